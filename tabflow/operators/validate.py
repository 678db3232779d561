"""Table checks: each ``*_report`` is a lazy one-row table, each ``require_*`` raises on a violation."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabflow.functions import fixed_values as fv


class ValidationError(ValueError):
    """A table does not meet a stated condition."""


def require_columns(df: DataFrame, columns: Iterable[str], name: str) -> None:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValidationError(f"{name}: missing columns {missing}; available: {df.columns}")


def key_report(df: DataFrame, key: str) -> DataFrame:
    """Rows, null keys, distinct keys, and rows beyond the first of their key."""
    per_key = df.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    known = F.col(key).isNotNull()
    return per_key.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"),
        F.coalesce(F.sum(F.when(~known, F.col("n"))), F.lit(0)).alias("n_null"),
        F.count_if(known).alias("n_keys"),
        F.coalesce(F.sum(F.when(known, F.col("n") - 1)), F.lit(0)).alias("n_duplicates"),
    )


def duplicate_keys(df: DataFrame, key: str, examples: int = 10) -> DataFrame:
    """The lowest duplicated keys with their counts."""
    counts = df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    return counts.filter("n > 1").orderBy(key).limit(examples)


def require_unique_key(df: DataFrame, key: str, name: str) -> None:
    report = key_report(df, key).first()
    if report["n_null"] or report["n_duplicates"]:
        shown = [r[0] for r in duplicate_keys(df, key).collect()]
        raise ValidationError(f"{name}: {report['n_null']} null and {report['n_duplicates']} duplicate values in {key}, e.g. {shown}")


def key_set_report(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Distinct keys only in the left (``n_extra``), only in the right (``n_missing``), in both."""
    side = lambda df, l, r: df.select(key, F.lit(l).alias("l"), F.lit(r).alias("r"))  # noqa: E731, E741
    per_key = side(left, 1, 0).unionByName(side(right, 0, 1)).groupBy(key).agg(F.max("l").alias("l"), F.max("r").alias("r"))
    return per_key.agg(
        F.count_if((F.col("l") == 1) & (F.col("r") == 0)).alias("n_extra"),
        F.count_if((F.col("l") == 0) & (F.col("r") == 1)).alias("n_missing"),
        F.count_if((F.col("l") == 1) & (F.col("r") == 1)).alias("n_common"),
    )


def require_same_keys(tables: Sequence[DataFrame], key: str) -> None:
    """Every table has the key set of the first one."""
    for i, other in enumerate(tables[1:], start=1):
        report = key_set_report(other, tables[0], key).first()
        if report["n_extra"] or report["n_missing"]:
            raise ValidationError(f"table {i}: {report['n_missing']} keys missing and {report['n_extra']} extra in {key}")


def mapped_label(column: str, labels: Mapping[str, int] = fv.LABELS) -> Column:
    """The number of a known label, else null."""
    value = F.when(F.lit(False), F.lit(0))
    for name, number in labels.items():
        value = value.when(F.col(f"`{column}`") == name, F.lit(number))
    return value


def unknown_labels(df: DataFrame, column: str, labels: Mapping[str, int] = fv.LABELS) -> DataFrame:
    """Labels outside the domain with their counts, null included."""
    return df.filter(mapped_label(column, labels).isNull()).groupBy(F.col(f"`{column}`").cast("string").alias("label")).agg(F.count(F.lit(1)).alias("n"))


def map_label(df: DataFrame, column: str, *, name: str = "target", labels: Mapping[str, int] = fv.LABELS) -> DataFrame:
    """Add the mapped label; any label outside the domain is an error."""
    unknown = [r["label"] for r in unknown_labels(df, column, labels).orderBy("label").limit(20).collect()]
    if unknown:
        raise ValidationError(f"unknown labels in {column}: {unknown}; allowed: {list(labels)}")
    return df.withColumn(name, mapped_label(column, labels))


def range_report(df: DataFrame, column: str) -> DataFrame:
    """Nulls (NaN included), minimum and maximum of a prediction column."""
    c = F.col(f"`{column}`")
    value = F.when(~F.isnan(c.cast("double")), c)
    return df.agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(value.isNull()).alias("n_null"), F.min(value).alias("low"), F.max(value).alias("high"))


def require_probabilities(df: DataFrame, column: str) -> None:
    r = range_report(df, column).first()
    if r["n_null"] or (r["n_rows"] and (r["low"] < 0.0 or r["high"] > 1.0)):
        raise ValidationError(f"{column}: {r['n_null']} missing, range [{r['low']}, {r['high']}] must be within [0, 1]")


def anchor_report(folds: DataFrame, key: str, anchors: Sequence[str]) -> DataFrame:
    """Largest difference of any anchor between the folds of one key."""
    gap = F.greatest(*[F.max(a) - F.min(a) for a in anchors]) if len(anchors) > 1 else F.max(anchors[0]) - F.min(anchors[0])
    return folds.groupBy(key).agg(gap.alias("gap")).agg(F.max("gap").alias("max_gap"))


def require_equal_anchors(folds: DataFrame, key: str, anchors: Sequence[str], tolerance: float = 1e-4) -> None:
    gap = anchor_report(folds, key, anchors).first()["max_gap"]
    if gap is not None and gap > tolerance:
        raise ValidationError(f"anchors of one {key} differ by {gap} between folds")


def require_complete_folds(folds: DataFrame, key: str, fold: str) -> int:
    """Every key occurs exactly once in every fold; returns the number of folds."""
    per_key = folds.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.count_distinct(fold).alias("k"))
    r = per_key.agg(F.min("n").alias("low"), F.max("n").alias("high"), F.min("k").alias("k_low"), F.max("k").alias("k_high")).first()
    k = folds.select(fold).distinct().count()
    if r["low"] is not None and {r["low"], r["high"], r["k_low"], r["k_high"]} != {k}:
        raise ValidationError(f"some {key} is missing or repeated in one of the {k} folds")
    return k
