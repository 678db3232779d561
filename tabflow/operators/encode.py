"""Fitted encodings: frequencies, top-k groups, vocabularies, target means, class weights.

A fitted table has one row per distinct value with the number of rows ``n`` that carry it.
It is written once, and applied by a lookup join that is safe for hot values.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabflow.functions import fixed_values as fv
from tabflow.operators.lookup import lookup_join
from tabflow.operators.ranking import row_positions
from tabflow.operators.selection import select_quantiles
from tabflow.scratch import materialize


def value_counts(df: DataFrame, *columns: str, weight: str | None = None) -> DataFrame:
    """Rows per distinct value, null included; of counted rows, the sum of ``weight``."""
    return df.groupBy(*columns).agg((F.sum(weight) if weight else F.count(F.lit(1))).alias("n"))


def fit_top_values(df: DataFrame, value: str, top: int, *, weight: str | None = None) -> DataFrame:
    """(value, n, freq, is_top): the ``top`` most frequent values, ties by value ascending."""
    counts = materialize(value_counts(df.filter(F.col(value).isNotNull()), value, weight=weight), "counts")
    best = counts.orderBy(F.desc("n"), value).limit(top).select(value, F.lit(True).alias("is_top"))
    # the broadcast side has at most ``top`` rows
    flagged = counts.join(F.broadcast(best), value, "left")
    return materialize(flagged.select(value, "n", F.col("n").alias("freq"), F.coalesce("is_top", F.lit(False)).alias("is_top")), "top_values")


def apply_top_values(df: DataFrame, value: str, fitted: DataFrame, prefix: str, *, rare: Column | None = None, other: str = "OTHER") -> DataFrame:
    """Add ``<prefix>_topk``, ``_freq``, ``_freq_log1p`` and ``_is_rare``; unseen values are
    ``other`` with frequency 0. ``rare`` is a condition on ``freq`` and ``is_top``; by default
    everything outside the top is rare."""
    keyed = df.withColumn("__value", F.col(f"`{value}`"))
    joined = lookup_join(keyed, fitted.withColumnRenamed(value, "__value"), ["__value"], weight="n")
    known = joined.withColumns({"freq": F.coalesce("freq", F.lit(0)).cast("long"), "is_top": F.coalesce("is_top", F.lit(False))})
    rare = ~F.col("is_top") if rare is None else rare
    return known.withColumns({
        f"{prefix}_topk": F.when(F.col("is_top"), F.col("__value")).otherwise(other),
        f"{prefix}_freq": F.col("freq"),
        f"{prefix}_freq_log1p": F.log1p("freq"),
        f"{prefix}_is_rare": rare.cast("int"),
    }).drop("__value", "freq", "is_top")


def fit_vocabulary(df: DataFrame, fields: Sequence[str], *, partitions: int | None = None) -> DataFrame:
    """(field, value, n, idx): per field, sorted distinct values numbered from 2; null is "None".

    Index 0 is padding and 1 is any unknown value, so a field's size is its count plus 2.
    """
    narrow = df.select(*[category_text(c).alias(c) for c in fields])
    counts = value_counts(narrow.unpivot([], list(fields), "field", "value"), "field", "value")
    placed = row_positions(counts, group=["field"], order=["value"], partitions=partitions)
    return materialize(placed.select("field", "value", "n", (F.col("pos") - 1 + fv.FIRST_INDEX).alias("idx")), "vocabulary")


def category_text(c: str) -> Column:
    """Identifier as text; whole numbers never carry a decimal part."""
    return F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("None"))


def apply_vocabulary(df: DataFrame, vocabulary: DataFrame, fields: Sequence[str], suffix: str = "_idx") -> DataFrame:
    """Add ``<field>_idx`` per field; unknown values get 1."""
    for c in fields:
        table = vocabulary.filter(F.col("field") == c).select(F.col("value").alias("__value"), "n", F.col("idx").alias("__idx"))
        df = lookup_join(df.withColumn("__value", category_text(c)), table, ["__value"], weight="n")
        df = df.withColumn(f"{c}{suffix}", F.coalesce("__idx", F.lit(fv.UNKNOWN_INDEX)).cast("long")).drop("__value", "__idx")
    return df


def vocabulary_sizes(vocabulary: DataFrame) -> DataFrame:
    return vocabulary.groupBy("field").agg((F.count(F.lit(1)) + fv.FIRST_INDEX).alias("size"))


def target_sums(df: DataFrame, value: str, label: str, *by: str) -> DataFrame:
    return df.groupBy(value, *by).agg(
        F.count(label).alias("n"), F.sum(F.col(label).cast("double")).alias("s"), F.sum(F.col(label).cast("double") ** 2).alias("ss")
    )


def smoothed_mean(n: Column, s: Column, ss: Column, n_all: Column, s_all: Column, ss_all: Column, smoothing: float | str) -> Column:
    """Mean of a category drawn towards the overall mean.

    A number adds that many rows of the overall mean. "auto" weighs the two means by the
    variance within the category against the overall variance (empirical Bayes).
    """
    overall = s_all / n_all
    if smoothing == "auto":
        within = F.greatest(F.lit(0.0), F.try_divide(ss, n) - F.try_divide(s, n) * F.try_divide(s, n))
        spread = F.greatest(F.lit(0.0), ss_all / n_all - overall * overall)
        weight = F.try_divide(spread * n, spread * n + within)
        return F.coalesce(weight * F.try_divide(s, n) + (1.0 - weight) * overall, overall)
    return F.coalesce(F.try_divide(s + F.lit(float(smoothing)) * overall, n + F.lit(float(smoothing))), overall)


def target_encode_crossfit(df: DataFrame, value: str, label: str, fold: str, *, smoothing: float | str = "auto", name: str | None = None) -> DataFrame:
    """Add the target mean of each row's value computed from all other folds.

    Works on sums per (value, fold): leaving a fold out is a subtraction, so the rows are
    read once for the sums and once for the lookup, whatever the number of folds is.
    """
    name, key = name or f"{value}_te", "__value"
    keyed = df.withColumn(key, F.coalesce(F.col(f"`{value}`").cast("string"), F.lit(fv.MISSING_CATEGORY)))
    cells = materialize(target_sums(keyed, key, label, fold), "target_sums")
    sums = lambda *by: cells.groupBy(*by).agg(F.sum("n").alias("n_t"), F.sum("s").alias("s_t"), F.sum("ss").alias("ss_t"))
    per_value = materialize(sums(key).withColumn("__w", F.lit(1)), "target_values")
    per_fold = sums(fold).select(fold, F.col("n_t").alias("n_f"), F.col("s_t").alias("s_f"), F.col("ss_t").alias("ss_f"), F.lit(1).alias("__w"))
    every = cells.agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("ss").alias("ss")).first()
    table = lookup_join(lookup_join(cells, per_value, [key], weight="__w"), materialize(per_fold, "target_folds"), [fold], weight="__w")
    c = F.col
    encoded = smoothed_mean(
        c("n_t") - c("n"), c("s_t") - c("s"), c("ss_t") - c("ss"),
        F.lit(float(every["n"])) - c("n_f"), F.lit(every["s"]) - c("s_f"), F.lit(every["ss"]) - c("ss_f"), smoothing,
    )
    table = materialize(table.select(key, fold, "n", encoded.alias(name)), "target_encoding")
    return lookup_join(keyed, table, [key, fold], weight="n").drop(key)


def fit_target_encoding(train: DataFrame, value: str, label: str, *, smoothing: float | str = "auto") -> tuple[DataFrame, float]:
    """Full-fit table (value, n, encoding) for unseen rows and the overall mean for unknown values."""
    keyed = train.select(F.coalesce(F.col(f"`{value}`").cast("string"), F.lit(fv.MISSING_CATEGORY)).alias("__value"), label)
    sums = materialize(target_sums(keyed, "__value", label), "target_sums")
    every = sums.agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("ss").alias("ss")).first()
    lit = lambda v: F.lit(float(v))
    encoded = smoothed_mean(F.col("n"), F.col("s"), F.col("ss"), lit(every["n"]), lit(every["s"]), lit(every["ss"]), smoothing)
    return materialize(sums.select("__value", "n", encoded.alias("__te")), "target_encoding"), every["s"] / every["n"]


def apply_target_encoding(df: DataFrame, value: str, fitted: tuple[DataFrame, float], *, name: str | None = None) -> DataFrame:
    table, overall = fitted
    keyed = df.withColumn("__value", F.coalesce(F.col(f"`{value}`").cast("string"), F.lit(fv.MISSING_CATEGORY)))
    out = lookup_join(keyed, table, ["__value"], weight="n")
    return out.withColumn(name or f"{value}_te", F.coalesce("__te", F.lit(overall))).drop("__value", "__te")


def fit_medians(df: DataFrame, columns: Sequence[str]) -> dict[str, float]:
    """Exact medians of numeric columns, nulls ignored; one number per column."""
    return {r["feature"]: r["q0"] for r in select_quantiles(df, columns, [0.5]).collect()}


def fit_medians_without(df: DataFrame, columns: Sequence[str], fold: str) -> dict[object, dict[str, float]]:
    """For every fold the exact medians of the rows outside it; all folds share the passes."""
    found: dict[object, dict[str, float]] = {}
    rows = df.select(F.col(fold).alias("__fold"), *[F.col(f"`{c}`") for c in columns])
    for r in select_quantiles(rows, columns, [0.5], group=["__fold"], leave_out=True).collect():
        found.setdefault(r["__fold"], {})[r["feature"]] = r["q0"]
    return found


def impute_medians(df: DataFrame, medians: dict[str, float]) -> DataFrame:
    return df.withColumns({c: F.coalesce(F.nanvl(F.col(f"`{c}`").cast("double"), F.lit(None)), F.lit(m)) for c, m in medians.items()})


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """(label, n, weight): n_all / (classes · n), one row per class."""
    counts = materialize(value_counts(df, label), "classes")
    every = counts.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("k")).first()
    return counts.select(label, "n", (F.lit(float(every["n"] or 0)) / (F.lit(every["k"]) * F.col("n"))).alias("weight"))


def class_weights_without(df: DataFrame, label: str, fold: str) -> DataFrame:
    """(fold, label, n, weight): ``class_weights`` of the rows outside each fold, from one count."""
    counts = materialize(value_counts(df.select(F.col(fold).alias("__fold"), F.col(label).alias("__label")), "__fold", "__label"), "classes")
    # one row per fold beside one per fold and class
    pairs = counts.select(F.col("__fold").alias("__out")).distinct().join(counts, F.col("__out") != F.col("__fold"))
    outside = pairs.groupBy("__out", "__label").agg(F.sum("n").alias("n"))
    every = Window.partitionBy("__out")
    weight = F.sum("n").over(every).cast("double") / (F.count(F.lit(1)).over(every) * F.col("n"))
    return outside.select(F.col("__out").alias(fold), F.col("__label").alias(label), "n", weight.alias("weight"))


def add_class_weights(df: DataFrame, label: str, name: str = "weight") -> DataFrame:
    table = materialize(class_weights(df, label).withColumnRenamed("weight", name), "class_weights")
    return lookup_join(df, table, [label], weight="n")
