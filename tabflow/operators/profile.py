"""Table profiles: nulls, duplicates, summaries, distinct values, histograms."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabflow.operators.ranking import present


def missing(df: DataFrame, column: str) -> Column:
    """Null or NaN."""
    c = F.col(f"`{column}`")
    return (c.isNull() | F.isnan(c)) if dict(df.dtypes)[column] in ("float", "double") else c.isNull()


def null_profile(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(column, n_null, null_ratio) from one aggregate over all columns."""
    columns = list(columns or df.columns)
    counts = df.agg(F.count(F.lit(1)).alias("__rows"), *[F.count_if(missing(df, c)).alias(c) for c in columns])
    long = counts.unpivot(["__rows"], [f"`{c}`" for c in columns], "column", "n_null")
    return long.select("column", "n_null", F.try_divide(F.col("n_null").cast("double"), F.col("__rows")).alias("null_ratio"))


def null_ratios(df: DataFrame, columns: Sequence[str] | None = None) -> dict[str, float]:
    return {r["column"]: r["null_ratio"] or 0.0 for r in null_profile(df, columns).collect()}


def most_nulls(df: DataFrame, n: int = 20) -> DataFrame:
    return null_profile(df).orderBy(F.desc("n_null"), "column").limit(n)


def row_identity(df: DataFrame, column: str) -> Column:
    """The column as a grouping key: long texts by length and SHA-256, so that whole texts are not shuffled.

    The length keeps a digest apart from a short text that reads the same.
    """
    c = F.col(f"`{column}`")
    return F.struct(F.length(c).alias("n"), F.when(F.length(c) > 64, F.sha2(c, 256)).otherwise(c).alias("key")).alias(column) if dict(df.dtypes)[column] == "string" else c


def duplicate_rows(df: DataFrame, exclude: Sequence[str] = ()) -> DataFrame:
    """Rows, distinct rows and rows beyond the first of equal ones; null equals null."""
    columns = [row_identity(df, c) for c in df.columns if c not in exclude]
    per_row = df.groupBy(*columns).agg(F.count(F.lit(1)).alias("__n"))
    return per_row.agg(
        F.coalesce(F.sum("__n"), F.lit(0)).alias("n_rows"), F.count(F.lit(1)).alias("n_distinct"), F.coalesce(F.sum(F.col("__n") - 1), F.lit(0)).alias("n_duplicates")
    )


def type_counts(df: DataFrame) -> dict[str, int]:
    out: dict[str, int] = {}
    for _, t in df.dtypes:
        out[t] = out.get(t, 0) + 1
    return out


def overview(df: DataFrame, key: str) -> dict:
    """Shape, types, columns with most nulls, duplicate rows with and without the key."""
    every, without = duplicate_rows(df).first(), duplicate_rows(df, [key]).first()
    return {
        "rows": every["n_rows"], "columns": len(df.columns), "type_counts": type_counts(df), "types": dict(df.dtypes),
        "most_nulls": {r["column"]: r["n_null"] for r in most_nulls(df).collect()},
        "duplicates": every["n_duplicates"], "duplicates_without_key": without["n_duplicates"],
    }


def summary(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, count, mean, std, min, max) of numeric columns; std is the sample deviation."""
    long = present(df.select(*[F.col(f"`{c}`").cast("double").alias(c) for c in columns]).unpivot([], [f"`{c}`" for c in columns], "column", "value"), "value")
    return long.groupBy("column").agg(
        F.count("value").alias("count"), F.avg("value").alias("mean"), F.stddev("value").alias("std"), F.min("value").alias("min"), F.max("value").alias("max")
    )


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    return df.select(column).distinct()


def side_ranges(df: DataFrame, column: str, side: str) -> DataFrame:
    """Minimum, maximum and null ratio of one column per table side."""
    return df.groupBy(side).agg(F.min(column).alias("low"), F.max(column).alias("high"), F.avg(missing(df, column).cast("double")).alias("null_ratio"))


def target_distribution(df: DataFrame, target: str) -> DataFrame:
    """Rows and share per class, the null class included."""
    counts = df.groupBy(target).agg(F.count(F.lit(1)).alias("n"))
    every = df.count()
    return counts.withColumn("share", F.col("n") / F.lit(float(max(1, every))))


def histogram(df: DataFrame, value: str, low: float, high: float, bins: int, *, side: str | None = None) -> DataFrame:
    """Counts in ``bins`` equal bins over [low, high]; the last bin is closed, values outside are left out."""
    c = F.col(value)
    width = (high - low) / bins
    index = F.least(F.floor((c - F.lit(low)) / F.lit(width)), F.lit(bins - 1)).cast("int")
    inside = present(df, value).filter((c >= low) & (c <= high))
    return inside.groupBy(*([side] if side else []), index.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def column_histograms(df: DataFrame, columns: Sequence[str], bins: int = 10) -> DataFrame:
    """Counts per (column, bin) over each column's own range, read in two passes for all columns."""
    long = present(df.select(*[F.col(f"`{c}`").cast("double").alias(c) for c in columns]).unpivot([], [f"`{c}`" for c in columns], "column", "value"), "value")
    ranges = long.groupBy("column").agg(F.min("value").alias("low"), F.max("value").alias("high"))
    # one row per column of the table
    joined = long.join(F.broadcast(ranges), "column")
    at = F.floor((F.col("value") - F.col("low")) / ((F.col("high") - F.col("low")) / bins))
    index = F.when(F.col("high") > F.col("low"), F.least(at, F.lit(bins - 1))).otherwise(0).cast("int")
    return joined.groupBy("column", index.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
