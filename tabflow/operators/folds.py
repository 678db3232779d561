"""Seeded fold and split assignment as narrow (key, fold) tables.

Assignment follows a hash order of the key, so it does not depend on how rows are
partitioned. Exact fold sizes need positions; those come from range blocks, so a class or a
table of any size is split without passing one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabflow.operators.ranking import row_positions, top_rows, with_group_total
from tabflow.operators.validate import ValidationError, duplicate_keys


def hash_order(key: str, seed: int) -> Column:
    return F.xxhash64(F.col(key).cast("string"), F.lit(seed))


def group_folds(df: DataFrame, group: str, n_folds: int, *, seed: int = 42, order: Column | None = None) -> DataFrame:
    """Folds 0 … n-1 over distinct groups in shuffled order; earlier folds get the extra groups."""
    groups = df.select(group).distinct().withColumn("__o", hash_order(group, seed) if order is None else order)
    placed = row_positions(groups, order=["__o", group]).withColumn("__one", F.lit(1))
    placed = with_group_total(placed, (), "__one", "__n")
    at, size, extra = F.col("pos") - 1, F.floor(F.col("__n") / n_folds), F.col("__n") % n_folds
    wide = extra * (size + 1)
    fold = F.when(at < wide, F.floor(F.try_divide(at, size + 1))).otherwise(extra + F.floor(F.try_divide(at - wide, size)))
    return placed.select(group, fold.cast("int").alias("fold"))


def group_holdout(df: DataFrame, group: str, *, share: float = 0.2, seed: int = 42, order: Column | None = None) -> DataFrame:
    """One split: the first ceil(share · groups) shuffled groups are ``is_valid``."""
    groups = df.select(group).distinct().withColumn("__o", hash_order(group, seed) if order is None else order)
    placed = with_group_total(row_positions(groups, order=["__o", group]).withColumn("__one", F.lit(1)), (), "__one", "__n")
    return placed.select(group, (F.col("pos") <= F.ceil(F.col("__n") * F.lit(share))).alias("is_valid"))


def stratified_folds(df: DataFrame, key: str, label: str, n_folds: int, *, seed: int = 42, order: Column | None = None) -> DataFrame:
    """Folds 1 … n; every class is spread over the folds with sizes that differ by at most one."""
    rows = df.select(key, label, (hash_order(key, seed) if order is None else order).alias("__o"))
    placed = row_positions(rows, group=[label], order=["__o", key])
    return placed.select(key, ((F.col("pos") - 1) % n_folds + 1).cast("int").alias("fold"))


def plain_folds(df: DataFrame, key: str, n_folds: int, *, seed: int = 42, order: Column | None = None) -> DataFrame:
    """Folds 1 … n of equal size, whatever the target is."""
    rows = df.select(key, (hash_order(key, seed) if order is None else order).alias("__o"))
    placed = row_positions(rows, order=["__o", key])
    return placed.select(key, ((F.col("pos") - 1) % n_folds + 1).cast("int").alias("fold"))


def random_split(df: DataFrame, key: str, *, share: float, stratify: str | None = None, seed: int = 42, order: Column | None = None) -> DataFrame:
    """A seeded split; ``share`` of the rows (of every class if stratified, rounded) is ``is_valid``."""
    group = [stratify] if stratify else []
    rows = df.select(key, *group, (hash_order(key, seed) if order is None else order).alias("__o"))
    placed = row_positions(rows, group=group, order=["__o", key]).withColumn("__one", F.lit(1))
    placed = with_group_total(placed, group, "__one", "__n")
    return placed.select(key, (F.col("pos") <= F.floor(F.col("__n") * F.lit(share) + 0.5)).alias("is_valid"))


def balanced_sample(df: DataFrame, key: str, label: str, *, n: int = 5000, seed: int = 42, order: Column | None = None) -> DataFrame:
    """Without replacement: up to max(1, n // 2) rows of each of the classes 0 and 1."""
    each = max(1, n // 2)
    rows = df.withColumn("__o", hash_order(key, seed) if order is None else order)
    parts = [top_rows(rows.filter(F.col(label) == c), each, [F.col("__o"), F.col(key)]) for c in (0, 1)]
    return parts[0].unionByName(parts[1]).drop("__o")


def fold_overlap(train: DataFrame, valid: DataFrame, group: str) -> DataFrame:
    """One row: distinct groups per side and groups on both sides (must be 0)."""
    sides = train.select(group, F.lit(1).alias("t"), F.lit(0).alias("v")).unionByName(valid.select(group, F.lit(0).alias("t"), F.lit(1).alias("v")))
    per_group = sides.groupBy(group).agg(F.max("t").alias("t"), F.max("v").alias("v"))
    return per_group.agg(F.sum("t").alias("n_train"), F.sum("v").alias("n_valid"), F.count_if((F.col("t") == 1) & (F.col("v") == 1)).alias("n_both"))


def split_by_groups(df: DataFrame, assigned: DataFrame, group: str, fold: int) -> tuple[DataFrame, DataFrame]:
    """Training and validation rows of one fold of a (group, fold) table."""
    chosen = assigned.filter(F.col("fold") == fold).select(group)
    return df.join(chosen, group, "left_anti"), df.join(chosen, group, "left_semi")


def sample_key_report(samples: DataFrame, key: str, split: str | None = None) -> DataFrame:
    """Samples, distinct keys and rows beyond the first of their key, per split."""
    by = [split] if split else []
    per_key = samples.groupBy(*by, key).agg(F.count(F.lit(1)).alias("n"))
    return per_key.groupBy(*by).agg(
        F.sum("n").alias("n_samples"), F.count(F.lit(1)).alias("n_keys"), F.sum(F.col("n") - 1).alias("n_duplicates")
    )


def require_one_sample_per_key(samples: DataFrame, key: str, split: str | None = None) -> None:
    """Fine-tuning needs one sample per episode in each split."""
    if sample_key_report(samples, key, split).filter("n_duplicates > 0").count():
        shown = [r[0] for r in duplicate_keys(samples, key).collect()]
        raise ValidationError(f"several samples for one {key}, e.g. {shown}")
