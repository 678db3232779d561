"""Order-dependent operators that never put a whole group into one task.

A window partitioned by a group runs each group in a single task. Groups here may hold a
large share of all rows (one score model, one class, one episode), so ranks and running
totals are built in two levels: rows are range-partitioned by (group, order), each range
block is numbered and written once, windows run inside (block, group) with one task per
block, and the totals of earlier blocks are added. A block continues at most one group from the block before it,
so the table of carried totals has fewer rows than there are blocks and can be broadcast.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabflow.operators.lookup import lookup_join
from tabflow.scratch import materialize

BLOCK = "__block"


def range_blocks(df: DataFrame, group: Sequence[str], order: Sequence[str | Column], partitions: int | None = None) -> DataFrame:
    """Rows range-partitioned by (group, order) with their block number, written once."""
    keys = [as_column(c) for c in [*group, *order]]
    ranged = df.repartitionByRange(partitions, *keys) if partitions else df.repartitionByRange(*keys)
    return materialize(ranged.withColumn(BLOCK, F.spark_partition_id()), "blocks")


def running_totals(
    df: DataFrame,
    *,
    group: Sequence[str] = (),
    order: Sequence[str | Column],
    sums: Mapping[str, Column] | None = None,
    lags: Mapping[str, Column] | None = None,
    partitions: int | None = None,
    bounded: bool = False,
) -> DataFrame:
    """Add running values over the rows that precede each row of its group.

    ``sums`` maps an output name to an expression; the output is its total over all earlier
    rows (0 for the first). ``lags`` maps an output name to an expression; the output is its
    value on the previous row (null for the first). ``order`` must be unique in a group, and
    ascending where ``lags`` are asked for. ``bounded`` states that the caller has counted the
    rows and one task can take any group; a plain window is used then.
    """
    sums, lags = dict(sums or {}), dict(lags or {})
    if bounded:
        w = Window.partitionBy(*(group or [F.lit(0)])).orderBy(*order)
        earlier = w.rowsBetween(Window.unboundedPreceding, -1)
        return df.select("*", *[F.coalesce(F.sum(e).over(earlier), F.lit(0)).alias(n) for n, e in sums.items()], *[F.lag(e).over(w).alias(n) for n, e in lags.items()])
    rows = range_blocks(df, group, order, partitions)
    position = F.struct(*[as_column(c) for c in order]) if lags else None
    blocks = rows.groupBy(BLOCK, *group).agg(
        *[F.sum(e).alias(f"__sum_{n}") for n, e in sums.items()],
        *[F.max_by(e, position).alias(f"__last_{n}") for n, e in lags.items()],
        F.count(F.lit(1)).alias("__n"),
    )
    by_group = Window.partitionBy(*group).orderBy(BLOCK) if group else Window.partitionBy(F.lit(0)).orderBy(BLOCK)
    earlier = by_group.rowsBetween(Window.unboundedPreceding, -1)
    carried = (
        blocks.select(
            F.col(BLOCK).alias("__carry_block"),
            *[F.col(g).alias(f"__carry_{g}") for g in group],
            *[F.sum(f"__sum_{n}").over(earlier).alias(f"__carry_sum_{n}") for n in sums],
            *[F.lag(f"__last_{n}").over(by_group).alias(f"__carry_last_{n}") for n in lags],
            F.row_number().over(by_group).alias("__nth"),
        )
        .filter("__nth > 1")
        .drop("__nth")
    )
    match = F.col(BLOCK) == F.col("__carry_block")
    for g in group:
        match = match & F.col(g).eqNullSafe(F.col(f"__carry_{g}"))
    inside = Window.partitionBy(BLOCK, *group).orderBy(*order)
    before = inside.rowsBetween(Window.unboundedPreceding, -1)
    # one task per block: the files written are the blocks that hold rows
    local = rows.repartitionById(max(1, len(rows.inputFiles())), F.col(BLOCK)).select(
        "*",
        *[F.sum(e).over(before).alias(f"__sum_{n}") for n, e in sums.items()],
        *[F.lag(e).over(inside).alias(f"__last_{n}") for n, e in lags.items()],
        *([F.row_number().over(inside).alias("__row")] if lags else []),
    )
    # fewer rows than range blocks: at most one continued group per block
    joined = local.join(F.broadcast(carried), match, "left")
    zero = F.lit(0)
    return joined.select(
        *[F.col(c) for c in df.columns],
        *[(F.coalesce(f"__sum_{n}", zero) + F.coalesce(f"__carry_sum_{n}", zero)).alias(n) for n in sums],
        *[F.when(F.col("__row") == 1, F.col(f"__carry_last_{n}")).otherwise(F.col(f"__last_{n}")).alias(n) for n in lags],
    )


def row_positions(df: DataFrame, *, group: Sequence[str] = (), order: Sequence[str | Column], name: str = "pos", partitions: int | None = None) -> DataFrame:
    """Add the 1-based position of each row in its group; ``order`` must be unique in a group."""
    out = running_totals(df, group=group, order=order, sums={name: F.lit(1)}, partitions=partitions)
    return out.withColumn(name, (F.col(name) + 1).cast("long"))


def value_ranks(df: DataFrame, value: str, *, group: Sequence[str] = (), partitions: int | None = None) -> DataFrame:
    """One row per distinct non-null (group, value): its count ``n``, ``total`` rows of the
    group, rows ``before`` it, average-tie rank ``avg_rank`` and ``pct_rank`` = rank / total."""
    counts = present(df, value).groupBy(*group, value).agg(F.count(F.lit(1)).alias("n"))
    ranked = running_totals(counts, group=group, order=[value], sums={"before": F.col("n")}, partitions=partitions)
    ranked = with_group_total(ranked, group, "n", "total")
    rank = F.col("before") + (F.col("n") + 1) / 2.0
    return ranked.select("*", rank.alias("avg_rank"), (rank / F.col("total")).alias("pct_rank"))


def percent_rank_avg(df: DataFrame, value: str, *, group: Sequence[str] = (), name: str = "pct_rank", partitions: int | None = None) -> DataFrame:
    """Add the average-tie percent rank of ``value`` in its group; null values get null."""
    ranks = value_ranks(df, value, group=group, partitions=partitions)
    table = materialize(ranks.select(*group, value, "n", F.col("pct_rank").alias(name)), "ranks")
    return lookup_join(df, table, [*group, value], weight="n").select(*df.columns, name)


def exact_quantiles(df: DataFrame, value: str, probs: Sequence[float], *, group: Sequence[str] = (), partitions: int | None = None) -> DataFrame:
    """Interpolated quantiles per group as columns ``q0``, ``q1``, … in the order of ``probs``.

    The built-in exact percentile gathers all distinct values of a group in one task; this
    reads the two neighbouring order statistics from the ranked value counts instead.
    """
    ranks = value_ranks(df, value, group=group, partitions=partitions)
    return ranks.groupBy(*group).agg(*[quantile_of_ranks(value, p).alias(f"q{i}") for i, p in enumerate(probs)])


def quantile_of_ranks(value: str, prob: float, n: str = "n", before: str = "before", total: str = "total") -> Column:
    """Aggregate expression: the interpolated quantile from ranked value counts."""
    at = (F.col(total) - 1) * F.lit(float(prob))
    holds = lambda k: (F.col(before) <= k) & (k < F.col(before) + F.col(n))
    low = F.max(F.when(holds(F.floor(at)), F.col(value)))
    high = F.max(F.when(holds(F.ceil(at)), F.col(value)))
    part = F.max(at - F.floor(at))
    return low + (high - low) * part


def with_group_total(df: DataFrame, group: Sequence[str], measure: str, name: str) -> DataFrame:
    """Add the group's total of ``measure``; the totals are one row per group."""
    totals = materialize(df.groupBy(*group).agg(F.sum(measure).alias(name), F.count(F.lit(1)).alias("__w")), "totals")
    if not group:
        row = totals.first()
        return df.withColumn(name, F.lit(row[name] if row else None).cast(totals.schema[name].dataType))
    return lookup_join(df, totals, list(group), weight="__w").drop("__w")


def as_column(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def present(df: DataFrame, value: str) -> DataFrame:
    """Rows whose ``value`` is neither null nor NaN."""
    keep = F.col(value).isNotNull()
    if dict(df.dtypes)[value] in ("float", "double"):
        keep = keep & ~F.isnan(value)
    return df.filter(keep)


def top_rows(df: DataFrame, n: int, order: Sequence[Column], *, within: str | None = None) -> DataFrame:
    """First ``n`` rows by ``order``, overall or for each value of ``within``.

    Overall it is a map-side top-n. For groups the ``row_number() <= n`` filter lets Spark cut
    every map task to n rows per group before the shuffle, up to the session's group-limit
    threshold. Beyond it a group may be large, and rows are numbered in range blocks instead;
    ``order`` must then tell the rows of a group apart.
    """
    if within is None:
        return df.orderBy(*order).limit(n)
    if n > int(df.sparkSession.conf.get("spark.sql.optimizer.windowGroupLimitThreshold")):
        return row_positions(df, group=[within], order=order, name="__nth").filter(F.col("__nth") <= n).drop("__nth")
    number = F.row_number().over(Window.partitionBy(within).orderBy(*order))
    return df.withColumn("__nth", number).filter(F.col("__nth") <= n).drop("__nth")
