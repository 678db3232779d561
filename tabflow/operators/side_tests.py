"""Tests that tell two sides of a table apart from counts of bounded size.

Separability of a column is bounded from both sides by a coarse histogram: a pair of rows in
different cells is ordered for certain, a pair in one cell may stand either way. Only columns whose
bounds enclose the limit are ranked. That two columns of categories share no value is shown by a
Bloom filter of each side: where the filters have no bit in common nothing is shared, and where
they have, a few of the values behind common bits are compared, which ends the search at the first
shared one. Whatever the filters leave open is compared in full, so every answer is exact.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabflow.functions import fixed_values as fv
from tabflow.operators.drift import SIDE, cell_counts, disjoint_categories, separable, side_ranges, value_table
from tabflow.operators.selection import select_quantiles
from tabflow.scratch import materialize

CELLS = 256
# Doubt of a bound that rounding may cause.
DOUBT = 1e-12
# Bits of a side's filter of one column, and common bits whose values are compared first.
FILTER_BITS = 1 << 20
PROBES = 256


def quantile_ranges(df: DataFrame, columns: Sequence[str], *, side: str = SIDE, probs: tuple[float, float] = fv.RANGE_QUANTILES, **options) -> DataFrame:
    """Per feature the low and high quantile of both sides, by selection; equal to ``drift.range_profile``."""
    found = select_quantiles(df, columns, probs, group=[side], **options)
    on = lambda s, q: F.max(F.when(F.col(side) == s, F.col(q)))
    return found.groupBy("feature").agg(*[on(s, f"q{i}").alias(f"{name}_{s}") for s in (0, 1) for i, name in enumerate(("q_low", "q_high"))])


def separability_bounds(df: DataFrame, columns: Sequence[str], *, side: str = SIDE, ranges: DataFrame | None = None, cells: int = CELLS) -> DataFrame:
    """(feature, low, high): bounds of the folded univariate AUC, from one pass over the rows.

    Columns with an empty side, or of one value, have 0.5 twice.
    """
    spark = df.sparkSession
    # one row per column
    known = {r["feature"]: r for r in (side_ranges(df, columns, side) if ranges is None else ranges).collect() if r["feature"] in columns}
    edges, open_, flat = {}, [], []
    for c in columns:
        r = known.get(c)
        if r is None or r["min_0"] is None or r["min_1"] is None:
            flat.append(c)
            continue
        lo, hi = min(r["min_0"], r["min_1"]), max(r["max_0"], r["max_1"])
        if lo == hi:
            flat.append(c)
        elif math.isfinite(hi - lo) and (hi - lo) / cells > 0:
            edges[c] = (lo, hi)
        else:
            open_.append(c)
    fixed = spark.createDataFrame([(c, 0.5, 0.5) for c in flat] + [(c, 0.5, 1.0) for c in open_], "feature string, low double, high double")
    if not edges:
        return fixed
    counts = cell_counts(df, edges, cells, side)
    # at most ``cells`` rows a column
    below = F.coalesce(F.sum("n0").over(Window.partitionBy("feature").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = counts.withColumn("below", below).groupBy("feature").agg(
        F.sum(F.col("n1").cast("double") * F.col("below")).alias("sure"), F.sum(F.col("n1").cast("double") * F.col("n0")).alias("tied"), (F.sum("n1").cast("double") * F.sum("n0")).alias("pairs")
    )
    least, most = F.col("sure") / F.col("pairs"), (F.col("sure") + F.col("tied")) / F.col("pairs")
    low = F.when(least >= 0.5, least).when(most <= 0.5, 1.0 - most).otherwise(F.lit(0.5))
    return sums.select("feature", low.alias("low"), F.greatest(most, 1.0 - least).alias("high")).unionByName(fixed)


def separable_bounded(df: DataFrame, columns: Sequence[str], *, side: str = SIDE, limit: float = fv.SEPARABLE_AUC, ranges: DataFrame | None = None, cells: int = CELLS) -> DataFrame:
    """(feature, low, high, auc, drifted): ``drifted`` as ``drift.separable`` has it.

    ``auc`` is given for the columns that the bounds left open and that were ranked, else null.
    """
    bounds = materialize(separability_bounds(df, columns, side=side, ranges=ranges, cells=cells), "auc-bounds")
    undecided = (F.col("high") + DOUBT >= limit) & (F.col("low") - DOUBT < limit)
    ranked = [r["feature"] for r in bounds.filter(undecided).select("feature").collect()]  # columns of the table
    out = bounds.filter(~undecided).select("feature", "low", "high", F.lit(None).cast("double").alias("auc"), (F.col("low") >= limit).alias("drifted"))
    if not ranked:
        return out
    exact = separable(value_table(df, ranked, side=side), limit=limit)
    return out.unionByName(bounds.join(exact, "feature").select("feature", "low", "high", "auc", "drifted"))


def _positions(value, bits: int):
    return [F.pmod(F.xxhash64(value, F.lit(k)), F.lit(bits)) for k in (1, 2)]


def side_filters(texts: DataFrame, *, side: str = SIDE, bits: int = FILTER_BITS) -> DataFrame:
    """(feature, word, bits_0, bits_1): Bloom filters of both sides of every column, from one aggregate.

    ``texts`` is long: (side, feature, value). Words without a bit are not stored.
    """
    placed = texts.select(side, "feature", F.explode(F.array(*_positions(F.col("value"), bits))).alias("at"))
    bit = F.expr("shiftleft(1L, cast(at % 64 as int))")
    on = lambda s: F.coalesce(F.bit_or(F.when(F.col(side) == s, bit)), F.lit(0).cast("long"))
    return placed.groupBy("feature", F.floor(F.col("at") / 64).alias("word")).agg(on(0).alias("bits_0"), on(1).alias("bits_1"))


def disjoint_by_filters(df: DataFrame, columns: Sequence[str], *, side: str = SIDE, bits: int = FILTER_BITS, probes: int = PROBES) -> DataFrame:
    """(feature, n_common, decided, drifted): whether no value is on both sides; null counts as a value.

    ``n_common`` bits are set in both filters. ``decided`` says by what: "filter" if there is none,
    "probe" if a shared value was found behind the first of them, or all were looked at, else "values".
    """
    spark = df.sparkSession
    texts = df.select(side, *[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("nan")).alias(c) for c in columns])
    long = texts.unpivot([side], [f"`{c}`" for c in columns], "feature", "value")
    common = side_filters(long, side=side, bits=bits).withColumn("both", F.col("bits_0").bitwiseAND(F.col("bits_1"))).filter("both <> 0")
    common = materialize(common.select("feature", "word", "both"), "common-bits")
    n_common = {r["feature"]: r["n"] for r in common.groupBy("feature").agg(F.sum(F.bit_count("both")).alias("n")).collect()}  # one row per column
    spread = common.select("feature", "word", F.explode(F.expr("filter(sequence(0, 63), i -> getbit(both, i) = 1)")).alias("bit")).select("feature", (F.col("word") * 64 + F.col("bit")).alias("at"))
    first = spread.withColumn("nth", F.row_number().over(Window.partitionBy("feature").orderBy("at"))).filter(F.col("nth") <= probes).select("feature", "at")
    # at most ``probes`` rows a column
    looked = long.withColumn("at", _positions(F.col("value"), bits)[0]).join(F.broadcast(first), ["feature", "at"])
    per_value = looked.groupBy("feature", "value").agg(F.count_if(F.col(side) == 0).alias("n0"), F.count_if(F.col(side) == 1).alias("n1"))
    shared = {r["feature"] for r in per_value.filter("n0 > 0 and n1 > 0").select("feature").distinct().collect()} if n_common else set()
    rows, left = [], []
    for c in columns:
        n = n_common.get(c, 0)
        if not n:
            rows.append((c, 0, "filter", True))
        elif c in shared or n <= probes:
            rows.append((c, n, "probe", c not in shared))
        else:
            left.append(c)
    out = spark.createDataFrame(rows, "feature string, n_common long, decided string, drifted boolean")
    if not left:
        return out
    exact = disjoint_categories(df, left, side=side)
    counts = spark.createDataFrame([(c, n_common[c]) for c in left], "feature string, n_common long")
    return out.unionByName(exact.join(counts, "feature").select("feature", "n_common", F.lit("values").alias("decided"), "drifted"))
