"""Exact quantiles by distributed selection: counting passes narrow in on order statistics.

``ranking.exact_quantiles`` orders all distinct values to read a few of them. Selection counts
instead. Each pass cuts the bracket around a wanted order statistic into ``BINS`` cells and counts
the rows of each, with their least and greatest value; the cell that holds the statistic, shrunk
to the values it really has, is the next bracket. Rows are summed in every map task, so a pass
moves at most ``BINS`` rows per bracket and task, for all columns and groups at once. When few rows
are left in a bracket, or after ``ROUNDS`` passes whatever is left, their values are counted one by
one and ranked: the answer is always exact, and no value outside the brackets is ever sorted.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce
from operator import and_

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabflow.operators.lookup import BROADCAST_ROWS
from tabflow.operators.ranking import exact_quantiles, present, running_totals
from tabflow.scratch import materialize

BINS = 2048
ROUNDS = 3
# Values of a bracket that one task may rank.
SMALL = 50_000
_LARGEST = 1.7e308
# Up to so many brackets, of groups of these types, are counted on columns as they stand; more of them on long rows.
COLUMN_BRACKETS = 256
_GROUP_TYPES = ("string", "boolean", "tinyint", "smallint", "int", "bigint")


def _cell(value: Column, lo: Column, hi: Column, bins: int) -> Column:
    """Number of the equal cell of [lo, hi] that a value lies in; never falls as the value grows."""
    low, high = F.greatest(lo, F.lit(-_LARGEST)), F.least(hi, F.lit(_LARGEST))
    width = high / bins - low / bins
    at = F.floor(F.least(F.greatest(F.try_divide(value - low, width), F.lit(0.0)), F.lit(float(bins - 1)))).cast("int")
    return F.when(width > 0, at).otherwise(F.when(value == lo, F.lit(0)).otherwise(F.lit(1)))


def _same(left: str, right: str, keys: Sequence[str]) -> Column:
    return reduce(and_, [F.col(f"{left}.`{k}`").eqNullSafe(F.col(f"{right}.`{k}`")) for k in keys], F.lit(True))


def _inside(long: DataFrame, brackets: DataFrame, keys: Sequence[str], leave_out: bool = False) -> DataFrame:
    """Rows of ``long`` that lie in a bracket, with it: (keys, lo, hi, value); with ``leave_out`` rows of other groups than the bracket's."""
    spans = brackets.select(*keys, "lo", "hi").distinct().groupBy(*keys).agg(F.collect_list(F.struct("lo", "hi")).alias("spans"))
    # one row per group and column, a few brackets each: counted before the first pass
    match = ~_same("__l", "__b", keys[:-1]) & _same("__l", "__b", keys[-1:]) if leave_out else _same("__l", "__b", keys)
    joined = long.alias("__l").join(F.broadcast(spans.alias("__b")), match)
    here = F.explode(F.filter("spans", lambda s: (F.col("value") >= s["lo"]) & (F.col("value") <= s["hi"]))).alias("span")
    found = joined.select(*[F.col(f"__b.`{k}`" if leave_out else f"__l.`{k}`").alias(k) for k in keys], "value", here)
    return found.select(*keys, F.col("span.lo").alias("lo"), F.col("span.hi").alias("hi"), "value")


class _Columns:
    """Counting passes over columns as they stand: tasks compare Arrow batches with every bracket and send its cells only."""

    def __init__(self, narrow: DataFrame, group: Sequence[str], columns: Sequence[str], left: DataFrame, leave_out: bool = False):
        self.leave_out = leave_out
        self.group, self.columns, self.fits = list(group), list(columns), all(dict(narrow.dtypes)[g] in _GROUP_TYPES for g in group)
        found = left.select(*group, "feature", "lo", "hi").distinct().limit(COLUMN_BRACKETS + 1).collect() if self.fits else []
        self.fits = self.fits and len(found) <= COLUMN_BRACKETS
        if not self.fits:
            return
        of = lambda r: tuple(r[g] for g in group)
        groups = list(dict.fromkeys(map(of, found)))
        self.spans = [(groups.index(of(r)), self.columns.index(r["feature"]), r["lo"], r["hi"]) for r in found]
        kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in left.select(*group, "feature", "lo", "hi").schema)
        self.table = narrow.sparkSession.createDataFrame([(*r, k) for k, r in enumerate(found)], f"{kinds}, __span int")
        which = F.lit(-1)
        for k, values in enumerate(groups):
            which = F.when(reduce(and_, [F.col(f"`{g}`").eqNullSafe(F.lit(v)) for g, v in zip(group, values)], F.lit(True)), F.lit(k)).otherwise(which)
        self.rows = narrow.select(which.alias("__group"), *[F.col(f"`{c}`").alias(f"__v{i}") for i, c in enumerate(self.columns)])

    def _named(self, counted: DataFrame) -> DataFrame:
        # one row per bracket
        return counted.join(F.broadcast(self.table), "__span").drop("__span")

    def _held(self):
        """A function that gives the values of a batch inside each bracket."""
        spans, leave_out = self.spans, self.leave_out

        def held(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray]]:
            group = batch.column(0).to_numpy()
            values = [c.to_numpy(zero_copy_only=False) for c in batch.columns[1:]]
            for k, (g, c, lo, hi) in enumerate(spans):
                v = values[c]
                yield k, v[(v >= lo) & (v <= hi) & ((group != g) if leave_out else (group == g))]

        return held

    def cells(self, bins: int) -> DataFrame:
        """(keys, lo, hi, cell, n, cell_lo, cell_hi); cells are those of ``_cell``."""
        spans, held = self.spans, self._held()

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            n, low, high = np.zeros((len(spans), bins), np.int64), np.full((len(spans), bins), np.inf), np.full((len(spans), bins), -np.inf)
            for batch in batches:
                for k, v in held(batch):
                    lo, hi = spans[k][2:]
                    first, last = max(lo, -_LARGEST), min(hi, _LARGEST)
                    width = last / bins - first / bins
                    with np.errstate(over="ignore"):
                        at = np.floor(np.clip((v - first) / width, 0.0, bins - 1.0)).astype(np.int64) if width > 0 else (v != lo).astype(np.int64)
                    n[k] += np.bincount(at, minlength=bins)
                    np.minimum.at(low[k], at, v)
                    np.maximum.at(high[k], at, v)
            k, at = np.nonzero(n)
            yield pa.RecordBatch.from_pydict({"__span": pa.array(k, pa.int32()), "cell": pa.array(at, pa.int32()), "n": n[k, at], "low": low[k, at], "high": high[k, at]})

        sent = self.rows.mapInArrow(count, "__span int, cell int, n long, low double, high double")
        return self._named(sent.groupBy("__span", "cell").agg(F.sum("n").alias("n"), F.min("low").alias("cell_lo"), F.max("high").alias("cell_hi")))

    def values(self) -> DataFrame:
        """(keys, lo, hi, value, n) of the values inside the brackets."""
        held = self._held()

        def inside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for k, v in held(batch):
                    if len(v):
                        yield pa.RecordBatch.from_pydict({"__span": pa.array(np.full(len(v), k), pa.int32()), "value": v})

        return self._named(self.rows.mapInArrow(inside, "__span int, value double").groupBy("__span", "value").agg(F.count(F.lit(1)).alias("n")))


def _chosen(wanted: DataFrame, ranked: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``wanted`` with the row of ``ranked`` (keys, lo, hi, before, n, …) that holds its statistic."""
    on = [*keys, "lo", "hi"]
    match = reduce(and_, [F.col(f"__w.`{k}`").eqNullSafe(F.col(f"__r.`{k}`")) for k in on])
    held = (F.col("__r.before") + F.col("__w.below") <= F.col("__w.k")) & (F.col("__w.k") < F.col("__r.before") + F.col("__w.below") + F.col("__r.n"))
    return wanted.alias("__w").join(ranked.alias("__r"), match & held)


def order_statistics(long: DataFrame, base: DataFrame, ranks: Column, keys: Sequence[str], *, bins: int = BINS, rounds: int = ROUNDS, small: int = SMALL, narrow: tuple | None = None, leave_out: bool = False) -> DataFrame:
    """(keys, k, value) for every rank (from 0) that ``ranks``, an array over ``base`` (keys, n, lo, hi), asks for.

    ``narrow`` is the table that ``long`` was unpivoted from, with its group and its columns.
    With ``leave_out`` ranks are among the rows outside the group.
    """
    wanted = base.select(*keys, F.explode(ranks).alias("k"), "lo", "hi", F.lit(0).cast("long").alias("below"), F.col("n").alias("inside"))
    wanted = materialize(wanted, "brackets")
    done = wanted.filter("lo = hi").select(*keys, "k", F.col("lo").alias("value"))
    for _ in range(rounds):
        left = wanted.filter("lo < hi")
        if (left.agg(F.max("inside")).first()[0] or 0) <= small:
            break
        direct = _Columns(*narrow, left, leave_out) if narrow else None
        if direct and direct.fits and bins > 1:
            cells = direct.cells(bins)
        else:
            cells = _inside(long, left, keys, leave_out).withColumn("cell", _cell(F.col("value"), F.col("lo"), F.col("hi"), bins))
            cells = cells.groupBy(*keys, "lo", "hi", "cell").agg(F.count(F.lit(1)).alias("n"), F.min("value").alias("cell_lo"), F.max("value").alias("cell_hi"))
        # at most ``bins`` cells a bracket
        ahead = Window.partitionBy(*keys, "lo", "hi").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
        ranked = cells.withColumn("before", F.coalesce(F.sum("n").over(ahead), F.lit(0)))
        found = _chosen(left, ranked, keys)
        wanted = found.select(*[F.col(f"__w.`{k}`").alias(k) for k in keys], "k", F.col("cell_lo").alias("lo"), F.col("cell_hi").alias("hi"), (F.col("below") + F.col("before")).alias("below"), F.col("n").alias("inside"))
        wanted = materialize(wanted, "brackets")
        done = done.unionByName(wanted.filter("lo = hi").select(*keys, "k", F.col("lo").alias("value")))
    left = wanted.filter("lo < hi")
    most = left.agg(F.max("inside")).first()[0]
    if most:
        direct = _Columns(*narrow, left, leave_out) if narrow else None
        if direct and direct.fits:
            counts = direct.values()
        else:
            counts = _inside(long, left, keys, leave_out).groupBy(*keys, "lo", "hi", "value").agg(F.count(F.lit(1)).alias("n"))
        ranked = running_totals(counts, group=[*keys, "lo", "hi"], order=["value"], sums={"before": F.col("n")}, bounded=most <= small)
        found = _chosen(left, ranked, keys)
        done = done.unionByName(found.select(*[F.col(f"__w.`{k}`").alias(k) for k in keys], "k", "value"))
    return materialize(done, "order-statistics")


def _ranges_outside(narrow: DataFrame, group: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """(keys, n, lo, hi) of the present values outside each group; a group without any has a part of its own, too."""
    value = F.when(F.col("value").isNotNull() & ~F.isnan("value"), F.col("value"))
    parts = narrow.unpivot(list(group), [f"`{c}`" for c in columns], "feature", "value").groupBy(*group, "feature")
    parts = materialize(parts.agg(F.count(value).alias("n"), F.min(value).alias("lo"), F.max(value).alias("hi")), "group-ranges")
    # one row per group beside one per group and column
    pairs = parts.select(*group).distinct().alias("__g").join(parts.alias("__p"), ~_same("__g", "__p", group))
    keys = [*[F.col(f"__g.`{g}`").alias(g) for g in group], "feature"]
    return pairs.groupBy(*keys).agg(F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi")).filter("n > 0")


def select_quantiles(df: DataFrame, columns: Sequence[str], probs: Sequence[float], *, group: Sequence[str] = (), bins: int = BINS, rounds: int = ROUNDS, small: int = SMALL, leave_out: bool = False) -> DataFrame:
    """(group…, feature, q0, q1, …): interpolated quantiles of numeric columns, null and NaN left out.

    Equal to ``exact_quantiles`` of the unpivoted columns. ``df`` is read once for each pass and
    should be a scan. More groups than ``BROADCAST_ROWS`` are ordered instead. With ``leave_out``
    a group's quantiles are those of all rows outside it, for a few groups such as folds.
    """
    keys = [*group, "feature"]
    narrow = df.select(*group, *[F.col(f"`{c}`").cast("double").alias(c) for c in columns])
    long = present(narrow.unpivot(list(group), [f"`{c}`" for c in columns], "feature", "value"), "value")
    base = materialize(_ranges_outside(narrow, group, columns) if leave_out else long.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min("value").alias("lo"), F.max("value").alias("hi")), "value-ranges")
    if base.count() > BROADCAST_ROWS:
        if leave_out:
            groups = base.select(*group).distinct().alias("__g")
            long = long.alias("__l").join(groups, ~_same("__l", "__g", group)).select(*[F.col(f"__g.`{g}`").alias(g) for g in group], "feature", "value")
        return exact_quantiles(long, "value", probs, group=keys)
    at = [(F.col("n") - 1) * F.lit(float(p)) for p in probs]
    ranks = F.array_distinct(F.array(*[f(a).cast("long") for a in at for f in (F.floor, F.ceil)]))
    found = order_statistics(long, base, ranks, keys, bins=bins, rounds=rounds, small=small, narrow=(narrow, group, columns), leave_out=leave_out)
    # two statistics for each probability at most
    known = found.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("k", "value"))).alias("__known"))
    joined = base.alias("__base").join(known.alias("__k"), reduce(and_, [F.col(f"__base.`{k}`").eqNullSafe(F.col(f"__k.`{k}`")) for k in keys]))

    def quantile(a: Column) -> Column:
        low, high = F.element_at("__known", F.floor(a).cast("long")), F.element_at("__known", F.ceil(a).cast("long"))
        return F.when(low == high, low).otherwise(low + (high - low) * (a - F.floor(a)))

    return joined.select(*[F.col(f"__base.`{k}`").alias(k) for k in keys], *[quantile(a).alias(f"q{i}") for i, a in enumerate(at)])
