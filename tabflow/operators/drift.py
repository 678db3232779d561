"""Train-versus-test drift: which columns tell the two tables apart.

Null ratios, constants and ranges come from one aggregate and histograms from one pass with the
ranges as constants. For the stacked table, quantiles are selected by counting, and separability
and common categories are decided by the bounds and filters of ``side_tests``. The checks that
give every value rest on one table of value counts, (feature, value, n0, n1) with running totals
per side.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from tabflow.functions import fixed_values as fv
from tabflow.functions import temporal as tm
from tabflow.operators import schema as sc
from tabflow.operators.metrics import auc_of_counts, unpivot_numbers
from tabflow.operators.profile import missing
from tabflow.operators.ranking import present, quantile_of_ranks, running_totals
from tabflow.scratch import materialize

SIDE = "is_test"


def side_profile(df: DataFrame, columns: Sequence[str], side: str = SIDE) -> DataFrame:
    """(feature, null_0, null_1, constant_0, constant_1): null ratio and "at most one value" per side."""
    wide = df.agg(*[F.struct(*_null_stats(df, c, (0, 1), side)).alias(c) for c in columns])
    return wide.unpivot([], [f"`{c}`" for c in columns], "feature", "s").select("feature", "s.*")


def _null_stats(df: DataFrame, c: str, sides: Sequence[int], side: str) -> list:
    out = []
    for s in sides:
        here = F.col(side) == s
        value = F.when(here & ~missing(df, c), F.col(f"`{c}`"))
        ratio = F.try_divide(F.count_if(here & missing(df, c)).cast("double"), F.count_if(here))
        out += [ratio.alias(f"null_{s}"), F.coalesce(F.min(value) == F.max(value), F.lit(True)).alias(f"constant_{s}")]
    return out


def both_profiles(df: DataFrame, columns: Sequence[str], numeric: Sequence[str], side: str = SIDE) -> tuple[DataFrame, DataFrame]:
    """``side_profile`` of ``columns`` and ``side_ranges`` of ``numeric`` from one aggregate, as local tables of a row per column."""
    kinds = dict(df.dtypes)
    # sums over longs and doubles stay in a hash aggregate, least and greatest texts need a sorting one
    texts = [c for c in columns if kinds[c] == "string"]
    short = df.withColumns({c: F.when(F.col(f"`{c}`").isNotNull(), F.xxhash64(F.col(f"`{c}`"))) for c in texts}) if texts else df

    def by_side(rows: DataFrame, names: Sequence[str], numbers: Sequence[str]) -> dict[int, Row]:
        present_ = lambda c: F.when(~missing(rows, c), F.col(f"`{c}`"))
        number = lambda c: present_(c) if kinds[c] == "double" else F.when(~F.isnan(F.col(f"`{c}`").cast("double")), F.col(f"`{c}`").cast("double"))
        stats = [F.struct(F.count_if(missing(rows, c)), F.coalesce(F.min(present_(c)) == F.max(present_(c)), F.lit(True))).alias(f"p{i}") for i, c in enumerate(names)]
        ranges = [F.struct(F.min(number(c)), F.max(number(c))).alias(f"r{i}") for i, c in enumerate(numbers)]
        on = F.when(F.col(side) == 0, 0).when(F.col(side) == 1, 1)
        # one row a side
        return {r["__on"]: r for r in rows.withColumn("__on", on).filter("__on is not null").groupBy("__on").agg(F.count(F.lit(1)).alias("n"), *stats, *ranges).collect()}

    found = by_side(short, columns, numeric)
    stats = {c: [(f[f"p{i}"][0] / f["n"], f[f"p{i}"][1]) if (f := found.get(s)) else (None, True) for s in (0, 1)] for i, c in enumerate(columns)}
    # texts with different hashes differ; where a side has one hash only, the texts themselves decide
    doubt = [c for c in texts if any(constant for _, constant in stats[c])]
    if doubt:
        exact = by_side(df, doubt, [])
        for i, c in enumerate(doubt):
            stats[c] = [(null, exact[s][f"p{i}"][1] if s in exact else True) for s, (null, _) in zip((0, 1), stats[c])]
    make = df.sparkSession.createDataFrame
    profile = make([(c, *stats[c][0], *stats[c][1]) for c in columns], "feature string, null_0 double, constant_0 boolean, null_1 double, constant_1 boolean")
    span = lambda i, s: tuple(found[s][f"r{i}"]) if s in found else (None, None)
    ranges = make([(c, *span(i, 0), *span(i, 1)) for i, c in enumerate(numeric)], "feature string, min_0 double, max_0 double, min_1 double, max_1 double")
    return profile, ranges


def null_or_constant(df: DataFrame, columns: Sequence[str], *, side: str = SIDE, null_gap: float = fv.NULL_GAP, profile: DataFrame | None = None) -> DataFrame:
    """The profile with ``drifted``: null ratios far apart, or constant on exactly one side."""
    wide_gap = F.abs(F.col("null_0") - F.col("null_1")) >= null_gap
    return (side_profile(df, columns, side) if profile is None else profile).withColumn("drifted", F.coalesce(wide_gap, F.lit(False)) | (F.col("constant_0") != F.col("constant_1")))


def value_table(df: DataFrame, columns: Sequence[str], *, side: str = SIDE, partitions: int | None = None) -> DataFrame:
    """(feature, value, n0, n1, before0, before1): distinct values with counts and running totals per side."""
    long = present(unpivot_numbers(df, columns, [side]), "value")
    counts = long.groupBy("feature", "value").agg(F.count_if(F.col(side) == 0).alias("n0"), F.count_if(F.col(side) == 1).alias("n1"))
    ranked = running_totals(counts, group=["feature"], order=["value"], sums={"before0": F.col("n0"), "before1": F.col("n1")}, partitions=partitions)
    return materialize(ranked, "values")


def range_profile(values: DataFrame, probs: tuple[float, float] = fv.RANGE_QUANTILES) -> DataFrame:
    """Per feature: low and high quantile of both sides."""
    totals = values.groupBy("feature").agg(F.sum("n0").alias("total0"), F.sum("n1").alias("total1"))
    # one row per column of the table
    v = values.join(F.broadcast(totals), "feature")
    parts = [quantile_of_ranks("value", p, f"n{s}", f"before{s}", f"total{s}").alias(f"{name}_{s}") for s in (0, 1) for name, p in zip(("q_low", "q_high"), probs)]
    return v.groupBy("feature").agg(*parts)


def side_ranges(df: DataFrame, columns: Sequence[str], side: str = SIDE) -> DataFrame:
    """(feature, min_0, max_0, min_1, max_1) of numeric columns from one aggregate; null and NaN do not count."""
    def stats(i: int, c: str):
        number = F.col(f"`{c}`").cast("double")
        on = lambda s: F.when((F.col(side) == s) & ~F.isnan(number), number)
        return [f(on(s)).alias(f"{n}_{s}_{i}") for s in (0, 1) for n, f in (("min", F.min), ("max", F.max))]

    wide = df.agg(*[e for i, c in enumerate(columns) for e in stats(i, c)])
    one = lambda i, c: F.struct(F.lit(c).alias("feature"), *[F.col(f"{n}_{s}_{i}").alias(f"{n}_{s}") for s in (0, 1) for n in ("min", "max")])
    return wide.select(F.explode(F.array(*[one(i, c) for i, c in enumerate(columns)])).alias("r")).select("r.*")


def disjoint(low_0: str, high_0: str, low_1: str, high_1: str, eps: float = 0.0):
    """The two ranges do not meet; false if a side has no value."""
    c = F.col
    return F.coalesce((c(high_0) + eps < c(low_1)) | (c(high_1) + eps < c(low_0)), F.lit(False))


def quantile_disjoint(profile: DataFrame) -> DataFrame:
    return profile.select("feature", "q_low_0", "q_high_0", "q_low_1", "q_high_1", disjoint("q_low_0", "q_high_0", "q_low_1", "q_high_1", fv.RANGE_EPS).alias("drifted"))


def minmax_disjoint(profile: DataFrame) -> DataFrame:
    return profile.select("feature", "min_0", "max_0", "min_1", "max_1", disjoint("min_0", "max_0", "min_1", "max_1").alias("drifted"))


def cell_counts(df: DataFrame, edges: Mapping[str, tuple[float, float]], cells: int, side: str = SIDE) -> DataFrame:
    """(feature, cell, n0, n1): rows of both sides in equal cells of each column's range, its ends included.

    Tasks count Arrow batches and send one row for each cell they met.
    """
    spans = list(edges.values())

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros((2, len(spans), cells), dtype=np.int64)
        for batch in batches:
            on = batch.column(0).to_numpy()
            for k, (lo, hi) in enumerate(spans):
                v = batch.column(k + 1).to_numpy(zero_copy_only=False)
                for s in (0, 1):
                    own = v[(v >= lo) & (v <= hi) & (on == s)]
                    with np.errstate(all="ignore"):
                        at = np.nan_to_num(np.minimum(np.floor((own - lo) / ((hi - lo) / cells)), cells - 1))
                    n[s, k] += np.bincount(at.astype(np.int64), minlength=cells)
        k, at = np.nonzero(n.sum(axis=0))
        yield pa.RecordBatch.from_pydict({"f": pa.array(k, pa.int32()), "cell": pa.array(at, pa.int32()), "n0": n[0, k, at], "n1": n[1, k, at]})

    on = F.when(F.col(side) == 0, 0).when(F.col(side) == 1, 1).otherwise(-1)
    rows = df.select(on.alias("s"), *[F.col(f"`{c}`").cast("double").alias(f"v{i}") for i, c in enumerate(edges)])
    found = rows.mapInArrow(count, "f int, cell int, n0 long, n1 long").groupBy("f", "cell").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    return found.select(F.get(F.array(*[F.lit(c) for c in edges]), F.col("f")).alias("feature"), "cell", "n0", "n1")


def histogram_overlap(df: DataFrame, columns: Sequence[str], *, ranges: DataFrame | None = None, side: str = SIDE, bins: int = fv.HISTOGRAM_BINS, limit: float = fv.MIN_OVERLAP) -> DataFrame:
    """Overlap of the density histograms over the common range, and ``drifted`` if it is at most ``limit``.

    One pass over the rows with the ranges (``side_ranges``, one row per column) as constants;
    nothing is ranked. A common range without width also counts as drifted; features with an
    empty side do not appear.
    """
    known = (side_ranges(df, columns, side) if ranges is None else ranges).filter("min_0 is not null and min_1 is not null")
    common = {r["feature"]: (max(r["min_0"], r["min_1"]), min(r["max_0"], r["max_1"])) for r in known.collect() if r["feature"] in columns}
    spark = df.sparkSession
    edges = spark.createDataFrame([(c, lo, hi) for c, (lo, hi) in common.items()], "feature string, lo double, hi double")
    wide = {c: span for c, span in common.items() if span[1] > span[0]}
    if not wide:
        return edges.select("feature", "lo", "hi", F.lit(None).cast("double").alias("overlap"), F.lit(True).alias("drifted"))
    long = cell_counts(df, wide, bins, side)
    # at most ``bins`` cells per column
    all_cells = Window.partitionBy("feature")
    share = lambda s: F.try_divide(F.col(f"n{s}").cast("double"), F.sum(f"n{s}").over(all_cells))
    shares = long.select("feature", F.least(share(0), share(1)).alias("both")).groupBy("feature").agg(F.sum("both").alias("overlap"))
    out = edges.join(shares, "feature", "left")
    return out.select("feature", "lo", "hi", "overlap", (F.coalesce("overlap", F.lit(0.0)) <= limit).alias("drifted"))


def separable(values: DataFrame, *, limit: float = fv.SEPARABLE_AUC) -> DataFrame:
    """Folded univariate AUC per feature (0.5 if a side is empty); ``drifted`` at or above the limit."""
    auc = values.groupBy("feature").agg(auc_of_counts("n1", "n0", "before0").alias("a"))
    folded = F.coalesce(F.greatest("a", 1.0 - F.col("a")), F.lit(0.5))
    return auc.select("feature", folded.alias("auc"), (folded >= limit).alias("drifted"))


def disjoint_categories(df: DataFrame, columns: Sequence[str], *, side: str = SIDE) -> DataFrame:
    """(feature, n_values, n_shared, drifted): no value on both sides; null counts as a value."""
    texts = df.select(side, *[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("nan")).alias(c) for c in columns])
    long = texts.unpivot([side], [f"`{c}`" for c in columns], "feature", "value")
    per_value = long.groupBy("feature", "value").agg(F.max((F.col(side) == 0).cast("int")).alias("s0"), F.max((F.col(side) == 1).cast("int")).alias("s1"))
    return per_value.groupBy("feature").agg(
        F.count(F.lit(1)).alias("n_values"), F.count_if((F.col("s0") == 1) & (F.col("s1") == 1)).alias("n_shared")
    ).withColumn("drifted", F.col("n_shared") == 0)


@dataclass
class DriftFrame:
    """The stacked table that a drift model is trained on, and why columns were dropped."""

    table: DataFrame
    entity_key: str | None
    time_key: str | None
    dropped: dict[str, str] = field(default_factory=dict)

    @property
    def features(self) -> list[str]:
        return [c for c in self.table.columns if c not in (SIDE, "__row")]


def prepare_side(df: DataFrame, dim: DataFrame | None, entity: str | None, time: str | None) -> DataFrame:
    """Date parts, dimension columns, placeholders as null."""
    if time and time in df.columns:
        df = df.withColumn(time, tm.to_time(F.col(f"`{time}`"), dict(df.dtypes)[time]))
        df = df.withColumns(tm.date_parts(F.col(f"`{time}`")))
    if dim is not None and entity and entity in df.columns:
        df = sc.join_dimension(df, dim, entity)
    return sc.clean_placeholders(df)


def drift_frame(train: DataFrame, test: DataFrame, dim: DataFrame | None = None, *, key: str | None = None) -> DriftFrame:
    """Clean both tables, drop what separates them trivially, stack the rest with ``is_test``.

    Dropped: the target and columns named like one, ids, the raw time column, columns only one
    table has, and columns flagged by the null/constant, range, histogram, separability and
    category checks. The entity key stays. ``key`` names a row id to carry along as ``__row``.
    """
    from tabflow.operators import side_tests  # which builds on this module

    original = (train.columns, test.columns)
    roles = [sc.detect_roles(t.columns) for t in (train, test)]
    sides, entities, times = [], [], []
    for table, role in zip((train, test), roles):
        if role.combined_key and isinstance(table.schema[role.combined_key].dataType, StringType):
            table, num, time = sc.split_key_columns(table, role.combined_key)
            entities.append(role.entity_key or num)
            times.append(role.datetime or time)
        else:
            entities.append(role.entity_key)
            times.append(role.datetime)
        sides.append(table)
    entity = entities[0] or entities[1] or sc.first_integer_column(train)
    time = times[0] or times[1] or sc.first_time_like(train.columns)
    if key:
        sides = [s.withColumn("__row", F.col(key)) for s in sides]
    # dates are parsed and cells cleaned once; deciding on numbers reads the written table
    sides = [materialize(prepare_side(s, dim, entity, time), "drift-side") for s in sides]
    # each table decides on its own; a column stays numeric only if both agree
    sides = [sc.coerce_numeric_like(s) for s in sides]
    left, right = sides
    dropped: dict[str, str] = {}
    for c in (roles[0].target, "answer", "target", "y", "num_date_time", "id", "row_id", key):
        if c and (c in left.columns or c in right.columns):
            dropped[c] = "target or id"
    if time:
        dropped[time] = "raw time"
    for c in fv.HARD_DROPS:
        if c in left.columns:
            dropped[c] = "listed"
    for c in sc.target_like_columns(*original):
        dropped.setdefault(c, "named like a target")
    for c in set(left.columns) ^ set(right.columns):
        dropped.setdefault(c, "only in one table")
    for c in (entity, "__row"):
        dropped.pop(c, None)
    common = [c for c in left.columns if c in right.columns and c not in dropped and c != "__row"]
    numeric = [c for c in common if c in sc.numeric_columns(left) and c in sc.numeric_columns(right)]
    texts = [c for c in common if c not in numeric]
    as_text = lambda s: s.select(*[F.col(f"`{c}`") for c in numeric], *[F.col(f"`{c}`").cast("string").alias(c) for c in texts], *(["__row"] if key else []))
    table = sc.aligned_union(as_text(left), as_text(right), label=SIDE)
    table = materialize(table, "drift")  # several profiling passes read it

    def drop(found: DataFrame, reason: str, keep_entity: bool = True) -> None:
        for r in found.filter("drifted").collect():  # at most one row per column
            if r["feature"] != entity or not keep_entity:
                dropped.setdefault(r["feature"], reason)

    checked = [c for c in common if c != entity]
    profile, ranges = both_profiles(table, checked, numeric)
    drop(null_or_constant(table, checked, profile=profile), "nulls or constant on one side")
    live = [c for c in numeric if c not in dropped]
    if live:
        ranges = ranges.filter(F.col("feature").isin(live))
        # ranges that are further apart than the tolerance have disjoint quantile ranges too
        apart = disjoint("min_0", "max_0", "min_1", "max_1", fv.RANGE_EPS)
        drop(ranges.select("feature", apart.alias("drifted")), "disjoint quantile ranges")
        drop(minmax_disjoint(ranges), "disjoint ranges")
        live = [c for c in live if c not in dropped]
        drop(histogram_overlap(table, live, ranges=ranges), "histograms hardly overlap")
        live = [c for c in live if c not in dropped]
    if live:
        # quantiles are selected, not ranked; only columns whose bounds enclose the limit are ranked
        drop(quantile_disjoint(side_tests.quantile_ranges(table, live)), "disjoint quantile ranges")
        drop(side_tests.separable_bounded(table, live, ranges=ranges), "separable", keep_entity=False)
    rest = [c for c in texts if c not in dropped]
    if rest:
        drop(side_tests.disjoint_by_filters(table, rest), "no common category", keep_entity=False)
    return DriftFrame(table.drop(*dropped), entity, time, dropped)
