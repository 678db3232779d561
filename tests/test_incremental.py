from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tabflow.sources import cache


def build(part):
    return part.groupBy("k").agg(F.sum("v").alias("total"), F.count(F.lit(1)).alias("n"))


def content(found):
    return sorted(map(tuple, found.data.collect()), key=str)


def table(spark, rows):
    return spark.createDataFrame(rows, "k string, v long").repartition(3)


ROWS = [(f"k{i % 40}", i) for i in range(400)] + [(None, 7), (None, 8)]


def test_only_changed_parts_are_built(spark, tmp_path):
    root, calls = str(tmp_path / "cache"), []

    def counted(part):
        calls.append(part.select("k").distinct().count())
        return build(part)

    def run(rows, params=None):
        return cache.incremental_dataset(spark, root, params or {"p": 1}, table(spark, rows), ["k"], counted, parts=16)

    first = run(ROWS)
    assert content(first) == sorted(map(tuple, build(table(spark, ROWS)).collect()), key=str) and not first.kept and calls == [41]
    again = run(ROWS[::-1])
    assert content(again) == content(first) and again.rebuilt == [] and sorted(again.kept) == sorted(first.rebuilt) and len(calls) == 1
    changed = [(k, v + 1 if k == "k3" else v) for k, v in ROWS]
    third = run(changed)
    assert content(third) == sorted(map(tuple, build(table(spark, changed)).collect()), key=str)
    assert len(third.rebuilt) == 1 and len(third.kept) == len(first.rebuilt) - 1 and calls[1] < 10
    # a key leaves, one comes
    moved = [r for r in ROWS if r[0] != "k5"] + [("new", 1)]
    fourth = run(moved)
    assert content(fourth) == sorted(map(tuple, build(table(spark, moved)).collect()), key=str) and 1 <= len(fourth.rebuilt) <= 3
    # other parameters are another dataset
    assert len(run(ROWS, {"p": 2}).rebuilt) == len(first.rebuilt)


def test_parts_without_rows_are_dropped(spark, tmp_path):
    root = str(tmp_path / "cache")
    run = lambda rows: cache.incremental_dataset(spark, root, {}, table(spark, rows), ["k"], build, parts=64)
    full = run(ROWS)
    few = run(ROWS[:1])
    assert content(few) == [("k0", 0, 1)] and few.dropped and set(few.dropped) | set(few.rebuilt) | set(few.kept) == set(full.rebuilt)
    none = run([])
    assert none.data.count() == 0 and none.data.columns == ["k", "total", "n"]
    # what an older manifest names can go, what the last one names stays
    run(ROWS[:3])
    assert cache.drop_stale(spark, root) > 0 and content(run(ROWS[:3])) == content(cache.incremental_dataset(spark, str(tmp_path / "other"), {}, table(spark, ROWS[:3]), ["k"], build, parts=64))
    assert run(ROWS[:3]).rebuilt == []


def test_a_failed_build_changes_nothing(spark, tmp_path):
    root = str(tmp_path / "cache")
    good = cache.incremental_dataset(spark, root, {}, table(spark, ROWS), ["k"], build, parts=8)
    with pytest.raises(Exception, match="broken|boom"):
        cache.incremental_dataset(spark, root, {}, table(spark, [("k1", 1)]), ["k"], lambda p: p.select("k", F.raise_error(F.lit("boom")).cast("long").alias("total")), parts=8)
    assert cache.incremental_dataset(spark, root, {}, table(spark, ROWS), ["k"], build, parts=8).rebuilt == [] and good.data.count() == 41
    with pytest.raises(ValueError, match="changed the key"):
        cache.incremental_dataset(spark, root, {}, table(spark, [(k, 5) for k, _ in ROWS[:1]]), ["k"], lambda p: p.select(F.explode(F.transform(F.sequence(F.lit(1), F.lit(60)), lambda i: F.concat(F.lit("x"), i))).alias("k"), "v"), parts=8)


def test_an_input_without_rows(spark, tmp_path):
    found = cache.incremental_dataset(spark, str(tmp_path / "c"), {}, table(spark, []), ["k"], build)
    assert found.data.count() == 0 and found.rebuilt == []


def test_fingerprints_of_over_a_million_rows(spark):
    # the sums of the hashes of these rows are beyond a long
    rows = spark.range(1_300_000).select(F.col("id").alias("v"), F.lit("k").alias("k"))
    whole = cache.table_fingerprint(rows)
    assert whole.startswith("1300000-") and whole == cache.table_fingerprint(rows.repartition(3, "v"))
    assert whole != cache.table_fingerprint(rows.withColumn("v", F.when(F.col("v") == 1, 2).otherwise(F.col("v"))))
    (part,) = cache.part_fingerprints(rows, ["k"], 1).values()
    assert part.startswith("1300000-")
    assert cache.table_fingerprint(spark.range(3).select("id")) == "3-" + whole_of_three(spark)


def whole_of_three(spark):
    """The checksums of three rows, summed as plain numbers."""
    h = [tuple(r) for r in spark.range(3).select(F.xxhash64("id"), F.shiftrightunsigned(F.xxhash64(F.xxhash64("id"), F.lit(1)), 20)).collect()]
    return f"{h[0][0] ^ h[1][0] ^ h[2][0]:x}-{sum(s for _, s in h):x}"
