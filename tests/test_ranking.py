from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tabflow.operators import lookup, ranking
from tabflow.scratch import materialize


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(7)
    # one group holds most rows, and one value most of that group
    data = [(i, "hot" if i % 4 else f"g{i % 12}", 0.5 if i % 3 else rng.randint(0, 40) / 40) for i in range(600)]
    return spark.createDataFrame(data + [(900, "hot", None), (901, "hot", float("nan"))], "id long, g string, v double")


@pytest.mark.parametrize("partitions", [1, 7, 23])
def test_running_totals_do_not_depend_on_partitions(rows, partitions):
    out = ranking.running_totals(rows.filter("id < 900"), group=["g"], order=["v", "id"], sums={"before": F.col("id")}, lags={"last": F.col("id")}, partitions=partitions).toPandas()
    want = out.sort_values(["g", "v", "id"])
    assert (want.groupby("g").id.cumsum() - want.id == want.before).all()
    assert (want.groupby("g").id.shift().fillna(-1) == want["last"].fillna(-1)).all()


@pytest.mark.parametrize("partitions", [1, 7])
def test_percent_rank_is_average_of_ties_and_skips_missing(rows, partitions):
    out = ranking.percent_rank_avg(rows, "v", group=["g"], partitions=partitions).toPandas()
    assert ((out.groupby("g").v.rank(pct=True) - out.pct_rank).abs().fillna(0) < 1e-12).all()
    assert out[out.id >= 900].pct_rank.isna().all() and len(out) == 602


def test_exact_quantiles_interpolate(rows):
    got = {r["g"]: r for r in ranking.exact_quantiles(rows, "v", [0.01, 0.5, 0.99], group=["g"], partitions=5).collect()}
    frame = rows.toPandas()
    for g, part in frame.groupby("g"):
        for i, q in enumerate((0.01, 0.5, 0.99)):
            assert got[g][f"q{i}"] == pytest.approx(part.v.quantile(q), abs=1e-12)


def test_quantiles_of_whole_table(rows):
    got = ranking.exact_quantiles(rows, "v", [0.25]).first()["q0"]
    assert got == pytest.approx(rows.toPandas().v.quantile(0.25))


def test_row_positions_descending_order(spark):
    df = spark.createDataFrame([(1, 5), (2, 9), (3, 7)], "id int, v int")
    out = {r["id"]: r["pos"] for r in ranking.row_positions(df, order=[F.desc("v"), F.col("id")], partitions=3).collect()}
    assert out == {2: 1, 3: 2, 1: 3}


def test_lookup_join_paths_agree(spark):
    rows = spark.createDataFrame([(i, "hot" if i % 3 == 0 else (None if i % 7 == 0 else f"k{i % 5}")) for i in range(200)], "id int, k string")
    table = materialize(rows.filter("k is not null and k <> 'k4'").groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("low")), "t")
    small = lookup.lookup_join(rows, table, ["k"], weight="n")
    large = lookup.lookup_join(rows, table, ["k"], weight="n", broadcast_rows=0, heavy_keys=1)
    assert small.columns == large.columns == ["id", "k", "low"]
    assert sorted(map(str, small.collect())) == sorted(map(str, large.collect()))
    assert small.count() == 200


def test_chained_large_lookups_read_the_rows_once_and_spread_hot_and_null_keys(spark):
    keys = F.when(F.col("id") % 3 > 0, F.lit(1)).when(F.col("id") % 7 == 0, F.lit(None)).otherwise(F.col("id"))
    rows = materialize(spark.range(3000).select("id", *[keys.alias(f"k{i}") for i in range(4)]), "rows")
    out = rows
    for i in range(4):
        table = materialize(rows.filter(f"k{i} is not null").groupBy(f"k{i}").agg(F.count(F.lit(1)).alias("n"), F.max("id").alias(f"x{i}")), "t")
        out = lookup.lookup_join(out, table, [f"k{i}"], weight="n", broadcast_rows=0, heavy_keys=4)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation") == 5  # the rows and four tables
    assert out.count() == 3000
    assert out.filter("k0 is not null and x0 is null").count() == 0 and out.filter("k0 is null and x0 is not null").count() == 0
    salted = lookup.salted_left_join(rows.select("id", "k0"), table.withColumnsRenamed({"k3": "k"}), [("k0", "k")], lookup.heavy_hashes(table, ["k3"], "n", 4))
    assert salted.count() == 3000 and "__salt" not in salted.columns


def test_broadcast_bounds_count_rows_and_bytes(spark):
    table = materialize(spark.range(100).select("id", F.repeat(F.lit("x"), 1000).alias("t")), "t")
    assert lookup.is_small(table) and not lookup.is_small(table, rows=99) and not lookup.is_small(table, size=100_000)


def test_top_rows_overall_and_within(spark):
    df = spark.createDataFrame([("a", 1), ("a", 3), ("a", 2), ("b", 5)], "g string, v int")
    assert [r["v"] for r in ranking.top_rows(df, 2, [F.desc("v")]).collect()] == [5, 3]
    assert sorted((r["g"], r["v"]) for r in ranking.top_rows(df, 2, [F.desc("v")], within="g").collect()) == [("a", 2), ("a", 3), ("b", 5)]
    many = ranking.top_rows(df, 5000, [F.desc("v")], within="g")  # beyond the group-limit size
    assert many.count() == 4


def test_large_tops_use_range_blocks(spark):
    df = spark.range(9000).select((F.col("id") % 2).alias("g"), (F.col("id") * 7919 % 9001).alias("v"))
    spark.conf.set("spark.sql.optimizer.windowGroupLimitThreshold", "100")
    try:
        top = ranking.top_rows(df, 3000, [F.desc("v")], within="g")
    finally:
        spark.conf.unset("spark.sql.optimizer.windowGroupLimitThreshold")
    plan = top._jdf.queryExecution().optimizedPlan().toString()
    # every window is inside a block, none over a whole group
    windows = [line for line in plan.splitlines() if "Window " in line and "sum(1)" in line]
    assert windows and all("__block" in line for line in windows)
    small = ranking.top_rows(df, 3000, [F.desc("v")], within="g")
    assert sorted(map(tuple, top.collect())) == sorted(map(tuple, small.collect())) and top.count() == 6000


def test_top_rows_cut_before_the_shuffle(spark):
    df = spark.range(1000).select((F.col("id") % 2).alias("g"), "id")
    plan = ranking.top_rows(df, 3, [F.desc("id")], within="g")._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_written_tables_go_to_the_shared_folder(spark):
    from tabflow.scratch import scratch_root

    root = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    assert scratch_root(spark).startswith(root)
    assert materialize(spark.range(3), "probe").inputFiles()[0].startswith(f"file://{root}")


def test_a_hot_key_that_no_table_tells_of_is_measured(spark):
    """The table has no weights; the sketch of the rows finds the key of two thirds of them."""
    keys = F.when(F.col("id") % 3 > 0, F.lit("hot")).when(F.col("id") % 7 == 0, F.lit(None)).otherwise(F.concat(F.lit("k"), F.col("id")))
    rows = materialize(spark.range(20_000).select("id", keys.alias("k")), "rows")
    table = materialize(rows.filter("k is not null").groupBy("k").agg(F.max("id").alias("last")), "t")
    hot = lookup.measured_heavy(rows, [F.col("k")], 3)
    assert rows.filter("k = 'hot'").select(F.xxhash64("k")).first()[0] in hot and len(hot) <= 3
    out = lookup.lookup_join(rows, table, ["k"], broadcast_rows=0, heavy_keys=3)
    assert out.count() == 20_000 and out.filter("(k is null) <> (last is null)").count() == 0
    # the rows of the hot key are dealt over the salts
    salted = lookup.salted_left_join(rows, table.withColumnRenamed("k", "__k"), [("k", "__k")], hot)
    parts = salted.filter("k = 'hot'").groupBy(F.spark_partition_id()).count().collect()
    assert sorted(map(str, out.collect())) == sorted(map(str, rows.join(table, "k", "left").select("id", "k", "last").collect())) and len(parts) >= 1
    assert lookup.measured_heavy(rows.filter("false"), [F.col("k")]) == []
