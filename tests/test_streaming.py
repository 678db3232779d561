from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tabflow.operators import episodes as ep
from tabflow.streaming import episode_tails
from tests.test_prefixes import SCHEMA, events


def ordered(rows):
    return sorted(([round(v, 9) if isinstance(v, float) else v for v in r] for r in map(tuple, rows)), key=str)


@pytest.fixture
def folder(spark, tmp_path):
    return str(tmp_path / "events")


def stream(spark, path):
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(path)


@pytest.mark.parametrize("k", [1, 5, 1000])
def test_a_drained_stream_equals_the_batch_form(spark, folder, k):
    rows = spark.createDataFrame(events(300), SCHEMA)
    rows.repartition(5, F.xxhash64("action_id")).write.parquet(folder)
    views = episode_tails.inference_views(stream(spark, folder), k)
    got = episode_tails.drain(views)
    want = ep.long_features(rows, policy="last_row", max_tail_k=k)
    assert got.columns == [*want.columns, "seen"]
    assert ordered(got.drop("seen").collect()) == ordered(want.collect())
    # what an episode has seen is all of it, however few rows are kept
    seen = {r[0]: r[1] for r in got.groupBy("game_episode").agg(F.max("seen")).collect()}
    assert seen == {r[0]: r[1] for r in rows.groupBy("game_episode").count().collect()}


def test_a_restarted_stream_goes_on(spark, folder, tmp_path):
    first, second = spark.createDataFrame(events(100), SCHEMA), spark.createDataFrame([(r[0] + 1000, *r[1:]) for r in events(60, seed=8, episodes=("1_2", "7_7"))], SCHEMA)
    first.coalesce(1).write.parquet(folder)
    point = str(tmp_path / "point")
    episode_tails.drain(episode_tails.inference_views(stream(spark, folder), 6), checkpoint=point)
    second.coalesce(1).write.mode("append").parquet(folder)
    got = episode_tails.drain(episode_tails.inference_views(stream(spark, folder), 6), checkpoint=point)
    want = ep.long_features(first.unionByName(second), policy="last_row", max_tail_k=6)
    assert ordered(got.drop("seen").collect()) == ordered(want.collect())
    assert {r["game_episode"] for r in got.collect()} == {"1_1", "1_2", "2_1", "7_7"}


def test_refuses_an_empty_tail(spark, folder):
    spark.createDataFrame(events(5), SCHEMA).write.parquet(folder)
    with pytest.raises(ValueError):
        episode_tails.tails(stream(spark, folder), 0)


@pytest.mark.parametrize("buckets", [1, 3])
def test_episodes_share_a_state(spark, folder, buckets):
    rows = spark.createDataFrame([*events(200), *[(r[0] + 5000, None, *r[2:]) for r in events(20)]], SCHEMA)
    rows.repartition(4, F.xxhash64("action_id")).write.parquet(folder)
    got = episode_tails.drain(episode_tails.tails(stream(spark, folder), 4, buckets=buckets))
    want = ep.order_steps(rows, max_tail_k=4)
    names = ["game_episode", "action_id", "pos", "dt_raw"]
    # the join with an episode's newest view leaves out the null key
    known = [r for r in want.select(names).collect() if r[0] is not None]
    assert ordered(got.select(names).collect()) == ordered(known)
    assert got.groupBy("game_episode").agg(F.count_distinct("seen").alias("n")).filter("n > 1").isEmpty()
