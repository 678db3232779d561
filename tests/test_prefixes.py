from __future__ import annotations

import math
import random

from pyspark.sql import functions as F

from tabflow.functions import fixed_values as fv
from tabflow.operators import episodes as ep
from tabflow.operators.prefixes import prefix_summaries
from tabflow.plans import episode_model

SCHEMA = "action_id long, game_episode string, period_id int, time_seconds double, team_id int, player_id int, type_name string, result_name string, start_x double, start_y double, end_x double, end_y double"


def events(n, seed=3, episodes=("1_1", "1_2", "2_1")):
    rng = random.Random(seed)
    some = lambda v, p=0.1: None if rng.random() < p else v
    return [
        (k, rng.choice(episodes), some(rng.choice([1, 2])), k * rng.random(), some(rng.choice([100, 101, 102])), rng.randrange(9), rng.choice(["Pass", "Pass", "Carry", "Take-On", "Block"]),
         some("Successful"), some(rng.uniform(0, 105), 0.05), some(rng.uniform(0, 68), 0.05), some(rng.uniform(0, 105)), some(rng.uniform(0, 68)))
        for k in range(n)
    ]


def test_equals_the_summary_of_the_long_form(spark):
    rows = spark.createDataFrame(events(400), SCHEMA)
    long = ep.long_features(rows, policy="all_pass")
    want = long.groupBy("game_episode", "t_pos").agg(F.count("*").alias("length"), *[F.max_by(c, "pos").alias(f"last_{c}") for c in fv.SEQUENCE_NUMBERS], *[F.avg(c).alias(f"mean_{c}") for c in fv.SEQUENCE_NUMBERS], F.max("target_dx").alias("target_dx"))
    want = {(r["game_episode"], r["t_pos"]): r.asDict() for r in want.collect()}
    got = prefix_summaries(rows).collect()
    assert len(got) == len(want) > 100 and {r["game_episode"] for r in got} == {"1_1", "1_2", "2_1"}
    for r in got:
        w = want[r["game_episode"], r["t_pos"]]
        for c, x in w.items():
            assert (r[c] is None) == (x is None), c
            assert not isinstance(x, float) or math.isclose(r[c], x, rel_tol=0, abs_tol=1e-9), (c, r[c], x)


def test_one_hot_episode_stays_linear(spark):
    """20,000 steps in one episode: their pairs would be 120 million rows."""
    rows = spark.createDataFrame(events(20_000, episodes=("9_9",)), SCHEMA)
    found = prefix_summaries(rows)
    plan = found._jdf.queryExecution().toString()
    assert "__sample_block" not in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan
    first = found.agg(F.count("*"), F.max("length"), F.max("t_pos")).first()
    assert first[0] == rows.filter("type_name = 'Pass' and end_x is not null and end_y is not null").count() and first[1] == first[2] > 19_000


def test_models_can_be_trained_on_every_pass(spark):
    rows = spark.createDataFrame(events(300, episodes=("1_1", "2_1", "3_1")), SCHEMA).fillna(5.0, ["start_x", "start_y"])
    samples = episode_model.summaries(rows, "all_pass")
    models = episode_model.train_fold_models(samples, 3)
    last = episode_model.summaries(rows, "last_row")
    out = episode_model.predict_deltas(models, last).collect()
    assert len(out) == 9 and all(-1 <= r["delta_x"] <= 1 for r in out)


def test_empty(spark):
    assert prefix_summaries(spark.createDataFrame([], SCHEMA)).count() == 0
