from __future__ import annotations

import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tabflow.operators import metrics


def brute_auc(pairs):
    pos, neg = [s for s, y in pairs if y == 1], [s for s, y in pairs if y == 0]
    return sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 5), st.integers(0, 1)), min_size=2, max_size=30))
def test_auc_equals_pair_counting(spark, pairs):
    pairs = [*pairs, (2, 1), (3, 0)]
    df = spark.createDataFrame([(s / 5, y) for s, y in pairs], "s double, y int")
    got = metrics.roc_auc(df, score="s", label="y", partitions=3).first()["auc"]
    assert got == pytest.approx(brute_auc([(s / 5, y) for s, y in pairs]))
    flipped = metrics.roc_auc(df.withColumn("s", -F.col("s")), score="s", label="y", partitions=2).first()["auc"]
    assert got + flipped == pytest.approx(1.0)


def test_auc_without_a_class_is_null(spark):
    df = spark.createDataFrame([(0.1, 1), (0.2, 1)], "s double, y int")
    assert metrics.roc_auc(df, score="s", label="y").first()["auc"] is None


def test_constant_score_is_half_and_missing_feature_is_half(spark):
    df = spark.createDataFrame([(1.0, None, 0), (1.0, None, 1)], "a double, b double, y int")
    assert {r["feature"]: r["auc"] for r in metrics.separability(df, features=["a", "b"], label="y").collect()} == {"a": 0.5, "b": 0.5}


@pytest.fixture(scope="module")
def scored(spark):
    rng = random.Random(3)
    rows = [(i, rng.choice([0.05, 0.2, 0.205, 0.5, 0.9499999, 0.95, rng.random(), 0.0, 1.0]), int(rng.random() < 0.4)) for i in range(300)]
    return rows, spark.createDataFrame(rows, "id int, p double, y int")


def brute(rows, t):
    tp = sum(p >= t and y == 1 for _, p, y in rows)
    fp = sum(p >= t and y == 0 for _, p, y in rows)
    fn = sum(p < t and y == 1 for _, p, y in rows)
    return tp, fp, fn, (2 * tp / (2 * tp + fp + fn) if tp else 0.0)


def test_threshold_sweep_equals_brute_force(scored):
    rows, df = scored
    got = metrics.threshold_sweep(df, prob="p", label="y").orderBy("threshold").collect()
    grid = metrics.threshold_grid()
    assert [r["threshold"] for r in got] == grid
    for r in got:
        tp, fp, fn, f1 = brute(rows, r["threshold"])
        assert (r["tp"], r["fp"], r["fn"]) == (tp, fp, fn) and r["f1"] == pytest.approx(f1)
    best = metrics.best_threshold_by_f1(df, prob="p", label="y").first()
    f1s = [brute(rows, t)[3] for t in grid]
    assert best["best_f1"] == pytest.approx(max(f1s)) and best["best_threshold"] == grid[f1s.index(max(f1s))]


def test_zero_division_gives_zero(spark):
    df = spark.createDataFrame([(0.1, 0), (0.2, 1)], "p double, y int")
    r = metrics.threshold_metrics(df, prob="p", label="y", threshold=0.9).first()
    assert (r["precision"], r["recall"], r["f1"], r["accuracy"]) == (0.0, 0.0, 0.0, 0.5)


def test_euclidean_error(spark):
    df = spark.createDataFrame([(0.0, 0.0, 3 / 105, 4 / 68)], "a double, b double, c double, d double")
    assert metrics.euclidean_error(df, pred=("a", "b"), truth=("c", "d")).first()[0] == pytest.approx(5.0)


def test_error_columns(spark):
    df = spark.createDataFrame([(1, 0.9, 0), (2, 0.2, 1), (3, 0.5, 1)], "id int, p double, y int")
    out = {r["id"]: r for r in df.withColumns(metrics.error_columns("p", "y", 0.5)).collect()}
    assert [out[i]["error_type"] for i in (1, 2, 3)] == ["FP", "FN", "OK"]
    assert [round(out[i]["confidence"], 6) for i in (1, 2, 3)] == [0.9, 0.8, 0.5]
    assert round(out[2]["margin_to_threshold"], 6) == 0.3
