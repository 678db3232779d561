"""Cross-validation: what is fitted on the rows outside each fold, for all folds from the same passes."""

from __future__ import annotations

import random
from statistics import median

import pytest
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.sql import functions as F

from tabflow.operators import encode, selection
from tabflow.plans import cv


def rows(spark, n: int = 900):
    rng = random.Random(3)
    odd = [None, float("nan"), float("inf"), 0.0]
    out = []
    for i in range(n):
        f = i % 4 + 1
        only = 5.0 if f == 2 else None  # a column that one fold alone has values of
        out.append((i % 700, f, rng.choice([0, 0, 1]), rng.choice([*odd, *[rng.gauss(f, 1)] * 6]), float(rng.choice([1, 1, 2])), only,
                    rng.choice(["a", "b", None, f"own{f}", f"rare{i % 150}"]), rng.choice(["1", "2.5", "x", None])))
    return spark.createDataFrame(out, "id long, fold int, y int, x double, ties double, only double, c string, `odd name` string").repartition(5)


NUMERIC, CATEGORICAL, IDS = ["x", "ties", "only"], ["c", "odd name"], [1, 2, 3, 4]


def test_encodings_equal_those_of_each_training_part(spark):
    df = rows(spark)
    got = cv.fit_one_hots(df, "fold", IDS, NUMERIC, CATEGORICAL, min_share=0.02)
    for f in IDS:
        assert got[f] == cv.fit_one_hot(df.filter(F.col("fold") != f), NUMERIC, CATEGORICAL, min_share=0.02), f
    assert got[2].medians["only"] == 0.0 and got[1].medians["only"] == 5.0
    assert len({str(e.categories) for e in got.values()}) > 1


@pytest.mark.parametrize("options", [{"small": 10, "bins": 16}, {"small": 10, "bins": 16, "long": True}, {"ordered": True}, {}])
def test_medians_of_the_rows_outside(spark, monkeypatch, options):
    df = rows(spark)
    if options.get("long"):
        monkeypatch.setattr(selection, "COLUMN_BRACKETS", 0)
    if options.get("ordered"):
        monkeypatch.setattr(selection, "BROADCAST_ROWS", 0)
    sizes = {k: v for k, v in options.items() if k in ("small", "bins")}
    got = {(r["fold"], r["feature"]): r["q0"] for r in selection.select_quantiles(df, NUMERIC, [0.5], group=["fold"], leave_out=True, **sizes).collect()}
    want = {}
    for f in IDS:
        for c in NUMERIC:
            values = [r[c] for r in df.collect() if r["fold"] != f and r[c] is not None and r[c] == r[c]]
            if values:
                want[f, c] = median(values)
    assert got == pytest.approx(want)


def test_class_weights_of_the_rows_outside(spark):
    df = rows(spark).withColumn("y", F.when(F.col("fold") == 3, F.lit(7)).otherwise(F.col("y")))
    got = {(r["fold"], r["y"]): (r["n"], r["weight"]) for r in encode.class_weights_without(df, "y", "fold").collect()}
    assert got == {(f, r["y"]): (r["n"], r["weight"]) for f in IDS for r in encode.class_weights(df.filter(F.col("fold") != f), "y").collect()}


def test_passes_are_shared_and_held_out_rows_not_written(spark, monkeypatch):
    """One fit for all folds; a fold's features are those of its training rows."""
    written, fits, keep, fit = [], [], cv.materialize, encode.select_quantiles
    monkeypatch.setattr(cv, "materialize", lambda df, name: written.append((name, t := keep(df, name))) or t)
    monkeypatch.setattr(encode, "select_quantiles", lambda *a, **o: fits.append(a) or fit(*a, **o))
    df = rows(spark).withColumn("weight", F.lit(9.0))
    n = df.count()
    run = lambda make: cv.cross_validate(df, key="id", label="y", numeric=["ties", "weight"], categorical=["c"], estimators={"m": make}, balanced=True, parallel=2)
    result = run(lambda: LogisticRegression(maxIter=2))
    assert len(fits) == 1
    assert sum(t.count() for name, t in written if name == "cv_features") == 3 * n
    assert result.oof.count() == n and result.oof.groupBy("fold").count().count() == 4
    # a feature called "weight" is read as it is
    assert {v for name, t in written if name == "cv_features" for v in [r[0] for r in t.select(cv.vector_to_array("features")[2]).distinct().collect()]} == {9.0}
    written.clear()
    assert run(lambda: GBTClassifier(maxIter=1, maxDepth=2, seed=1)).oof.count() == n
    assert sum(t.count() for name, t in written if name == "cv_features") == 4 * n
