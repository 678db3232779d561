"""Whole runs on small tables."""

from __future__ import annotations

import pytest
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.sql import functions as F

from querybook.inputs import Inputs
from tabflow.operators.validate import ValidationError
from tabflow.plans import runs
from tabflow.sources import tables


def test_tabular_run(spark, tmp_path):
    rows = spark.range(150).select(F.col("id").cast("int").alias("id"), (F.col("id") % 50 + 20).alias("Age"), (F.col("id") % 2).alias("Sex"),
                                   F.when((F.col("id") % 50 > 25) | (F.col("id") % 11 == 0), "Presence").otherwise("Absence").alias("Heart Disease"))
    train, test = rows.filter("id < 100"), rows.filter("id >= 100").drop("Heart Disease")
    template = test.select("id", F.lit(0.5).alias("Heart Disease"))
    auc = runs.tabular_run(train, test, template, str(tmp_path), n_splits=2, strategy="oof_opt", step=0.25, public_score=0.9,
                           estimators={"m1": lambda seed: LogisticRegression(maxIter=5), "m2": lambda seed: RandomForestClassifier(numTrees=3, seed=seed)}, seeds=[1, 2])
    assert auc > 0.8
    out = tables.read_csv(spark, str(tmp_path / "submission_blend"))
    assert out.count() == 50 and out.filter("`Heart Disease` between 0 and 1").count() == 50
    doc = tables.read_document(spark, str(tmp_path / "metrics")).first()
    assert doc["oof_public_gap"] == pytest.approx(0.9 - auc) and doc["target_distribution"]["Presence"] + doc["target_distribution"]["Absence"] == 100
    assert tables.read_document(spark, str(tmp_path / "weights")).first()["selected_strategy"] in ("rank", "prob")
    names = {r["model"] for r in tables.read_csv(spark, str(tmp_path / "model_detail")).select("model").collect()}
    assert names == {f"pred_{c}_cat_{s}" for c in ("m1", "m2") for s in (1, 2)}
    assert set(runs.boosted_configs("robust")) == set(runs.boosted_configs("fast")) and runs.boosted_configs("robust", max_iter=3)["m1"](5).getSeed() == 5
    with pytest.raises(ValueError):
        runs.boosted_configs("unknown")
    with pytest.raises(ValidationError):
        runs.tabular_run(train, test, template.limit(10), str(tmp_path), n_splits=2)


def test_survey_run(spark, data, tmp_path):
    rows = Inputs(spark, data).survey.withColumnRenamed("major1", "major_field")
    tuned = runs.survey_run(rows, rows.drop("completed"), str(tmp_path), n_splits=2, make=lambda: RandomForestClassifier(numTrees=3, maxDepth=3, seed=1))
    assert 0.05 <= tuned <= 0.95
    assert set(tables.read_csv(spark, str(tmp_path / "submission")).columns) == {"id", "completed", "completed_tuned"}
    wrong = spark.read.parquet(str(tmp_path / "fold_errors"))
    assert wrong.filter("error_type = 'OK'").count() == 0 and "major_field" in wrong.columns


def test_episode_run(spark, data, tmp_path):
    events = Inputs(spark, data).episodes
    ends = runs.episode_run(events, events, events.select("game_episode").distinct(), str(tmp_path), n_folds=3)
    assert ends.count() == events.select("game_episode").distinct().count()
    assert ends.filter("end_x between 0 and 105 and end_y between 0 and 68").count() == ends.count()
    built = lambda: sorted(len(list(run.glob("__part=*"))) for run in tmp_path.glob("cache/parts_*/run-*"))
    run = lambda rows, **o: runs.episode_run(rows, events, events.select("game_episode").distinct(), str(tmp_path), n_folds=3, **o)
    parts = built()
    assert len(parts) == 1 and parts[0] > 5
    run(events)
    assert built() == parts
    # as many rows and categories, one episode with other contents: its part is built again
    first = events.agg(F.min("game_episode")).first()[0]
    run(events.withColumn("start_x", F.col("start_x") + F.when(F.col("game_episode") == first, 1.0).otherwise(0.0)))
    assert built() == [1, *parts]
    # every pass a sample: summaries in place of the long form
    every = run(events, policy="all_pass")
    assert every.filter("end_x between 0 and 105 and end_y between 0 and 68").count() == ends.count() and len(built()) == 3


def test_drift_run(spark, data, tmp_path):
    rows = Inputs(spark, data).sides
    train, test = (rows.filter(F.col("is_test") == s).drop("is_test") for s in (0, 1))
    dim = spark.read.parquet(f"{data}/customer.parquet").select(F.col("c_custkey").alias("num"), "c_mktsegment")
    auc = runs.drift_run(train, test, dim, str(tmp_path), key="id", repeats=1, max_iter=2, max_depth=2)
    assert 0.0 <= auc <= 1.0 and spark.read.parquet(str(tmp_path / "likeness")).count() == rows.count()
