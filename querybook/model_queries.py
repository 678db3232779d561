"""Model jobs: fitted models have no SQL counterpart; these are rows-only."""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.sql import functions as F

from querybook.book import query
from querybook.drift_queries import drift_input
from querybook.inputs import Inputs
from tabflow.operators import ensemble, folds
from tabflow.plans import cv, drift_model, survey_table

ESTIMATORS = {
    "m1": lambda seed: RandomForestClassifier(numTrees=10, maxDepth=4, seed=seed),
    "m2": lambda seed: LogisticRegression(maxIter=20),  # has no random part
}


def trained(d: Inputs) -> cv.CvResult:
    rows = d.scores
    test = d.table("orders").filter("o_orderstatus = 'O'").select(F.col("o_orderkey").alias("id"), F.lit(0.0).alias("p"), F.col("o_totalprice").alias("x"), F.col("o_orderpriority").alias("cat"))
    return cv.cross_validate(rows, key="id", label="y", numeric=["p", "x"], categorical=["cat"], estimators=ESTIMATORS, seeds=[42], test=test, balanced=True)


@query("cv_train_oof", "id:i fold:i y:i model:s pred:d")
def _(d: Inputs):
    return trained(d).oof


@query("cv_fold_summary", "fold:s scope:s auc:d best_iteration_mean:d best_iteration_median:d best_iteration_min:i best_iteration_max:i n_models:i")
def _(d: Inputs):
    return cv.summarise(trained(d), ensemble.model_weights(list(ESTIMATORS), {"cat": 1.0}, [42]))[1]


@query("cv_oof_members", "id:i fold:i y:i model:s in_range:i", """
select id, fold, y, 'pred_'||c||'_'||m||'_'||s as model, 1 as in_range from cv, (select unnest(['m1','m2']) as c), (select unnest(['cat','numeric']) as m), (select unnest(['1','2']) as s)""")
def _(d: Inputs):
    small = {"m1": lambda seed: RandomForestClassifier(numTrees=2, maxDepth=2, seed=seed), "m2": lambda seed: LogisticRegression(maxIter=2)}
    oof = cv.cross_validate(d.scores, key="id", label="y", numeric=["p", "x"], categorical=["cat"], modes=["cat", "numeric"], seeds=[1, 2], estimators=small).oof
    return oof.withColumn("in_range", F.col("pred").between(0, 1).cast("int"))


@query("cv_importances", "feature:s importance_mean:d importance_std:d n_models:i")
def _(d: Inputs):
    return cv.column_importances(trained(d))


@query("cv_early_stopping", "fold:i model:s best_iteration:i auc:d")
def _(d: Inputs):
    rows = d.scores
    return cv.cross_validate(rows, key="id", label="y", numeric=["p", "x"], categorical=["cat"], modes=["numeric"],
                             estimators={"gbt": lambda: GBTClassifier(maxIter=5, maxDepth=3, seed=42)}).detail


@query("forest_on_target_means", "id:i completed:i")
def _(d: Inputs):
    rows = d.survey
    return cv.forest_on_target_means(rows, rows.drop("completed"), key="id", label="completed", categorical=["major1", "major2"], numeric=["time_input"], trees=10)


@query("survey_model_errors", "id:i fold:i y:i pred:d error_type:s confidence:d")
def _(d: Inputs):
    rows = d.survey.withColumnRenamed("major1", "major_field")
    s = survey_table.survey_tables(rows, rows.drop("completed"))
    assigned = folds.stratified_folds(s.train, "id", "completed", 3)
    numeric, cats = cv.category_columns(s.train, s.features, s.categorical)
    done = cv.cross_validate(s.train.join(assigned, "id"), key="id", label="completed", numeric=numeric, categorical=cats, balanced=True,
                             estimators={"rf": lambda: RandomForestClassifier(numTrees=5, maxDepth=4, seed=42)})
    return cv.error_frame(done.oof.drop("model"), prob="pred", label="y", threshold=0.5)


@query("drift_model_auc", "auc:d n_features:i")
def _(d: Inputs):
    m = drift_model.fit_drift_model(drift_input(d), max_iter=5, max_depth=3)
    return d.spark.createDataFrame([(m.auc, len(m.features))], "auc double, n_features int")


@query("permutation_importance", "feature:s importance_mean:d importance_std:d")
def _(d: Inputs):
    return drift_model.permutation_importance(drift_model.fit_drift_model(drift_input(d), max_iter=3, max_depth=3), repeats=2)


@query("test_likeness", "__row:i is_test:i test_likeness:d")
def _(d: Inputs):
    frame = drift_input(d)
    return drift_model.test_likeness(drift_model.fit_drift_model(frame, max_iter=3, max_depth=3), frame.table)
