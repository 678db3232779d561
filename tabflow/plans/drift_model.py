"""Adversarial validation: a classifier that tells test rows from training rows."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.ml import Model
from pyspark.ml.classification import GBTClassifier
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabflow.operators import folds, metrics
from tabflow.operators.drift import SIDE, DriftFrame
from tabflow.operators.schema import numeric_columns
from tabflow.plans.cv import OneHot, fit_one_hot, positive_probability
from tabflow.scratch import materialize

ROW = "__row"


@dataclass(frozen=True)
class DriftModel:
    model: Model
    encoder: OneHot
    features: list[str]
    valid: DataFrame
    auc: float


def score(m: DriftModel, df: DataFrame, name: str = "score") -> DataFrame:
    out = m.model.transform(m.encoder.apply(df))
    return out.withColumn(name, positive_probability()).drop("features", "rawPrediction", "probability", "prediction")


def split_sides(frame: DriftFrame, *, valid_share: float = 0.3, seed: int = 42, order: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """Training and validation rows, stratified by side."""
    assigned = folds.random_split(frame.table, ROW, share=valid_share, stratify=SIDE, seed=seed, order=order)
    data = materialize(frame.table.join(assigned, ROW), "drift_split")
    return data.filter("not is_valid").drop("is_valid"), data.filter("is_valid").drop("is_valid")


def judged(valid: DataFrame, scorer: Callable[[DataFrame], DataFrame]) -> float | None:
    """AUC with which a scorer, which adds ``score``, tells the sides apart; none if one is missing."""
    return metrics.roc_auc(_scores(scorer(valid)), score="score", label=SIDE).first()["auc"]


def _scores(scored: DataFrame, *by: str) -> DataFrame:
    """The scores, written: a test of a score for null is pushed below the model, which would work out every row's twice."""
    return materialize(scored.select(*by, SIDE, "score"), "drift_scores")


def fit_drift_model(frame: DriftFrame, *, valid_share: float = 0.3, seed: int = 42, max_iter: int = 20, max_depth: int = 5) -> DriftModel:
    """Boosted trees on one-hot features, judged by AUC on a stratified part of the rows."""
    features = frame.features
    numbers = numeric_columns(frame.table, features)
    train, valid = split_sides(frame, valid_share=valid_share, seed=seed)
    encoder = fit_one_hot(train, numbers, [c for c in features if c not in numbers])
    ready = materialize(encoder.apply(train).select(F.col(SIDE).cast("double").alias("label"), "features"), "drift_train")
    model = GBTClassifier(maxIter=max_iter, maxDepth=max_depth, stepSize=0.1, minInstancesPerNode=20, seed=seed, featuresCol="features", labelCol="label").fit(ready)
    m = DriftModel(model, encoder, features, valid, 0.0)
    return DriftModel(model, encoder, features, valid, judged(valid, lambda df: score(m, df)))


def permutation_importance(m: DriftModel, *, n: int = 5000, repeats: int = 5, seed: int = 42) -> DataFrame:
    """(feature, importance_mean, importance_std): AUC the model loses when one raw column is shuffled.

    Works on a class-balanced sample of at most ``n`` rows.
    """
    sample = materialize(folds.balanced_sample(m.valid, ROW, SIDE, n=n, seed=seed), "drift_sample")
    return permuted_losses(sample, m.features, lambda df: score(m, df), repeats=repeats, seed=seed)


def permuted_losses(sample: DataFrame, features: Sequence[str], scorer: Callable[[DataFrame], DataFrame], *, repeats: int = 5, seed: int = 42,
                    order: Callable[[Column, Column, Column, Column], Column] | None = None) -> DataFrame:
    """Mean and population deviation of the AUC lost per shuffled feature; ``scorer`` adds ``score``.

    For every (feature, repeat) the sample is put in two orders and each row takes the feature's
    value from the row at its place in the other one. ``order(row, feature number, repeat, side)``
    gives the orders; by default it is a seeded hash. All features and repeats are one table and
    one scoring job. The caller bounds the sample, so its copies are broadcast.
    """
    order = order or (lambda row, i, r, s: F.xxhash64(row.cast("string"), i, r, s, F.lit(seed)))
    base = judged(sample, scorer)
    runs = F.explode(F.array(*[F.struct(F.lit(i).alias("__feature"), F.lit(r).alias("__repeat")) for i in range(len(features)) for r in range(repeats)]))
    every = sample.select(ROW, runs.alias("__run")).select(ROW, "__run.*")
    # one window group per (feature, repeat), as large as the sample
    place = lambda s: F.row_number().over(Window.partitionBy("__feature", "__repeat").orderBy(order(F.col(ROW), F.col("__feature"), F.col("__repeat"), F.lit(s)), ROW))
    first = every.withColumn("__pos", place(0))
    second = every.withColumn("__pos", place(1)).withColumnRenamed(ROW, "__other")
    pairs = first.join(second, ["__feature", "__repeat", "__pos"]).drop("__pos")
    values = sample.select(F.col(ROW).alias("__other"), *[F.col(f"`{c}`").alias(f"__new_{i}") for i, c in enumerate(features)])
    full = pairs.join(F.broadcast(sample), ROW).join(F.broadcast(values), "__other")
    mixed = full.select(
        "__feature", "__repeat", *[F.col(f"`{c}`") for c in sample.columns if c not in features],
        *[F.when(F.col("__feature") == i, F.col(f"__new_{i}")).otherwise(F.col(f"`{c}`")).alias(c) for i, c in enumerate(features)])
    aucs = metrics.roc_auc(_scores(scorer(mixed), "__feature", "__repeat"), score="score", label=SIDE, group=["__feature", "__repeat"])
    loss, name = F.lit(base) - F.col("auc"), F.element_at(F.array(*[F.lit(c) for c in features]), F.col("__feature") + 1)
    losses = aucs.groupBy(name.alias("feature")).agg(F.avg(loss).alias("importance_mean"), F.stddev_pop(loss).alias("importance_std"))
    return losses.orderBy(F.desc("importance_mean"), "feature")


def test_likeness(m: DriftModel | Callable[[DataFrame], DataFrame], table: DataFrame, keep: Sequence[str] = (ROW, SIDE)) -> DataFrame:
    """Probability of being a test row, for every row of both tables; ``m`` is a model, or a scorer that adds ``score``."""
    scored = score(m, table) if isinstance(m, DriftModel) else m(table)
    return scored.select(*keep, F.col("score").alias("test_likeness"))
