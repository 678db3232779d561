"""Cross-validated training with out-of-fold bookkeeping on Spark ML estimators."""

from __future__ import annotations

import time
from collections.abc import Callable, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import reduce
from itertools import product
from operator import or_

from pyspark import inheritable_thread_target
from pyspark.ml import Model
from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabflow.functions import fixed_values as fv
from tabflow.operators import encode, ensemble, folds, metrics, validate
from tabflow.operators.schema import categorical_columns
from tabflow.operators.ranking import top_rows
from tabflow.scratch import materialize
from tabflow.sources.tables import number_map

# Fits that share the cluster.
PARALLEL = 4


@dataclass(frozen=True)
class OneHot:
    """Columns of a fitted one-hot encoding: frequent categories and a group of rare ones."""

    categories: dict[str, list[str]]
    medians: dict[str, float]

    def names(self) -> list[str]:
        """Encoded columns in vector order: each number with its missing flag, then category flags."""
        return list(self.sources())

    def sources(self) -> dict[str, str]:
        """Raw column behind each encoded name."""
        numbers = {n: c for c in self.medians for n in (c, f"{c}__missing")}
        return {**numbers, **{f"{c}_{v}": c for c, known in self.categories.items() for v in [*known, "_rare"]}}

    def _flags(self, c: str) -> list[Column]:
        value, known = F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(fv.MISSING_CATEGORY)), self.categories[c]
        return [*[value == v for v in known], ~value.isin(known) if known else F.lit(True)]

    def apply(self, df: DataFrame, output: str = "features") -> DataFrame:
        """Add the feature vector: imputed numbers, missing flags, category flags."""
        number = lambda c: F.nanvl(F.col(f"`{c}`").try_cast("double"), F.lit(None))
        columns = [x for c, m in self.medians.items() for x in (F.coalesce(number(c), F.lit(m)), number(c).isNull().cast("double"))]
        columns += [cond.cast("double") for c in self.categories for cond in self._flags(c)]
        slots = [f"__f{i}" for i in range(len(columns))]
        return VectorAssembler(inputCols=slots, outputCol=output).transform(df.withColumns(dict(zip(slots, columns)))).drop(*slots)


def _category_texts(categorical: Sequence[str]) -> list[Column]:
    return [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(fv.MISSING_CATEGORY)).alias(c) for c in categorical]


def fit_one_hot(df: DataFrame, numeric: Sequence[str], categorical: Sequence[str], *, min_share: float = 0.01) -> OneHot:
    """Medians of the numbers and the categories with at least ``min_share`` of the rows.

    At most 1 / min_share categories per column qualify, so the lists are small.
    """
    found: dict[str, list[str]] = {c: [] for c in categorical}
    if categorical:
        texts = df.select(*_category_texts(categorical))
        counts = encode.value_counts(texts.unpivot([], [f"`{c}`" for c in categorical], "feature", "value"), "feature", "value")
        for r in counts.filter(F.col("n") >= F.lit(min_share * df.count())).orderBy("feature", "value").collect():
            found[r["feature"]].append(r["value"])
    medians = encode.fit_medians(df, numeric) if numeric else {}
    return OneHot(found, {c: medians.get(c, 0.0) for c in numeric})


def fit_one_hots(df: DataFrame, fold: str, ids: Sequence[int], numeric: Sequence[str], categorical: Sequence[str], *, min_share: float = 0.01) -> dict[int, OneHot]:
    """For every fold what ``fit_one_hot`` gives on the rows outside it; all folds share the passes."""
    found: dict[int, dict[str, list[str]]] = {f: {c: [] for c in categorical} for f in ids}
    if categorical:
        texts = df.select(F.col(fold).alias("__fold"), *_category_texts(categorical))
        counts = encode.value_counts(texts.unpivot(["__fold"], [f"`{c}`" for c in categorical], "feature", "value"), "__fold", "feature", "value")
        counts = materialize(counts, "categories")
        # every row is counted once for each column
        sizes = {r["__fold"]: r["n"] for r in counts.filter(F.col("feature") == categorical[0]).groupBy("__fold").agg(F.sum("n").alias("n")).collect()}
        least = [min_share * (sum(sizes.values()) - sizes.get(f, 0)) for f in ids]
        outside = counts.groupBy("feature", "value").agg(*[F.sum(F.when(F.col("__fold") != F.lit(f), F.col("n"))).alias(f"n{i}") for i, f in enumerate(ids)])
        for r in outside.filter(reduce(or_, [F.col(f"n{i}") >= F.lit(m) for i, m in enumerate(least)])).orderBy("feature", "value").collect():
            for i, f in enumerate(ids):
                if r[f"n{i}"] is not None and r[f"n{i}"] >= least[i]:
                    found[f][r["feature"]].append(r["value"])
    medians = encode.fit_medians_without(df, numeric, fold) if numeric else {}
    return {f: OneHot(found[f], {c: medians.get(f, {}).get(c, 0.0) for c in numeric}) for f in ids}


def positive_probability(column: str = "probability") -> Column:
    return vector_to_array(F.col(column))[1]


@dataclass(frozen=True)
class CvResult:
    """Long tables of one run: predictions, one row per trained model, and importances."""

    oof: DataFrame
    test: DataFrame | None
    detail: DataFrame
    importances: DataFrame


def cross_validate(
    df: DataFrame,
    *,
    key: str,
    label: str,
    numeric: Sequence[str],
    categorical: Sequence[str] = (),
    estimators: Mapping[str, Callable[..., object]],
    fold: str = "fold",
    modes: Sequence[str] = ("cat",),
    seeds: Sequence[int] | None = None,
    balanced: bool = False,
    test: DataFrame | None = None,
    parallel: int = PARALLEL,
) -> CvResult:
    """Train every estimator on every fold and keep what each row's own fold model predicts.

    ``estimators`` maps a config name to a factory of a Spark ML classifier. Mode "cat" feeds
    encoded categories, "numeric" casts all columns to numbers. Boosted trees stop early on
    the held-out fold. ``balanced`` weighs rows by class. Encodings are fitted on the training
    part of each fold only, from passes that all folds share. With ``seeds`` a factory takes the seed, every seed is trained, and
    models are named ``pred_<config>_<mode>_<seed>``; without, ``pred_<config>_<mode>``. Up to
    ``parallel`` pairs of a fold and a mode are trained at the same time.
    """
    spark, columns = df.sparkSession, [*numeric, *categorical]
    data = materialize(df.select(key, fold, F.col(label).cast("double").alias("label"), *columns), "cv")
    held = None if test is None else materialize(test.select(key, *columns), "cv_test")
    ids = sorted(r[0] for r in data.select(fold).distinct().collect())

    as_numbers = data.withColumns({c: F.col(f"`{c}`").try_cast("double") for c in categorical})
    encoders = {mode: fit_one_hots(data, fold, ids, numeric, categorical) if mode == "cat" else fit_one_hots(as_numbers, fold, ids, columns, []) for mode in modes}
    # a few classes per fold
    shares = encode.class_weights_without(data, "label", fold).collect() if balanced else []

    def train_part(f, mode: str) -> tuple[DataFrame, DataFrame | None, list, list]:
        """All models of one fold and mode: (out-of-fold rows, test rows, details, importances)."""
        part = data.withColumn("__is_valid", F.col(fold) == f)
        if balanced:  # one weight per class, from the training part
            pairs = [F.lit(v) for r in shares if r[fold] == f for v in (r["label"], r["weight"])]
            part = part.withColumn("__weight", F.coalesce(F.try_element_at(F.create_map(*pairs), F.col("label")), F.lit(1.0)))
        encoder, planned = encoders[mode][f], []
        for (config, make), seed in product(estimators.items(), seeds or [None]):
            name = "_".join(["pred", config, mode, *([] if seed is None else [str(seed)])])
            estimator = (make() if seed is None else make(seed)).setFeaturesCol("features").setLabelCol("label")
            planned.append((name, config, seed, estimator.setWeightCol("__weight") if balanced else estimator))
        # the held-out rows are written only for trees that stop early on them
        stops = any(isinstance(estimator, GBTClassifier) for *_, estimator in planned)
        ready = materialize(encoder.apply(part if stops else part.filter("not __is_valid")).select("label", "__is_valid", "features", *(["__weight"] if balanced else [])), "cv_features")
        sources, models, detail, importances = encoder.sources(), {}, [], []
        for name, config, seed, estimator in planned:
            start, early = time.perf_counter(), isinstance(estimator, GBTClassifier)
            model = models[name] = estimator.setValidationIndicatorCol("__is_valid").fit(ready) if early else estimator.fit(ready.filter("not __is_valid"))
            detail.append((int(f), name, config, mode, seed, trees_of(model), time.perf_counter() - start))
            importances += [(int(f), name, c, n, v) for (n, c), v in zip(sources.items(), importances_of(model, len(sources)))]
        valid = encoder.apply(part.filter("__is_valid")).select(key, fold, "label", "features")
        oof = predicted(models, valid).select(key, F.col(fold).alias("fold"), F.col("label").cast("int").alias("y"), *models)
        scored = None if held is None else predicted(models, encoder.apply(held).select(key, "features")).select(key, *models)
        return oof, scored, detail, importances

    # folds and modes are independent of each other: their jobs share the cluster
    tasks = [lambda f=f, mode=mode: train_part(f, mode) for f in ids for mode in modes]
    with ThreadPoolExecutor(max(1, parallel)) as pool:
        parts = list(pool.map(lambda task: task(), map(inheritable_thread_target(spark), tasks)))
    oof, tests = [p[0] for p in parts], [p[1] for p in parts if p[1] is not None]
    detail, importances = ([row for p in parts for row in p[i]] for i in (2, 3))
    out = _written(oof, len(modes), "oof", [key, "fold", "y"])
    table = spark.createDataFrame(detail, "fold int, model string, config string, mode string, seed int, best_iteration int, train_seconds double")
    auc = metrics.roc_auc(out, score="pred", label="y", group=["fold", "model"]).select(F.col("fold").cast("int").alias("fold"), "model", "auc")
    return CvResult(
        out,
        ensemble.mean_over_folds(_written(tests, len(modes), "cv_predictions", [key]), key=key) if tests else None,
        table.join(auc, ["fold", "model"], "left"),
        spark.createDataFrame(importances, "fold int, model string, column string, feature string, importance double"),
    )


def predicted(models: Mapping[str, Model], rows: DataFrame) -> DataFrame:
    """``rows`` with a column for every model, its probability under its name: one scan for all."""
    for i, model in enumerate(models.values()):
        # without the other two outputs the probability is worked out from the features in one step
        own = {model.probabilityCol: f"__probabilityCol_{i}", model.rawPredictionCol: "", model.predictionCol: ""}
        rows = model.copy(own).transform(rows)
    kept = [c for c in rows.columns if not c.startswith("__probabilityCol_")]
    return rows.select(*kept, *[positive_probability(f"__probabilityCol_{i}").alias(name) for i, name in enumerate(models)])


def _written(parts: Sequence[DataFrame], modes: int, name: str, keep: Sequence[str]) -> DataFrame:
    """Predictions of all folds in long form, written with a column per model; modes, which differ in their models, take turns in ``parts``."""
    wide = [materialize(reduce(DataFrame.unionByName, parts[i::modes]), name) for i in range(modes)]
    return reduce(DataFrame.unionByName, [ensemble.to_long(t, [c for c in t.columns if c not in keep], keep) for t in wide])


def trees_of(model: Model) -> int:
    return int(model.getNumTrees) if hasattr(model, "getNumTrees") else -1


def importances_of(model: Model, n: int) -> list[float]:
    """Tree importances, or absolute coefficients of a linear model."""
    if hasattr(model, "featureImportances"):
        return [float(v) for v in model.featureImportances.toArray()]
    if hasattr(model, "coefficients"):
        return [abs(float(v)) for v in model.coefficients.toArray()]
    return [0.0] * n


def column_importances(result: CvResult) -> DataFrame:
    """Importance per raw column: encoded parts summed per model, then mean and std over models."""
    per_model = result.importances.groupBy("fold", "model", F.col("column").alias("feature")).agg(F.sum("importance").alias("importance"))
    return ensemble.importance_table(per_model)


def fold_aucs(blended: DataFrame, *, score: str = "blend") -> DataFrame:
    return metrics.roc_auc(blended, score=score, label="y", group=["fold"]).select("fold", "auc")


def summarise(result: CvResult, weights: Mapping[str, float], *, key: str = "id") -> tuple[DataFrame, DataFrame, float]:
    """Blended out-of-fold table, the fold summary with its mean/std/oof rows, and the OOF AUC."""
    blended = materialize(ensemble.weighted_blend(result.oof, weights, key=key, keep=["fold", "y"]), "blended")
    auc = metrics.roc_auc(blended, score="blend", label="y").first()["auc"]
    return blended, ensemble.fold_summary(result.detail, fold_aucs(blended), auc), auc


def submission(template: DataFrame, predictions: DataFrame, *, key: str = "id", pred: str = "blend", name: str = "pred") -> DataFrame:
    """Template ids with their predictions; every id needs a probability."""
    joined = template.select(key).join(predictions.select(key, F.col(pred).alias(name)), key, "left")
    validate.require_probabilities(joined, name)
    return joined


def label_columns(predictions: DataFrame, pred: str, thresholds: Mapping[str, float]) -> DataFrame:
    """One 0/1 column per named threshold."""
    return predictions.withColumns({n: (F.col(pred) >= F.lit(float(t))).cast("int") for n, t in thresholds.items()})


def run_document(train: DataFrame, label: str, summary: DataFrame, weights: Mapping[str, float], *, public_score: float | None = None, **settings: str | float) -> dict[str, Column]:
    """Column expressions of the run document: target counts, weights, fold and out-of-fold AUC,
    the gap to a public score, and the settings of the run."""
    counts = {str(r[label]): r["n"] for r in encode.value_counts(train, label).collect()}
    aucs = {r["fold"]: r["auc"] for r in summary.select("fold", "auc").collect()}  # one row per fold and three more
    gap = None if public_score is None else public_score - aucs["oof"]
    return {
        "target_distribution": number_map(counts), "weights": number_map(weights), "oof_auc": F.lit(aucs["oof"]), "fold_auc_mean": F.lit(aucs["mean"]),
        "fold_auc_std": F.lit(aucs["std"]), "fold_auc": number_map({f: a for f, a in aucs.items() if f not in ("oof", "mean", "std")}),
        "public_score": F.lit(public_score).cast("double"), "oof_public_gap": F.lit(gap).cast("double"),
        "settings": F.create_map(*[F.lit(str(v)) for item in settings.items() for v in item]) if settings else F.lit(None).cast("map<string,string>"),
    }


def error_frame(predictions: DataFrame, *, prob: str, label: str, threshold: float, key: str = "id", extras: DataFrame | None = None) -> DataFrame:
    """Predictions with error columns, joined with raw or feature columns by key."""
    out = predictions.withColumns(metrics.error_columns(prob, label, threshold))
    return out if extras is None else out.join(extras, key, "left")


def wrong_first_order(key: str = "id") -> list[Column]:
    """Wrong rows on top, the most confident first, ties by key."""
    return [F.desc(F.col("error_type") != "OK"), F.desc("confidence"), F.col(key).asc()]


def wrong_first(errors: DataFrame, key: str = "id") -> DataFrame:
    return errors.orderBy(*wrong_first_order(key))


def confident_errors(errors: DataFrame, n: int, *, within: str | None = None, key: str = "id") -> DataFrame:
    """The n most confident wrong rows, overall or per fold; 0 keeps all wrong rows."""
    wrong = errors.filter("error_type != 'OK'")
    return wrong if n == 0 else top_rows(wrong, n, [F.desc("confidence"), F.col(key)], within=within)


def forest_inputs(train: DataFrame, test: DataFrame, assigned: DataFrame, *, key: str, label: str, categorical: Sequence[str], numeric: Sequence[str]) -> tuple[DataFrame, DataFrame, list[str]]:
    """(train, test, inputs): cross-fitted target means (full-fit for ``test``), medians in place of
    missing numbers and balanced class weights; ``assigned`` has the fold of every training row."""
    fitted = train.join(assigned, key)
    for c in categorical:
        fitted = encode.target_encode_crossfit(fitted, c, label, "fold")
        test = encode.apply_target_encoding(test, c, encode.fit_target_encoding(train, c, label))
    medians = encode.fit_medians(train, numeric) if numeric else {}
    if medians:
        fitted, test = encode.impute_medians(fitted, medians), encode.impute_medians(test, medians)
    return encode.add_class_weights(fitted, label), test, [*[f"{c}_te" for c in categorical], *numeric]


def forest_on_target_means(train: DataFrame, test: DataFrame, *, key: str, label: str, categorical: Sequence[str], numeric: Sequence[str], n_folds: int = 5, trees: int = 100, seed: int = 42) -> DataFrame:
    """Random forest on cross-fitted target means and median-imputed numbers; hard labels for the test rows."""
    assigned = folds.stratified_folds(train, key, label, n_folds, seed=seed)
    ready, test, inputs = forest_inputs(train, test, assigned, key=key, label=label, categorical=categorical, numeric=numeric)
    vector = VectorAssembler(inputCols=inputs, outputCol="features")
    ready = vector.transform(ready)
    forest = RandomForestClassifier(numTrees=trees, seed=seed, featuresCol="features", labelCol=label, weightCol="weight", maxDepth=10)
    model = forest.fit(materialize(ready.select(key, F.col(label).cast("double").alias(label), "weight", "features"), "forest"))
    scored = model.transform(vector.transform(test))
    return scored.select(key, F.col("prediction").cast("int").alias(label))


def category_columns(df: DataFrame, features: Sequence[str], forced: Sequence[str] = ()) -> tuple[list[str], list[str]]:
    """(numeric, categorical) split of a feature list."""
    cats = categorical_columns(df, features, forced)
    return [c for c in features if c not in cats], cats
