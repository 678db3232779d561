"""Whole runs: tables in, result tables and documents below an output folder out."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce
from operator import or_

from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabflow.functions import fixed_values as fv
from tabflow.operators import encode, ensemble, folds, metrics, validate
from tabflow.operators import episodes as ep
from tabflow.operators.drift import drift_frame
from tabflow.plans import blend, cv, drift_model, episode_model, survey_table
from tabflow.scratch import materialize
from tabflow.sources import cache, tables


def boosted_configs(preset: str = "fast", *, max_iter: int | None = None) -> dict[str, Callable[[int], object]]:
    """One boosted-tree factory per ensemble config; it takes the seed."""
    if preset not in fv.PRESETS:
        raise ValueError(f"unknown preset {preset!r}: use one of {sorted(fv.PRESETS)}")
    rounds = max_iter or fv.PRESETS[preset]

    def factory(depth: int, rate: float):
        return lambda seed: GBTClassifier(maxIter=rounds, maxDepth=depth, stepSize=rate, seed=seed)

    return {name: factory(depth, rate) for name, (depth, rate) in fv.ENSEMBLE_CONFIGS.items()}


def tabular_run(train: DataFrame, test: DataFrame, template: DataFrame, out: str, *, key: str = "id", target: str = "Heart Disease", categorical: Sequence[str] = fv.TABULAR_CATEGORIES,
                labels: Mapping[str, int] = fv.LABELS, n_splits: int = 5, seed: int = 42, feature_mode: str = "cat", hybrid_weight: float = 0.5, strategy: str = "none",
                preset: str = "fast", seeds: Sequence[int] | None = None, estimators: Mapping[str, Callable[[int], object]] | None = None, public_score: float | None = None, **search) -> float:
    """Cross-validated ensemble of labelled rows with optional blend search; returns the OOF AUC.

    Every config, feature mode and seed (``seed`` alone by default) is trained on every fold.
    """
    train, test = tables.null_for_nan(train), tables.null_for_nan(test)
    if n_splits < 2:
        raise ValueError("n_splits must be at least 2")
    for name, df in (("train", train), ("test", test), ("template", template)):
        validate.require_columns(df, [key], name)
        validate.require_unique_key(df, key, name)
    validate.require_same_keys([test, template], key)
    labelled = materialize(validate.map_label(train, target, labels=labels), "labelled")
    columns = [c for c in test.columns if c != key]
    modes = ensemble.submode_weights(feature_mode, hybrid_weight)
    estimators, seeds = estimators or boosted_configs(preset), list(seeds or [seed])
    data = labelled.join(folds.stratified_folds(labelled, key, "target", n_splits, seed=seed), key)
    result = cv.cross_validate(data, key=key, label="target", numeric=[c for c in columns if c not in categorical], categorical=[c for c in columns if c in categorical],
                               estimators=estimators, modes=list(modes), seeds=seeds, test=test)
    weights = ensemble.model_weights(list(estimators), modes, seeds)
    blended, summary, auc = cv.summarise(result, weights, key=key)
    predicted = ensemble.weighted_blend(result.test, weights, key=key)
    tables.write_table(cv.submission(template, predicted, key=key, name=target), f"{out}/submission", fmt="csv")
    tables.write_table(blended, f"{out}/oof", partition_by=["fold"])
    tables.write_table(summary, f"{out}/fold_summary", fmt="csv")
    tables.write_table(result.detail, f"{out}/model_detail", fmt="csv")
    tables.write_table(ensemble.to_wide(result.oof, sorted(weights), key=key, keep=["y"]), f"{out}/model_oof")
    tables.write_table(ensemble.to_wide(result.test, sorted(weights), key=key), f"{out}/model_test_pred")
    tables.write_table(cv.column_importances(result), f"{out}/feature_importance", fmt="csv")
    if strategy == "none":
        document = blend.base_document(weights, auc)
        mixed = cv.submission(template, predicted, key=key, name=target)
    else:
        b = blend.blend(result.oof.select(key, "y", "model", "pred"), result.test, strategy=strategy, key=key, **search)
        document = blend.blend_document(b, requested=strategy, step=search.get("step"), top_k=search.get("top_k"))
        mixed = blend.blend_submission(b, key=key, name=target)
    tables.write_table(mixed, f"{out}/submission_blend", fmt="csv")
    tables.write_document(train.sparkSession, document, f"{out}/weights")
    run = cv.run_document(train, target, summary, weights, public_score=public_score, n_splits=n_splits, seed=seed, feature_mode=feature_mode, strategy=strategy)
    tables.write_document(train.sparkSession, run, f"{out}/metrics")
    return auc


def survey_run(train: DataFrame, test: DataFrame, out: str, *, target: str = "completed", key: str = "id", n_splits: int = 5, seed: int = 42, threshold: float = 0.5,
               max_errors: int = 0, extra_columns: Sequence[str] = ("major_field",), make: Callable[[], object] | None = None) -> float:
    """Survey features, balanced cross-validation, tuned threshold, submissions and error tables; returns the tuned threshold."""
    train, test = tables.null_for_nan(train), tables.null_for_nan(test)
    made = survey_table.survey_tables(train, test, target=target, key=key)
    x_train, x_test = materialize(made.train.withColumn(target, F.coalesce(F.col(target).try_cast("int"), F.lit(0))), "survey_train"), materialize(made.test, "survey_test")
    numeric, cats = cv.category_columns(x_train, made.features, made.categorical)
    data = x_train.join(folds.stratified_folds(x_train, key, target, n_splits, seed=seed), key)
    result = cv.cross_validate(data, key=key, label=target, numeric=numeric, categorical=cats, test=x_test, balanced=True,
                               estimators={"rf": make or (lambda: RandomForestClassifier(numTrees=100, maxDepth=8, seed=seed))})
    oof = result.oof.drop("model")
    tuned = metrics.best_threshold_by_f1(oof, prob="pred", label="y").first()["best_threshold"]
    tables.write_table(cv.label_columns(result.test.select(key, "pred"), "pred", {target: threshold, f"{target}_tuned": tuned}).drop("pred"), f"{out}/submission", fmt="csv")
    extras = x_train.drop(target)
    raw = [c for c in extra_columns if c in train.columns and c not in extras.columns]
    if raw:
        extras = extras.join(train.select(key, *raw), key, "left")
    by_fold = cv.error_frame(oof, prob="pred", label="y", threshold=threshold, key=key, extras=extras)
    tables.write_table(cv.confident_errors(by_fold, max_errors, within="fold", key=key), f"{out}/fold_errors", partition_by=["fold"])
    overall = cv.error_frame(oof.drop("fold"), prob="pred", label="y", threshold=tuned, key=key, extras=extras)
    tables.write_table(cv.wrong_first(cv.confident_errors(overall, max_errors, key=key), key), f"{out}/oof_errors", fmt="csv")
    tables.write_table(metrics.error_counts(by_fold), f"{out}/error_counts", fmt="csv")
    tables.write_table(metrics.threshold_metrics(oof, prob="pred", label="y", threshold=threshold, group=["fold"]), f"{out}/fold_metrics", fmt="csv")
    tables.write_table(metrics.threshold_metrics(oof, prob="pred", label="y", threshold=tuned), f"{out}/oof_metrics", fmt="csv")
    tables.write_table(cv.column_importances(result), f"{out}/feature_importance", fmt="csv")
    return tuned


def episode_run(train: DataFrame, test: DataFrame, template: DataFrame, out: str, *, n_folds: int = 5, policy: str = "last_pass", max_tail_k: int = 0, space: str = "atanh", trim: int = 1, seed: int = 42) -> DataFrame:
    """Cached samples, fold models, fold predictions and the ensembled end points.

    The cached table is keyed by parameters and built in parts, so that only episodes of changed
    parts are built again. It holds the long form, on which the models train and an outside model
    can (``episodes.to_sequences`` packs it; ``episode_model.predict_with`` scores it); for
    "all_pass" without a tail, whose long form is quadratic, it holds the summaries.
    ``max_tail_k`` cuts episodes to their last rows.
    """
    spark = train.sparkSession
    train, test = tables.null_for_nan(train), tables.null_for_nan(test)
    vocabulary = encode.fit_vocabulary(train, fv.SEQUENCE_CATEGORIES)
    params = {"policy": policy, "max_tail_k": max_tail_k, "field": fv.FIELD, "dt": [fv.DT_CLIP, fv.DT_REF], "no_end": fv.NO_END_TYPES}
    if policy == "all_pass" and not max_tail_k:
        found = cache.incremental_dataset(spark, f"{out}/cache", {**params, "form": "summaries"}, train, [ep.KEY], lambda part: episode_model.summaries(part, policy))
        samples = found.data
        numbers = [F.col(f"last_{c}") for c in fv.SEQUENCE_NUMBERS] + [F.col("target_dx"), F.col("target_dy")]
        if not samples.filter(reduce(or_, [n.isNull() | F.isnan(n) | (F.abs(n) == float("inf")) for n in numbers])).isEmpty():
            raise validate.ValidationError("samples hold missing or infinite numbers")
    else:
        # indexes of categories depend on every row, so another vocabulary is another dataset
        params["vocabulary"] = cache.table_fingerprint(vocabulary.select("field", "value", "idx"))
        found = cache.incremental_dataset(spark, f"{out}/cache", params, train, [ep.KEY], lambda part: ep.long_features(part, policy=policy, max_tail_k=max_tail_k, vocabulary=vocabulary))
        reason = cache.columns_check([*fv.SEQUENCE_NUMBERS, *[f"{c}_idx" for c in fv.SEQUENCE_CATEGORIES]])(found.data)
        if reason or ep.check_samples(found.data).first()["n_not_finite"]:
            raise validate.ValidationError(reason or "samples hold missing or infinite numbers")
        samples = materialize(episode_model.sample_summary(found.data), "samples")
    if policy == "last_pass":
        folds.require_one_sample_per_key(samples, ep.KEY)
    models = episode_model.train_fold_models(samples, n_folds, seed=seed)
    scored = episode_model.predict_deltas(models, episode_model.sample_summary(ep.long_features(test, policy="last_row", max_tail_k=max_tail_k)))
    tables.write_table(scored, f"{out}/fold_predictions", partition_by=["fold"])
    scored = spark.read.parquet(f"{out}/fold_predictions")
    ends = template.select(ep.KEY).join(ensemble.delta_ensemble(scored, space=space, trim=trim), ep.KEY, "left")
    tables.write_table(ends, f"{out}/submission", fmt="csv")
    return ends


def drift_run(train: DataFrame, test: DataFrame, dim: DataFrame | None, out: str, *, key: str, repeats: int = 5, **options) -> float:
    """Adversarial validation: model AUC, importances, per-row test-likeness and the report; returns the AUC."""
    train, test = tables.null_for_nan(train), tables.null_for_nan(test)
    frame = drift_frame(train, test, dim, key=key)
    m = drift_model.fit_drift_model(frame, **options)
    importances = materialize(drift_model.permutation_importance(m, repeats=repeats), "importances")
    tables.write_table(importances, f"{out}/feature_importance", fmt="csv")
    likeness = drift_model.test_likeness(m, frame.table)
    tables.write_table(likeness, f"{out}/likeness", partition_by=["is_test"])
    tables.write_report(tables.importance_report(m.auc, importances), f"{out}/report")
    return m.auc
