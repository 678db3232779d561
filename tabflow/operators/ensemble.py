"""Out-of-fold bookkeeping and ensembles on long prediction tables (id, model, fold, pred)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabflow.functions import fixed_values as fv
from tabflow.functions import geometry as geo
from tabflow.operators import validate
from tabflow.operators.ranking import exact_quantiles, percent_rank_avg
from tabflow.scratch import materialize


def to_long(wide: DataFrame, models: Sequence[str], keep: Sequence[str]) -> DataFrame:
    return wide.unpivot(list(keep), [f"`{m}`" for m in models], "model", "pred")


def to_wide(long: DataFrame, models: Sequence[str], *, key: str = "id", keep: Sequence[str] = ()) -> DataFrame:
    """One column per declared model, for files; without a pass to discover the models."""
    return long.groupBy(key, *keep).agg(*[F.max(F.when(F.col("model") == m, F.col("pred"))).alias(m) for m in models])


def model_weights(configs: Sequence[str], submodes: Mapping[str, float], seeds: Sequence[int]) -> dict[str, float]:
    """Weight of each ``pred_<config>_<submode>_<seed>``: submode weight shared over seeds and configs."""
    return {
        f"pred_{c}_{m}_{s}": w / len(seeds) / len(configs) for c in configs for m, w in submodes.items() if w > 0.0 for s in seeds
    }


def submode_weights(feature_mode: str, hybrid_weight: float = 0.5) -> dict[str, float]:
    """Weights of the categorical and numeric feature modes; zero weights are dropped."""
    if feature_mode in ("cat", "numeric"):
        return {feature_mode: 1.0}
    if not 0.0 <= hybrid_weight <= 1.0:
        raise ValueError("hybrid_weight must be within [0, 1]")
    return {k: w for k, w in {"cat": hybrid_weight, "numeric": 1.0 - hybrid_weight}.items() if w > 0.0}


def parse_weights(weights: Sequence[float] | None, n: int) -> list[float]:
    """Normalised weights; equal by default."""
    if weights is None:
        return [1.0 / n] * n
    if len(weights) != n:
        raise ValueError(f"{n} weights expected, got {len(weights)}")
    if sum(weights) <= 0:
        raise ValueError("weights must have a positive sum")
    return [w / sum(weights) for w in weights]


def weight_of(model: Column, weights: Mapping[str, float]) -> Column:
    """Weight by model name as an expression; an unlisted model has none."""
    pairs = [F.lit(v) for item in weights.items() for v in (item[0], float(item[1]))]
    return F.try_element_at(F.create_map(*pairs), model)


def weighted_blend(long: DataFrame, weights: Mapping[str, float], *, key: str = "id", keep: Sequence[str] = (), name: str = "blend") -> DataFrame:
    """Σ w · pred per key over the listed models."""
    used = long.filter(F.col("model").isin(list(weights)))
    return used.groupBy(key, *keep).agg(F.sum(F.col("pred") * weight_of(F.col("model"), weights)).alias(name))


def common_models(oof: DataFrame, test: DataFrame, prefix: str = "pred_") -> list[str]:
    """Sorted models both tables have; an error if there is none."""
    named = lambda df: df.select("model").distinct().filter(F.startswith("model", F.lit(prefix)))
    names = sorted(r["model"] for r in named(oof).intersect(named(test)).collect())
    if not names:
        raise ValueError(f"no common prediction model starts with {prefix!r}")
    return names


def rank_predictions(long: DataFrame, *, partitions: int | None = None) -> DataFrame:
    """Predictions replaced by their average-tie percent rank within each model."""
    ranked = percent_rank_avg(long, "pred", group=["model"], name="__rank", partitions=partitions)
    return ranked.withColumn("pred", F.col("__rank")).drop("__rank")


def equal_blend(long: DataFrame, models: Sequence[str], *, space: str = "prob", key: str = "id", keep: Sequence[str] = ()) -> DataFrame:
    """Equal-weight blend of the listed models in probability or rank space."""
    used = long.filter(F.col("model").isin(list(models)))
    if space == "rank":
        used = rank_predictions(used)
    elif space != "prob":
        raise ValueError(f"unknown space {space!r}: use 'prob' or 'rank'")
    return weighted_blend(used, {m: 1.0 / len(models) for m in models}, key=key, keep=keep)


def rank_average(tables: Sequence[DataFrame], *, key: str = "id", value: str = "pred", weights: Sequence[float] | None = None) -> DataFrame:
    """Weighted average of the percent ranks of N tables with the same unique keys."""
    shares = parse_weights(weights, len(tables))
    for i, t in enumerate(tables):
        validate.require_columns(t, [key, value], f"table {i}")
        validate.require_unique_key(t, key, f"table {i}")
    validate.require_same_keys(tables, key)
    long = stack({f"t{i}": t.select(key, F.col(f"`{value}`").alias("pred")) for i, t in enumerate(tables)})
    blended = weighted_blend(rank_predictions(long), {f"t{i}": w for i, w in enumerate(shares)}, key=key, name="__blend")
    return blended.select(key, F.col("__blend").alias(value))


def stack(tables: Mapping[str, DataFrame], label: str = "model") -> DataFrame:
    """Tables stacked with a label column."""
    return reduce(DataFrame.unionByName, [t.withColumn(label, F.lit(name)) for name, t in tables.items()])


def mean_over_folds(long: DataFrame, *, key: str = "id") -> DataFrame:
    """Test prediction of each model: mean over the fold models."""
    return long.groupBy(key, "model").agg(F.avg("pred").alias("pred"))


def assemble_oof(predictions: DataFrame, assignment: DataFrame, *, key: str = "id") -> DataFrame:
    """Each row's prediction by the model of its own fold."""
    return predictions.join(assignment.select(key, "fold"), [key, "fold"], "left_semi").select(key, "fold", "model", "pred")


def trimmed_mean(values: Column, k: int, trim: int) -> Column:
    """Mean of an array of k values after dropping ``trim`` at each end."""
    if trim < 0 or 2 * trim >= k:
        raise ValueError(f"cannot drop {trim} at each end of {k} values")
    kept = F.slice(F.array_sort(values), trim + 1, k - 2 * trim)
    return F.aggregate(kept, F.lit(0.0), lambda a, x: a + x) / (k - 2 * trim)


def delta_ensemble(folds: DataFrame, *, key: str = "game_episode", fold: str = "fold", space: str = "atanh", trim: int = 0, eps: float = 1e-6, field: tuple[float, float] = fv.FIELD, tolerance: float = 1e-4) -> DataFrame:
    """End point per key from the delta predictions of all folds.

    The folds must hold the same keys once each and the same anchors. Deltas are averaged
    (trimmed per coordinate) before the tanh ("atanh" and its aliases) or as they are
    ("mean" and its aliases); the lowest fold supplies the anchor.
    """
    inner, plain = ("atanh", "logit", "pre_tanh", "pretanh"), ("mean", "tanh", "raw")
    if space not in inner + plain:
        raise ValueError(f"unknown space {space!r}: use one of {inner + plain}")
    limited = lambda c: F.greatest(F.lit(eps - 1.0), F.least(F.lit(1.0 - eps), F.col(c)))
    value = (lambda c: F.atanh(limited(c))) if space in inner else F.col
    # one row per fold and key, as checked below: the arrays hold k numbers
    gap = F.greatest(F.max("anchor_x") - F.min("anchor_x"), F.max("anchor_y") - F.min("anchor_y"))
    grouped = materialize(folds.groupBy(key).agg(
        F.collect_list(value("delta_x")).alias("dx"), F.collect_list(value("delta_y")).alias("dy"), F.min_by(F.struct("anchor_x", "anchor_y"), fold).alias("a"),
        F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_set(fold)).alias("of"), gap.alias("gap"),
    ), "fold_deltas")
    seen = grouped.agg(F.min("of").alias("low"), F.max("of").alias("high"), F.min("n").alias("n_low"), F.max("n").alias("n_high"), F.max("gap").alias("gap")).first()
    k = len(seen["high"] or [])
    if seen["low"] != seen["high"] or (k and {seen["n_low"], seen["n_high"]} != {k}):
        raise validate.ValidationError(f"some {key} is missing or repeated in one of the {k} folds")
    if seen["gap"] is not None and seen["gap"] > tolerance:
        raise validate.ValidationError(f"anchors of one {key} differ by {seen['gap']} between folds")
    if not k:
        return grouped.select(key, F.lit(None).cast("double").alias("end_x"), F.lit(None).cast("double").alias("end_y"))
    mean = lambda c: F.tanh(trimmed_mean(F.col(c), k, trim)) if space in inner else trimmed_mean(F.col(c), k, trim)
    return grouped.select(
        key, geo.delta_to_end(F.col("a.anchor_x"), mean("dx"), field[0]).alias("end_x"), geo.delta_to_end(F.col("a.anchor_y"), mean("dy"), field[1]).alias("end_y")
    )


def importance_table(importances: DataFrame) -> DataFrame:
    """(feature, importance_mean, population importance_std, n_models) over (feature, importance) rows, best first."""
    return importances.groupBy("feature").agg(
        F.avg("importance").alias("importance_mean"), F.stddev_pop("importance").alias("importance_std"), F.count(F.lit(1)).alias("n_models")
    ).orderBy(F.desc("importance_mean"), "feature")


def fold_summary(detail: DataFrame, fold_auc: DataFrame, oof_auc: float) -> DataFrame:
    """Per-fold AUC and best-iteration statistics, then rows mean, std (population) and oof.

    ``detail`` has one row per trained model (fold, best_iteration), ``fold_auc`` one per fold.
    """
    medians = exact_quantiles(detail, "best_iteration", [0.5], group=["fold"]).withColumnRenamed("q0", "best_iteration_median")
    stats = detail.groupBy("fold").agg(
        F.avg("best_iteration").alias("best_iteration_mean"),
        F.min("best_iteration").alias("best_iteration_min"), F.max("best_iteration").alias("best_iteration_max"), F.count(F.lit(1)).alias("n_models"),
    ).join(medians, "fold", "left")
    stats = stats.select("fold", *[f"best_iteration_{s}" for s in ("mean", "median", "min", "max")], "n_models")
    per_fold = fold_auc.select("fold", "auc").join(stats, "fold", "left").select(F.col("fold").cast("string").alias("fold"), F.lit("fold_ensemble").alias("scope"), *[c for c in ["auc", *stats.columns] if c != "fold"])
    overall = fold_auc.agg(F.avg("auc").alias("mean"), F.stddev_pop("auc").alias("std")).withColumn("oof", F.lit(float(oof_auc)).cast("double"))
    rows = overall.unpivot([], ["mean", "std", "oof"], "fold", "auc").withColumn("scope", F.lit("cv_summary"))
    return per_fold.unionByName(rows, allowMissingColumns=True)
