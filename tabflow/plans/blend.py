"""Blend-weight search on out-of-fold predictions."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabflow.operators import ensemble, validate
from tabflow.operators.metrics import auc_from_counts, roc_auc
from tabflow.scratch import materialize, scope
from tabflow.sources.tables import number_map

GAIN = 1e-12
# Cells that bound a candidate's AUC, and the doubt that rounding leaves in a bound.
CELLS = 1024
DOUBT = 1e-9
# Distinct prediction rows up to which the candidates are ranked by a plain window.
SMALL_PATTERNS = 200_000


def model_aucs(oof: DataFrame, *, label: str = "y") -> DataFrame:
    """(model, auc) of a long out-of-fold table."""
    return roc_auc(oof, score="pred", label=label, group=["model"]).select("model", "auc")


def top_models(oof: DataFrame, k: int, *, label: str = "y") -> DataFrame:
    """The k models with the highest AUC, ties by name."""
    return model_aucs(oof, label=label).orderBy(F.desc("auc"), "model").limit(k)


def prediction_patterns(oof: DataFrame, models: Sequence[str], *, key: str = "id", label: str = "y") -> DataFrame:
    """Distinct prediction rows ``p0 … pn`` over the models with their positives and negatives."""
    wide = oof.filter(F.col("model").isin(list(models))).groupBy(key, label).agg(
        *[F.max(F.when(F.col("model") == m, F.col("pred"))).alias(f"p{i}") for i, m in enumerate(models)]
    )
    return wide.groupBy(*[f"p{i}" for i in range(len(models))]).agg(
        F.count_if(F.col(label) == 1).alias("n1"), F.count_if(F.col(label) == 0).alias("n0")
    )


def blend_aucs(patterns: DataFrame, candidates: Sequence[Sequence[float]], *, bounded: bool) -> list[float]:
    """AUC of every candidate weight vector from one job."""
    score = lambda w: sum((F.col(f"p{i}") * F.lit(float(x)) for i, x in enumerate(w)), F.lit(0.0))
    each = F.array(*[F.struct(F.lit(c).alias("cand"), score(w).alias("score")) for c, w in enumerate(candidates)])
    long = patterns.select("n1", "n0", F.explode(each).alias("e")).groupBy("e.cand", "e.score").agg(F.sum("n1").alias("n1"), F.sum("n0").alias("n0"))
    found = {r["cand"]: r["auc"] for r in auc_from_counts(long, "score", ["cand"], bounded=bounded).collect()}
    return [found[c] for c in range(len(candidates))]


def auc_bounds(patterns: DataFrame, candidates: Sequence[Sequence[float]], *, cells: int = CELLS) -> list[tuple[float, float]]:
    """(low, high) bounds of every candidate's AUC, from one job that sums ``cells`` cells a candidate.

    Scores lie between the least and the greatest prediction, as weights add up to one. Pairs of
    rows in different cells are ordered for certain, pairs in one cell may stand either way.
    """
    n = len(candidates[0])
    ends = patterns.agg(F.min(F.least(*[F.col(f"p{i}") for i in range(n)]) if n > 1 else F.col("p0")).alias("lo"), F.max(F.greatest(*[F.col(f"p{i}") for i in range(n)]) if n > 1 else F.col("p0")).alias("hi")).first()
    lo, hi = ends["lo"], ends["hi"]
    if lo is None or hi <= lo or (hi - lo) / cells <= 0:
        return [(0.0, 1.0)] * len(candidates)
    score = lambda w: sum((F.col(f"p{i}") * F.lit(float(x)) for i, x in enumerate(w)), F.lit(0.0))
    cell = lambda w: F.greatest(F.lit(0), F.least(F.floor((score(w) - F.lit(lo)) / F.lit((hi - lo) / cells)), F.lit(cells - 1))).cast("int")
    each = F.array(*[F.struct(F.lit(c).alias("cand"), cell(w).alias("cell")) for c, w in enumerate(candidates)])
    counts = patterns.select("n1", "n0", F.explode(each).alias("e")).groupBy("e.cand", "e.cell").agg(F.sum("n1").alias("n1"), F.sum("n0").alias("n0"))
    # at most ``cells`` rows a candidate
    below = F.coalesce(F.sum("n0").over(Window.partitionBy("cand").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = counts.withColumn("below", below).groupBy("cand").agg(
        F.sum(F.col("n1").cast("double") * F.col("below")).alias("sure"), F.sum(F.col("n1").cast("double") * F.col("n0")).alias("tied"), (F.sum("n1").cast("double") * F.sum("n0")).alias("pairs")
    )
    found = {r["cand"]: (r["sure"] / r["pairs"], (r["sure"] + r["tied"]) / r["pairs"]) if r["pairs"] else (0.0, 1.0) for r in sums.collect()}
    return [found[c] for c in range(len(candidates))]


def survivors(bounds: Sequence[tuple[float, float]], best: float) -> list[int]:
    """Candidates that may gain on ``best`` and that none of the others beats for certain."""
    floor = max([best, *(low for low, _ in bounds)])
    return [c for c, (_, high) in enumerate(bounds) if high >= floor - DOUBT]


def neighbours(weights: Sequence[float], step: float) -> list[list[float]]:
    """All vectors that move one step of weight from one model to another, kept on the simplex."""
    out = []
    for i, give in enumerate(weights):
        for j, take in enumerate(weights):
            if i == j or give < step - GAIN or take + step > 1.0 + GAIN:
                continue
            moved = [min(1.0, max(0.0, w + (step if n == j else -step if n == i else 0.0))) for n, w in enumerate(weights)]
            out.append([w / sum(moved) for w in moved])
    return out


@dataclass(frozen=True)
class Round:
    """What a round of the search looked at."""

    candidates: int
    ranked: int
    ranked_rows: int


def simplex_search(patterns: DataFrame, n_models: int, *, step: float = 0.02, max_rounds: int = 500, small_patterns: int = SMALL_PATTERNS, eliminate: bool | None = None, cells: int = CELLS, rounds: list[Round] | None = None) -> tuple[list[float], float, bool]:
    """Hill climb from equal weights: take the best move until none gains; (weights, AUC, converged).

    The patterns are written once; a round scores at most n·(n-1) candidates, and what it writes
    is freed after it. With ``eliminate``, which is on for more than ``small_patterns`` patterns,
    a counting job bounds every candidate's AUC first, and only those that may win are ranked; the
    moves are the same. ``converged`` is false if ``max_rounds`` ended the climb; ``rounds`` gets
    a record of each round.
    """
    spark = patterns.sparkSession
    patterns = materialize(patterns, "patterns")
    bounded = patterns.limit(small_patterns + 1).count() <= small_patterns

    eliminate = not bounded if eliminate is None else eliminate
    n_patterns = patterns.count() if rounds is not None else 0

    def scored(candidates: Sequence[Sequence[float]], best: float | None = None) -> list[tuple[Sequence[float], float]]:
        """Candidates that may win with their AUC, in order."""
        with scope(spark):
            left = survivors(auc_bounds(patterns, candidates, cells=cells), best) if eliminate and best is not None and candidates else range(len(candidates))
            chosen = [candidates[c] for c in left]
            if rounds is not None and best is not None:
                rounds.append(Round(len(candidates), len(chosen), len(chosen) * n_patterns))
            return list(zip(chosen, blend_aucs(patterns, chosen, bounded=bounded))) if chosen else []

    weights = [1.0 / n_models] * n_models
    best = scored([weights])[0][1]
    for _ in range(max_rounds):
        moves = neighbours(weights, step) if n_models > 1 else []
        chosen = None
        for move, auc in scored(moves, best):
            if auc > best + GAIN:
                chosen, best = move, auc
        if chosen is None:
            return weights, best, True
        weights = chosen
    return weights, best, False


@dataclass(frozen=True)
class Blend:
    strategy: str
    models: list[str]
    weights: list[float]
    auc: float
    comparison: dict[str, float]
    candidates: dict[str, float]
    oof: DataFrame
    test: DataFrame
    converged: bool = True  # false if the round limit ended a search


def optimised_blend(oof: DataFrame, test: DataFrame, *, key: str = "id", label: str = "y", step: float = 0.02, top_k: int = 5, max_rounds: int = 500, models: Sequence[str] | None = None) -> Blend:
    """Search weights of the best ``top_k`` models in rank and probability space; rank wins ties."""
    if step <= 0 or top_k < 1:
        raise ValueError("step must be positive and top_k at least 1")
    names = list(models or ensemble.common_models(oof, test))
    best = [(r["model"], r["auc"]) for r in top_models(oof.filter(F.col("model").isin(names)), top_k, label=label).collect()]
    chosen = [m for m, _ in best]
    oof, test = (d.filter(F.col("model").isin(chosen)) for d in (oof, test))
    spaces = {"rank": (materialize(ensemble.rank_predictions(oof), "oof_ranks"), ensemble.rank_predictions(test)), "prob": (oof, test)}
    found = {s: simplex_search(prediction_patterns(o, chosen, key=key, label=label), len(chosen), step=step, max_rounds=max_rounds) for s, (o, _) in spaces.items()}
    space = "rank" if found["rank"][1] >= found["prob"][1] else "prob"
    weights, auc, _ = found[space]
    shares = dict(zip(chosen, weights))
    mix = lambda d, keep: ensemble.weighted_blend(d, shares, key=key, keep=keep)
    return Blend(space, chosen, weights, auc, {f"{s}_auc": a for s, (_, a, _) in found.items()}, dict(best), mix(spaces[space][0], [label]), mix(spaces[space][1], []), all(c for *_, c in found.values()))


def equal_blend(oof: DataFrame, test: DataFrame, *, space: str, key: str = "id", label: str = "y") -> Blend:
    """Equal weights over all common models in one space."""
    names = ensemble.common_models(oof, test)
    o = ensemble.equal_blend(oof, names, space=space, key=key, keep=[label])
    auc = roc_auc(o, score="blend", label=label).first()["auc"]
    return Blend(space, names, [1.0 / len(names)] * len(names), auc, {f"{space}_auc": auc}, {}, o, ensemble.equal_blend(test, names, space=space, key=key))


def blend(oof: DataFrame, test: DataFrame, *, strategy: str = "oof_opt", key: str = "id", label: str = "y", **options) -> Blend:
    """Checked blend by strategy "rank", "prob" or "oof_opt"."""
    for name, d in (("oof", oof), ("test", test)):
        if d.filter(F.col("pred").isNull() | F.isnan("pred")).limit(1).count():
            raise validate.ValidationError(f"{name}: missing predictions")
        validate.require_unique_key(d.select(F.struct(key, "model").alias("row")), "row", name)
    if oof.filter(F.col(label).isNull()).limit(1).count():
        raise validate.ValidationError("oof: missing target")
    if strategy in ("rank", "prob"):
        return equal_blend(oof, test, space=strategy, key=key, label=label)
    if strategy != "oof_opt":
        raise ValueError(f"unknown strategy {strategy!r}: use 'rank', 'prob' or 'oof_opt'")
    return optimised_blend(oof, test, key=key, label=label, **options)


def blend_submission(b: Blend, *, key: str = "id", name: str = "pred") -> DataFrame:
    """Blended test predictions limited to [0, 1]."""
    return b.test.select(key, F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("blend"))).alias(name))


def blend_document(b: Blend, *, requested: str, step: float | None = None, top_k: int | None = None) -> dict:
    """Column expressions of the weights document."""
    return {
        "strategy_requested": F.lit(requested), "selected_strategy": F.lit(b.strategy), "selected_auc": F.lit(float(b.auc)),
        "step": F.lit(step).cast("double"), "top_k": F.lit(top_k).cast("int"), "n_models": F.lit(len(b.models)),
        "selected_columns": F.array(*[F.lit(m) for m in b.models]), "weights": number_map(dict(zip(b.models, b.weights))),
        "converged": F.lit(b.converged), "comparison": number_map(b.comparison), "top_candidates": number_map(b.candidates),
    }


def base_document(weights: dict[str, float], auc: float) -> dict:
    """Weights document of the plain ensemble, without a blend search."""
    return {
        "strategy": F.lit("none"), "selected_strategy": F.lit("base_ensemble"), "selected_auc": F.lit(float(auc)),
        "selected_columns": F.array(*[F.lit(m) for m in sorted(weights)]), "weights": number_map(weights),
    }
