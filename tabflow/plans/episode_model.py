"""Score every inference episode in one pass and return delta predictions per fold model."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabflow.functions import fixed_values as fv
from tabflow.operators import episodes as ep
from tabflow.operators import folds, prefixes
from tabflow.operators.metrics import euclidean_error
from tabflow.scratch import materialize

KEY = ep.KEY
# Steps of the sequences that a worker turns into Python objects at once; a longer sequence stands alone.
STEPS_AT_ONCE = 20_000
DELTA = "game_episode string, anchor_x double, anchor_y double, delta_x double, delta_y double"


def summaries(df: DataFrame, policy: str = "all_pass", *, key: str = KEY, **options) -> DataFrame:
    """Summaries of the samples of a policy. Every pass is a sample in "all_pass": its history is
    summed by prefix totals and never built."""
    if policy == "all_pass" and not options.get("max_tail_k"):
        return prefixes.prefix_summaries(df, key=key, **{k: v for k, v in options.items() if k != "max_tail_k"})
    return sample_summary(ep.long_features(df, policy=policy, key=key, **options), key)


def sample_summary(long: DataFrame, key: str = KEY) -> DataFrame:
    """One row per sample: numbers of its last step, means over all steps, length, anchor, target."""
    last = lambda c: F.max_by(c, "pos").alias(f"last_{c}")
    return long.groupBy(key, "t_pos").agg(
        *[last(c) for c in fv.SEQUENCE_NUMBERS], *[F.avg(c).alias(f"mean_{c}") for c in ("dx", "dy", "dist", "dt", "sx_abs", "sy_abs")],
        F.count(F.lit(1)).alias("length"), *[F.first(c).alias(c) for c in ("anchor_x", "anchor_y", "target_dx", "target_dy")],
    )


def summary_features() -> list[str]:
    return [*[f"last_{c}" for c in fv.SEQUENCE_NUMBERS], *[f"mean_{c}" for c in ("dx", "dy", "dist", "dt", "sx_abs", "sy_abs")], "length"]


def train_fold_models(samples: DataFrame, n_folds: int, *, make: Callable[[], object] = LinearRegression, seed: int = 42) -> list[tuple]:
    """Per fold, a model for each delta trained on the games outside the fold; ``samples`` is a
    table of ``sample_summary``."""
    keyed = samples.withColumn("game", F.substring_index(KEY, "_", 1))
    assigned = folds.group_folds(keyed, "game", n_folds, seed=seed)
    data = materialize(assembled(keyed.join(assigned, "game")).select("fold", "features", "target_dx", "target_dy"), "episode_train")
    fit = lambda f, label: make().setFeaturesCol("features").setLabelCol(label).fit(data.filter(F.col("fold") != f))
    return [(fit(f, "target_dx"), fit(f, "target_dy")) for f in range(n_folds)]


def assembled(df: DataFrame) -> DataFrame:
    number = lambda c: F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(None)), F.lit(0.0)).alias(c)
    other = [F.col(c) for c in df.columns if c not in summary_features()]
    return VectorAssembler(inputCols=summary_features(), outputCol="features").transform(df.select(*other, *[number(c) for c in summary_features()]))


def predict_deltas(models: Sequence[tuple], samples: DataFrame) -> DataFrame:
    """(game_episode, fold, anchor_x, anchor_y, delta_x, delta_y); deltas limited to [-1, 1]."""
    ready = assembled(samples).select(KEY, "anchor_x", "anchor_y", "features")
    limited = lambda c: F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col(c)))
    parts = []
    for f, (mx, my) in enumerate(models):
        x = mx.copy({mx.getParam("predictionCol"): "delta_x"}).transform(ready)
        both = my.copy({my.getParam("predictionCol"): "delta_y"}).transform(x)
        parts.append(both.select(KEY, F.lit(f).alias("fold"), "anchor_x", "anchor_y", limited("delta_x").alias("delta_x"), limited("delta_y").alias("delta_y")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _schema(delta: pa.DataType) -> pa.Schema:
    return pa.schema([(KEY, pa.string()), ("anchor_x", pa.float64()), ("anchor_y", pa.float64()), ("delta_x", delta), ("delta_y", delta)])


def _bounded(batches: Iterator[pa.RecordBatch], steps: int = STEPS_AT_ONCE) -> Iterator[pd.DataFrame]:
    """Packed sequences of up to ``steps`` steps together; only these leave Arrow's compact form."""
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.list_value_length(batch.column("num")), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            done = ends[at - 1] if at else 0
            stop = max(at + 1, int(np.searchsorted(ends, done + steps, "right")))
            yield batch.slice(at, stop - at).to_pandas()
            at = stop


def predict_with(sequences: DataFrame, predict: Callable[..., pd.DataFrame], *, model: object = None) -> DataFrame:
    """Deltas from a user's own model, scored on Arrow batches of packed sequences.

    ``predict`` gets a batch (num, cat, length, …) and returns columns delta_x and delta_y in
    the same row order; they are limited to [-1, 1]. A ``model`` is broadcast once, reaches each
    Python worker once, and is handed over as the first argument: its size is the caller's.
    """
    shared = sequences.sparkSession.sparkContext.broadcast(model) if model is not None else None
    schema = _schema(pa.float64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _bounded(batches):
            d = predict(b) if shared is None else predict(shared.value, b)
            if len(d) != len(b):
                raise ValueError(f"the model returned {len(d)} rows for {len(b)} sequences")
            limited = {c: np.clip(np.asarray(d[c], dtype=np.float64), -1.0, 1.0) for c in ("delta_x", "delta_y")}
            yield pa.RecordBatch.from_pandas(pd.DataFrame({**{c: b[c].to_numpy() for c in (KEY, "anchor_x", "anchor_y")}, **limited}), schema=schema, preserve_index=False)

    return sequences.mapInArrow(run, DELTA)


def score_episodes(df: DataFrame, vocabulary: DataFrame, models: Sequence[object], predict: Callable[..., pd.DataFrame], **options) -> DataFrame:
    """(game_episode, fold, anchor_x, anchor_y, delta_x, delta_y): every episode scored by every fold's model.

    The sequences are built and packed once; ``models`` travel in one broadcast.
    """
    sequences = materialize(ep.inference_sequences(df, vocabulary, **options), "sequences")

    def every(shared: Sequence[object], batch: pd.DataFrame) -> pd.DataFrame:
        parts = [predict(m, batch) for m in shared]
        return pd.DataFrame({c: [list(v) for v in zip(*[np.asarray(p[c], dtype=np.float64) for p in parts])] for c in ("delta_x", "delta_y")})

    shared, schema = sequences.sparkSession.sparkContext.broadcast(list(models)), _schema(pa.list_(pa.float64()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _bounded(batches):
            found = pd.concat([b[[KEY, "anchor_x", "anchor_y"]].reset_index(drop=True), every(shared.value, b)], axis=1)
            yield pa.RecordBatch.from_pandas(found, schema=schema, preserve_index=False)

    scored = sequences.mapInArrow(run, f"{KEY} string, anchor_x double, anchor_y double, delta_x array<double>, delta_y array<double>")
    each = scored.select(KEY, "anchor_x", "anchor_y", F.posexplode(F.arrays_zip("delta_x", "delta_y")).alias("fold", "d"))
    limited = lambda c: F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col(f"d.{c}"))).alias(c)
    return each.select(KEY, "fold", "anchor_x", "anchor_y", limited("delta_x"), limited("delta_y"))


@dataclass(frozen=True)
class MeanScorer:
    """Deltas as linear functions of the mean of a sequence's numbers; nulls count as 0."""

    weights_x: tuple[float, ...]
    weights_y: tuple[float, ...]


def mean_scores(model: MeanScorer, batch: pd.DataFrame) -> pd.DataFrame:
    """Scores of a batch at once: all steps of all sequences stand in one matrix."""
    lengths = batch["num"].map(len).to_numpy(dtype=np.int64)
    if not len(batch):
        return pd.DataFrame({"delta_x": [], "delta_y": []})
    steps = np.nan_to_num(np.array([row for rows in batch["num"] for row in rows], dtype=np.float64))
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    means = np.add.reduceat(steps, starts, axis=0) / lengths[:, None]
    return pd.DataFrame({"delta_x": means @ np.array(model.weights_x), "delta_y": means @ np.array(model.weights_y)})


def mean_error(predictions: DataFrame, truth: DataFrame, *, key: str = KEY) -> DataFrame:
    """Mean distance in metres between predicted and true deltas per fold."""
    joined = predictions.join(truth.select(key, "target_dx", "target_dy"), key)
    return euclidean_error(joined, pred=("delta_x", "delta_y"), truth=("target_dx", "target_dy"), group=["fold"])
