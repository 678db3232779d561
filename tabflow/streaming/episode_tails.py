"""Inference features of episodes on a stream of events, by keyed state.

The state of an episode is its last ``k`` events in the order of the order columns, and how many
it has seen; nothing else is kept, so state is bounded by the number of episodes. Episodes of one
hash bucket share a state, which a batch that brings events of any of them reads and writes once. Events may come in
any order, within a batch and over batches: one that belongs into the last ``k`` takes its place
there, an older one only counts. For every batch that brings events of an episode its whole
tail leaves, numbered and seen from its last row, and the row-wise expressions of the batch form
(``episodes.sequence_features``) run on the stream unchanged. ``drain`` keeps the newest view of
each episode: what ``episodes.long_features`` with "last_row" and ``max_tail_k`` gives for all events.

State lives in RocksDB below the query's checkpoint, so a restarted query goes on where it was.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.types import DoubleType, IntegralType, LongType, StructField, StructType

from tabflow.functions import fixed_values as fv
from tabflow.operators import episodes as ep
from tabflow.scratch import materialize, scratch_root

ROCKSDB = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}
# Episodes share this many states: a call and a round trip to the store for each episode cost more than its rows.
BUCKETS = 1024
_BUCKET, _SEEN = "__bucket", "seen"
_TARGET = ("start_x", "start_y", "end_x", "end_y")


class _Tails(StatefulProcessor):
    """The last ``k`` rows, in order, of all keys of a bucket."""

    def __init__(self, k: int, order: Sequence[str], schema: StructType, key: str):
        self.k, self.order, self.schema, self.key = k, list(order), schema, key
        self.names = [f.name for f in schema if f.name != _SEEN]
        self.whole = [f.name for f in schema if isinstance(f.dataType, IntegralType)]

    def init(self, handle) -> None:
        self.rows = handle.getListState("rows", self.schema)

    def _plain(self, chunk: pd.DataFrame) -> pd.DataFrame:
        """Rows of plain values; nulls are None, and whole numbers beside nulls stay whole."""
        columns = {}
        for name in self.names:
            values = chunk[name].astype(object).where(chunk[name].notna(), None).tolist()
            columns[name] = [None if v is None else int(v) for v in values] if name in self.whole else values
        return pd.DataFrame(columns, dtype=object)

    def _last(self, rows: pd.DataFrame) -> pd.DataFrame:
        """The last ``k`` rows of each key, in order; rows that tie keep the order they came in."""
        rows = rows.assign(__key=pd.factorize(rows[self.key], use_na_sentinel=False)[0])
        rows = rows.sort_values(["__key", *self.order], kind="stable", na_position="first", ignore_index=True)
        back = rows.groupby("__key", sort=False).cumcount(ascending=False)
        return rows[back < self.k].drop(columns="__key").reset_index(drop=True)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        tail = pd.DataFrame([tuple(r) for r in self.rows.get()], columns=[*self.names, _SEEN], dtype=object)
        seen = dict(zip(tail[self.key], tail.pop(_SEEN)))
        came: dict = {}
        for chunk in rows:
            chunk = self._plain(chunk)
            for name, n in chunk[self.key].value_counts(dropna=False, sort=False).items():
                name = None if pd.isna(name) else name
                came[name] = came.get(name, 0) + n
            tail = self._last(pd.concat([tail, chunk], ignore_index=True) if len(tail) else chunk)
        for name, n in came.items():
            seen[name] = seen.get(name, 0) + n
        names = [None if pd.isna(v) else v for v in tail[self.key]]
        total = [int(seen[v]) for v in names]
        self.rows.put([(*r, n) for r, n in zip(tail.itertuples(index=False, name=None), total)])
        out = tail.assign(**{_SEEN: total})[[v in came for v in names]].reset_index(drop=True)
        # rows of a key stand together
        number = pd.factorize(out[self.key], use_na_sentinel=False)[0]
        n = np.bincount(number, minlength=1)
        ends = np.cumsum(n)[number] - 1 if len(out) else number
        out["pos"] = out.groupby(number, sort=False).cumcount() + 1
        clock = out["time_seconds"].tolist()
        out["dt_raw"] = pd.Series([None if i == 0 or number[i] != number[i - 1] or v is None or clock[i - 1] is None else v - clock[i - 1] for i, v in enumerate(clock)], dtype=object)
        out["t_pos"] = n[number]
        for c in ("team_id", *_TARGET):
            values = out[c].tolist()
            out["t_team" if c == "team_id" else f"t_{c}"] = pd.Series([values[i] for i in ends], dtype=object)
        yield out

    def close(self) -> None:
        pass


def tails(events: DataFrame, k: int, *, key: str = ep.KEY, order: Sequence[str] | None = None, buckets: int = BUCKETS) -> DataFrame:
    """Streaming (key, columns, pos, dt_raw, t_pos, t_team, t_start_x, …, seen) of every episode that a batch touches."""
    if k < 1:
        raise ValueError("the state keeps at least one row")
    order = list(order or ep.step_order(events))
    used = [*order, "time_seconds", "period_id", "team_id", "player_id", "type_name", "result_name", "start_x", "start_y", "end_x", "end_y"]
    narrow = events.select(key, *dict.fromkeys(c for c in used if c in events.columns))
    kind = {f.name: f.dataType for f in narrow.schema}
    seen = StructField(_SEEN, LongType())
    added = [seen, StructField("pos", LongType()), StructField("dt_raw", DoubleType()), StructField("t_pos", LongType()), StructField("t_team", kind["team_id"])]
    plain = [StructField(f.name, f.dataType) for f in narrow.schema]
    schema = StructType([*plain, *added, *[StructField(f"t_{c}", kind[c]) for c in _TARGET]])
    bucket = F.pmod(F.xxhash64(F.col(f"`{key}`")), F.lit(buckets)).cast("int")
    return narrow.withColumn(_BUCKET, bucket).groupBy(_BUCKET).transformWithStateInPandas(
        statefulProcessor=_Tails(k, order, StructType([*plain, seen]), key), outputStructType=schema, outputMode="Update", timeMode="None")


def inference_views(events: DataFrame, k: int, *, key: str = ep.KEY, order: Sequence[str] | None = None, field: tuple[float, float] = fv.FIELD) -> DataFrame:
    """Streaming inference features: (key, t_pos, pos, 21 numbers, 4 categories, target_dx, target_dy, seen)."""
    out = ep.sequence_features(tails(events, k, key=key, order=order), field=field, mask_target_end=False)
    return out.select(key, "t_pos", "pos", *fv.SEQUENCE_NUMBERS, *fv.SEQUENCE_CATEGORIES, *ep._targets_of(out, field), "seen")


@contextmanager
def rocksdb(spark: SparkSession):
    """Session settings of the state store for the time a query starts and runs."""
    before = {k: spark.conf.get(k, None) for k in ROCKSDB}
    for k, v in ROCKSDB.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def drain(views: DataFrame, *, key: str = ep.KEY, checkpoint: str | None = None) -> DataFrame:
    """Run the stream over what is there and return the newest view of every episode.

    With ``checkpoint`` a later call goes on with new events; episodes without new events keep
    the view they had.
    """
    spark = views.sparkSession
    folder = checkpoint or f"{scratch_root(spark)}/tails-{uuid.uuid4().hex}"

    def put(batch: DataFrame, number: int) -> None:
        # rewriting a batch's own folder makes a repeated batch harmless
        batch.write.mode("overwrite").parquet(f"{folder}/views/batch={number}")

    with rocksdb(spark):
        views.writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    try:
        written = spark.read.schema(StructType([*views.schema, StructField("batch", LongType())])).option("basePath", f"{folder}/views").parquet(f"{folder}/views")
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], views.schema)  # a stream without a file runs no batch
    newest = materialize(written.groupBy(key).agg(F.max("seen").alias("seen")), "newest-views")
    return written.join(newest, [key, "seen"]).select(*views.columns)
