"""Exact dedup as a stateful stream: keyed state on disk, without expiry.

Documents arrive as a file stream. State is keyed by the digest of the normalised text and
kept in RocksDB below the shared checkpoint folder; it never expires. For every digest it
retains the stable identifier of the row that stays (the largest id), a locator of that
row's content (file and row number), and the number of rows seen. The stream is drained in
micro-batches of ``files_per_batch`` files, and a restarted query continues from its log.

A digest seen more than once is a hit. The full bytes of every hit are compared: least and
greatest text of a digest are found map-side first, so a text copied a billion times sends
one row from each task. Where they differ, which takes two texts with one digest, the digest
is split by its texts.

Defined cases: a null text counts as empty; equal texts keep the row with the largest id,
among equal ids the one last by content locator; a null id is below every other; an empty
table gives no rows; extra columns are not read.
"""

from __future__ import annotations

import uuid
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabflow.llm.common import ascii_lower, bounded_broadcast
from tabflow.scratch import materialize, scratch_root

FILES_PER_BATCH = 64
# Digests of hits are broadcast up to this many (about 30 MB), else joined by shuffle.
BROADCAST_DIGESTS = 200_000
# Many small state stores: no preallocated files, and each batch uploads its changes only.
STATE_CONF = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


def sha256_of(normal: Column) -> Column:
    return F.sha2(normal.cast("binary"), 256)


def _rows(source: DataFrame, doc_id: str, text: str, digest) -> DataFrame:
    normal = ascii_lower(F.coalesce(F.col(text), F.lit("")))
    return source.select(
        F.col(doc_id).cast("long").alias("doc_id"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"), normal.alias("normal"),
    ).withColumn("digest", digest(F.col("normal")))


def _pattern(path: str) -> str:
    """``path`` as a pattern that matches it alone: a file stream takes a single file only by pattern."""
    path = path.rstrip("/")
    return path if any(c in path for c in "*?[{") else f"{path[:-1]}[{path[-1]}]"


@contextmanager
def _session_conf(spark: SparkSession, wanted: dict[str, str]):
    """Session settings for the time a stream starts and runs."""
    before = {k: spark.conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def stream_state(spark: SparkSession, path: str, *, doc_id: str = "doc_id", text: str = "text", digest=sha256_of, files_per_batch: int = FILES_PER_BATCH, checkpoint: str | None = None) -> DataFrame:
    """Drain the files below ``path`` through the keyed state and return the state as a table.

    (digest, keep: struct<doc_id, file, row>, group_size) of every digest. With ``checkpoint``
    given, a later call continues that stream with the files that are new since.
    """
    folder = checkpoint or f"{scratch_root(spark)}/exact-dedup-{uuid.uuid4().hex}"
    table = spark.read.parquet(path)
    stream = spark.readStream.schema(table.schema).option("maxFilesPerTrigger", files_per_batch).parquet(_pattern(path))
    keyed = _rows(stream, doc_id, text, digest).groupBy("digest").agg(F.max(F.struct("doc_id", "file", "row")).alias("keep"), F.count("*").alias("group_size"))

    def put(changed: DataFrame, batch: int) -> None:
        # rewriting a batch's own folder makes a repeated batch harmless
        changed.write.mode("overwrite").parquet(f"{folder}/changes/batch={batch}")

    with _session_conf(spark, STATE_CONF):
        query = keyed.writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
        query.awaitTermination()
    schema = "digest string, keep struct<doc_id:long,file:string,row:long>, group_size long, batch int"
    try:
        changes = spark.read.schema(schema).option("basePath", f"{folder}/changes").parquet(f"{folder}/changes")
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        changes = spark.createDataFrame([], schema)  # a stream without a file runs no batch
    # the last change of a digest is its state
    return changes.groupBy("digest").agg(F.max_by(F.struct("keep", "group_size"), "batch").alias("s")).select("digest", "s.keep", "s.group_size")


def exact_duplicates(spark: SparkSession, path: str, *, doc_id: str = "doc_id", text: str = "text", digest=sha256_of, files_per_batch: int = FILES_PER_BATCH) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, digest) of every row of the Parquet table at ``path``."""
    state = materialize(stream_state(spark, path, doc_id=doc_id, text=text, digest=digest, files_per_batch=files_per_batch), "exact-state")
    rows = _rows(spark.read.parquet(path), doc_id, text, digest)
    narrow = rows.select("doc_id", "file", "row", "digest").join(state, "digest")
    hits = bounded_broadcast(state.filter("group_size > 1").select("digest"), BROADCAST_DIGESTS)
    compared = rows.select("digest", "normal").join(hits, "digest", "left_semi").groupBy("digest").agg(F.min("normal").alias("low"), F.max("normal").alias("high"))
    collided = materialize(compared.filter("low <> high").select("digest"), "exact-collided")
    answer = narrow.select("doc_id", F.col("keep.doc_id").alias("keep_id"), "group_size", F.col("keep").eqNullSafe(F.struct("doc_id", "file", "row")).alias("kept"), "digest")
    if collided.isEmpty():
        return answer
    # different texts with one digest: their rows are grouped by the text itself
    apart = rows.join(collided, "digest", "left_semi")
    groups = apart.groupBy("digest", "normal").agg(F.max(F.struct("doc_id", "file", "row")).alias("keep"), F.count("*").alias("group_size"))
    split = apart.join(groups, ["digest", "normal"]).select("doc_id", F.col("keep.doc_id").alias("keep_id"), "group_size", F.col("keep").eqNullSafe(F.struct("doc_id", "file", "row")).alias("kept"), "digest")
    return answer.join(collided, "digest", "left_anti").unionByName(split)


def op9(spark, folder: str) -> DataFrame:
    found = exact_duplicates(spark, f"{folder}/documents.parquet")
    return found.select("doc_id", "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256"))


OP9_SQL = """
select doc_id, max(doc_id) over w as keep_id, count(*) over w as group_size, doc_id = max(doc_id) over w as kept, sha256(t) as text_sha256
from (select doc_id, translate(coalesce(text,''),'ABCDEFGHIJKLMNOPQRSTUVWXYZ','abcdefghijklmnopqrstuvwxyz') as t from documents)
window w as (partition by t)
"""
