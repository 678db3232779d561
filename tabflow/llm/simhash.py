"""SimHash near-duplicates by deletion variants of two 32-bit segments.

Fingerprints that differ in at most three bits agree, in one of their two halves, up to one
bit. Each half is therefore indexed with one bit wiped out, for every bit in turn: two halves
that differ in at most one bit share such a variant, whatever the rest. Equal variants meet
in one sorted run, where the whole fingerprints are compared.

Only distinct fingerprints are indexed, so exact copies cost one aggregated row. A run of up
to ``run_limit`` fingerprints is compared where it is; a longer one is written out in blocks
and each pair of blocks is compared by a task of its own, so that no run of any size has to
fit one task. From every comparison leaves a spanning star, never all pairs.

Defined cases: a null or empty text, or one of white space, has the fingerprint zero and is
linked like any other; fewer than ``shingle`` words make one shingle; repeated rows and ties
fall into one component; a null id never is the component's id unless all its ids are null.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabflow.llm.common import table, without
from tabflow.llm.components import star_labels
from tabflow.scratch import materialize

SHINGLE = 3
MAX_BITS = 3
SEED = 42
RUN_LIMIT = 16_384
# Runs up to this length are compared for all keys of a batch at once.
SHORT_RUN = 16
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
# bytes.split() knows exactly the six separators of the contract
_WORDS_AT_ONCE = 200_000


def _bit_counts(hashes: list[int]) -> np.ndarray:
    raw = np.array(hashes, dtype=">u8").view(np.uint8).reshape(-1, 8)
    return np.unpackbits(raw, axis=1).sum(axis=0, dtype=np.int64)


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """64 bits; a bit is one if it is set in over half of the shingles' hashes, repeats included."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    digest, total = xxhash.xxh64_intdigest, np.zeros(64, dtype=np.int64)
    for at in range(0, n, _WORDS_AT_ONCE):
        part = words[at:at + _WORDS_AT_ONCE + shingle - 1]
        joined = b" ".join(part)
        ends = np.cumsum(np.fromiter(map(len, part), dtype=np.int64, count=len(part)) + 1)
        k = max(1, len(part) - shingle + 1)
        starts = np.concatenate([[0], ends[:-1]])[:k].tolist()
        stops = (ends[min(shingle, len(part)) - 1:][:k] - 1).tolist()
        total += _bit_counts([digest(joined[i:j], SEED) for i, j in zip(starts, stops)])
    return int.from_bytes(np.packbits(2 * total > n).tobytes(), "big")


def fingerprints(docs: DataFrame, *, text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """``docs`` with its 64-bit ``fingerprint`` as a signed long."""

    @F.pandas_udf("long")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(np.array([fingerprint(t, shingle) for t in texts], dtype=np.uint64).view(np.int64))

    return without(docs, ["fingerprint"]).withColumn("fingerprint", of(F.col(text)))


def variants(distinct: DataFrame) -> DataFrame:
    """(key, fingerprint): both halves with each of their bits wiped out, 64 rows a fingerprint."""
    half = F.when(F.col("i") < 32, F.shiftrightunsigned("fingerprint", 32)).otherwise(F.col("fingerprint").bitwiseAND(F.lit(0xFFFFFFFF)))
    wiped = half.bitwiseAND(F.expr("~shiftleft(1L, i % 32)"))
    rows = distinct.select("fingerprint", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("i"))
    return rows.select((F.expr("shiftleft(cast(i as long), 32)").bitwiseOR(wiped)).alias("key"), "fingerprint")


def _stars(fp: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links a-b among ``fp`` as (fingerprint, least fingerprint of its component here)."""
    nodes, at = np.unique(np.concatenate([fp[a], fp[b]]), return_inverse=True)
    x, y, label = at[:len(a)], at[len(a):], np.arange(len(nodes))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, label[x], low)
        np.minimum.at(new, label[y], low)
        new = new[new]
        if np.array_equal(new, label):
            break
        label = new
    off = label != np.arange(len(nodes))
    return nodes[off], nodes[label[off]]


def _close(x: np.ndarray, y: np.ndarray, max_bits: int) -> np.ndarray:
    return np.bitwise_count(x ^ y) <= max_bits


def _run_stars(fp: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Star links of the components within one run, found breadth first.

    What is reached leaves the rest at once, so a dense cluster takes a few comparisons of
    everything and a run without links compares each pair once.
    """
    left, right, rest = [], [], fp
    while len(rest) > 1:
        seed, rest = rest[:1], rest[1:]
        front, reached = seed, []
        while len(front) and len(rest):
            strip, front = front[:max(1, (1 << 21) // len(rest))], front[max(1, (1 << 21) // len(rest)):]
            near = (np.bitwise_count(strip[:, None] ^ rest[None, :]) <= max_bits).any(axis=0)
            reached.append(rest[near])
            front, rest = np.concatenate([front, rest[near]]), rest[~near]
        got = np.concatenate(reached) if reached else rest[:0]
        left.append(got)
        right.append(np.repeat(seed, len(got)))
    return (np.concatenate(left), np.concatenate(right)) if left else (fp[:0], fp[:0])


def _runs(max_bits: int, run_limit: int):
    """Compare runs of equal keys in a stream sorted by key; longer runs leave in blocks."""
    schema = pa.schema([("key", pa.int64()), ("block", pa.int64()), ("a", pa.int64()), ("b", pa.int64())])

    def table_of(a, b, key=None, block=None):
        n = len(a)
        fill = lambda v: pa.nulls(n, pa.int64()) if v is None else pa.array(v)
        return pa.RecordBatch.from_arrays([fill(key), fill(block), pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], schema=schema)

    def links(key: np.ndarray, fp: np.ndarray):
        """Star links within the complete runs of ``key``."""
        edge = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1], [True]]))
        size = np.diff(edge)
        left, right = [], []
        for step in range(1, min(SHORT_RUN, int(size.max(initial=0)))):
            # short runs of all keys at once: each fingerprint against the one ``step`` further on
            at = np.flatnonzero((key[step:] == key[:-step]) & np.repeat(size <= SHORT_RUN, size)[:-step])
            at = at[_close(fp[at], fp[at + step], max_bits)]
            left.append(at)
            right.append(at + step)
        a, b = (np.concatenate(v) if v else np.zeros(0, np.int64) for v in (left, right))
        p, q = _stars(fp, a, b) if len(a) else (fp[:0], fp[:0])
        out = [(p, q)]
        for k in np.flatnonzero(size > SHORT_RUN):
            out.append(_run_stars(fp[edge[k]:edge[k + 1]], max_bits))
        return np.concatenate([o[0] for o in out]), np.concatenate([o[1] for o in out])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, fp = np.zeros(0, np.int64), np.zeros(0, np.uint64)
        flushed = 0  # blocks already written of the run that is open
        for batch in batches:
            if not batch.num_rows:
                continue
            key = np.concatenate([key, batch.column(0).to_numpy()])
            fp = np.concatenate([fp, batch.column(1).to_numpy().view(np.uint64)])
            last = int(np.searchsorted(key, key[-1], "left"))
            if flushed and last:  # the open long run has ended inside this batch
                yield table_of(fp[:(n := int(np.searchsorted(key, key[0], "right")))], fp[:n], key[:n], np.full(n, flushed))
                key, fp, last, flushed = key[n:], fp[n:], last - n, 0
            if last:
                whole_key, whole_fp, key, fp = key[:last], fp[:last], key[last:], fp[last:]
                yield from ended(whole_key, whole_fp)
            while len(key) > run_limit:
                yield table_of(fp[:run_limit], fp[:run_limit], key[:run_limit], np.full(run_limit, flushed))
                key, fp, flushed = key[run_limit:], fp[run_limit:], flushed + 1
        if len(key) and flushed:
            yield table_of(fp, fp, key, np.full(len(key), flushed))
        elif len(key):
            yield from ended(key, fp)

    def ended(key, fp):
        edge = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1], [True]]))
        for k in np.flatnonzero(np.diff(edge) > run_limit):
            run = slice(edge[k], edge[k + 1])
            yield table_of(fp[run], fp[run], key[run], np.arange(edge[k + 1] - edge[k]) // run_limit)
        light = np.repeat(np.diff(edge) <= run_limit, np.diff(edge))
        a, b = links(key[light], fp[light]) if light.any() else (fp[:0], fp[:0])
        if len(a):
            yield table_of(a, b)

    return compare


def links(distinct: DataFrame, *, max_bits: int = MAX_BITS, run_limit: int = RUN_LIMIT) -> DataFrame:
    """(a, b) links between distinct fingerprints that keep exactly the components of all pairs within ``max_bits``."""
    if max_bits > 3:
        raise ValueError("two segments with one wildcard find up to 3 differing bits")
    by_key = variants(distinct).repartition("key").sortWithinPartitions("key", "fingerprint")
    found = materialize(by_key.mapInArrow(_runs(max_bits, run_limit), "key long, block long, a long, b long"), "simhash-links")
    light, long_runs = found.filter("key is null").select("a", "b"), found.filter("key is not null")
    blocks = long_runs.groupBy("key").agg((F.max("block") + 1).alias("n_blocks"))
    # block i meets block j >= i in task (key, i, j); each fingerprint goes to every pair its block is in
    spread = long_runs.join(blocks, "key").select("key", "block", F.col("a").alias("fingerprint"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_blocks") - 1)).alias("other"))
    spread = spread.select("key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "fingerprint")

    def meet(group: pd.DataFrame) -> pd.DataFrame:
        a, b = _run_stars(group["fingerprint"].to_numpy().view(np.uint64), max_bits)
        return pd.DataFrame({"a": a.view(np.int64), "b": b.view(np.int64)})

    return light.unionByName(spread.groupBy("key", "i", "j").applyInPandas(meet, "a long, b long"))


def components(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE, max_bits: int = MAX_BITS, run_limit: int = RUN_LIMIT, keep: Sequence[str] = ()) -> DataFrame:
    """(doc_id, fingerprint, component_id, root) of every row and the columns ``keep``.

    The least doc_id reachable names the component; ``root`` is its least fingerprint.
    """
    own = fingerprints(docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"), *keep), shingle=shingle)
    own = materialize(own.select("doc_id", "fingerprint", *keep), "simhash")
    distinct = materialize(own.groupBy("fingerprint").agg(F.min("doc_id").alias("least")), "simhash-distinct")
    roots = star_labels(links(distinct.select("fingerprint"), max_bits=max_bits, run_limit=run_limit))
    rooted = distinct.join(roots, distinct["fingerprint"] == roots["node"], "left").select("fingerprint", "least", F.coalesce("root", "fingerprint").alias("root"))
    named = rooted.join(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("fingerprint", "component_id", "root")
    return own.join(named, "fingerprint").select("doc_id", "fingerprint", "component_id", "root", *keep)


def keep_one(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """``docs`` with one row of each component: the least id (null last), then the least text digest.

    Rows that repeat both become one.
    """
    own = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"), text_digest(text).alias("_digest"))
    found = components(own, keep=["_digest"], **options)
    return keep_least(docs, materialize(found, "simhash-rows"), doc_id=doc_id, text=text)


def text_digest(text: str) -> Column:
    return F.xxhash64(F.coalesce(F.col(f"`{text}`"), F.lit("")), F.col(f"`{text}`").isNull())


def keep_least(docs: DataFrame, found: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The row of ``docs`` that stays of each component in ``found`` (doc_id, _digest, root), a written table."""
    best = found.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "_digest")).alias("best"))
    stays = best.select(F.col("best.doc_id").alias("_id"), F.col("best._digest").alias("_d"))
    rows = found.join(stays, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_digest") == F.col("_d"))).groupBy("_id", "_d").agg(F.count("*").alias("_n"))
    rows = materialize(rows, "simhash-stays")
    own = docs.select(text_digest(text).alias("_text_digest"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))
    chosen = own.join(rows, F.col(f"_row.`{doc_id}`").eqNullSafe(F.col("_id")) & (F.col("_text_digest") == F.col("_d")))
    once = chosen.filter("_n = 1").select("_row")
    if not rows.filter("_n > 1").isEmpty():
        once = once.unionByName(chosen.filter("_n > 1").groupBy("_id", "_d").agg(F.first("_row").alias("_row")).select("_row"))
    return once.select("_row.*")


def op7(spark, folder: str) -> DataFrame:
    found = components(table(spark, folder, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")
