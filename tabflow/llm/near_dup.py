"""Near-duplicates by exact Jaccard similarity of word shingles, without a missed pair.

Two texts are linked if the sets of their ``shingle``-word shingles have a Jaccard similarity of
at least ``MIN_SIMILARITY``. Candidates come from SimHash first: fingerprints of the shingles that differ in
at most three bits meet by the one-wildcard segments of ``simhash``, and the sets of a component of such
fingerprints are a run. Those are few of the pairs at that similarity, so prefixes give the rest: with the shingles of every set in one
common order, two sets that similar share one among the first n - ceil(0.8 n) + 1 of each, so
only those are indexed. Any order finds every pair; frequent shingles, counted on a sample, come
last, which keeps the runs of texts with an equal shingle short. Sizes and places in the order
rule out most pairs of a run, counts of the shingles by hash cell (whose differences bound the
sets' difference from below) most others, and what is left is verified on the words themselves.

A group of n copies has n^2 pairs, all within one component. The texts of a run are therefore
first compared with its ``LEADERS`` only; then pairs are formed between components, which
leaves out no pair that could still join two of them. Only runs with several components are
compared again, and there the counts by cell rule pairs out before any is written.

Defined cases: words are those of ``simhash``; fewer than ``shingle`` words make one shingle;
null, empty and white texts are equal to each other; repeated rows fall into one component.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabflow.llm import simhash
from tabflow.llm.common import bounded_broadcast
from tabflow.llm.components import star_labels
from tabflow.llm.simhash import _LOWER, keep_least, text_digest
from tabflow.scratch import materialize, scope

SHINGLE = 5
MIN_SIMILARITY = (4, 5)
LEADERS = 3
# Frequencies only set the order: a sample of one text in SAMPLE, all of up to SAMPLE_ROWS texts, and the FREQUENT most frequent shingles.
SAMPLE = 16
SAMPLE_ROWS = 20_000
FREQUENT = 500_000
BROADCAST_NODES = 500_000
_PAIRS_AT_ONCE = 1 << 18
_HASHES_AT_ONCE = 200_000
_CELLS_AT_ONCE = 1 << 15
CELLS = 128


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()


def shingles(words: list[bytes], shingle: int = SHINGLE) -> set[bytes]:
    return {b" ".join(words[i:i + shingle]) for i in range(max(1, len(words) - shingle + 1))} if words else set()


def similar(a: set, b: set) -> bool:
    p, q = MIN_SIMILARITY
    common = len(a & b)
    return common * q >= p * (len(a) + len(b) - common)


def shingle_hashes(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """One hash for every distinct shingle, in order of the hashes; equal hashes of two shingles are both kept."""
    found = shingles(words_of(text), shingle)
    return np.sort(np.fromiter(map(xxhash.xxh64_intdigest, found), dtype=np.uint64, count=len(found))).view(np.int64)


def _frequent(texts: DataFrame, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes in order, their counts) of shingles that occur in more than one text of the sample."""
    n = texts.count()
    sample = texts if n <= SAMPLE_ROWS else texts.filter(F.pmod(F.xxhash64("text", F.lit("sample")), F.lit(max(1, min(SAMPLE, n // SAMPLE_ROWS)))) == 0)

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text in batch.column(0):
                yield pa.RecordBatch.from_arrays([pa.array(shingle_hashes(text.as_py(), shingle))], names=["h"])

    counts = sample.select("text").distinct().mapInArrow(hashes, "h long").groupBy("h").agg(F.count("*").alias("n")).filter("n > 1")
    found = counts.orderBy(F.desc("n"), "h").limit(FREQUENT).toArrow()
    h, n = found.column("h").to_numpy(), found.column("n").to_numpy()
    order = np.argsort(h)
    return h[order], n[order]


def _prefixes(rows: DataFrame, frequent: tuple[np.ndarray, np.ndarray], shingle: int) -> DataFrame:
    """(doc_id, _digest, sig, size, cells, prefix, fingerprint): 128 bits of the set, its size, its shingles counted by cell, the first ones in the common order, and its SimHash."""
    shared = rows.sparkSession.sparkContext.broadcast(frequent)
    p, q = MIN_SIMILARITY

    @F.pandas_udf("sig binary, size long, cells binary, prefix array<long>, fingerprint long")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        known, counts = shared.value
        for texts in batches:
            out = []
            for text in texts:
                found = sorted(shingles(words_of(text), shingle))
                h = np.sort(np.fromiter(map(xxhash.xxh64_intdigest, found), dtype=np.uint64, count=len(found))).view(np.int64)
                weight = np.zeros(len(h), dtype=np.int64)
                if len(known):
                    at = np.minimum(np.searchsorted(known, h), len(known) - 1)
                    weight = np.where(known[at] == h, counts[at], 0)
                n = len(h)
                first = h[np.lexsort((h, weight))][:n - -(-p * n // q) + 1]
                cells = np.minimum(np.bincount(h.view(np.uint64) % np.uint64(CELLS), minlength=CELLS), 255).astype(np.uint8)
                out.append((xxhash.xxh128_digest(b"\n".join(found)), n, cells.tobytes(), first, _fingerprint(h)))
            yield pd.DataFrame(out, columns=["sig", "size", "cells", "prefix", "fingerprint"])

    return rows.withColumn("_f", of(F.col("text"))).select("doc_id", "_digest", "_f.sig", "_f.size", "_f.cells", "_f.prefix", "_f.fingerprint")


def _fingerprint(h: np.ndarray) -> int:
    """64 bits; a bit is one if it is set in over half of the hashes of a set's shingles."""
    bits = sum((simhash._bit_counts(h[at:at + _HASHES_AT_ONCE].view(np.uint64)) for at in range(0, len(h), _HASHES_AT_ONCE)), np.zeros(64, dtype=np.int64))
    return int(np.packbits(2 * bits > len(h)).view(">u8")[0].astype(np.uint64).view(np.int64))


def _fingerprint_links(sets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Distinct fingerprints (fingerprint, least node, n), and links (a, b) of those that differ in up to three bits, which keep their components."""
    prints = materialize(sets.groupBy("fingerprint").agg(F.min("node").alias("least"), F.count("*").alias("n")), "near-prints")
    return prints, materialize(simhash.links(prints.select("fingerprint")), "near-print-links")


def _fingerprint_pairs(sets: DataFrame, prints: DataFrame, close: DataFrame) -> DataFrame:
    """Pairs (a, b) of sets whose fingerprints differ in up to three bits, as stars: at most two pairs a set or fingerprint."""
    equal = sets.select("fingerprint", "node").join(prints.filter("n > 1"), "fingerprint").select(F.col("least").alias("a"), F.col("node").alias("b"))
    first = lambda c: prints.select(F.col("fingerprint").alias(c), F.col("least").alias(f"_{c}"))
    close = close.join(first("a"), "a").join(first("b"), "b").select(F.least("_a", "_b").alias("a"), F.greatest("_a", "_b").alias("b"))
    return equal.unionByName(close).filter("a <> b")


def _fingerprint_runs(sets: DataFrame, prints: DataFrame, close: DataFrame) -> DataFrame:
    """Runs (key, node, size, at) of the sets whose fingerprints are in one component.

    A star may join two sets that are not similar where others of its component are: as runs
    they are compared like those of a shingle, so that no similar pair of a component is left out.
    """
    runs = prints.join(star_labels(close), F.col("fingerprint") == F.col("node"), "left").filter("n > 1 or root is not null")
    runs = runs.select("fingerprint", F.coalesce("root", "fingerprint").alias("key"))
    return materialize(sets.select("fingerprint", "node", "size").join(runs, "fingerprint").select("key", "node", "size", F.lit(0).cast("long").alias("at")), "near-print-runs")


def _possible(size_a, at_a, size_b, at_b) -> np.ndarray:
    """Whether two sets whose first common shingle stands at these places can be similar."""
    p, q = MIN_SIMILARITY
    need = -(-p * (size_a + size_b) // (p + q))
    return np.minimum(size_a - at_a, size_b - at_b) >= need


def _run_pairs(node, size, at, root) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of the possible pairs of one run: with its leaders if there is no ``root`` yet, else between roots."""
    if root is None:
        lead = np.lexsort((node, at))[:LEADERS]
    else:
        names, which, n = np.unique(root, return_inverse=True, return_counts=True)
        if len(names) == 1:
            return
        # texts of the largest component need no turn of their own: each other text meets them
        lead = np.flatnonzero(which != n.argmax())
    turn = np.full(len(node), len(node))
    turn[lead] = np.arange(len(lead))
    step = max(1, _PAIRS_AT_ONCE // len(node))
    for k in range(0, len(lead), step):
        own = lead[k:k + step]
        ok = _possible(size[own, None], at[own, None], size[None], at[None]) & (turn[None] > turn[own, None])
        if root is not None:
            ok &= root[own, None] != root[None]
        i, j = np.nonzero(ok)
        if len(i):
            yield own[i], j


def _whole_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(numbers, edges) of a stream sorted by its first column: runs of equal keys, none of them cut.

    ``numbers`` has a row for each column of longs; a binary column follows as ``CELLS`` // 8 rows of words.
    """
    held = None

    def ended(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return rows, np.flatnonzero(np.concatenate([[True], rows[0, 1:] != rows[0, :-1], [True]]))

    for batch in batches:
        if not batch.num_rows:
            continue
        parts = [c.to_numpy()[None] if c.type == pa.int64() else np.frombuffer(b"".join(c.to_pylist()), dtype=np.int64).reshape(-1, CELLS // 8).T for c in batch.columns]
        now = np.concatenate(parts)
        held = now if held is None else np.concatenate([held, now], axis=1)
        last = int(np.searchsorted(held[0], held[0, -1], "left"))
        if last:
            yield ended(held[:, :last])
            held = held[:, last:]
    if held is not None:
        yield ended(held)


def _open_runs(index: DataFrame) -> DataFrame:
    """The rows of ``index`` (key, node, size, at, root) whose key occurs in more than one component."""
    schema = pa.schema([(c, pa.int64()) for c in ("key", "node", "size", "at", "root")])

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, edge in _whole_runs(batches):
            root, n = rows[4], np.diff(edge)
            several = np.minimum.reduceat(root, edge[:-1]) != np.maximum.reduceat(root, edge[:-1])
            found = rows[:, np.repeat(several, n)]
            if found.shape[1]:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in found], schema=schema)

    return index.select(*schema.names).repartition("key").sortWithinPartitions("key").mapInArrow(keep, "key long, node long, size long, at long, root long")


def _near_cells(x: np.ndarray, y: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Whether sets with these counts by cell may be similar: two sets differ in at least as many shingles as their counts."""
    p, q = MIN_SIMILARITY
    return np.abs(x.astype(np.int16) - y).sum(axis=1, dtype=np.int64) * (p + q) <= (q - p) * sizes


def _pairs(index: DataFrame, rooted: bool) -> DataFrame:
    """Distinct possible pairs (a, b) of ``index`` (key, node, size, at[, root, cells]); with ``cells`` the counts rule pairs out where they are formed."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, edge in _whole_runs(batches):
            yield from ended(rows, edge)

    def ended(rows: np.ndarray, edge: np.ndarray) -> Iterator[pa.RecordBatch]:
        left, right, n = [], [], 0
        for k in np.flatnonzero(np.diff(edge) > 1):
            _, node, size, at, *more = rows[:, edge[k]:edge[k + 1]]
            cells = np.ascontiguousarray(np.array(more[1:]).T).view(np.uint8) if more else None
            for i, j in _run_pairs(node, size, at, more[0] if more else None):
                if cells is not None:
                    parts = [slice(s, s + _CELLS_AT_ONCE) for s in range(0, len(i), _CELLS_AT_ONCE)]
                    near = np.concatenate([_near_cells(cells[i[p]], cells[j[p]], size[i[p]] + size[j[p]]) for p in parts])
                    i, j = i[near], j[near]
                a, b = np.minimum(node[i], node[j]), np.maximum(node[i], node[j])
                left.append(a)
                right.append(b)
                n += len(a)
                if n >= _PAIRS_AT_ONCE:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(left)), pa.array(np.concatenate(right))], schema=schema)
                    left, right, n = [], [], 0
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(left)), pa.array(np.concatenate(right))], schema=schema)

    columns = ["key", "node", "size", "at", *(["root", "cells"] if rooted else [])]
    return index.select(*columns).repartition("key").sortWithinPartitions("key").mapInArrow(compare, "a long, b long").distinct()


def _not_ruled_out(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """``pairs`` without those whose counts by cell differ too much: two sets differ in at least as many shingles."""
    @F.pandas_udf("boolean")
    def possible(a: pd.Series, b: pd.Series, sizes: pd.Series) -> pd.Series:
        x, y = (np.frombuffer(b"".join(v), dtype=np.uint8).reshape(-1, CELLS) for v in (a, b))
        return pd.Series(_near_cells(x, y, sizes.to_numpy()))

    side = lambda c: sets.select(F.col("node").alias(c), F.col("cells").alias(f"_{c}"), F.col("size").alias(f"n{c}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    return both.filter(possible("_a", "_b", F.col("na") + F.col("nb"))).select("a", "b")


def _verified(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, shingle: int) -> DataFrame:
    """The pairs that are similar, compared word for word. ``docs`` has doc_id, _digest and text."""
    pairs = materialize(_not_ruled_out(materialize(pairs, "near-possible"), nodes), "near-pairs")
    needed = materialize(nodes.join(pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct(), "node").select("node", F.col("doc_id").alias("_id"), F.col("_digest").alias("_d")), "near-needed")
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_digest") == F.col("_d"))
    texts = materialize(docs.join(bounded_broadcast(needed, BROADCAST_NODES), same).groupBy("node").agg(F.first("text").alias("text")), "near-texts")

    @F.pandas_udf("boolean")
    def holds(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([similar(shingles(words_of(x), shingle), shingles(words_of(y), shingle)) for x, y in zip(a, b)], dtype=bool)

    both = pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("_a")), "a").join(texts.select(F.col("node").alias("b"), F.col("text").alias("_b")), "b")
    return materialize(both.filter(holds("_a", "_b")).select("a", "b"), "near-links")


def components(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, _digest, root) of every row; rows are in one component if links of similar texts join them."""
    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), text_digest(text).alias("_digest"), F.col(f"`{text}`").alias("text"))
    own = materialize(_prefixes(rows, _frequent(rows.select("text"), shingle), shingle), "near-rows")
    # a set is known by 128 bits; its number is given once, before the table is written
    sets = own.groupBy("sig").agg(F.min(F.struct("doc_id", "_digest")).alias("row"), F.first("size").alias("size"), F.first("cells").alias("cells"), F.first("prefix").alias("prefix"), F.first("fingerprint").alias("fingerprint"))
    sets = materialize(sets.select(F.monotonically_increasing_id().alias("node"), "sig", "row.doc_id", "row._digest", "size", "cells", "prefix", "fingerprint"), "near-sets")
    index = sets.select("node", "size", F.posexplode("prefix").alias("at", "key")).select("key", "node", "size", F.col("at").cast("long").alias("at"))
    prints = _fingerprint_links(sets)
    index = index.unionByName(_fingerprint_runs(sets, *prints))
    names = sets.select("node", "doc_id", "_digest", "size", "cells")
    links = _verified(_fingerprint_pairs(sets, *prints).unionByName(_pairs(index, False)).distinct(), names, rows, shingle)
    roots = star_labels(links)
    labels = sets.join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("root"))
    labels = materialize(labels, "near-labels")
    open_ = materialize(_open_runs(index.join(bounded_broadcast(labels, BROADCAST_NODES), "node")), "near-open")
    rest = _verified(_pairs(open_.join(sets.select("node", "cells"), "node"), True), names, rows, shingle)
    roots = star_labels(links.unionByName(rest))
    rooted = sets.join(roots, "node", "left").select("sig", F.coalesce("root", "node").alias("root"))
    return own.select("doc_id", "_digest", "sig").join(rooted, "sig").select("doc_id", "_digest", "root")


def keep_one(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """``docs`` with one row of each component, chosen as by ``simhash.keep_one``."""
    with scope(docs.sparkSession):
        found = materialize(components(docs, doc_id=doc_id, text=text, **options), "near-found", outlive=True)
    return keep_least(docs, found, doc_id=doc_id, text=text)
