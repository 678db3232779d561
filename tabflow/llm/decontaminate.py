"""Benchmark decontamination: a broadcast hash set of the benchmark's word n-grams.

Benchmark texts are normalised to words and cut into windows of ``size`` words (a shorter
item is one window). The windows are broadcast in blocks whose text is at most
``block_chars`` characters: a benchmark of any size is handled, one block after another, each
with its hits written before the next is read, so one bounded broadcast is alive at a time. A training text is turned into benchmark word numbers, its
windows are hashed where all their words occur in the benchmark, looked up in the sorted
hashes, and each hit is verified word for word.

Defined cases: null and empty texts have no words and no hits; an item without words is
never found; items that share an id are one item, a null id is written as the empty text;
repeated documents are judged one by one; an empty benchmark hits nothing; extra columns
pass through and input columns named like an output are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabflow.llm.common import packed, table, unpacked
from tabflow.scratch import materialize

WINDOW = 10
BLOCK_CHARS = 8_000_000
# Word bytes are digits, lower-case letters and everything outside ASCII; the rest separates.
_WORD_BYTES = bytes((b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32) for b in range(256))
_MIX = np.uint64(0x9E3779B97F4A7C15)
_KEPT_OUTPUTS = ["n_words", "n_hit", "n_items", "items_sha256", "contaminated", "item_ids", "spans"]


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_WORD_BYTES).split()


@dataclass(frozen=True)
class Windows:
    """All distinct windows of one length, sorted by hash."""

    length: int
    hashes: np.ndarray
    words: np.ndarray  # (windows, length) word numbers
    items: tuple[tuple[str, ...], ...]


@dataclass(frozen=True)
class BenchmarkIndex:
    vocabulary: dict[bytes, int]  # numbers from 1; 0 is "not in the benchmark"
    windows: tuple[Windows, ...]


def _hash(columns: list[np.ndarray]) -> np.ndarray:
    h = np.zeros(len(columns[0]), dtype=np.uint64)
    for c in columns:
        h = (h ^ c.astype(np.uint64)) * _MIX
        h ^= h >> np.uint64(29)
    return h


def build_index(items: list[tuple[str, str | None]], size: int = WINDOW) -> BenchmarkIndex:
    vocabulary: dict[bytes, int] = {}
    found: dict[int, dict[tuple[int, ...], set[str]]] = {}
    for name, text in items:
        ids = [vocabulary.setdefault(w, len(vocabulary) + 1) for w in words_of(text)]
        n = min(size, len(ids))
        for i in range(len(ids) - n + 1 if n else 0):
            found.setdefault(n, {}).setdefault(tuple(ids[i:i + n]), set()).add(name)
    windows = []
    for n, by_window in sorted(found.items()):
        matrix = np.array(list(by_window), dtype=np.int64).reshape(-1, n)
        hashes = _hash([matrix[:, j] for j in range(n)])
        order = np.argsort(hashes, kind="stable")
        names = [tuple(sorted(s)) for s in by_window.values()]
        windows.append(Windows(n, hashes[order], matrix[order], tuple(names[i] for i in order)))
    return BenchmarkIndex(vocabulary, tuple(windows))


def find(index: BenchmarkIndex, words: list[bytes]) -> tuple[np.ndarray, set[str]]:
    """(whether each word is inside an occurring window, ids of the items found)."""
    hit = np.zeros(len(words) + 1, dtype=np.int32)
    names: set[str] = set()
    ids = np.fromiter(map(index.vocabulary.get, words, repeat(0)), dtype=np.int64, count=len(words))
    known = np.concatenate([[0], np.cumsum(ids > 0)])
    for w in index.windows:
        n = w.length
        if len(ids) < n:
            continue
        at = np.flatnonzero(known[n:] - known[:-n] == n)
        if not len(at):
            continue
        hashes = _hash([ids[at + j] for j in range(n)])
        # windows with equal hashes stand side by side; each of them is compared in full
        low, high = np.searchsorted(w.hashes, hashes, "left"), np.searchsorted(w.hashes, hashes, "right")
        for p, a, b in zip(at[high > low], low[high > low], high[high > low]):
            for k in range(a, b):
                if np.array_equal(w.words[k], ids[p:p + n]):
                    hit[p] += 1
                    hit[p + n] -= 1
                    names.update(w.items[k])
    return np.cumsum(hit[:-1]) > 0, names


def _benchmark_items(benchmark: DataFrame, item_id: str, text: str, block_chars: int) -> tuple[DataFrame, int]:
    """Benchmark items (item, text), and into how many blocks of bounded text they go."""
    items = benchmark.select(F.coalesce(F.col(f"`{item_id}`").cast("string"), F.lit("")).alias("item"), F.col(f"`{text}`").alias("text")).filter(F.col("text").isNotNull())
    n_chars = items.agg(F.sum(F.length("text"))).first()[0] or 0
    n = int(n_chars // block_chars) + 1
    # blocks of half the bound on average leave room for uneven hashing
    return items, 1 if n == 1 else 2 * n


def _scan_by_block(own: DataFrame, items: DataFrame, n_blocks: int, text: str, size: int) -> DataFrame:
    """``own`` with ``_found`` from all blocks. One block's index is alive at a time: what it hits is
    written (a row's number, ranges, items) before the next is read, and the hits are merged at the end."""
    sc = own.sparkSession.sparkContext
    rows = materialize(own.withColumn("_n", F.monotonically_increasing_id()), "scan-rows")
    hits = None
    for k in range(n_blocks):
        block = [tuple(r) for r in items.filter(F.pmod(F.xxhash64("item", "text"), F.lit(n_blocks)) == k).collect()]
        index = sc.broadcast(build_index(block, size))
        part = rows.select("_n", _scan_block(index)(F.col(f"_row.`{text}`")).alias("f")).filter("size(f.items) > 0")
        part = materialize(part.select("_n", "f.starts", "f.ends", "f.items"), "scan-hits")
        index.destroy()
        hits = part if hits is None else hits.unionByName(part)
    # a row for each block at most
    merged = hits.groupBy("_n").agg(*[F.flatten(F.collect_list(c)).alias(c) for c in ("starts", "ends", "items")])

    @F.pandas_udf("n_words long, starts array<int>, ends array<int>, items array<string>")
    def together(texts: pd.Series, starts: pd.Series, ends: pd.Series, names: pd.Series) -> pd.DataFrame:
        out = []
        for t, s, e, own_items in zip(texts, starts, ends, names):
            hit = np.zeros(len(words_of(t)), dtype=bool)
            for a, b in zip(s if s is not None else [], e if e is not None else []):
                hit[a:b] = True
            out.append(_row_of(hit, set(own_items) if own_items is not None else set()))
        return pd.DataFrame(out, columns=["n_words", "starts", "ends", "items"])

    return rows.join(merged, "_n", "left").select("_row", together(F.col(f"_row.`{text}`"), "starts", "ends", "items").alias("_found"))


def _row_of(hit: np.ndarray, names: set[str]) -> tuple:
    edge = np.flatnonzero(np.diff(np.concatenate([[0], hit.astype(np.int8), [0]])))
    return len(hit), edge[::2].astype(np.int32), edge[1::2].astype(np.int32), sorted(names)


def scan(docs: DataFrame, benchmark: DataFrame, *, text: str = "text", item_id: str = "item_id", item_text: str = "text", size: int = WINDOW, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """``docs`` with n_words, n_hit, ``spans`` (word ranges [start, end) that are hit) and sorted ``item_ids``."""
    spark, own = docs.sparkSession, packed(docs)
    items, n_blocks = _benchmark_items(benchmark, item_id, item_text, block_chars)
    if n_blocks == 1:
        index = spark.sparkContext.broadcast(build_index([tuple(r) for r in items.collect()], size))
        found = own.withColumn("_found", _scan_block(index)(F.col(f"_row.`{text}`")))
    else:
        found = _scan_by_block(own, items, n_blocks, text, size)
    return found.select(
        *unpacked(docs.columns, _KEPT_OUTPUTS), F.col("_found.n_words").alias("n_words"),
        F.expr("aggregate(zip_with(_found.starts, _found.ends, (s, e) -> e - s), 0L, (a, x) -> a + x)").alias("n_hit"),
        F.arrays_zip(F.col("_found.starts").alias("start"), F.col("_found.ends").alias("end")).alias("spans"), F.col("_found.items").alias("item_ids"),
    )


def _scan_block(index):
    @F.pandas_udf("n_words long, starts array<int>, ends array<int>, items array<string>")
    def scan_texts(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            rows = [_row_of(*find(index.value, words_of(text))) for text in texts]
            yield pd.DataFrame(rows, columns=["n_words", "starts", "ends", "items"])

    return scan_texts


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, *, text: str = "text", **options) -> DataFrame:
    """Documents without a hit, with their own columns only."""
    return scan(packed(docs, text), benchmark, text=f"_{text}", **options).filter("n_hit = 0").select("_row.*")


def cut_spans(docs: DataFrame, benchmark: DataFrame, *, text: str = "text", **options) -> DataFrame:
    """Every document, with hit word ranges (and what separates their words) cut out of the text."""
    found = scan(packed(docs, text), benchmark, text=f"_{text}", **options)

    @F.pandas_udf("string")
    def cut(texts: pd.Series, spans: pd.Series) -> pd.Series:
        return pd.Series([_cut(t, s) for t, s in zip(texts, spans)], dtype=object)

    own = F.col(f"_row.`{text}`")
    new = F.when(F.size("spans") > 0, cut(own, F.col("spans"))).otherwise(own)
    return found.select(*[new.alias(c) if c == text else F.col(f"_row.`{c}`").alias(c) for c in docs.columns])


def _cut(text: str | None, spans) -> str | None:
    if text is None or spans is None or not len(spans):
        return text
    raw = text.encode("utf-8", "surrogatepass")
    inside = np.frombuffer(raw.translate(_WORD_BYTES), dtype=np.uint8) != 32
    edge = np.flatnonzero(np.diff(np.concatenate([[0], inside.astype(np.int8), [0]])))
    starts, ends = edge[::2], edge[1::2]
    out, at = [], 0
    for s in spans:
        out.append(raw[at:starts[s["start"]]])
        at = ends[s["end"] - 1]
    return b"".join([*out, raw[at:]]).decode("utf-8", "surrogatepass")


def items_digest(items: Column) -> Column:
    return F.sha2(F.concat_ws(",", items).cast("binary"), 256)


def op5(spark, folder: str) -> DataFrame:
    found = scan(table(spark, folder, "documents").select("doc_id", "text"), table(spark, folder, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), items_digest(F.col("item_ids")).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


OP5_SQL = r"""
with w as (select doc_id, row_number() over () as r, regexp_extract_all(translate(coalesce(text,''),'ABCDEFGHIJKLMNOPQRSTUVWXYZ','abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as ws from documents),
b as (select distinct cast(item_id as varchar) as item, regexp_extract_all(translate(text,'ABCDEFGHIJKLMNOPQRSTUVWXYZ','abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as ws from benchmark where text is not null),
bw as (select distinct item, n, array_to_string(ws[i:i+n-1],' ') as win from (select item, ws, least(10,len(ws)) as n, unnest(generate_series(1, len(ws)-least(10,len(ws))+1)) as i from b where len(ws)>0)),
dw as (select r, n, i, array_to_string(ws[i:i+n-1],' ') as win from (select r, ws, n, unnest(generate_series(1, len(ws)-n+1)) as i from w, (select distinct n from bw) where len(ws)>=n)),
h as (select distinct r, n, i, item from dw join bw using (n, win)),
hw as (select r, count(distinct p) as n_hit from (select r, unnest(generate_series(i, i+n-1)) as p from (select distinct r, n, i from h)) group by r),
hi as (select r, count(distinct item) as n_items, string_agg(distinct item, ',' order by item) as items from h group by r)
select doc_id, cast(len(ws) as bigint) as n_words, cast(coalesce(n_hit,0) as bigint) as n_hit, cast(coalesce(n_items,0) as bigint) as n_items, sha256(coalesce(items,'')) as items_sha256, coalesce(n_hit,0)>0 as contaminated
from w left join hw using (r) left join hi using (r)
"""
