"""Repeated byte strings by a sparse suffix array, range-partitioned by sampled splitters.

Every string of ``match`` bytes that starts at two places is found, and all bytes such strings
cover are cut, judged on the input. A suffix per byte would multiply the input by its own
length, so suffixes start at content-defined anchors only: the minima of a hash over any
``window`` neighbouring positions. Two equal strings have equal minima, so they have an
anchor at the same offset, at most ``window - 1`` bytes from their start. An anchor's suffix
carries the ``window - 1`` bytes before it and ``match`` bytes from it on: its context. Each
string is then one offset of one context.

1. Every anchor sends a digest of its core, the bytes that all strings at it share, and of its
   whole context. Cores are summed map-side; a core that occurs once can't be repeated.
2. Cores all of whose contexts have one 128-bit digest are copies: all their strings repeat.
3. The other contexts, one or two of each per task, are range-partitioned by their leading
   bytes with splitters Spark samples, and sorted in each bucket by multikey quicksort, eight
   bytes at a time. Common prefixes of neighbours, forwards from the anchor and backwards
   before it, give for each offset the classes of equal strings.
4. A string may also start in another bucket, but only if its bytes from the anchor on are a
   prefix of the bucket's first or last context. Each bucket sends one row for every such
   string it holds, with its count: (offset, 128-bit digest). Counts are summed over the
   buckets, and only strings that were single in their bucket ask for the sum.

Keys of repeated cores are broadcast while they number at most ``broadcast_keys``; beyond
that they are joined to the anchors, and those to the texts, by shuffle. Both ways find the same.

Defined cases: a null text is empty; texts below ``match`` bytes keep everything; repeated
rows and exact copies lose everything from ``match`` bytes on; overlapping matches, also
within one text, count; a cut may split a character, so what is kept is binary; extra columns
pass through and input columns named like an output are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabflow.llm.common import packed, table, unpacked
from tabflow.scratch import materialize

MATCH = 400
WINDOW = 128
GRAM = 16
# At most 36 MB of keys (a long and a flag), and 500,000 texts with 4,000,000 ranges, some 50 MB.
BROADCAST_KEYS = 4_000_000
BROADCAST_TEXTS = 500_000
# Contexts a range bucket is to hold; one bucket is sorted in memory.
BUCKET_ROWS = 30_000
# Texts are hashed in stretches of this many bytes, with what neighbouring stretches share.
_STRETCH = 1 << 20


@dataclass(frozen=True)
class Shape:
    match: int = MATCH
    window: int = WINDOW
    gram: int = GRAM

    def __post_init__(self):
        if not (self.window >= 2 and self.window + self.gram <= self.match + 1):
            raise ValueError("a match must hold a whole window of anchors")

    @property
    def core(self) -> int:
        return self.match - self.window + 1


# ---------------------------------------------------------------- anchors of one text

def _mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = a * np.uint64(0xBF58476D1CE4E5B9) + b * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(31))


def _gram_hashes(raw: np.ndarray, gram: int) -> np.ndarray:
    """A 32-bit hash of the ``gram`` bytes from each position; ``gram`` is a power of two."""
    h, step = raw.astype(np.uint64), 1
    while step < gram:
        h, step = _mix(h[:-step], h[step:]), 2 * step
    return (h >> np.uint64(16)).astype(np.uint32)


def _slide(a: np.ndarray, w: int, op) -> np.ndarray:
    """op over every ``w`` neighbours: a running value forwards meets one backwards in each block."""
    n, edge = len(a), (np.iinfo(a.dtype).max if op is np.minimum else 0)
    blocks = np.concatenate([a, np.full(-n % w, edge, a.dtype)]).reshape(-1, w)
    ahead = op.accumulate(blocks, axis=1).ravel()
    back = op.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return op(back[:n - w + 1], ahead[w - 1:n])


def anchors(raw: bytes, shape: Shape) -> np.ndarray:
    """Positions whose hash is the least of some ``window`` positions around."""
    b, w = np.frombuffer(raw, dtype=np.uint8), shape.window
    n = len(b) - shape.gram + 1
    if len(b) < shape.match:
        return np.zeros(0, dtype=np.int64)
    out, quiet = [], np.zeros(w - 1, dtype=np.uint32)
    for start in range(0, n, _STRETCH):
        end = min(n, start + _STRETCH)
        low, high = max(0, start - w + 1), min(n - w, end - 1)  # first and last window that touch the stretch
        if high < low:
            continue
        h = _gram_hashes(b[low:high + w + shape.gram - 1], shape.gram)
        least = _slide(h, w, np.minimum)
        at = low + np.flatnonzero(_slide(np.concatenate([quiet, least, quiet]), w, np.maximum) == h)
        out.append(at[(at >= start) & (at < end)])
    found = np.concatenate(out)
    return found[found + shape.core <= len(b)]


def _digests(raw: bytes, at: list[int], shape: Shape) -> tuple[np.ndarray, np.ndarray]:
    digest, before = xxhash.xxh64_intdigest, shape.window - 1
    core = np.array([digest(raw[x:x + shape.core], 1) for x in at], dtype=np.uint64).view(np.int64)
    context = np.array([digest(raw[max(0, x - before):x + shape.match] + b"|%d" % min(x, before), 2) for x in at], dtype=np.uint64).view(np.int64)
    return core, context


def _bytes(text) -> bytes:
    return text.encode("utf-8", "surrogatepass") if isinstance(text, str) else b""


def _whole(x: np.ndarray, n: int, shape: Shape) -> tuple[np.ndarray, np.ndarray]:
    """What all strings at anchors ``x`` of a text of ``n`` bytes cover."""
    most = np.minimum(x, shape.window - 1)
    least = np.maximum(0, shape.match - (n - x))
    ok = least <= most
    return (x - most)[ok], (x - least + shape.match)[ok]


def merged(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of the union of byte ranges."""
    if not len(start):
        return start, end
    order = np.argsort(start, kind="stable")
    s, e = start[order], np.maximum.accumulate(end[order])
    new = np.concatenate([[True], s[1:] > e[:-1]])
    return s[new], e[np.concatenate([new[1:], [True]])]


# ---------------------------------------------------------------- a sorted bucket

def multikey_order(words: np.ndarray) -> np.ndarray:
    """Order of the rows of a (rows, words) matrix, most significant word first.

    Multikey quicksort with eight-byte keys, all open segments a level at a time: rows are
    parted by the next word, and only segments that still have equals go on.
    """
    order = np.argsort(words[:, 0], kind="stable")
    segment = np.concatenate([[0], np.cumsum(np.diff(words[order, 0]) != 0)]) if len(order) else np.zeros(0, np.int64)
    for c in range(1, words.shape[1]):
        size = np.bincount(segment) if len(segment) else segment
        open_ = np.flatnonzero(size[segment] > 1)
        if not len(open_):
            break
        word = words[order[open_], c]
        by = np.lexsort((word, segment[open_]))
        order[open_] = order[open_][by]
        word, seg = word[by], segment[open_]
        new = np.zeros(len(order), dtype=np.int64)
        new[open_[1:]] = (seg[1:] == seg[:-1]) & (word[1:] != word[:-1])
        segment = segment + np.cumsum(new)
    return order


def _matrix(texts: list[bytes], width: int) -> np.ndarray:
    """Rows of ``width`` bytes rounded up to whole words, filled with zeros."""
    width = -(-width // 8) * 8
    return np.frombuffer(b"".join(t.ljust(width, b"\0") for t in texts), dtype=np.uint8).reshape(len(texts), width)


def _common(matrix: np.ndarray, length: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Common prefix of each row with the one before it in ``order``; 0 for the first."""
    out = np.zeros(len(order), dtype=np.int64)
    for at in range(1, len(order), 4096):
        one, two = order[at - 1:at - 1 + len(order[at:at + 4096])], order[at:at + 4096]
        differ = matrix[one] != matrix[two]
        first = np.where(differ.any(axis=1), differ.argmax(axis=1), matrix.shape[1])
        out[at:at + 4096] = np.minimum(first, np.minimum(length[one], length[two]))
    return out


def repeated_offsets(left: list[bytes], right: list[bytes], n: np.ndarray, shape: Shape) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    """(repeated[context, offset], open strings) of one bucket.

    ``left`` are the bytes before each anchor, nearest first. An open string, (context, offset,
    count here), may occur in a neighbouring bucket too; each has one entry.
    """
    r, r_len = _matrix(right, shape.match), np.fromiter(map(len, right), dtype=np.int64, count=len(right))
    l, l_len = _matrix(left, shape.window - 1), np.fromiter(map(len, left), dtype=np.int64, count=len(left))
    # the length comes last: of equal padded rows, all of one length stand together
    r_order, l_order = (multikey_order(np.column_stack([m.view(">u8"), k.astype(">u8")])) for m, k in ((r, r_len), (l, l_len)))
    r_common, l_common = _common(r, r_len, r_order), _common(l, l_len, l_order)
    # common prefix of each context with the first and with the last one of the bucket
    reach = np.empty(len(right), np.int64)
    to_first = np.minimum.accumulate(np.concatenate([[shape.match], r_common[1:]]))
    to_last = np.minimum.accumulate(np.concatenate([[shape.match], r_common[:0:-1]]))[::-1]
    reach[r_order] = np.maximum(to_first, to_last)
    repeated = np.zeros((len(right), shape.window), dtype=bool)
    r_class, l_class = np.empty(len(right), np.int64), np.empty(len(right), np.int64)
    open_strings: list[tuple[int, int, int]] = []
    for d in range(shape.window):
        r_class[r_order] = np.cumsum(r_common < shape.match - d)
        l_class[l_order] = np.cumsum(l_common < d) if d else 0
        at = np.flatnonzero((r_len >= shape.match - d) & (l_len >= d))
        if len(at):
            _, first, which = np.unique(r_class[at] * (len(right) + 1) + l_class[at], return_index=True, return_inverse=True)
            count = np.bincount(which, weights=n[at])
            repeated[at, d] = count[which] > 1
            for k in np.flatnonzero(reach[at[first]] >= shape.match - d).tolist():
                open_strings.append((int(at[first[k]]), d, int(count[k])))
    return repeated, open_strings


def _ranges(flags: np.ndarray) -> tuple[list[int], list[int]]:
    edge = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return edge[::2].tolist(), (edge[1::2] - 1).tolist()


# ---------------------------------------------------------------- the distributed operator

_ANCHOR = "id_a long, id_b long, x int, core long, context long"
_NOMINATED = "id_a long, id_b long, starts array<int>, ends array<int>, x int, core long, context long, n int, left binary, right binary"


def _identified(docs: DataFrame, text: str) -> DataFrame:
    """(id_a, id_b, text): rows with equal texts have equal, 128-bit ids."""
    t = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    return docs.select(F.xxhash64(t).alias("id_a"), F.xxhash64(t, F.lit(1)).alias("id_b"), t.alias("text"))


def _text_anchors(texts: DataFrame, shape: Shape, digests_only: bool) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out, held = [], 0
            for k, text in enumerate(batch["text"]):
                raw = _bytes(text)
                at = anchors(raw, shape)
                if len(at):
                    core, context = _digests(raw, at.tolist(), shape)
                    part = {"core": core, "context": context}
                    if not digests_only:
                        part = {"id_a": batch["id_a"].iat[k], "id_b": batch["id_b"].iat[k], "x": at.astype(np.int32), **part}
                    out.append(pd.DataFrame(part))
                    held += len(at)
                if held > 200_000:
                    yield pd.concat(out)
                    out, held = [], 0
            if out:
                yield pd.concat(out)

    return (texts.select("text") if digests_only else texts).mapInPandas(run, "core long, context long" if digests_only else _ANCHOR)


def _nominate(shape: Shape):
    """Rows for one text and its anchors with repeated cores; see ``_NOMINATED``.

    A first row has what the copies among them cover, then one row per other anchor, with the
    context's bytes where this task has seen that context less than twice.
    """
    seen: dict[tuple[int, int], int] = {}
    told: set[tuple[int, int]] = set()

    def rows(id_a, id_b, raw: bytes, x, core, context, copies) -> list[tuple]:
        out, first = [], (id_a, id_b) not in told
        told.add((id_a, id_b))
        if first:
            s, e = merged(*_whole(x[copies], len(raw), shape))
            out.append((id_a, id_b, s.astype(np.int32), e.astype(np.int32), None, None, None, None, None, None))
        for at, k, h in zip(x[~copies].tolist(), core[~copies].tolist(), context[~copies].tolist()):
            times = seen[k, h] = seen.get((k, h), 0) + 1
            if first or times <= 2:
                left = raw[max(0, at - shape.window + 1):at][::-1] if times <= 2 else None
                right = raw[at:at + shape.match] if times <= 2 else None
                # a text met before adds to the count of its contexts, not to the places
                out.append((id_a if first else None, id_b if first else None, None, None, at, k, h, 1 if times <= 2 else 0, left, right))
        return out

    return rows


_WHOLE = ("id_a", "id_b", "x", "core", "context", "n")
_COLUMNS = ["id_a", "id_b", "starts", "ends", "x", "core", "context", "n", "left", "right"]


def _nominated_frame(rows: list[tuple]) -> pd.DataFrame:
    # whole numbers beside nulls must not pass through floating point
    columns = dict(zip(_COLUMNS, zip(*rows)))
    return pd.DataFrame({c: pd.array(list(v), dtype="Int64") if c in _WHOLE else pd.Series(list(v), dtype=object) for c, v in columns.items()})


def _nominated(texts: DataFrame, repeated: DataFrame, shape: Shape, broadcast_keys: int) -> DataFrame:
    """Nominated anchors of all texts, once their cores are known to repeat."""
    spark = texts.sparkSession
    if repeated.limit(broadcast_keys + 1).count() <= broadcast_keys:
        held = repeated.toArrow()  # at most ``broadcast_keys`` pairs of a long and a flag, in columns
        core, copied = (held.column(c).to_numpy(zero_copy_only=False) for c in ("core", "copies"))
        order = np.argsort(core)
        shared = spark.sparkContext.broadcast((core[order], copied.astype(bool)[order]))

        def look_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            keys, copies = shared.value
            nominate = _nominate(shape)
            for batch in batches:
                rows, held = [], 0
                for id_a, id_b, text in zip(batch["id_a"], batch["id_b"], batch["text"]):
                    raw = _bytes(text)
                    x = anchors(raw, shape)
                    if not len(x) or not len(keys):
                        continue
                    core = np.array([xxhash.xxh64_intdigest(raw[a:a + shape.core], 1) for a in x.tolist()], dtype=np.uint64).view(np.int64)
                    at = np.minimum(np.searchsorted(keys, core), len(keys) - 1)
                    x, core, at = (v[keys[at] == core] for v in (x, core, at))
                    if len(x):
                        rows += nominate(id_a, id_b, raw, x, core, _digests(raw, x.tolist(), shape)[1], copies[at])
                        held += len(x)
                    if held > 4_000:
                        yield _nominated_frame(rows)
                        rows, held = [], 0
                if rows:
                    yield _nominated_frame(rows)

        return texts.mapInPandas(look_up, _NOMINATED)

    found = _text_anchors(texts, shape, False).join(repeated, "core").groupBy("id_a", "id_b").agg(F.collect_set(F.struct("x", "core", "context", "copies")).alias("found"))

    def attach(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        nominate = _nominate(shape)
        for batch in batches:
            for id_a, id_b, text, found in zip(batch["id_a"], batch["id_b"], batch["text"], batch["found"]):
                x, core, context, copies = (np.array([f[c] for f in found]) for c in ("x", "core", "context", "copies"))
                order = np.argsort(x)
                if rows := nominate(id_a, id_b, _bytes(text), x[order].astype(np.int64), core[order], context[order], copies[order].astype(bool)):
                    yield _nominated_frame(rows)

    return texts.join(found, ["id_a", "id_b"]).mapInPandas(attach, _NOMINATED)


_JUDGED = "core long, context long, low array<int>, high array<int>, d int, a long, b long, n int"


def _bucket(shape: Shape):
    """Sort a range bucket and judge its contexts; its open strings follow as rows of their own."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = list(batches)
        rows = pd.concat(held, ignore_index=True) if held else pd.DataFrame()
        if not len(rows):
            return
        left, right = rows["left"].tolist(), rows["right"].tolist()
        repeated, open_strings = repeated_offsets(left, right, rows["n"].to_numpy(dtype=np.int64), shape)
        core, context = rows["core"].to_numpy(), rows["context"].to_numpy()
        some = np.flatnonzero(repeated.any(axis=1))
        ranges = [_ranges(repeated[k]) for k in some]
        empty = {"d": None, "a": None, "b": None, "n": None}
        for at in range(0, len(some), 50_000):
            part = slice(at, at + 50_000)
            yield pd.DataFrame({"core": core[some[part]], "context": context[some[part]], "low": [r[0] for r in ranges[part]], "high": [r[1] for r in ranges[part]], **empty})
        for at in range(0, len(open_strings), 50_000):
            k, d, n = (np.array(v) for v in zip(*open_strings[at:at + 50_000]))
            strings = [left[i][:j][::-1] + right[i][:shape.match - j] for i, j in zip(k.tolist(), d.tolist())]
            digest = lambda seed: np.array([xxhash.xxh64_intdigest(s, seed) for s in strings], dtype=np.uint64).view(np.int64)
            yield pd.DataFrame({"core": core[k], "context": context[k], "low": None, "high": None, "d": d, "a": digest(3), "b": digest(4), "n": np.minimum(n, 2)})

    return run


def _across(strings: DataFrame) -> DataFrame:
    """(core, context, low, high) of strings that are single in their bucket and occur in another one."""
    twice = strings.groupBy("d", "a", "b").agg(F.count("*").alias("k")).filter("k > 1").select("d", "a", "b")
    hit = strings.filter("n = 1").join(twice, ["d", "a", "b"], "left_semi")
    # at most ``window`` offsets a context
    return hit.groupBy("core", "context").agg(F.collect_set("d").alias("low")).select("core", "context", "low", F.col("low").alias("high"))


def repeats(docs: DataFrame, *, text: str = "text", shape: Shape = Shape(), broadcast_keys: int = BROADCAST_KEYS, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """(id_a, id_b, starts, ends): merged byte ranges of the texts that hold a repeated string."""
    texts = _identified(docs, text)
    cores = _text_anchors(texts, shape, True).groupBy("core").agg(F.count("*").alias("n"), F.min("context").alias("low"), F.max("context").alias("high"))
    repeated = materialize(cores.filter("n > 1").select("core", (F.col("low") == F.col("high")).alias("copies")), "suffix-cores")
    found = materialize(_nominated(texts, repeated, shape, broadcast_keys), "suffix-anchors")
    contexts = found.filter("right is not null").select("core", "context", "n", "left", "right")
    buckets = contexts.count() // bucket_rows + 1
    judged = materialize(
        contexts.repartitionByRange(buckets, "right", "left").mapInPandas(_bucket(shape), _JUDGED), "suffix-judged")
    offsets = judged.filter("d is null").select("core", "context", "low", "high").unionByName(_across(judged.filter("d is not null").select("core", "context", "d", "a", "b", "n")))
    # equal contexts meet in one bucket and have equal ranges there; another bucket may add offsets
    offsets = offsets.groupBy("core", "context").agg(F.collect_set(F.struct("low", "high")).alias("o"))
    offsets = materialize(offsets.select("core", "context", F.flatten("o.low").alias("low"), F.flatten("o.high").alias("high")), "suffix-offsets")
    # both sides are written: the join reads plain scans, and a context that very many texts hold can be split
    places = materialize(found.filter("x is not null and id_a is not null").select("id_a", "id_b", "x", "core", "context").distinct(), "suffix-places")
    # strings at offsets low..high before an anchor at x cover x - high .. x - low + match
    ranged = places.join(offsets, ["core", "context"]).select(
        "id_a", "id_b", F.transform("high", lambda d: F.col("x") - d).alias("starts"), F.transform("low", lambda d: F.col("x") - d + shape.match).alias("ends"))
    copied = found.filter("starts is not null and size(starts) > 0").select("id_a", "id_b", "starts", "ends").distinct()
    # equal texts were made one above, so a list holds the ranges of one text
    return copied.unionByName(ranged).groupBy("id_a", "id_b").agg(F.flatten(F.collect_list("starts")).alias("starts"), F.flatten(F.collect_list("ends")).alias("ends"))


def cut_repeats(docs: DataFrame, *, text: str = "text", shape: Shape = Shape(), broadcast_keys: int = BROADCAST_KEYS, broadcast_texts: int = BROADCAST_TEXTS, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """``docs`` with n_bytes, ``spans`` (removed byte ranges, maximal) and ``kept``, the remaining bytes."""
    found = materialize(repeats(docs, text=text, shape=shape, broadcast_keys=broadcast_keys, bucket_rows=bucket_rows), "suffix-ranges")
    size = found.agg(F.count("*"), F.sum(F.size("starts"))).first()
    if size[0] <= broadcast_texts and (size[1] or 0) <= 8 * broadcast_texts:
        found = F.broadcast(found)
    t = F.coalesce(F.col(f"_row.`{text}`"), F.lit(""))
    found = found.select(F.col("id_a").alias("_a"), F.col("id_b").alias("_b"), "starts", "ends")
    joined = packed(docs).join(found, (F.xxhash64(t) == F.col("_a")) & (F.xxhash64(t, F.lit(1)) == F.col("_b")), "left")

    @F.pandas_udf("n_bytes long, starts array<int>, ends array<int>, kept binary")
    def cut(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for texts, starts, ends in batches:
            rows = []
            for value, s, e in zip(texts, starts, ends):
                raw = _bytes(value)
                if s is None:
                    rows.append((len(raw), [], [], raw))
                    continue
                s, e = merged(np.asarray(s, dtype=np.int64), np.asarray(e, dtype=np.int64))
                rest = b"".join(raw[a:b] for a, b in zip([0, *e.tolist()], [*s.tolist(), len(raw)]))
                rows.append((len(raw), s.astype(np.int32), e.astype(np.int32), rest))
            yield pd.DataFrame(rows, columns=["n_bytes", "starts", "ends", "kept"])

    done = joined.select("_row", cut(F.col(f"_row.`{text}`"), F.col("starts"), F.col("ends")).alias("_cut"))
    return done.select(*unpacked(docs.columns, ["n_bytes", "spans", "kept"]), F.col("_cut.n_bytes").alias("n_bytes"), F.arrays_zip(F.col("_cut.starts").alias("start"), F.col("_cut.ends").alias("end")).alias("spans"), F.col("_cut.kept").alias("kept"))


def op10(spark, folder: str) -> DataFrame:
    found = cut_repeats(table(spark, folder, "documents").select("doc_id", "text"))
    n_removed = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + (s["end"] - s["start"]))
    return found.select("doc_id", "n_bytes", n_removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
