from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabflow.llm.suffix_dedup import Shape, anchors, cut_repeats, merged, multikey_order, op10

SMALL = Shape(match=24, window=9, gram=4)


def brute(texts: list[str | None], match: int) -> list[tuple[int, list[tuple[int, int]], bytes]]:
    raw = [(t or "").encode() for t in texts]
    seen: dict[bytes, int] = {}
    for r in raw:
        for p in range(len(r) - match + 1):
            seen[r[p:p + match]] = seen.get(r[p:p + match], 0) + 1
    out = []
    for r in raw:
        gone = np.zeros(len(r) + 1, dtype=bool)
        for p in range(len(r) - match + 1):
            if seen[r[p:p + match]] > 1:
                gone[p:p + match] = True
        gone = gone[:-1]
        edge = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(int), [0]])))
        out.append((len(r), list(zip(edge[::2].tolist(), edge[1::2].tolist())), bytes(b for b, g in zip(r, gone) if not g)))
    return out


def corpus(seed: int, n: int = 60) -> list[str | None]:
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdé") for _ in range(rng.randint(1, 6)))
    text = lambda k: " ".join(word() for _ in range(k))
    shared = [text(k) for k in (4, 6, 9, 14, 30)]
    texts: list[str | None] = [None, "", "short", "a" * 90, "ab" * 70, "Repeat me " * 12]
    for _ in range(n):
        parts = [text(rng.randint(0, 12))]
        for _ in range(rng.randint(0, 3)):
            parts += [rng.choice(shared)[rng.randint(0, 3):], text(rng.randint(0, 5))]
        texts.append("".join(parts))
    texts += texts[8:12] + texts[10:11] * 3
    near = list(texts[14])
    near[len(near) // 2:len(near) // 2] = "XY"
    return texts + ["".join(near)]


def run(spark, texts, **options):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    rows = cut_repeats(docs, **options).collect()
    return {r["doc_id"]: (r["n_bytes"], [(s["start"], s["end"]) for s in r["spans"]], bytes(r["kept"])) for r in rows}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_equals_brute_force(spark, seed):
    texts = corpus(seed)
    assert run(spark, texts, shape=SMALL) == dict(enumerate(brute(texts, SMALL.match)))


@pytest.mark.parametrize("options", [{"bucket_rows": 12}, {"broadcast_keys": 0}, {"broadcast_keys": 0, "broadcast_texts": 0, "bucket_rows": 40}])
def test_ways_agree(spark, options):
    texts = corpus(4)
    assert run(spark, texts, shape=SMALL, **options) == dict(enumerate(brute(texts, SMALL.match)))


def test_one_passage_in_many_texts_fills_several_buckets(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    passage = " ".join(word() for _ in range(12))
    texts = [f"{word()} {word()}{passage}{word()} {word()} {word()}" for _ in range(200)]
    assert run(spark, texts, shape=SMALL, bucket_rows=100) == dict(enumerate(brute(texts, SMALL.match)))


def test_extra_columns_and_empty_table(spark):
    docs = spark.createDataFrame([(1, "x" * 50, "old", 3)], "doc_id long, text string, kept string, id_a int")
    got = cut_repeats(docs, shape=SMALL)
    assert got.columns == ["doc_id", "text", "n_bytes", "spans", "kept"]
    assert bytes(got.first()["kept"]) == b""
    assert cut_repeats(docs.filter("false"), shape=SMALL).count() == 0


def test_query_equals_brute_force(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()
    want = {d["doc_id"]: b for d, b in zip(docs, brute([d["text"] for d in docs], 400))}
    got = op10(spark, data).collect()
    assert len(got) == len(docs)
    for r in got:
        n, spans, kept = want[r["doc_id"]]
        assert (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) == (n, sum(e - s for s, e in spans), len(spans), hashlib.sha256(kept).hexdigest())


def test_anchors_do_not_depend_on_stretches(monkeypatch):
    rng = random.Random(6)
    raw = bytes(rng.choice(b"abc ") for _ in range(5000))
    whole = anchors(raw, SMALL)
    monkeypatch.setattr("tabflow.llm.suffix_dedup._STRETCH", 37)
    assert np.array_equal(anchors(raw, SMALL), whole)
    # every window holds an anchor
    assert all(((whole >= p) & (whole < p + SMALL.window)).any() for p in range(len(raw) - SMALL.match + 1))


def test_multikey_order_sorts_rows():
    rng = np.random.default_rng(7)
    words = rng.integers(0, 3, size=(500, 6)).astype(">u8")
    assert [tuple(r) for r in words[multikey_order(words)].tolist()] == sorted(map(tuple, words.tolist()))


def test_merged():
    s, e = merged(np.array([5, 0, 9, 2]), np.array([7, 3, 12, 5]))
    assert list(zip(s, e)) == [(0, 7), (9, 12)]
