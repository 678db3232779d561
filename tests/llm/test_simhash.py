from __future__ import annotations

import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tabflow.llm.components import star_labels
from tabflow.llm.simhash import components, fingerprint, keep_one, links, op7


def plain_fingerprint(text: str | None) -> int:
    raw = bytes(b + 32 if 65 <= b <= 90 else b for b in (text or "").encode())
    for s in b"\t\n\x0b\x0c\r":
        raw = raw.replace(bytes([s]), b" ")
    words = [w for w in raw.split(b" ") if w]
    if not words:
        return 0
    shingles = [b" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))


def plain_components(ids: list, prints: list[int]) -> dict:
    parent = list(range(len(prints)))

    def root(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    p = np.array(prints, dtype=np.uint64)
    for i in range(len(p)):
        for j in np.flatnonzero(np.bitwise_count(p[i + 1:] ^ p[i]) <= 3):
            parent[root(i)] = root(i + 1 + int(j))
    least: dict[int, int] = {}
    for i, k in enumerate(ids):
        least[root(i)] = min(k, least.get(root(i), k))
    return {k: least[root(i)] for i, k in enumerate(ids)}


def test_spark_hash_is_the_same(spark):
    row = spark.sql("select xxhash64('einß word') h").first()
    assert row["h"] & (2**64 - 1) == xxhash.xxh64_intdigest("einß word".encode(), 42)


def test_fingerprint_of_edge_texts(monkeypatch):
    texts = [None, "", " \t\n", "one", "One TWO", "a b c", "É a\x0bb\x0c c" * 30, "nb\xa0sp is one word"]
    assert [fingerprint(t) for t in texts] == [plain_fingerprint(t) for t in texts]
    monkeypatch.setattr("tabflow.llm.simhash._WORDS_AT_ONCE", 7)
    text = " ".join(f"w{i % 13}" for i in range(100))
    assert fingerprint(text) == plain_fingerprint(text)


def test_query_equals_brute_force(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()
    prints = [plain_fingerprint(d["text"]) for d in docs]
    want = plain_components([d["doc_id"] for d in docs], prints)
    got = op7(spark, data).collect()
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in got} == {d["doc_id"]: (f"{p:016x}", want[d["doc_id"]]) for d, p in zip(docs, prints)}
    assert len(set(want.values())) < len(want)


@pytest.mark.parametrize("run_limit", [16_384, 20])
def test_links_keep_all_components(spark, run_limit):
    rng = random.Random(3)
    base = [rng.getrandbits(64) for _ in range(40)]
    prints = set(base)
    for b in base:
        for _ in range(4):
            prints.add(b ^ sum(1 << k for k in rng.sample(range(64), rng.randint(1, 5))))
    hot = rng.getrandbits(64)  # a dense cluster that fills long runs
    prints |= {hot ^ sum(1 << k for k in rng.sample(range(64), 2)) for _ in range(300)}
    prints = sorted(prints)
    signed = [p - 2**64 if p >= 2**63 else p for p in prints]
    found = links(spark.createDataFrame([(s,) for s in signed], "fingerprint long"), run_limit=run_limit)
    assert found.count() < 64 * len(prints)
    roots = {r["node"]: r["root"] for r in star_labels(found).collect()}
    want = plain_components(prints, prints)
    group: dict = {}
    for s, p in zip(signed, prints):
        group.setdefault(want[p], set()).add(roots.get(s, s))
    assert all(len(g) == 1 for g in group.values())
    assert len({next(iter(g)) for g in group.values()}) == len(group)


def test_star_labels_of_a_long_chain_and_a_hub(spark):
    edges = [(i, i + 1) for i in range(60)] + [(1000, 1000 + k) for k in range(1, 200)] + [(5, 5)]
    got = {r["node"]: r["root"] for r in star_labels(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(61)}, **{1000 + k: 1000 for k in range(200)}}
    assert star_labels(spark.createDataFrame([], "a long, b long")).count() == 0


LONG = " ".join(f"word{i * 7 % 101}" for i in range(400))
ROWS = [(5, LONG, "x", 1), (3, LONG + " tail", "y", 1), (3, LONG + " tail", "y", 1), (None, LONG, "z", None), (8, None, "n", 1), (7, "", "e", 1), (9, "quite another text stands here", "q", 1)]


def test_defined_cases(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string, component_id string, root int")
    got = components(docs).select("doc_id", "fingerprint", "component_id").collect()
    assert sorted(((r["doc_id"] is None, r["doc_id"] or 0), r["component_id"]) for r in got) == [
        ((False, 3), 3), ((False, 3), 3), ((False, 5), 3), ((False, 7), 7), ((False, 8), 7), ((False, 9), 9), ((True, 0), 3)]
    kept = keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"], r["component_id"]) for r in kept.collect()) == [(3, "y"), (7, "e"), (9, "q")]
    assert components(docs.filter("false")).count() == 0 and keep_one(docs.filter("false")).count() == 0
