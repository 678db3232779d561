from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from tabflow.llm import cross_align, perfect_hash

SCHEMA = "doc_id long, text string, n_a string, groups string"


@pytest.fixture(scope="module")
def both():
    return cross_align.Both(cross_align.load_files())


def plain(rows, both):
    """The result by whole texts, byte by byte, and pairs counted in a dictionary."""
    found, corpus = [], Counter()
    for k, text in rows:
        raw = (" " + (text or "")).encode()
        a = both.a.encode(" " + (text or ""), add_special_tokens=False).ids
        b = both.b.encode(text or "")
        bytes_a, bytes_b = [both.bytes_a[i] for i in a], [both.bytes_b[i] for i in b]
        if not text or b"".join(bytes_a) != raw or b"".join(bytes_b) != raw:
            found.append((k, [], []))
            continue
        at_a = [i for i, x in enumerate(bytes_a) for _ in x]
        at_b = [i for i, x in enumerate(bytes_b) for _ in x]
        links = sorted(set(zip(at_a, at_b)))
        groups, own = [], ([], [])
        for p in range(len(raw)):
            for ids, at, part in ((a, at_a, own[0]), (b, at_b, own[1])):
                if p == 0 or at[p] != at[p - 1]:
                    part.append(ids[at[p]])
            if p + 1 == len(raw) or (at_a[p + 1] != at_a[p] and at_b[p + 1] != at_b[p]):
                groups.append(own)
                own = ([], [])
        pairs = [(a[i], b[j]) for i, j in links]
        corpus.update(set(pairs))
        found.append((k, groups, pairs))
    best = Counter()
    for (x, _), n in corpus.items():
        best[x] = max(best[x], n)
    out = []
    for k, groups, pairs in found:
        text = ";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in groups)
        out.append((k, sum(len(x) for x, _ in groups), sum(len(y) for _, y in groups), len(groups), len(pairs), sum(corpus[p] == best[p[0]] for p in pairs), sum(corpus[p] for p in pairs), text))
    return out


def odd_texts():
    rng = random.Random(5)
    bits = ["word", "Straße", "naïve", "日本語", "🙂", "\n", "\n\n", "  ", " ", "\t", "don't", "x1y2", "...", "<|endoftext|>", "<s>", "</s>", "<unk>", " ", " ", "\x1c", "\x85", "Ωmega", "é", "ﬁ", "\r\n", "<0x0A>", "of the", "aaaaaaaaaaaaaaaaaaaaaaaaaaaa"]
    texts = [None, "", " ", "   ", "\n", "\nfoo bar", " foo", "  foo\nbar", "▁", "a ▁b", "foo\nbar baz\n\nqux ", "foo \n bar", "\x00a b"]
    texts += ["".join(rng.choice(bits) + rng.choice(["", " ", " ", "\n"]) for _ in range(rng.randint(1, 40))) for _ in range(150)]
    texts += ["x" * 5000, "long words here\n" * 4000, texts[20], texts[20]]
    return [(k if k % 40 else None, t) for k, t in enumerate(texts)]


def frame(spark, rows):
    return spark.createDataFrame([(k, t, "x", "y") for k, t in rows], SCHEMA).repartition(5)


def ordered(rows):
    return sorted(map(tuple, rows), key=lambda r: (r[0] is None, r[0] or 0, r[1:]))


def test_equals_whole_texts(spark, both):
    rows = odd_texts()
    want = plain(rows, both)
    got = cross_align.align(frame(spark, rows))
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups"]
    assert ordered(got.collect()) == ordered(want)
    # the document with the reserved character has no tokens
    assert {r[0]: r[1:] for r in want}[9][-1] == "" and sum(r[1] > 0 for r in want) > 100


def test_joined_counts_many_shards_and_slices(spark, both, monkeypatch):
    rows = odd_texts()
    monkeypatch.setattr(cross_align, "SLICE", 16)
    got = cross_align.align(frame(spark, rows), broadcast_pairs=10, shard_keys=50)
    assert ordered(got.collect()) == ordered(plain(rows, both))


def test_forgetting_changes_nothing(both, monkeypatch):
    texts = [t for _, t in odd_texts()]

    def values():
        memory, out = cross_align.Memory(both), {}
        for group in memory.texts(texts):
            pair, of = group.links()
            for k, (t, text) in enumerate(zip(group.texts, group.group_texts())):
                out[t] = (text, memory.codes[pair[of == k]].tolist(), group.sums(memory.n_a)[k])
        return out, memory.age

    whole, age = values()
    monkeypatch.setattr(cross_align, "REMEMBERED", 5)
    monkeypatch.setattr(cross_align, "GROUP_CHARS", 50)
    again, later = values()
    assert again == whole and age == 1 and later > 10


def test_sums_over_several_memories(both, monkeypatch):
    """A task whose memory is emptied on the way sends its sums in parts."""
    texts = [t for _, t in odd_texts()]

    def sums():
        memory, total = cross_align.Memory(both), Counter()
        for group in memory.texts(texts):
            for code, n in zip(memory.codes.tolist(), cross_align._document_counts(group).tolist()):
                total[code] += n
        return +total

    whole = sums()
    monkeypatch.setattr(cross_align, "REMEMBERED", 20)
    monkeypatch.setattr(cross_align, "GROUP_CHARS", 100)
    assert sums() == whole


def test_query_equals_brute_force(spark, data, both):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()]
    want = [(*r[:-1], hashlib.sha256(r[-1].encode()).hexdigest() if r[-1] else "") for r in plain(docs, both)]
    got = cross_align.op12(spark, data)
    assert got.columns[-1] == "groups_sha256"
    assert ordered(got.collect()) == ordered(want)


def test_sums_up_a_tree(spark):
    rng = np.random.default_rng(1)
    rows = [(int(c), int(n)) for c, n in zip(rng.integers(0, 3000, 20_000), rng.integers(1, 9, 20_000))]
    sums = spark.createDataFrame(rows, "code long, n long").repartition(13)
    _, hashed = cross_align.hash_pairs(sums, 700)
    vectors = cross_align.dense_counts(sums, spark.sparkContext.broadcast(hashed), fan_in=3)
    want = Counter()
    for c, n in rows:
        want[c] += n
    assert {r["code"]: r["n"] for r in cross_align.pair_counts(vectors).collect()} == dict(want)


def test_perfect_hash():
    rng = np.random.default_rng(3)
    keys = np.unique(rng.integers(0, 2**63, 50_000).astype(np.uint64))
    shards = [keys[perfect_hash.spread(keys, perfect_hash.SHARD_SEED, 7) == k] for k in range(7)]
    hashed = perfect_hash.PerfectHash([perfect_hash.load(*perfect_hash.build(s)) for s in shards])
    assert hashed.n_keys == len(keys) and np.array_equal(np.sort(hashed.index(keys)), np.arange(len(keys)))
    assert sum(w.nbytes for s in hashed.shards for w in s.levels) * 8 < 5 * len(keys)
    # keys without a level are found in the rest
    few = perfect_hash.load([], np.sort(keys[:100]))
    assert np.array_equal(np.sort(perfect_hash.index_in(few, keys[:100])), np.arange(100)) and (perfect_hash.index_in(few, keys[200:300]) == -1).all()


def test_empty_table(spark):
    assert cross_align.align(spark.createDataFrame([], SCHEMA)).count() == 0
