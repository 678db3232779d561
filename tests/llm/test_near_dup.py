from __future__ import annotations

import itertools
import random

import pytest
from pyspark.sql import functions as F

from tabflow.llm import near_dup, pipeline


def plain_set(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").split(" ")
    words = [w for w in words if w]
    return {tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute(rows):
    """The rows' ids that stay: the least of each component of pairs with Jaccard >= 0.8."""
    sets, parent = [plain_set(t) for _, t in rows], list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        a, b = sets[i], sets[j]
        if 5 * len(a & b) >= 4 * len(a | b):
            parent[root(j)] = root(i)
    least: dict = {}
    for i, (k, _) in enumerate(rows):
        least[root(i)] = min(k, least.get(root(i), k))
    return sorted(least.values())


def rows():
    rng = random.Random(4)
    text = lambda n: [f"w{rng.randint(0, 400)}" for _ in range(n)]
    out = []
    for n in [3, 5, 6, 9, 14, 30, 60, 100, 200, 400]:
        base = text(n)
        out.append(base)
        for changes in (1, 1, 2, 3, 4):
            near = list(base)
            for _ in range(max(1, changes * n // 100)):
                near[rng.randrange(n)] = "changed"
            out += [near, near + text(max(1, n // 9)), near[: n - n // 8]]
    boiler = text(40)
    out += [boiler + text(12) for _ in range(30)] + [boiler + text(4) for _ in range(30)]
    texts = [" ".join(w) for w in out] + ["", None, "  ", "w1 W2", "W1 w2"]
    rng.shuffle(texts)
    return list(enumerate(texts))


@pytest.mark.parametrize("known", [500_000, 0])
def test_stage_equals_brute_force(spark, monkeypatch, known):
    monkeypatch.setattr(near_dup, "FREQUENT", known)
    data = rows()
    docs = spark.createDataFrame(data, "doc_id long, text string")
    kept = sorted(r["doc_id"] for r in pipeline.drop_near_duplicates(spark, docs, "").collect())
    assert kept == brute(data) and len(kept) < len(data) // 2


def test_changed_words_are_found(spark):
    """0.87 of the shingles are shared; fingerprints of such texts differ in more than three bits."""
    words = [f"w{i * i % 211}x{i}" for i in range(300)]
    near = [("new" if i in (40, 120, 200, 280) else w) for i, w in enumerate(words)]
    docs = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(near))], "doc_id long, text string")
    assert [r["doc_id"] for r in pipeline.drop_near_duplicates(spark, docs, "").collect()] == [1]


def test_runs_over_many_batches_and_joins_by_shuffle(spark, monkeypatch):
    """Runs of one shingle lie over several Arrow batches, and no table of nodes is broadcast."""
    monkeypatch.setattr(near_dup, "BROADCAST_NODES", 0)
    monkeypatch.setattr(near_dup, "FREQUENT", 0)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        data = rows()
        docs = spark.createDataFrame(data, "doc_id long, text string")
        kept = sorted(r["doc_id"] for r in pipeline.drop_near_duplicates(spark, docs, "").collect())
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert kept == brute(data)


def test_nulls_in_other_columns_and_repeated_rows(spark):
    same = "one two three four five six seven"
    data = [(1, same, None, None), (1, same, None, None), (2, same + " eight", "en", None), (None, same, None, 5), (None, "other words that stand alone here", None, None), (3, None, "en", 1), (4, "", None, None)]
    docs = spark.createDataFrame(data, "doc_id long, text string, lang string, n_chars long")
    kept = sorted(map(str, ((r["doc_id"], r["text"]) for r in near_dup.keep_one(docs).collect())))
    # 3 of 4 shingles are shared with the eighth word: below the limit
    assert kept == sorted(map(str, [(1, same), (2, same + " eight"), (None, "other words that stand alone here"), (3, None)]))


def test_fingerprints_alone_link_close_texts(spark, monkeypatch):
    """The stage's SimHash step, without the prefixes: copies but for the case, and one word more in a long text."""
    words = " ".join(f"w{i * i % 211}x{i}" for i in range(3000))
    data = [(1, words), (2, words.upper().replace("X", "x")), (3, words + " more"), (4, " ".join(f"v{i}" for i in range(300))), (5, None)]
    docs = spark.createDataFrame(data, "doc_id long, text string")
    monkeypatch.setattr(near_dup, "_pairs", lambda index, rooted: spark.createDataFrame([], "a long, b long"))
    assert sorted(r["doc_id"] for r in pipeline.drop_near_duplicates(spark, docs, "").collect()) == [1, 4, 5]


def test_pairs_between_components_are_ruled_out_before_they_are_written(spark):
    # 120 components share a key; only the last two have the same counts by cell
    cells = [bytes(100 if c == min(i, 118) else 0 for c in range(near_dup.CELLS)) for i in range(120)]
    rows = [(7, i, 100, 0, i, cells[i]) for i in range(120)] + [(8, i, 100, 0, 5, cells[0]) for i in (300, 301)]
    index = spark.createDataFrame(rows, "key long, node long, size long, at long, root long, cells binary")
    assert [tuple(r) for r in near_dup._pairs(index, True).collect()] == [(118, 119)]
    kept = near_dup._open_runs(index.drop("cells")).collect()
    assert len(kept) == 120 and {r["key"] for r in kept} == {7}


def test_every_pair_of_a_fingerprint_component_is_compared(spark, monkeypatch):
    """Without the prefixes: similar texts whose fingerprints meet are found, also where a star of the component joins others."""
    own = near_dup._prefixes
    monkeypatch.setattr(near_dup, "_prefixes", lambda *a: own(*a).withColumns({"prefix": F.array().cast("array<long>"), "fingerprint": F.when(F.col("doc_id") % 3 > 0, F.lit(5).cast("long")).otherwise(F.lit(6).cast("long"))}))
    text = lambda k: " ".join(f"w{(i * i + k) % 97}k{k}" for i in range(100))
    data = [(k, text(k)) for k in range(20)] + [(k + 100, text(k) + " more") for k in range(20)]
    docs = spark.createDataFrame(data, "doc_id long, text string")
    assert sorted(r["doc_id"] for r in pipeline.drop_near_duplicates(spark, docs, "").collect()) == list(range(20))
