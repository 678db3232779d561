from __future__ import annotations

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from tabflow.llm import merkle

SCHEMA = "text string, doc_id long, source string, lang string, n_chars long, digest string, pos string, path string"


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def plain_leaf(doc_id, source, lang, n_chars, text):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)))


def climb(level):
    """All levels from ``level`` to its single node."""
    levels = [level]
    while len(levels[-1]) > 1:
        levels.append([sha("".join(levels[-1][i:i + 8])) for i in range(0, len(levels[-1]), 8)])
    return levels


def path(levels, at):
    out = []
    for level in levels[:-1]:
        run = at // 8 * 8
        out.append(("".join(level[run:at]), "".join(level[at + 1:run + 8])))
        at //= 8
    return out


def plain(rows):
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) of (doc_id, source, lang, n_chars, text)."""
    order = lambda v: (v is not None, v if v is not None else 0)
    langs = sorted({r[2] for r in rows}, key=lambda v: (v is not None, (v or "").encode()))
    groups = {v: sorted(([plain_leaf(*r), r] for r in rows if r[2] == v), key=lambda x: (order(x[1][0]), x[0])) for v in langs}
    trees = {v: climb([leaf for leaf, _ in g]) for v, g in groups.items()}
    crown = climb([trees[v][-1][0] for v in langs])
    out = []
    for k, v in enumerate(langs):
        for i, (leaf, r) in enumerate(groups[v]):
            steps = path(trees[v], i) + path(crown, k)
            text = r[4]
            if text is not None and r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0:
                text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
            node = plain_leaf(*r[:4], text)
            for left, right in steps:
                node = sha(left + node + right)
            root = crown[-1][0]
            out.append((r[0], leaf, trees[v][-1][0], root, sha("".join(a + b for a, b in steps)), node, node == root))
    return out


def key(r):
    return (r[0] is None, r[0] or 0, r[1:])


def run(spark, tmp_path, rows):
    data = [(r[4], r[0], r[1], r[2], r[3], "x", "y", "z") for r in rows]
    spark.createDataFrame(data, SCHEMA).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    return merkle.op11(spark, str(tmp_path))


@pytest.mark.parametrize("sizes", [[1], [9], [1, 8, 64, 65], [2, 3, 1, 1, 1, 1, 1, 1, 1], [700, 512, 3]])
def test_equals_plain_tree(spark, tmp_path, sizes):
    rows, k = [], 0
    for g, n in enumerate(sizes):
        for _ in range(n):
            rows.append((k * 7 % 1009 + 2000 * g, f"s{k % 3}", None if g == 1 else f"é{g}", k, None if k % 11 == 3 else f"Text ÄÖ {k} ABC" * (k % 4)))
            k += 1
    got = run(spark, tmp_path, rows)
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert sorted(map(tuple, got.collect()), key=key) == sorted(plain(rows), key=key)


def test_three_tiers_with_small_blocks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(merkle, "LEVELS", 1)
    monkeypatch.setattr(merkle, "BLOCK", 8)
    rows = [(k, "s", "en" if k % 50 else "de", 1, f"T{k}") for k in range(600)]
    assert sorted(map(tuple, run(spark, tmp_path, rows).collect()), key=key) == sorted(plain(rows), key=key)


def test_nulls_ties_repeats_and_long_texts(spark, tmp_path):
    rows = [(None, None, None, None, None), (None, "s", "en", 1, ""), (5, "s", "en", 1, "B"), (5, "s", "en", 1, "A"), (5, "s", "en", 1, "A"), (3, None, "en", None, "Long WORD " * 200_000), (3, "", "", 0, "")]
    rows += [(77, "s", "fr", 2, "Same Text")] * 20
    got = [tuple(r) for r in run(spark, tmp_path, rows).collect()]
    assert sorted(got, key=key) == sorted(plain(rows), key=key)


def test_tampering_is_seen_and_nothing_else(spark, data):
    found = merkle.op11(spark, data)
    docs = spark.read.parquet(f"{data}/documents.parquet")
    changed = docs.filter((F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3)) == 0) & (F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz") != F.col("text")))
    assert found.count() == docs.count()
    assert found.filter("not verified").join(changed, "doc_id", "left_anti").count() == 0
    assert found.filter("verified").join(changed, "doc_id", "left_semi").count() == 0 < changed.count()


def test_empty_table(spark, tmp_path):
    assert run(spark, tmp_path, []).count() == 0
