from __future__ import annotations

import hashlib
import random

from tabflow.llm.line_chunks import dedup_lines


def chunks(lines, spread):
    h = [int(hashlib.md5(x.encode()).hexdigest()[:7], 16) for x in lines]
    n, start = len(lines), 0
    marked = [None] + [((h[i - 2] if i > 1 else 0) * 31 + h[i - 1]) % (2**31 - 1) % spread == 0 for i in range(1, n + 1)]
    for i in range(1, n + 1):
        # a second mark in a row, and one that would leave a single line at an end, end no chunk
        if i == n or (1 < i < n - 1 and marked[i] and not marked[i - 1]):
            if i - start > 1:
                yield start, i
            start = i


def brute(rows, spread=4):
    places: dict = {}
    for k, t in {(k, t) for k, t, *_ in rows if t is not None}:
        lines = t.split("\n")
        for s, e in chunks(lines, spread):
            places.setdefault("\n".join(lines[s:e]), []).append(((k is not None, k or 0), t, s, e))
    gone: dict = {}
    for where in places.values():
        where.sort(key=lambda w: (w[0], w[2]))
        for key, t, s, e in where[1:]:
            gone.setdefault((key, t), set()).update(range(s, e))
    out = []
    for k, t, *_ in rows:
        if t is None:
            out.append((k, None, 0, 0))
            continue
        lines, g = t.split("\n"), gone.get(((k is not None, k or 0), t), set())
        out.append((k, "\n".join(x for i, x in enumerate(lines) if i not in g), len(lines), len(g)))
    return out


def key(r):
    return (r[0] is None, r[0] or 0, r[1] or "")


def test_equals_brute_force_and_survives_shifts(spark):
    rng = random.Random(2)
    line = lambda: " ".join(rng.choice("abcdefg") for _ in range(rng.randint(1, 5)))
    block = [line() for _ in range(30)]
    rows = [(i, "\n".join([line() for _ in range(rng.randint(0, 6))] + block[rng.randint(0, 3):] + [line()])) for i in range(12)]
    rows += [(20, None), (21, ""), (22, "\n\n\n"), (23, "\n\n\n"), (24, "single"), (25, "single"), (26, rows[0][1]), (26, rows[0][1]), (None, rows[1][1])]
    docs = spark.createDataFrame([(k, t, "old") for k, t in rows], "doc_id long, text string, n_removed string")
    got = dedup_lines(docs)
    assert got.columns == ["doc_id", "text", "n_lines", "n_removed"]
    got = [tuple(r) for r in got.collect()]
    want = brute(rows)
    assert sorted(got, key=key) == sorted(want, key=key)
    # most of the shared block is gone from all but one of the texts
    assert sum(r[3] for r in want) > 200


def test_every_chunk_has_two_lines(spark):
    rng = random.Random(9)
    for n in range(1, 60):
        lines = [str(rng.random()) for _ in range(n)]
        for spread in (1, 2, 4):
            found = list(chunks(lines, spread))
            assert sum(e - s for s, e in found) == (n if n > 1 else 0)


def test_copies_lose_every_line(spark):
    """Wherever two boundaries stand side by side: of two equal texts the later keeps nothing."""
    rng = random.Random(6)
    texts = ["\n".join(str(rng.random()) for _ in range(rng.randint(2, 40))) for _ in range(60)]
    # the same two lines over and over: all marked, or none
    texts += ["\n".join(["same"] * n) for n in (2, 3)]
    rows = [(k, t) for k, t in enumerate(texts + texts)]
    got = {r["doc_id"]: r for r in dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"), spread=2).collect()}
    assert all(got[k]["n_removed"] == got[k]["n_lines"] and got[k]["text"] == "" for k in range(len(texts), len(rows)))


def test_long_text_ties_and_shuffled_keys(spark, monkeypatch):
    rows = [(1, "\n".join(f"line {k % 977}" for k in range(30_000))), (2, "x" * 300_000 + "\ny\nz\n" + "x" * 300_000), (2, "y\nz"), (2, "z\ny"), (None, "y\nz"), (None, "y\nz")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = sorted(brute(rows), key=key)
    assert sorted(map(tuple, dedup_lines(docs).collect()), key=key) == want
    monkeypatch.setattr("tabflow.llm.line_chunks.BROADCAST_KEYS", 0)
    assert sorted(map(tuple, dedup_lines(docs).collect()), key=key) == want


def test_empty_table(spark):
    assert dedup_lines(spark.createDataFrame([], "doc_id long, text string")).count() == 0
