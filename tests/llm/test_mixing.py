from __future__ import annotations

import itertools
import random

import pytest
from pyspark.sql import functions as F

from tabflow.llm.mixing import capped_targets, mix, repeated_documents, route, single_source_mix


def plain_targets(sizes, weights, total, most):
    """Shares by weight; whoever is above its cap is set to it and the others share anew."""
    out, open_ = [0.0] * len(sizes), set(range(len(sizes)))
    while open_:
        left, weight = total - sum(out[i] for i in range(len(sizes)) if i not in open_), sum(weights[i] for i in open_)
        over = [i for i in open_ if left * weights[i] / weight >= most * sizes[i]]
        if not over:
            for i in open_:
                out[i] = left * weights[i] / weight
            break
        for i in over:
            out[i] = float(most * sizes[i])
            open_.discard(i)
    return out


@pytest.mark.parametrize("sizes", [[100, 100, 100], [10, 1000, 0], [3, 50, 7, 9], [], [7]])
def test_targets_are_capped_and_reshared(spark, sizes):
    rows = [(f"s{k}" if k + 1 < len(sizes) or k % 2 else None, n) for k, n in enumerate(sizes)]
    docs = spark.createDataFrame(rows, "source string, size long")
    got = {r["source"]: r["target"] for r in capped_targets(docs, "source", (5, 2, 1), 1.5, 2).collect()}
    want = plain_targets(sizes, [(5, 2, 1)[k % 3] for k in range(len(sizes))], 1.5 * sum(sizes), 2)
    assert [got[s] for s, _ in rows] == pytest.approx(want) and sum(want) == pytest.approx(1.5 * sum(sizes))


def test_very_many_sources(spark):
    """150,000 sources of their own and a few that share documents: no table comes to the driver."""
    docs = spark.range(150_000).select("id", F.array(F.concat(F.lit("s"), F.col("id"))).alias("sets"), F.lit(2).cast("long").alias("w"))
    shared = spark.createDataFrame([(1_000_000 + k, [["x"], ["x", "y"], ["y"]][k % 3], 3) for k in range(60)], "id long, sets array<string>, w long")
    sources = docs.select(F.col("sets")[0].alias("source"), F.lit(3).cast("long").alias("quota")).unionByName(spark.createDataFrame([("x", 70), ("y", 120)], "source string, quota long"))
    got = mix(docs.unionByName(shared), sources, members=F.col("sets"), size=F.col("w"), key="id")
    taken = got.select(F.explode("takes").alias("t"), "size").groupBy("t.source").agg(F.sum(F.col("size") * F.col("t.repeats")).alias("n"))
    sums = {r["kind"]: (r["n"], r["sources"]) for r in taken.groupBy(F.substring("source", 1, 1).alias("kind")).agg(F.sum("n").alias("n"), F.count("*").alias("sources")).collect()}
    # quota 3 of a document of 2: its middle falls into the whole first run and onto the end of the second
    assert sums["s"] == (600_000, 150_000)
    assert abs(sums["x"][0] - 70) <= 6 and abs(sums["y"][0] - 120) <= 6


def brute_route(supply, quota, repeats):
    """(most tokens, least cost) over every way to give patterns' tokens to sources."""
    patterns = list(supply)
    options = []
    for p in patterns:
        shares = itertools.product(*[range(min(quota[s], repeats * supply[p]) + 1) for s in p])
        options.append([dict(zip(p, x)) for x in shares if sum(x) <= repeats * supply[p]])
    best = (0, 0)
    for pick in itertools.product(*options):
        if any(sum(x.get(s, 0) for x in pick) > quota[s] for s in quota):
            continue
        tokens = sum(sum(x.values()) for x in pick)
        cost = sum((r + 1) * max(0, min(supply[p], sum(x.values()) - r * supply[p])) for p, x in zip(patterns, pick) for r in range(repeats))
        best = min(best, (-tokens, cost))
    return -best[0], best[1]


@pytest.mark.parametrize("seed", range(6))
def test_flow_is_the_largest_and_cheapest(seed):
    rng = random.Random(seed)
    supply = {p: rng.randint(0, 3) for p in [("a",), ("b",), ("a", "b"), ("b", "c")]}
    quota = {s: rng.randint(0, 5) for s in "abc"}
    flow = route(supply, quota, 2)
    used = {p: sum(v for (q, _), v in flow.items() if q == p) for p in supply}
    assert all(sum(v for (_, t), v in flow.items() if t == s) <= quota[s] for s in quota)
    cost = sum((r + 1) * max(0, min(supply[p], used[p] - r * supply[p])) for p in supply for r in range(2))
    assert (sum(flow.values()), cost) == brute_route(supply, quota, 2)


def test_overlapping_sources_get_their_quotas(spark):
    rng = random.Random(1)
    rows = [(i, rng.choice([["a"], ["b"], ["a", "b"], ["b", "c"], []]), rng.randint(1, 20), "x") for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, sets array<string>, w long, members string")
    quota = {"a": 2500, "b": 3000, "c": 1500}
    got = mix(docs, quota, members=F.col("sets"), size=F.col("w")).collect()
    assert len(got) == 600
    taken = {s: sum(r["size"] * t["repeats"] for r in got for t in r["takes"] if t["source"] == s) for s in quota}
    assert all(abs(taken[s] - quota[s]) <= 60 for s in quota)
    assert all(sum(t["repeats"] for t in r["takes"]) <= 2 and all(t["source"] in r["sets"] for t in r["takes"]) for r in got)
    again = mix(docs.repartition(7), quota, members=F.col("sets"), size=F.col("w"), slices=16).collect()
    assert sorted((r["doc_id"], str(r["takes"])) for r in got) == sorted((r["doc_id"], str(r["takes"])) for r in again)


ROWS = [(1, "a b c", "s", 1), (1, "a b c", "s", 1), (2, None, "s", 2), (3, "", None, 3), (4, "one two\tthree\nfour", None, 4), (None, "x y", "t", 5), (None, None, None, None)]


def test_defined_cases(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string, source string, size long")
    got = single_source_mix(docs).collect()
    assert len(got) == len(ROWS) and all(r["taken"] in (0, r["size"], 2 * r["size"]) for r in got)
    assert {(r["source"], r["source_size"]) for r in got} == {("s", 6), ("t", 2), (None, 4)}
    rows = repeated_documents(docs)
    assert rows.columns == docs.columns
    count = {}
    for r in got:
        count[r["doc_id"], r["source"]] = count.get((r["doc_id"], r["source"]), 0) + (r["taken"] // r["size"] if r["size"] else 0)
    out = {}
    for r in rows.collect():
        out[r["doc_id"], r["source"]] = out.get((r["doc_id"], r["source"]), 0) + 1
    assert out == {k: n for k, n in count.items() if n}
    assert single_source_mix(docs.filter("false")).count() == 0 and repeated_documents(docs.filter("false")).count() == 0


def test_copies_joined_by_shuffle(spark, monkeypatch):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string, source string, size long")
    want = sorted(map(str, repeated_documents(docs).collect()))
    monkeypatch.setattr("tabflow.llm.mixing.BROADCAST_TAKES", 0)
    assert sorted(map(str, repeated_documents(docs).collect())) == want
