from __future__ import annotations

import os

import numpy as np
from pyspark.sql import functions as F

from tabflow.llm.quality import N_FEATURES, encode, fit, fit_bags, gradients, op3, score, _embed, _pool


def auc(scores, labels) -> float:
    order = np.argsort(scores, kind="stable")
    rank = np.empty(len(order))
    rank[order] = np.arange(1, len(order) + 1)
    pos = labels == 1
    return (rank[pos].sum() - pos.sum() * (pos.sum() + 1) / 2) / (pos.sum() * (~pos).sum())


def test_held_out_quality(spark, data):
    folder = os.path.join(os.path.dirname(data.rstrip("/")), "sf0.01")
    labels = spark.read.parquet(f"{folder}/labels.parquet").select("doc_id", "quality")
    got = op3(spark, folder).join(labels, "doc_id").filter("held_out").toPandas()
    assert len(got) > 30 and auc(got["score"].to_numpy(), got["quality"].to_numpy()) > 0.95
    assert (got["predicted"] == got["quality"]).mean() > 0.9 and got["score"].between(0, 1).all()


def test_attention_finds_the_passage_that_decides():
    rng = np.random.default_rng(0)
    bags, labels, rows = [], [], []
    for k in range(300):
        x = rng.standard_normal((rng.integers(3, 12), 6)).astype(np.float32)
        labels.append(k % 2)
        if k % 2:
            x[rng.integers(len(x))] += np.array([0, 0, 4, 4, 0, 0])
        rows.append(x)
        bags += [k] * len(x)
    x, bag, y = np.concatenate(rows), np.array(bags), np.array(labels, dtype=float)
    model = fit_bags(x, bag, y, width=8, epochs=60)
    h, e = model.embed(x)
    start = np.searchsorted(bag, np.arange(300))
    f = _pool(model.weights, h, e, bag, start)
    assert auc(f["p"], y) > 0.97


def test_gradients_of_one_step_lower_the_loss():
    rng = np.random.default_rng(1)
    x, bag, y = rng.standard_normal((40, 5)).astype(np.float32), np.repeat(np.arange(10), 4), (np.arange(10) % 2).astype(float)
    loss = []
    for epochs in (1, 30, 120):
        m = fit_bags(x, bag, y, width=4, epochs=epochs, rate=1e-2)
        p = _pool(m.weights, *m.embed(x), bag, np.arange(0, 40, 4))["p"]
        loss.append(-np.mean(y * np.log(p) + (1 - y) * np.log(1 - p)))
    assert loss[0] > loss[1] > loss[2]


def test_encoding_of_edge_texts():
    x, bag = encode(["", "a", "b " * 3000, "\x00"])
    assert x.shape == (len(bag), N_FEATURES) and bag.tolist() == [0, 1, *[2] * 6, 3] and np.isfinite(x).all()
    alone, _ = encode(["b " * 3000])
    assert np.allclose(alone, x[2:8])


def test_forward_pass_and_gradients():
    """Attention pooling written out passage by passage, and one step of training against numeric gradients."""
    rng = np.random.default_rng(4)
    x, bag, y = rng.standard_normal((9, 5)).astype(np.float64), np.array([0, 0, 0, 1, 1, 2, 2, 2, 2]), np.array([1.0, 0.0, 1.0])
    w = {"embed": rng.standard_normal((5, 4)), "embed_b": rng.standard_normal(4), "tanh": rng.standard_normal((4, 4)), "gate": rng.standard_normal((4, 4)), "attend": rng.standard_normal(4), "head": rng.standard_normal(4), "head_b": rng.standard_normal(1)}

    def plain(w):
        out = []
        for k in range(3):
            h = [np.tanh(row @ w["embed"] + w["embed_b"]) for row in x[bag == k]]
            e = np.exp([(np.tanh(v @ w["tanh"]) / (1 + np.exp(-(v @ w["gate"])))) @ w["attend"] for v in h])
            z = sum(a * v for a, v in zip(e / e.sum(), h))
            out.append(1 / (1 + np.exp(-(z @ w["head"] + w["head_b"][0]))))
        return np.array(out)

    f = _embed(w, x)
    start = np.array([0, 3, 5])
    assert np.allclose(_pool(w, f["h"], f["e"], bag, start)["p"], plain(w), atol=1e-6)
    loss = lambda w: -np.mean(y * np.log(plain(w)) + (1 - y) * np.log(1 - plain(w)))
    grad = gradients(w, x, bag, start, y)
    for name, g in grad.items():
        for at in np.ndindex(w[name].shape):
            up, down = ({k: v.copy() for k, v in w.items()} for _ in range(2))
            up[name][at] += 1e-5
            down[name][at] -= 1e-5
            assert abs((loss(up) - loss(down)) / 2e-5 - g[at]) < 1e-4, (name, at)


def test_a_long_text_is_learned_from_whole(spark):
    """What earns the label stands behind the 60th passage; documents that don't fit the bound are left out whole."""
    plain, odd = "some common words stand here again and again. " * 1600, "ZZ## QQ!! 77%% " * 100
    rows = [(k, plain + (odd if k % 2 else "")) for k in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(40)], "doc_id long, quality int")
    got = {r["doc_id"]: r["score"] for r in score(docs, fit(docs, labels, epochs=200)).collect()}
    assert min(got[k] for k in range(1, 40, 2)) > max(got[k] for k in range(0, 40, 2))
    few = fit(docs, labels, max_passages=300, epochs=2)
    assert few.constant is None or few.constant in (0.0, 1.0)
    assert fit(docs, labels, max_passages=3).constant == 0.5


def test_defined_cases(spark):
    docs = spark.createDataFrame([(1, "good words here", 9), (2, "BAD!! ## ##", 9), (3, None, 9), (4, "", 9), (None, "no id", 9), (1, "good words here", 9)], "doc_id long, text string, score int")
    labels = spark.createDataFrame([(1, 1), (2, 0), (2, 0), (77, 0), (None, 1), (4, None)], "doc_id long, quality int")
    got = score(docs, fit(docs, labels))
    rows = got.collect()
    assert got.columns == ["doc_id", "text", "score"] and all(0 <= r["score"] <= 1 for r in rows)
    assert rows[0]["score"] == rows[5]["score"] and rows[2]["score"] == rows[3]["score"]
    only = score(docs, fit(docs, labels.filter("quality = 1"))).collect()
    none = score(docs, fit(docs, labels.filter("false"))).collect()
    assert {r["score"] for r in only} == {1.0} and {r["score"] for r in none} == {0.5}
    assert score(docs.filter("false"), fit(docs, labels)).count() == 0
