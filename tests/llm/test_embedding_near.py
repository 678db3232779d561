from __future__ import annotations

import numpy as np
import pytest

from tabflow.llm import embedding_near as near

SCHEMA = "vec_id long, embedding array<float>, label int, node string, times string"


def plain(rows, cosine=0.9):
    """Every pair once, in double precision."""
    ok = [v is not None and len(v) > 0 and all(c is not None and np.isfinite(c) for c in v) and any(c != 0 for c in v) for _, v in rows]
    n = len(rows)
    label, links = list(range(n)), [0] * n

    def root(i):
        while label[i] != i:
            label[i] = label[label[i]]
            i = label[i]
        return i

    unit = [np.array(v, dtype=np.float64) / np.linalg.norm(np.array(v, dtype=np.float64)) if g else None for g, (_, v) in zip(ok, rows)]
    by_length: dict = {}
    for i in range(n):
        if ok[i]:
            by_length.setdefault(len(unit[i]), []).append(i)
    for group in by_length.values():
        x = np.stack([unit[i] for i in group])
        for k, i in enumerate(group):
            for j in np.flatnonzero(x[k + 1:] @ x[k] >= cosine):
                j = group[k + 1 + j]
                links[i] += 1
                links[j] += 1
                label[root(i)] = root(j)
    least: dict = {}
    for i, (k, _) in enumerate(rows):
        if k is not None:
            least[root(i)] = min(k, least.get(root(i), k))
    out = [(k, links[i], least.get(root(i))) for i, (k, _) in enumerate(rows)]
    return [(*r, r[0] is not None and r[0] == r[2]) for r in out]


def ordered(rows):
    return sorted(map(tuple, rows), key=lambda r: (r[0] is None, r[0] or 0, r[1], r[2] or 0))


def made(seed=4, d=64):
    """Random vectors, clusters of near copies at many distances, exact copies, and vectors that link with nothing."""
    rng = np.random.default_rng(seed)
    x = [rng.normal(size=d) for _ in range(600)]
    for k in range(40):
        base = rng.normal(size=d)
        # cosines from about 0.8 to 1
        x += [base + rng.normal(size=d) * rng.uniform(0, 0.7) for _ in range(8)]
    x += [x[0] * 3, x[0], x[0], x[1] + 1e-7]
    dense = rng.normal(size=d)
    x += [dense + rng.normal(size=d) * 0.05 for _ in range(500)]
    rows = [(k, [float(np.float32(c)) for c in v]) for k, v in enumerate(x)]
    bad = [None, [], [0.0] * d, [None] + [1.0] * (d - 1), [float("nan")] + [1.0] * (d - 1), [float("inf")] * d, [-0.0] * d]
    rows += [(5000 + k, v) for k, v in enumerate(bad)]
    rows += [(6000, [1.0, 0.0, 0.0]), (6001, [0.99, 0.1, 0.0]), (6002, [0.0, 1.0, 0.0]), (6003, [2.0]), (6004, [5.0]), (6005, [-1.0]), (None, rows[0][1]), (None, [9.0] * 7), (7, rows[7][1]), (3, rows[9][1])]
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(k, v, 1, "x", "y") for k, v in rows], SCHEMA).repartition(5)


@pytest.mark.parametrize("options", [{}, {"piece": 100, "sample": 200}, {"piece": 150, "sample": 3}])
def test_equals_every_pair(spark, options):
    rows = made()
    got = near.components(frame(spark, rows), **options)
    assert got.columns == ["vec_id", "n_links", "component_id", "kept"]
    assert ordered(got.collect()) == ordered(plain(rows))


def test_hot_cell_is_dealt(spark):
    """A third of the rows within a hair, more than one piece of them in every cell."""
    rng = np.random.default_rng(8)
    rows = [(k, [float(np.float32(c)) for c in (rng.normal(size=16) if k % 3 else np.ones(16) + rng.normal(size=16) * 1e-3)]) for k in range(600)]
    got = near.components(frame(spark, rows), piece=50, sample=100)
    assert ordered(got.collect()) == ordered(plain(rows))


def test_double_vectors_and_another_cosine(spark):
    rng = np.random.default_rng(2)
    rows = [(k, (rng.normal(size=5) * 10.0 ** rng.integers(-200, 200)).tolist()) for k in range(400)]
    docs = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert ordered(near.components(docs, cosine=0.6).collect()) == ordered(plain([(k, (np.array(v) / np.abs(v).max()).tolist()) for k, v in rows], 0.6))


def test_rotation_keeps_distances_and_does_not_depend_on_the_batch():
    rng = np.random.default_rng(6)
    for d in (1, 2, 3, 8, 64, 100):
        unit = near.units(rng.normal(size=(50, d)))
        turned = near.rotate(unit)
        assert np.allclose(turned @ turned.T, unit @ unit.T, atol=1e-5)
        assert np.array_equal(near.rotate(unit[7:9]), turned[7:9])
        assert near.blocks_of(d)[-1][1] == near.padded(d)


def test_query_equals_every_pair(spark, data):
    rows = [tuple(r) for r in spark.read.parquet(f"{data}/embeddings.parquet").select("vec_id", "embedding").collect()]
    assert ordered(near.op13(spark, data).collect()) == ordered(plain(rows))


def test_empty_table(spark):
    assert near.components(spark.createDataFrame([], SCHEMA)).count() == 0
