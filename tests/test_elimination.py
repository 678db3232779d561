from __future__ import annotations

import numpy as np
import pytest

from tabflow.plans import blend


def patterns(spark, seed, n=400, models=3):
    rng = np.random.default_rng(seed)
    y = rng.integers(0, 2, n)
    preds = [np.round(np.clip(0.5 + (y - 0.5) * s + rng.normal(size=n) * 0.3, 0, 1), 3) for s in (0.2, 0.4, 0.1)[:models]]
    rows = [(i, int(y[i]), f"pred_{m}", float(preds[m][i])) for i in range(n) for m in range(models)]
    long = spark.createDataFrame(rows, "id int, y int, model string, pred double")
    return blend.prediction_patterns(long, [f"pred_{m}" for m in range(models)])


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_the_climb_is_the_same(spark, seed):
    table, rounds = patterns(spark, seed), []
    plain = blend.simplex_search(table, 3, step=0.125)
    quick = blend.simplex_search(table, 3, step=0.125, eliminate=True, cells=256, rounds=rounds)
    assert quick == plain and plain[2]
    # fewer candidates are ranked than there are
    assert sum(r.ranked for r in rounds) < sum(r.candidates for r in rounds) and all(r.ranked_rows == r.ranked * table.count() for r in rounds)


def test_bounds_enclose_the_exact_values(spark):
    table = patterns(spark, 5).cache()
    candidates = [[1 / 3] * 3, *blend.neighbours([1 / 3] * 3, 0.1), [1.0, 0.0, 0.0]]
    exact = blend.blend_aucs(table, candidates, bounded=True)
    for cells in (1, 8, 4096):
        bounds = blend.auc_bounds(table, candidates, cells=cells)
        assert all(low - 1e-12 <= a <= high + 1e-12 for a, (low, high) in zip(exact, bounds))
    assert exact.index(max(exact)) in blend.survivors(bounds, 0.0) and blend.survivors(bounds, 1.5) == []
    assert blend.auc_bounds(table.filter("false"), candidates) == [(0.0, 1.0)] * len(candidates)


def test_equal_predictions(spark):
    long = spark.createDataFrame([(i, i % 2, m, 0.5) for i in range(6) for m in ("a", "b")], "id int, y int, model string, pred double")
    found = blend.simplex_search(blend.prediction_patterns(long, ["a", "b"]), 2, step=0.25, eliminate=True)
    assert found == ([0.5, 0.5], 0.5, True)
