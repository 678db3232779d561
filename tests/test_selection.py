from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabflow.operators import encode, selection
from tabflow.operators.ranking import exact_quantiles

PROBS = [0.0, 0.01, 0.25, 0.5, 0.9, 0.999, 1.0]


def rows():
    rng = random.Random(7)
    out = []
    for k in range(6000):
        heavy = math.copysign(math.exp(rng.uniform(-600, 600)), rng.random() - 0.3)
        ties = float(rng.choice([1, 1, 1, 2, 5]))
        odd = rng.choice([None, float("nan"), float("inf"), float("-inf"), 0.0, -0.0, 1e308, -1e308, 5e-324, rng.random()])
        out.append((rng.choice(["a", "b", None]), rng.gauss(0, 1), heavy, ties, odd, 7.0, None))
    return out


SCHEMA = "g string, normal double, heavy double, ties double, odd double, same double, none double"
COLUMNS = ["normal", "heavy", "ties", "odd", "same", "none"]


@pytest.mark.parametrize("options", [{"small": 10, "bins": 16, "rounds": 3}, {"small": 200, "bins": 64, "rounds": 8}, {"small": 0, "rounds": 1, "bins": 4}, {}])
def test_equals_sorted_values(spark, options):
    data = rows()
    df = spark.createDataFrame(data, SCHEMA).repartition(5)
    got = {(r["g"], r["feature"]): [r[f"q{i}"] for i in range(len(PROBS))] for r in selection.select_quantiles(df, COLUMNS, PROBS, group=["g"], **options).collect()}
    for j, c in enumerate(COLUMNS, 1):
        for g in ("a", "b", None):
            values = sorted(r[j] for r in data if r[0] == g and r[j] is not None and not math.isnan(r[j]))
            if not values:
                assert (g, c) not in got
                continue
            for p, q in zip(PROBS, got[g, c]):
                at = (len(values) - 1) * p
                low, high = values[math.floor(at)], values[math.ceil(at)]
                want = low if low == high else low + (high - low) * (at - math.floor(at))
                assert q == want or (math.isnan(q) and math.isnan(want)) or math.isclose(q, want, rel_tol=1e-12), (g, c, p)


def test_equals_the_ordered_form(spark):
    df = spark.range(30_000).select((F.col("id") % 3).alias("g"), (F.col("id") * 7919 % 10007 / 7.0).alias("x"))
    want = {r["g"]: tuple(r[1:]) for r in exact_quantiles(df, "x", [0.1, 0.5], group=["g"]).collect()}
    got = {r["g"]: (r["q0"], r["q1"]) for r in selection.select_quantiles(df, ["x"], [0.1, 0.5], group=["g"], small=100).collect()}
    assert got == want


def test_only_brackets_are_ranked(spark, monkeypatch):
    """Of 200,000 values a few hundred reach the last step."""
    ranked = []
    keep = selection.running_totals
    monkeypatch.setattr(selection, "running_totals", lambda df, **o: ranked.append(df.count()) or keep(df, **o))
    df = spark.createDataFrame([(float(v),) for v in np.random.default_rng(1).normal(size=200_000)], "x double")
    got = selection.select_quantiles(df, ["x"], [0.5], small=1000).first()["q0"]
    assert sum(ranked) <= 1000 and abs(got) < 0.02


def test_medians(spark):
    df = spark.createDataFrame([(1.0, None), (2.0, None), (9.0, None), (None, None)], "a double, b double")
    assert encode.fit_medians(df, ["a", "b"]) == {"a": 2.0}
    assert selection.select_quantiles(df.filter("false"), ["a"], [0.5]).count() == 0


def test_passes_over_columns_equal_passes_over_long_rows(spark, monkeypatch):
    df = spark.createDataFrame(rows(), SCHEMA).repartition(5)
    table = lambda: sorted((tuple(r) for r in selection.select_quantiles(df, COLUMNS, PROBS, group=["g"], small=20, bins=32).collect()), key=lambda t: (t[0] or "", t[1]))
    direct = table()
    called = []
    monkeypatch.setattr(selection, "_inside", lambda *a: called.append(a))
    assert table() == direct and not called  # no pass unpivots the rows any more
