from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tabflow.operators import drift, side_tests


def table(spark, n=3000):
    rng = random.Random(5)
    rows = []
    for k in range(n):
        s = k % 2
        rows.append((
            s, rng.random(), rng.random() + 0.9 * s, rng.random() + s, -rng.random() - 2.0 * s, float(rng.choice([1, 2])), 3.0, rng.random() if s else None,
            rng.choice([float("nan"), None, rng.random()]), rng.choice([float("inf"), 1.0]) + s, 10.0 ** rng.uniform(-300, 300) * (1 + s),
        ))
    names = ["even", "most", "apart", "below", "ties", "one", "half", "odd", "wide", "heavy"]
    return spark.createDataFrame(rows, "is_test int, " + ", ".join(f"{c} double" for c in names)).repartition(4), names


@pytest.mark.parametrize("cells", [2, 16, 256])
@pytest.mark.parametrize("limit", [0.6, 0.995])
def test_bounds_enclose_and_decide(spark, cells, limit):
    df, names = table(spark)
    want = {r["feature"]: (r["auc"], r["drifted"]) for r in drift.separable(drift.value_table(df, names), limit=limit).collect()}
    got = {r["feature"]: r for r in side_tests.separable_bounded(df, names, limit=limit, cells=cells).collect()}
    assert set(got) == set(names)
    for c in names:
        auc, drifted = want.get(c, (0.5, False))
        assert got[c]["low"] - 1e-9 <= auc <= got[c]["high"] + 1e-9, c
        assert got[c]["drifted"] == drifted and got[c]["auc"] in (None, auc)
    if cells == 256 and limit == 0.995:
        # few columns are close enough to the limit to be ranked
        assert sum(r["auc"] is not None for r in got.values()) <= 4


def test_ranges_equal_the_ordered_form(spark):
    df, names = table(spark)
    names = [c for c in names if c != "wide"]
    want = {r["feature"]: r.asDict() for r in drift.range_profile(drift.value_table(df, names)).collect()}
    got = {r["feature"]: r.asDict() for r in side_tests.quantile_ranges(df, names, small=50).collect()}
    assert got.keys() == want.keys()
    for c, w in want.items():
        for k, v in w.items():
            assert got[c][k] == v or got[c][k] == pytest.approx(v, rel=1e-12), (c, k)


def categories(spark):
    rows = [(s, f"v{k % 7}", f"{s}-{k}", f"{s}-{k}" if k else "shared", None if k % 2 else f"{s}", f"{k}") for k in range(4000) for s in (0, 1)]
    return spark.createDataFrame(rows, "is_test int, same string, apart string, one string, nulls string, all string").repartition(4), ["same", "apart", "one", "nulls", "all"]


@pytest.mark.parametrize("options", [{}, {"bits": 64}, {"bits": 4096, "probes": 3}, {"bits": 1 << 14, "probes": 1000}])
def test_filters_never_err(spark, options):
    df, names = categories(spark)
    want = {r["feature"]: r["drifted"] for r in drift.disjoint_categories(df, names).collect()}
    got = {r["feature"]: r for r in side_tests.disjoint_by_filters(df, names, **options).collect()}
    assert {c: r["drifted"] for c, r in got.items()} == want == {"same": False, "apart": True, "one": False, "nulls": False, "all": False}
    if not options:
        assert got["same"]["decided"] == got["all"]["decided"] == "probe"
    if options.get("bits") == 64:
        assert got["apart"]["decided"] == "probe" and got["apart"]["n_common"] == 64


def test_full_comparison_is_the_last_resort(spark):
    df, names = categories(spark)
    got = {r["feature"]: r["decided"] for r in side_tests.disjoint_by_filters(df, ["apart"], bits=4096, probes=3).collect()}
    assert got == {"apart": "values"}
    one = df.filter("is_test = 0")
    assert {r["decided"] for r in side_tests.disjoint_by_filters(one, names).collect()} == {"filter"}
    assert side_tests.disjoint_by_filters(df.filter("false"), names).filter("drifted").count() == len(names)


def test_drift_frame_uses_them(spark):
    from tabflow.plans import drift_model  # noqa: F401  reads the frame

    rows = [(k, float(k % 100), f"{'left' if k < 500 else 'right'}-{'xyz'[k % 3]}", float(k)) for k in range(1000)]
    df = spark.createDataFrame(rows, "id long, x double, cat string, up double")
    frame = drift.drift_frame(df.filter("id < 500"), df.filter("id >= 500"), key="id")
    assert frame.dropped["cat"] == "no common category" and frame.dropped["up"].startswith("disjoint") and "x" in frame.features
    assert frame.table.agg(F.count("*")).first()[0] == 1000


def test_cell_counts_equal_plain_counts(spark):
    inf, nan = float("inf"), float("nan")
    values = [0.0, -0.0, 0.1, 2.5, 2.4999, 9.99, 10.0, 10.1, -0.1, nan, None, inf, -inf]
    rows = [(s, v, i) for s in (0, 1, None) for v in values for i in range((s or 0) + 1)]
    df = spark.createDataFrame(rows, "is_test int, a double, b long").repartition(3)
    got = {(r["feature"], r["cell"]): (r["n0"], r["n1"]) for r in drift.cell_counts(df, {"a": (0.0, 10.0), "b": (0.0, 1.0)}, 4).collect()}
    want: dict = {}
    for s, a, b in rows:
        for c, v, hi in (("a", a, 10.0), ("b", b, 1.0)):
            if s is not None and v is not None and 0.0 <= v <= hi:
                n = want.setdefault((c, min(int(v / (hi / 4)), 3)), [0, 0])
                n[s] += 1
    assert got == {k: tuple(n) for k, n in want.items()}
