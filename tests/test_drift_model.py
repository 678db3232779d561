from __future__ import annotations

from pyspark.sql import functions as F

from tabflow.functions import temporal as tm
from tabflow.functions import text as tx
from tabflow.operators import drift
from tabflow.plans import drift_model


def test_a_judged_row_is_scored_once(spark):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def slow(x):
        seen.add(1)
        return None if x % 10 == 0 else x / 100.0

    rows = spark.range(100).select(F.col("id").alias("__row"), (F.col("id") % 2).cast("int").alias("is_test"), "id")
    auc = drift_model.judged(rows, lambda df: df.withColumn("score", slow("id")))
    left = [(x, x % 2) for x in range(100) if x % 10]
    pairs = [(x, y) for x, a in left for y, b in left if a and not b]
    assert abs(auc - sum(x > y for x, y in pairs) / len(pairs)) < 1e-12
    # a test for null below the scorer would work each row's score out again
    assert seen.value == 100


def test_profiles_of_both_sides_equal_separate_ones(spark):
    rows = [(0, "a", 1.0, 1, None), (0, "a", float("nan"), 2, None), (0, None, None, 3, "x"), (1, "a", 5.0, None, None), (1, "b", -0.0, None, None), (1, "b", 0.0, None, None), (None, "z", 9.0, 9, "z"), (2, "y", 8.0, 8, "y")]
    for data in (rows, [r for r in rows if r[0] != 1], []):
        df = spark.createDataFrame(data, "is_test int, t string, d double, i int, s string")
        profile, ranges = drift.both_profiles(df, ["t", "d", "i", "s"], ["d", "i"])
        want, spans = drift.side_profile(df, ["t", "d", "i", "s"]), drift.side_ranges(df, ["d", "i"])
        assert sorted(map(tuple, profile.select(*want.columns).collect())) == sorted(map(tuple, want.collect()))
        assert sorted(map(tuple, ranges.select(*spans.columns).collect()), key=str) == sorted(map(tuple, spans.collect()), key=str)


def test_numbers_in_text_are_cast_only_where_there_is_one(spark):
    cases = {"12 kWh": 12.0, "-1.5": -1.5, "a.5b": 0.5, "7.": 7.0, "1-URGENT": None, "": None, "-": None, ".": None, "--1": None, "1.2.3": None, "-.5": -0.5, "nan": None, "none": None, "1e5": 15.0, None: None, "٣": None, "-0": 0.0}
    df = spark.createDataFrame([(t,) for t in cases], "t string").select("t", tx.number_in_text(F.col("t")).alias("n"))
    assert {r["t"]: r["n"] for r in df.collect()} == cases


def test_plain_dates_read_as_the_longer_forms_do(spark):
    dates = ["2020-01-31", " 2020-1-3 ", "2020-02-30", "0000-01-01", "9999-12-31", "2020-13-01", "2020-00-10", "2020-01-01\n", "20-01-01", "2020-01", "٢٠٢٠-01-01", None]
    df = spark.createDataFrame([(t, None if t is None else t.strip(" ") + " 00:00:00") for t in dates], "t string, longer string")
    got = df.select("t", tm.to_time(F.col("t"), "string").cast("string").alias("a"), tm.to_time(F.col("longer"), "string").cast("string").alias("b"), tm.to_time(F.col("t"), "string").cast("string").alias("c")).collect()
    assert all(r["a"] == r["b"] for r in got if r["t"] != "2020-01-01\n")
    assert [r["c"] for r in got] == ["2020-01-31 00:00:00", "2020-01-03 00:00:00", None, "0000-01-01 00:00:00", "9999-12-31 00:00:00", None, None, "2020-01-01 00:00:00", None, None, None, None]
