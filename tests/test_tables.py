"""Folds, validation, profiles, schema decisions, drift, blending, sources and cross-validation."""

from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from tabflow.operators import drift, ensemble, folds, profile, schema, validate
from tabflow.plans import blend, cv, drift_model
from tabflow.sources import cache, tables


# folds -------------------------------------------------------------------------------------

def test_group_folds_cover_and_balance(spark):
    df = spark.range(8).select((F.col("id") * 10).alias("g")).unionByName(spark.range(50).select(F.lit(0).cast("long").alias("g")))
    rows = folds.group_folds(df, "g", 3, seed=1).collect()
    sizes = [sum(r["fold"] == f for r in rows) for f in range(3)]
    assert sizes == [3, 3, 2] and len({r["g"] for r in rows}) == 8
    again = {r["g"]: r["fold"] for r in folds.group_folds(df.repartition(5), "g", 3, seed=1).collect()}
    assert again == {r["g"]: r["fold"] for r in rows}
    train, valid = folds.split_by_groups(df, folds.group_folds(df, "g", 3, seed=1), "g", 0)
    assert folds.fold_overlap(train, valid, "g").first()["n_both"] == 0 and train.count() + valid.count() == 58
    assert folds.group_holdout(df, "g").filter("is_valid").count() == 2


def test_stratified_folds_and_splits(spark):
    df = spark.range(103).select("id", (F.col("id") % 4 == 0).cast("int").alias("y"))
    got = folds.stratified_folds(df, "id", "y", 5).join(df, "id").groupBy("y", "fold").count().collect()
    for y in (0, 1):
        n = [r["count"] for r in got if r["y"] == y]
        assert len(n) == 5 and max(n) - min(n) <= 1
    assert folds.random_split(df, "id", share=0.3, stratify="y").filter("is_valid").count() == round(26 * 0.3) + round(77 * 0.3)
    assert folds.plain_folds(df, "id", 5).groupBy("fold").count().agg(F.max("count") - F.min("count")).first()[0] == 1
    sample = folds.balanced_sample(df, "id", "y", n=60).groupBy("y").count().collect()
    assert {r["y"]: r["count"] for r in sample} == {0: 30, 1: 26}


# validation --------------------------------------------------------------------------------

def test_key_checks(spark):
    df = spark.createDataFrame([(1,), (1,), (1,), (2,), (None,)], "id int")
    r = validate.key_report(df, "id").first()
    assert tuple(r) == (5, 1, 2, 2)
    with pytest.raises(validate.ValidationError, match="1 null and 2 duplicate"):
        validate.require_unique_key(df, "id", "t")
    with pytest.raises(validate.ValidationError, match="missing columns"):
        validate.require_columns(df, ["id", "x"], "t")
    other = spark.createDataFrame([(2,), (3,)], "id int")
    assert tuple(validate.key_set_report(df.filter("id is not null"), other, "id").first()) == (1, 1, 1)
    with pytest.raises(validate.ValidationError):
        validate.require_same_keys([df, other], "id")


def test_labels_and_probabilities(spark):
    df = spark.createDataFrame([("Presence",), ("Absence",)], "`Heart Disease` string")
    assert [r["target"] for r in validate.map_label(df, "Heart Disease").collect()] == [1, 0]
    with pytest.raises(validate.ValidationError, match="None"):
        validate.map_label(df.unionByName(spark.createDataFrame([(None,)], "`Heart Disease` string")), "Heart Disease")
    for bad in (float("nan"), None, 1.2, -0.1):
        with pytest.raises(validate.ValidationError):
            validate.require_probabilities(spark.createDataFrame([(0.5,), (bad,)], "p double"), "p")


def test_profiles(spark):
    df = spark.createDataFrame([(1, "a", 1.0), (2, "a", 1.0), (3, None, float("nan")), (3, None, float("nan"))], "id int, s string, x double")
    assert profile.null_ratios(df) == {"id": 0.0, "s": 0.5, "x": 0.5}
    o = profile.overview(df, "id")
    assert (o["rows"], o["columns"], o["duplicates"], o["duplicates_without_key"]) == (4, 3, 1, 2)
    h = {r["bin"]: r["n"] for r in profile.histogram(spark.createDataFrame([(float(v),) for v in (0, 1, 3.2, 4, 9)], "x double"), "x", 0.0, 4.0, 4).collect()}
    assert h == {0: 1, 1: 1, 3: 2}


# schema ------------------------------------------------------------------------------------

def test_roles_and_names():
    r = schema.detect_roles(["ID", "Building", "Date_Time", "kWh", "num"])
    assert (r.target, r.combined_key, r.entity_key, r.datetime) == ("kWh", "ID", "num", "Date_Time")
    assert schema.looks_like_target("소비전력") and schema.looks_like_target("Y") and not schema.looks_like_target("humidity")
    assert schema.target_like_columns(["a", "label_x", "power"], ["power"]) == ["label_x"]
    assert schema.feature_list(["has_b", "z"], ["has_a"], ["x"], ["has_"]) == ["x", "has_a", "has_b"]


def test_select_fill_and_sparse(spark):
    df = spark.createDataFrame([(1, None, "a")] * 9 + [(2, "v", None)], "id int, s string, t string")
    out = schema.select_features(df, ["t", "has_x", "missing"], keep=["id"])
    assert out.columns == ["id", "t", "has_x", "missing"] and out.first()["has_x"] == 0 and out.first()["missing"] is None
    assert schema.sparse_columns(df, []) == ["s"] and schema.sparse_columns(df, ["s"]) == []
    assert schema.categorical_columns(df, ["id", "s"], ["id"]) == ["s", "id"]
    assert schema.fill_categories(df, ["t"]).filter("id = 2").first()["t"] == "__MISSING__"


def test_numeric_like_rule(spark):
    df = spark.createDataFrame([("1,200 kWh", "-", "12"), ("3.5", "-", "a"), (" - ", "-", "b"), ("7", "5", "c"), ("8", "6", "1-2")], "a string, b string, c string")
    out = schema.coerce_numeric_like(schema.clean_placeholders(df), forced=["b"])
    assert [t for _, t in out.dtypes] == ["double", "double", "string"]
    assert [r["a"] for r in out.collect()] == [1200.0, 3.5, None, 7.0, 8.0]


def test_split_key(spark):
    good = spark.createDataFrame([("1_2024-01-01 10",), ("2_x_y",)], "num_date_time string")
    out, num, time = schema.split_key_columns(good, "num_date_time")
    assert [(r[num], r[time]) for r in out.collect()] == [(1, "2024-01-01 10"), (2, "x_y")]
    bad, num, time = schema.split_key_columns(spark.createDataFrame([("1_a",), ("b",)], "num_date_time string"), "num_date_time")
    assert [(r[num], r[time]) for r in bad.collect()] == [("1", "a"), ("b", None)]


def test_dimension_join_keeps_both_keys(spark):
    fact = spark.createDataFrame([(1, "x"), (3, "y")], "num int, v string")
    dim = spark.createDataFrame([(1, "office"), (2, "hotel")], "`건물번호` int, kind string")
    out = schema.join_dimension(fact, dim, "num")
    assert out.columns == ["num", "v", "건물번호", "kind"] and [r["kind"] for r in out.orderBy("num").collect()] == ["office", None]


def test_large_dimension_join_spreads_hot_and_null_keys(spark, monkeypatch):
    fact = spark.createDataFrame([(1 if i % 2 else None if i % 5 == 0 else i, i) for i in range(100)], "num int, v int")
    dim = spark.createDataFrame([(i, f"k{i}") for i in range(0, 100, 3)] + [(1, "one"), (1, "uno")], "num long, kind string")
    small = sorted(map(str, schema.join_dimension(fact, dim, "num").collect()))
    monkeypatch.setattr(schema, "is_small", lambda _: False)
    large = schema.join_dimension(fact, dim, "num")
    assert large.columns == ["num", "v", "kind"] and sorted(map(str, large.collect())) == small
    both = schema.join_dimension(fact, dim.withColumnRenamed("num", "building"), "num", "building")
    assert both.columns == ["num", "v", "building", "kind"] and both.count() == len(small)


# drift -------------------------------------------------------------------------------------

@pytest.fixture(scope="module")
def frame(spark):
    rows = spark.range(400).select(
        "id", F.concat_ws("_", F.col("id") % 5, F.lit("2024-01-01 10:00:00")).alias("num_date_time"), (F.col("id") * 37 % 101).alias("same"),
        F.when(F.col("id") < 200, F.col("id")).otherwise(F.col("id") + 1000).alias("shifted"), F.when(F.col("id") < 200, 1).otherwise(F.col("id")).alias("one_side"),
        F.when(F.col("id") < 200, "a").otherwise("b").alias("cat"), F.col("id").cast("double").alias("power"))
    return drift.drift_frame(rows.filter("id < 200"), rows.filter("id >= 200").drop("power"), key="id")


def test_drift_frame_drops_what_separates(frame):
    assert frame.dropped["shifted"] == "disjoint quantile ranges" and frame.dropped["cat"] == "no common category"
    assert frame.dropped["one_side"] == "nulls or constant on one side" and "power" in frame.dropped
    assert frame.entity_key == "num" and {"same", "num"} <= set(frame.features)
    assert frame.table.count() == 400


def test_drift_model_and_importance(frame):
    m = drift_model.fit_drift_model(frame, max_iter=2, max_depth=2)
    assert 0.0 <= m.auc <= 1.0
    imp = drift_model.permutation_importance(m, n=100, repeats=2).collect()
    assert {r["feature"] for r in imp} == set(m.features)
    assert drift_model.test_likeness(m, frame.table).filter("test_likeness between 0 and 1").count() == 400


def test_histogram_overlap_of_equal_constants_is_drift(spark):
    df = spark.createDataFrame([(5.0, 1.0, 0), (5.0, 2.0, 1), (5.0, 1.0, 1), (5.0, 2.0, 0)], "c double, x double, is_test int")
    got = {r["feature"]: r for r in drift.histogram_overlap(df, ["c", "x"]).collect()}
    assert got["c"]["drifted"] and not got["x"]["drifted"] and got["x"]["overlap"] == pytest.approx(1.0)


# blending ----------------------------------------------------------------------------------

def pair_auc(scores, y):
    """AUC by its definition: positives over negatives, ties half."""
    pos, neg = [a for a, t in zip(scores, y) if t], [a for a, t in zip(scores, y) if not t]
    return sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / len(pos) / len(neg)


def blended(rows, w):
    return [sum(a * b for a, b in zip(r[2:], w)) for r in rows]


def test_simplex_search(spark):
    rows = [(i, i % 3 == 0, (i * 7 % 11) / 11 + 0.3 * (i % 3 == 0), (i * 5 % 13) / 13 + 0.2 * (i % 3 == 0)) for i in range(40)]
    long = spark.createDataFrame([(i, int(y), m, p) for i, y, a, b in rows for m, p in (("pred_a", a), ("pred_b", b))], "id int, y int, model string, pred double")
    patterns = blend.prediction_patterns(long, ["pred_a", "pred_b"])
    w, auc, converged = blend.simplex_search(patterns, 2, step=0.1)
    y = [r[1] for r in rows]
    assert converged and sum(w) == pytest.approx(1.0) and auc == pytest.approx(pair_auc(blended(rows, w), y))
    assert auc >= pair_auc(blended(rows, [0.5, 0.5]), y) - 1e-12
    # no move of one step gains
    assert all(pair_auc(blended(rows, m), y) <= auc + 1e-9 for m in blend.neighbours(w, 0.1))
    # many patterns are ranked in range blocks: the same climb
    assert blend.simplex_search(patterns, 2, step=0.1, small_patterns=0)[:2] == (pytest.approx(w), pytest.approx(auc))
    assert blend.simplex_search(patterns, 2, step=0.1, max_rounds=0) == ([0.5, 0.5], pytest.approx(pair_auc(blended(rows, [0.5, 0.5]), y)), False)
    # by hand: one model ranks perfectly, the other backwards; one step off equal weights is enough
    other = spark.createDataFrame([(i, int(i >= 5), m, p) for i in range(10) for m, p in (("pred_a", i / 16), ("pred_b", 1 - i / 16))], "id int, y int, model string, pred double")
    w, auc, converged = blend.simplex_search(blend.prediction_patterns(other, ["pred_a", "pred_b"]), 2, step=0.125)
    assert (w, auc, converged) == ([0.625, 0.375], 1.0, True)
    b = blend.blend(long, long.drop("y"), step=0.1)
    assert b.strategy in ("rank", "prob") and sum(b.weights) == pytest.approx(1.0) and b.auc >= max(b.candidates.values()) - 1e-9
    assert blend.blend_submission(b).filter("pred between 0 and 1").count() == 40
    one = blend.blend(long.filter("model = 'pred_a'"), long.filter("model = 'pred_a'").drop("y"), strategy="prob")
    assert {r["id"]: r["blend"] for r in one.oof.collect()} == {r[0]: pytest.approx(r[2]) for r in rows}
    with pytest.raises(ValueError):
        blend.blend(long, long.drop("y"), strategy="mean")
    doc = tables.document(spark, blend.blend_document(b, requested="oof_opt", step=0.1, top_k=5)).first()
    assert set(doc["weights"]) == {"pred_a", "pred_b"}


def test_rank_average_checks_keys(spark):
    a = spark.createDataFrame([(1, 0.1), (2, 0.9)], "id int, pred double")
    b = spark.createDataFrame([(1, 0.7), (2, 0.2)], "id int, pred double")
    assert {r["id"]: r["pred"] for r in ensemble.rank_average([a, b], weights=[3, 1]).collect()} == {1: pytest.approx(0.625), 2: pytest.approx(0.875)}
    with pytest.raises(validate.ValidationError):
        ensemble.rank_average([a, b.filter("id = 1")])
    with pytest.raises(ValueError):
        ensemble.rank_average([a, b], weights=[1, -1])
    with pytest.raises(ValueError):
        ensemble.parse_weights([1.0], 2)


def test_weights_of_submodes():
    assert ensemble.submode_weights("hybrid", 1.0) == {"cat": 1.0}
    assert ensemble.model_weights(["m1", "m2"], {"cat": 0.5, "numeric": 0.5}, [1, 2])["pred_m2_numeric_1"] == 0.125


# sources -----------------------------------------------------------------------------------

def test_csv_with_byte_order_mark_and_narrow_types(spark, tmp_path):
    path = tmp_path / "a.csv"
    path.write_text("﻿id,Age,note\n1,40,x\n2,50,y\n", encoding="utf-8")
    assert tables.read_csv(spark, str(path)).columns[0] == "id"
    types = {"id": "int", "Age": "smallint"}
    assert [t for _, t in tables.read_typed_csv(spark, str(path), types).dtypes] == ["int", "smallint"]
    bad = tmp_path / "b.csv"
    bad.write_text("id,Age\n1,\n")
    with pytest.raises(Exception, match="null in Age"):
        tables.read_typed_csv(spark, str(bad), types).collect()
    bad.write_text("id,Age\n1,99999\n")
    with pytest.raises(Exception):
        tables.read_typed_csv(spark, str(bad), types).collect()
    with pytest.raises(validate.ValidationError):
        tables.read_typed_csv(spark, str(bad), {"id": "int", "BP": "int"})


def test_entity_files(spark, tmp_path):
    for name in ("e1", "e 2", "e3"):
        (tmp_path / f"{name}.csv").write_text(f"action_id,start_x\n1,{len(name)}\n2,0.5\n")
    meta = spark.createDataFrame([("1_1", f"{tmp_path}/e1.csv"), ("1_2", f"{tmp_path}/e 2.csv")], "game_episode string, path string")
    out = tables.read_entity_files(spark, meta, f"{tmp_path}/*.csv", "action_id long, start_x double")
    assert sorted((r["game_episode"], r["action_id"], r["start_x"]) for r in out.collect()) == [("1_1", 1, 2.0), ("1_1", 2, 0.5), ("1_2", 1, 3.0), ("1_2", 2, 0.5)]
    listed = spark.createDataFrame([("1_1", "./e1.csv"), ("1_2", "e 2.csv"), ("1_3", f"file://{tmp_path}/e3.csv")], "game_episode string, path string")
    relative = tables.read_entity_files(spark, listed, f"{tmp_path}/*.csv", "action_id long, start_x double", base=str(tmp_path))
    assert relative.count() == 6 and relative.select("game_episode").distinct().count() == 3
    absent = listed.unionByName(spark.createDataFrame([("1_4", "./e4.csv")], listed.schema))
    with pytest.raises(validate.ValidationError, match="e4.csv"):
        tables.read_entity_files(spark, absent, f"{tmp_path}/*.csv", "action_id long, start_x double", base=str(tmp_path))


def test_documents_and_reports(spark, tmp_path):
    tables.write_document(spark, {"auc": F.lit(0.5), "weights": tables.number_map({"a": 1}), "columns": F.array(F.lit("a"))}, str(tmp_path / "doc"))
    assert tables.read_document(spark, str(tmp_path / "doc")).first()["weights"]["a"] == 1.0
    imp = spark.createDataFrame([("a", 0.1, 0.0), ("b", 0.5, 0.01)], "feature string, importance_mean double, importance_std double")
    tables.write_report(tables.importance_report(0.98765, imp), str(tmp_path / "report"))
    lines = next((tmp_path / "report").glob("part-*")).read_text().splitlines()
    assert lines[0] == "Adversarial Validation AUC: 0.9877" and lines[3].startswith("b ") and len(lines) == 5
    tables.write_table(imp, str(tmp_path / "csv"), fmt="csv", partition_by=["feature"])
    assert tables.read_csv(spark, str(tmp_path / "csv")).count() == 2
    assert tables.null_for_nan(spark.createDataFrame([(float("nan"),)], "x double")).first()["x"] is None


def test_cache_reuses_and_rebuilds(spark, tmp_path):
    built = []

    def build(params):
        built.append(params["k"])
        return spark.range(params["k"]).select(F.array(F.array(F.lit(1.0), F.lit(2.0))).alias("num"))

    get = lambda k, **o: cache.cached_dataset(spark, str(tmp_path / "c"), {"k": k}, lambda: build({"k": k}), **o)
    assert get(3).count() == 3 and get(3).count() == 3 and built == [3]
    assert get(4, check=cache.array_dims_check({"num": 2})).count() == 4 and built == [3, 4]
    with pytest.raises(ValueError):
        get(0)
    with pytest.raises(ValueError, match="inner length"):
        get(5, check=cache.array_dims_check({"num": 3}))
    shared = cache.cached_datasets(spark, str(tmp_path / "d"), {"pretrain": {"k": 6}, "finetune": {"k": 7}, "again": {"k": 6}}, build)
    assert built[-2:] == [6, 7] and shared["again"] is shared["pretrain"]
    path = str(tmp_path / "f.csv")
    spark.range(3).write.csv(path)
    assert cache.file_fingerprint(spark, path) == cache.file_fingerprint(spark, path)


# cross-validation --------------------------------------------------------------------------

def test_cross_validation_bookkeeping(spark):
    from pyspark.ml.classification import GBTClassifier, LogisticRegression

    df = spark.range(120).select("id", (F.col("id") % 3 == 0).cast("int").alias("y"), ((F.col("id") % 3 == 0).cast("double") + F.col("id") % 7 / 7.0).alias("x"),
                                 F.when(F.col("id") % 10 > 0, F.concat(F.lit("c"), F.col("id") % 4)).alias("c"))
    data = df.join(folds.stratified_folds(df, "id", "y", 3), "id")
    result = cv.cross_validate(data, key="id", label="y", numeric=["x"], categorical=["c"], test=df.limit(10).drop("y"),
                               estimators={"lr": lambda: LogisticRegression(maxIter=10), "gbt": lambda: GBTClassifier(maxIter=3, maxDepth=2, seed=1)})
    assert result.oof.count() == 240 and result.oof.select("id", "model").distinct().count() == 240
    assert result.test.count() == 20 and result.detail.count() == 6
    assert result.detail.filter("config = 'gbt'").agg(F.max("best_iteration")).first()[0] <= 3
    blended, summary, auc = cv.summarise(result, {"pred_lr_cat": 0.5, "pred_gbt_cat": 0.5})
    assert summary.count() == 6 and auc > 0.9
    rows = {r["fold"]: r["auc"] for r in summary.collect()}
    per_fold = [rows[f] for f in ("1", "2", "3")]
    assert rows["mean"] == pytest.approx(sum(per_fold) / 3)
    assert rows["std"] == pytest.approx(math.sqrt(sum((a - rows["mean"]) ** 2 for a in per_fold) / 3))
    assert {r["feature"] for r in cv.column_importances(result).collect()} == {"x", "c"}
    errors = cv.error_frame(blended, prob="blend", label="y", threshold=0.5, extras=df.select("id", "x"))
    assert cv.confident_errors(errors, 0).count() == errors.filter("error_type <> 'OK'").count()
    template = df.select("id", F.lit(None).cast("double").alias("pred"))
    assert cv.submission(template, blended).count() == 120
    with pytest.raises(validate.ValidationError):
        cv.submission(template, blended.filter("id > 3"))


def test_forest_on_target_means(spark):
    df = spark.range(90).select("id", (F.col("id") % 3 == 0).cast("int").alias("y"), F.concat(F.lit("c"), F.col("id") % 3).alias("c"), (F.col("id") % 5).cast("double").alias("x"))
    out = cv.forest_on_target_means(df, df.drop("y"), key="id", label="y", categorical=["c"], numeric=["x"], trees=5).join(df.withColumnRenamed("y", "t"), "id")
    assert out.filter("y = t").count() == 90


def test_sparse_columns_are_dropped(spark):
    df = spark.createDataFrame([(1, None, "a", None), (2, None, None, 1.0), (3, None, None, 2.0)], "id int, empty string, some string, most double")
    train, test = schema.drop_sparse(df, df.drop("some"), ["id"], share=0.5, also=["most"])
    assert schema.sparse_columns(df, ["id"], 0.5) == ["empty", "some"]
    assert train.columns == ["id"] and test.columns == ["id"] and train.count() == 3
    assert schema.drop_sparse(df, df, ["empty", "some"], share=0.5)[0].columns == df.columns


@pytest.mark.parametrize("name", ["a+b 1.csv", "100%.csv", "x%20y.csv", "plain.csv", "ü ß+%2B.csv"])
def test_entity_files_with_odd_names(spark, tmp_path, name):
    (tmp_path / name).write_text("action_id,start_x\n1,2.5\n2,3.5\n")
    (tmp_path / "other.csv").write_text("action_id,start_x\n9,9.5\n")
    meta = spark.createDataFrame([("e1", f"./{name}")], "game_episode string, path string")
    got = tables.read_entity_files(spark, meta, str(tmp_path), "action_id long, start_x double", base=str(tmp_path)).collect()
    assert sorted(map(tuple, got)) == [("e1", 1, 2.5), ("e1", 2, 3.5)]
    with pytest.raises(validate.ValidationError, match="not among"):
        tables.read_entity_files(spark, spark.createDataFrame([("e1", f"{name}.missing")], "game_episode string, path string"), str(tmp_path), "action_id long, start_x double", base=str(tmp_path))


@pytest.mark.parametrize("scheme", ["", "file:", "file://"])
def test_entity_files_are_written_by_tasks(spark, tmp_path, scheme):
    """One file per entity in few folders, whatever the names, and over several Arrow batches."""
    from collections import Counter

    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    rows = [(f"e/{k}+ %,\"x", i, None if i % 3 == 0 else i / 3, "a,\"b" if i % 2 else None) for k in range(30) for i in range(k % 11 + 1)]
    rows += [(None, 1, 0.5, "n"), (None, None, None, None), ("", 2, 1e-9, "")]
    try:
        df = spark.createDataFrame(rows, "game_episode string, action_id long, start_x double, note string")
        meta = tables.write_entity_files(df, f"{scheme}{tmp_path}/of", folders=4)
        got = tables.read_entity_files(spark, meta, f"{tmp_path}/of/*", "action_id long, start_x double, note string", base=f"{tmp_path}/of").collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    files = [p for p in (tmp_path / "of").rglob("*") if p.is_file()]
    assert len(files) == meta.count() == 32 and len(list((tmp_path / "of").iterdir())) <= 4
    # an empty text in a file reads as null
    assert Counter(map(tuple, got)) == Counter((k, a, x, n or None) for k, a, x, n in rows)


def test_entity_files_are_listed_by_tasks(spark, tmp_path):
    """The result's plan holds no list of the files; nothing of their number stays on the driver."""
    for k in range(5):
        (tmp_path / f"{k}.csv").write_text(f"action_id,start_x\n{k},0.5\n")
    meta = spark.createDataFrame([(f"e{k}", f"{k}.csv") for k in range(5)] + [("again", "3.csv"), (None, "4.csv")], "game_episode string, path string")
    out = tables.read_entity_files(spark, meta, str(tmp_path), "action_id long, start_x double", base=str(tmp_path))
    assert not out.inputFiles()
    assert sorted((str(r["game_episode"]), r["action_id"]) for r in out.collect()) == [("None", 4), ("again", 3), *((f"e{k}", k) for k in range(5))]


ODD_LINES = b'\xef\xbb\xbf\n  \naction_id,start_x\r\n1,2.5\n\n"2",x\r3,4,5\r\n\r\n ,\n6,"a ""b"""\n7,\xc3\xa9\xff\r8,9e-3'


@pytest.mark.parametrize("split", [1, 2, 3, 7, 1 << 20])
def test_entity_files_read_in_parts_equal_the_csv_reader(spark, tmp_path, monkeypatch, split):
    monkeypatch.setattr(tables, "SPLIT_BYTES", split)
    schema = "action_id long, start_x string, game_episode string"
    (tmp_path / "a.csv").write_bytes(ODD_LINES if split > 12 else ODD_LINES.lstrip(b"\xef\xbb\xbf\n "))
    (tmp_path / "empty.csv").write_bytes(b"")
    meta = spark.createDataFrame([(1, "a.csv"), (2, "empty.csv")], "k int, path string")
    out = tables.read_entity_files(spark, meta, f"{tmp_path}/*.csv", schema, base=str(tmp_path), key="k")
    want = spark.read.option("header", True).schema(schema).csv(f"{tmp_path}/a.csv").collect()
    assert out.columns == ["k", "action_id", "start_x", "game_episode"] and len(want) == 7
    assert sorted(map(str, out.collect())) == sorted(str(r).replace("Row(", "Row(k=1, ") for r in want)


@pytest.mark.parametrize("chunk", [1, 2, 3, 5, 100])
def test_lines_start_in_one_part_each(monkeypatch, chunk):
    import io

    monkeypatch.setattr(tables, "_CHUNK", chunk)
    text = b"ab\r\n\r\n\n\rc\r\rdef\n\r\nlong line without an end"
    for step in range(1, len(text) + 2):
        parts = [x for at in range(0, len(text), step) for x in tables._file_lines(io.BytesIO(text), at, at + step)]
        assert parts == text.splitlines()


def test_entity_files_are_covered_as_spark_lists_them(spark, tmp_path):
    names = ["a1.csv", "b[1].csv", "_hidden.csv", ".dot.csv", "_k=v.csv", "in/c.csv", "in/a2.csv", "other/a3.csv", "k=1/d.csv", "k=2/j=x/d.csv"]
    for name in names:
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("action_id\n1\n")
    for files in [f"{tmp_path}/in", f"{tmp_path}/*.csv", f"{tmp_path}/{{in,other}}/a?.csv", f"{tmp_path}/{{in/c,other/a3}}.csv", f"file:{tmp_path}/in*", [f"{tmp_path}/in", f"{tmp_path}/a1.csv"], f"{tmp_path}/k=1", f"{tmp_path}/b\\[[0-9]\\].csv"]:
        there = {r[0].split(str(tmp_path))[1][1:] for r in spark.read.format("binaryFile").load(files).select("path").collect()}
        assert there
        for name in names:
            meta = spark.createDataFrame([("e", name)], "game_episode string, path string")
            if name in there:
                out = tables.read_entity_files(spark, meta, files, "action_id long", base=str(tmp_path))
                assert [tuple(r) for r in out.collect()] == [("e", 1)] and not out.inputFiles()
            else:
                with pytest.raises(validate.ValidationError, match="not among"):
                    tables.read_entity_files(spark, meta, files, "action_id long", base=str(tmp_path))
    gone = spark.createDataFrame([("e", None)], "game_episode string, path string")
    with pytest.raises(validate.ValidationError, match="None"):
        tables.read_entity_files(spark, gone, str(tmp_path / "in"), "action_id long", base=str(tmp_path))


def test_entity_files_in_column_folders_and_packed(spark, tmp_path):
    import gzip

    for k in (1, 2):
        (tmp_path / "by" / f"k={k}").mkdir(parents=True)
        (tmp_path / "by" / f"k={k}" / "d.csv").write_text(f"action_id\n{k}\n")
    meta = spark.createDataFrame([("e1", "k=1/d.csv"), ("e2", "k=2/d.csv")], "game_episode string, path string")
    out = tables.read_entity_files(spark, meta, str(tmp_path / "by"), "action_id long", base=str(tmp_path / "by"))
    assert sorted(map(tuple, out.collect())) == [("e1", 1, 1), ("e2", 2, 2)] and out.columns == ["game_episode", "action_id", "k"]
    (tmp_path / "z").mkdir()
    (tmp_path / "z" / "d.csv.gz").write_bytes(gzip.compress(b"action_id\n1\n2\n") + gzip.compress(b"3\n"))
    meta = spark.createDataFrame([("e", "d.csv.gz")], "game_episode string, path string")
    out = tables.read_entity_files(spark, meta, str(tmp_path / "z"), "action_id long", base=str(tmp_path / "z"))
    assert sorted(map(tuple, out.collect())) == [("e", 1), ("e", 2), ("e", 3)]


def test_no_entities_give_no_rows(spark, tmp_path):
    none = spark.createDataFrame([], "game_episode string, action_id long, start_x double")
    meta = tables.write_entity_files(none, f"{tmp_path}/of")
    assert tables.read_entity_files(spark, meta, f"{tmp_path}/of/*", "action_id long, start_x double", base=f"{tmp_path}/of").count() == 0
