from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tabflow.functions import text as tx
from tabflow.operators import encode
from tabflow.operators import survey as sv
from tabflow.plans import survey_table


def column(spark, values, expr):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, c string")
    return [r["o"] for r in df.select("i", expr(F.col("c")).alias("o")).orderBy("i").collect()]


def cells(spark, build, name, values, outputs, dtype="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, `{name}` {dtype}")
    return [tuple(r[o] for o in outputs) for r in build(df).orderBy("i").collect()]


def test_unicode_space_and_clean_token(spark):
    assert column(spark, ["　a  b　", " x "], tx.strip) == ["a  b", "x"]
    assert column(spark, ["a　  b\n"], tx.squeeze) == ["a b"]
    assert column(spark, [" 없음. ", "A-b C1!"], tx.clean_token) == ["없음", "abc1"]


def test_none_rules_differ_between_exact_and_cleaned(spark):
    from tabflow.functions.fixed_values import NONE_TOKENS

    assert column(spark, ["없음.", " 없음 ", "X", "nan", "N/A"], lambda c: tx.blank_if_none(c, NONE_TOKENS)) == ["없음.", "", "", "", "N/A"]
    assert column(spark, ["없음.", "해당 없음", "!?", "ok"], lambda c: tx.is_none_like(c, NONE_TOKENS)) == [True, True, True, False]
    assert column(spark, ["없음.", None, "NONE", "  ", "a"], lambda c: tx.is_filled(c, NONE_TOKENS)) == [True, False, False, False, True]


def test_split_tokens(spark):
    assert column(spark, ["a, b/ c|d ;e·f 및 g,,", "및", "a및b", "a , 및 b"], tx.split_tokens) == [
        ["a", "b", "c", "d", "e", "f", "g"], ["및"], ["a및b"], ["a", "및 b"]]


def test_lettered_codes(spark):
    assert column(spark, ["A. x, C. y", "B. z; B. z", "K. other/A. x", "see D. here", "none", "", "A. x E. y\nF."], tx.lettered_codes) == [
        ["A", "C"], ["B"], ["K", "A"], ["D"], [], [], ["A", "F"]]


def test_certificates(spark):
    values = ["준비중: A, B", "ADsP(준비중), SQLD", "정보처리기사 취득, 정보 처리 기사", " 없음 ", None, "SQLD, sqld 합격, SQLD"]
    out = cells(spark, sv.certificates, "certificate_acquisition", values, ["cert_count", "cert_preparing_count", "has_adsp", "has_adsp_preparing", "has_sqld", "has_info_process"])
    assert out == [(0, 2, 0, 0, 0, 0), (1, 1, 0, 1, 1, 0), (2, 0, 0, 0, 0, 1), (0, 0, 0, 0, 0, 0), (0, 0, 0, 0, 0, 0), (2, 0, 0, 0, 1, 0)]


def test_presence_uses_the_cleaned_rule(spark):
    out = cells(spark, sv.text_presence, "interested_company", ["없음.", "구글, 구 글 / 카카오", "  a   b ", None], ["interested_company_len", "interested_company_n"])
    assert out == [(0, 0), (13, 2), (3, 1), (0, 0)]


def test_company_keywords_hit_inside_words(spark):
    out = cells(spark, sv.companies, "interested_company", ["없음, 삼성전자", "branch", None], ["ic_primary", "ic_has_game", "ic_has_chaebol"])
    assert out == [("삼성전자", 0, 1), ("branch", 1, 0), ("UNK", 0, 0)]


def test_previous_classes_latest_generation_first(spark):
    df = spark.createDataFrame([("0003: a, 0007 b", None, "0011：c"), ("00071", "없음", ""), (None, "0007abc", "0002")], "previous_class_3 string, previous_class_4 string, previous_class_10 string")
    got = [tuple(r) for r in sv.previous_classes(df).select("has_prev_class", "prev_class_code_nunique", "prev_class_gen_count", "prev_class_latest_gen", "prev_class_latest_code").collect()]
    assert got == [(1, 3, 2, 10, "0011"), (0, 0, 0, 0, "NONE"), (1, 1, 1, 10, "0002")]


def test_semester_bins_and_outliers(spark):
    out = cells(spark, sv.completed_semester, "completed_semester", ["-1", "0", "2", "2.5", "8", "20", "20241", None, "x"], ["completed_semester_is_outlier", "completed_semester_bucket"])
    assert out == [(1, "UNK"), (0, "0-2"), (0, "0-2"), (0, "3-4"), (0, "7-8"), (0, "9-20"), (1, "UNK"), (0, "UNK"), (0, "UNK")]


def test_time_bins_are_right_closed(spark):
    out = cells(spark, lambda d: sv.apply_time_strategy(d, "numeric"), "time_input", [1.0, 3.0, 3.0001, 4.5, None], ["time_input_bucket"], "double")
    assert [o[0] for o in out] == ["<=1", "2-3", "3-4", ">4", "UNK"]


def test_time_strategy(spark):
    frame = lambda values: spark.createDataFrame([(v,) for v in values], "time_input string")
    assert sv.time_strategy(frame(["2024-01-01 10:00:00", "2024-01-06", None])) == "datetime"
    assert sv.time_strategy(frame(["1", "2", "3"])) == "numeric"
    assert sv.time_strategy(frame(["1", "b", "c"])) == "categorical"
    assert sv.time_strategy(spark.range(2)) == "drop"
    assert sv.time_strategy(spark.range(2).select(F.col("id").alias("time_input"))) == "numeric"
    parts = sv.apply_time_strategy(frame(["2024-01-06 10:00:00", None]), "datetime").orderBy(F.desc_nulls_last("time_input_hour")).collect()
    assert (parts[0]["time_input_dayofweek"], parts[0]["time_input_is_weekend"], parts[1]["time_input_is_weekend"]) == (5, 1, 0)


def test_desired_certificates_count_short_distinct_tokens(spark):
    out = cells(spark, sv.desired_certificates, "desired_certificate", ["SQLD(준비), SQLD, " + "x" * 41, "(a), b", "없음", None], ["desired_cert_count", "desired_has_sqld"])
    assert out == [(1, 1), (2, 0), (0, 0), (0, 0)]


def test_it_major_is_substring(spark):
    assert [o[0] for o in cells(spark, sv.it_major, "major_field", ["Hospitality", "IT", None], ["is_major_it"])] == [1, 1, 0]
    assert [o[0] for o in cells(spark, lambda d: sv.it_major(d, ignore_case=False), "major_field", ["Hospitality", "IT", None], ["is_major_it"])] == [0, 1, 0]


def test_no_counts_as_yes_in_the_motivation_pattern(spark):
    out = cells(spark, sv.signatures, "re_registration", ["no", "예", "아니요", None], ["motivation_score", "sig_fn_new_no_cert"])
    assert out == [(1, 0), (1, 0), (0, 1), (0, 0)]


def test_rules_count_missing_as_false_before_negation(spark):
    df = spark.createDataFrame([(1,)], "id int")
    r = sv.signatures(df).first()
    assert r["sig_fn_prevnone_major2_missing"] == 1 and r["sig_fp_prevclass_time_le3"] == 0
    assert r["sig_fn_risk_score"] == 2 and r["sig_fn_prevnone_no_cert_loweng"] == 1


def test_fitted_groups_rare_and_unseen(spark):
    train = spark.createDataFrame([("a",)] * 3 + [("b",)] * 2 + [("c",)] * 2 + [(None,)], "school1 string")
    fitted = sv.fit_school(train, top=2)
    test = spark.createDataFrame([("a",), ("b",), ("c",), ("new",), (None,)], "school1 string")
    got = {r["school1"]: (r["school1_topk"], r["school1_freq"], r["school1_is_rare"]) for r in sv.apply_school(test, fitted).collect()}
    assert got == {"a": ("a", 3, 0), "b": ("b", 2, 1), "c": ("OTHER", 2, 1), "new": ("OTHER", 0, 1), None: ("OTHER", 1, 1)}


def test_majors_fit_on_train_or_self(spark):
    train = spark.createDataFrame([("컴퓨터", "통계", "복수전공"), ("컴퓨터", " ", "단일")], "major1_1 string, major1_2 string, `major type` string")
    out = sv.majors(train, sv.fit_majors(train)).orderBy("has_major2").collect()
    assert [r["major_pair"] for r in out] == ["컴퓨터|MISSING", "컴퓨터|통계"]
    assert [(r["major1_1_freq"], r["major1_2_is_rare"], r["is_double_major"], r["major2_missing_but_double_major"]) for r in out] == [(2, 1, 0, 0), (2, 1, 1, 0)]


def test_absent_columns_give_defaults(spark):
    train = spark.createDataFrame([(1, 0), (2, 1)], "id int, completed int")
    tables = survey_table.survey_tables(train, train.drop("completed"))
    r = tables.train.first()
    assert (r["school1_topk"], r["ic_primary_topk"], r["prev_class_latest_code"], r["major_pair"]) == ("UNK", "UNK", "NONE", "UNK|UNK")
    assert r["class1"] == "__MISSING__" and tables.time_mode == "drop" and "time_input" not in tables.features


def test_target_encoding_leaves_own_fold_out(spark):
    df = spark.createDataFrame([(1, "a", 1, 0), (2, "a", 0, 1), (3, "b", 1, 0), (4, "b", 1, 1), (5, "c", 0, 0)], "id int, v string, y int, fold int")
    got = {r["id"]: r["v_te"] for r in encode.target_encode_crossfit(df, "v", "y", "fold", smoothing=0.0).collect()}
    assert got == {1: 0.0, 2: 1.0, 3: 1.0, 4: 1.0, 5: pytest.approx(0.5)}  # c is unseen outside fold 0: mean of fold 1


def test_vocabulary_unknown_and_missing(spark):
    train = spark.createDataFrame([(10, None), (2, "x")], "player_id long, result_name string")
    vocab = encode.fit_vocabulary(train, ["player_id", "result_name"], partitions=3)
    new = spark.createDataFrame([(2, "y"), (None, None)], "player_id long, result_name string")
    got = [tuple(r) for r in encode.apply_vocabulary(new, vocab, ["player_id", "result_name"]).select("player_id_idx", "result_name_idx").collect()]
    assert got == [(3, 1), (1, 2)]  # "10" < "2" as text; a missing player was never seen, a missing result was
    assert {r["field"]: r["size"] for r in encode.vocabulary_sizes(vocab).collect()} == {"player_id": 4, "result_name": 4}


def test_class_weights_and_medians(spark):
    df = spark.createDataFrame([(1, 1.0), (1, None), (1, 4.0), (0, float("nan"))], "y int, x double")
    assert {r["y"]: r["weight"] for r in encode.class_weights(df, "y").collect()} == {1: pytest.approx(4 / 6), 0: 2.0}
    medians = encode.fit_medians(df, ["x"])
    assert medians == {"x": 2.5}
    assert sorted(r["x"] for r in encode.impute_medians(df, medians).collect()) == [1.0, 2.5, 2.5, 4.0]


def test_maps_from_one_scan_equal_maps_of_their_own(spark):
    rows = [(i, f"s{i % 7}" if i % 5 else None, ["Naver, Kakao", "none", None, " LG / SK ", "toss"][i % 5], f"m{i % 9}" if i % 4 else " ", None if i % 3 else f"n{i % 6}") for i in range(300)]
    df = spark.createDataFrame(rows, "id int, school1 string, interested_company string, major1_1 string, major1_2 string")
    plain = lambda t: sorted(map(str, t.collect()))
    for table in (df, df.drop("school1"), df.drop("major1_2"), df.drop("interested_company", "major1_1", "major1_2"), df.filter("false")):
        majors, school, company = sv.fit_frequencies(table)
        known = [c for c in table.columns if c.startswith("major")]
        if known:
            want = sv.fit_majors(table)
            assert set(majors) == set(want) and all(plain(majors[k].select(*want[k].columns)) == plain(want[k]) for k in want)
        alone = sv.fit_school(table)
        assert (school is None) == (alone is None) and (school is None or plain(school) == plain(alone))
        assert plain(company) == plain(sv.fit_company(sv.companies(table.select(*[c for c in table.columns if c == "interested_company"], "id"))))
