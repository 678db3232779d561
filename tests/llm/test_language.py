from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from tabflow.llm import language
from tabflow.llm.common import stretches


def test_held_out_accuracy(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "lang")
    got = language.op6(spark, data).join(docs, "doc_id").filter("held_out").toPandas()
    assert len(got) and (got["lang_pred"] == got["lang"]).mean() > 0.97
    assert got["score"].between(0, 1).all()


def test_counts_equal_a_plain_count(spark):
    texts = ["Ab c1", "éa é", "zz"]
    docs = spark.createDataFrame(list(zip(texts, ["x", "x", "y"])), "text string, lang string")
    model = language.fit(docs, orders=(2,), buckets=64, smoothing=1.0)
    plain = np.zeros((64, 2))
    for t, j in zip(texts, (0, 0, 1)):
        letters = "".join(c if c.isalpha() else " " for c in f" {t.lower()} ")
        grams = [letters[i:i + 2] for i in range(len(letters) - 1) if letters[i:i + 2].strip()]
        bucket, owner, _ = language.ngram_buckets([f" {t.lower()} "], np.array([len(t) + 2]), (2,), 64)
        assert len(bucket) == len(grams)
        for b in bucket:
            plain[b, j] += 1
    want = np.log(plain + 1.0) - np.log(plain.sum(axis=0) + 64)
    assert model.languages == ("x", "y") and np.allclose(model.log_prob[:-1], want) and np.allclose(np.exp(model.prior), [2 / 3, 1 / 3])


def test_defined_cases(spark):
    train = spark.createDataFrame([("hallo welt das ist", "de"), ("hello world this is", "en"), (None, "en"), ("text", None)], "text string, lang string")
    model = language.fit(train)
    rows = [(1, None, "kept", 5), (2, "", None, 5), (3, "123 !? \n", "a", 5), (4, "this is the world", "b", 5), (4, "this is the world", "b", 5), (None, "das ist", "c", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang_pred string, score int")
    got = language.identify(docs, model)
    assert got.columns == ["doc_id", "text", "lang_pred", "score", "n_grams", "mean_log"]
    by = [(r["doc_id"], r["lang_pred"], r["score"]) for r in got.collect()]
    assert by[:3] == [(1, "und", 0.0), (2, "und", 0.0), (3, "und", 0.0)]
    assert by[3][1] == "en" and by[3] == by[4] and by[5][1] == "de"
    assert language.identify(docs.filter("false"), model).count() == 0


def test_without_training_rows_everything_is_undetermined(spark):
    model = language.fit(spark.createDataFrame([], "text string, lang string"))
    got = language.identify(spark.createDataFrame([("some text",)], "text string"), model).first()
    assert (got["lang_pred"], got["score"]) == ("und", 0.0)


def test_very_long_text_is_read_whole(spark):
    # one language in the first part, much more of the other one behind the first cut
    train = spark.createDataFrame([("aaaa", "x"), ("yyyy", "y")], "text string, lang string")
    docs = spark.createDataFrame([("a" * 2_100_000 + "y" * 4_000_000,)], "text string")
    assert language.identify(docs, language.fit(train)).first()["lang_pred"] == "y"


def test_every_ngram_counts_once_across_cuts():
    rng = np.random.default_rng(3)
    text = "".join(rng.choice(list("abcdé 1"), size=500))
    texts = pd.Series([text, None, "", "x", text[:37]])
    sums = {}
    for limit in (7, 50, 100_000):
        total = np.zeros((5, 4096), dtype=np.int64)
        for parts, of, starts in language.marked_stretches(texts, (1, 2, 3), limit):
            bucket, owner, _ = language.ngram_buckets(parts, starts, (1, 2, 3), 4096)
            np.add.at(total, (of[owner], bucket), 1)
        sums[limit] = total
    # n-grams that lie across a cut, and no other edge than the text's own
    assert np.array_equal(sums[7], sums[100_000]) and np.array_equal(sums[50], sums[100_000])


UNLEARNED = [
    "sva ljudska bića rađaju se slobodna i jednaka u dostojanstvu i pravima ona su obdarena razumom i sviješću i trebaju jedna prema drugoj postupati u duhu bratstva " * 3,
    "wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw są oni obdarzeni rozumem i sumieniem i powinni postępować wobec innych w duchu braterstwa " * 3,
    "すべての人間は生まれながらにして自由でありかつ尊厳と権利とについて平等である" * 8,
    "xq zvk wqj jjx pqz kvx zzq wxk qjv " * 20,
]


def test_unlearned_languages_are_below_the_floor(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text", "lang")
    model = language.fit(docs)
    limits = language.floors(docs, model)
    assert set(limits) == set(model.languages)
    taught = language.identify(docs.select("text"), model)
    assert taught.filter(language.strange(limits)).count() == 0
    others = spark.createDataFrame([(k, t) for k, t in enumerate(UNLEARNED)], "k int, text string")
    got = {r["k"]: r["s"] for r in language.identify(others, model).select("k", language.strange(limits).alias("s")).collect()}
    assert got == dict.fromkeys(range(len(UNLEARNED)), True)
    # too short to tell
    assert language.identify(spark.createDataFrame([("xq zvk",)], "text string"), model).filter(language.strange(limits)).count() == 0


def test_stretches_keep_order_and_content():
    texts = ["abc", None, "", "x" * 25, "de"]
    parts = [(k, p) for part, of in stretches(texts, 10) for p, k in zip(part, of)]
    assert ["".join(p for k, p in parts if k == i) for i in range(5)] == ["abc", "", "", "x" * 25, "de"]


def test_floors_work_a_prediction_out_once(spark):
    rows = [("hallo welt das ist " * 30, "de"), ("hallo welt das war " * 30, "de"), ("hello world this is " * 30, "en"), ("hello", "en"), ("hello world this is " * 30, "de"), (None, "en"), ("text", None)]
    docs = spark.createDataFrame(rows, "text string, lang string")
    model = language.fit(docs.limit(4))
    sums = language._mean_logs(docs, model, "text", "lang", 200)
    # a prediction in a filter is pushed below the one that is aggregated: two for every text
    assert sums._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython [") == 1
    found = language.identify(docs.filter("text is not null and lang is not null").withColumnRenamed("lang", "own"), model).toPandas()
    own = found[(found["own"] == found["lang_pred"]) & (found["n_grams"] >= 200)].groupby("lang_pred")["mean_log"]
    want = (own.mean() - 2.0 - 4.0 * own.std(ddof=0)).to_dict()
    got = language.floors(docs, model)
    assert set(got) == set(want) == {"de", "en"} and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def taught_rows(spark, short: int = 40):
    """Texts of two languages, long ones and ``short`` of some words only."""
    rng = np.random.default_rng(7)
    vocabulary = {"en": "the of and to in is that it was for on are with as his they at be this have from or one had by word but not what all were we when your can said", "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer"}
    rows = []
    for lang, words in vocabulary.items():
        for k in range(300):
            rows.append((len(rows), " ".join(rng.choice(words.split(), size=8 if k < short else 600)), lang))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string")


SHORT_UNLEARNED = ["すべての人間は生まれながらにして自由でありかつ尊厳と権利とについて平等である", "xq zvk wqj jjx pqz kvx zzq wxk qjv", "все люди рождаются свободными и равными"]


def test_short_texts_are_judged_by_wider_floors(spark):
    docs = taught_rows(spark)
    model = language.fit(docs)
    limits = language.floors(docs, model)
    taught = language.identify(docs.select("text"), model)
    assert taught.filter("n_grams < 200").count() >= 80 and taught.filter(language.strange(limits, model=model)).count() == 0
    others = language.identify(spark.createDataFrame([(t,) for t in SHORT_UNLEARNED], "text string"), model)
    assert others.filter("n_grams < 200").count() == len(SHORT_UNLEARNED)
    assert others.filter(language.strange(limits, model=model)).count() == len(SHORT_UNLEARNED)
    # some n-grams are too few whatever they are, and so are those of texts in a taught language
    few = language.identify(spark.createDataFrame([("xq",), ("日本",), ("the of and",), ("ich",), ("A",), ("12",), (None,)], "text string"), model)
    assert few.filter(language.strange(limits, model=model)).count() == 0


def test_languages_without_long_texts_have_floors(spark):
    rng = np.random.default_rng(5)
    words = lambda n, letters: " ".join("".join(rng.choice(list(letters), size=4)) for _ in range(n))
    docs = spark.createDataFrame([(words(12, "abc"), "x") for _ in range(3000)], "text string, lang string")
    model = language.fit(docs)
    limits = language.floors(docs, model)
    assert limits == {}
    got = language.identify(spark.createDataFrame([(0, words(80, "abc")), (1, words(80, "ijklmnop")), (2, words(12, "abc"))], "k int, text string"), model)
    assert [r["s"] for r in got.orderBy("k").select(language.strange(limits, model=model).alias("s")).collect()] == [False, True, False]


def test_expected_bounds_the_variance(spark):
    """Means of texts drawn from a language spread less than the bound says, and lie around the expected mean."""
    rng = np.random.default_rng(6)
    letters, weight = list("abcdefgh "), np.array([30, 20, 10, 10, 5, 3, 1, 1, 20]) / 100
    texts = ["".join(rng.choice(letters, size=40, p=weight)) for _ in range(4000)]
    docs = spark.createDataFrame([(t, "x") for t in texts], "text string, lang string")
    model = language.fit(docs, smoothing=1e-6)
    mean, variance = language.expected(model)["x"]
    got = language.identify(docs.select("text"), model).toPandas()
    assert abs(got["mean_log"].mean() - mean) < 0.05
    assert ((got["mean_log"] - got["mean_log"].mean()) ** 2 * got["n_grams"]).mean() < variance
