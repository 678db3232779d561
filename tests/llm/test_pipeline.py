from __future__ import annotations

import numpy as np
import pytest

import corpus_pipeline
from tabflow.llm import decontaminate, mixing, pipeline
from tests.llm.test_language import SHORT_UNLEARNED, taught_rows
from tests.llm.test_simhash import plain_components, plain_fingerprint

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, extra string"
BENCH = "what is the answer to the question that nobody asked before today"


def rows():
    text = lambda k: " ".join(f"w{(i * i + k) % 97}x" for i in range(120))
    out = [(k, text(k * 13), "en", f"s{k % 3}", 1, "e") for k in range(12)]
    out += [(30, None, "en", "s1", None, None), (31, "", "en", None, 0, "e"), (32, "12 34 !!", None, "s0", 8, "e"), (33, out[3][1], "en", "s1", 1, "e"), (33, out[3][1], "en", "s1", 1, "e")]
    out += [(40, f"{text(5000)} {BENCH} {text(6000)}", "en", "s2", 2, "e"), (None, text(9999), None, None, None, None)]
    return out


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("pipeline"))
    spark.createDataFrame(rows(), SCHEMA).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, BENCH)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def test_stages_one_by_one(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        kept[name] = sorted((r["doc_id"] for r in docs.collect()), key=lambda k: (k is None, k))
    assert kept["language_id"] == [*range(12), 33, 33, 40, None]
    data = [r for r in rows() if r[0] not in (30, 31, 32)]
    ids = [r[0] if r[0] is not None else 10**9 for r in data]
    groups = plain_components(ids, [plain_fingerprint(r[1]) for r in data])
    assert kept["simhash_near_dedup"] == sorted({k if k < 10**9 else None for k in groups.values()}, key=lambda k: (k is None, k))
    assert kept["decontaminate"] == [k for k in kept["simhash_near_dedup"] if k != 40]
    mixed = spark.createDataFrame([r for r in rows() if r[0] in kept["decontaminate"] and r[0] != 33], SCHEMA)
    want = {r["doc_id"]: r["taken"] // r["size"] for r in mixing.single_source_mix(mixed).collect() if r["taken"]}
    assert {k: kept["mix_sources"].count(k) for k in kept["mix_sources"]} == want


def test_run_gives_the_stages_rows(spark, folder):
    manifest = corpus_pipeline.run(spark, folder).collect()
    ids = {k for r in manifest for k in r["doc_ids"]}
    assert ids and ids <= {*range(12), None} and sorted(r["slot"] for r in manifest) == list(range(len(manifest)))


def test_empty_documents(spark, folder, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{folder}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_clean_documents_stay(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    kept = pipeline.keep_known_language(spark, docs, data)
    assert kept.count() == docs.count()
    dirty = decontaminate.op5(spark, data).filter("contaminated").count()
    assert pipeline.drop_benchmark_leaks(spark, docs, data).count() == docs.count() - dirty


def test_texts_stay_where_no_language_is_taught(spark):
    docs = spark.createDataFrame([(1, "some words", None), (2, "12 34", None), (3, None, None), (4, "é", None)], "doc_id long, text string, lang string")
    assert sorted(r["doc_id"] for r in pipeline.keep_known_language(spark, docs, "").collect()) == [1, 4]


def test_a_taught_language_may_be_called_undetermined(spark):
    docs = spark.createDataFrame([(1, "some words of a language", "und"), (2, "andere worte", "de"), (3, "12", "und")], "doc_id long, text string, lang string")
    assert sorted(r["doc_id"] for r in pipeline.keep_known_language(spark, docs, "").collect()) == [1, 2]


def test_short_texts_of_other_languages_go(spark):
    docs = taught_rows(spark)
    other = spark.createDataFrame([*((-k, t, None) for k, t in enumerate(SHORT_UNLEARNED, 1)), (-9, "the of and", None)], docs.schema)
    kept = pipeline.keep_known_language(spark, docs.unionByName(other), "")
    assert [r["doc_id"] for r in kept.filter("doc_id < 0").collect()] == [-9] and kept.count() == docs.count() + 1
