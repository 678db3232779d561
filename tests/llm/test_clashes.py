"""No name that an operator uses for itself clashes with a column of the user's."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tabflow.llm import decontaminate, language, line_chunks, mixing, near_dup, pipeline, quality, simhash, suffix_dedup, token_counts

NAMES = (
    "_row", "_text", "_id", "_d", "_n", "_a", "_b", "_h", "_p", "_s", "_u", "_x", "_i", "_key", "_digest", "_text_digest", "_source", "_hit", "_slice", "_within", "_ahead", "_gone", "_text_hash",
    "_found", "_cut", "_cuts", "_pattern", "_copies", "_rows", "_users", "starts", "ends", "start", "pattern", "before", "weight", "node", "root", "sig", "id_a", "id_b", "core", "context", "h", "n",
    "chunk", "lines", "hashes", "low", "high", "label", "own", "items", "item", "normal", "digest", "keep", "file", "row", "value", "key", "f", "c", "w", "q",
)
BENCH = "what is the answer to the question that nobody asked before today"


def rows():
    text = lambda k: "\n".join(" ".join(f"w{(i * i + k) % 97}x" for i in range(j, j + 12)) for j in range(0, 120, 12))
    out = [(k, text(k * 13), "en", f"s{k % 3}", 1) for k in range(8)]
    return out + [(20, out[3][1], "en", "s1", 1), (21, f"{text(500)} {BENCH}", "en", "s2", 1), (22, None, None, None, None), (None, text(999), "en", None, 2)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), "doc_id long, text string, lang string, source string, n_chars long")


OPERATORS = {
    "mix": lambda d, b: mixing.mix(d, {"s0": 100, "s1": 300}, members=F.array("source"), size=mixing.word_count(F.col("text"))),
    "repeat": lambda d, b: mixing.repeated_documents(d),
    "quality": lambda d, b: quality.score(d, quality.fit(d, d.select("doc_id", (F.col("doc_id") % 2).alias("quality")), epochs=1)),
    "lines": lambda d, b: line_chunks.dedup_lines(d),
    "scan": lambda d, b: decontaminate.scan(d, b),
    "scan_blocks": lambda d, b: decontaminate.scan(d, b, block_chars=20),
    "cut_spans": lambda d, b: decontaminate.cut_spans(d, b),
    "drop": lambda d, b: decontaminate.drop_contaminated(d, b),
    "language": lambda d, b: language.identify(d, language.fit(d)),
    "fingerprints": lambda d, b: simhash.fingerprints(d),
    "simhash": lambda d, b: simhash.keep_one(d),
    "near": lambda d, b: near_dup.keep_one(d),
    "tokens": lambda d, b: token_counts.token_counts(d, token_counts.load_vocabulary()),
    "suffixes": lambda d, b: suffix_dedup.cut_repeats(d),
    "known": lambda d, b: pipeline.keep_known_language(d.sparkSession, d, ""),
}


def plain(found, names):
    return sorted(str([r[c] for c in names]) for r in found.collect())


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_columns_named_like_inner_ones_pass_through(spark, docs, name):
    run = OPERATORS[name]
    bench = spark.createDataFrame([("i1", BENCH), ("i2", "another item of the benchmark with more than ten words in it")], "item_id string, text string")
    alone = run(docs, bench)
    wide = docs.select("*", *[F.concat(F.lit(f"{n}:"), F.col("doc_id")).alias(n) for n in NAMES])
    found = run(wide, bench)
    outputs = [c for c in alone.columns if c not in docs.columns]
    assert [c for c in found.columns if c in alone.columns] == alone.columns
    kept = [n for n in NAMES if n not in outputs]
    assert set(kept) <= set(found.columns)
    assert plain(found, alone.columns) == plain(alone, alone.columns)
    wrong = [F.coalesce(F.col(f"`{n}`") != F.concat(F.lit(f"{n}:"), F.col("doc_id")), F.col("doc_id").isNotNull() & F.col(f"`{n}`").isNull()) for n in kept]
    assert found.filter(F.array_contains(F.array(*wrong), True)).count() == 0
