"""The corpus pipeline: five stages over ``documents``, each written and read again.

Every stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept; all but the
last return the columns of ``documents``.

1. language ID: fitted on all documents with a language; texts without a letter go, and texts
   whose mean log-probability per n-gram is below the floor of their most likely language: they are
   probably of a language that nobody taught. Floors are fitted on the training texts of 200 n-grams or
   more; shorter texts, and languages without such, have wider ones that follow from the model and the text's
   n-grams. Where no language is taught, there is none to tell and all texts with a letter stay;
2. near-dedup by SimHash segments and by prefixes, verified by a five-word Jaccard of 0.8 or more: of each component the row with the least id
   stays (null ids last, then the least text digest); repeated rows become one;
3. benchmark decontamination: a document with any benchmark window goes;
4. source mixing: whole documents, repeated as often as the mix takes them;
5. training-order token shards: the manifest, one row per sequence.

Since a stage's result is written before the next stage reads it, the tables that a stage left
in the scratch folder go when the next stage starts, unless its documents are still read from them.
The stages lower the session's rows per Arrow batch to ``BATCH_ROWS``.

Defined cases: nulls and empty or very long texts are as the operators define them (a text without
a letter goes in the first stage); an empty table passes every stage and gives no shard; extra
columns, whatever their names, pass through all stages but the last, which does not read them.
"""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabflow.llm import decontaminate, language, mixing, near_dup, training_order
from tabflow.llm.common import packed, table
from tabflow.scratch import discard, free, materialize, scope

# Rows of an Arrow batch; results don't depend on it, the memory of executors and workers does.
BATCH_ROWS = 1_000
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
# Words a worker remembers: the executors' memory is shared with what other stages hold.
REMEMBERED = 240_000
# Scratch tables that the result of the last stage reads, until the next one starts.
_LEFT: list[str] = []


def _free_left(spark: SparkSession, docs: DataFrame) -> None:
    """Delete what the stage before left, unless ``docs`` was not written and still reads it."""
    files = docs.inputFiles() if _LEFT else []
    if not any(path.rsplit("/", 1)[1] in f for path in _LEFT for f in files):
        free(spark, _LEFT)
        _LEFT.clear()


def _small_batches(spark: SparkSession) -> None:
    """Whole documents travel to Python: batches of ``BATCH_ROWS`` rows at most, for this session."""
    if int(spark.conf.get(_BATCH)) > BATCH_ROWS or int(spark.conf.get(_BATCH)) <= 0:
        spark.conf.set(_BATCH, str(BATCH_ROWS))


def _stage(function):
    @wraps(function)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        _small_batches(spark)
        _free_left(spark, docs)
        with scope(spark, later=_LEFT):
            return function(spark, docs, sf_dir)

    return run


@_stage
def keep_known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = language.fit(docs)
    limits = language.floors(docs, model)
    found = packed(docs).withColumn("_found", language.prediction(spark, model)(F.col("_row.text")))
    # an n-gram has a letter; a taught language may be named like the undetermined one
    return found.filter((F.col("_found.n_grams") > 0) & ~language.strange(limits, found="_found.", model=model)).select("_row.*")


@_stage
def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dup.keep_one(docs)


@_stage
def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


@_stage
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.repeated_documents(docs)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    # the shards and their manifest stay
    _small_batches(spark)
    _free_left(spark, docs)
    return training_order.write_training_order(docs, remembered=REMEMBERED)


STAGES = [
    ("language_id", keep_known_language),
    ("simhash_near_dedup", drop_near_duplicates),
    ("decontaminate", drop_benchmark_leaks),
    ("mix_sources", mix_sources),
    ("token_output", write_tokens),
]

ORACLE_SQL = None  # fitted model, 64-bit hashes and a tokenizer; tests compare with brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES[:-1]):
        kept = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if k:
            discard(docs)
        docs = kept
    manifest = STAGES[-1][1](spark, docs, sf_dir)
    discard(docs)
    return manifest
