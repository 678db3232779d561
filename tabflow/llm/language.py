"""Language ID: multinomial naive Bayes over hashed character n-grams.

Fitting counts n-grams of every training text: each task adds into one count vector per
language, and Spark sums the non-zero cells by (language, bucket). The model is a matrix of
(buckets + 1) x languages log-probabilities, a size fixed by parameters and the number of
languages, so it is broadcast. Scoring is a sparse row-times-matrix product: the matrix rows
of a text's n-grams are gathered and summed in numpy, a bounded stretch of texts at a time.
Stretches of one long text overlap, and each n-gram counts in the stretch it starts in.

Defined cases: a null text, or one without a letter, is ``und`` with score 0; training rows
with a null language or text are left out; without any training row every text is ``und``;
ties go to the language first in code point order; extra columns pass through, and input
columns named like an output are replaced. Repeated rows are scored one by one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabflow.llm.common import id_bucket, packed, table, unpacked, worker_slot

ORDERS = (1, 2, 3)
BUCKETS = 1 << 16
SMOOTHING = 0.5
UNDETERMINED = "und"
# Floors: they are fitted on texts of so many n-grams, shorter texts have wider ones of their own; strange is what lies
# below a language's mean by this much (n-grams are some seven times rarer than they should be) and these deviations.
LEAST_GRAMS = 200
# Characters whose n-grams a worker holds at once.
STRETCH = 200_000
MARGIN = 2.0
DEVIATIONS = 4.0


@dataclass(frozen=True)
class LanguageModel:
    languages: tuple[str, ...]
    log_prob: np.ndarray  # (buckets + 1, languages); the last row is zero and stands for "no n-gram"
    prior: np.ndarray
    orders: tuple[int, ...]


def _letters() -> np.ndarray:
    """For every code point, whether it is a letter. Built once per Python worker."""
    return worker_slot("letters", lambda: np.fromiter((chr(c).isalpha() for c in range(0x110000)), dtype=bool, count=0x110000))


def marked_stretches(texts: pd.Series, orders, limit: int = STRETCH) -> Iterator[tuple[list[str], np.ndarray, np.ndarray]]:
    """Lower-cased texts between spaces, in order, as (parts, text each is from, characters of each in which n-grams start).

    About ``limit`` characters at a time. A longer text is cut into parts that run on by what
    the longest n-gram needs, so every n-gram of the whole text starts in exactly one part.
    """
    over, parts, of, starts, size = max(orders) - 1, [], [], [], 0
    for k, t in enumerate(texts):
        marked = f" {t.lower()} " if isinstance(t, str) else "  "
        for at in range(0, len(marked), limit):
            parts.append(marked[at:at + limit + over])
            of.append(k)
            starts.append(min(limit, len(marked) - at))
            size += starts[-1]
            if size >= limit:
                yield parts, np.array(of), np.array(starts)
                parts, of, starts, size = [], [], [], 0
    if parts:
        yield parts, np.array(of), np.array(starts)


def ngram_buckets(marked: list[str], starts: np.ndarray, orders=ORDERS, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket of each n-gram, part it belongs to, whether each part has a letter).

    What is no letter becomes a space; n-grams of spaces only, those that would cross into the
    next part and those that start behind the part's ``starts`` characters are left out.
    """
    code = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    letter = _letters()[code]
    code = np.where(letter, code, np.uint32(32))
    size = np.fromiter(map(len, marked), dtype=np.int64, count=len(marked))
    owner = np.repeat(np.arange(len(marked)), size)
    own = np.arange(len(code)) - np.repeat(np.cumsum(size) - size, size) < np.repeat(starts, size)
    has_letter = np.bincount(owner, weights=letter, minlength=len(marked)) > 0
    out, of = [], []
    for n in orders:
        if len(code) < n:
            continue
        m = len(code) - n + 1
        h = np.full(m, n * 0x9E3779B1 & 0xFFFFFFFF, dtype=np.uint32)
        some = np.zeros(m, dtype=bool)
        for j in range(n):
            h = (h ^ code[j:j + m]) * np.uint32(0x85EBCA6B)
            h ^= h >> np.uint32(13)
            some |= letter[j:j + m]
        h *= np.uint32(0xC2B2AE35)
        keep = some & own[:m] & (owner[:m] == owner[n - 1:])
        out.append(((h >> np.uint32(7)) % np.uint32(buckets)).astype(np.int32)[keep])
        of.append(owner[:m][keep])
    if not out:
        return np.zeros(0, np.int32), np.zeros(0, np.int64), has_letter
    return np.concatenate(out), np.concatenate(of), has_letter


def fit(docs: DataFrame, *, text: str = "text", lang: str = "lang", orders=ORDERS, buckets: int = BUCKETS, smoothing: float = SMOOTHING) -> LanguageModel:
    """Count the n-grams of every row of ``docs`` with a text and a language."""
    rows = docs.select(F.col(f"`{text}`").alias("text"), F.col(f"`{lang}`").cast("string").alias("lang")).filter("text is not null and lang is not null")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[str, np.ndarray] = {}
        n_docs: dict[str, int] = {}
        for batch in batches:
            for name, part in batch.groupby("lang", sort=False)["text"]:
                into = total.setdefault(name, np.zeros(buckets, dtype=np.int64))
                n_docs[name] = n_docs.get(name, 0) + len(part)
                for parts, _, starts in marked_stretches(part, orders):
                    into += np.bincount(ngram_buckets(parts, starts, orders, buckets)[0], minlength=buckets)
        for name, into in total.items():
            at = np.flatnonzero(into)
            # bucket -1 carries the number of documents
            yield pd.DataFrame({"lang": name, "bucket": np.append(at, -1).astype(np.int32), "n": np.append(into[at], n_docs[name])})

    cells = rows.mapInPandas(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow().to_pandas()
    languages = tuple(sorted(cells["lang"].unique()))
    counts = np.zeros((buckets, len(languages)))
    docs_of = np.zeros(len(languages))
    column = cells["lang"].map({name: i for i, name in enumerate(languages)}).to_numpy(dtype=np.int64)
    bucket, n = cells["bucket"].to_numpy(), cells["n"].to_numpy(dtype=np.float64)
    counts[bucket[bucket >= 0], column[bucket >= 0]] = n[bucket >= 0]
    docs_of[column[bucket < 0]] = n[bucket < 0]
    log_prob = np.log(counts + smoothing) - np.log(counts.sum(axis=0) + smoothing * buckets)
    return LanguageModel(languages, np.vstack([log_prob, np.zeros(len(languages))]), np.log(docs_of / max(docs_of.sum(), 1)), tuple(orders))


def floors(docs: DataFrame, model: LanguageModel, *, text: str = "text", lang: str = "lang", least_grams: int = LEAST_GRAMS, margin: float = MARGIN, deviations: float = DEVIATIONS) -> dict[str, float]:
    """For each language a floor of the mean log-probability per n-gram.

    The mean over all training texts of the language that are predicted as it and have
    ``least_grams`` n-grams, less ``margin`` and ``deviations`` standard deviations; a mean does not
    depend on a text's length, as a posterior does. A language without such texts has no floor.
    """
    # one row a language
    return {r["lang_pred"]: r["mean"] - margin - deviations * r["spread"] for r in _mean_logs(docs, model, text, lang, least_grams).collect()}


def _mean_logs(docs: DataFrame, model: LanguageModel, text: str, lang: str, least_grams: int) -> DataFrame:
    """(lang_pred, mean, spread) of the mean log-probabilities that ``floors`` asks for.

    The condition stands inside the aggregates: as a filter it would be pushed below the prediction,
    which tasks would then work out twice for every text, in twice as many Python workers.
    """
    found = identify(docs.select(F.col(f"`{text}`").alias("text"), F.col(f"`{lang}`").cast("string").alias("own")).filter("text is not null and own is not null"), model)
    own = F.when((F.col("own") == F.col("lang_pred")) & (F.col("n_grams") >= least_grams), F.col("mean_log"))
    sums = found.groupBy("lang_pred").agg(F.avg(own).alias("mean"), F.coalesce(F.stddev_pop(own), F.lit(0.0)).alias("spread"))
    return sums.filter("mean is not null")


def expected(model: LanguageModel) -> dict[str, tuple[float, float]]:
    """For each language the mean of an n-gram's log-probability, and a bound on ``n`` times the variance of a mean of ``n``.

    Both follow from the model. N-grams that share no character count as independent: one n-gram shares
    some with at most ``shared`` others, itself included.
    """
    log_prob = model.log_prob[:-1]
    p = np.exp(log_prob)
    mean = (p * log_prob).sum(axis=0)
    shared = max(sum(a + b - 1 for b in model.orders) for a in model.orders)
    return dict(zip(model.languages, zip(mean.tolist(), (shared * (p * (log_prob - mean) ** 2).sum(axis=0)).tolist())))


def strange(limits: dict[str, float], least_grams: int = LEAST_GRAMS, found: str = "", model: LanguageModel | None = None, margin: float = MARGIN, deviations: float = DEVIATIONS):
    """Whether an identified text is below its language's floor: probably of a language nobody taught.

    ``limits`` are the floors of texts of ``least_grams`` n-grams or more. With a ``model`` every other
    text has a floor, too, the wider the fewer n-grams it has (``expected``); else none.
    """
    col = lambda c: F.col(f"{found}{c}")
    spread = expected(model) if model else {}
    below = F.lit(False)
    for name in sorted({*limits, *spread}):
        floor = F.when(col("n_grams") >= least_grams, F.lit(limits.get(name)).cast("double"))
        if name in spread:
            mean, variance = spread[name]
            floor = F.coalesce(floor, F.lit(mean - margin) - F.lit(deviations) * F.sqrt(F.lit(variance) / col("n_grams")))
        below = below | ((col("lang_pred") == name) & F.coalesce(col("mean_log") < floor, F.lit(False)))
    return below


def prediction(spark, model: LanguageModel):
    """A function of a text column: struct of ``lang_pred``, ``score``, ``n_grams`` and ``mean_log``."""
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double, n_grams long, mean_log double")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        m = shared.value
        buckets, names = len(m.log_prob) - 1, np.array([*m.languages, UNDETERMINED], dtype=object)
        for batch in batches:
            log, has_letter, n = np.tile(m.prior, (len(batch), 1)), np.zeros(len(batch), dtype=bool), np.zeros(len(batch), dtype=np.int64)
            for parts, of, starts in marked_stretches(batch, m.orders):
                bucket, owner, letter = ngram_buckets(parts, starts, m.orders, buckets)
                np.add.at(n, of, np.bincount(owner, minlength=len(parts)))
                for j in range(len(m.languages)):
                    np.add.at(log[:, j], of, np.bincount(owner, weights=m.log_prob[bucket, j], minlength=len(parts)))
                np.logical_or.at(has_letter, of, letter)
            if not m.languages:
                yield pd.DataFrame({"lang_pred": UNDETERMINED, "score": np.zeros(len(batch)), "n_grams": n, "mean_log": np.zeros(len(batch))})
                continue
            p = 1.0 / np.exp(log - log.max(axis=1, keepdims=True)).sum(axis=1)
            best = log.argmax(axis=1)
            mean = (log - m.prior)[np.arange(len(batch)), best] / np.maximum(n, 1)
            yield pd.DataFrame({"lang_pred": names[np.where(has_letter, best, len(m.languages))], "score": np.where(has_letter, p, 0.0), "n_grams": n, "mean_log": mean})

    return predict


def identify(docs: DataFrame, model: LanguageModel, *, text: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred``, ``score`` (the posterior probability of that language), ``n_grams``
    and ``mean_log`` (the mean log-probability of the n-grams in that language, 0 without any)."""
    outputs = ["lang_pred", "score", "n_grams", "mean_log"]
    found = packed(docs).withColumn("_found", prediction(docs.sparkSession, model)(F.col(f"_row.`{text}`")))
    return found.select(*unpacked(docs.columns, outputs), *[F.col(f"_found.{c}").alias(c) for c in outputs])


def held_out_model(docs: DataFrame) -> LanguageModel:
    """The model of the contract: learned from documents outside the held-out fold."""
    return fit(docs.filter(id_bucket(F.col("doc_id"), 4) != 2).select("text", "lang"))


def op6(spark, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    found = identify(docs.select("doc_id", "text"), held_out_model(docs))
    return found.select("doc_id", (id_bucket(F.col("doc_id"), 4) == 2).alias("held_out"), "lang_pred", "score")
