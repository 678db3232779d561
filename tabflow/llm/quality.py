"""Quality classifier: attention-based multiple-instance learning over passages.

A document is a bag of passages of ``PASSAGE`` bytes; only the bag has a label. Every passage
is encoded by how it is written and by its words: frequencies of character classes and of
pairs of them, hashed words, and the shares of words and of word beginnings that repeat. A
learned layer embeds a passage, gated attention weighs the passages of a bag, and a logistic
head scores the weighted representation.

The model is fitted on the driver on a bounded sample of labelled documents: at most
``MAX_LABELLED`` by hash order of their id, of those as many as have ``MAX_PASSAGES`` passages
together. A document is learned from whole or not at all. Scoring reads every passage of every whole text, ``STRETCH`` characters at a time: repetition is counted
within a stretch, attention goes over all passages of a text.

Defined cases: a null or empty text is one passage without content and gets a score like any
other; rows without a label, and labels of ids without a text row, are not learned from;
several labels of one id are averaged; with no labels, or labels of one kind only, every
score is that share of label 1 (0.5 without labels); repeated rows score alike; extra columns
pass through and input columns named like an output are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabflow.llm.common import id_bucket, stretches, table, without

PASSAGE = 1024
STRETCH = 1_000_000
MAX_LABELLED = 8_000
# Some 950 bytes each come to the driver, 38 MB.
MAX_PASSAGES = 40_000
WORD_BUCKETS = 128
WIDTH = 24
EPOCHS = 40
THRESHOLD = 0.3
_CLASSES = 18


def _class_table() -> np.ndarray:
    """Bytes as classes: letters by case, digits, white space, frequent marks, the rest."""
    out = np.full(256, 17, dtype=np.uint8)
    out[128:] = 0
    out[ord("a"):ord("z") + 1] = 1
    out[ord("A"):ord("Z") + 1] = 2
    out[ord("0"):ord("9") + 1] = 3
    for k, marks in enumerate((" ", "\n", "\t\r\v\f", ".", ",", "!", "?", "'\"`", "-_", "()[]{}<>", "@/:;\\", "|", "#$%&*+=^~")):
        for m in marks:
            out[ord(m)] = 4 + k
    return out


_CLASS = _class_table()
N_FEATURES = _CLASSES + _CLASSES * _CLASSES + WORD_BUCKETS + 5


def encode(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(features of every passage, text each passage belongs to)."""
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    size = np.fromiter(map(len, raw), dtype=np.int64, count=len(raw))
    bags = np.maximum(1, -(-size // PASSAGE))
    first = np.concatenate([[0], np.cumsum(bags)])
    n = int(first[-1])
    b = np.frombuffer(b"".join(raw), dtype=np.uint8)
    start = np.concatenate([[0], np.cumsum(size)])
    place = np.arange(len(b)) - np.repeat(start[:-1], size)
    passage = np.repeat(first[:-1], size) + place // PASSAGE
    owner = np.repeat(np.arange(len(raw)), size)
    out = np.zeros((n, N_FEATURES), dtype=np.float32)
    length = np.maximum(1, np.bincount(passage, minlength=n)).astype(np.float32)[:, None]
    c = _CLASS[b].astype(np.int64)
    out[:, :_CLASSES] = np.bincount(passage * _CLASSES + c, minlength=n * _CLASSES).reshape(n, -1) / length
    if len(b) > 1:
        same = passage[1:] == passage[:-1]
        pair = (passage[:-1] * _CLASSES + c[:-1]) * _CLASSES + c[1:]
        out[:, _CLASSES:_CLASSES + _CLASSES ** 2] = np.bincount(pair[same], minlength=n * _CLASSES ** 2).reshape(n, -1) / length
    # words by a hash of their first eight bytes, and word beginnings by twenty bytes from there
    space = (c >= 4) & (c <= 6)
    word = np.flatnonzero(~space & (np.concatenate([[True], space[:-1]]) | (place == 0)))
    if len(word):
        padded = np.concatenate([b, np.zeros(24, np.uint8)])
        h, alive = np.zeros(len(word), dtype=np.uint64), np.ones(len(word), dtype=bool)
        for j in range(8):
            x = padded[word + j]
            alive &= (_CLASS[x] < 4) & (x != 0)
            h = np.where(alive, (h ^ (x | 32)) * np.uint64(0x100000001B3) + np.uint64(j + 1), h)
        h ^= h >> np.uint64(29)
        wide = np.zeros(len(word), dtype=np.uint64)
        for j in range(20):
            wide = (wide ^ padded[word + j]) * np.uint64(0x9E3779B97F4A7C15)
            wide ^= wide >> np.uint64(32)
        at, words = passage[word], np.maximum(1, np.bincount(passage[word], minlength=n))
        base = _CLASSES + _CLASSES ** 2
        bucket = (h * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)).astype(np.int64) % WORD_BUCKETS
        out[:, base:base + WORD_BUCKETS] = np.bincount(at * WORD_BUCKETS + bucket, minlength=n * WORD_BUCKETS).reshape(n, -1) / words[:, None]
        base += WORD_BUCKETS
        out[:, base] = np.log1p(words) / 6
        out[:, base + 1] = words / length[:, 0]
        out[:, base + 2] = _share_repeated(h, at, at, n) / words
        out[:, base + 3] = _share_repeated(wide, owner[word], at, n) / words
    out[:, -1] = np.minimum(1.0, length[:, 0] / PASSAGE)
    return out, np.repeat(np.arange(len(raw)), bags)


def _share_repeated(h: np.ndarray, group: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """Words of each passage whose hash occurs again in the same group."""
    key = h ^ (group.astype(np.uint64) * np.uint64(0xD1B54A32D192ED03))
    _, inverse, counts = np.unique(key, return_inverse=True, return_counts=True)
    return np.bincount(at, weights=counts[inverse] > 1, minlength=n)


# ---------------------------------------------------------------- the model

@dataclass(frozen=True)
class QualityModel:
    mean: np.ndarray
    scale: np.ndarray
    weights: dict[str, np.ndarray]
    constant: float | None = None  # the score where there was nothing to tell apart

    def embed(self, features: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(representation, attention logit) of passages."""
        f = _embed(self.weights, (features - self.mean) / self.scale)
        return f["h"], f["e"]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -30, 30)))


def _embed(w: dict[str, np.ndarray], x: np.ndarray) -> dict[str, np.ndarray]:
    h = np.tanh(np.clip(x, -8, 8) @ w["embed"] + w["embed_b"])
    t, g = np.tanh(h @ w["tanh"]), _sigmoid(h @ w["gate"])
    return {"h": h, "t": t, "g": g, "e": (t * g) @ w["attend"]}


def _pool(w: dict[str, np.ndarray], h: np.ndarray, e: np.ndarray, bag: np.ndarray, start: np.ndarray) -> dict[str, np.ndarray]:
    """Attention over bags; passages of a bag stand side by side from ``start``."""
    e = np.exp(e - np.maximum.reduceat(e, start)[bag])
    a = e / np.add.reduceat(e, start)[bag]
    z = np.add.reduceat(a[:, None] * h, start, axis=0)
    return {"a": a, "z": z, "p": _sigmoid(z @ w["head"] + w["head_b"][0])}


def gradients(w: dict[str, np.ndarray], x: np.ndarray, bag: np.ndarray, start: np.ndarray, label: np.ndarray) -> dict[str, np.ndarray]:
    """Gradients of the mean log loss of some bags."""
    f = _embed(w, x)
    f |= _pool(w, f["h"], f["e"], bag, start)
    d = (f["p"] - label) / len(label)
    dz = d[:, None] * w["head"]
    da = (dz[bag] * f["h"]).sum(axis=1)
    de = f["a"] * (da - np.add.reduceat(f["a"] * da, start)[bag])
    dt = de[:, None] * w["attend"] * f["g"] * (1 - f["t"] ** 2)
    dg = de[:, None] * w["attend"] * f["t"] * f["g"] * (1 - f["g"])
    dh = (f["a"][:, None] * dz[bag] + dt @ w["tanh"].T + dg @ w["gate"].T) * (1 - f["h"] ** 2)
    return {"embed": x.T @ dh, "embed_b": dh.sum(axis=0), "tanh": f["h"].T @ dt, "gate": f["h"].T @ dg, "attend": (f["t"] * f["g"]).T @ de, "head": f["z"].T @ d, "head_b": d.sum(keepdims=True)}


def fit_bags(features: np.ndarray, bag: np.ndarray, label: np.ndarray, *, width: int = WIDTH, epochs: int = EPOCHS, seed: int = 7, rate: float = 3e-3, decay: float = 1e-4) -> QualityModel:
    """Fit by Adam on mini-batches of bags; ``bag`` ascends from 0 and ``label`` has one value per bag."""
    share = float(label.mean()) if len(label) else 0.5
    if not len(label) or label.min() == label.max():
        return QualityModel(np.zeros(features.shape[1], np.float32), np.ones(features.shape[1], np.float32), {}, share)
    mean, scale = features.mean(axis=0), features.std(axis=0) + np.float32(1e-3)
    x = np.clip((features - mean) / scale, -8, 8)
    rng = np.random.default_rng(seed)
    normal = lambda *s: (rng.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
    w = {"embed": normal(x.shape[1], width), "embed_b": np.zeros(width, np.float32), "tanh": normal(width, width), "gate": normal(width, width),
         "attend": normal(width), "head": normal(width), "head_b": np.array([np.log(share / (1 - share))], np.float32)}
    m, v, step = {k: np.zeros_like(p) for k, p in w.items()}, {k: np.zeros_like(p) for k, p in w.items()}, 0
    first = np.searchsorted(bag, np.arange(len(label) + 1))
    for epoch in range(epochs):
        order = rng.permutation(len(label))
        for at in range(0, len(order), 64):
            chosen = order[at:at + 64]
            rows = np.concatenate([np.arange(first[k], first[k + 1]) for k in chosen])
            sizes = first[chosen + 1] - first[chosen]
            start = np.concatenate([[0], np.cumsum(sizes)[:-1]])
            of = np.repeat(np.arange(len(chosen)), sizes)
            grad = gradients(w, x[rows], of, start, label[chosen].astype(np.float32))
            step += 1
            now = rate * (1 - epoch / epochs)
            for k, p in w.items():
                g = grad[k] + decay * p
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g * g
                p -= (now * (m[k] / (1 - 0.9 ** step)) / (np.sqrt(v[k] / (1 - 0.999 ** step)) + 1e-8)).astype(np.float32)
    return QualityModel(mean, scale, w)


def fit(docs: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text", label: str = "quality", max_labelled: int = MAX_LABELLED, max_passages: int = MAX_PASSAGES, **options) -> QualityModel:
    """Fit on a bounded sample of labelled documents; see the module's text for the bounds."""
    named = labels.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{label}`").cast("double").alias("label"))
    known = named.filter("label is not null and doc_id is not null").groupBy("doc_id").agg(F.avg("label").alias("label"))
    sample = known.orderBy(F.xxhash64(F.col("doc_id")), "doc_id").limit(max_labelled)
    # at most ``max_labelled`` rows of two numbers; one row of each id that occurs more often
    own = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text")).join(F.broadcast(sample), "doc_id")
    n_bytes = F.coalesce(F.octet_length("text"), F.lit(0))
    sizes = own.select("doc_id", F.greatest(F.lit(1), F.ceil(n_bytes / PASSAGE)).alias("n")).groupBy("doc_id").agg(F.max("n").alias("n")).orderBy(F.xxhash64(F.col("doc_id")), "doc_id").collect()
    chosen, room = [], max_passages
    for r in sizes:
        if r["n"] <= room:
            chosen.append((r["doc_id"],))
            room -= r["n"]
    if len(chosen) < len(sizes):
        own = own.join(F.broadcast(docs.sparkSession.createDataFrame(chosen, f"doc_id {dict(own.dtypes)['doc_id']}")), "doc_id", "left_semi")

    def bags(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, y, value in zip(batch["doc_id"], batch["label"], batch["text"]):
                x = np.concatenate([encode(parts)[0] for parts, _ in stretches([value], STRETCH)])
                yield pd.DataFrame({"doc_id": [name], "label": [y], "bag": [x.astype(np.float16).tobytes()]})

    schema = f"doc_id {dict(own.dtypes)['doc_id']}, label double, bag binary"
    rows = own.mapInPandas(bags, schema).groupBy("doc_id").agg(F.max("label").alias("label"), F.max("bag").alias("bag")).orderBy("doc_id").toArrow().to_pandas()
    parts = [np.frombuffer(r, dtype=np.float16).reshape(-1, N_FEATURES).astype(np.float32) for r in rows["bag"]]
    if not parts:
        return fit_bags(np.zeros((0, N_FEATURES), np.float32), np.zeros(0, np.int64), np.zeros(0))
    return fit_bags(np.concatenate(parts), np.repeat(np.arange(len(parts)), [len(p) for p in parts]), rows["label"].to_numpy(), **options)


def score(docs: DataFrame, model: QualityModel, *, text: str = "text") -> DataFrame:
    """``docs`` with ``score``, the probability of label 1."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = shared.value
        for texts in batches:
            if model.constant is not None or not len(texts):
                yield pd.Series(np.full(len(texts), model.constant, dtype=np.float64))
                continue
            h, e, bag = [], [], []
            for parts, text_no in stretches(texts, STRETCH):
                x, part_no = encode(parts)
                for into, value in zip((h, e, bag), (*model.embed(x), text_no[part_no])):
                    into.append(value)
            h, e, bag = np.concatenate(h), np.concatenate(e), np.concatenate(bag)
            yield pd.Series(_pool(model.weights, h, e, bag, np.searchsorted(bag, np.arange(len(texts))))["p"].astype(np.float64))

    return without(docs, ["score"]).withColumn("score", of(F.col(text)))


def op3(spark, folder: str) -> DataFrame:
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    model = fit(docs, labels.filter(id_bucket(F.col("doc_id"), 5) != 0))
    found = score(docs.select("doc_id", "text"), model)
    return found.select("doc_id", (id_bucket(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
