"""Token counts of a unigram tokenizer without encoding: count-only Viterbi.

An Aho-Corasick automaton lists every vocabulary match that ends at a character; dynamic
programming carries the best score and, instead of a path, the number of pieces on it. The
rules are those of the unigram tokenizer itself: a better score must be strictly better, so
among equals the piece that starts first (the longest) stays; a character without a piece of
its own may become unknown at the least score minus ten; unknown neighbours fuse, and spell
out as one piece per UTF-8 byte where the vocabulary has all bytes.

A text is cut before every word mark (spaces become marks, one is put in front), as the
tokenizer's word split does, so a word's count depends on the word alone; each worker
remembers the counts of up to ``REMEMBERED`` words.

Defined cases: null and empty texts have no tokens; words and texts of any length are counted
whole; extra columns pass through and an input column named ``n_tokens`` is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import ahocorasick
import pandas as pd
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabflow.llm.common import table, without

TOKENIZER = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
UNKNOWN_PENALTY = 10.0
REMEMBERED = 400_000


@dataclass(frozen=True)
class Vocabulary:
    """Pieces with their scores; ``byte_pieces`` says whether all 256 byte pieces exist."""

    pieces: tuple[str, ...]
    scores: tuple[float, ...]
    byte_pieces: bool
    least: float

    @cached_property
    def automaton(self):
        found = ahocorasick.Automaton()
        for piece, score in zip(self.pieces, self.scores):
            found.add_word(piece, (len(piece), score))
        found.make_automaton()
        return found

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "automaton"}


def load_vocabulary(path: str = TOKENIZER) -> Vocabulary:
    """The normal pieces and scores of a sentencepiece file, read on the driver."""
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = range(model.get_piece_size())
    normal = [i for i in ids if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
    return Vocabulary(
        tuple(model.id_to_piece(i) for i in normal), tuple(model.get_score(i) for i in normal),
        sum(model.is_byte(i) for i in ids) == 256, min(model.get_score(i) for i in ids),
    )


def count_word(vocabulary: Vocabulary, word: str) -> int:
    """Pieces on the best path of one word."""
    n = len(word)
    ends: list[list[tuple[int, float]]] = [[] for _ in range(n + 1)]
    alone = [False] * n
    for end, (length, score) in vocabulary.automaton.iter(word):
        ends[end + 1].append((end + 1 - length, score))
        if length == 1:
            alone[end] = True
    unknown_score = vocabulary.least - UNKNOWN_PENALTY
    best, count, unknown = [0.0] * (n + 1), [0] * (n + 1), [False] * (n + 1)
    for e in range(1, n + 1):
        top, begin = None, -1
        for start, score in ends[e]:
            x = score + best[start]
            # equal scores: the smaller start came first
            if top is None or x > top or (x == top and start < begin):
                top, begin = x, start
        is_unknown = False
        if not alone[e - 1]:
            x = unknown_score + best[e - 1]
            if top is None or x > top:
                top, begin, is_unknown = x, e - 1, True
        best[e], unknown[e] = top, is_unknown
        if not is_unknown:
            count[e] = count[begin] + 1
        elif vocabulary.byte_pieces:
            count[e] = count[begin] + len(word[begin:e].encode("utf-8", "surrogatepass"))
        else:
            count[e] = count[begin] + (0 if unknown[begin] else 1)
    return count[n]


class _Remembered(dict):
    def __init__(self, vocabulary: Vocabulary):
        super().__init__()
        self.vocabulary = vocabulary

    def __missing__(self, word: str) -> int:
        n = count_word(self.vocabulary, MARK + word)
        if len(self) >= REMEMBERED:
            self.clear()
        self[word] = n
        return n


def count_text(counts: _Remembered, text: str | None) -> int:
    if not text:
        return 0
    marked = text.replace(" ", MARK)
    words = (marked if marked[0] == MARK else MARK + marked).split(MARK)
    return sum(map(counts.__getitem__, words[1:]))


_COUNTS: list[tuple[object, _Remembered]] = []


def token_counts(docs: DataFrame, vocabulary: Vocabulary, *, text: str = "text") -> DataFrame:
    """``docs`` with ``n_tokens``."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    @F.pandas_udf("long")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        if not _COUNTS or _COUNTS[0][0] != shared.value.pieces:  # kept between the tasks of a worker
            _COUNTS[:] = [(shared.value.pieces, _Remembered(shared.value))]
        counts = _COUNTS[0][1]
        for texts in batches:
            yield pd.Series([count_text(counts, t) for t in texts], dtype="int64")

    return without(docs, ["n_tokens"]).withColumn("n_tokens", count(F.col(text)))


def op8(spark, folder: str) -> DataFrame:
    return token_counts(table(spark, folder, "documents").select("doc_id", "text"), load_vocabulary()).select("doc_id", "n_tokens")
