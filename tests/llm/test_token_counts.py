from __future__ import annotations

import pytest
import sentencepiece
from tokenizers import Tokenizer, models, pre_tokenizers

from tabflow.llm.token_counts import TOKENIZER, Vocabulary, _Remembered, count_text, count_word, load_vocabulary, op8, token_counts

TEXTS = [
    "", " ", "  ", "a", "Hello world", " two  spaces ", "tab\tand\nnew line", "ñandú für Ärzte à côté", "日本語 text", "\U0001F600 smile \U0001F600\U0001F600", "▁mark ▁▁ x",
    "x" * 300, "aaaaaaaabaaaa" * 20, "mixed 123,456.78 numbers!!", "\x00\x01 control",
]


def tokenizer(pieces, scores, byte_pieces) -> Tokenizer:
    vocab = [("<unk>", 0.0), *zip(pieces, scores)] + ([(f"<0x{b:02X}>", 0.0) for b in range(256)] if byte_pieces else [])
    t = Tokenizer(models.Unigram(vocab, 0, byte_pieces))
    t.pre_tokenizer = pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always", split=True)
    return t


@pytest.mark.parametrize("byte_pieces", [True, False])
def test_counts_equal_the_tokenizer(byte_pieces):
    own = load_vocabulary()
    v = Vocabulary(own.pieces, own.scores, byte_pieces, min(0.0, *own.scores))
    t = tokenizer(v.pieces, v.scores, byte_pieces)
    assert [count_text(_Remembered(v), x) for x in TEXTS] == [len(t.encode(x, add_special_tokens=False).ids) for x in TEXTS]


def test_equal_scores_take_the_longest_first_piece():
    pieces, scores = ("▁", "a", "aa", "aaa", "▁a"), (-1.0, -1.0, -2.0, -3.0, -2.0)
    v = Vocabulary(pieces, scores, False, -3.0)
    t = tokenizer(pieces, scores, False)
    for n in range(1, 12):
        assert count_word(v, "▁" + "a" * n) == len(t.encode("a" * n, add_special_tokens=False).ids), n


def test_vocabulary_is_that_of_the_file():
    v, model = load_vocabulary(), sentencepiece.SentencePieceProcessor(model_file=TOKENIZER)
    assert v.byte_pieces and len(v.pieces) == model.get_piece_size() - 3 - 256


def test_query_equals_the_tokenizer(spark, data):
    v = load_vocabulary()
    t = tokenizer(v.pieces, v.scores, v.byte_pieces)
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    got = {r["doc_id"]: r["n_tokens"] for r in op8(spark, data).collect()}
    assert got == {k: len(t.encode(x, add_special_tokens=False).ids) for k, x in docs.items()}


def test_defined_cases(spark):
    docs = spark.createDataFrame([(1, None, "z"), (2, "", "z"), (3, "some words", "z"), (3, "some words", "z"), (None, "b" * 200_000, "z")], "doc_id long, text string, n_tokens string")
    got = token_counts(docs, load_vocabulary())
    rows = [(r["doc_id"], r["n_tokens"]) for r in got.collect()]
    assert got.columns == ["doc_id", "text", "n_tokens"] and rows[:2] == [(1, 0), (2, 0)] and rows[2] == rows[3] and rows[4][1] > 1000
    assert token_counts(docs.filter("false"), load_vocabulary()).count() == 0
