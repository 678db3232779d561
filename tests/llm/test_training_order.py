from __future__ import annotations

import hashlib

import numpy as np
import pytest

from tabflow.llm.training_order import Encoder, load_tokenizer, op2, permute, read_slots, write_shards


@pytest.mark.parametrize("n", [1, 2, 3, 5, 16, 17, 100, 1023, 4097, 70_000])
def test_permutation_is_a_keyed_bijection(n):
    slots = permute(np.arange(n), n)
    assert np.array_equal(np.sort(slots), np.arange(n))
    assert np.array_equal(permute(slots, n, inverse=True), np.arange(n))
    if n > 100:
        assert not np.array_equal(slots, permute(np.arange(n), n, key=1))
        assert abs(np.corrcoef(np.arange(n), slots)[0, 1]) < 0.1


def test_permutation_of_a_huge_range_and_refusal():
    n = 10**15 + 7
    x = np.array([0, 1, n // 2, n - 1])
    assert np.array_equal(permute(permute(x, n), n, inverse=True), x)
    with pytest.raises(ValueError):
        permute([5], 5)


def test_encoder_equals_the_library():
    e = Encoder(load_tokenizer())
    texts = ["plain words, here.", " leading", "trailing ", "two  spaces", "new\nline \n mixed", "it's we'll 'tis", "tab\tword", "ñ ü 日本 語", "a b c", "x" * 500, "1 22 333,4", "\x1c a \x85 b", "line\nline\nline", "\nfirst", "a\n\nb\nc", "end.\n", "a \nb", "a\n b", "x\x0by\nz", "it's\nit's  ok", "a\r\nb", "w " * 3 + "l" * 300 + " w"]
    for t in texts:
        assert e.encode(t) == e.direct(t), t


ROWS = [(1, "the first text " * 40), (2, None), (3, ""), (4, "short"), (4, "short"), (None, "no id here"), (7, "long " * 30_000), (8, "ü" * 50)]


def test_round_trip_and_resumption(spark, tmp_path):
    docs = spark.createDataFrame([(k, t, "x") for k, t in ROWS], "doc_id long, text string, slot string").coalesce(3)
    tokenizer = load_tokenizer()
    layout, manifest = write_shards(docs, str(tmp_path / "shards"), tokenizer, sequence=64, shard_sequences=100)
    rows = {r["slot"]: r for r in manifest.collect()}
    assert sorted(rows) == list(range(layout.n_sequences)) and layout.n_shards == len(list((tmp_path / "shards").glob("*")))
    sequences = list(read_slots(layout))
    stream = np.concatenate([sequences[s] for s in sorted(rows, key=lambda s: rows[s]["sequence_no"])])
    e = Encoder(tokenizer)
    own = [np.frombuffer(e.direct(t), dtype="<u2") for _, t in docs.select("doc_id", "text").collect() if t]
    want = np.concatenate([np.append(x, tokenizer.separator) for x in own])
    assert layout.n_tokens == len(want) == sum(r["n_tokens"] for r in rows.values())
    assert np.array_equal(stream[:len(want)], want) and (stream[len(want):] == tokenizer.separator).all()
    for slot, r in rows.items():
        assert r["sha256"] == hashlib.sha256(sequences[slot][:r["n_tokens"]].tobytes()).hexdigest()
        assert (r["shard"], r["byte_offset"]) == (slot // 100, slot % 100 * 128)
        assert len(r["doc_ids"]) == len(r["doc_starts"]) and r["doc_starts"][0] == 0
    half = layout.n_sequences // 2
    assert all(np.array_equal(a, b) for a, b in zip(read_slots(layout, half), sequences[half:], strict=True))
    assert {k for r in rows.values() for k in r["doc_ids"]} == {1, 4, None, 7, 8}
    # a second run writes the same bytes
    again, _ = write_shards(docs, str(tmp_path / "again"), tokenizer, sequence=64, shard_sequences=100)
    assert all(np.array_equal(a, b) for a, b in zip(read_slots(again), sequences, strict=True))


def test_blocks_do_not_change_the_shards(spark, tmp_path, monkeypatch):
    docs = spark.createDataFrame(ROWS * 3, "doc_id long, text string").coalesce(2)
    whole, a = write_shards(docs, str(tmp_path / "whole"), load_tokenizer(), sequence=32, shard_sequences=50)
    monkeypatch.setattr("tabflow.llm.training_order.BLOCK_BYTES", 100)
    small, b = write_shards(docs, str(tmp_path / "small"), load_tokenizer(), sequence=32, shard_sequences=50)
    assert all(np.array_equal(x, y) for x, y in zip(read_slots(whole), read_slots(small), strict=True))
    assert sorted(map(str, a.collect())) == sorted(map(str, b.collect()))


def test_no_tokens_write_nothing(spark, tmp_path):
    docs = spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")
    layout, manifest = write_shards(docs, str(tmp_path / "none"), load_tokenizer())
    assert manifest.count() == 0 and layout.n_sequences == 0 and list(read_slots(layout)) == []
    assert write_shards(docs.filter("false"), str(tmp_path / "none2"), load_tokenizer())[1].count() == 0


def test_query_covers_every_document(spark, data):
    rows = op2(spark, data).collect()
    docs = spark.read.parquet(f"{data}/documents.parquet").filter("text <> ''").select("doc_id").collect()
    assert {k for r in rows for k in r["doc_ids"]} == {d["doc_id"] for d in docs}
    assert sorted(r["slot"] for r in rows) == list(range(len(rows)))
