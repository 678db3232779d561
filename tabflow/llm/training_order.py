"""Training-order materialisation of token ids as fixed-stride binary shards.

1. Every task tokenises its rows and writes them once, in compressed blocks, with the block's
   place in the task's own token stream. Streams of all tasks, one after another, are the token stream
   of the corpus; only the length of each task's stream is needed to place it. Sequence k is
   tokens [k L, (k + 1) L) of that stream, so nothing is padded but the last sequence.
2. A keyed Feistel permutation of the sequence numbers, walked along its cycle until it falls
   below their count, gives each sequence its global slot: a bijection that any task computes
   from the number, the count and the key alone.
3. A shard is a range of slots, and so is a partition: pieces of sequences go to the partition
   with the number of their shard, what a block has of one shard in one row. Each shard is written
   by one task as one file of ``sequence bytes`` per slot: the place of a slot is a multiplication,
   reading in training order is sequential, and a run resumes at any slot.
   Shards are bounded by ``shard_sequences``, files appear under their name only when they are
   complete, and a repeated task writes the same bytes again.

Defined cases: null and empty texts contribute nothing; a document ends with the separator;
the unfilled end of the last sequence holds the separator and is not counted in
``n_tokens``; repeated rows are written again; no token at all writes no shard and returns no
row; null ids are carried as null; ids must be whole numbers or texts of such, another is an error;
extra columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import os
import re
import sys
import uuid
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow.fs
import tiktoken
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabflow.llm.common import table, worker_slot
from tabflow.scratch import discard, materialize, scratch_root

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# The split that belongs to the rank file: fixed by the vocabulary.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
SEQUENCE = 1024
SHARD_SEQUENCES = 8192
# Tokens are compressed in blocks of about this many bytes of whole documents.
BLOCK_BYTES = 1 << 20
LEVEL = 6
KEY = 0x5EED
ROUNDS = 6
# Words a worker remembers, in two generations of half as many.
REMEMBERED = 600_000


# ---------------------------------------------------------------- permutation

def _round(half: np.ndarray, key: int, r: int) -> np.ndarray:
    x = half ^ np.uint64((key * 0x9E3779B97F4A7C15 + (r + 1) * 0xD1B54A32D192ED03) & 0xFFFFFFFFFFFFFFFF)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(31))


def permute(index, n: int, key: int = KEY, rounds: int = ROUNDS, inverse: bool = False) -> np.ndarray:
    """Slots of sequence numbers below ``n`` (or, inverted, numbers of slots)."""
    x = np.array(index, dtype=np.uint64, ndmin=1)
    if len(x) and (n < 1 or int(x.max()) >= n):
        raise ValueError("sequence number outside the permuted range")
    bits = np.uint64(max(1, ((max(n, 2) - 1).bit_length() + 1) // 2))
    mask = np.uint64((1 << int(bits)) - 1)
    todo = np.arange(len(x))
    while len(todo):
        left, right = x[todo] >> bits, x[todo] & mask
        for r in range(rounds - 1, -1, -1) if inverse else range(rounds):
            if inverse:
                left, right = right ^ (_round(left, key, r) & mask), left
            else:
                left, right = right, left ^ (_round(right, key, r) & mask)
        x[todo] = (left << bits) | right
        # the domain is less than four times n: a few steps along the cycle lead back below n
        todo = todo[x[todo] >= np.uint64(n)]
    return x.astype(np.int64)


# ---------------------------------------------------------------- tokens

@dataclass(frozen=True)
class Tokenizer:
    ranks: dict[bytes, int]
    pattern: str
    separator: int
    remembered: int = REMEMBERED

    @property
    def dtype(self) -> np.dtype:
        return np.dtype("<u2" if max(self.separator, max(self.ranks.values())) < 1 << 16 else "<u4")


def load_tokenizer(path: str = TOKENIZER, pattern: str = SPLIT, *, remembered: int = REMEMBERED) -> Tokenizer:
    """Ranks of a byte-level BPE file, read on the driver; the first free id is the separator."""
    with open(path, "rb") as f:
        ranks = {base64.b64decode(word): int(rank) for word, rank in map(bytes.split, f)}
    return Tokenizer(ranks, pattern, max(ranks.values()) + 1, remembered)


# A space or newline between two characters that are no white space: the pattern always splits before it.
_SPACE = re.compile(r" (?<=\S )(?=\S)")
_NEWLINE = re.compile(r"\n(?<=\S\n)(?=\S)")
# Longer pieces are not remembered.
LONG_PIECE = 200


class Encoder:
    """Token bytes of texts. Texts are cut where the pattern always splits, whatever lies around,
    and the pieces, led by their space or newline, are remembered."""

    def __init__(self, tokenizer: Tokenizer):
        self.dtype = tokenizer.dtype
        self.code = next(c for c in "HIL" if array(c).itemsize == self.dtype.itemsize)
        self.encoding = tiktoken.Encoding("corpus", pat_str=tokenizer.pattern, mergeable_ranks=tokenizer.ranks, special_tokens={})
        self.words = _Words(self, tokenizer.remembered)

    def direct(self, text: str) -> bytes:
        ids = array(self.code, self.encoding.encode_ordinary(text))
        if sys.byteorder == "big":
            ids.byteswap()
        return ids.tobytes()

    def encode(self, text: str) -> bytes:
        first, *lines = _NEWLINE.split(text)
        head, *pieces = _SPACE.split(first)
        for line in lines:
            start, *rest = _SPACE.split(line)
            # no piece that a space leads begins with white space: the two kinds of names don't meet
            pieces.append("\n" + start)
            pieces += rest
        return self.direct(head) + b"".join(map(self.words.__getitem__, pieces))


class _Words(dict):
    """Words in two generations: what was asked for since the last change stays through the next."""

    def __init__(self, encoder: Encoder, remembered: int):
        super().__init__()
        self.encoder, self.remembered, self.older = encoder, remembered, {}

    def __missing__(self, word: str) -> bytes:
        ids = self.older.pop(word, None)
        if ids is None:
            ids = self.encoder.direct(word if word[0] == "\n" else " " + word)
        if len(word) > LONG_PIECE:
            return ids
        if len(self) >= self.remembered // 2:
            self.older = dict(self)
            self.clear()
        self[word] = ids
        return ids


def _worker_encoder(shared) -> Encoder:
    """One encoder per Python worker, kept between its tasks."""
    name = ("encoder", len(shared.value.ranks), shared.value.pattern, shared.value.separator, shared.value.remembered)
    return worker_slot(name, lambda: Encoder(shared.value))


_BLOCK = "part int, before long, n_tokens long, doc_ids array<long>, doc_tokens array<int>, ids binary"


def tokenise(docs: DataFrame, tokenizer: Tokenizer, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(part, before, n_tokens, doc_ids, doc_tokens, ids): token blocks of documents, written once.

    A block holds whole documents in the order of the task ``part`` that read them, compressed
    together; ``before`` counts the tokens ahead of it in that task's stream.
    """
    shared = docs.sparkSession.sparkContext.broadcast(tokenizer)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder, pack = _worker_encoder(shared), zstandard.ZstdCompressor(level=LEVEL)
        part, at, size = TaskContext.get().partitionId(), 0, encoder.dtype.itemsize
        end = np.array([shared.value.separator], dtype=encoder.dtype).tobytes()
        names, held, n_bytes = [], [], 0

        def block() -> pd.DataFrame:
            lengths = [len(x) // size for x in held]
            return pd.DataFrame({"part": [part], "before": [at], "n_tokens": [sum(lengths)], "doc_ids": [names], "doc_tokens": [lengths], "ids": [pack.compress(b"".join(held))]})

        for batch in batches:
            for name, value in zip(batch["doc_id"], batch["text"]):
                if not isinstance(value, str) or not value:
                    continue
                names.append(None if name is None else int(name))
                held.append(encoder.encode(value) + end)
                n_bytes += len(held[-1])
                if n_bytes >= BLOCK_BYTES:
                    yield block()
                    at += n_bytes // size
                    names, held, n_bytes = [], [], 0
        if held:
            yield block()

    # ids travel as text: beside nulls, whole numbers would pass through floating point
    narrow = docs.select(F.col(doc_id).cast("long").cast("string").alias("doc_id"), F.col(text).alias("text"))
    return materialize(narrow.mapInPandas(run, _BLOCK), "tokens")


# ---------------------------------------------------------------- shards

@dataclass(frozen=True)
class Layout:
    """Where each slot lies: all that a reader needs."""

    folder: str
    n_tokens: int
    n_sequences: int
    sequence: int = SEQUENCE
    shard_sequences: int = SHARD_SEQUENCES
    key: int = KEY
    dtype: str = "<u2"

    @property
    def stride(self) -> int:
        return self.sequence * np.dtype(self.dtype).itemsize

    @property
    def n_shards(self) -> int:
        return -(-self.n_sequences // self.shard_sequences)

    def place(self, slot: int) -> tuple[str, int]:
        return f"{self.folder}/shard-{slot // self.shard_sequences:06d}.bin", slot % self.shard_sequences * self.stride


def file_system(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """The file system of a folder by its scheme; a bare path is local."""
    return pyarrow.fs.FileSystem.from_uri(path if ":/" in path else os.path.abspath(path))


def write_shards(docs: DataFrame, folder: str, tokenizer: Tokenizer, *, doc_id: str = "doc_id", text: str = "text", sequence: int = SEQUENCE, shard_sequences: int = SHARD_SEQUENCES, key: int = KEY) -> tuple[Layout, DataFrame]:
    """Write the shards below ``folder``; the manifest has one row per sequence.

    (slot, shard, byte_offset, sequence_no, n_tokens, doc_ids, doc_starts, sha256): ``doc_ids``
    are the documents in the sequence in order and ``doc_starts`` where each begins in it.
    """
    spark = docs.sparkSession
    tokens = tokenise(docs, tokenizer, doc_id=doc_id, text=text)
    # one row per task of the tokenising job
    lengths = {r["part"]: r["n"] for r in tokens.groupBy("part").agg(F.sum("n_tokens").alias("n")).collect()}
    base, n_tokens = {}, 0
    for part in sorted(lengths):
        base[part], n_tokens = n_tokens, n_tokens + lengths[part]
    layout = Layout(folder.rstrip("/"), n_tokens, -(-n_tokens // sequence), sequence, shard_sequences, key, tokenizer.dtype.str)
    bases = spark.sparkContext.broadcast(base)

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pack, unpack = zstandard.ZstdCompressor(level=LEVEL), zstandard.ZstdDecompressor()
        for batch in batches:
            for part, before, n, names, tokens, ids in batch[["part", "before", "n_tokens", "doc_ids", "doc_tokens", "ids"]].itertuples(index=False):
                ids = np.frombuffer(unpack.decompress(ids), dtype=layout.dtype)
                at, starts = bases.value[part] + before, np.concatenate([[0], np.cumsum(tokens)])
                numbers = np.arange(at // sequence, (at + n - 1) // sequence + 1)
                slots, begin = permute(numbers, layout.n_sequences, key), numbers * sequence - at
                low, high = np.maximum(begin, 0), np.minimum(begin + sequence, n)
                # the first and the last document of each piece
                first, last = np.searchsorted(starts, low, "right") - 1, np.searchsorted(starts, high, "left") - 1
                order = np.argsort(slots // shard_sequences, kind="stable")
                edges = np.flatnonzero(np.diff(slots[order] // shard_sequences, prepend=-1, append=-1))
                rows = []
                for k in (order[a:b] for a, b in zip(edges[:-1], edges[1:])):
                    inside = [np.arange(first[j], last[j] + 1) for j in k]
                    places = [np.maximum(starts[d], low[j]) - begin[j] for d, j in zip(inside, k)]
                    rows.append((
                        int(slots[k[0]] // shard_sequences), slots[k], numbers[k], (low[k] - begin[k]).astype(np.int32), (high[k] - low[k]).astype(np.int32),
                        np.array([len(d) for d in inside], dtype=np.int32), [None if names[d] is None else int(names[d]) for d in np.concatenate(inside)], np.concatenate(places).astype(np.int32),
                        pack.compress(b"".join(ids[low[j]:high[j]].tobytes() for j in k)),
                    ))
                yield pd.DataFrame(rows, columns=_PIECE_COLUMNS)

    pieces = tokens.withColumn("doc_ids", F.col("doc_ids").cast("array<string>")).mapInPandas(split, _PIECES)
    # range partitions: a shard is a range of slots, and partition k holds what belongs to shard k
    dealt = pieces.repartitionById(max(1, layout.n_shards), F.col("shard")).withColumn("doc_ids", F.col("doc_ids").cast("array<string>")).sortWithinPartitions("shard")
    schema = "slot long, shard int, byte_offset long, sequence_no long, n_tokens int, doc_ids array<long>, doc_starts array<int>, sha256 string"
    manifest = materialize(dealt.mapInPandas(_shard_writer(layout, tokenizer.separator), schema), "shard-manifest")
    discard(tokens)
    return layout, manifest


# what one block has of one shard: its pieces, their places, and the documents in each
_PIECES = "shard int, slots array<long>, numbers array<long>, begins array<int>, sizes array<int>, doc_counts array<int>, doc_ids array<long>, doc_starts array<int>, ids binary"
_PIECE_COLUMNS = ["shard", "slots", "numbers", "begins", "sizes", "doc_counts", "doc_ids", "doc_starts", "ids"]
_MANIFEST_COLUMNS = ["slot", "shard", "byte_offset", "sequence_no", "n_tokens", "doc_ids", "doc_starts", "sha256"]


def _shard_writer(layout: Layout, separator: int):
    """Fill and write the shards of a partition one after another; one shard is held at a time."""
    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        unpack, dtype = zstandard.ZstdDecompressor(), np.dtype(layout.dtype)
        fs, folder = file_system(layout.folder)
        fs.create_dir(folder, recursive=True)
        shard, block, pieces = None, None, {}

        def finish() -> pd.DataFrame:
            if len(pieces) != len(block):
                raise RuntimeError(f"shard {shard} has {len(pieces)} of {len(block)} sequences")
            path, rows = f"{folder}/shard-{shard:06d}.bin", []
            for slot in sorted(pieces):
                own, n = sorted(pieces[slot], key=lambda p: p[0]), 0
                for begin, size, *_ in own:
                    if begin != n:
                        raise RuntimeError(f"slot {slot} has {n} tokens where {begin} were due")
                    n += size
                row = slot % layout.shard_sequences
                rows.append((slot, shard, row * layout.stride, own[0][2], n, [d for p in own for d in p[3]], [int(x) for p in own for x in p[4]], hashlib.sha256(block[row, :n].tobytes()).hexdigest()))
            part = f"{path}.{uuid.uuid4().hex}"
            with fs.open_output_stream(part) as out:
                out.write(block.tobytes())
            fs.move(part, path)
            return pd.DataFrame(rows, columns=_MANIFEST_COLUMNS)

        for batch in batches:
            for nth, slots, numbers, begins, sizes, counts, doc_ids, doc_starts, ids in batch[_PIECE_COLUMNS].itertuples(index=False):
                if nth != shard:
                    if shard is not None:
                        yield finish()
                    shard, pieces = nth, {}
                    here = min(layout.shard_sequences, layout.n_sequences - nth * layout.shard_sequences)
                    block = np.full((here, layout.sequence), separator, dtype=dtype)
                ids, at, doc = np.frombuffer(unpack.decompress(ids), dtype=dtype), 0, 0
                doc_ids = [None if d is None else int(d) for d in doc_ids]
                for slot, number, begin, size, k in zip(slots.tolist(), numbers.tolist(), begins.tolist(), sizes.tolist(), counts.tolist()):
                    block[slot % layout.shard_sequences, begin:begin + size] = ids[at:at + size]
                    pieces.setdefault(slot, []).append((begin, size, number, doc_ids[doc:doc + k], doc_starts[doc:doc + k]))
                    at, doc = at + size, doc + k
        if shard is not None:
            yield finish()

    return write


def read_slots(layout: Layout, start: int = 0, stop: int | None = None) -> Iterator[np.ndarray]:
    """Token ids of slots [start, stop) in training order, one shard file open at a time."""
    stop = layout.n_sequences if stop is None else min(stop, layout.n_sequences)
    fs, folder = file_system(layout.folder)
    slot = start
    while slot < stop:
        path, offset = layout.place(slot)
        last = min(stop, (slot // layout.shard_sequences + 1) * layout.shard_sequences)
        with fs.open_input_file(f"{folder}/{path.rsplit('/', 1)[1]}") as f:
            f.seek(offset)
            while slot < last:
                yield np.frombuffer(f.read(layout.stride), dtype=layout.dtype)
                slot += 1


def write_training_order(docs: DataFrame, folder: str | None = None, *, tokenizer_path: str = TOKENIZER, remembered: int = REMEMBERED, **options) -> DataFrame:
    """Write the shards (below the shared scratch folder unless told) and return the manifest."""
    folder = folder or f"{scratch_root(docs.sparkSession)}/shards-{uuid.uuid4().hex}"
    return write_shards(docs, folder, load_tokenizer(tokenizer_path, remembered=remembered), **options)[1]


def op2(spark, folder: str) -> DataFrame:
    return write_training_order(table(spark, folder, "documents"))
