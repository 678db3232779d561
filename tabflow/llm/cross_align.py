"""Alignment of two tokenizers' tokens, with corpus-wide counts by minimal perfect hashing.

1. Every document is encoded by both tokenizers; byte offsets where tokens of both end cut them
   into groups, and tokens whose byte ranges overlap are links. Each task counts in how many of
   its documents a pair of ids is linked and writes the sums.
2. The distinct pairs get a minimal perfect hash (``perfect_hash``), built in shards of bounded
   size. The written sums become dense count vectors indexed by it, cut into slices, which are
   added up a tree of ``FAN_IN`` branches a round. Beside each count lies its key.
3. The documents are aligned once more; each pair's count is read at its hash index after its key
   is compared, and compared in turn with the highest count of its id of the first tokenizer.

Counts and keys are broadcast while their counted number is within ``BROADCAST_PAIRS`` (16 bytes
each); beyond, documents' pairs are written and joined with the counts, hot pairs salted. The best
counts are a number for each id of the vocabulary.

Texts are cut where neither tokenizer can join what lies on the two sides: before a single space
or newline between characters that are no white space. What a piece gives is remembered per
worker, within a bound.

Defined cases: null and empty texts, and texts whose tokens' bytes differ from a space and the text
with either tokenizer, have no tokens, zeros and empty groups; repeated rows are documents of their
own and each count; null ids are carried; columns that are not named are not read.
"""

from __future__ import annotations

import json
import os
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import sentencepiece
import tiktoken
import tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabflow.llm import perfect_hash
from tabflow.llm.common import table
from tabflow.llm.training_order import SPLIT
from tabflow.operators.lookup import lookup_join
from tabflow.scratch import materialize

BYTE_BPE = "/opt/tokenizers/byte_bpe_50k.json"
PIECE_BPE = "/opt/tokenizers/piece_bpe_32k.model"
# Counts and keys of up to this many pairs (64 MB) are broadcast.
BROADCAST_PAIRS = 1 << 22
SHARD_KEYS = 1 << 20
# Counts in one row of a dense vector, slices a task holds, branches added in one round.
SLICE = 1024
HELD_SLICES = 1 << 13
FAN_IN = 32
# A worker forgets what it knows beyond this many pieces (some 300 bytes each), or 16 times as many characters.
REMEMBERED = 600_000
# Pieces encoded as one text by the first tokenizer, by the second, and the longest among them.
TOGETHER = 5_000
RUN = 16
LONG_PIECE = 1_000
# Texts are encoded together in groups of about this many characters.
GROUP_CHARS = 1_000_000


# ---------------------------------------------------------------- tokens of both

@dataclass(frozen=True)
class Files:
    """The two tokenizer files, read on the driver."""

    byte_level: str
    pieces: bytes
    name: str = field(default_factory=lambda: uuid.uuid4().hex)


def load_files(byte_level: str = BYTE_BPE, pieces: str = PIECE_BPE) -> Files:
    with open(byte_level, encoding="utf-8") as f, open(pieces, "rb") as g:
        return Files(f.read(), g.read())


def byte_alphabet() -> dict[str, int]:
    """The byte each character of a byte-level vocabulary stands for: printable bytes stand for
    themselves, the others for the characters from 256 on, in order."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(others)}


def ranked(byte_level: str, table: list[bytes]) -> tiktoken.Encoding | None:
    """The byte-level tokenizer of the file in a faster form, where ids give the order of its merges."""
    told = json.loads(byte_level)
    model, before = told["model"], told.get("pre_tokenizer") or {}
    merges = [m.split(" ") if isinstance(m, str) else m for m in model.get("merges", ())]
    made = [model["vocab"].get(a + b, -1) for a, b in merges]
    special = {t["id"] for t in told["added_tokens"]}
    plain = {x: k for k, x in enumerate(table) if k not in special and x}
    same = before.get("type") == "ByteLevel" and before.get("use_regex") and not before.get("add_prefix_space") and not told["normalizer"]
    if not same or model.get("dropout") or model.get("ignore_merges") or made != sorted(made) or len(plain) != len(set(made)) + 256:
        return None
    return tiktoken.Encoding("pieces", pat_str=SPLIT, mergeable_ranks=plain, special_tokens={})


# a space or newline between two characters that are no white space
_SPACE = re.compile(r" (?<=\S )(?=\S)")
_NEWLINE = re.compile(r"\n(?<=\S\n)(?=\S)")


class Both:
    """Both tokenizers and the bytes of their tokens."""

    def __init__(self, files: Files):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.a = tokenizers.Tokenizer.from_str(files.byte_level)
        self.a.encode_special_tokens = True
        self.a.no_truncation()
        self.a.no_padding()
        alphabet = byte_alphabet()
        vocabulary = self.a.get_vocab(with_added_tokens=True)
        self.bytes_a = [b""] * (max(vocabulary.values()) + 1)
        for entry, k in vocabulary.items():
            self.bytes_a[k] = bytes(alphabet[c] for c in entry) if all(c in alphabet for c in entry) else entry.encode()
        self.b = sentencepiece.SentencePieceProcessor(model_proto=files.pieces)
        entries = [self.b.id_to_piece(k) for k in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(k) else p.replace("▁", " ").encode() for k, p in enumerate(entries)]
        self.ranked = ranked(files.byte_level, self.bytes_a)
        self.len_a, self.len_b = (np.array([len(x) for x in v], dtype=np.int64) for v in (self.bytes_a, self.bytes_b))
        self.digits = _digit_table(max(len(self.bytes_a), len(self.bytes_b)))
        self.digit_counts = (self.digits != 0).sum(axis=1)
        # a cut is safe only where no piece could reach over it
        self.cut_spaces = not any("▁" in p.lstrip("▁") for p in entries)
        self.cut_lines = self.cut_spaces and not any("\n" in p for k, p in enumerate(entries) if not self.b.is_byte(k))

    def cut(self, text: str) -> list[str]:
        """Pieces of a space and the text. A piece that a space leads is given without it, one
        that a newline leads with it; the first is led by the space that was put before the text."""
        if not self.cut_spaces:
            return [text]
        out: list[str] = []
        for k, line in enumerate(_NEWLINE.split(text) if self.cut_lines else [text]):
            words = _SPACE.split(line)
            if k:
                words[0] = "\n" + words[0]
            out += words
        return out

    def one_by_one(self, pieces: list[str], led: list[bool]) -> tuple[list[list[int]], list[list[int]]]:
        """Ids of both tokenizers for each piece; ``led`` tells which a newline leads."""
        whole = [p if line else " " + p for p, line in zip(pieces, led)]
        a = [e.ids for e in self.a.encode_batch_fast(whole, add_special_tokens=False)]
        # the tokenizer puts a space before each; before a newline it is a token of its own, which goes
        b = [ids[1:] if line else ids for ids, line in zip(self.b.encode(pieces, num_threads=1), led)]
        return a, b

    def together(self, pieces: list[str], led: list[bool]) -> tuple[np.ndarray, ...] | None:
        """(n_a, ids of a, n_b, ids of b) of pieces without white space at their ends, as one text
        that is cut at them again; null if the tokens' ends or bytes don't allow that."""
        whole = [p if line else " " + p for p, line in zip(pieces, led)]
        text = "".join(whole)
        raw = text.encode("utf-8", "surrogatepass")
        ends = np.cumsum(np.fromiter((len(w.encode("utf-8", "surrogatepass")) for w in whole), dtype=np.int64, count=len(whole)) if len(raw) != len(text) else np.fromiter(map(len, whole), dtype=np.int64, count=len(whole)))
        a = self.ranked.encode_ordinary(text) if self.ranked else self.a.encode_batch_fast([text], add_special_tokens=False)[0].ids
        # the second tokenizer puts the first space of each text itself; a newline must not come first
        spaces = [k for k, line in enumerate(led) if not line][::RUN]
        runs = ["".join(whole[i:j])[1:] for i, j in zip(spaces, [*spaces[1:], len(whole)])]
        b = list(chain.from_iterable(self.b.encode(runs, num_threads=1)))
        out = []
        for ids, table, lengths in ((a, self.bytes_a, self.len_a), (b, self.bytes_b, self.len_b)):
            if b"".join(map(table.__getitem__, ids)) != raw:
                return None
            ids = np.array(ids, dtype=np.int64)
            stops = np.cumsum(lengths[ids])
            last = np.searchsorted(stops, ends)
            if not np.array_equal(stops[last], ends):
                return None
            out += [np.diff(last, prepend=-1), ids]
        return tuple(out)

    def encode(self, pieces: list[str], led: list[bool]) -> tuple[np.ndarray, ...]:
        """(whether each piece fits, n_a, ids of a, n_b, ids of b); pieces that don't fit have no ids."""
        plain = [k for k, (p, line) in enumerate(zip(pieces, led)) if line < len(p) <= LONG_PIECE and p[line:] == p[line:].strip()] if self.cut_spaces else []
        parts, single = [], set(range(len(pieces))).difference(plain) if len(plain) < len(pieces) else set()
        for at in range(0, len(plain), TOGETHER):
            own = plain[at:at + TOGETHER]
            if led[own[0]]:
                first = next((k for k, x in enumerate(own) if not led[x]), None)
                if first is None:
                    single.update(own)
                    continue
                own[0], own[first] = own[first], own[0]
            found = self.together([pieces[k] for k in own], [led[k] for k in own])
            if found is None:
                single.update(own)
            else:
                parts.append((own, np.ones(len(own), dtype=bool), *found))
        if single:
            own = sorted(single)
            a, b = self.one_by_one([pieces[k] for k in own], [led[k] for k in own])
            fits = np.zeros(len(own), dtype=bool)
            for i, k in enumerate(own):
                raw = (pieces[k] if led[k] else " " + pieces[k]).encode("utf-8", "surrogatepass")
                fits[i] = b"".join(map(self.bytes_a.__getitem__, a[i])) == raw == b"".join(map(self.bytes_b.__getitem__, b[i]))
            parts.append((own, fits, *_flat([x if ok else [] for x, ok in zip(a, fits)]), *_flat([x if ok else [] for x, ok in zip(b, fits)])))
        order = np.concatenate([np.array(x[0], dtype=np.int64) for x in parts])
        back = np.argsort(order)
        fits, n_a, n_b = (np.concatenate([x[i] for x in parts]) for i in (1, 2, 4))
        ids = []
        for n, i in ((n_a, 3), (n_b, 5)):
            ids.append(np.concatenate([x[i] for x in parts])[_spans((np.cumsum(n) - n)[back], n[back])])
        return fits[back], n_a[back], ids[0], n_b[back], ids[1]


def _flat(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    n = np.fromiter(map(len, lists), dtype=np.int64, count=len(lists))
    return n, np.fromiter(chain.from_iterable(lists), dtype=np.int64, count=int(n.sum()))


def _spans(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """All numbers of the ranges [start, start + size), one range after another."""
    return np.arange(int(size.sum())) + np.repeat(start - (np.cumsum(size) - size), size)


_DIGITS = 10


def _digit_table(n: int) -> np.ndarray:
    """Decimal digits of 0..n-1 as bytes, right-aligned, zero bytes before them; a last column for a mark."""
    k, out = np.arange(n), np.zeros((n, _DIGITS + 1), dtype=np.uint8)
    for c in range(_DIGITS):
        shown = (k >= 10 ** c) | (c == 0)
        out[:, _DIGITS - 1 - c] = np.where(shown, 48 + k // 10 ** c % 10, 0)
    return out[:, int((out[:, :_DIGITS] == 0).all(axis=0).sum()):]


@dataclass
class Aligned:
    """Alignment of some pieces: for each its tokens and groups, the text of its groups with a
    semicolon after each, and where its links end."""

    fits: np.ndarray
    n_a: np.ndarray
    n_b: np.ndarray
    n_groups: np.ndarray
    groups: list[bytes]
    links: np.ndarray  # id of the first tokenizer in the upper, of the second in the lower 32 bits
    link_ends: np.ndarray


def _group_texts(both: Both, flat_a, flat_b, stops_a, stops_b, piece_groups) -> list[bytes]:
    """The groups of each piece as text, all digits at once."""
    if not len(stops_a):
        return [b""] * len(piece_groups)
    size_a, size_b = np.diff(stops_a, prepend=0), np.diff(stops_b, prepend=0)
    # a group's tokens stand together: those of the first tokenizer, then those of the second
    at_a = np.arange(len(flat_a)) + np.repeat(stops_b - size_b, size_a)
    at_b = np.arange(len(flat_b)) + np.repeat(stops_a, size_b)
    order, marks = np.empty(len(flat_a) + len(flat_b), dtype=np.int64), np.full(len(flat_a) + len(flat_b), ord(","), dtype=np.uint8)
    order[at_a], order[at_b] = flat_a, flat_b
    ends = stops_a + stops_b
    marks[ends - 1], marks[ends - 1 - size_b] = ord(";"), ord("|")
    cells = both.digits[order]
    cells[:, -1] = marks
    text = cells[cells != 0].tobytes()
    widths = np.cumsum(both.digit_counts[order] + 1)
    group_ends = widths[ends - 1]
    stops = np.concatenate([[0], group_ends])[np.cumsum(piece_groups)].tolist()
    return [text[i:j] for i, j in zip([0, *stops[:-1]], stops)]


def align_pieces(both: Both, pieces: list[str], led: list[bool]) -> Aligned:
    fits, n_a, flat_a, n_b, flat_b = both.encode(pieces, led)
    ends_a, ends_b = np.cumsum(both.len_a[flat_a]), np.cumsum(both.len_b[flat_b])
    # between two neighbouring ends lies one token of each: one link
    ends = np.sort(np.concatenate([ends_a, ends_b]), kind="stable")
    ends = ends[np.diff(ends, prepend=-1) > 0]
    at_a, at_b = np.searchsorted(ends_a, ends), np.searchsorted(ends_b, ends)
    links = flat_a[at_a] << 32 | flat_b[at_b]
    shared = (ends_a[at_a] == ends) & (ends_b[at_b] == ends) if len(ends) else np.zeros(0, bool)
    piece_ends = np.concatenate([[0], ends_a])[np.cumsum(n_a)]
    link_ends, group_ends = np.searchsorted(ends, piece_ends, "right"), np.searchsorted(ends[shared], piece_ends, "right")
    n_groups = np.diff(group_ends, prepend=0)
    return Aligned(fits, n_a, n_b, n_groups, _group_texts(both, flat_a, flat_b, at_a[shared] + 1, at_b[shared] + 1, n_groups), links, link_ends)


@dataclass
class Group:
    """Some texts after each other: their numbers, the pieces of those that have tokens, and each one's links."""

    texts: list[int]  # those with tokens
    empty: list[int]
    pieces: np.ndarray  # numbers of the pieces of all texts
    of: np.ndarray  # the text, by its place in ``texts``, of each piece
    memory: Memory

    def sums(self, values: np.ndarray) -> np.ndarray:
        """Whole numbers of pieces, summed for each text."""
        return np.bincount(self.of, values[self.pieces], len(self.texts)).astype(np.int64)

    def links(self) -> tuple[np.ndarray, np.ndarray]:
        """(pair, text by its place) of every link."""
        start, size = self.memory.first[self.pieces], self.memory.n_links[self.pieces]
        return self.memory.pair[_spans(start, size)], np.repeat(self.of, size)

    def group_texts(self) -> list[bytes]:
        edges = np.searchsorted(self.of, np.arange(len(self.texts) + 1)).tolist()
        numbers, known = self.pieces.tolist(), self.memory.groups
        return [b"".join([known[k] for k in numbers[i:j]])[:-1] for i, j in zip(edges[:-1], edges[1:])]


class Memory:
    """What the pieces met so far give, in columns; forgotten as a whole when there is too much of it."""

    def __init__(self, both: Both):
        self.both = both
        self.forget()

    def forget(self) -> None:
        self.number: dict = {}
        self.held, self.age = 0, getattr(self, "age", 0) + 1
        self.fits = np.zeros(0, dtype=bool)
        self.n_a = self.n_b = self.n_groups = self.n_links = self.first = np.zeros(0, dtype=np.int64)
        self.groups: list[bytes] = []
        # links name their pair by its number here
        self.pair, self.codes = np.zeros(0, dtype=np.int32), np.zeros(0, dtype=np.int64)
        self.pair_number: dict[int, int] = {}

    def learn(self, names: list, pieces: list[str], led: list[bool]) -> None:
        found = align_pieces(self.both, pieces, led)
        n_links = np.diff(found.link_ends, prepend=0)
        codes, inverse = np.unique(found.links, return_inverse=True)
        known = self.pair_number
        numbers = np.array([known.setdefault(c, len(known)) for c in codes.tolist()], dtype=np.int32)
        fresh = numbers >= len(self.codes)
        added = np.empty(int(fresh.sum()), dtype=np.int64)
        added[numbers[fresh] - len(self.codes)] = codes[fresh]
        self.codes = np.concatenate([self.codes, added])
        self.first = np.concatenate([self.first, len(self.pair) + found.link_ends - n_links])
        self.pair = np.concatenate([self.pair, numbers[inverse]])
        for name, more in (("fits", found.fits), ("n_a", found.n_a), ("n_b", found.n_b), ("n_groups", found.n_groups), ("n_links", n_links)):
            setattr(self, name, np.concatenate([getattr(self, name), more]))
        self.number.update(zip(names, range(len(self.groups), len(self.groups) + len(names))))
        self.groups += found.groups
        self.held += len(names) + sum(map(len, pieces)) // 16

    def texts(self, texts: list[str | None]) -> Iterator[Group]:
        """All texts in groups, in order."""
        at = 0
        while at < len(texts):
            if self.held > REMEMBERED:
                self.forget()
            cuts, own, empty, size = [], [], [], 0
            while at < len(texts) and size < GROUP_CHARS:
                text = texts[at]
                if text:
                    pieces = self.both.cut(text)
                    if pieces[0][:1] == "\n":
                        # a first piece has a space before it, also where it begins with a newline
                        pieces[0] = (pieces[0],)
                    cuts.append(pieces)
                    own.append(at)
                    size += len(text)
                else:
                    empty.append(at)
                at += 1
            new = list(set().union(*cuts).difference(self.number))
            if new:
                self.learn(new, [p[0] if isinstance(p, tuple) else p for p in new], [not isinstance(p, tuple) and p[:1] == "\n" for p in new])
            sizes = np.fromiter(map(len, cuts), dtype=np.int64, count=len(cuts))
            pieces = np.fromiter(map(self.number.__getitem__, chain.from_iterable(cuts)), dtype=np.int64, count=int(sizes.sum()))
            of = np.repeat(np.arange(len(own)), sizes)
            wrong = np.unique(of[~self.fits[pieces]])
            if len(wrong):
                fit = np.ones(len(own), dtype=bool)
                fit[wrong] = False
                empty += [own[k] for k in wrong.tolist()]
                own = [k for k, ok in zip(own, fit) if ok]
                pieces, of = pieces[fit[of]], (np.cumsum(fit) - 1)[of[fit[of]]]
            yield Group(own, empty, pieces, of, self)


_WORKER: dict[str, object] = {}


def _worker(name: str, make):
    """One object of a kind per Python worker, kept between its tasks."""
    kind = name.split(":")[0]
    if _WORKER.get(kind, ("",))[0] != name:
        _WORKER[kind] = (name, make())
    return _WORKER[kind][1]


def _memory(files) -> Memory:
    return _worker(f"memory:{files.value.name}", lambda: Memory(Both(files.value)))


def _texts(batch: pa.RecordBatch) -> list[str | None]:
    return batch.column(batch.schema.get_field_index("text")).to_pylist()


# ---------------------------------------------------------------- counts

_SUMS = pa.schema([("code", pa.int64()), ("n", pa.int64())])


def _document_counts(group: Group) -> np.ndarray:
    """In how many texts of the group each pair of the memory is linked."""
    pair, of = group.links()
    met = np.zeros((len(group.texts), len(group.memory.codes)), dtype=bool)
    met[of, pair] = True
    return met.sum(axis=0, dtype=np.int64)


def pair_sums(docs: DataFrame, files) -> DataFrame:
    """(code, n): for each task the pairs it met and in how many of its documents, written once."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory = _memory(files)
        age, total = memory.age, np.zeros(0, dtype=np.int64)

        def out(codes: np.ndarray) -> pa.RecordBatch:
            some = np.flatnonzero(total)
            return pa.RecordBatch.from_arrays([pa.array(codes[some]), pa.array(total[some])], schema=_SUMS)

        codes = memory.codes
        for batch in batches:
            for group in memory.texts(_texts(batch)):
                if memory.age != age:  # the numbers of the pairs changed
                    yield out(codes)
                    age, total = memory.age, np.zeros(0, dtype=np.int64)
                codes, now = memory.codes, _document_counts(group)
                now[:len(total)] += total
                total = now
        yield out(codes)

    return materialize(docs.select("text").mapInArrow(run, "code long, n long"), "pair-sums")


def hash_pairs(sums: DataFrame, shard_keys: int = SHARD_KEYS) -> tuple[DataFrame, perfect_hash.PerfectHash]:
    """The distinct pairs (code), written once, and a minimal perfect hash of them."""
    pairs = materialize(sums.select("code").distinct(), "pairs")
    n_shards = max(1, -(-pairs.count() // shard_keys))

    @F.pandas_udf("int")
    def shard_of(codes: pd.Series) -> pd.Series:
        return pd.Series(perfect_hash.spread(codes.to_numpy().astype(np.uint64), perfect_hash.SHARD_SEED, n_shards).astype(np.int32))

    def build(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        levels, rest = perfect_hash.build(group["code"].to_numpy().astype(np.uint64))
        return pd.DataFrame({"shard": [int(key[0])], "levels": [levels], "rest": [rest.astype(np.int64).tolist()]})

    # about four bits a pair come to the driver
    built = pairs.withColumn("shard", shard_of("code")).groupBy("shard").applyInPandas(build, "shard int, levels array<binary>, rest array<long>")
    rows = {r["shard"]: r for r in built.collect()}
    empty = ([], [])
    parts = [(rows[k]["levels"], rows[k]["rest"]) if k in rows else empty for k in range(n_shards)]
    return pairs, perfect_hash.PerfectHash([perfect_hash.load([bytes(x) for x in levels], np.array(rest, dtype=np.uint64)) for levels, rest in parts])


_VECTORS = "slice int, branch int, counts binary, keys binary"
_VECTOR_SCHEMA = pa.schema([("slice", pa.int32()), ("branch", pa.int32()), ("counts", pa.binary()), ("keys", pa.binary())])


def _vector_batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(c), type=f.type) for c, f in zip(zip(*rows), _VECTOR_SCHEMA)], schema=_VECTOR_SCHEMA)


def _to_vectors(hashed):
    """Sums (code, n) as dense vectors of counts and keys, a row for each slice a task met."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        branch, size = TaskContext.get().partitionId(), hashed.value.n_keys

        def out() -> Iterator[pa.RecordBatch]:
            numbers = sorted(held)
            for k in range(0, len(numbers), 256):
                yield _vector_batch([(s, branch, held[s][0].tobytes(), held[s][1].tobytes()) for s in numbers[k:k + 256]])
            held.clear()

        for batch in batches:
            codes, n = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(2))
            at = hashed.value.index(codes)
            if len(at) and at.min() < 0:
                raise RuntimeError("a pair has no hash index")
            order = np.argsort(at, kind="stable")
            at, codes, n = at[order], codes[order], n[order]
            cuts = np.flatnonzero(np.diff(at // SLICE, prepend=-1, append=-1)).tolist()
            for low, high in zip(cuts[:-1], cuts[1:]):
                s = int(at[low] // SLICE)
                if s not in held:
                    if len(held) >= HELD_SLICES:
                        yield from out()
                    length = min(SLICE, size - s * SLICE)
                    held[s] = np.zeros(length, dtype="<i8"), np.full(length, -1, dtype="<i8")
                counts, keys = held[s]
                inside = at[low:high] - s * SLICE
                np.add.at(counts, inside, n[low:high])
                if ((keys[inside] >= 0) & (keys[inside] != codes[low:high])).any():
                    raise RuntimeError("two pairs have one hash index")
                keys[inside] = codes[low:high]
        yield from out()

    return run


def _add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Vectors of one slice and branch, which follow each other, added up; one is held at a time."""
    key, counts, keys, rows = None, None, None, []
    for batch in batches:
        for s, branch, c, k in zip(*[batch.column(i).to_pylist() for i in range(4)]):
            c, k = np.frombuffer(c, dtype="<i8"), np.frombuffer(k, dtype="<i8")
            if (s, branch) == key:
                counts = counts + c
                if ((keys >= 0) & (k >= 0) & (keys != k)).any():
                    raise RuntimeError("two pairs have one hash index")
                keys = np.maximum(keys, k)
                continue
            if key is not None:
                rows.append((*key, counts.tobytes(), keys.tobytes()))
            if len(rows) >= 256:
                yield _vector_batch(rows)
                rows = []
            key, counts, keys = (s, branch), c, k
    if key is not None:
        rows.append((*key, counts.tobytes(), keys.tobytes()))
        yield _vector_batch(rows)


def dense_counts(sums: DataFrame, hashed, fan_in: int = FAN_IN) -> DataFrame:
    """(slice, branch, counts, keys): one row a slice, ``SLICE`` whole numbers each, written once."""
    vectors = materialize(sums.mapInArrow(_to_vectors(hashed), _VECTORS), "pair-vectors")
    branches = (vectors.agg(F.max("branch")).first()[0] or 0) + 1
    while True:
        branches = -(-branches // fan_in)
        dealt = vectors.withColumn("branch", F.floor(F.col("branch") / fan_in).cast("int")).repartition("slice", "branch").sortWithinPartitions("slice", "branch")
        vectors = materialize(dealt.mapInArrow(_add, _VECTORS), "pair-vectors")
        if branches == 1:
            return vectors


def pair_counts(vectors: DataFrame) -> DataFrame:
    """(a, b, code, n): in how many documents each pair is linked."""
    schema = pa.schema([("code", pa.int64()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c, k in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(k, dtype="<i8")), pa.array(np.frombuffer(c, dtype="<i8"))], schema=schema)

    rows = vectors.select("counts", "keys").mapInArrow(run, "code long, n long")
    return rows.select(F.shiftright("code", 32).cast("int").alias("a"), F.col("code").bitwiseAND(F.lit(0xFFFFFFFF)).cast("int").alias("b"), "code", "n")


# ---------------------------------------------------------------- documents

@dataclass(frozen=True)
class Lookup:
    """Counts by hash index, the key of each, and the highest count of each id."""

    hashed: perfect_hash.PerfectHash
    keys: np.ndarray
    counts: np.ndarray
    best: np.ndarray
    name: str = field(default_factory=lambda: uuid.uuid4().hex)

    def of(self, links: np.ndarray) -> np.ndarray:
        at = self.hashed.index(links)
        if len(at) and not ((at >= 0) & (self.keys[at] == links)).all():
            raise RuntimeError("a pair of the second pass was not met in the first")
        return self.counts[at]


_NUMBERS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")
_RESULT = ", ".join(["doc_id long", *[f"{n} long" for n in _NUMBERS], "groups string"])
_RESULT_SCHEMA = pa.schema([("doc_id", pa.int64()), *[(n, pa.int64()) for n in _NUMBERS], ("groups", pa.string())])


class _Rated:
    """Count and rank of the pairs of a worker's memory, looked up once for each."""

    def __init__(self, lookup: Lookup):
        self.lookup, self.age = lookup, 0
        self.count, self.best = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=bool)

    def of(self, memory: Memory) -> tuple[np.ndarray, np.ndarray]:
        if self.age != memory.age:
            self.age, self.count, self.best = memory.age, self.count[:0], self.best[:0]
        return self.count, self.best

    def look_up(self, memory: Memory, pair: np.ndarray) -> None:
        """Counts of the pairs named; a memory may know others, met by other queries, that have none."""
        count, best = self.of(memory)
        more = len(memory.codes) - len(count)
        self.count, self.best = np.concatenate([count, np.full(more, -1)]), np.concatenate([best, np.zeros(more, dtype=bool)])
        new = np.unique(pair[self.count[pair] < 0])
        if len(new):
            codes = memory.codes[new]
            self.count[new] = self.lookup.of(codes)
            self.best[new] = self.count[new] == self.lookup.best[codes >> 32]


def _rate(files, lookup):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory, rated = _memory(files), _Rated(lookup.value)
        for batch in batches:
            ids = batch.column(0)
            for group in memory.texts(_texts(batch)):
                pair, of = group.links()
                rated.look_up(memory, pair)
                n, n_a, n_b, n_groups = len(group.texts), *(group.sums(v) for v in (memory.n_a, memory.n_b, memory.n_groups))
                best, total = np.bincount(of, rated.best[pair], n).astype(np.int64), _whole_sums(of, rated.count[pair], n)
                columns = [n_a, n_b, n_groups, n_a + n_b - n_groups, best, total]
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(group.texts, type=pa.int64())), *map(pa.array, columns), pa.array(group.group_texts(), type=pa.string())], schema=_RESULT_SCHEMA)
                if group.empty:
                    k = len(group.empty)
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array(group.empty, type=pa.int64())), *[pa.array(np.zeros(k, dtype=np.int64))] * len(_NUMBERS), pa.array([""] * k, type=pa.string())], schema=_RESULT_SCHEMA)

    return run


def _whole_sums(of: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """Sums of whole numbers for each text, exact beyond 2^53; ``of`` ascends."""
    ends = np.searchsorted(of, np.arange(n), "right")
    return np.diff(np.concatenate([[0], np.cumsum(values)])[ends], prepend=0)


_ROWS = "row string, doc_id long, n_a long, n_b long, n_groups long, codes array<long>, times array<long>, groups string"
_ROWS_SCHEMA = pa.schema([("row", pa.string()), ("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("codes", pa.list_(pa.int64())), ("times", pa.list_(pa.int64())), ("groups", pa.string())])


def _rows_with_links(files):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory, nth = _memory(files), 0
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for group in memory.texts(_texts(batch)):
                pair, of = group.links()
                pairs = len(memory.codes)
                key, times = np.unique(of * pairs + pair, return_counts=True)
                edges = np.searchsorted(key // max(pairs, 1), np.arange(len(group.texts) + 1))
                codes = memory.codes[key % max(pairs, 1)] if pairs else np.zeros(0, dtype=np.int64)
                sums = [group.sums(v).tolist() for v in (memory.n_a, memory.n_b, memory.n_groups)]
                rows = [(ids[t], sums[0][k], sums[1][k], sums[2][k], codes[edges[k]:edges[k + 1]], times[edges[k]:edges[k + 1]], text) for k, (t, text) in enumerate(zip(group.texts, group.group_texts()))]
                rows += [(ids[t], 0, 0, 0, [], [], b"") for t in group.empty]
                names = [f"{TaskContext.get().partitionId()}-{nth + k}" for k in range(len(rows))]
                nth += len(rows)
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(list(c), type=f.type) for c, f in zip([names, *zip(*rows)], _ROWS_SCHEMA)], schema=_ROWS_SCHEMA)

    return run


def _joined(docs: DataFrame, files, counts: DataFrame, best) -> DataFrame:
    """The same rows without a broadcast of counts: documents' pairs written, then joined."""
    rows = materialize(docs.mapInArrow(_rows_with_links(files), _ROWS), "aligned-rows")
    links = rows.select("row", F.explode(F.arrays_zip("codes", "times")).alias("link")).select("row", F.col("link.codes").alias("code"), F.col("link.times").alias("times"))
    # the highest counts: one number for each id of the vocabulary
    rated = counts.join(F.broadcast(best), "a").select("code", "n", (F.col("n") == F.col("best")).alias("is_best"), F.col("n").alias("weight"))
    found = lookup_join(links, materialize(rated, "pair-counts"), ["code"], weight="weight")
    sums = found.groupBy("row").agg(F.sum(F.when(F.col("is_best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("n")).alias("count_sum"))
    zero = F.lit(0).cast("long")
    out = rows.join(sums, "row", "left")
    return out.select("doc_id", "n_a", "n_b", "n_groups", (F.col("n_a") + F.col("n_b") - F.col("n_groups")).alias("n_links"), F.coalesce("n_best", zero).alias("n_best"), F.coalesce("count_sum", zero).alias("count_sum"), "groups")


def align(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", files: Files | None = None, broadcast_pairs: int = BROADCAST_PAIRS, shard_keys: int = SHARD_KEYS) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups) of every row.

    ``groups`` lists the ids of each group, of the first tokenizer, a bar, of the second; groups
    are parted by semicolons. ``doc_id`` must be a whole number.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(files or load_files())
    narrow = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    sums = pair_sums(narrow, shared)
    pairs, hashed = hash_pairs(sums, shard_keys)
    vectors = dense_counts(sums, spark.sparkContext.broadcast(hashed))
    counts = pair_counts(vectors)
    best = materialize(counts.groupBy("a").agg(F.max("n").alias("best")), "pair-best")
    if hashed.n_keys > broadcast_pairs:
        return _joined(narrow, shared, counts, best)
    dense, tops = vectors.select("counts", "keys").orderBy("slice").toArrow(), best.toArrow()
    whole = lambda c: np.frombuffer(b"".join(dense.column(c).to_pylist()), dtype="<i8")
    highest = np.zeros((max(tops.column("a").to_pylist(), default=0)) + 1, dtype=np.int64)
    highest[tops.column("a").to_numpy()] = tops.column("best").to_numpy()
    lookup = spark.sparkContext.broadcast(Lookup(hashed, whole("keys"), whole("counts"), highest))
    return narrow.mapInArrow(_rate(shared, lookup), _RESULT)


def op12(spark, folder: str) -> DataFrame:
    found = align(table(spark, folder, "documents"))
    digest = F.when(F.col("groups") == "", "").otherwise(F.sha2(F.col("groups").cast("binary"), 256))
    return found.select("doc_id", *_NUMBERS, digest.alias("groups_sha256"))
