"""Minimal perfect hashing of whole numbers, built in shards.

A shard's keys are hashed into a bit array of twice their number; a key that is alone at its
place sets the bit and has found its place, the others go on to the next, smaller array. The
index of a key is the number of set bits before its own, over all levels, plus the keys of the
shards before its shard. That is about four bits a key, and a key that was not in the set gets
any index or none: whoever looks up compares the key kept at the index.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

GAMMA = 2.0
MOST_LEVELS = 48


def mix(keys: np.ndarray, seed: int) -> np.ndarray:
    """64-bit hashes of uint64 keys."""
    x = keys ^ np.uint64((0x9E3779B97F4A7C15 * (2 * seed + 1)) & 0xFFFFFFFFFFFFFFFF)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(31))


def spread(keys: np.ndarray, seed: int, size: int) -> np.ndarray:
    """Places of keys below ``size`` (below 2^32)."""
    return ((mix(keys, seed) >> np.uint64(32)) * np.uint64(size) >> np.uint64(32)).astype(np.int64)


def build(keys: np.ndarray) -> tuple[list[bytes], np.ndarray]:
    """(packed bits of every level, keys that no level could place); the keys are distinct."""
    levels, left = [], np.ascontiguousarray(keys, dtype=np.uint64)
    while len(left) and len(levels) < MOST_LEVELS:
        size = max(64, -(-int(GAMMA * len(left)) // 64) * 64)
        at = spread(left, len(levels), size)
        alone = np.bincount(at, minlength=size) == 1
        levels.append(np.packbits(alone, bitorder="little").tobytes())
        left = left[~alone[at]]
    return levels, np.sort(left)


@dataclass(frozen=True)
class Shard:
    levels: list[np.ndarray]  # 64-bit words
    ranks: list[np.ndarray]  # set bits before each word
    starts: list[int]  # keys of the levels before
    rest: np.ndarray
    n_keys: int


def load(levels: list[bytes], rest: np.ndarray) -> Shard:
    words, ranks, starts, n = [], [], [], 0
    for packed in levels:
        w = np.frombuffer(packed, dtype="<u8")
        counts = np.bitwise_count(w).astype(np.int64)
        words.append(w)
        ranks.append((np.cumsum(counts) - counts).astype(np.uint32))
        starts.append(n)
        n += int(counts.sum())
    return Shard(words, ranks, starts, np.asarray(rest, dtype=np.uint64), n + len(rest))


def index_in(shard: Shard, keys: np.ndarray) -> np.ndarray:
    out, todo = np.full(len(keys), -1, dtype=np.int64), np.arange(len(keys))
    for level, (words, ranks, start) in enumerate(zip(shard.levels, shard.ranks, shard.starts)):
        if not len(todo):
            return out
        at = spread(keys[todo], level, 64 * len(words))
        word, bit = words[at >> 6], (at & 63).astype(np.uint64)
        hit = (word >> bit) & np.uint64(1) == 1
        below = word[hit] & ((np.uint64(1) << bit[hit]) - np.uint64(1))
        out[todo[hit]] = start + ranks[at[hit] >> 6].astype(np.int64) + np.bitwise_count(below)
        todo = todo[~hit]
    if len(todo) and len(shard.rest):
        at = np.minimum(np.searchsorted(shard.rest, keys[todo]), len(shard.rest) - 1)
        hit = shard.rest[at] == keys[todo]
        out[todo[hit]] = shard.n_keys - len(shard.rest) + at[hit]
    return out


# Which shard a key is in; levels use the seeds from 0.
SHARD_SEED = 1 << 20


@dataclass(frozen=True)
class PerfectHash:
    shards: list[Shard]

    @property
    def n_keys(self) -> int:
        return sum(s.n_keys for s in self.shards)

    def index(self, keys: np.ndarray) -> np.ndarray:
        """A number below ``n_keys`` for every key of the set, each its own; -1 or any number for others."""
        keys = np.ascontiguousarray(keys).astype(np.uint64)
        of, out, before = spread(keys, SHARD_SEED, max(1, len(self.shards))), np.full(len(keys), -1, dtype=np.int64), 0
        for k, shard in enumerate(self.shards):
            mine = np.flatnonzero(of == k)
            if len(mine):
                found = index_in(shard, keys[mine])
                out[mine] = np.where(found >= 0, found + before, -1)
            before += shard.n_keys
        return out
