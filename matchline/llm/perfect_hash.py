"""A minimal perfect hash of many distinct 64-bit keys, built shard by shard.

Levels of bit arrays: a key that alone hits its bit of a level is settled there; the others go on to the next level. A
key's number is the rank of its bit. Each shard is built in one task; lookups of whole arrays are vectorised and verify
the key that stands under its number.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text_arrays import mixed

#: Keys of a shard on average.
SHARD_KEYS = 1 << 15
#: Bits a key has in its level; more bits settle more keys at once.
ROOM = 2


def shard_of(keys: np.ndarray, shards: int) -> np.ndarray:
    return (mixed(keys.astype(np.uint64) + np.uint64(0x5BD1E995)) % np.uint64(shards)).astype(np.int64)


def _places(keys: np.ndarray, level: int, size: int) -> np.ndarray:
    return (mixed(keys ^ np.uint64((level * 0x9E3779B97F4A7C15) % (1 << 64))) % np.uint64(size)).astype(np.int64)


def levels(keys: np.ndarray) -> list[np.ndarray]:
    """Boolean arrays, one per level, that give distinct keys distinct ranks without a gap."""
    out, left = [], keys.astype(np.uint64)
    while len(left):
        size = max(8, ROOM * len(left))
        at = _places(left, len(out), size)
        alone = np.bincount(at, minlength=size) == 1
        out.append(alone)
        left = left[~alone[at]]
    return out


def ranks(keys: np.ndarray, built: list[np.ndarray]) -> np.ndarray:
    """The number of each key; -1 for one that no level settles. Keys outside the built set may get any number."""
    keys = keys.astype(np.uint64)
    out, left, before = np.full(len(keys), -1, np.int64), np.arange(len(keys)), 0
    for level, alone in enumerate(built):
        at = _places(keys[left], level, len(alone))
        hit = alone[at]
        number = np.cumsum(alone) - 1 + before
        out[left[hit]] = number[at[hit]]
        left, before = left[~hit], before + int(alone.sum())
    return out


def build(keys: DataFrame, shards: int) -> DataFrame:
    """keys(key: long, distinct; shard: by shard_of) -> shard, size, widths and bits of the levels, keys in order of their numbers."""

    def one(key, frame: pd.DataFrame) -> pd.DataFrame:
        own = frame["key"].to_numpy(np.int64).view(np.uint64)
        built = levels(own)
        placed = np.empty_like(own)
        placed[ranks(own, built)] = own
        bits = np.packbits(np.concatenate(built), bitorder="little").tobytes()
        return pd.DataFrame({"shard": [key[0]], "size": [len(own)], "widths": [np.array([len(x) for x in built], np.int64).tobytes()], "bits": [bits], "ordered": [placed.tobytes()]})

    return keys.groupBy("shard").applyInPandas(one, "shard long, size long, widths binary, bits binary, ordered binary")


@dataclass
class PerfectHash:
    """Some shards of the hash: number(key) is its place among the keys of these shards; counts can be put beside it.

    shards: how many there are in all; own: those in here, ascending; base: the first number of each.
    """

    shards: int
    own: np.ndarray
    base: np.ndarray
    level_begin: np.ndarray  # per shard: its first level among all levels of these shards
    widths: np.ndarray
    bit_begin: np.ndarray
    bits: np.ndarray  # one byte a bit
    rank: np.ndarray
    keys: np.ndarray

    @staticmethod
    def of(rows: list, shards: int) -> PerfectHash:
        """rows of build(), ordered by shard."""
        widths = [np.frombuffer(r["widths"], np.int64) for r in rows]
        bits = [np.unpackbits(np.frombuffer(r["bits"], np.uint8), bitorder="little", count=int(w.sum())) for r, w in zip(rows, widths)]
        n_levels, flat = [len(w) for w in widths], np.concatenate([np.zeros(0, np.int64), *widths])
        every = np.concatenate([np.zeros(0, np.uint8), *bits])
        return PerfectHash(
            shards, np.array([r["shard"] for r in rows], np.int64), np.cumsum([0, *(r["size"] for r in rows)]), np.cumsum([0, *n_levels]), flat, np.cumsum(flat) - flat, every,
            (np.cumsum(every, dtype=np.int64) - every).astype(np.int32), np.concatenate([np.zeros(0, np.uint64), *(np.frombuffer(r["ordered"], np.uint64) for r in rows)]),
        )

    def numbers(self, keys: np.ndarray) -> np.ndarray:
        """The number of each key (long), -1 for keys that aren't in these shards; every number is verified by its key."""
        keys = keys.view(np.uint64)
        out = np.full(len(keys), -1, np.int64)
        if not len(self.own):
            return out
        shard = shard_of(keys, self.shards)
        place = np.minimum(np.searchsorted(self.own, shard), len(self.own) - 1)
        left = np.flatnonzero(self.own[place] == shard)
        level = 0
        while len(left):
            at = self.level_begin[place[left]] + level
            inside = at < self.level_begin[place[left] + 1]
            left, at = left[inside], at[inside]
            hash_level = np.uint64((level * 0x9E3779B97F4A7C15) % (1 << 64))
            bit = self.bit_begin[at] + (mixed(keys[left] ^ hash_level) % self.widths[at].astype(np.uint64)).astype(np.int64)
            hit = self.bits[bit] == 1
            # Bits are ranked across all levels of these shards, in the order of numbers.
            out[left[hit]] = self.rank[bit[hit]]
            left, level = left[~hit], level + 1
        found = np.flatnonzero(out >= 0)
        out[found[self.keys[out[found]] != keys[found]]] = -1
        return out
