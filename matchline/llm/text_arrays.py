"""Words and shingles of many texts at once, as NumPy arrays of 64-bit hashes."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads all bits (the finaliser of MurmurHash3)."""
    x = x ^ (x >> np.uint64(33))
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        for k, base in enumerate((_BASE, _INVERSE)):
            row = np.full(n, base, np.uint64)
            row[0] = 1
            _powers[k] = np.cumprod(row, dtype=np.uint64)
    return _powers[0][:n], _powers[1][:n]


@dataclass
class Words:
    """hashes of all words in order; starts[d] to starts[d + 1] are those of text d; raw[begin:end] is a word."""

    hashes: np.ndarray
    starts: np.ndarray
    raw: bytes
    begin: np.ndarray
    end: np.ndarray

    def own(self, i: int, j: int) -> bytes:
        """The bytes from word i up to word j - 1."""
        return self.raw[self.begin[i] : self.end[j - 1]] if j > i else b""


def split_words(raws: list[bytes]) -> Words:
    """Words `[^\\x20\\x09-\\x0D]+` with A-Z lower-cased, of UTF-8 texts."""
    raw = b"\n".join(raws).lower() + b"\n"
    data = np.frombuffer(raw, np.uint8)
    blank = (data == 32) | ((data >= 9) & (data <= 13))
    edge = np.flatnonzero(np.diff(np.concatenate([[True], blank]).astype(np.int8)))
    begin, end = edge[::2], edge[1::2]
    power, inverse = _power(len(data))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power, dtype=np.uint64)])
    hashes = mixed((sums[end] - sums[begin]) * inverse[begin] + (end - begin).astype(np.uint64))
    ends = np.cumsum([len(r) + 1 for r in raws]) if raws else np.zeros(0, np.int64)
    return Words(hashes, np.concatenate([[0], np.searchsorted(begin, ends)]).astype(np.int64), raw, begin, end)


def shingles(words: np.ndarray, starts: np.ndarray, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of runs of k words and where each text's begin; a text of 1 to k - 1 words has one shingle of them all."""
    lengths = np.diff(starts)
    n = np.where(lengths >= k, lengths - k + 1, (lengths > 0).astype(np.int64))
    out_starts = np.concatenate([[0], np.cumsum(n)]).astype(np.int64)
    at = np.arange(out_starts[-1]) + np.repeat(starts[:-1] - out_starts[:-1], n)
    last = np.repeat(starts[1:], n)
    value = np.zeros(len(at), np.uint64)
    for i in range(k):
        inside = at + i < last
        value = mixed(value + np.where(inside, words[np.minimum(at + i, max(len(words) - 1, 0))] if len(words) else 0, 0).astype(np.uint64) + _BASE)
    return value, out_starts


def labelled(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Values told apart by how often the same value stood earlier in the text."""
    text = np.repeat(np.arange(len(starts) - 1, dtype=np.uint64), np.diff(starts))
    own = mixed(values + text * np.uint64(0xD6E8FEB86659FD93))
    order = np.argsort(own, kind="stable")
    new = np.concatenate([[True], own[order][1:] != own[order][:-1]]) if len(order) else np.zeros(0, bool)
    first = np.maximum.accumulate(np.where(new, np.arange(len(order)), 0)) if len(order) else order
    earlier = np.empty(len(order), np.uint64)
    earlier[order] = (np.arange(len(order)) - first).astype(np.uint64)
    return mixed(values + earlier * np.uint64(0xA0761D6478BD642F))
