"""Tokens of two tokenizers aligned by byte offsets, and how many documents link each pair of ids.

The first pass aligns every document and counts the pairs that each holds, once a document. The distinct pairs get a
minimal perfect hash; counts become dense vectors indexed by it, which are summed as a tree. The second pass aligns the
documents again and looks the counts up; the key under every number is verified.
"""

from __future__ import annotations

import functools
import hashlib
import os
import re
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, slices, stored, texts
from .perfect_hash import SHARD_KEYS, PerfectHash, build, shard_of
from .token_counts import SPACE

#: Distinct pairs whose hash and counts a task holds at once; further ones take further passes.
BLOCK_PAIRS = 1 << 22
#: Vectors that are summed at once.
FAN_IN = 32
#: Distinct units whose alignment a Python worker keeps; beyond, it starts afresh.
CACHED = 800_000
SLICE_BYTES = 2 << 20
#: Place of the first tokenizer's id in a pair's key.
SHIFT = 32

#: White space before a space, in ASCII texts and in others.
_ODD = {ascii_only: [c + " " for c in SPACE if not ascii_only or c.isascii()] for ascii_only in (True, False)}
#: No token of either kind crosses a space that follows a character which isn't white space.
_CUT = re.compile(f"(?<=[^{SPACE}]) (?=.)", re.DOTALL)


def _byte_alphabet() -> dict[str, int]:
    """The characters by which byte-level BPE writes bytes: printable ones stand for themselves, others follow from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


class Aligner:
    """Alignments of units (a space and what follows), each distinct unit aligned once; results lie in flat arrays."""

    def __init__(self, path_a: str, path_b: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True  # their strings are plain text
        self.a.no_truncation()
        self.a.no_padding()
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        letters = _byte_alphabet()
        tokens = [self.a.id_to_token(i) or "" for i in range(self.a.get_vocab_size(with_added_tokens=True))]
        self.bytes_a = [bytes(letters[c] for c in t) if all(c in letters for c in t) else t.encode() for t in tokens]
        self.bytes_b = [self._piece(i) for i in range(self.b.get_piece_size())]
        if any("▁" in self.b.id_to_piece(i).lstrip("▁") for i in range(self.b.get_piece_size())):
            raise ValueError("a piece has a space inside: units can't be encoded by themselves")
        self.size_a, self.size_b = (np.array([len(x) for x in own], np.int64) for own in (self.bytes_a, self.bytes_b))
        self.clear()

    def _piece(self, i: int) -> bytes:
        piece = self.b.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace("▁", " ").encode()

    def clear(self) -> None:
        self.turn = getattr(self, "turn", 0) + 1
        self.place: dict[str, int] = {}
        self.valid = np.zeros(0, bool)
        #: per unit: tokens of A, of B, groups, links
        self.sizes = np.zeros((0, 4), np.int32)
        #: groups of the first units as text, made when asked for; ids to make the others from
        self.shown: list[bytes] = []
        self.later: list[tuple] = []
        #: pairs seen (keys, ascending, and their numbers), and the number of each link's pair, in order of units
        self.pair_keys, self.pair_numbers = np.zeros(0, np.int64), np.zeros(0, np.int32)
        self.links, self.link_begin = np.zeros(0, np.int32), np.zeros(1, np.int64)

    def places(self, units: list[str]) -> np.ndarray:
        """The number of each unit; new ones are aligned first."""
        out = np.fromiter(map(self.place.get, units, repeat(-1)), np.int64, len(units))
        if len(new := np.flatnonzero(out < 0)):
            named = [units[i] for i in new.tolist()]
            self._learn(list(dict.fromkeys(named)))
            out[new] = np.fromiter(map(self.place.__getitem__, named), np.int64, len(named))
        return out

    def _learn(self, units: list[str]) -> None:
        raws = [b" " + u.encode() for u in units]
        ids_a = [x.ids for x in self.a.encode_batch_fast([" " + u for u in units], add_special_tokens=False)]
        ids_b = self.b.encode(units, num_threads=1)
        flat_a, flat_b = list(chain.from_iterable(ids_a)), list(chain.from_iterable(ids_b))
        whole, valid = b"".join(raws), np.ones(len(units), bool)
        if not b"".join(map(self.bytes_a.__getitem__, flat_a)) == whole == b"".join(map(self.bytes_b.__getitem__, flat_b)):
            valid = np.array([b"".join(map(self.bytes_a.__getitem__, x)) == r == b"".join(map(self.bytes_b.__getitem__, y)) for r, x, y in zip(raws, ids_a, ids_b)], bool)
            ids_a, ids_b = ([x if ok else [] for x, ok in zip(own, valid.tolist())] for own in (ids_a, ids_b))
            flat_a, flat_b = list(chain.from_iterable(ids_a)), list(chain.from_iterable(ids_b))
        n_a, n_b = (np.fromiter(map(len, own), np.int64, len(units)) for own in (ids_a, ids_b))
        a, b = np.array(flat_a, np.int64), np.array(flat_b, np.int64)
        end_a, end_b = np.cumsum(self.size_a[a]), np.cumsum(self.size_b[b])  # bytes of all valid units, one after another
        both = end_a[np.isin(end_a, end_b, assume_unique=True)]
        first, last = np.searchsorted(end_b, end_a - self.size_a[a], "right"), np.searchsorted(end_b, end_a, "left")
        count = last - first + 1
        token = np.repeat(np.arange(len(a)), count)
        keys = (a[token] << SHIFT) | b[first[token] + np.arange(len(token)) - np.repeat(np.cumsum(count) - count, count)]
        stop_a = np.cumsum(n_a)
        n_links = np.diff(np.concatenate([[0], np.cumsum(count)])[np.concatenate([[0], stop_a])])
        group_a, group_b = np.searchsorted(both, end_a, "left"), np.searchsorted(both, end_b, "left")
        groups = np.diff(np.concatenate([[0], group_a + 1])[stop_a], prepend=0)  # a unit ends where tokens of both end
        self.later.append((a.astype(np.int32), b.astype(np.int32), group_a.astype(np.int32), group_b.astype(np.int32), groups))
        self.place.update(zip(units, range(len(self.valid), len(self.valid) + len(units))))
        self.valid = np.concatenate([self.valid, valid])
        self.sizes = np.concatenate([self.sizes, np.column_stack([n_a, n_b, groups, n_links]).astype(np.int32)])
        self.links = np.concatenate([self.links, self._numbered(keys)])
        self.link_begin = np.concatenate([self.link_begin, self.link_begin[-1] + np.cumsum(n_links)])

    def _numbered(self, keys: np.ndarray) -> np.ndarray:
        """The number of each pair; new pairs get the next ones."""
        distinct = sorted_distinct(keys)
        new = distinct[~np.isin(distinct, self.pair_keys, assume_unique=True)]
        numbers = np.concatenate([self.pair_numbers, np.arange(len(self.pair_keys), len(self.pair_keys) + len(new), dtype=np.int32)])
        every = np.concatenate([self.pair_keys, new])
        order = np.argsort(every, kind="stable")
        self.pair_keys, self.pair_numbers = every[order], numbers[order]
        return self.pair_numbers[np.searchsorted(self.pair_keys, keys)]

    def pairs(self) -> np.ndarray:
        """The key of each pair, by number."""
        out = np.empty(len(self.pair_keys), np.int64)
        out[self.pair_numbers] = self.pair_keys
        return out

    def texts(self) -> list[bytes]:
        """Each unit's groups as text, `a1,a2|b1` each."""
        for a, b, group_a, group_b, groups in self.later:
            if not len(a):
                self.shown += [b""] * len(groups)
                continue
            # Ids in the order of the text, A's before B's in each group, with what follows each of them.
            group, side = np.concatenate([group_a, group_b]), np.repeat([0, 1], [len(a), len(b)])
            order = np.lexsort((side, group))
            last = np.concatenate([group[order][1:] != group[order][:-1], [True]])
            turns = np.concatenate([side[order][1:] != side[order][:-1], [True]])
            unit = np.repeat(np.arange(len(groups)), groups)[group[order]]
            ends = np.concatenate([unit[1:] != unit[:-1], [True]])
            mark = np.where(ends, "\n", np.where(last, ";", np.where(turns, "|", ","))).tolist()
            text = "".join(chain.from_iterable(zip(map(str, np.concatenate([a, b])[order].tolist()), mark))).encode().split(b"\n")
            made = iter(text)
            self.shown += [next(made) if n else b"" for n in groups.tolist()]
        self.later.clear()
        return self.shown


@functools.lru_cache(maxsize=1)
def _aligner(path_a: str, path_b: str) -> Aligner:
    return Aligner(path_a, path_b)


def sorted_distinct(values: np.ndarray) -> np.ndarray:
    own = np.sort(values)
    return own[np.concatenate([[True], own[1:] != own[:-1]])] if len(own) else own


def units_of(text: str) -> list[str]:
    """The text cut before each space that follows a character which isn't white space, without those spaces."""
    if not text:
        return []
    odd = text[0] == " " or text[-1] == " " or any(x in text for x in _ODD[text.isascii()])
    return _CUT.split(text) if odd else text.split(" ")


class _Aligned:
    """The texts of a batch as numbers of units; texts that either tokenizer doesn't give back have none."""

    def __init__(self, own: Aligner, raw: list[str]):
        if len(own.place) > CACHED:
            own.clear()
        split = [units_of(t) for t in raw]
        every = own.places(list(chain.from_iterable(split)))
        n = np.fromiter(map(len, split), np.int64, len(split))
        doc = np.repeat(np.arange(len(raw)), n)
        valid = own.valid[every]
        if not valid.all():
            bad = np.zeros(len(raw), bool)
            bad[doc[~valid]] = True
            keep = ~bad[doc]
            every, doc = every[keep], doc[keep]
        self.n, self.units, self.doc = len(raw), every, doc
        self.edge = np.searchsorted(doc, np.arange(self.n + 1))

    def sums(self, of_unit: np.ndarray) -> np.ndarray:
        """Sums over each text's units of a column."""
        total = np.concatenate([[0], np.cumsum(of_unit[self.units], dtype=np.int64)])
        return total[self.edge[1:]] - total[self.edge[:-1]]

    def shown(self, own: Aligner) -> list[str]:
        units, texts, edge = self.units.tolist(), own.texts(), self.edge.tolist()
        return [hashlib.sha256(b";".join(map(texts.__getitem__, units[i:j]))).hexdigest() if j > i else "" for i, j in zip(edge, edge[1:])]

    def held(self, own: Aligner) -> np.ndarray:
        """In how many of these texts each pair is linked, by number."""
        doc, unit = np.divmod(sorted_distinct(self.doc * np.int64(max(len(own.valid), 1)) + self.units), max(len(own.valid), 1))
        n = own.link_begin[unit + 1] - own.link_begin[unit]
        at = np.repeat(own.link_begin[unit] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        size = max(len(own.pair_keys), 1)
        return np.bincount(sorted_distinct(np.repeat(doc, n) * np.int64(size) + own.links[at]) % size, minlength=len(own.pair_keys))


def pair_counts(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """docs(text) -> task, key, n: documents that link a pair, in pieces that are still to be summed."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, task = _aligner(path_a, path_b), TaskContext.get().partitionId()
        turn, total = own.turn, np.zeros(0, np.int64)

        def counted(keys: np.ndarray) -> pa.RecordBatch:
            some = np.flatnonzero(total)
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(some), task, np.int64)), pa.array(keys[some]), pa.array(total[some])], names=["task", "key", "n"])

        for part in slices(batches, size=SLICE_BYTES):
            keys = own.pairs() if len(own.place) > CACHED else None  # the numbers are about to be given anew
            found = _Aligned(own, texts(part))
            if own.turn != turn:
                yield counted(keys)
                turn, total = own.turn, np.zeros(0, np.int64)
            here = found.held(own)
            here[: len(total)] += total
            total = here
        yield counted(own.pairs())

    return docs.select("text").mapInArrow(count, "task long, key long, n long")


def _with_shard(keys: DataFrame, shards: int) -> DataFrame:
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.append_column("shard", pa.array(shard_of(np.asarray(batch.column("key")), shards)))

    return keys.mapInArrow(add, ", ".join([*(f"{n} long" for n in keys.columns), "shard long"]))


def summed_vectors(counts: DataFrame, hashed: Broadcast) -> DataFrame:
    """counts(task, key, n) -> shard, vector: one dense vector of counts for each shard of the hash.

    Each task adds its rows into a vector indexed by the hash; vectors of a shard are then summed FAN_IN at a time,
    level by level, so no task holds more than FAN_IN of them.
    """

    def dense(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, task = hashed.value, TaskContext.get().partitionId()
        total = np.zeros(len(own.keys), np.int64)
        for batch in batches:
            at = own.numbers(np.asarray(batch.column("key")))
            here = at >= 0  # the other keys are of other blocks
            np.add.at(total, at[here], np.asarray(batch.column("n"))[here])
        cut = [total[i:j].tobytes() for i, j in zip(own.base, own.base[1:])]
        some = [i for i, x in enumerate(cut) if any(x)]
        yield pa.RecordBatch.from_arrays([pa.array(own.own[some]), pa.array([task] * len(some), pa.int64()), pa.array([cut[i] for i in some], pa.binary())], names=["shard", "task", "vector"])

    def add(key, frame: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(x, np.int64) for x in frame["vector"])
        return pd.DataFrame({"shard": [key[0]], "task": [key[1]], "vector": [total.tobytes()]})

    rows, tasks = counts.select("key", "n").mapInArrow(dense, "shard long, task long, vector binary"), counts.rdd.getNumPartitions()
    while True:
        rows = rows.groupBy("shard", F.floor(F.col("task") / FAN_IN).alias("task")).applyInPandas(add, "shard long, task long, vector binary")
        tasks = -(-tasks // FAN_IN)
        if tasks <= 1:
            return stored(rows.select("shard", "vector"))


def _highest(hashes: DataFrame, vectors: DataFrame, size: int) -> np.ndarray:
    """The highest count of each of the first tokenizer's ids: a number an id, whatever the corpus."""

    def most(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top = np.zeros(size, np.int64)
        for batch in batches:
            for keys, counts in zip(batch.column("ordered").to_pylist(), batch.column("vector").to_pylist()):
                np.maximum.at(top, np.frombuffer(keys, np.int64) >> SHIFT, np.frombuffer(counts, np.int64))
        a = np.flatnonzero(top)
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(top[a])], names=["a", "n"])

    out = np.zeros(size, np.int64)
    for row in hashes.join(vectors, "shard").select("ordered", "vector").mapInArrow(most, "a long, n long").groupBy("a").agg(F.max("n").alias("n")).collect():
        out[row["a"]] = row["n"]
    return out


class _Scores:
    """Per unit: links whose count is their A id's highest, and the sum of its links' counts."""

    def __init__(self, own: Aligner, hashed: PerfectHash, counts: np.ndarray, highest: np.ndarray):
        self.own, self.hashed, self.counts, self.highest = own, hashed, counts, highest
        self.turn, self.values, self.of_pair = -1, np.zeros((0, 2), np.int64), np.zeros((0, 2), np.int64)

    def updated(self) -> np.ndarray:
        own = self.own
        if self.turn != own.turn:
            self.turn, self.values, self.of_pair = own.turn, np.zeros((0, 2), np.int64), np.zeros((0, 2), np.int64)
        done = len(self.values)
        if len(self.of_pair) < len(own.pair_keys):
            keys = own.pairs()[len(self.of_pair) :]
            at = self.hashed.numbers(keys)
            n = np.where(at >= 0, self.counts[at], 0) if len(self.counts) else np.zeros(len(keys), np.int64)
            self.of_pair = np.concatenate([self.of_pair, np.column_stack([(n > 0) & (n == self.highest[keys >> SHIFT]), n])])
        if done < len(own.valid):
            total = np.concatenate([np.zeros((1, 2), np.int64), np.cumsum(self.of_pair[own.links[own.link_begin[done] :]], axis=0)])
            edge = own.link_begin[done:] - own.link_begin[done]
            self.values = np.concatenate([self.values, total[edge[1:]] - total[edge[:-1]]])
        return self.values


_RESULT = "doc_id long, h binary, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def _looked_up(docs: DataFrame, path_a: str, path_b: str, table: Broadcast) -> DataFrame:
    """Every document's result by the pairs of one block."""

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _aligner(path_a, path_b)
        scores = _Scores(own, *table.value)
        for batch in slices(batches, size=SLICE_BYTES):
            raw = texts(batch)
            found = _Aligned(own, raw)
            columns = [found.sums(c) for c in (*own.sizes.T, *scores.updated().T)]
            names = pa.array([xxhash.xxh3_128_digest(t.encode()) for t in raw], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), names, *map(pa.array, columns), pa.array(found.shown(own), pa.string())], names=[x.split()[0] for x in _RESULT.split(", ")])

    return docs.mapInArrow(look_up, _RESULT)


def align(docs: DataFrame, path_a: str, path_b: str, block_pairs: int = BLOCK_PAIRS) -> DataFrame:
    """docs(doc_id, text) -> doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    path_a: a byte-level `tokenizers` file; path_b: a `sentencepiece` model that adds a space. A text's tokens are those
    of a space and the text; offsets where tokens of both end cut it into groups; tokens whose bytes overlap are linked.
    A pair's count is the number of documents that link it. Null and empty texts, and those whose bytes either tokenizer
    doesn't give back, have no tokens: zeros and ''. Rows count each, also those of one id and equal ones. A text of any
    length is read whole. Empty table: no rows. Other columns are ignored.
    """
    own = documents(docs)
    sc = own.sparkSession.sparkContext
    counts = stored(pair_counts(own, path_a, path_b))
    keys = stored(counts.select("key").distinct())
    shards = max(1, -(-keys.count() // SHARD_KEYS))
    hashes = stored(build(_with_shard(keys, shards), shards))
    width = max(1, block_pairs // SHARD_KEYS)
    size_a = len(_aligner(path_a, path_b).bytes_a)
    blocks, highest = [], np.zeros(size_a, np.int64)
    for begin in range(0, shards, width):
        inside = hashes.where((F.col("shard") >= begin) & (F.col("shard") < begin + width))
        hashed = sc.broadcast(PerfectHash.of(inside.orderBy("shard").collect(), shards))
        blocks.append((inside, summed_vectors(counts, hashed)))
        highest = np.maximum(highest, _highest(*blocks[-1], size_a))
        hashed.destroy()  # what came of it is stored
    done = []
    for inside, vectors in blocks:
        hashed = PerfectHash.of(inside.orderBy("shard").collect(), shards)
        summed = [np.frombuffer(r["vector"], np.int64) for r in vectors.orderBy("shard").collect()]
        done.append(_looked_up(own, path_a, path_b, sc.broadcast((hashed, np.concatenate([np.zeros(0, np.int64), *summed]), highest))))
    if len(done) == 1:
        return done[0].drop("h")
    # Each block gave every row once; a link's count is in one block.
    rows = functools.reduce(DataFrame.unionByName, done)
    same = ("n_a", "n_b", "n_groups", "n_links")
    copies = F.count("*") / F.lit(len(done))
    joined = rows.groupBy("doc_id", "h").agg(
        copies.cast("long").alias("copies"), *(F.max(x).alias(x) for x in (*same, "groups_sha256")), *((F.sum(x) / copies).cast("long").alias(x) for x in ("n_best", "count_sum"))
    )
    return joined.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).select("doc_id", *same, "n_best", "count_sum", "groups_sha256")
