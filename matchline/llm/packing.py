"""Best-fit packing of tokenised documents with certified bin counts.

Pieces are dealt to partitions of a bounded size and packed by best-fit decreasing. Dual-feasible functions give each
partition a lower bound on its bins; a partition that meets its bound is certified optimal. Those with a gap give up
their emptiest bins; the pieces in them are exchanged between partitions and packed again, and a new packing replaces the
old one where it needs fewer bins.
"""

from __future__ import annotations

import functools
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, documents, slices

CAPACITY = 2048
#: Pieces of a partition, on average.
PARTITION = 50_000
ROUNDS = 3
#: Bytes of text that are cut into words at once.
SLICE_BYTES = 6 << 20
#: Words whose ids a Python worker keeps; beyond, it starts afresh.
CACHED = 1_000_000

_ITEM = "doc_id long, piece int, start long, length long, ids_crc32 long"
_PLACED = f"{_ITEM}, sequence_id long, offset long, part long, gap int"


class WordIds:
    """Ids of words by a `tokenizers` file, each distinct word encoded once; all ids lie in one array."""

    #: Symbols that may stand between words, of which the first that is a token of its own is taken. ASCII, so their
    #: bytes are part of no other character, and no character is normalised to them.
    MARKS = "~^|"

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
        self.folds = self._ids([upper]) == self._ids([upper.lower()])
        single = [(m, ids[0]) for m in self.MARKS if len(ids := self._ids([m])[0]) == 1]
        self.mark, self.mark_id = single[0] if single else ("", -1)
        self._clear()

    def _ids(self, texts: list[str]) -> list[list[int]]:
        return [x.ids for x in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _clear(self) -> None:
        self.place: dict[str, int] = {"": 0}
        self.begin, self.length, self.flat = np.zeros(1, np.int64), np.zeros(1, np.int64), np.zeros(0, np.uint32)

    def _learn(self, words: list[str]) -> None:
        """Encodes words a thousand at a time, a mark between them; words that hold the mark one by one."""
        joined = [w for w in words if self.mark and self.mark not in w]
        apart = [w for w in words if not self.mark or self.mark in w]
        flat, lengths = [], []
        for ids in self._ids([f" {self.mark} ".join(joined[i : i + 1000]) for i in range(0, len(joined), 1000)]):
            ids = np.array(ids, np.uint32)
            at = np.flatnonzero(ids == self.mark_id)
            lengths.append(np.diff(np.concatenate([[-1], at, [len(ids)]])) - 1)
            flat.append(np.delete(ids, at))
        for ids in self._ids(apart):
            lengths.append(np.array([len(ids)]))
            flat.append(np.array(ids, np.uint32))
        if not lengths:
            return
        more = np.concatenate(lengths)
        self.place.update(zip(joined + apart, range(len(self.length), len(self.length) + len(more))))
        self.begin = np.concatenate([self.begin, len(self.flat) + np.cumsum(more) - more])
        self.length = np.concatenate([self.length, more])
        self.flat = np.concatenate([self.flat, *flat])

    def encode(self, column: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """Texts (null: empty) -> ids of all of them, end_id after each, and where each text's ids end.

        Words are cut at ASCII white space; other white space stays inside a word, for the tokenizer to drop. A-Z is
        lower-cased before where the tokenizer does so, but not where a special token's string might come of it.
        """
        column = pc.fill_null(column, "")
        if self.folds:
            column = pc.if_else(pc.match_substring(column, "<|"), column, pc.ascii_lower(column))
        cut = pc.ascii_split_whitespace(column)
        coded = cut.flatten().dictionary_encode()
        distinct = _strings(coded.dictionary)
        if len(self.place) > CACHED:
            self._clear()
        self._learn([w for w in distinct if w not in self.place])
        word = np.fromiter(map(self.place.__getitem__, distinct), np.int64, len(distinct))[np.asarray(coded.indices)]
        length = self.length[word]
        ends = np.concatenate([[0], np.cumsum(length)])
        ids = self.flat[np.arange(ends[-1]) + np.repeat(self.begin[word] - ends[:-1], length)]
        offsets = np.asarray(cut.offsets, np.int64)
        own_end = ends[offsets[1:] - offsets[0]]
        return np.insert(ids, own_end, np.uint32(end_id)).astype("<u4"), own_end + np.arange(1, len(own_end) + 1)


def _strings(words: pa.Array) -> list[str]:
    """Words without blanks as Python strings, by way of one string of them all."""
    if not len(words):
        return []
    whole = pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words.cast(pa.string()))
    return pc.binary_join(whole, " ")[0].as_py().split(" ")


@functools.lru_cache(maxsize=2)
def _word_ids(path: str) -> WordIds:
    return WordIds(path)


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = 0, keep_ids: bool = False) -> DataFrame:
    """docs(doc_id, text) -> doc_id, piece, start, length, ids_crc32 (and ids, binary, on request).

    tokenizer: a `tokenizers` file that drops white space, so that a text's ids are those of its words one after
    another; each distinct word is encoded once per worker. end_id closes each document. Only longer documents are cut.
    Null or empty text: one piece with the end alone. Null and repeated ids: kept. Other columns are ignored.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _word_ids(tokenizer)
        for batch in slices(batches, size=SLICE_BYTES):
            ids, ends = own.encode(batch.column("text"), end_id)
            begins = np.concatenate([[0], ends[:-1]]).astype(np.int64)
            n = -(-(ends - begins) // capacity)
            doc = np.repeat(np.arange(len(n)), n)
            piece = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            at = begins[doc] + piece * capacity
            to = np.minimum(at + capacity, ends[doc])
            raw = memoryview(ids.tobytes())
            cut = [raw[4 * i : 4 * j] for i, j in zip(at.tolist(), to.tolist())]
            columns = [batch.column("doc_id").take(pa.array(doc)), pa.array(piece, pa.int32()), pa.array(piece * capacity), pa.array(to - at), pa.array(map(zlib.crc32, cut), pa.int64())]
            if keep_ids:
                columns.append(pa.array(map(bytes, cut), pa.binary()))
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: len(columns)])

    return documents(docs).mapInArrow(encode, _ITEM + ", ids binary" * keep_ids)


def best_fit(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each size by best-fit decreasing. Open bins are found by the bits of their free room."""
    order = np.argsort(-sizes, kind="stable")
    bins, offsets = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    free: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms, n = 0, 0
    for i, size in zip(order.tolist(), sizes[order].tolist()):
        if fitting := rooms >> size:
            room = size + (fitting & -fitting).bit_length() - 1
            at = free[room].pop()
            if not free[room]:
                rooms ^= 1 << room
        else:
            room, at, n = capacity, n, n + 1
        bins[i], offsets[i] = at, capacity - room
        if left := room - size:
            free[left].append(at)
            rooms |= 1 << left
    return bins, offsets


def lower_bound(counts: np.ndarray, capacity: int) -> int:
    """Bins that sizes need at least; counts[s] is how often size s (1 to capacity) occurs.

    The largest value of three families of dual-feasible functions (Fekete and Schepers): a sum of such function
    values over any feasible bin is at most 1.
    """
    x = np.flatnonzero(counts)
    x = x[x > 0]
    if not len(x):
        return 0
    c = counts[x].astype(float)
    best = float((c * x).sum()) / capacity
    for k in range(1, 21):
        scaled = (k + 1) * x
        best = max(best, float((c * np.where(scaled % capacity == 0, x / capacity, (scaled // capacity) / k)).sum()))
    for e in range(1, capacity // 2 + 1):
        small, large = x < e, x > capacity - e
        best = max(best, float((c * np.where(large, 1.0, np.where(small, 0.0, x / capacity))).sum()))
        whole = capacity // e
        best = max(best, float((c * np.where(2 * x > capacity, 1 - ((capacity - x) // e) / whole, np.where(small, 0.0, 1 / whole))).sum()))
    return int(np.ceil(best - 1e-6))


def pack(items: DataFrame, capacity: int = CAPACITY, partition: int = PARTITION, rounds: int = ROUNDS) -> DataFrame:
    """items(doc_id, piece, start, length, ids_crc32; 1 <= length <= capacity) -> with sequence_id and offset.

    Rows that are alike are packed one by one. Further columns: part (the partition that packed it last) and gap (its
    bins over its lower bound; 0 certifies it, null: bins left over by an open partition). Nothing but counts reaches the driver.
    """
    items = checkpointed(items)
    parts = max(1, -(-items.count() // partition))
    where = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(parts))

    def first(key, frame: pd.DataFrame) -> pd.DataFrame:
        sizes = frame["length"].to_numpy()
        bins, offsets = best_fit(sizes, capacity)
        gap = int(bins.max()) + 1 - lower_bound(np.bincount(sizes, minlength=capacity + 1), capacity)
        return frame.assign(sequence_id=(int(key[0]) << 24) + bins, offset=offsets, part=int(key[0]), gap=gap)[[x.split()[0] for x in _PLACED.split(", ")]]

    done = checkpointed(items.withColumn("part", where).groupBy("part").applyInPandas(first, _PLACED))
    for turn in range(1, rounds + 1):
        open_parts = done.where("gap > 0").select("part", "gap").distinct()
        if open_parts.select("part").limit(2).count() < 2:  # nobody to exchange with
            break
        # Each open partition gives up the bins filled to less than 63/64; whole bins move, so the old packing stays valid.
        loose = done.where("gap > 0").groupBy("sequence_id").agg(F.sum("length").alias("filled")).where(F.col("filled") < capacity - capacity // 64).select("sequence_id")
        moved = checkpointed(done.join(loose, "sequence_id", "left_semi"))
        n = moved.count()
        if not n:
            break
        groups = max(1, -(-n // partition))

        def again(key, frame: pd.DataFrame, turn=turn) -> pd.DataFrame:
            sizes = frame["length"].to_numpy()
            bins, offsets = best_fit(sizes, capacity)
            need, had = int(bins.max()) + 1, frame["sequence_id"].nunique()
            number = (turn << 56) + (int(key[0]) << 24)
            gap = min(need, had) - lower_bound(np.bincount(sizes, minlength=capacity + 1), capacity)
            frame = frame.assign(part=number >> 24, gap=gap)
            return frame.assign(sequence_id=number + bins, offset=offsets) if need < had else frame

        repacked = moved.withColumn("group", F.pmod(F.xxhash64("sequence_id", F.lit(turn)), F.lit(groups))).groupBy("group").applyInPandas(lambda key, f: again(key, f.drop(columns="group")), _PLACED)
        stayed = done.join(loose, "sequence_id", "left_anti").withColumn("gap", F.when(F.col("gap") == 0, F.col("gap")))  # the rest of an open partition isn't certified
        done = checkpointed(stayed.select(repacked.columns).unionByName(repacked))
    return done


def certificate(items: DataFrame, packed: DataFrame, capacity: int = CAPACITY) -> dict[str, int]:
    """Sequences used and the lower bound over all items, from a histogram of at most `capacity` rows."""
    counts = np.zeros(capacity + 1, np.int64)
    for row in items.groupBy("length").count().collect():
        counts[row["length"]] = row["count"]
    return {"sequences": packed.select("sequence_id").distinct().count(), "lower_bound": lower_bound(counts, capacity)}
