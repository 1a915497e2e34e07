"""Benchmark decontamination: rare n-gram seeds find candidate passages, Smith-Waterman alignment scores them.

First the texts that hold each n-gram of the test items are counted. A seed is rare if few texts hold it, or not many
more than its item's seeds usually have, so that an item that was copied often is still found, with all its edited
copies; at least half of an item's seeds are rare by that rule. Only rare seeds are looked up again: places whose offset
to the item agrees form a passage, which is cut out and aligned with the item where the text is read. The alignment
tolerates replaced, missing and added words. So the corpus isn't shuffled, and no item gathers its texts in one task. Test
items are taken in blocks of a bounded size; each block's n-grams are broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, documents, raw_texts, slices
from .text_arrays import mixed, split_words

NGRAM = 3
#: A seed in at most so many documents is rare, or in at most so many times the median of its item's seeds.
RARE_DOCS = 50
TIMES_USUAL = 4.0
#: Alignment score (match 2, mismatch and gap -1) over that of the whole item.
SCORE = 0.5
#: Characters of test items whose n-grams are broadcast at once.
BLOCK_CHARS = 20_000_000


def grams(words: np.ndarray, n: int = NGRAM) -> np.ndarray:
    """Hashes of all runs of n words; a shorter text has one of all its words."""
    n = min(n, len(words))
    value = np.zeros(len(words) - n + 1 if n else 0, np.uint64)
    for i in range(n):
        value = mixed(value + words[i : len(words) - n + 1 + i] + np.uint64(0x9E3779B97F4A7C15))
    return value


def align(item: np.ndarray, passage: np.ndarray) -> tuple[int, int, int]:
    """Best local alignment of word hashes: score, first and one past the last word of it in the passage."""

    def best(a: np.ndarray, b: np.ndarray) -> tuple[int, int, int]:
        step = np.arange(len(b) + 1)
        row, top, at, to = np.zeros(len(b) + 1, np.int64), 0, 0, 0
        for i, word in enumerate(a):
            new = np.zeros(len(b) + 1, np.int64)
            new[1:] = np.maximum(row[:-1] + np.where(b == word, 2, -1), row[1:] - 1)
            row = np.maximum(np.maximum.accumulate(np.maximum(new, 0) + step) - step, 0)  # gaps in the item, one step at a time
            if (k := int(row.argmax())) and row[k] > top:
                top, at, to = int(row[k]), i + 1, k
        return top, at, to

    if not len(item) or not len(passage):
        return 0, 0, 0
    score, i, end = best(item, passage)
    _, _, back = best(item[:i][::-1], passage[:end][::-1])
    return score, end - back, end


class _Items:
    """A block of test items: the places of their n-grams, sorted by hash, and which of them are rare."""

    def __init__(self, items: list[tuple[int, bytes]], n: int):
        split = [(i, w) for i, raw in items if len(w := split_words([raw]).hashes)]
        self.ids, self.words = [i for i, _ in split], [w for _, w in split]
        parts = [grams(w, n) for w in self.words]
        keys = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
        order = np.argsort(keys, kind="stable")
        self.keys = keys[order]
        self.item = np.repeat(np.arange(len(parts)), [len(g) for g in parts])[order]
        self.place = np.concatenate([np.arange(len(g)) for g in parts])[order] if parts else order
        self.lengths = np.array([len(w) for w in self.words], np.int64)
        #: Distinct n-grams, where the entries of each begin, and sizes of n-grams in use.
        self.seeds, self.first = np.unique(self.keys, return_index=True)
        self.sizes = sorted({min(n, len(w)) for w in self.words})

    def hits(self, words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Seed, word number and text of every place of the block's n-grams in some texts."""
        out = [np.zeros((0, 3), np.int64)]
        for size in self.sizes if len(words.hashes) else ():
            key = grams(words.hashes, size) if len(words.hashes) >= size else np.zeros(0, np.uint64)
            at = np.minimum(np.searchsorted(self.seeds, key), len(self.seeds) - 1)
            hit = np.flatnonzero(self.seeds[at] == key)
            doc = np.searchsorted(words.starts, hit, side="right") - 1
            inside = hit + size <= words.starts[doc + 1]
            out.append(np.column_stack([at[hit], hit, doc])[inside])
        return tuple(np.concatenate(out).T)

    def judge(self, n_docs: np.ndarray, rare_docs: float, times_usual: float) -> None:
        """Keeps the entries of rare seeds: held by rare_docs texts at most, or by times_usual the median of their item's."""
        held = np.repeat(n_docs, np.diff(np.concatenate([self.first, [len(self.keys)]])))
        usual = np.zeros(len(self.ids))
        order = np.lexsort((held, self.item))
        for i, own in enumerate(np.split(held[order], np.cumsum(np.bincount(self.item, minlength=len(self.ids)))[:-1]) if len(self.ids) else ()):
            usual[i] = np.median(own)
        rare = held <= np.maximum(rare_docs, times_usual * usual[self.item])
        self.item, self.place = self.item[rare], self.place[rare]
        kept = np.concatenate([[0], np.cumsum(rare)])
        self.first = kept[np.concatenate([self.first, [len(rare)]])]  # entries of seed s: first[s] to first[s + 1]


def _spread(docs: DataFrame, items, n: int) -> np.ndarray:
    """In how many rows each seed of the block stands; as many sums as seeds reach the driver."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: _Items = items.value
        sums = np.zeros(len(own.seeds), np.int64)
        for batch in slices(batches):
            seed, _, doc = own.hits(split_words(raw_texts(batch)))
            sums += np.bincount(np.unique(doc * len(own.seeds) + seed) % max(1, len(own.seeds)), minlength=len(sums))
        at = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(sums[at])], names=["seed", "n"])

    table = docs.select("text").mapInArrow(count, "seed long, n long").groupBy("seed").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(len(items.value.seeds), np.int64)
    out[np.asarray(table.column("seed"))] = np.asarray(table.column("n"))
    return out


def _aligned(docs: DataFrame, items, least: float) -> DataFrame:
    """Aligned passages of rare seeds: doc_id, item_id, score (at least `least`), first_word, end_word."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: _Items = items.value
        for batch in slices(batches):
            words = split_words(raw_texts(batch))
            seed, at, doc = own.hits(words)
            n = own.first[seed + 1] - own.first[seed] if len(seed) else seed
            entry = np.repeat(own.first[seed], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            item, at, doc = own.item[entry], np.repeat(at, n), np.repeat(doc, n)
            # Where the item would begin; passages reach one item length to both sides of a cell.
            cell = (at - words.starts[doc] - own.place[entry]) // own.lengths[item]
            rows = []
            for d, i, c in np.unique(np.column_stack([doc, item, cell]), axis=0).tolist() if len(doc) else ():
                length, first, last = int(own.lengths[i]), int(words.starts[d]), int(words.starts[d + 1])
                begin, end = max(first, first + (c - 1) * length), min(last, first + (c + 3) * length)
                score, a, b = align(own.words[i], words.hashes[begin:end])
                if score >= least * 2 * length:
                    rows.append((d, own.ids[i], score / (2 * length), begin - first + a, begin - first + b))
            d, *rest = zip(*rows) if rows else [()] * 5
            kinds = (pa.int64(), pa.float64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(d, pa.int64())), *map(pa.array, rest, kinds)], names=["doc_id", "item_id", "score", "first_word", "end_word"])

    return docs.select("doc_id", "text").mapInArrow(find, "doc_id long, item_id long, score double, first_word long, end_word long")


def contaminated(docs: DataFrame, benchmark: DataFrame, n: int = NGRAM, rare_docs: int = RARE_DOCS, times_usual: float = TIMES_USUAL, least: float = SCORE) -> DataFrame:
    """docs(doc_id, text), benchmark(item_id, text) -> doc_id, item_id, score, first_word, end_word of the best passage.

    A row for each document and item with a score of at least `least`; of equal scores the first passage's. Null or
    empty texts and items match nothing. Rows without doc_id are searched like others and share one row per item. Rows
    that repeat an item_id: each text is searched for, the best score counts. Rows that repeat a doc_id share a row per
    item. Empty tables: no rows. Other columns are ignored.
    """
    sc, own = docs.sparkSession.sparkContext, documents(docs)
    tests = checkpointed(benchmark.where("item_id IS NOT NULL AND text IS NOT NULL").select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).distinct())
    chars = tests.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks, out = max(1, -(-chars // BLOCK_CHARS)), None
    for block in range(blocks):
        some = _Items(sorted((r["item_id"], r["text"].encode()) for r in tests.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block).toLocalIterator()), n)
        counted = sc.broadcast(some)
        some.judge(_spread(own, counted, n), rare_docs, times_usual)
        rows = _aligned(own, sc.broadcast(some), least)
        out = rows if out is None else out.unionByName(rows)
    best = out.groupBy("doc_id", "item_id").agg(F.max(F.struct("score", (-F.col("first_word")).alias("back"), "end_word")).alias("b"))
    return best.select("doc_id", "item_id", "b.score", (-F.col("b.back")).alias("first_word"), "b.end_word")
