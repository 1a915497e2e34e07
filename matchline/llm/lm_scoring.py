"""Language-model scores by a probabilistic suffix tree over words, kept as Spark tables.

Symbols are words (A-Z lower-cased) and the end of a text. Contexts grow word by word to the left: a context of k words
is tried if it occurs often enough in the training texts (least_count: 2 log2 of their number of tokens, as naming a
sequence costs some log2 bits, so ever rarer shares of the corpus count as it grows), its suffix of k - 1 words is a
state of the tree and was seen to predict it. It becomes a state if its next-symbol distribution diverges from its suffix's: the log-likelihood gain
exceeds GAIN nats per next symbol. Growth ends where no context of some length passes; no length, share or number of
contexts is fixed, so the tree grows with the corpus. Distributions are smoothed by absolute discounting with Katz
back-off to the suffix's, the root's by adding one. A symbol is scored in the state of the longest suffix of what
stands before it.

The log-probability of a text is a sum of weights of the word sequences in it, each weight a function of the sequence
alone: a state's back-off weight stands for every place where it is the context, and a kept sequence's own probability
less what back-off would have given it for every place where it occurs. So scoring is a sum over a weight table:
sequences that are common (one per slot of a table of bounded size) are summed where the text is read, all others go
through a shuffled join. A bitmap of bounded size saves the join what is surely not in the table. Both are exact.
Sequences are told apart by 64-bit hashes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, fold, raw_texts, slices, stored
from .text_arrays import mixed, split_words

GAIN = 2.0
DISCOUNT = 0.5
END = np.uint64(0x5851F42D4C957F2D)
_LEFT = np.uint64(0xD1342543DE82EF95)
#: Distinct sequences that a task holds before it passes their counts on.
HELD = 1_000_000
#: 64-bit words of a bitmap, and slots of the table of common sequences, at most, as powers of two.
MAP_BITS = 21
HOT_BITS = 20


def least_count(total: int) -> int:
    """Occurrences that make a sequence count, in a corpus of so many tokens."""
    return 2 * math.ceil(math.log2(total + 2))


def joined(context: np.ndarray, suffix: np.ndarray) -> np.ndarray:
    """Hash of a sequence from those of it without its last and without its first word."""
    return mixed(context * _LEFT + suffix)


class _Tokens(NamedTuple):
    """word hashes of some texts, an end after each; doc and place of each."""

    words: np.ndarray
    doc: np.ndarray
    place: np.ndarray

    @classmethod
    def of(cls, raws: list[bytes]) -> _Tokens:
        own = split_words(raws)
        n = np.diff(own.starts) + 1
        ends = np.cumsum(n)
        words = np.empty(int(ends[-1]) if len(ends) else 0, np.uint64)
        is_end = np.zeros(len(words), bool)
        is_end[ends - 1] = True
        words[is_end], words[~is_end] = END, own.hashes
        doc = np.repeat(np.arange(len(n)), n)
        return cls(words, doc, np.arange(len(words)) - np.repeat(ends - n, n))

    def sequences(self, length: int) -> np.ndarray:
        """Hash of the last `length` words at each place; meaningless at the first length - 1 places of a text."""
        own = self.words
        for _ in range(length - 1):
            own = joined(np.concatenate([own[:1], own[:-1]]), own)
        return own


def _power(rows: int, most: int) -> int:
    """The power of two next above rows, at least 6 and at most `most`."""
    return max(6, min(most, rows.bit_length()))


def _bitmap(keys: DataFrame) -> np.ndarray:
    """keys(g) -> words of 64 flags, one word for every four keys and 2 ** MAP_BITS at most; flags combine in Spark."""
    bits = _power(keys.count() // 4, MAP_BITS)
    flags = keys.select(F.shiftrightunsigned("g", 64 - bits).cast("int").alias("at"), F.expr("shiftleft(1L, cast(g & 63 AS int))").alias("bit"))
    table = flags.groupBy("at").agg(F.bit_or("bit").alias("bits")).toArrow()
    out = np.zeros(1 << bits, np.uint64)
    out[np.asarray(table.column("at"))] = np.asarray(table.column("bits")).view(np.uint64)
    return out


def _slots(keys: np.ndarray, size: int) -> np.ndarray:
    """Slots of keys in a table of `size`, a power of two."""
    return (keys >> np.uint64(65 - size.bit_length())).astype(np.int64)


def _within(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    return (bits[_slots(keys, len(bits))] >> (keys & np.uint64(63)) & np.uint64(1)).astype(bool)


def _summed(texts: DataFrame, names: tuple[str, ...], found, key) -> DataFrame:
    """found(tokens) -> columns of counted places; names, n over texts(text), added up within each task first.

    key(columns) -> a hash that tells rows apart. Rows leave a task ordered by their first column, which then takes
    little room in the shuffle.
    """

    def merged(columns: list[np.ndarray], n: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
        own = key(columns)
        order = np.argsort(own, kind="stable")
        own = own[order]
        first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
        return [x[order[first]] for x in columns], np.add.reduceat(n[order], first)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        size = 0

        def together() -> None:
            parts = list(zip(*held))
            held.clear()
            columns, n = merged([np.concatenate(x) for x in parts[:-1]], np.concatenate(parts[-1]))
            held.append([*columns, n])

        def table() -> pa.RecordBatch:
            *columns, n = held.pop()
            order = np.argsort(columns[0], kind="stable")
            return pa.RecordBatch.from_arrays([*(pa.array(x[order].view(np.int64)) for x in columns), pa.array(n[order])], names=[*names, "n"])

        for batch in slices(batches):
            columns = found(_Tokens.of(raw_texts(batch)))
            if len(columns[0]):
                columns, n = merged(columns, np.ones(len(columns[0]), np.int64))
                held.append([*columns, n])
                size += len(n)
            if size > 2 * HELD:
                together()
                size = len(held[0][0])
                if size > HELD:
                    yield table()
                    size = 0
        if held:
            together()
            yield table()

    return texts.select("text").mapInArrow(count, ", ".join(f"{x} long" for x in (*names, "n"))).groupBy(*names).agg(F.sum("n").alias("n"))


def vocabulary(train: DataFrame) -> DataFrame:
    """train(text) -> g (a word's hash), n."""
    return _summed(train, ("g",), lambda t: [t.words], lambda columns: columns[0])


def _grown(train: DataFrame, length: int, contexts, suffixes, least: int) -> DataFrame:
    """Sequences one longer than `length` that occur `least` times -> g, c (without the last word), e (without the first), n.

    Only those whose parts stand in the bitmaps of contexts and suffixes; some others slip through. They are counted by
    their two parts, which make their hash: so the rows of a pass are at most the places of the texts, and what is
    common is named once, not again by each task that meets it.
    """

    def parts(t: _Tokens) -> list[np.ndarray]:
        own = t.sequences(length)
        at = np.flatnonzero(t.place >= length)
        at = at[_within(suffixes.value, own[at])]
        at = at[_within(contexts.value, own[at - 1])]
        return [own[at - 1], own[at]]

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            c, e = (np.asarray(batch.column(x)).view(np.uint64) for x in ("c", "e"))
            yield pa.RecordBatch.from_arrays([pa.array(joined(c, e).view(np.int64)), *(batch.column(x) for x in ("c", "e", "n"))], names=["g", "c", "e", "n"])

    often = _summed(train, ("c", "e"), parts, lambda columns: joined(*columns)).where(F.col("n") >= least)
    return often.mapInArrow(named, "g long, c long, e long, n long")


def fit(train: DataFrame, vocab: DataFrame, total: int, kinds: int, least: int, gain: float = GAIN) -> tuple[DataFrame, int]:
    """train(text), vocab(g, n) -> weights (g, n, v) of sequences of two words and more and of states, and the longest length.

    p is the log10 probability of a sequence's last word in the longest state among the words before it.
    """
    sc = train.sparkSession.sparkContext
    known = vocab.where(F.col("n") >= least).select("g", "n", F.log10((F.col("n") + 1) / F.lit(float(total + kinds + 1))).alias("p"), F.lit(True).alias("ok"))
    weights, length = None, 1
    contexts = suffixes = sc.broadcast(_bitmap(known.select("g")))
    while True:
        seen = _grown(train, length, contexts, suffixes, least)
        entries = seen.join(known.where("ok").select(F.col("g").alias("e"), F.col("p").alias("up")), "e").join(known.select(F.col("g").alias("c"), F.col("n").alias("total")), "c")
        entries = stored(entries)
        by = entries.groupBy("c", "total").agg(
            F.count("*").alias("kinds"), F.sum("n").alias("kept"), F.sum(F.pow(F.lit(10.0), "up")).alias("mass"),
            F.sum(F.col("n") * (F.log(F.col("n") / F.col("total")) - F.col("up") * math.log(10))).alias("gain"),
        )
        by = by.withColumns({"rest": 1 - (F.col("kept") - DISCOUNT * F.col("kinds")) / F.col("total"), "left": 1 - F.col("mass")}).where("rest > 1e-9 AND left > 1e-9")
        by = by.where(F.col("gain") + (F.col("total") - F.col("kept")) * F.log(F.col("rest") / F.col("left")) > gain * F.col("kinds"))
        states = stored(by.select("c", "total", F.log10(F.col("rest") / F.col("left")).alias("back")))
        own = F.log10((F.col("n") - DISCOUNT) / F.col("total"))
        grown = entries.join(states.select("c", "back"), "c", "left").select(
            "g", "n", F.when(F.col("back").isNotNull(), own).otherwise(F.col("up")).alias("p"), F.col("back").isNotNull().alias("ok"),
            F.coalesce(own - F.col("up") - F.col("back"), F.lit(0.0)).alias("v"),
        )
        known = stored(grown)
        more = known.where("ok").select("g", "n", "v").unionByName(states.select(F.col("c").alias("g"), F.col("total").alias("n"), F.col("back").alias("v")))
        weights = more if weights is None else weights.unionByName(more)
        length += 1
        for used in {contexts, suffixes}:
            used.destroy()  # what came of it is stored
        if states.isEmpty():
            return weights, length
        contexts = sc.broadcast(_bitmap(known.select("g")))
        suffixes = sc.broadcast(_bitmap(known.where("ok").select("g")))


def _sums(docs: DataFrame, table: DataFrame, longest: int) -> DataFrame:
    """docs(doc_id, text), table(g, n, base, v) -> doc_id, n_tokens, n_known, base, v summed; a row per input row.

    n_known counts words, which alone have a base. A sequence longer than a word is looked for only where it is in the
    table without its first word, as all are.
    """
    sc = docs.sparkSession.sparkContext
    size = _power(2 * table.count(), HOT_BITS)
    slot = F.shiftrightunsigned("g", 64 - size).cast("int")
    best = table.groupBy(slot.alias("slot")).agg(F.max_by(F.struct("g", "base", "v"), F.struct("n", "g")).alias("b")).select("slot", "b.*").toArrow()
    keys, values = np.zeros(1 << size, np.uint64), np.zeros((2, 1 << size))
    at = np.asarray(best.column("slot"))
    keys[at] = np.asarray(best.column("g")).view(np.uint64)
    values[0, at], values[1, at] = np.asarray(best.column("base")), np.asarray(best.column("v"))
    hot, bits = sc.broadcast((keys, values)), sc.broadcast(_bitmap(table.select("g")))

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, values = hot.value
        first = TaskContext.get().partitionId() << 33  # rows are numbered; what is written keeps its numbers
        for batch in slices(batches):
            t, d = _Tokens.of(raw_texts(batch)), batch.num_rows
            base, known, v, rest = np.zeros(d), np.zeros(d), np.zeros(d), []
            own, at = t.words, np.arange(len(t.words))
            for length in range(1, longest + 1):
                key = own[at]
                slot = _slots(key, len(keys))
                hit = keys[slot] == key
                doc, slot = t.doc[at[hit]], slot[hit]
                v += np.bincount(doc, values[1][slot], d)
                if length == 1:
                    base += np.bincount(doc, values[0][slot], d)
                    known += np.bincount(doc, values[0][slot] > 0, d)
                near = ~hit
                near[near] = _within(bits.value, key[near])
                rest.append(np.column_stack([t.doc[at[near]].astype(np.uint64), key[near]]))
                at = at[hit | near]
                at = at[t.place[at] >= length]
                if not len(at):
                    break
                own = joined(np.concatenate([own[:1], own[:-1]]), own)
            doc, key = np.concatenate(rest).T
            order = np.argsort(doc, kind="stable")
            doc, key = doc[order], key[order]
            lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(doc, np.arange(d + 1)).astype(np.int32)), pa.array(key.view(np.int64)))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(first + np.arange(d)), pa.array(np.bincount(t.doc, minlength=d)), *map(pa.array, (base, known, v)), lists],
                names=["doc_id", "row", "n_tokens", "base", "known", "v", "keys"],
            )
            first += d

    rows = stored(docs.select("doc_id", "text").mapInArrow(look_up, "doc_id long, row long, n_tokens long, base double, known double, v double, keys array<long>"))
    cold = rows.select("row", F.explode("keys").alias("g"))
    values = table.select("g", F.col("base").alias("cold_base"), F.col("v").alias("cold_v"))
    found = cold.join(values, "g").groupBy("row").agg(F.sum("cold_base").alias("cold_base"), F.count(F.when(F.col("cold_base") > 0, 1)).alias("cold_known"), F.sum("cold_v").alias("cold_v"))
    total = lambda c: F.col(c) + F.coalesce(f"cold_{c}", F.lit(0.0))
    return rows.drop("keys").join(found, "row", "left").select("doc_id", "n_tokens", F.round(total("known")).cast("long").alias("n_known"), total("base").alias("base"), total("v").alias("v"))


def lm_scores(docs: DataFrame, held_out_fold: int = 2, folds: int = 7, least: int | None = None, gain: float = GAIN) -> DataFrame:
    """docs(doc_id, text) -> doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score; a row per input row.

    Learns from the rows outside the held-out fold alone. base_score is the add-one unigram log10 probability, score the
    suffix tree's. Null or empty text: one token, the end. Null doc_id: trained on. No training row: both scores are
    the root's. Repeated rows count as often as they occur and each get a row. Other columns are ignored.
    """
    own = documents(docs)
    held = fold("doc_id", folds) == held_out_fold
    train = own.where(~held)
    vocab = stored(vocabulary(train))
    totals = vocab.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("N"), F.count("*").alias("V")).first()
    n, v = totals["N"], totals["V"]
    weights, longest = fit(train, vocab, n, v, least or least_count(n), gain)
    words = vocab.select("g", "n", F.log10(F.col("n") + 1).alias("base"), F.lit(0.0).alias("v"))
    rows = words.unionByName(weights.select("g", "n", F.lit(0.0).alias("base"), "v"))
    table = stored(rows.groupBy("g").agg(F.max("n").alias("n"), F.sum("base").alias("base"), F.sum("v").alias("v")))
    base = F.col("base") - F.col("n_tokens") * F.lit(math.log10(n + v + 1))
    return _sums(own, table, longest).select(
        "doc_id",
        held.alias("held_out"),
        "n_tokens",
        "n_known",
        F.lit(n).cast("long").alias("train_tokens"),
        base.alias("base_score"),
        (base + F.col("v")).alias("score"),
    )
