"""Reversible line dedup: sharded cuckoo filters in front of exact reference-count tables.

The state of a corpus is the table of references (key, doc_id), one row per document and long line, the table of
reference counts (key, n_docs, last) and, for keys held by enough documents, fingerprints in cuckoo filters, one per
shard of the key space. The filters let a pass over the references skip nearly all of them before a join; what passes
is confirmed against the exact counts. Arriving documents add references, raise counts and insert fingerprints; leaving
ones take references away, lower counts and delete fingerprints, so that every dropped line comes back when its
repetition goes. Only keys that changed are touched, and only those that lose their last document look at the
references again.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from .common import documents, raw_texts, slices, stored

LEAST_CHARS = 40
LEAST_DOCS = 5
_BLANKS = b" \t\n\x0b\x0c\r"
#: Keys of a shard, on average.
SHARD_KEYS = 200_000
#: Shards whose filters are broadcast at once (about 3 bytes a key: 24 MB); further shards take further passes over the references.
BLOCK_SHARDS = 40
#: Tasks that share the references of one key where a key's last document is looked for anew.
SALTS = 32
#: Stands for a null doc_id: all such rows count as one document, smaller than all others.
NO_ID = -(1 << 63)


def line_key(line: bytes, least_chars: int = LEAST_CHARS) -> bytes | None:
    """128-bit key of a line, stripped of blanks and with A-Z lower-cased; None for shorter lines."""
    line = line.strip(_BLANKS)
    if len(line) < least_chars or not line.isascii() and len(line.decode()) < least_chars:
        return None
    return hashlib.md5(line.lower(), usedforsecurity=False).digest()


class CuckooFilter:
    """Sets of 128-bit keys as 16-bit fingerprints in buckets of four, with deletion; vectorised look-ups.

    An insertion that finds no room doubles the table, for which the caller's exact keys are needed: it returns False.
    """

    SLOTS = 4

    def __init__(self, keys: int):
        buckets = 1
        while buckets * self.SLOTS * 0.85 < max(keys, 1):
            buckets *= 2
        self.table = np.zeros((buckets, self.SLOTS), np.uint16)

    @staticmethod
    def halves(keys: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        raw = np.frombuffer(b"".join(keys), "<u8").reshape(-1, 2)
        return raw[:, 0], raw[:, 1]

    def places(self, keys: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Fingerprint (never 0) and both buckets of each key."""
        a, b = self.halves(keys)
        prints = (b % np.uint64(65535)).astype(np.uint16) + np.uint16(1)
        mask = np.uint64(len(self.table) - 1)
        one = (a >> np.uint64(16)) & mask
        return prints, one.astype(np.int64), (one ^ (self._spread(prints) & mask)).astype(np.int64)

    @staticmethod
    def _spread(prints: np.ndarray) -> np.ndarray:
        return (prints.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(20)

    def contains(self, keys: list[bytes]) -> np.ndarray:
        if not keys:
            return np.zeros(0, bool)
        prints, one, two = self.places(keys)
        return (self.table[one] == prints[:, None]).any(1) | (self.table[two] == prints[:, None]).any(1)

    def insert(self, keys: list[bytes]) -> bool:
        if not keys:
            return True
        prints, one, two = (x.tolist() for x in self.places(keys))
        rows, mask = self.table.tolist(), len(self.table) - 1
        for p, i, j in zip(prints, one, two):
            for turn in range(500):
                for b in (i, j):
                    if 0 in rows[b]:
                        rows[b][rows[b].index(0)] = p
                        break
                else:
                    k = turn % self.SLOTS
                    p, rows[j][k] = rows[j][k], p
                    i = j
                    j ^= int(self._spread(np.array([p], np.uint16))[0]) & mask
                    continue
                break
            else:
                return False
        self.table = np.array(rows, np.uint16)
        return True

    def delete(self, keys: list[bytes]) -> None:
        """Removes one fingerprint of each key; only keys that were inserted may be deleted."""
        if not keys:
            return
        for p, i, j in zip(*(x.tolist() for x in self.places(keys))):
            for b in (i, j):
                if (found := np.flatnonzero(self.table[b] == p)).size:
                    self.table[b, found[0]] = 0
                    break

    @classmethod
    def of(cls, keys: list[bytes]) -> CuckooFilter:
        size = len(keys)
        while not (own := cls(size)).insert(keys):
            size *= 2
        return own

    def to_bytes(self) -> bytes:
        return self.table.tobytes()

    @classmethod
    def from_bytes(cls, raw: bytes) -> CuckooFilter:
        own = cls(0)
        own.table = np.frombuffer(raw, np.uint16).reshape(-1, cls.SLOTS).copy()
        return own


def references(docs: DataFrame, least_chars: int = LEAST_CHARS) -> DataFrame:
    """docs(doc_id, text) -> key (binary), doc_id: each document's long lines once, for any number of rows of an id."""

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found, ids = [], []
            for doc_id, raw in zip(batch.column("doc_id").to_pylist(), raw_texts(batch)):
                own = {line_key(x, least_chars) for x in raw.split(b"\n")} - {None}
                found += own
                ids += [NO_ID if doc_id is None else doc_id] * len(own)
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary()), pa.array(ids, pa.int64())], names=["key", "doc_id"])

    return documents(docs).mapInArrow(keys, "key binary, doc_id long").distinct()


def repeated(refs: DataFrame, least_docs: int = LEAST_DOCS) -> DataFrame:
    """References -> key, n_docs, last (largest doc_id) of keys held by enough documents; counts combine map-side."""
    return refs.groupBy("key").agg(F.count("*").alias("n_docs"), F.max("doc_id").alias("last")).where(F.col("n_docs") >= least_docs)


def _shard(shards: int) -> Column:
    """Shard of a key by its first four bytes; `_shards` gives the same for a list of keys."""
    return F.pmod(F.conv(F.substring(F.hex("key"), 1, 8), 16, 10).cast("long"), F.lit(shards)).cast("int")


def _shards(keys: list[bytes], shards: int) -> np.ndarray:
    return np.frombuffer(b"".join(keys), ">u4").reshape(-1, 4)[:, 0].astype(np.int64) % shards


def filters(keys: DataFrame, shards: int) -> DataFrame:
    """key -> shard, filter (binary); the keys of a shard are bounded, as hashes deal them evenly."""

    def build(key, frame: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"shard": [key[0]], "filter": [CuckooFilter.of(frame["key"].tolist()).to_bytes()]})

    return keys.select("key", _shard(shards).alias("shard")).groupBy("shard").applyInPandas(build, "shard int, filter binary")


def update_filters(old: DataFrame, shards: int, before: DataFrame, after: DataFrame) -> DataFrame:
    """Filters of `before`'s keys changed to those of `after`'s: fingerprints of new keys inserted, of gone ones deleted.

    Only shards with a change are rebuilt from their keys, and only if their table has no room.
    """
    change = before.select("key", F.lit(-1).alias("d")).unionByName(after.select("key", F.lit(1).alias("d"))).groupBy("key").agg(F.sum("d").alias("d"), F.max("d").alias("now"))
    change = change.select("key", "d", "now", _shard(shards).alias("shard"))

    def apply(key, frame: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        if not len(frame):
            return own[["shard", "filter"]]
        pick = lambda d: frame["key"][frame["d"] == d].tolist()
        table = CuckooFilter.from_bytes(own["filter"].iloc[0]) if len(own) else CuckooFilter.of([])
        table.delete(pick(-1))
        if not table.insert(pick(1)):
            table = CuckooFilter.of(frame["key"][frame["now"] == 1].tolist())
        return pd.DataFrame({"shard": [key[0]], "filter": [table.to_bytes()]})

    return change.groupBy("shard").cogroup(old.groupBy("shard")).applyInPandas(apply, "shard int, filter binary")


def update_references(refs: DataFrame, added: DataFrame | None = None, removed: DataFrame | None = None, least_chars: int = LEAST_CHARS) -> DataFrame:
    """References after whole documents leave (removed: doc_id) and then others come (added: doc_id, text)."""
    if removed is not None:
        refs = refs.join(_ids(removed), "doc_id", "left_anti").select("key", "doc_id")
    return refs if added is None else refs.unionByName(references(added, least_chars)).distinct()


def _ids(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id")).distinct()


class State(NamedTuple):
    """What is known of the documents that are there: stored tables, and filters of the repeated keys."""

    refs: DataFrame  # key, doc_id
    counts: DataFrame  # key, n_docs, last
    hot: DataFrame  # key, n_docs, last of repeated keys
    filters: DataFrame  # shard, filter
    shards: int
    least_docs: int
    least_chars: int


def load(docs: DataFrame, least_chars: int = LEAST_CHARS, least_docs: int = LEAST_DOCS) -> State:
    """The state of a first set of documents."""
    refs = stored(references(docs, least_chars))
    counts = stored(repeated(refs, 1))
    hot = stored(counts.where(F.col("n_docs") >= least_docs))
    shards = max(1, -(-hot.count() // SHARD_KEYS))
    return State(refs, counts, hot, stored(filters(hot, shards)), shards, least_docs, least_chars)


def change(state: State, added: DataFrame | None = None, removed: DataFrame | None = None) -> State:
    """The state after whole documents leave (removed: doc_id) and then others come (added: doc_id, text).

    Documents that come again under an id that is there add the lines that it didn't have. Unknown ids leave nothing.
    """
    refs, moves = state.refs, []
    if removed is not None:
        ids = stored(_ids(removed))
        gone = refs.join(ids, "doc_id", "left_semi").select("key", "doc_id", F.lit(-1).alias("d"))
        refs, moves = stored(refs.join(ids, "doc_id", "left_anti").select("key", "doc_id")), [gone]
    if added is not None:
        new = stored(references(added, state.least_chars).join(refs, ["key", "doc_id"], "left_anti"))
        refs, moves = refs.unionByName(new), [*moves, new.withColumn("d", F.lit(1))]
    if not moves:
        return state
    moved = moves[0] if len(moves) == 1 else moves[0].unionByName(moves[1])
    delta = moved.groupBy("key").agg(F.sum("d").alias("d"), F.max(F.when(F.col("d") > 0, F.col("doc_id"))).alias("came"), F.max(F.when(F.col("d") < 0, F.col("doc_id"))).alias("went"))
    both = state.counts.join(delta, "key", "full_outer").select(
        "key", (F.coalesce("n_docs", F.lit(0)) + F.coalesce("d", F.lit(0))).alias("n_docs"), F.greatest("last", "came").alias("last"),
        F.coalesce(F.col("went") == F.col("last"), F.lit(False)).alias("lost"),
    )
    both = stored(both.where("n_docs > 0"))
    # A common key's references are dealt by key and salt; what is left of them after that is one row per task.
    salted = both.where("lost").select("key", "n_docs", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    rest = refs.select("key", "doc_id", F.pmod(F.hash("doc_id"), F.lit(SALTS)).alias("salt"))
    again = salted.join(rest, ["key", "salt"]).groupBy("key", "salt").agg(F.first("n_docs").alias("n_docs"), F.max("doc_id").alias("last"))
    again = again.groupBy("key").agg(F.first("n_docs").alias("n_docs"), F.max("last").alias("last"))
    counts = stored(both.where("NOT lost").select("key", "n_docs", "last").unionByName(again))
    hot = stored(counts.where(F.col("n_docs") >= state.least_docs))
    wanted = max(1, -(-hot.count() // SHARD_KEYS))
    if wanted > 2 * state.shards:  # tables would outgrow their tasks: deal the keys anew
        return state._replace(refs=refs, counts=counts, hot=hot, filters=stored(filters(hot, wanted)), shards=wanted)
    changed = stored(update_filters(state.filters, state.shards, state.hot, hot))
    return state._replace(refs=refs, counts=counts, hot=hot, filters=changed)


def probe(refs: DataFrame, tables: DataFrame, shards: int) -> DataFrame:
    """References whose key some filter may hold, and few others; filters are broadcast a block of shards at a time."""
    spark, out = refs.sparkSession, None
    for first in range(0, shards, BLOCK_SHARDS):
        block = tables.where(F.col("shard").between(first, first + BLOCK_SHARDS - 1))
        built = spark.sparkContext.broadcast({r["shard"]: bytes(r["filter"]) for r in block.toLocalIterator()})

        def pick(batches: Iterator[pa.RecordBatch], built=built) -> Iterator[pa.RecordBatch]:
            own = {s: CuckooFilter.from_bytes(f) for s, f in built.value.items()}
            for batch in batches:
                keys = batch.column("key").to_pylist()
                keep = np.zeros(len(keys), bool)
                at = _shards(keys, shards) if keys else keep
                for s in np.unique(at).tolist() if keys else ():
                    if s in own:
                        rows = np.flatnonzero(at == s)
                        keep[rows] = own[s].contains([keys[i] for i in rows.tolist()])
                yield batch.filter(pa.array(keep))

        part = refs.select("key", "doc_id").mapInArrow(pick, "key binary, doc_id long")
        out = part if out is None else out.unionByName(part)
    return out


def drop_lines(docs: DataFrame, state: State, carry: tuple[str, ...] = ()) -> DataFrame:
    """docs(doc_id, text), all of them in state -> doc_id, text, n_lines, n_dropped and carried columns; a row per row.

    Repeated lines go, except in the document with the largest id. Texts are read once; what goes from them comes from
    the references that pass the filters.
    """
    kept = [docs.schema[c] for c in carry]
    schema = StructType([StructField("doc_id", LongType()), StructField("text", StringType()), StructField("n_lines", LongType()), StructField("n_dropped", LongType()), *kept])
    least_chars = state.least_chars

    def rebuild(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            out, lines, dropped = [], [], []
            for raw, gone in zip(raw_texts(batch), batch.column("gone").to_pylist()):
                own = raw.split(b"\n")
                lines.append(len(own))
                if gone:
                    gone = set(gone)
                    own = [x for x in own if line_key(x, least_chars) not in gone]
                    raw = b"\n".join(own)
                out.append(raw.decode())
                dropped.append(lines[-1] - len(own))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(out, pa.string()), pa.array(lines, pa.int64()), pa.array(dropped, pa.int64()), *(batch.column(f"carried{i}") for i in range(len(kept)))],
                names=["doc_id", "text", "n_lines", "n_dropped", *carry],
            )

    found = probe(state.refs, state.filters, state.shards)
    gone = found.join(state.hot.select("key", "last"), "key").where("last <> doc_id").groupBy(F.col("doc_id").alias("id")).agg(F.collect_set("key").alias("gone"))
    own = documents(docs, *(F.col(c).alias(f"carried{i}") for i, c in enumerate(carry)))
    joined = own.join(gone, F.coalesce("doc_id", F.lit(NO_ID)) == F.col("id"), "left").drop("id")
    return joined.mapInArrow(rebuild, schema)


def line_dedup(docs: DataFrame, carry: tuple[str, ...] = (), least_chars: int = LEAST_CHARS, least_docs: int = LEAST_DOCS) -> DataFrame:
    """docs(doc_id, text) -> doc_id, text (kept lines), n_lines, n_dropped and carried columns; one row per input row.

    A line's key is the line without blanks at its ends, A-Z lower-cased. Keys of at least least_chars code points in
    at least least_docs documents stay only in the document with the largest id. Null or empty text: one empty line.
    Rows of one doc_id are one document, as are all rows without an id (the smallest). Equal lines within the last
    document all stay. Empty table: no rows.
    """
    return drop_lines(docs, load(docs, least_chars, least_docs), carry)
