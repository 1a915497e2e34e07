"""Encoding and decoding of whole texts that encodes passages shared by documents once.

A rolling hash over bytes cuts texts where the content says so, so a passage gives the same chunks wherever it stands.
A chunk that occurs once is encoded where it is read. Chunks that occur again are encoded once for all documents; each
document refers to them by hash. Where a shared chunk meets its neighbours, a window of words around the join is
encoded again by the library, and widened until both its ends agree with the encodings at its sides.
"""

from __future__ import annotations

import functools
import hashlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, raw_texts, slices, stored
from .packing import WordIds

#: A cut falls on one of 2^CUT_BITS bytes: chunks of about 1 KB.
CUT_BITS = 10
#: Bytes that the rolling hash sees, a power of two.
WINDOW = 32
#: log2 of the flags for chunks that occur again, and of the flags in one row of them.
FLAG_BITS, ROW_BITS = 27, 15
#: Distinct chunks that a task holds before it passes its counts on.
HELD_CHUNKS = 200_000
#: Bytes of text that a task handles at once.
SLICE_BYTES = 4 << 20

_GEAR = np.random.default_rng(11).integers(0, 1 << 32, 256, dtype=np.uint64).astype(np.uint32)


def cuts(data: np.ndarray, bits: int = CUT_BITS) -> np.ndarray:
    """Where chunks begin in UTF-8 bytes: places that follow a window whose hash has `bits` leading zeros, at a character's start.

    The hash of a window is the sum of its bytes' random numbers, the k-th byte before the end shifted by k.
    """
    if len(data) < 2:
        return np.zeros(0, np.int64)
    sums, width = _GEAR[data], 1
    while width < WINDOW:
        sums[width:] = sums[width:] + (sums[:-width] << np.uint32(width))
        width *= 2
    at = np.flatnonzero(sums[:-1] < np.uint32(1 << (32 - bits))) + 1
    return at[(data[at] & 0xC0) != 0x80]


def chunks(raw: bytes, bits: int = CUT_BITS) -> tuple[list[int], list[bytes]]:
    """The edges of a text's chunks and each chunk's 128-bit hash."""
    if not raw:
        return [0], []
    edges = [0, *cuts(np.frombuffer(raw, np.uint8), bits).tolist(), len(raw)]
    return edges, [xxhash.xxh3_128_digest(raw[a:b]) for a, b in zip(edges, edges[1:])]


class Codec(WordIds):
    """Ids of texts, and the decoded form of ids, by a `tokenizers` file that drops white space and has no decoder."""

    def __init__(self, path: str):
        super().__init__(path)
        size = self.library.get_vocab_size(with_added_tokens=True)
        self.dtype = np.dtype("<u4" if size > 1 << 16 else "<u2")
        self.tokens = [(self.library.id_to_token(i) or "").encode() for i in range(size)]
        sample = [0, size - 1, 0]
        if self.library.decode(sample, skip_special_tokens=False).encode() != b" ".join(self.tokens[i] for i in sample):
            raise ValueError("decoding must join the tokens by spaces")

    def ids_of(self, raws: list[bytes]) -> list[np.ndarray]:
        """The ids of each text."""
        if not raws:
            return []
        ids, ends = self.encode(pa.array([r.decode() for r in raws], pa.string()), 0)
        return [ids[a:b] for a, b in zip([0, *ends[:-1].tolist()], (ends - 1).tolist())]

    def library_ids(self, raws: list[bytes]) -> list[np.ndarray]:
        """The same by the library alone, text by text."""
        return [np.array(x, np.int64) for x in self._ids([r.decode() for r in raws])]

    def packed(self, ids: np.ndarray) -> bytes:
        return ids.astype(self.dtype).tobytes()


class Digest:
    """The hashes of a document's ids and of its decoded text, fed in order."""

    def __init__(self, codec: Codec):
        self.codec, self.n = codec, 0
        self.ids, self.decoded = hashlib.sha256(), hashlib.sha256()

    def add(self, ids: np.ndarray) -> None:
        if len(ids):
            self.decoded.update(b" " * bool(self.n) + b" ".join(map(self.codec.tokens.__getitem__, ids.tolist())))
            self.ids.update(ids.astype("<u4").tobytes())
            self.n += len(ids)

    def result(self) -> dict[str, int | str]:
        return {"n_tokens": self.n, "ids_sha256": self.ids.hexdigest(), "decoded_sha256": self.decoded.hexdigest()}


@functools.lru_cache(maxsize=2)
def codec_of(path: str) -> Codec:
    return Codec(path)


@dataclass
class Reference:
    """A shared chunk, text[begin:end], of which a text takes text[inner:until] from the chunk's own encoding.

    head, tail: the chunk's first or last word isn't taken, as no blank parts it from the text beside the chunk.
    """

    name: bytes
    begin: int
    end: int
    inner: int
    until: int
    head: bool
    tail: bool


def blanks(raw: bytes) -> np.ndarray:
    """Where ASCII white space stands, which no token crosses."""
    data = np.frombuffer(raw, np.uint8)
    return np.flatnonzero((data == 32) | ((data >= 9) & (data <= 13)))


def references(size: int, blank: np.ndarray, edges: list[int], names: list[bytes], shared: list[bool]) -> list[Reference]:
    """What a text takes from shared chunks; a chunk without a blank where it needs one is encoded with its neighbours."""
    out = []
    for a, b, name, again in zip(edges, edges[1:], names, shared):
        if not again:
            continue
        i, j = np.searchsorted(blank, (a, b)).tolist()  # blank[i:j] are the chunk's
        head = a > 0 and not (i > 0 and blank[i - 1] == a - 1)
        tail = b < size and not (j < len(blank) and blank[j] == b)
        if (head or tail) and i == j:
            continue
        inner, until = (int(blank[i]) if head else a), (int(blank[j - 1]) + 1 if tail else b)
        if inner < until:
            out.append(Reference(name, a, b, inner, until, head, tail))
    return out


def windows(raw: bytes, blank: np.ndarray, own: list[Reference]) -> list[bytes]:
    """The text around each join of a shared chunk: the word that it cuts and one more on each side."""
    edge = np.concatenate([[-1, -1], blank, [len(raw)] * 2])  # blank k is edge[k + 2]
    joins = sorted({x for r in own for x in (r.begin, r.end) if 0 < x < len(raw)})
    at = np.searchsorted(blank, joins)
    return [raw[edge[i] + 1 : edge[i + 3]] for i in at.tolist()]


def shared_flags(docs: DataFrame, bits: int = CUT_BITS) -> np.ndarray:
    """Flags, packed, of the chunks that occur more than once; some others share a flag with them."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def flush() -> Iterator[pa.RecordBatch]:
            if held:
                yield pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.binary()), pa.array(held.values(), pa.int64())], names=["name", "n"])
                held.clear()

        for batch in slices(batches, size=SLICE_BYTES):
            for raw in raw_texts(batch):
                held.update(chunks(raw, bits)[1])
            if len(held) > HELD_CHUNKS:
                yield from flush()
        yield from flush()

    often = docs.select("text").mapInArrow(count, "name binary, n long").groupBy("name").agg(F.sum("n").alias("n")).where("n > 1")
    flag = F.shiftrightunsigned(F.conv(F.hex(F.substring("name", 1, 4)), 16, 10).cast("long"), 32 - FLAG_BITS)
    rows = often.groupBy(F.shiftright(flag, ROW_BITS).alias("at")).agg(F.bitmap_construct_agg(flag.bitwiseAND((1 << ROW_BITS) - 1)).alias("bits"))
    out, width = np.zeros(1 << (FLAG_BITS - 3), np.uint8), 1 << (ROW_BITS - 3)
    for row in rows.collect():  # at most 2^(FLAG_BITS - ROW_BITS) rows
        out[row["at"] * width : (row["at"] + 1) * width] = np.frombuffer(row["bits"], np.uint8)
    return out


def flagged(names: list[bytes], flags: np.ndarray) -> list[bool]:
    at = np.frombuffer(b"".join(x[:4] for x in names), ">u4").astype(np.int64) >> (32 - FLAG_BITS)
    return ((flags[at >> 3] >> (at & 7).astype(np.uint8)) & 1).astype(bool).tolist()


DONE, SEGMENT, REFERENCE, CHUNK = range(4)
_PARTS = {
    "kind": pa.int32(), "row": pa.int64(), "seq": pa.int32(), "doc_id": pa.int64(), "name": pa.binary(), "head": pa.bool_(), "tail": pa.bool_(),
    "data": pa.binary(), "n_tokens": pa.int64(), "ids_sha256": pa.string(), "decoded_sha256": pa.string(),
}
_SQL = {pa.int32(): "int", pa.int64(): "long", pa.binary(): "binary", pa.bool_(): "boolean", pa.string(): "string"}
_SCHEMA = ", ".join(f"{name} {_SQL[kind]}" for name, kind in _PARTS.items())


def parts(docs: DataFrame, tokenizer: str, flags: Broadcast, bits: int = CUT_BITS) -> DataFrame:
    """Rows of four kinds: texts without a shared chunk, done; other texts' own segments and references; shared chunks, once a task.

    A segment is what lies between two references, so it holds the words that joins cut.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec, known = codec_of(tokenizer), set()
        row = TaskContext.get().partitionId() << 33  # rows are numbered; what is written keeps its numbers
        for batch in slices(batches, size=SLICE_BYTES):
            raws, owns, around = raw_texts(batch), [], []
            for d, raw in enumerate(raws):
                edges, names = chunks(raw, bits)
                shared, own = flagged(names, flags.value) if names else [], []
                if any(shared):
                    blank = blanks(raw)
                    own = references(len(raw), blank, edges, names, shared)
                    around += [(d, w) for w in windows(raw, blank, own)]
                owns.append(own)
            # A window as the library encodes it must begin and end as its neighbours do by themselves; else it grows to the whole text.
            by_words, by_library = codec.ids_of([w for _, w in around]), codec.library_ids([w for _, w in around])
            apart = {d for (d, _), x, y in zip(around, by_words, by_library) if not np.array_equal(x, y)}
            segments = []
            for d, (raw, own) in enumerate(zip(raws, owns)):
                own = owns[d] = [] if d in apart else own
                edges = [0, *(x for r in own for x in (r.inner, r.until)), len(raw)]
                segments.append([raw[a:b] for a, b in zip(edges[::2], edges[1::2])])
            ids = iter(codec.ids_of([x for own in segments for x in own]))
            out = Rows()
            for d, (doc_id, raw, own) in enumerate(zip(batch.column("doc_id").to_pylist(), raws, owns)):
                row += 1
                own_ids = [next(ids) for _ in segments[d]]
                if not own:
                    digest = Digest(codec)
                    digest.add(codec.library_ids([raw])[0] if d in apart else own_ids[0])
                    out.add(kind=DONE, row=row, doc_id=doc_id, **digest.result())
                    continue
                for i, x in enumerate(own_ids):
                    out.add(kind=SEGMENT, row=row, seq=2 * i, doc_id=doc_id, data=codec.packed(x))
                for i, r in enumerate(own):
                    out.add(kind=REFERENCE, row=row, seq=2 * i + 1, doc_id=doc_id, name=r.name, head=r.head, tail=r.tail)
                    if r.name not in known:
                        known.add(r.name)
                        out.add(kind=CHUNK, name=r.name, data=raw[r.begin : r.end])
                if len(known) > HELD_CHUNKS:
                    known.clear()
            yield out.batch()

    return docs.mapInArrow(cut, _SCHEMA)


class Rows:
    """Rows of _PARTS, by column."""

    def __init__(self):
        self.columns: dict[str, list] = {name: [] for name in _PARTS}

    def add(self, **values) -> None:
        for name, column in self.columns.items():
            column.append(values.get(name))

    def batch(self) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(self.columns[name], kind) for name, kind in _PARTS.items()], names=list(_PARTS))


def encoded_chunks(rows: DataFrame, tokenizer: str) -> DataFrame:
    """Shared chunks (name, data: text) -> name, ids, and how many of them n_head and n_tail belong to its first and last word. Each is encoded once."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec, known = codec_of(tokenizer), set()
        for batch in slices(batches, "data", SLICE_BYTES):
            own = {}
            for name, raw in zip(batch.column("name").to_pylist(), batch.column("data").to_pylist()):
                if name not in known:
                    known.add(name)
                    own[name] = raw
            ends = []
            for raw in own.values():
                blank = blanks(raw)
                ends += [raw[: blank[0]], raw[blank[-1] :]] if len(blank) else [raw, raw]
            n = np.array([len(x) for x in codec.ids_of(ends)], np.int32).reshape(-1, 2)
            ids = [codec.packed(x) for x in codec.ids_of(list(own.values()))]
            yield pa.RecordBatch.from_arrays(
                [pa.array(own.keys(), pa.binary()), pa.array(ids, pa.binary()), pa.array(n[:, 0]), pa.array(n[:, 1])], names=["name", "ids", "n_head", "n_tail"]
            )

    return rows.repartition("name").mapInArrow(encode, "name binary, ids binary, n_head int, n_tail int")


def encode_texts(docs: DataFrame, tokenizer: str, bits: int = CUT_BITS) -> DataFrame:
    """docs(doc_id, text) -> doc_id, n_tokens, ids_sha256, decoded_sha256: every whole text encoded, and its ids decoded.

    tokenizer: a file of `tokenizers` that drops ASCII white space and has no decoder. The ids are those of the library
    without added special tokens; special strings inside a text count as the library takes them. One row per input row:
    null and repeated ids and equal rows each get theirs. Null or empty text: no tokens. A text of any length is read
    whole; one without blanks is encoded in one piece. Empty table: no rows. Other columns are ignored.
    """
    own = documents(docs)
    flags = own.sparkSession.sparkContext.broadcast(shared_flags(own, bits))
    found = stored(parts(own, tokenizer, flags, bits))
    flags.destroy()  # what came of it is stored
    return found.where(F.col("kind") == DONE).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").unionByName(assembled(found, tokenizer))


def assembled(found: DataFrame, tokenizer: str) -> DataFrame:
    """The results of texts that hold shared chunks: their segments and their chunks' ids, read in order."""
    coded = encoded_chunks(found.where(F.col("kind") == CHUNK).select("name", "data"), tokenizer)
    width = F.lit(codec_of(tokenizer).dtype.itemsize)
    skip, drop = (F.when(F.col(x), F.col(n)).otherwise(0) for x, n in (("head", "n_head"), ("tail", "n_tail")))
    inner = F.expr("substring(ids, skip + 1, length(ids) - skip - lost)")
    taken = (
        found.where(F.col("kind") == REFERENCE).select("row", "seq", "doc_id", "name", "head", "tail").join(coded, "name")
        .select("row", "seq", "doc_id", "ids", (skip * width).alias("skip"), (drop * width).alias("lost")).select("row", "seq", "doc_id", inner.alias("ids"))
    )
    pieces = found.where(F.col("kind") == SEGMENT).select("row", "seq", "doc_id", F.col("data").alias("ids")).unionByName(taken)

    def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec, last, digest, doc_id = codec_of(tokenizer), None, None, None
        for batch in slices(batches, "ids"):
            out = Rows()
            for row, own_id, ids in zip(*(batch.column(x).to_pylist() for x in ("row", "doc_id", "ids"))):
                if row != last:
                    if digest:
                        out.add(doc_id=doc_id, **digest.result())
                    last, digest, doc_id = row, Digest(codec), own_id
                digest.add(np.frombuffer(ids, codec.dtype))
            yield out.batch()
        if digest:
            out = Rows()
            out.add(doc_id=doc_id, **digest.result())
            yield out.batch()

    ordered = pieces.repartition("row").sortWithinPartitions("row", "seq")
    return ordered.mapInArrow(assemble, _SCHEMA).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
