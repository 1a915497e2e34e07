"""Near-duplicate classes by order MinHash with alignment.

A text is a sequence of five-word shingles, each labelled with its occurrence number. One sketch samples the TAKEN
shingles with the least hashes and keeps them in the order of the text, so sketches agree where edit similarity is high
(Marçais and others' order MinHash). Texts that share one of SKETCHES sketches are candidates; a candidate pair is a link
if a banded alignment of their shingles finds at least SIMILARITY of them in common order.

Links are looked for from one leader per bucket first: members that align with the leader are in its class already; the
rest of the bucket gets a new leader, ROUNDS times. That finds most classes with few pairs. Then texts of buckets that
still hold several classes are joined on their rarest shingles, of which any two linked texts share one: so all links
between candidates are found, and no bucket ever meets in all its pairs. Where many texts share a shingle, a few of them
meet the others first, then MORE times as many and at last all: classes grow in between, and texts of one class needn't
meet. Copies are grouped before, so buckets hold different texts only.
"""

from __future__ import annotations

import functools
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, documents, raw_texts, slices, stored
from .text_arrays import labelled, mixed, shingles, split_words

WORDS = 5
SIMILARITY = 0.8
#: With 16 sketches of 3 shingles a pair at similarity 0.8 agrees on none with a probability of about 1e-5.
SKETCHES = 16
TAKEN = 3
LEADERS = 4
#: Rounds of leaders before texts of unlike buckets meet by their rarest shingles.
ROUNDS = 3
#: Texts sharing a rare shingle that meet the others in the first such round, and the factor from round to round.
MET = 64
MORE = 8
#: Rarer shingles of a text that its row for a shingle names.
NAMED = 8
#: Parts of a group of copies.
SALTS = 32
#: Slots, as a power of two, of the table that tells common shingles from rare ones.
TABLE_BITS = 20
#: 64-bit words of flags that tell from two texts alone how many shingles they can't share.
SIGNATURE = 8
#: Rows of sketches per partition of what is derived from them.
ROWS_PER_PART = 20_000


def order_sketches(values: np.ndarray, starts: np.ndarray, sketches: int = SKETCHES, taken: int = TAKEN) -> np.ndarray:
    """(texts, sketches) of 64-bit numbers. Texts of fewer than `taken` shingles have their whole sequence as sketch."""
    n = len(starts) - 1
    out = np.zeros((n, sketches), np.uint64)
    lengths = np.diff(starts)
    own = labelled(values, starts)
    full = np.flatnonzero(lengths >= taken)
    for d in np.flatnonzero((lengths > 0) & (lengths < taken)).tolist():
        x = np.zeros(1, np.uint64)
        for v in own[starts[d] : starts[d + 1]]:
            x = mixed(x + v)
        out[d] = x
    if not len(full):
        return out
    keep = np.repeat(lengths >= taken, lengths)
    own, lengths = own[keep], lengths[full]
    begin = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    for j in range(sketches):
        h = mixed(own ^ mixed(np.array([j + 1], np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
        places = np.empty((taken, len(full)), np.int64)
        for t in range(taken):
            least = np.minimum.reduceat(h, begin)
            places[t] = np.flatnonzero(h == np.repeat(least, lengths))  # labels differ within a text, and mixed() is one to one
            h[places[t]] = np.uint64(0xFFFFFFFFFFFFFFFF)
        x = np.full(len(full), j, np.uint64)
        for row in np.sort(places, axis=0):
            x = mixed(x + own[row])
        out[full, j] = x
    return out


def aligned(a: np.ndarray, b: np.ndarray, least: float = SIMILARITY) -> bool:
    """Whether the longest common subsequence L of two shingle sequences has L / (len(a) + len(b) - L) >= least.

    Pairs that similar differ by few insertions and deletions, so only a diagonal band of that width is searched.
    """
    n, m = len(a), len(b)
    if not n or not m:
        return n == m
    need = int(np.ceil(least * (n + m) / (1 + least) - 1e-9))
    if need > min(n, m):
        return False
    k = min(n, m)
    head = int(np.argmin(np.concatenate([a[:k] == b[:k], [False]])))
    a, b, k = a[head:], b[head:], k - head
    tail = int(np.argmin(np.concatenate([a[len(a) - k :][::-1] == b[len(b) - k :][::-1], [False]]))) if k else 0
    a, b = a[: len(a) - tail], b[: len(b) - tail]
    need -= head + tail
    if need <= 0:
        return True
    both = np.intersect1d(a, b)
    if not len(both):
        return False
    ia, ib = np.flatnonzero(np.isin(a, both)), np.flatnonzero(np.isin(b, both))
    if min(len(ia), len(ib)) < need:
        return False
    band = n + m - 2 * (need + head + tail)
    places: dict[int, list[int]] = defaultdict(list)
    for i in ia.tolist():
        places[int(a[i])].append(i)
    ends: list[int] = []
    for j in ib.tolist():  # Hunt and Szymanski's method within the band
        own = places[int(b[j])]
        for i in reversed(own[bisect_left(own, j - band) : bisect_left(own, j + band + 1)]):
            at = bisect_left(ends, i)
            if at == len(ends):
                ends.append(i)
            else:
                ends[at] = i
    return len(ends) >= need


def sketched(docs: DataFrame, sketches: int = SKETCHES, taken: int = TAKEN) -> DataFrame:
    """docs(doc_id, text) -> doc_id, h1, h2 (128 bits of the words), n (shingles), sketches; rows without id are left out."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            words = split_words(raw_texts(batch))
            value, starts = shingles(words.hashes, words.starts, WORDS)
            rows = order_sketches(value, starts, sketches, taken)
            place = (np.arange(len(words.hashes)) - np.repeat(words.starts[:-1], np.diff(words.starts))).astype(np.uint64)
            whole = []
            for seed in (np.uint64(0x8BB84B93962EACC9), np.uint64(0x4B33A62ED433D4A3)):
                sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed(words.hashes + place * seed), dtype=np.uint64)])
                whole.append(pa.array((sums[words.starts[1:]] - sums[words.starts[:-1]]).view(np.int64)))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * sketches), pa.array(rows.reshape(-1).view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *whole, pa.array(np.diff(starts)), lists], names=["doc_id", "h1", "h2", "n", "sketches"])

    return documents(docs).where("doc_id IS NOT NULL").mapInArrow(sketch, "doc_id long, h1 long, h2 long, n long, sketches array<long>")


def verified(pairs: DataFrame, text: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """pairs(a, b) of ids, text(id, text) -> the pairs that align. Texts are joined on each side; nothing is grouped."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(slices(batches, "text_a"), "text_b"):
            ab = []
            for c in ("text_a", "text_b"):
                words = split_words(raw_texts(batch, c))
                ab.append(shingles(words.hashes, words.starts, WORDS))
            (va, sa), (vb, sb) = ab
            keep = pa.array([aligned(va[sa[i] : sa[i + 1]], vb[sb[i] : sb[i + 1]], least) for i in range(batch.num_rows)])
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(keep), batch.column("b").filter(keep)], names=["a", "b"])

    with_a = pairs.join(text.select(F.col("id").alias("a"), F.col("text").alias("text_a")), "a")
    with_b = with_a.join(text.select(F.col("id").alias("b"), F.col("text").alias("text_b")), "b")
    return with_b.select("a", "b", "text_a", "text_b").mapInArrow(check, "a long, b long")


def _with_leaders(members: DataFrame) -> DataFrame:
    """members(id, n, j, key) -> those of buckets (j, key) with two or more, but the leaders, with leader(id, n).

    A leader is the member with the least of LEADERS hashes, so a member of many buckets meets few leaders.
    """
    leader = F.min_by(F.struct("id", "n"), F.xxhash64("id", F.col("j") % LEADERS)).alias("leader")
    shared = members.groupBy("j", "key").agg(F.count("*").alias("k"), leader).where("k > 1").drop("k")
    return members.join(shared, ["j", "key"]).where("id <> leader.id")


def _needed(n: Column | str, m: Column | str, least: float) -> Column:
    """Shingles that sequences of n and m must have in common."""
    size = F.col(n) + F.col(m)
    return F.ceil(least * size / (1 + least) - 1e-9)


def _labelled_shingles(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    words = split_words(raw_texts(batch))
    value, starts = shingles(words.hashes, words.starts, WORDS)
    return labelled(value, starts), starts


def _spread(text: DataFrame) -> np.ndarray:
    """How often shingles of text(text) fall into each of 2 ** TABLE_BITS slots; that many sums reach the driver."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(1 << TABLE_BITS, np.int64)
        for batch in slices(batches):
            sums += np.bincount((_labelled_shingles(batch)[0] >> np.uint64(64 - TABLE_BITS)).astype(np.int64), minlength=len(sums))
        at = np.flatnonzero(sums)
        for i in range(0, len(at), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(at[i : i + 100_000].astype(np.int32)), pa.array(sums[at[i : i + 100_000]])], names=["slot", "n"])

    table = text.select("text").mapInArrow(count, "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(1 << TABLE_BITS, np.int64)
    out[np.asarray(table.column("slot"))] = np.asarray(table.column("n"))
    return out


def _prefixes(text: DataFrame, least: float) -> DataFrame:
    """text(id, text) -> s, at, before, id, n, bits: each text's rarest shingles, so many that any link shares one of them.

    Two linked texts have at least `least` of the longer one's shingles in common. In any fixed order of all shingles
    a text's first n - ceil(least * n) + 1 therefore hold one of the other's first. The order goes from shingles of
    sparsely used slots to those of crowded ones, so what a large group of texts shares comes last; which slots are
    crowded changes the number of pairs, never which links are found.

    bits are 64 * SIGNATURE flags, each flipped by the shingles that fall to it: two texts differ in at least as many
    shingles as in flags. before are the last NAMED shingles before s in that order: two texts that share one of them meet
    there or earlier.
    """
    used = text.sparkSession.sparkContext.broadcast(_spread(text))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            s, starts = _labelled_shingles(batch)
            n = np.diff(starts)
            doc = np.repeat(np.arange(len(n)), n)
            order = np.lexsort((s, used.value[(s >> np.uint64(64 - TABLE_BITS)).astype(np.int64)], doc))
            at = np.arange(len(s)) - np.repeat(starts[:-1], n)
            first = at < (n - np.ceil(least * n - 1e-9) + 1)[doc]
            own = pa.array(doc[first])
            sizes = np.minimum(at[first], NAMED)
            ends = np.cumsum(sizes)
            named = np.repeat(np.flatnonzero(first) - ends, sizes) + np.arange(sizes.sum())
            before = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(s[order][named].view(np.int64)))
            flags = np.bincount(doc * 64 * SIGNATURE + (mixed(s) % np.uint64(64 * SIGNATURE)).astype(np.int64), minlength=batch.num_rows * 64 * SIGNATURE) & 1
            bits = np.packbits(flags.astype(np.uint8)).view(np.int64).reshape(-1, SIGNATURE)[doc[first]]
            yield pa.RecordBatch.from_arrays(
                [pa.array(s[order][first].view(np.int64)), pa.array(at[first]), before, batch.column("id").take(own), pa.array(n[doc[first]]), *map(pa.array, bits.T)],
                names=["s", "at", "before", "id", "n", *(f"bits{i}" for i in range(SIGNATURE))],
            )

    return text.select("id", "text").mapInArrow(cut, ", ".join(["s long, at long, before array<long>, id long, n long", *(f"bits{i} long" for i in range(SIGNATURE))]))


def _unlike(buckets: DataFrame, classes: DataFrame) -> DataFrame:
    """buckets(j, key, id), classes(node, component) -> id of the texts from buckets that hold several classes."""
    own = buckets.join(classes, F.col("id") == F.col("node"), "left").select("j", "key", "id", F.coalesce("component", "id").alias("c"))
    # The leader has checked a bucket of two.
    unlike = own.groupBy("j", "key").agg(F.count("*").alias("k"), F.min("c").alias("low"), F.max("c").alias("high")).where("k > 2 AND low <> high")
    return own.join(unlike.select("j", "key"), ["j", "key"], "left_semi").select("id").distinct()


def _shared(rows: DataFrame) -> DataFrame:
    """rows(s, c) -> s of several classes, the largest of them and k, the rows with s."""
    kinds = rows.groupBy("s", "c").agg(F.count("*").alias("k")).groupBy("s")
    return kinds.agg(F.max_by("c", F.struct("k", "c")).alias("largest"), F.count("*").alias("kinds"), F.sum("k").alias("k")).where("kinds > 1").drop("kinds")


def _unchecked(rows: DataFrame, shared: DataFrame, checked: DataFrame, least: float, most: int) -> DataFrame:
    """rows as of _prefixes with c, shared as of _shared, checked(a, b) -> pairs(a, b) that may still be links.

    These are the pairs of texts in different classes that share one of their rarest shingles (see _prefixes) early enough
    to reach `least`. So a bucket of texts that a common passage or many edits of one text brought together never meets
    in all its pairs. No link is missed if each s has `most` rows or fewer; of more, about `most` meet the others, the
    same texts for every s and with every larger `most`. A pair is made where no shingle named before is shared: mostly
    once, and always where its first shared shingle is.
    """
    met = rows.join(shared, "s")
    flags = [f"bits{i}" for i in range(SIGNATURE)]
    # Where a shingle is shared across classes, the members outside its largest class meet all of another class.
    left = met.where("c <> largest").select("s", F.col("id").alias("a"), "n", "at", "before", "c", *flags)
    some = (F.col("k") <= most) | (F.pmod(F.xxhash64("id"), F.lit(1 << 20)) * F.col("k") < most << 20)
    right = met.where(some).select("s", "largest", F.col("id").alias("b"), F.col("n").alias("m"), F.col("at").alias("bt"), F.col("before").alias("earlier"), F.col("c").alias("d"), *(F.col(x).alias(f"b{x}") for x in flags))
    differ = functools.reduce(Column.__add__, (F.bit_count(F.col(x).bitwiseXOR(F.col(f"b{x}"))) for x in flags))
    alike = differ <= F.col("n") + F.col("m") - 2 * _needed("n", "m", least)
    near = F.least(F.col("n") - F.col("at"), F.col("m") - F.col("bt")) >= _needed("n", "m", least)
    once = (F.col("d") == F.col("largest")) | (F.col("a") < F.col("b"))
    like = (F.col("n") >= least * F.col("m")) & (F.col("m") >= least * F.col("n"))
    pairs = left.join(right, "s").where((F.col("c") != F.col("d")) & once & near & alike & like & ~F.arrays_overlap("before", "earlier"))
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct().join(checked, ["a", "b"], "left_anti")


def components(links: DataFrame, parts: int) -> DataFrame:
    """links(a, b) -> node, component (its least node), by alternating large and small stars (Kiveris and others).

    Every round is two grouped minima and one distinct; rounds follow the logarithm of a component's size.
    """
    edges = _kept(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), parts)
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u AND v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        pairs = F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))
        small = large.join(least, "u").select(F.explode(pairs).alias("e")).select("e.*").where("u <> v").distinct()
        edges = _kept(small, parts)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
        before = now


def _kept(df: DataFrame, parts: int) -> DataFrame:
    """A checkpoint in at most `parts` files: links and buckets are small beside texts."""
    return checkpointed(df.coalesce(parts))


def near_classes(docs: DataFrame, least: float = SIMILARITY, sketches: int = SKETCHES, taken: int = TAKEN) -> DataFrame:
    """docs(doc_id, text) -> doc_id, class_id (the class's least doc_id), copy_of (the least doc_id of equal words), n_rows.

    One row per distinct non-null doc_id. Texts without words are copies of each other. Rows that repeat a doc_id with
    other texts join both texts' classes. Rows without an id have no name and are left out. Other columns are ignored.
    """
    rows = stored(sketched(docs, sketches, taken))
    parts = max(8, -(-rows.count() // ROWS_PER_PART))
    texts = rows.groupBy("h1", "h2").agg(F.min("doc_id").alias("id"), F.first("n").alias("n"), F.first("sketches").alias("sketches"))
    # A group of copies may hold a third of all rows: its rows meet their text's id in SALTS parts.
    own = rows.select("doc_id", "h1", "h2", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).alias("salt"))
    met = own.select("h1", "h2", "salt").distinct().join(texts.select("h1", "h2", "id"), ["h1", "h2"])
    copies = own.join(met, ["h1", "h2", "salt"]).select("doc_id", F.col("id").alias("copy_of"))
    texts = _kept(texts.where("n > 0"), parts)
    left = _kept(_with_leaders(texts.select("id", "n", F.posexplode("sketches").alias("j", "key"))), parts)
    # Texts of candidates only, written once: later rounds read no others.
    named = left.select("id").unionByName(left.select("leader.id")).distinct()
    own = documents(docs).where("doc_id IS NOT NULL").select(F.col("doc_id").alias("id"), "text")
    kept = stored(own.join(named, "id", "left_semi").select("id", "text"))
    met, checked, found = left, None, None
    for _ in range(ROUNDS):
        # Lengths bound the similarity: no pair is checked that can't reach it.
        pairs = left.where((F.col("n") >= least * F.col("leader.n")) & (F.col("leader.n") >= least * F.col("n")))
        pairs = _kept(pairs.select(F.least("id", "leader.id").alias("a"), F.greatest("id", "leader.id").alias("b")).distinct(), parts)
        fresh = _kept(pairs.join(checked, ["a", "b"], "left_anti"), parts) if checked else pairs
        links = _kept(verified(fresh, kept, least), parts)
        checked = checked.unionByName(fresh) if checked else fresh
        found = found.unionByName(links) if found else links
        # Who doesn't align with the leader stays, under the bucket's own key.
        linked = found.select(F.col("a").alias("la"), F.col("b").alias("lb"))
        rest = left.join(linked, (F.least("id", "leader.id") == F.col("la")) & (F.greatest("id", "leader.id") == F.col("lb")), "left_anti").drop("leader")
        left = _kept(_with_leaders(rest), parts)
        if left.isEmpty():
            break
    repeated = rows.groupBy("doc_id").agg(F.count("*").alias("k")).where("k > 1").select("doc_id")
    # An id with several texts ties their classes together; else only links between different texts need components.
    tied = copies.join(repeated, "doc_id", "left_semi").where("doc_id <> copy_of").select(F.col("doc_id").alias("a"), F.col("copy_of").alias("b"))
    classes = components(found.unionByName(tied), parts)
    buckets = met.select("j", "key", "id").unionByName(met.select("j", "key", "leader.id").distinct())
    rows, most = stored(_prefixes(kept.join(checkpointed(_unlike(buckets, classes)), "id"), least)), MET
    while True:
        own = rows.join(classes, F.col("id") == F.col("node"), "left").withColumn("c", F.coalesce("component", "id")).drop("node", "component")
        shared = checkpointed(_shared(own))
        top = shared.agg(F.max("k")).first()[0]
        if top is None:
            break
        pairs = _kept(_unchecked(own, shared, checked, least, most), parts)
        links = _kept(verified(pairs, kept, least), parts)
        checked = checked.unionByName(pairs)
        if not links.isEmpty():
            classes = components(classes.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(links), parts)
        if top <= most:
            break
        most *= MORE
    first = copies.groupBy("doc_id").agg(F.min("copy_of").alias("copy_of"), F.count("*").alias("n_rows"))
    return first.join(classes, F.col("copy_of") == F.col("node"), "left").select("doc_id", F.coalesce("component", "copy_of").alias("class_id"), "copy_of", "n_rows")
