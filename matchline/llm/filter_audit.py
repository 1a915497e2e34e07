"""What each order of five filters removes, for all 120 orders at once.

A document is known by the set of filters that it fails. Orders are numbered lexicographically (Lehmer rank), so the
orders that share their first k filters are one interval of ranks, and what a set of failures means at step k is the
same within such an interval. Counts are added where intervals begin and taken off where they end; one prefix sum over
the ranks gives every order's totals. Documents are counted once, not once per order.
"""

from __future__ import annotations

import itertools
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import on_workers, raw_texts, slices, stored

FILTERS = "ABCDE"
#: Bit of each filter in a document's mask.
BIT = {letter: 1 << i for i, letter in enumerate(FILTERS)}
ORDERS = ["".join(p) for p in itertools.permutations(FILTERS)]
_FLAGS = ("kept", "removed", "redundant", "unique_fails")

_CAPITALS = bytes(range(65, 91))
_MARKS = re.compile(rb"[#$%&*|]")


def facts(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text, source) -> doc_id, part, mask (filters A to D) and text_key, a 128-bit hash of the text."""
    on_workers(docs.sparkSession)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            masks, keys = [], []
            for raw in raw_texts(batch):
                words = raw.split()
                short = len(words) < 50
                few = 100 * len(set(words)) < 65 * len(words)
                points = len(raw.decode()) if not raw.isascii() else len(raw)
                loud = 100 * (len(raw) - len(raw.translate(None, _CAPITALS))) > 5 * points
                masks.append(BIT["A"] * short + BIT["B"] * few + BIT["C"] * loud + BIT["D"] * bool(_MARKS.search(raw)))
                keys.append(xxhash.xxh3_128_digest(raw))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("part"), pa.array(masks, pa.int32()), pa.array(keys, pa.binary())],
                names=["doc_id", "part", "mask", "text_key"],
            )

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), F.col("text").cast("string").alias("text"))
    return own.mapInArrow(measure, "doc_id long, part string, mask int, text_key binary")


def mask_counts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Documents per part, mask of all five filters, good and toxic: at most 128 rows a part.

    Filter E is judged on counts: of a text's documents all but those of its least doc_id fail. So copies are summed
    per text, part and labels before they meet, and a text of many copies is a few rows. Rows without a doc_id are
    nobody's copy and have no labels. A doc_id that is labelled twice is good or toxic if one of its labels says so.
    """
    own = facts(docs)
    flags = (
        labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id"))
        .agg(F.coalesce(F.max(F.col("quality") == 1), F.lit(False)).alias("good"), F.coalesce(F.max(F.col("toxic") == 1), F.lit(False)).alias("toxic"))
    )
    no = F.lit(False)
    keys = ("text_key", "mask", "part", "good", "toxic")
    # Rows without an id would meet in one task of the join.
    known = own.where("doc_id is not null").groupBy("doc_id", "part", "mask", "text_key").agg(F.count("*").alias("n"))
    known = known.join(flags, "doc_id", "left").withColumn("good", F.coalesce("good", no)).withColumn("toxic", F.coalesce("toxic", no))
    texts = stored(
        known.groupBy(*keys).agg(F.sum("n").alias("n"), F.min("doc_id").alias("least"), F.sum("n").alias("known"), F.min_by("n", "doc_id").alias("n_least"))
        .unionByName(own.where("doc_id is null").groupBy("text_key", "mask", "part").agg(F.count("*").alias("n")), allowMissingColumns=True)
        .fillna(False, ["good", "toxic"])
    )
    first = texts.groupBy("text_key").agg(F.min("least").alias("first"))
    late = F.coalesce(F.col("known") - F.when(F.col("least") == F.col("first"), F.col("n_least")).otherwise(0), F.lit(0))
    split = F.explode(F.array(F.struct((F.col("mask") + BIT["E"]).alias("mask"), late.alias("n")), F.struct(F.col("mask"), (F.col("n") - late).alias("n")))).alias("x")
    rows = texts.join(first, "text_key").select("part", "good", "toxic", split)
    return rows.groupBy("part", F.col("x.mask").alias("mask"), "good", "toxic").agg(F.sum("x.n").alias("n"))


def intervals() -> list[tuple[int, int, int, int, int, int, int, int]]:
    """(mask, step, from rank, to rank, kept, removed, redundant, unique_fails) for all masks, neighbours alike joined.

    The orders with a given beginning of `step` filters are one interval of (5 - step)! ranks.
    """
    n, out = len(FILTERS), []
    for step in range(1, n + 1):
        width = math.factorial(n - step)
        for mask in range(1 << n):
            last = None
            for i, begin in enumerate(itertools.permutations(FILTERS, step)):
                hits = [bool(mask & BIT[x]) for x in begin]
                failed_before, fails = any(hits[:-1]), hits[-1]
                flags = (not any(hits), fails and not failed_before, fails and failed_before, fails and mask == BIT[begin[-1]])
                if last and last[4:] == flags:
                    last = (*last[:3], (i + 1) * width, *flags)
                else:
                    if last and any(last[4:]):
                        out.append(last)
                    last = (mask, step, i * width, (i + 1) * width, *flags)
            if any(last[4:]):
                out.append(last)
    return [tuple(map(int, row)) for row in out]


def _table(spark: SparkSession, rows: list[tuple], names: str) -> DataFrame:
    return spark.createDataFrame(rows, ", ".join(f"{x} {'string' if x == 'filter_order' else 'int'}" for x in names.split()))


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs(doc_id, text, source), labels(doc_id, quality, toxic) -> what the five filters do in every order.

    One row per part (source; null: empty), filter_order and step: kept, removed, redundant, unique_fails, good_lost,
    toxic_lost and shapley, zeros included. Null texts are empty ones. Repeated rows count each; equal rows of one
    doc_id aren't copies of each other. Rows without a doc_id count, without labels, and never fail E. Empty table: no
    rows. Other columns are ignored.
    """
    spark = docs.sparkSession
    counts = stored(mask_counts(docs, labels))
    spans = _table(spark, intervals(), "mask step begin end " + " ".join(_FLAGS))  # fixed by the number of filters
    sums = (*_FLAGS, "good_lost", "toxic_lost")

    def edges(sign: int, rank: str) -> Column:
        n = F.col("n") * sign
        lost = n * F.col("removed")
        return F.struct(
            F.col(rank).alias("rank"), *((n * F.col(x)).alias(x) for x in _FLAGS),
            F.when(F.col("good"), lost).otherwise(0).alias("good_lost"), F.when(F.col("toxic"), lost).otherwise(0).alias("toxic_lost"),
        )

    ends = counts.join(F.broadcast(spans), "mask").select("part", "step", F.explode(F.array(edges(1, "begin"), edges(-1, "end"))).alias("x")).select("part", "step", "x.*")
    ranks = F.explode(F.sequence(F.lit(0), F.lit(len(ORDERS) - 1)))
    steps = F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS))))
    grid = counts.select("part").distinct().select("part", steps.alias("step")).select("part", "step", ranks.alias("rank"), *(F.lit(0).cast("long").alias(x) for x in sums))
    differences = ends.unionByName(grid).groupBy("part", "step", "rank").agg(*(F.sum(x).alias(x) for x in sums)).where(F.col("rank") < len(ORDERS))
    upward = Window.partitionBy("part", "step").orderBy("rank")
    totals = differences.select("part", "step", "rank", *(F.sum(x).over(upward).alias(x) for x in sums))
    orders = _table(spark, list(enumerate(ORDERS)), "rank filter_order")
    named = totals.join(F.broadcast(orders), "rank").withColumn("letter", F.substring("filter_order", F.col("step"), F.lit(1)))
    everywhere = Window.partitionBy("part", "letter")
    return named.select("part", "filter_order", "step", *sums, F.sum("removed").over(everywhere).alias("shapley"))
