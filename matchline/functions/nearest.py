"""Exact k nearest unit vectors by a blocked join of queries and rows, pruned by pivots.

Rows are dealt into cells by their nearest pivot and into rings by their distance to it. From each ring's least and
greatest distance and its number of rows, a query knows how near its k-th row is at least, and by the triangle inequality
which rings hold none as near. Only those meet the query, in blocks of bounded size on both sides.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.stored import written
from .helpers import on_workers

#: Rows and queries of a block; pivots, at most; width of a ring.
BLOCK = 8192
PIVOTS = 128
RING = 0.05
#: Slack for rounding in the bounds.
SLACK = 1e-7
_APART = np.sqrt(2.0)  # a vector of zeros has cosine distance 1 to all


def unit_rows(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """A column of equally long lists as rows of length 1; zeros stay."""
    own = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = np.asarray(own.flatten(), dtype=float)
    rows = flat.reshape(len(own), -1) if len(own) else np.zeros((0, 0))
    return rows / np.maximum(np.sqrt((rows**2).sum(axis=1, keepdims=True)), 1e-300)


def _apart(rows: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Distances of unit rows to unit pivots."""
    return np.sqrt(np.maximum(2 - 2 * np.clip(rows @ pivots.T, -1, 1), 0))


def place(rows: DataFrame, pivots: np.ndarray) -> DataFrame:
    """rows(chunk_id, chunk_index, vector) -> with cell, ring and apart, the distance to the cell's pivot; zeros are cell -1."""
    shared = rows.sparkSession.sparkContext.broadcast(pivots)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            own = unit_rows(batch.column("vector"))
            zero = ~own.any(axis=1)
            if len(shared.value):
                away = _apart(own, shared.value)
                cell = away.argmin(axis=1)
                apart = away[np.arange(len(own)), cell]
            else:  # one cell without a centre: everything is visited
                cell, apart = np.zeros(len(own), np.int64), np.full(len(own), 0.0)
            cell, apart = np.where(zero, -1, cell), np.where(zero, _APART, apart)
            ring = np.floor(apart / RING).astype(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell), pa.array(ring), pa.array(apart)], names=[*batch.schema.names, "cell", "ring", "apart"])

    return rows.mapInArrow(add, ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema), "cell long, ring long, apart double"]))


@dataclass
class Rings:
    """Per ring its cell, number of rows, least and greatest distance, first block and number of blocks: at most pivots x 41 rows."""

    cell: np.ndarray
    n: np.ndarray
    low: np.ndarray
    high: np.ndarray
    first: np.ndarray
    blocks: np.ndarray

    def visits(self, queries: np.ndarray, pivots: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(query, ring) pairs so that each query's k nearest rows, ties included, are in its rings."""
        to = np.concatenate([_apart(queries, pivots), np.zeros((len(queries), 1))], axis=1)[:, self.cell] if len(pivots) else np.zeros((len(queries), len(self.n)))
        lower, upper = np.maximum(np.maximum(to - self.high, self.low - to), 0), to + self.high
        flat = (self.cell == -1)[None, :] | ~queries.any(axis=1)[:, None]
        if len(pivots):
            lower, upper = np.where(flat, _APART, lower), np.where(flat, _APART, upper)
        else:
            lower, upper = np.zeros_like(lower), np.full_like(upper, 2.0)
        order = np.argsort(upper, axis=1)
        enough = np.cumsum(self.n[order], axis=1) >= k
        kth = np.where(enough.any(axis=1), np.take_along_axis(upper, np.take_along_axis(order, enough.argmax(axis=1)[:, None], 1), 1)[:, 0], np.inf)
        return np.nonzero(lower <= kth[:, None] + SLACK)


def topk_block(queries: np.ndarray, rows: np.ndarray, chunk: np.ndarray, index: np.ndarray, k: int) -> pd.DataFrame:
    """The k nearest rows of each query of a block -> q (its place), chunk_id, chunk_index, distance."""
    most, out = min(k, len(rows)), []
    for at in range(0, len(queries), 512):
        distance = 1 - np.clip(queries[at : at + 512] @ rows.T, -1, 1)
        # All rows as near as the k-th stay, so ties are cut by index and id only.
        edge = np.partition(distance, most - 1, axis=1)[:, most - 1 : most]
        q, r = np.nonzero(distance <= edge)
        frame = pd.DataFrame({"q": q + at, "chunk_id": chunk[r], "chunk_index": index[r], "distance": distance[q, r]})
        out.append(frame.sort_values(["q", "distance", "chunk_index", "chunk_id"]).groupby("q").head(k))
    return pd.concat(out)


def nearest(queries: DataFrame, rows: DataFrame, k: int, pivots: int | None = None, block: int = BLOCK) -> DataFrame:
    """queries(query_id, vector), rows(chunk_id, chunk_index, vector) -> query_id, chunk_id, chunk_index, distance.

    At least each query's k nearest rows by cosine distance, ties by (chunk_index, chunk_id): k of every block that it
    visits. Rows and queries without a vector are left out; all vectors are equally long. pivots: as many rows of the
    least id hashes, one per two blocks and at most PIVOTS unless given; only they reach the driver.
    """
    spark = rows.sparkSession
    on_workers(spark)
    rows = rows.where("vector IS NOT NULL").select("chunk_id", "chunk_index", "vector")
    queries = queries.where("vector IS NOT NULL").select("query_id", "vector")
    total, asked = rows.count(), queries.count()
    wanted = min(PIVOTS, total // (2 * block)) if pivots is None else pivots
    chosen = unit_rows(rows.orderBy(F.xxhash64("chunk_id"), "chunk_id").limit(wanted).select("vector").toArrow().column("vector")) if wanted else np.zeros((0, 0))
    chosen = chosen[chosen.any(axis=1)] if len(chosen) else chosen
    placed = place(rows, chosen)
    placed = written(placed) if len(chosen) else placed
    stats = placed.groupBy("cell", "ring").agg(F.count("*").alias("n"), F.min("apart").alias("low"), F.max("apart").alias("high")).orderBy("cell", "ring").toPandas()
    blocks = -(-stats["n"].to_numpy(np.int64) // block)
    rings = Rings(*(stats[c].to_numpy() for c in ("cell", "n", "low", "high")), np.cumsum(blocks) - blocks, blocks)
    shared = spark.sparkContext.broadcast((rings, chosen))
    sides = max(1, -(-asked // block))

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, pivots = shared.value
        for batch in batches:
            if not batch.num_rows or not len(own.n):
                continue
            query, ring = own.visits(unit_rows(batch.column("vector")), pivots, k)
            n = own.blocks[ring]
            query, ring = np.repeat(query, n), np.repeat(ring, n)
            number = own.first[ring] + np.arange(len(ring)) - np.repeat(np.cumsum(n) - n, n)
            yield pa.RecordBatch.from_arrays([batch.column("query_id").take(pa.array(query)), batch.column("vector").take(pa.array(query)), pa.array(number)], names=["query_id", "vector", "block"])

    kind = queries.schema["vector"].dataType.simpleString()
    id_kind = queries.schema["query_id"].dataType.simpleString()
    side = lambda c: F.pmod(F.xxhash64(c), F.lit(sides)).alias("side")
    visits = queries.mapInArrow(visit, f"query_id {id_kind}, vector {kind}, block long").select("query_id", "vector", "block", side("query_id"))
    where = spark.createDataFrame(stats.assign(first=rings.first, blocks=blocks)[["cell", "ring", "first", "blocks"]], "cell long, ring long, first long, blocks long")
    dealt = placed.join(F.broadcast(where), ["cell", "ring"]).withColumn("block", F.col("first") + F.pmod(F.xxhash64("chunk_id"), F.col("blocks")))
    sided = dealt.select("chunk_id", "chunk_index", "vector", "block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(sides - 1).cast("long"))).alias("side")) if sides > 1 else dealt.select("chunk_id", "chunk_index", "vector", "block", F.lit(0).cast("long").alias("side"))
    schema = f"query_id {id_kind}, chunk_id long, chunk_index long, distance double"

    def local(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.table({"query_id": left.column("query_id").slice(0, 0), "chunk_id": pa.array([], pa.int64()), "chunk_index": pa.array([], pa.int64()), "distance": pa.array([], pa.float64())})
        chunk, index = (right.column(c).cast(pa.int64()).to_numpy() for c in ("chunk_id", "chunk_index"))
        found = topk_block(unit_rows(left.column("vector")), unit_rows(right.column("vector")), chunk, index, k)
        return pa.table({"query_id": left.column("query_id").take(pa.array(found["q"].to_numpy())), **{c: pa.array(found[c].to_numpy()) for c in ("chunk_id", "chunk_index", "distance")}})

    return visits.groupBy("block", "side").cogroup(sided.groupBy("block", "side")).applyInArrow(local, schema)
