"""Sums over the units (pre-tokens, words) of every document, with one value row per distinct unit.

A document's result is a sum of values that depend on the unit alone. The vocabulary is counted once, values are
computed once for each distinct unit, and documents meet the values in two ways: the commonest units (at most
HOT_UNITS of at most HOT_UNIT_BYTES each, so a proven bound) are broadcast and summed where the text is read; every
other (document, unit, frequency) row goes through a shuffled join. Both together are exact.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, texts

HOT_UNITS = 1 << 18
HOT_UNIT_BYTES = 64
#: Distinct units that a task holds before it passes its counts on.
HELD_UNITS = 250_000

Split = Callable[[str], list]


def vocabulary(docs: DataFrame, split: Split) -> DataFrame:
    """docs(text, train) -> unit (binary), n: occurrences, c: those in rows with train. Pre-aggregated in each task."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[Counter, Counter] = (Counter(), Counter())

        def flush() -> Iterator[pa.RecordBatch]:
            for train, counts in enumerate(held):
                if counts:
                    n = pa.array(counts.values(), pa.int64())
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(counts.keys(), pa.binary()), n, n if train else pa.array(np.zeros(len(counts), np.int64))],
                        names=["unit", "n", "c"],
                    )
                    counts.clear()

        for batch in slices(batches):
            for text, train in zip(texts(batch), batch.column("train").to_pylist()):
                held[bool(train)].update(split(text))
            if len(held[0]) + len(held[1]) > HELD_UNITS:
                yield from flush()
        yield from flush()

    rows = docs.select("text", "train").mapInArrow(count, "unit binary, n long, c long")
    return rows.groupBy("unit").agg(F.sum("n").alias("n"), F.sum("c").alias("c"))


def hot_cutoff(values: DataFrame) -> int:
    """The least power of two so that at most HOT_UNITS short units occur as often; from 63 counts at most."""
    steps = values.where(F.length("unit") <= HOT_UNIT_BYTES).groupBy(F.floor(F.log2("n")).cast("int").alias("b")).count().collect()
    least, taken = 62, 0
    for row in sorted(steps, key=lambda r: -r["b"]):
        taken += row["count"]
        if taken > HOT_UNITS:
            break
        least = row["b"]
    return 2**least


def unit_sums(docs: DataFrame, split: Split, values: DataFrame, columns: list[str], extra: Callable[[list[list]], np.ndarray] | None = None) -> DataFrame:
    """docs(doc_id, text) and values(unit, n, *columns) -> doc_id, n_bytes, n_units, extra and the columns' sums.

    extra: a number for each of some documents' lists of units, for what depends on their order.
    One row per input row; a null text has no bytes and the units of ''. Equal rows each get their result.
    """
    spark = docs.sparkSession
    is_hot = (F.length("unit") <= HOT_UNIT_BYTES) & (F.col("n") >= F.lit(hot_cutoff(values)))
    table = values.where(is_hot).select("unit", *columns).toArrow()
    hot = spark.sparkContext.broadcast(
        (table.column("unit").to_pylist(), np.column_stack([np.asarray(table.column(c), float) for c in columns]))
    )
    names = [f"s{i}" for i in range(len(columns))]
    schema = ", ".join(["doc_id long", "h long", "unit binary", "is_unit boolean", "n long", "n_bytes long", "n_units long", "extra double", *(f"{c} double" for c in names)])

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units, matrix = hot.value
        matrix = np.vstack([matrix, np.zeros((1, len(names)))])
        get = dict(zip(units, range(len(units)))).get
        for batch in slices(batches):
            ids = batch.column("doc_id").to_pylist()
            keys, hashes, unit, counts, sizes, lengths, sums = [], [], [], [], [], [], []
            rare_keys, rare_hashes = [], []
            split_up = []
            for doc_id, text in zip(ids, texts(batch)):
                own = split(text)
                if extra:
                    split_up.append(own)
                raw = text.encode()
                at = np.fromiter(map(get, own, repeat(-1)), np.int32, len(own))
                h = xxhash.xxh3_64_intdigest(raw) - (1 << 63)
                keys.append(doc_id)
                hashes.append(h)
                sizes.append(len(raw))
                lengths.append(len(own))
                sums.append(matrix[at].sum(axis=0))
                if len(missing := np.flatnonzero(at < 0)):
                    rest = Counter([own[i] for i in missing.tolist()])
                    unit += rest.keys()
                    counts += rest.values()
                    rare_keys += [doc_id] * len(rest)
                    rare_hashes += [h] * len(rest)
            d, r = len(keys), len(unit)
            own_key = [b"%d,%d" % (i if i is not None else -1, h) for i, h in zip(keys, hashes)]
            more = extra(split_up) if extra else np.zeros(d)
            table = np.array(sums).reshape(d, len(names))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(keys + rare_keys, pa.int64()),
                    pa.array(hashes + rare_hashes, pa.int64()),
                    pa.array(own_key + unit, pa.binary()),
                    pa.array([False] * d + [True] * r),
                    pa.array([1] * d + counts, pa.int64()),
                    pa.array(sizes + [None] * r, pa.int64()),
                    pa.array(lengths + [None] * r, pa.int64()),
                    pa.array(np.concatenate([more, np.zeros(r)])),
                    *(pa.array(np.concatenate([table[:, i], np.zeros(r)])) for i in range(len(names))),
                ],
                names=["doc_id", "h", "unit", "is_unit", "n", "n_bytes", "n_units", "extra", *names],
            )

    rows = docs.select("doc_id", "text").mapInArrow(look_up, schema)
    rare = values.where(~is_hot).select("unit", F.lit(True).alias("is_unit"), *(F.col(c).cast("double").alias(f"v{i}") for i, c in enumerate(columns)))
    # Document rows pass through the join under a key of their own, so nulls don't meet in one task.
    joined = rows.join(rare, ["unit", "is_unit"], "left")
    copies = F.sum(F.when(F.col("is_unit"), 0).otherwise(1))
    found = joined.groupBy("doc_id", "h").agg(
        copies.alias("copies"),
        F.max("n_bytes").alias("n_bytes"),
        F.max("n_units").alias("n_units"),
        F.sum("extra").alias("extra"),
        *(F.sum(F.col(s) + F.coalesce(F.col("n") * F.col(f"v{i}"), F.lit(0.0))).alias(s) for i, s in enumerate(names)),
    )
    return found.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select(
        "doc_id", "n_bytes", "n_units", (F.col("extra") / F.col("copies")).alias("extra"), *((F.col(s) / F.col("copies")).alias(c) for s, c in zip(names, columns))
    )
