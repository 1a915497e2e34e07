"""Quality scores by compression: a dictionary of good and one of bad text, and which of them helps a text more.

Each dictionary is trained by zstandard on labelled texts of one class. A text is compressed with both, in blocks so that
a long text doesn't teach the compressor its own style. The size difference over the sum of both sizes is mapped to a
probability by a logistic curve fitted on labelled texts that no dictionary has seen; the curve also takes how far the text
shrinks at all, as a text that repeats itself leaves no difference to see.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, fold, raw_texts, slices

#: Labelled rows that are learnt from, for each class: at most so many, the first in the order of a hash of the id.
SAMPLE_ROWS = 4000
#: Longer labelled texts aren't learnt from, which bounds the sample; all texts are scored whole.
SAMPLE_CHARS = 50_000
DICT_BYTES = 112 << 10
BLOCK = 2048
LEVEL = 3


@dataclass(frozen=True)
class Model:
    good: bytes
    bad: bytes
    weights: tuple[float, float, float]

    def measure(self, raw: bytes) -> tuple[float, float]:
        return _measure(self.good, self.bad, raw)

    def score(self, measured: np.ndarray) -> np.ndarray:
        """Scores of rows of measure()."""
        return 1 / (1 + np.exp(-np.clip(measured @ np.array(self.weights[:2]) + self.weights[2], -500, 500)))


@functools.lru_cache(maxsize=4)
def _compressor(dictionary: bytes):
    import zstandard

    if not dictionary:
        return zstandard.ZstdCompressor(level=LEVEL).compress
    own = zstandard.ZstdCompressionDict(dictionary)
    own.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(dict_data=own, write_content_size=False, write_checksum=False, write_dict_id=False).compress


def _measure(good: bytes, bad: bytes, raw: bytes) -> tuple[float, float]:
    """(bytes with bad's dictionary - bytes with good's) / their sum, over all blocks, and log(their mean / bytes).

    Both are 0 for an empty text.
    """
    if not raw:
        return 0.0, 0.0
    by_good, by_bad = _compressor(good), _compressor(bad)
    blocks = [raw[i : i + BLOCK] for i in range(0, len(raw), BLOCK)]
    g, b = sum(len(by_good(x)) for x in blocks), sum(len(by_bad(x)) for x in blocks)
    return (b - g) / (b + g), math.log((b + g) / (2 * len(raw)))


def _dictionary(samples: list[bytes]) -> bytes:
    """A trained dictionary; with too little text to train on, the text itself (raw content)."""
    import zstandard

    samples = [s[i : i + BLOCK] for s in samples for i in range(0, len(s), BLOCK)]
    try:
        return zstandard.train_dictionary(DICT_BYTES, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-DICT_BYTES:]


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, ...]:
    """Weights of the columns and the intercept, by Newton's method with a little shrinkage."""
    scale = np.maximum(np.abs(x).max(axis=0, initial=0), 1e-9)
    a = np.column_stack([x / scale, np.ones(len(x))])
    w = np.zeros(a.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a * (weight * p * (1 - p))[:, None]).T @ a + 1e-2 * np.eye(len(w)), a.T @ (weight * (y - p)) - 1e-2 * w)
        w = w + np.clip(step, -3, 3)
        if np.abs(step).max() < 1e-9:
            break
    return (*(w[:-1] / scale).tolist(), float(w[-1]))


def fit(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> Model:
    """docs(doc_id, text), labels(doc_id, quality: 1 good, 0 bad; other rows are ignored, as are ids whose labels disagree) -> Model.

    At most 2 * rows texts reach the driver. Half of them train the dictionaries, half the curve. A missing class
    leaves its dictionary empty; no usable label gives a score of 0.5.
    """
    known = labels.where("quality IN (0, 1) AND doc_id IS NOT NULL").select(F.col("doc_id").cast("long"), "quality")
    known = known.groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("quality").alias("other")).where("quality = other").drop("other")
    share = {r["quality"]: r["n"] for r in known.groupBy("quality").agg(F.count("*").alias("n")).collect()}
    order = F.xxhash64("doc_id")
    some = known.where("quality = 1").orderBy(order, "doc_id").limit(rows).unionByName(known.where("quality = 0").orderBy(order, "doc_id").limit(rows))
    texts = documents(docs).where(F.length("text") <= SAMPLE_CHARS).join(F.broadcast(some), "doc_id").select("doc_id", "quality", "text", (F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(2)) == 0).alias("shown"))
    sample = sorted((r["doc_id"], r["quality"], r["text"].encode(), r["shown"]) for r in texts.toLocalIterator())
    good, bad = (_dictionary([t for _, q, t, shown in sample if q == k and shown]) for k in (1, 0))
    rest = [(q, _measure(good, bad, t)) for _, q, t, shown in sample if not shown]
    if not rest:
        return Model(good, bad, (0.0, 0.0, 0.0))
    y, x = np.array([q for q, _ in rest], float), np.array([m for _, m in rest])
    # Weights restore the classes' shares, of which the sample holds up to the same number of rows.
    weight = np.where(y == 1, share.get(1, 0) / max(1, y.sum()), share.get(0, 0) / max(1, (1 - y).sum()))
    return Model(good, bad, _logistic(x, y, weight * len(y) / max(weight.sum(), 1e-9)))


def quality_scores(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """docs(doc_id, text) -> doc_id, difference, score (0 to 1), predicted; one row per input row, no shuffle.

    Null or empty text: difference 0. Null and repeated ids: kept. Other columns are ignored.
    """
    own = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            m = np.array([own.value.measure(raw) for raw in raw_texts(batch)])
            d, s = m[:, 0], own.value.score(m)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(d), pa.array(s), pa.array((s >= threshold).astype(np.int32))], names=["doc_id", "difference", "score", "predicted"])

    return documents(docs).mapInArrow(score, "doc_id long, difference double, score double, predicted int")


def cross_scored(docs: DataFrame, labels: DataFrame, held_out_fold: int = 0, folds: int = 5, threshold: float = 0.3) -> DataFrame:
    """Scores of all rows by a model learnt outside one fold of ids; held_out marks that fold."""
    model = fit(docs, labels.where(fold("doc_id", folds) != held_out_fold))
    scored = quality_scores(docs, model, threshold)
    return scored.withColumn("held_out", fold("doc_id", folds) == held_out_fold)
