"""Hashed embeddings by built-in functions, and JSON cleaning, which those can't say."""

from __future__ import annotations

import json
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .scalars import SENSITIVE


def on_workers(spark: SparkSession) -> None:
    """Puts the package on the path of Spark's Python workers, where it isn't installed."""
    spark.sparkContext.environment.setdefault("PYTHONPATH", str(Path(__file__).resolve().parents[2]))


def _clean(x: object) -> object:
    if isinstance(x, dict):
        return {k: _clean(v) for k, v in x.items() if not any(s in k.lower() for s in SENSITIVE)}
    return [_clean(v) for v in x] if isinstance(x, list) else x


def sanitize_json(c: Column | str) -> Column:
    """U4: a JSON text without the entries, at any depth, whose key names a credential; null where it isn't JSON."""

    def clean(texts: pd.Series) -> pd.Series:
        def one(t: str | None) -> str | None:
            try:
                return json.dumps(_clean(json.loads(t)), separators=(",", ":"), ensure_ascii=False) if t is not None else None
            except ValueError:
                return None

        return texts.map(one)

    return F.pandas_udf(clean, "string")(c)


_TOKEN = "[a-z0-9]+"


def _number_at(hex_digits: Column | str, at: Column | int, n: int) -> Column:
    """n bytes of a hex string from byte `at` on, as a number."""
    return F.conv(F.substring(hex_digits, F.lit(at) * 2 + 1, F.lit(2 * n)), 16, 10).cast("int")


def embeddings(texts: DataFrame, dim: int = 768) -> DataFrame:
    """P5: texts(key, text; not null, one text a key) -> key, vector (array<float>): hashed bags of tokens, of length 1.

    Each token adds a sign at four places; a text without tokens has its own digest's bytes. Which bytes of a digest
    give places and signs is a fixed value: stored vectors depend on it. A text's tokens are counted, and its places
    summed, before they leave a task; no more than dim sums a text are gathered.
    """
    entry = lambda place, value: F.struct(F.pmod(place, F.lit(dim)).cast("int").alias("place"), value.cast("double").alias("v"))
    # One exchange by key; all that follows groups by key and more, where the rows are. A null token stands for the text itself.
    own = texts.groupBy("key").agg(F.first("text").alias("text"))
    tokens = F.regexp_extract_all(F.lower("text"), F.lit(_TOKEN), 0)
    bare = F.transform(F.sequence(F.lit(0), F.lit(31)), lambda i: entry(i, _number_at(F.sha2("text", 256), i, 1) / 255.0 - 0.5))
    zeros = F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: entry(i, F.lit(0)))
    marked = own.select("key", tokens.alias("tokens"), F.when(~F.lower("text").rlike(_TOKEN), bare).alias("bare"))
    counted = marked.select("key", "bare", F.explode(F.array_prepend("tokens", F.lit(None).cast("string"))).alias("token"))
    counted = counted.groupBy("key", "token").agg(F.count("*").alias("n"), F.first(F.when(F.col("token").isNull(), F.col("bare"))).alias("bare"))
    hashed = counted.select("key", "n", "bare", F.when(F.col("token").isNotNull(), F.sha2("token", 256)).alias("h"))
    signs = F.array(*(entry(_number_at("h", 2 * j, 2), F.col("n") * (1 - 2 * (_number_at("h", 8 + j, 1) % 2))) for j in range(4)))
    filled = F.when(F.col("bare").isNull(), zeros).otherwise(F.concat(zeros, "bare"))
    sums = hashed.select("key", F.explode(F.when(F.col("h").isNotNull(), signs).otherwise(filled)).alias("e")).groupBy("key", "e.place").agg(F.sum("e.v").alias("v"))
    rows = sums.groupBy("key").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "v"))), lambda e: e["v"]).alias("raw"))
    rows = rows.withColumn("norm", F.sqrt(F.aggregate("raw", F.lit(0.0), lambda a, x: a + x * x)))
    return rows.select("key", F.transform("raw", lambda x: F.when(F.col("norm") > 0, x / F.col("norm")).otherwise(x).cast("float")).alias("vector"))


def embed_batch(df: DataFrame, text: str, dim: int = 768) -> DataFrame:
    """Df with vector (array<float>), the hashed embedding of a text column (null as empty); equal texts are embedded once."""
    whole = F.coalesce(F.col(text), F.lit(""))
    own = df.withColumn("_key", F.unhex(F.sha2(whole, 256)))
    vectors = embeddings(own.select(F.col("_key").alias("key"), whole.alias("text")), dim)
    return own.join(vectors, F.col("_key") == F.col("key")).drop("_key", "key")
