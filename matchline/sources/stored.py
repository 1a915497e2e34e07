"""Tables in the folder that driver and executors share: plain ones, and ones bucketed by a key that joins reuse."""

from __future__ import annotations

import contextlib
import functools
import tempfile
import threading
import uuid
from collections import Counter
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A key with more than this share of a bucket's mean load keeps a table out of buckets.
HOT_SHARE = 0.5


def shared_folder(spark: SparkSession, kind: str) -> str:
    """A new folder under spark.checkpoint.dir, which driver and executors share; local sessions may leave that unset."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        base = f"file://{tempfile.mkdtemp(prefix='spark-')}"
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{kind}-{uuid.uuid4().hex}"


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_lock, _writers = threading.Lock(), Counter()


@contextlib.contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Writes that begin inside leave no shuffle files: what they wrote is read instead, so nobody asks for those again."""
    session = spark._jsparkSession.hashCode()
    with _lock:
        _writers[session] += 1
        if _writers[session] == 1:
            spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        with _lock:
            _writers[session] -= 1
            if not _writers[session]:
                spark.conf.unset(_CLEANUP)


def written(df: DataFrame, folder: str | None = None) -> DataFrame:
    """df as a table in the shared folder: what follows plans and runs without its derivation."""
    folder = folder or shared_folder(df.sparkSession, "table")
    with shuffles_dropped(df.sparkSession):
        df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Gives a `written` whose tables go at the end; nothing that is read later may depend on them."""
    root = shared_folder(spark, "scratch")
    try:
        yield lambda df: written(df, f"{root}/{uuid.uuid4().hex}")
    finally:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def bucketed(df: DataFrame, key: str, buckets: int, placed: bool = False) -> DataFrame:
    """Like written, in buckets of key, each sorted by it: joins and groups on key and more columns need no exchange.

    A bucket is read by one task, so key must be spread (see `are_spread`). placed: df comes from tables in these buckets
    without an exchange, so its rows are where they belong.
    """
    spark, name = df.sparkSession, f"bucketed_{uuid.uuid4().hex}"
    rows = (df if placed else df.repartition(buckets, key)).write.format("parquet").bucketBy(buckets, key).sortBy(key)
    with shuffles_dropped(spark):
        rows.option("path", shared_folder(spark, "table")).saveAsTable(name)
    return spark.table(name)


def at_once(calls: list[Callable[[], DataFrame]]) -> list[DataFrame]:
    """What the calls return, run side by side: jobs that are too small to fill the cluster one by one."""
    with ThreadPoolExecutor(len(calls)) as pool:
        return [f.result() for f in [pool.submit(call) for call in calls]]


def are_spread(tables: list[DataFrame], key: str, buckets: int) -> bool:
    """In no table has a value of key more rows than HOT_SHARE of a bucket's mean, and than a thousand. One job."""
    rows = [df.select(F.col(key).alias("key"), F.lit(i).alias("table")) for i, df in enumerate(tables)]
    per_key = functools.reduce(DataFrame.unionByName, rows).groupBy("table", "key").agg(F.count("*").alias("n"))
    loads = per_key.groupBy("table").agg(F.sum("n").alias("n"), F.max("n").alias("most")).collect()
    return all(r["most"] <= max(1000, HOT_SHARE * r["n"] / buckets) for r in loads)
