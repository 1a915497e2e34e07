"""Size-tiered shards of a table with atomically committed, versioned manifests.

Arrivals are appended as small immutable Parquet files. Compaction merges shards of a similar size, a tier, into files of
about the target size; every merge is one Spark job whose tasks each read some small files and write one. A manifest
lists the shards of a version and the table's schema. It appears by renaming a finished file to a name that must not
exist, so readers see a version wholly or not at all, and of two writers one wins and the other commits on top of the
new version. That needs a file system whose rename is atomic and fails where the name exists, as HDFS's; each writer
also reads back whether its own manifest stands there. Object stores without such a rename need a single writer.

A writer removes only files that it wrote itself and could not commit. What no kept version names any more is removed
by vacuum(): shards of expired versions at once, files that no version ever named (a lost or still running writer's)
only after a day.
"""

from __future__ import annotations

import json
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

TARGET_BYTES = 128 << 20
#: A tier holds sizes within this factor and is merged when it has as many shards.
FAN = 4
#: Shards (about 100 bytes each) that are broadcast as a list; beyond, rows are joined to them.
BROADCAST_SHARDS = 500_000
#: Rows of an arrival's shard at most.
ARRIVAL_ROWS = 20_000
#: Versions that stay readable, and seconds for which files that no version names are left to their writer.
KEEP = 2
ORPHAN_S = 86_400


class Conflict(Exception):
    """Another writer has committed the version first."""


class ShardStore:
    """Shards under root, a folder that driver and executors share."""

    def __init__(self, spark: SparkSession, root: str, target_bytes: int = TARGET_BYTES, fan: int = FAN):
        self.spark, self.root, self.target, self.fan = spark, root.rstrip("/"), target_bytes, fan
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = self._path(self.root).getFileSystem(self._conf)
        for folder in ("manifests", "shards"):
            self._fs.mkdirs(self._path(f"{self.root}/{folder}"))

    # Manifests

    def version(self) -> int:
        """The newest version, 0 before the first commit."""
        names = [x.getPath().getName() for x in self._fs.listStatus(self._path(f"{self.root}/manifests"))]
        return max((int(x[1:-5]) for x in names if x[0] == "v" and x.endswith(".json")), default=0)

    def manifest(self, version: int | None = None) -> dict:
        """version, schema (JSON, None before the first append) and shards (path, bytes, rows, tier); by default the newest."""
        version = self.version() if version is None else version
        if not version:
            return {"version": 0, "schema": None, "shards": []}
        stream = self._fs.open(self._path(f"{self.root}/manifests/v{version:010d}.json"))
        try:
            return json.loads(bytes(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)))
        finally:
            stream.close()

    def commit(self, base: int, shards: list[dict], schema: str | None) -> int:
        """Makes shards the version after base; Conflict if another writer has made that version."""
        jvm, new, writer = self.spark.sparkContext._jvm, base + 1, uuid.uuid4().hex
        draft = self._path(f"{self.root}/manifests/_{writer}")
        stream = self._fs.create(draft, False)
        stream.write(bytearray(json.dumps({"version": new, "writer": writer, "schema": schema, "shards": shards}).encode()))
        stream.close()
        final = self._path(f"{self.root}/manifests/v{new:010d}.json")
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self._conf)
        none = self.spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        try:
            context.rename(draft, final, none)  # fails where the name exists
        except Exception as e:
            self._fs.delete(draft, False)
            if "FileAlreadyExists" in str(e):
                raise Conflict(f"version {new} exists") from e
            raise
        if self.manifest(new)["writer"] != writer:
            raise Conflict(f"version {new} is another writer's")
        return new

    # Shards

    def tier(self, size: int) -> int:
        """0 for shards of about the target size or more, then one more for each factor of fan below it."""
        tier = 0
        while size * self.fan**tier * 2 < self.target and tier < 30:
            tier += 1
        return tier

    def _write(self, df: DataFrame, rows: int = 0) -> list[dict]:
        folder = f"{self.root}/shards/{uuid.uuid4().hex}"
        df.write.option("maxRecordsPerFile", rows).parquet(folder)
        files = [(x.getPath().toString(), x.getLen()) for x in self._fs.listStatus(self._path(folder)) if x.getPath().getName().startswith("part-")]
        if not files:
            return []
        counts = {r["f"]: r["n"] for r in self.spark.read.parquet(folder).groupBy(F.input_file_name().alias("f")).agg(F.count("*").alias("n")).collect()}  # one row per shard
        by_name = {k.rsplit("/", 1)[-1]: v for k, v in counts.items()}
        return [{"path": p, "bytes": b, "rows": n, "tier": self.tier(b)} for p, b in sorted(files) if (n := by_name.get(p.rsplit("/", 1)[-1], 0))]

    def _discard(self, shards: list[dict]) -> None:
        """Removes files that this writer wrote and did not commit."""
        for folder in {s["path"].rsplit("/", 1)[0] for s in shards}:
            self._fs.delete(self._path(folder), True)

    def append(self, df: DataFrame, rows: int = ARRIVAL_ROWS) -> int:
        """Adds df's rows as small shards; no shuffle. Returns the new version. No rows: a version that keeps the schema.

        Every arrival must have the columns of the first; ValueError otherwise.
        """
        schema = _columns(df)
        shards = self._write(df, rows)
        while True:
            now = self.manifest()
            if now["schema"] and json.loads(now["schema"]) != json.loads(schema):
                self._discard(shards)
                raise ValueError(f"columns {schema} are not the table's {now['schema']}")
            try:
                return self.commit(now["version"], [*now["shards"], *shards], schema)
            except Conflict:
                continue

    def compact(self) -> int:
        """Merges tiers that hold `fan` shards or more, smallest first, until none does. Returns the version.

        What comes of a merge lies at least one tier higher, whatever its size, so that merging ends.
        """
        while True:
            now = self.manifest()
            tiers: dict[int, list[dict]] = {}
            for s in now["shards"]:
                tiers.setdefault(s["tier"], []).append(s)
            due = [t for t in sorted(tiers, reverse=True) if t and len(tiers[t]) >= self.fan]
            if not due:
                return now["version"]
            old = tiers[due[0]]
            new = [{**s, "tier": min(s["tier"], due[0] - 1)} for s in self._merge(old, now["schema"])]
            gone = {s["path"] for s in old}
            while gone <= {s["path"] for s in now["shards"]}:  # others may have added shards meanwhile, or merged these
                try:
                    self.commit(now["version"], [*(s for s in now["shards"] if s["path"] not in gone), *new], now["schema"])
                    break
                except Conflict:
                    now = self.manifest()
            else:
                self._discard(new)

    def _merge(self, shards: list[dict], schema: str) -> list[dict]:
        """Spark's reader packs whole small files into partitions of the target size; each is written as one file."""
        own = self.spark.newSession()  # its settings are nobody else's
        own.conf.set("spark.sql.files.maxPartitionBytes", str(self.target))
        own.conf.set("spark.sql.files.openCostInBytes", "0")
        own.conf.set("spark.sql.files.minPartitionNum", "1")
        return self._write(own.read.schema(StructType.fromJson(json.loads(schema))).parquet(*(s["path"] for s in shards)))

    def vacuum(self, keep: int = KEEP, orphan_s: float = ORPHAN_S) -> int:
        """Forgets all but the newest `keep` versions; returns how many files went.

        Shards of forgotten versions go unless a kept one names them. Files that no version names go when they are
        older than orphan_s seconds: younger ones may belong to a writer that hasn't committed yet.
        """
        newest = self.version()
        listed = sorted(int(n[1:-5]) for x in self._fs.listStatus(self._path(f"{self.root}/manifests")) if (n := x.getPath().getName()).endswith(".json") and n[0] == "v")
        names = lambda versions: {s["path"].rsplit("/shards/", 1)[-1] for v in versions for s in self.manifest(v)["shards"]}
        expired = [v for v in listed if v <= newest - keep]
        kept = names(v for v in listed if v > newest - keep)
        gone, before, removed = names(expired) - kept, (time.time() - orphan_s) * 1000, 0
        for folder in self._fs.listStatus(self._path(f"{self.root}/shards")):
            files = list(self._fs.listStatus(folder.getPath()))
            left = 0
            for x in files:
                name, is_part = f"{folder.getPath().getName()}/{x.getPath().getName()}", x.getPath().getName().startswith("part-")
                if is_part and (name in gone or name not in kept and x.getModificationTime() < before):
                    removed += bool(self._fs.delete(x.getPath(), False))
                else:
                    left += is_part or x.getModificationTime() >= before and not x.getPath().getName().startswith("_SUCCESS")
            if files and not left:  # nothing but marks of finished writes
                self._fs.delete(folder.getPath(), True)
        for v in expired:
            self._fs.delete(self._path(f"{self.root}/manifests/v{v:010d}.json"), False)
        return removed

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version; of a table without rows none, with its columns. ValueError before the first append."""
        return self._read(self.manifest(version))

    def _read(self, manifest: dict) -> DataFrame:
        if not manifest["schema"]:
            raise ValueError("the table has no version yet")
        schema = StructType.fromJson(json.loads(manifest["schema"]))
        paths = [s["path"] for s in manifest["shards"]]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def placed(self, version: int | None = None) -> DataFrame:
        """The rows with shard (the file's number in the manifest) and tier; the table's own columns of these names give way."""
        manifest = self.manifest(version)
        own, shards = self._read(manifest), manifest["shards"]
        columns = [c for c in own.columns if c.lower() not in ("shard", "tier")]
        if not shards:
            return own.select(*columns, F.lit(0).cast("long").alias("shard"), F.lit(0).alias("tier"))
        file = max((c for c in columns if c.startswith("file")), default="") + "file"  # no column of the table
        names = self.spark.createDataFrame([(s["path"].rsplit("/", 1)[-1], i, s["tier"]) for i, s in enumerate(shards)], f"`{file}` string, shard long, tier int")
        rows = own.select(*columns, F.element_at(F.split(F.input_file_name(), "/"), -1).alias(file))
        # A shard's rows share their key, so the list of shards goes to the rows as long as it is small.
        return rows.join(F.broadcast(names) if len(shards) <= BROADCAST_SHARDS else names, file).drop(file)


def _columns(df: DataFrame) -> str:
    """The schema as JSON, every column nullable, as Parquet gives it back."""
    nullable = lambda x: {k: True if k in ("nullable", "containsNull", "valueContainsNull") else nullable(v) for k, v in x.items()} if isinstance(x, dict) else [nullable(y) for y in x] if isinstance(x, list) else x
    return json.dumps(nullable(json.loads(df.schema.json())), sort_keys=True)


def shard_table(spark: SparkSession, docs: DataFrame, root: str, arrivals: int = 3, target_bytes: int = TARGET_BYTES, rows: int = ARRIVAL_ROWS) -> ShardStore:
    """docs appended in `arrivals` parts (by a hash of doc_id), each followed by compaction and vacuum.

    All columns are kept as they are, with nulls, repeated rows, empty and long texts. An empty table commits versions
    without shards, which read as no rows with the table's columns.
    """
    store = ShardStore(spark, root, target_bytes)
    part = F.pmod(F.xxhash64("doc_id"), F.lit(arrivals))
    for i in range(arrivals):
        store.append(docs.where(part == i), rows)
        store.compact()
        store.vacuum()
    return store
