"""From raw documents to packed training sequences.

Stages take (spark, docs, sf_dir) and return a DataFrame; all but the last return the columns of `documents`. run()
writes each stage's result to the shared folder and reads it again, so a lost executor costs a stage at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matchline.llm import common, decontamination, line_dedup, near_dedup, packing, quality_rules

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that every rule of the policy passes; null or empty texts have too few words. Repeated rows stay."""
    rows = quality_rules.apply_policy(quality_rules.ledger(docs.select(*COLUMNS), carry=True), "v1")
    return rows.where("kept").select("row.*")


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document without the lines that many documents share; each such line stays in its last document.

    Rows that share an id count as one document, as do all rows without one. Null texts become empty.
    """
    kept = line_dedup.line_dedup(docs.select(*COLUMNS), carry=("lang", "source"))
    return kept.select("doc_id", "text", "lang", "source", F.length("text").cast("long").alias("n_chars"))


def _named(docs: DataFrame) -> DataFrame:
    """docs with name: the doc_id, or where it is null a number from a hash of the text that no doc_id can be.

    Ids leave room above the largest or below the least; hashes go to the larger room, above if they can: there, of alike
    documents the one with an id has the least name.
    """
    doc_id = F.col("doc_id").cast("long")
    least, most = docs.agg(F.min(doc_id), F.max(doc_id)).first()
    own = F.xxhash64(F.coalesce("text", F.lit("")))
    if most is not None:
        above, below = min(2**63 - 1 - most, 2**63 - 1), min(least + 2**63, 2**63 - 1)
        if not above and not below:
            raise ValueError("doc_id takes up all 64-bit numbers")
        own = most + 1 + F.pmod(own, F.lit(above)) if above >= below or above >= 2**62 else least - 1 - F.pmod(own, F.lit(below))
    return docs.select(*COLUMNS, F.coalesce(doc_id, own).alias("name"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least id of each class; a row without an id goes by its text and yields to one with an id.

    Rows that share an id are one document and stay together, whatever their texts; rows alike in all columns become one.
    Texts without words are one class. Empty table: no rows.
    """
    own = _named(docs)
    first = near_dedup.near_classes(own.select(F.col("name").alias("doc_id"), "text")).where("doc_id = class_id").select(F.col("doc_id").alias("name"), "n_rows")
    kept = own.join(common.stored(first), "name")
    return kept.where("n_rows = 1").select(*COLUMNS).unionByName(kept.where("n_rows > 1").select(*COLUMNS).distinct())


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark; all rows of an id that holds one go. Rows without an id go by their text."""
    own = _named(docs)
    found = decontamination.contaminated(own.select(F.col("name").alias("doc_id"), "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return own.join(found.select(F.col("doc_id").alias("name")).distinct(), "name", "left_anti").select(*COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their sequence and offset; a null text is one piece with the end alone. No rows: none."""
    import public_tokenizers

    pieces = packing.pieces(docs, public_tokenizers.path("word_bpe_49k.json"))
    return packing.pack(pieces).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [
    ("quality rules", quality),
    ("line dedup", lines),
    ("MinHash near-dedup", near_duplicates),
    ("benchmark decontamination", decontaminated),
    ("best-fit packing", packed),
]

#: Alignment and bin packing are beyond SQL; tests hold the stages against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = common.stored(stage(spark, docs, sf_dir))
    return docs
