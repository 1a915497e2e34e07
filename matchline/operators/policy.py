"""Policy texts: sections, chunks, versions, embeddings, exact retrieval and checks on answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import helpers as U
from ..functions import texts as T
from ..functions.nearest import nearest

#: Evidence entries that a retrieval query names, in this order, and what each family adds. Fixed values.
QUERY_KEYS = ("rule", "affected_field", "field", "expected_unit_price", "billed_unit_price", "expected_value", "actual_value", "percentage_variance", "absolute_variance", "tolerance", "price_tolerance_percent", "quantity_tolerance")
FAMILIES = (
    ("PRICE", "procurement price tolerance approval unit price variance PO vs invoice"),
    ("QUANTITY", "quantity tolerance over-delivery goods receipt invoice matching"),
    ("TAX", "tax rate discrepancy invoice purchase order tolerance"),
)
ANY_FAMILY = "procurement policy reconciliation exception approval"


def sections(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) -> doc_id, place, section_id, section_title, n_blocks, body."""
    rows = docs.select("doc_id", F.posexplode(T.markdown_sections("text")).alias("place", "s"))
    return rows.select("doc_id", "place", "s.section_id", "s.section_title", F.size("s.blocks").cast("long").alias("n_blocks"), F.array_join("s.blocks", "\n\n").alias("body"))


def chunks(docs: DataFrame, max_chars: int = 2000) -> DataFrame:
    """docs(doc_id, text) -> doc_id, chunk_index, section_id, section_title, content, content_hash; map only."""
    rows = docs.select("doc_id", F.posexplode(T.markdown_chunks("text", max_chars)).alias("chunk_index", "c"))
    return rows.select("doc_id", "chunk_index", "c.*", F.sha2("c.content", 256).alias("content_hash"))


def ingest_versions(existing: DataFrame, sources: DataFrame, max_chars: int = 2000) -> tuple[DataFrame, DataFrame]:
    """existing(version_id, source_hash, n_chunks), sources(version_id, text) -> outcome per source, and new chunks."""
    own = sources.withColumn("hash", F.sha2(F.coalesce("text", F.lit("")), 256)).join(existing, "version_id", "left")
    outcome = (
        F.when(F.trim(F.coalesce("text", F.lit(""))) == "", "EMPTY")
        .when((F.col("source_hash") == F.col("hash")) & (F.col("n_chunks") > 0), "ALREADY_INGESTED")
        .when(F.col("n_chunks") > 0, "CONFLICT")
        .otherwise("INGESTED")
    )
    judged = own.withColumn("outcome", outcome)
    work = judged.where("outcome = 'INGESTED'").select(F.col("version_id").alias("doc_id"), "text")
    return judged.select("version_id", "hash", "outcome"), chunks(work, max_chars).withColumnRenamed("doc_id", "version_id")


def check_versions(versions: DataFrame) -> DataFrame:
    """versions(version_id, document_id, label, source_hash, effective_from, effective_to) that break a rule."""
    rules = F.array_compact(F.array(F.when(F.col("effective_to") < F.col("effective_from"), "dates"), F.when(F.trim(F.coalesce("label", F.lit(""))) == "", "label"), F.when(F.length(F.coalesce("source_hash", F.lit(""))) != 64, "hash")))
    single = versions.select("version_id", F.explode(rules).alias("violation"))
    repeated = versions.groupBy("document_id", "label").agg(F.count("*").alias("n")).where("n > 1")
    return single.unionByName(versions.join(repeated, ["document_id", "label"], "left_semi").select("version_id", F.lit("label_repeated").alias("violation")))


def stale(model: str, dim: int) -> Column:
    """On chunks(vector, embedding_model, embedding_hash, content_hash)."""
    return F.col("vector").isNull() | ~F.col("embedding_hash").eqNullSafe(F.col("content_hash")) | ~F.col("embedding_model").eqNullSafe(F.lit(model)) | (F.size("vector") != dim)


def stale_chunks(chunk_rows: DataFrame, model: str, dim: int) -> DataFrame:
    return chunk_rows.where(stale(model, dim))


def embed_versions(chunk_rows: DataFrame, model: str, dim: int) -> tuple[DataFrame, DataFrame]:
    """All chunks with fresh vectors (only stale ones are computed), and counts and outcome per version."""
    marked = chunk_rows.withColumn("_stale", stale(model, dim))
    counts = marked.groupBy("version_id").agg(F.count("*").alias("total"), F.count_if("_stale").alias("embedded")).withColumn("skipped", F.col("total") - F.col("embedded"))
    counts = counts.withColumn("outcome", F.when(F.col("total") == 0, "EMPTY").when(F.col("embedded") == 0, "UP_TO_DATE").otherwise("EMBEDDED"))
    fresh = U.embed_batch(marked.where("_stale").drop("vector", "_stale"), "content", dim).withColumns({"embedding_model": F.lit(model), "embedding_hash": F.col("content_hash")})
    return marked.where("NOT _stale").drop("_stale").unionByName(fresh), counts


def retrieve(queries: DataFrame, chunk_rows: DataFrame, k: int, model: str | None = None, dim: int | None = None, document: int | None = None, version: int | None = None, pivots: int | None = None) -> DataFrame:
    """queries(query_id, vector) -> query_id, rank, chunk_id, chunk_index, distance, similarity of the k nearest chunks.

    Exact, for any number of queries: they meet the chunks in blocks, and pivots spare blocks that hold none of the k
    (functions.nearest). Stale chunks and those of another model or length are left out; ties go by (chunk_index, chunk_id).
    """
    own = chunk_rows
    if model is not None and dim is not None:
        own = own.where(~stale(model, dim))
    if document is not None:
        own = own.where(F.col("policy_document_id") == document)
    if version is not None:
        own = own.where(F.col("policy_version_id") == version)
    found = nearest(queries, own, k, pivots)
    order = Window.partitionBy("query_id").orderBy("distance", "chunk_index", "chunk_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).withColumn("similarity", 1 - F.col("distance"))


def filter_relevant(hits: DataFrame, queries: DataFrame, least: float = 0.25) -> tuple[DataFrame, DataFrame]:
    """Hits with enough similarity, and a status per query."""
    kept = hits.where(F.col("similarity") >= least)
    counts = kept.groupBy("query_id").agg(F.count("*").alias("n"))
    return kept, queries.select("query_id").join(counts, "query_id", "left").select("query_id", F.when(F.col("n") > 0, "RELEVANT").otherwise("INSUFFICIENT_EVIDENCE").alias("status"))


def version_conflicts(hits: DataFrame) -> DataFrame:
    """P10: hits(query_id, policy_document_id, policy_version_id, status) with two or more ACTIVE versions of one document."""
    active = hits.where("status = 'ACTIVE'").groupBy("query_id", "policy_document_id").agg(F.array_sort(F.collect_set("policy_version_id")).alias("versions"))
    return active.where(F.size("versions") > 1).withColumn("status", F.lit("CONFLICTING_POLICY"))


def exception_facts(exceptions: DataFrame, inv: DataFrame, po: DataFrame, grn: DataFrame, vendors: DataFrame) -> DataFrame:
    """Exceptions with numbers and the name of the order's vendor, else the invoice's."""
    i = inv.select("invoice_id", "invoice_number", F.col("vendor_id").alias("iv"))
    p = po.select(F.col("po_id").alias("purchase_order_id"), "po_number", F.col("vendor_id").alias("pv"))
    g = grn.select(F.col("grn_id").alias("goods_receipt_id"), "grn_number")
    v = vendors.select(F.col("vendor_id").alias("v"), F.col("name").alias("vendor_name"))
    own = exceptions.drop("vendor_id").join(i, "invoice_id", "left").join(p, "purchase_order_id", "left").join(g, "goods_receipt_id", "left")
    return own.withColumn("v", F.coalesce("pv", "iv")).join(v, "v", "left").drop("v", "pv", "iv")


def retrieval_query(kind: Column, message: Column, evidence: Column) -> Column:
    """Words of type, message, the evidence's known entries in order, and the family's words."""
    family = None
    for word, more in FAMILIES:
        test = F.contains(F.upper(F.coalesce(kind, F.lit(""))), F.lit(word))
        family = F.when(test, more) if family is None else family.when(test, more)
    entries = [F.when(F.try_element_at(evidence, F.lit(k)).isNotNull(), F.concat(F.lit(f"{k} "), F.try_element_at(evidence, F.lit(k)))) for k in QUERY_KEYS]
    text = F.concat_ws(" ", F.replace(kind, F.lit("_"), F.lit(" ")), message, *entries, family.otherwise(ANY_FAMILY))
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def check_citations(answers: DataFrame, hits: DataFrame) -> DataFrame:
    """answers(query_id, status, cited array) -> checked status and unknown citations."""
    allowed = hits.groupBy("query_id").agg(F.collect_set("chunk_id").alias("allowed"))  # k ids per query
    own = answers.join(allowed, "query_id", "left").withColumn("unknown", F.array_except("cited", F.coalesce("allowed", F.array().cast("array<bigint>"))))
    bad = (F.size("unknown") > 0) | ((F.col("status") == "SUPPORTED") & (F.size("cited") == 0))
    return own.withColumn("checked", F.when(bad, "INSUFFICIENT_EVIDENCE").otherwise(F.col("status"))).drop("allowed")


def latest_grounding(results: DataFrame) -> DataFrame:
    """The newest result per exception."""
    return results.groupBy("exception_id").agg(F.max_by("result_id", F.struct("created_at", "result_id")).alias("result_id"))
