"""Policy text base and retrieval, P1 to P14."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import fixtures as X
from ..operators import policy as P
from ..functions import helpers as U
from .base import query, written


def markdown(spark: SparkSession, d: str) -> DataFrame:
    """Documents with a title, and every third line a numbered heading."""
    lines = F.split(F.coalesce("text", F.lit("")), "\n")
    headed = F.transform(lines, lambda x, i: F.when(i % 3 == 2, F.concat(F.lit("## "), (i + 1).cast("string"), F.lit(". "), F.lit("Part"))).when(i % 3 == 1, F.concat(x, F.lit("\n"))).otherwise(x))
    return spark.read.parquet(f"{d}/documents.parquet").select("doc_id", F.concat(F.lit("# "), "source", F.lit("\n\n"), F.array_join(headed, "\n")).alias("text"))


def vectors(spark: SparkSession, d: str) -> DataFrame:
    own = X.chunks(spark, d)
    return own.select(
        "chunk_id", "chunk_index", "policy_document_id", "policy_version_id", "status", F.col("embedding").alias("vector"), F.col("model").alias("embedding_model"),
        F.lit("h").alias("content_hash"), F.when(F.col("stale"), "old").otherwise("h").alias("embedding_hash"),
    )


def _queries(spark: SparkSession, d: str) -> DataFrame:
    """Every hundredth vector, as the stated query set."""
    return spark.read.parquet(f"{d}/embeddings.parquet").where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))


@query("p1_sections")
def p1(spark, d):
    return P.sections(markdown(spark, d)).select("doc_id", "place", "section_id", "section_title", "n_blocks")


@query("p2_chunks")
def p2(spark, d):
    return P.chunks(markdown(spark, d), 500).select("doc_id", "chunk_index", "section_id", "content_hash")


@query("p3_ingest_versions", "SELECT doc_id AS version_id, CASE WHEN trim(coalesce(text, '')) = '' THEN 'EMPTY' WHEN doc_id % 3 = 0 THEN 'ALREADY_INGESTED' WHEN doc_id % 3 = 1 THEN 'CONFLICT' ELSE 'INGESTED' END AS outcome FROM documents")
def p3(spark, d):
    docs = spark.read.parquet(f"{d}/documents.parquet").select(F.col("doc_id").alias("version_id"), "text")
    old = docs.where("version_id % 3 < 2").select("version_id", F.when(F.col("version_id") % 3 == 0, F.sha2("text", 256)).otherwise("x").alias("source_hash"), F.lit(1).alias("n_chunks"))
    outcome, _ = P.ingest_versions(old, docs)
    return outcome.select("version_id", "outcome")


_VERSIONS = "versions AS (SELECT doc_id AS version_id, doc_id // 4 AS document_id, CASE WHEN doc_id % 5 = 0 THEN ' ' ELSE 'v' || doc_id % 3 END AS label, CASE WHEN doc_id % 7 = 0 THEN 'short' ELSE sha256(doc_id::VARCHAR) END AS source_hash, DATE '2024-01-10' AS effective_from, DATE '2024-01-01' + (doc_id % 20)::INT AS effective_to FROM documents)"


@query("p4_check_versions", f"{_VERSIONS} SELECT version_id, 'dates' AS violation FROM versions WHERE effective_to < effective_from UNION ALL SELECT version_id, 'label' FROM versions WHERE trim(label) = '' UNION ALL SELECT version_id, 'hash' FROM versions WHERE length(source_hash) <> 64 UNION ALL SELECT version_id, 'label_repeated' FROM versions WHERE (document_id, label) IN (SELECT (document_id, label) FROM versions GROUP BY document_id, label HAVING count(*) > 1)")
def p4(spark, d):
    i = F.col("doc_id")
    own = spark.read.parquet(f"{d}/documents.parquet").select(
        i.alias("version_id"), F.floor(i / 4).cast("long").alias("document_id"), F.when(i % 5 == 0, " ").otherwise(F.concat(F.lit("v"), (i % 3).cast("string"))).alias("label"),
        F.when(i % 7 == 0, "short").otherwise(F.sha2(i.cast("string"), 256)).alias("source_hash"), F.lit(datetime.date(2024, 1, 10)).alias("effective_from"), F.date_add(F.lit(datetime.date(2024, 1, 1)), (i % 20).cast("int")).alias("effective_to"),
    )
    return P.check_versions(own)


def _embed_sql(name: str, source: str) -> str:
    """CTEs ending in {name}(text, p, v): the embeddings, in 64 places, of source(text)."""
    at = "(('0x' || substr(hx, {0}, {1}))::INT)"
    return f"""{name}_d AS (SELECT DISTINCT coalesce(text, '') AS text FROM {source}), {name}_t AS (SELECT text, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS tok FROM {name}_d),
{name}_h AS (SELECT text, sha256(tok) AS hx, count(*) AS n FROM {name}_t GROUP BY 1, 2),
{name}_e AS (SELECT text, {at.format("4 * j + 1", 4)} % 64 AS p, (n * (1 - 2 * ({at.format("17 + 2 * j", 2)} % 2)))::DOUBLE AS v FROM {name}_h, (SELECT unnest(range(4)) AS j)
  UNION ALL SELECT text, j, {at.format("2 * j + 1", 2)} / 255.0::DOUBLE - 0.5 FROM (SELECT text, sha256(text) AS hx FROM {name}_d WHERE NOT regexp_matches(lower(text), '[a-z0-9]')), (SELECT unnest(range(32)) AS j)),
{name}_s AS (SELECT text, p, sum(v) AS v FROM {name}_e GROUP BY 1, 2), {name} AS (SELECT text, p, v / nullif(sqrt(sum(v * v) OVER (PARTITION BY text)), 0) AS v FROM {name}_s)"""


@query("p5_embed_hash", f"{_embed_sql('emb', 'documents')} SELECT doc_id, p::INTEGER AS place, round(v::FLOAT::DOUBLE, 5) AS value FROM documents JOIN emb ON emb.text = coalesce(documents.text, '') WHERE abs(v) > 0.000001")
def p5(spark, d):
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text")
    rows = U.embed_batch(docs, "text", 64).select("doc_id", F.posexplode("vector").alias("place", "v"))
    return rows.where(F.abs("v") > 0.000001).select("doc_id", "place", F.round(F.col("v").cast("double"), 5).alias("value"))


_STALE = "model <> 'm1' OR stale"


@query("p6_stale_chunks", f"SELECT chunk_id FROM chunks WHERE {_STALE}")
def p6(spark, d):
    return P.stale_chunks(vectors(spark, d), "m1", 64).select("chunk_id")


@query("p7_embed_versions", f"""{_embed_sql("emb", "(SELECT 'chunk ' || chunk_id AS text FROM chunks)")}, v AS (SELECT policy_version_id AS version_id, count(*) AS total, count(*) FILTER ({_STALE}) AS embedded, count(*) FILTER (NOT ({_STALE})) AS skipped FROM chunks GROUP BY 1)
SELECT c.chunk_id, version_id, total, embedded, skipped, CASE WHEN embedded = 0 THEN 'UP_TO_DATE' ELSE 'EMBEDDED' END AS outcome, 'm1' AS embedding_model, {_STALE} AS fresh, CASE WHEN NOT ({_STALE}) THEN round(list_sum(embedding::DOUBLE[]), 3) + 0.0 END AS kept_sum,
  CASE WHEN {_STALE} THEN round(w, 3) + 0.0 END AS fresh_sum FROM chunks c JOIN v ON v.version_id = c.policy_version_id JOIN (SELECT text, sum(v * (p + 1)) AS w FROM emb GROUP BY 1) f ON f.text = 'chunk ' || c.chunk_id""")
def p7(spark, d):
    """Every chunk with its version's counts: kept vectors by their sum, new ones by the sum of value times place."""
    own = vectors(spark, d).withColumn("version_id", F.col("policy_version_id")).withColumn("content", F.concat(F.lit("chunk "), F.col("chunk_id").cast("string")))
    own = own.withColumn("was_stale", P.stale("m1", 64))
    all_, counts = P.embed_versions(own, "m1", 64)
    fold = lambda f: F.aggregate("vector", F.lit(0.0), lambda a, x: a + f(x.cast("double")))
    weighed = F.aggregate(F.transform("vector", lambda x, i: x.cast("double") * (i + 1)), F.lit(0.0), lambda a, x: a + x)
    kept, fresh = F.when(~F.col("was_stale"), F.round(fold(lambda x: x), 3) + 0.0), F.when(F.col("was_stale"), F.round(weighed, 3) + 0.0)
    return all_.join(counts, "version_id").select("chunk_id", "version_id", "total", "embedded", "skipped", "outcome", "embedding_model", F.col("was_stale").alias("fresh"), kept.alias("kept_sum"), fresh.alias("fresh_sum"))


_TOP = """q AS (SELECT vec_id AS query_id, embedding AS v FROM embeddings WHERE vec_id % 100 = 0),
dist AS (SELECT query_id, chunk_id, chunk_index, policy_document_id, policy_version_id, status, 1 - greatest(-1, least(1, list_cosine_similarity(v::DOUBLE[], embedding::DOUBLE[]))) AS distance FROM q CROSS JOIN chunks WHERE model = 'm1' AND NOT stale),
top AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, chunk_index, chunk_id) AS rank FROM dist QUALIFY rank <= 5)"""


def _hits(spark: SparkSession, d: str) -> DataFrame:
    return P.retrieve(_queries(spark, d), vectors(spark, d), 5, "m1", 64)


@query("p8_retrieve", f"{_TOP} SELECT query_id, rank, chunk_id, round(distance, 5) + 0.0 AS distance FROM top")
def p8(spark, d):
    return _hits(spark, d).select("query_id", F.col("rank").cast("long").alias("rank"), "chunk_id", (F.round("distance", 5) + 0.0).alias("distance"))


@query("p9_filter_relevant", f"{_TOP} SELECT query_id, CASE WHEN count(*) FILTER (1 - distance >= 0.9) > 0 THEN 'RELEVANT' ELSE 'INSUFFICIENT_EVIDENCE' END AS status FROM top GROUP BY 1")
def p9(spark, d):
    _, status = P.filter_relevant(_hits(spark, d), _queries(spark, d), 0.9)
    return status


@query("p10_version_conflicts", f"{_TOP} SELECT query_id, policy_document_id, string_agg(DISTINCT policy_version_id::VARCHAR, ',' ORDER BY policy_version_id::VARCHAR) AS versions FROM top WHERE status = 'ACTIVE' GROUP BY 1, 2 HAVING count(DISTINCT policy_version_id) > 1")
def p10(spark, d):
    meta = X.chunks(spark, d).select("chunk_id", "policy_document_id", "policy_version_id", "status")
    found = P.version_conflicts(_hits(spark, d).join(meta, "chunk_id"))
    return found.select("query_id", "policy_document_id", F.array_join(F.array_sort(F.col("versions").cast("array<string>")), ",").alias("versions"))


@query("p11_exception_facts", "SELECT exception_id, invoice_number, po_number, grn_number, name AS vendor_name FROM exceptions e LEFT JOIN inv USING (invoice_id) LEFT JOIN po ON po.po_id = e.purchase_order_id LEFT JOIN grn ON grn.grn_id = e.goods_receipt_id LEFT JOIN vendors ON vendors.vendor_id = coalesce(po.vendor_id, inv.vendor_id)")
def p11(spark, d):
    return P.exception_facts(X.exceptions(spark, d), X.inv(spark, d), X.po(spark, d), X.grn(spark, d), X.vendors(spark, d)).select("exception_id", "invoice_number", "po_number", "grn_number", "vendor_name")


_P12 = "SELECT exception_id, replace(exception_type, '_', ' ') || ' a message rule r' || exception_id % 3 || CASE WHEN exception_id % 2 = 0 THEN ' tolerance 5' ELSE '' END || ' ' || CASE WHEN exception_type LIKE '%PRICE%' THEN 'procurement price tolerance approval unit price variance PO vs invoice' WHEN exception_type LIKE '%QUANTITY%' THEN 'quantity tolerance over-delivery goods receipt invoice matching' WHEN exception_type LIKE '%TAX%' THEN 'tax rate discrepancy invoice purchase order tolerance' ELSE 'procurement policy reconciliation exception approval' END AS query FROM exceptions"


def _asked(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("exception_id")
    evidence = F.create_map(F.lit("other"), F.lit("x"), F.lit("tolerance"), F.when(i % 2 == 0, "5"), F.lit("rule"), F.concat(F.lit("r"), (i % 3).cast("string")))
    return X.exceptions(spark, d).select("exception_id", P.retrieval_query(F.col("exception_type"), F.lit("a   message"), evidence).alias("query"))


@query("p12_retrieval_query", _P12)
def p12(spark, d):
    return _asked(spark, d)


@query(
    "p8_retrieve_for_exceptions",
    f"""asked AS ({_P12}), {_embed_sql("emb", "(SELECT query AS text FROM asked)")}, ql AS (SELECT text, list(coalesce(v, 0) ORDER BY p) AS v FROM (SELECT DISTINCT text FROM emb) CROSS JOIN (SELECT unnest(range(64)) AS p) LEFT JOIN emb USING (text, p) GROUP BY 1),
    dist AS (SELECT text, chunk_id, chunk_index, 1 - greatest(-1, least(1, list_cosine_similarity(v::DOUBLE[], embedding::DOUBLE[]))) AS distance FROM ql CROSS JOIN chunks WHERE model = 'm1' AND NOT stale),
    top AS (SELECT *, row_number() OVER (PARTITION BY text ORDER BY distance, chunk_index, chunk_id) AS rank FROM dist QUALIFY rank <= 3)
    SELECT exception_id, rank, chunk_id, round(distance, 4) + 0.0 AS distance FROM asked JOIN top ON top.text = asked.query""",
)
def p8_exceptions(spark, d):
    """Every exception's query text, embedded, against all chunks; equal texts are one query."""
    asked = written(_asked(spark, d))
    texts = asked.select("query").distinct().select(F.xxhash64("query").alias("query_id"), "query")
    hits = P.retrieve(U.embed_batch(texts, "query", 64), vectors(spark, d), 3, "m1", 64)
    named = asked.select("exception_id", F.xxhash64("query").alias("query_id")).join(hits, "query_id")
    return named.select("exception_id", F.col("rank").cast("long").alias("rank"), "chunk_id", (F.round("distance", 4) + 0.0).alias("distance"))


@query("p13_check_citations", f"{_TOP}, ans AS (SELECT query_id, CASE (query_id // 100) % 3 WHEN 0 THEN [query_id] WHEN 1 THEN [-1]::BIGINT[] ELSE []::BIGINT[] END AS cited FROM q), ok AS (SELECT query_id, list(chunk_id) AS allowed FROM top GROUP BY 1) SELECT query_id, CASE WHEN len(cited) = 0 OR NOT list_has_all(allowed, cited) THEN 'INSUFFICIENT_EVIDENCE' ELSE 'SUPPORTED' END AS checked FROM ans JOIN ok USING (query_id)")
def p13(spark, d):
    turn = F.floor(F.col("query_id") / 100).cast("long") % 3
    cited = F.when(turn == 0, F.array("query_id")).when(turn == 1, F.array(F.lit(-1).cast("long"))).otherwise(F.array().cast("array<bigint>"))
    answers = _queries(spark, d).select("query_id", F.lit("SUPPORTED").alias("status"), cited.alias("cited"))
    return P.check_citations(answers, _hits(spark, d)).select("query_id", "checked")


@query("p14_latest_grounding", "SELECT vendor_id AS exception_id, arg_max(exception_id, (created_at, exception_id)) AS result_id FROM exceptions GROUP BY 1")
def p14(spark, d):
    return P.latest_grounding(X.exceptions(spark, d).select(F.col("vendor_id").alias("exception_id"), F.col("exception_id").alias("result_id"), "created_at"))
