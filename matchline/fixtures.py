"""Procurement tables derived from the star-schema test tables by integer arithmetic on keys.

Each table is one projection or equi-join of the source, so it grows with it. SQL holds the same recipes for DuckDB.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

QTY = "decimal(18,4)"
RATE = "decimal(8,4)"


def _read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _pick(index: Column, values: tuple[str, ...]) -> Column:
    return F.element_at(F.array(*(F.lit(v) for v in values)), (index + 1).cast("int"))


def vendors(spark: SparkSession, d: str) -> DataFrame:
    return _read(spark, d, "customer").select(F.col("c_custkey").alias("vendor_id"), F.col("c_name").alias("name"))


def po(spark: SparkSession, d: str) -> DataFrame:
    return _read(spark, d, "orders").select(
        F.col("o_orderkey").alias("po_id"),
        F.concat(F.lit("PO-"), F.lpad(F.col("o_orderkey").cast("string"), 8, "0")).alias("po_number"),
        F.col("o_custkey").alias("vendor_id"),
        F.to_date("o_orderdate").alias("order_date"),
        F.lit("USD").alias("currency"),
    )


def po_line(spark: SparkSession, d: str) -> DataFrame:
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_quantity", "l_extendedprice", "l_discount", "l_tax")
    lines = _read(spark, d, "lineitem").withColumn("seq", F.row_number().over(order).cast("long"))
    return lines.select(
        (F.col("l_orderkey") * 1000 + F.col("seq")).alias("po_line_id"),
        F.col("l_orderkey").alias("po_id"),
        "seq",
        F.col("l_linenumber").cast("long").alias("line_number"),
        F.col("l_quantity").cast(QTY).alias("quantity"),
        F.col("l_extendedprice").cast(QTY).alias("unit_price"),
        F.col("l_tax").cast(RATE).alias("tax_rate"),
    )


def grn(spark: SparkSession, d: str) -> DataFrame:
    k = F.explode(F.array(F.lit(0), F.lit(1))).alias("k")
    return po(spark, d).where("po_id % 11 <> 0").select("po_id", "po_number", "order_date", k).select(
        (F.col("po_id") * 10 + F.col("k")).alias("grn_id"),
        F.concat(F.lit("GRN-"), F.lpad(F.col("po_id").cast("string"), 8, "0"), F.lit("-"), F.col("k").cast("string")).alias("grn_number"),
        "po_id",
        F.date_add("order_date", (F.col("po_id") % 45 - 3 + 5 * F.col("k")).cast("int")).alias("receipt_date"),
    )


def _link(h: Column, line: Column) -> Column:
    return F.when(h % 29 == 0, -line).when(h % 6 != 0, line)


def grn_line(spark: SparkSession, d: str, lines: DataFrame | None = None) -> DataFrame:
    """lines: po_line, where it is at hand."""
    h = F.col("po_id") + F.col("seq")
    share = F.when(h % 7 == 0, F.lit("1.1").cast(RATE)).when(h % 5 == 0, F.lit("0.5").cast(RATE)).otherwise(F.lit("1.0").cast(RATE))
    return (lines if lines is not None else po_line(spark, d)).where("po_id % 11 <> 0").select(
        (F.col("po_line_id") * 10 + 1).alias("grn_line_id"),
        (F.col("po_id") * 10 + F.col("seq") % 2).alias("grn_id"),
        "po_id",
        "line_number",
        (F.col("quantity") * share).cast(QTY).alias("received_quantity"),
        _link(h, F.col("po_line_id")).alias("po_line_id"),
    )


def inv_line(spark: SparkSession, d: str, lines: DataFrame | None = None) -> DataFrame:
    """Lines carry src_po_id, their order, and po_id, the invoice's own reference (null for some). lines: po_line, where it is at hand."""
    h = F.col("po_id") + F.col("seq")
    rate = lambda x: F.lit(x).cast(RATE)
    q = F.when(h % 16 == 0, rate("1.07")).when(h % 16 == 4, rate("1.20")).when(h % 16 == 8, rate("1.30")).when(h % 16 == 12, rate("1.60")).otherwise(rate("1"))
    p = F.when(h % 10 == 0, rate("1.06")).when(h % 10 == 1, rate("1.12")).when(h % 10 == 2, rate("1.30")).when(h % 10 == 3, rate("1.60")).when(h % 10 == 4, rate("0.97")).otherwise(rate("1"))
    k = F.explode(F.when(F.col("po_id") % 17 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("k")
    link = F.when(F.col("po_id") % 19 == 0, None).when(h % 31 == 0, -F.col("po_line_id")).when(h % 6 != 0, F.col("po_line_id"))
    return (lines if lines is not None else po_line(spark, d)).where("po_id % 13 <> 0").select("*", k).select(
        (F.col("po_line_id") * 10 + F.col("k")).alias("invoice_line_id"),
        (F.col("po_id") * 10 + F.col("k")).alias("invoice_id"),
        F.col("po_id").alias("src_po_id"),
        F.when(F.col("po_id") % 19 != 0, F.col("po_id")).alias("po_id"),
        "line_number",
        (F.col("quantity") * q).cast(QTY).alias("quantity"),
        (F.col("unit_price") * p).cast(QTY).alias("unit_price"),
        (F.col("tax_rate") + F.when(h % 9 == 0, rate("0.01")).otherwise(rate("0"))).cast(RATE).alias("tax_rate"),
        link.alias("po_line_id"),
    )


def inv(spark: SparkSession, d: str, items: DataFrame | None = None) -> DataFrame:
    """items: inv_line, where it is at hand."""
    k = F.explode(F.when(F.col("po_id") % 17 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("k")
    totals = (items if items is not None else inv_line(spark, d)).groupBy("invoice_id").agg(F.sum((F.col("quantity") * F.col("unit_price")).cast(QTY)).cast(QTY).alias("total"))
    head = po(spark, d).where("po_id % 13 <> 0").select("*", k)
    number = F.lpad(F.col("po_id").cast("string"), 8, "0")
    return head.select(
        (F.col("po_id") * 10 + F.col("k")).alias("invoice_id"),
        F.col("po_id").alias("src_po_id"),
        F.when(F.col("k") == 0, F.concat(F.lit("INV-"), number)).otherwise(F.concat(F.lit(" inv_"), number, F.lit(" "))).alias("invoice_number"),
        "vendor_id",
        F.when(F.col("po_id") % 19 != 0, F.col("po_id")).alias("po_id"),
        F.date_add("order_date", (F.col("po_id") % 50 - 2).cast("int")).alias("invoice_date"),
        "currency",
        F.lit("RECEIVED").alias("status"),
    ).join(totals, "invoice_id", "left").withColumn("total_amount", F.coalesce("total", F.lit(0).cast(QTY))).drop("total")


EXCEPTION_TYPES = ("QUANTITY_MISMATCH", "PRICE_MISMATCH", "TAX_MISMATCH", "IDENTIFIER_MISMATCH", "DUPLICATE_INVOICE", "DATE_MISMATCH", "MISSING_DOCUMENT")
SEVERITIES = ("LOW", "MEDIUM", "HIGH", "CRITICAL")
EXCEPTION_STATUSES = ("OPEN", "IN_REVIEW", "RESOLVED", "DISMISSED")
SIGNAL_TYPES = ("PRICE_VARIANCE", "QUANTITY_VARIANCE", "DUPLICATE_INVOICE", "TIMING_ANOMALY", "VENDOR_SPIKE", "REPEATED_MISMATCH")
DOCUMENT_STATUSES = ("UPLOADED", "VALIDATED", "EXTRACTION_PENDING", "EXTRACTING", "EXTRACTED", "NORMALIZED", "READY_FOR_RECONCILIATION", "EXTRACTION_FAILED", "VALIDATION_FAILED", "REVIEW_REQUIRED", "REVIEW_REJECTED")
REVIEW_STATUSES = ("PENDING", "IN_REVIEW", "APPROVED", "CORRECTED", "REJECTED")
PRIORITIES = ("LOW", "MEDIUM", "HIGH")


def _instant(day: Column | str, seconds: Column) -> Column:
    return F.timestamp_seconds(F.unix_timestamp(F.col(day) if isinstance(day, str) else day) + seconds)


def exceptions(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("invoice_id")
    tens = F.floor(i / 10).cast("long")
    return inv(spark, d).select(
        i.alias("exception_id"),
        _pick(i % 7, EXCEPTION_TYPES).alias("exception_type"),
        _pick(i % 4, SEVERITIES).alias("severity"),
        _pick(tens % 4, EXCEPTION_STATUSES).alias("status"),
        i.alias("invoice_id"),
        F.col("po_id").alias("purchase_order_id"),
        F.when(i % 3 != 0, F.col("src_po_id") * 10).alias("goods_receipt_id"),
        _instant("invoice_date", i % 86400).alias("created_at"),
        F.sha2(i.cast("string"), 256).alias("fingerprint"),
        "vendor_id",
    )


def signals(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("invoice_id")
    return inv(spark, d).select(
        i.alias("signal_id"),
        _pick(F.floor(i / 10).cast("long") % 6, SIGNAL_TYPES).alias("anomaly_type"),
        _pick(F.floor(i / 60).cast("long") % 4, SEVERITIES).alias("severity"),
        "vendor_id",
        "po_id",
        i.alias("invoice_id"),
        _instant("invoice_date", i % 86400).alias("detected_at"),
        F.sha2(i.cast("string"), 256).alias("fingerprint"),
    )


def profiles(spark: SparkSession, d: str) -> DataFrame:
    score = F.floor(F.col("invoice_id") / 10).cast("long") % 101
    return inv(spark, d).select(
        F.col("invoice_id").alias("profile_id"),
        F.lit("VENDOR").alias("entity_type"),
        F.col("vendor_id").alias("entity_id"),
        score.alias("score"),
        F.when(score >= 75, "CRITICAL").when(score >= 50, "HIGH").when(score >= 25, "MEDIUM").otherwise("LOW").alias("risk_band"),
        F.lit("v1").alias("score_version"),
        F.col("invoice_date").alias("as_of"),
        _instant("invoice_date", F.col("invoice_id") % 86400).alias("calculated_at"),
        F.sha2(F.col("invoice_id").cast("string"), 256).alias("fingerprint"),
    )


def files(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("doc_id")
    n = i.cast("string")
    name = _pick_col(i % 5, [F.concat(F.lit("invoice-"), n, F.lit(".pdf")), F.concat(F.lit("purchase-order-"), n, F.lit(".pdf")), F.concat(F.lit("grn-"), n, F.lit(".xlsx")), F.lit("../x.png"), F.lit("notes.txt")])
    mime = _pick(i % 5, ("application/pdf", "application/pdf; charset=binary", "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet", "image/jpeg", "text/plain"))
    return _read(spark, d, "documents").select(
        i.alias("document_id"),
        name.alias("filename"),
        mime.alias("content_type"),
        F.col("text").alias("content"),
        _pick(i % 11, DOCUMENT_STATUSES).alias("status"),
        F.timestamp_seconds(F.lit(1704067200) + i * 60).alias("created_at"),
    )


def _pick_col(index: Column, values: list[Column]) -> Column:
    return F.element_at(F.array(*values), (index + 1).cast("int"))


def reviews(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("document_id")
    return files(spark, d).where("document_id % 3 = 0").select(
        i.alias("task_id"),
        "document_id",
        "filename",
        _pick(F.floor(i / 3).cast("long") % 5, REVIEW_STATUSES).alias("status"),
        _pick(i % 3, PRIORITIES).alias("priority"),
        "created_at",
    )


def history(spark: SparkSession, d: str) -> DataFrame:
    e = F.col("event_type")
    status = F.when(e == "view", "PENDING").when(e == "click", "IN_REVIEW").when(e == "purchase", "APPROVED").when(e == "signup", "CORRECTED").when(e == "error", "REJECTED")
    return _read(spark, d, "events").select(F.col("user_id").alias("entity_id"), "event_id", "ts", status.alias("status"))


ACTION_STATUSES = ("PENDING", "APPROVED", "REJECTED", "EXECUTING", "COMPLETED", "FAILED", "CANCELLED")


def actions(spark: SparkSession, d: str) -> DataFrame:
    order = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).cast("long")
    return _read(spark, d, "events").select(
        F.col("event_id").alias("action_id"), F.col("user_id").alias("plan_id"), order.alias("action_order"), _pick(F.col("event_id") % 7, ACTION_STATUSES).alias("status"), "ts"
    )


def chunks(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("vec_id")
    return _read(spark, d, "embeddings").select(
        i.alias("chunk_id"),
        F.col("embedding").alias("embedding"),
        F.col("label").cast("long").alias("policy_document_id"),
        (F.col("label") * 10 + i % 2).cast("long").alias("policy_version_id"),
        F.when(i % 5 != 0, "ACTIVE").otherwise("DRAFT").alias("status"),
        F.when(i % 7 != 0, "m1").otherwise("m0").alias("model"),
        (i % 11 == 0).alias("stale"),
        i.alias("chunk_index"),
    )


def _sql_pick(index: str, values: tuple[str, ...]) -> str:
    return f"([{', '.join(repr(v) for v in values)}])[({index}) + 1]"


#: CTEs of the same tables for DuckDB. Any of them may go unused.
SQL = f"""
vendors AS (SELECT c_custkey AS vendor_id, c_name AS name FROM customer),
po AS (SELECT o_orderkey AS po_id, 'PO-' || lpad(o_orderkey::VARCHAR, 8, '0') AS po_number, o_custkey AS vendor_id, o_orderdate::DATE AS order_date, 'USD' AS currency FROM orders),
po_line AS (SELECT l_orderkey * 1000 + seq AS po_line_id, l_orderkey AS po_id, seq, l_linenumber::BIGINT AS line_number, l_quantity::DECIMAL(18,4) AS quantity, l_extendedprice::DECIMAL(18,4) AS unit_price, l_tax::DECIMAL(8,4) AS tax_rate
  FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_quantity, l_extendedprice, l_discount, l_tax) AS seq FROM lineitem)),
grn AS (SELECT po_id * 10 + k AS grn_id, 'GRN-' || lpad(po_id::VARCHAR, 8, '0') || '-' || k AS grn_number, po_id, (order_date + (po_id % 45 - 3 + 5 * k)::INT)::DATE AS receipt_date
  FROM po CROSS JOIN (VALUES (0), (1)) t(k) WHERE po_id % 11 <> 0),
grn_line AS (SELECT po_line_id * 10 + 1 AS grn_line_id, po_id * 10 + seq % 2 AS grn_id, po_id, line_number,
    (quantity * CASE WHEN (po_id + seq) % 7 = 0 THEN 1.1 WHEN (po_id + seq) % 5 = 0 THEN 0.5 ELSE 1.0 END)::DECIMAL(18,4) AS received_quantity,
    CASE WHEN (po_id + seq) % 29 = 0 THEN -po_line_id WHEN (po_id + seq) % 6 <> 0 THEN po_line_id END AS po_line_id
  FROM po_line WHERE po_id % 11 <> 0),
inv_line AS (SELECT po_line_id * 10 + k AS invoice_line_id, po_id * 10 + k AS invoice_id, po_id AS src_po_id, CASE WHEN po_id % 19 <> 0 THEN po_id END AS po_id, line_number,
    (quantity * CASE (po_id + seq) % 16 WHEN 0 THEN 1.07 WHEN 4 THEN 1.20 WHEN 8 THEN 1.30 WHEN 12 THEN 1.60 ELSE 1.00 END)::DECIMAL(18,4) AS quantity,
    (unit_price * CASE (po_id + seq) % 10 WHEN 0 THEN 1.06 WHEN 1 THEN 1.12 WHEN 2 THEN 1.30 WHEN 3 THEN 1.60 WHEN 4 THEN 0.97 ELSE 1.00 END)::DECIMAL(18,4) AS unit_price,
    (tax_rate + CASE WHEN (po_id + seq) % 9 = 0 THEN 0.01 ELSE 0.00 END)::DECIMAL(8,4) AS tax_rate,
    CASE WHEN po_id % 19 = 0 THEN NULL WHEN (po_id + seq) % 31 = 0 THEN -po_line_id WHEN (po_id + seq) % 6 <> 0 THEN po_line_id END AS po_line_id
  FROM po_line CROSS JOIN (VALUES (0), (1)) t(k) WHERE po_id % 13 <> 0 AND (k = 0 OR po_id % 17 = 0)),
inv AS (SELECT po_id * 10 + k AS invoice_id, po_id AS src_po_id, CASE WHEN k = 0 THEN 'INV-' || lpad(po_id::VARCHAR, 8, '0') ELSE ' inv_' || lpad(po_id::VARCHAR, 8, '0') || ' ' END AS invoice_number, vendor_id,
    CASE WHEN po_id % 19 <> 0 THEN po_id END AS po_id, (order_date + (po_id % 50 - 2)::INT)::DATE AS invoice_date, currency, 'RECEIVED' AS status, coalesce(total, 0)::DECIMAL(18,4) AS total_amount
  FROM po CROSS JOIN (VALUES (0), (1)) t(k) LEFT JOIN (SELECT invoice_id, sum((quantity * unit_price)::DECIMAL(18,4)) AS total FROM inv_line GROUP BY 1) s ON s.invoice_id = po_id * 10 + k
  WHERE po_id % 13 <> 0 AND (k = 0 OR po_id % 17 = 0)),
exceptions AS (SELECT invoice_id AS exception_id, {_sql_pick("invoice_id % 7", EXCEPTION_TYPES)} AS exception_type, {_sql_pick("invoice_id % 4", SEVERITIES)} AS severity, {_sql_pick("(invoice_id // 10) % 4", EXCEPTION_STATUSES)} AS status,
    invoice_id, po_id AS purchase_order_id, CASE WHEN invoice_id % 3 <> 0 THEN src_po_id * 10 END AS goods_receipt_id, invoice_date::TIMESTAMP + to_seconds(invoice_id % 86400) AS created_at, sha256(invoice_id::VARCHAR) AS fingerprint, vendor_id FROM inv),
signals AS (SELECT invoice_id AS signal_id, {_sql_pick("(invoice_id // 10) % 6", SIGNAL_TYPES)} AS anomaly_type, {_sql_pick("(invoice_id // 60) % 4", SEVERITIES)} AS severity, vendor_id, po_id, invoice_id,
    invoice_date::TIMESTAMP + to_seconds(invoice_id % 86400) AS detected_at, sha256(invoice_id::VARCHAR) AS fingerprint FROM inv),
profiles AS (SELECT *, CASE WHEN score >= 75 THEN 'CRITICAL' WHEN score >= 50 THEN 'HIGH' WHEN score >= 25 THEN 'MEDIUM' ELSE 'LOW' END AS risk_band FROM (SELECT invoice_id AS profile_id, 'VENDOR' AS entity_type, vendor_id AS entity_id, (invoice_id // 10) % 101 AS score, 'v1' AS score_version,
    invoice_date AS as_of, invoice_date::TIMESTAMP + to_seconds(invoice_id % 86400) AS calculated_at, sha256(invoice_id::VARCHAR) AS fingerprint FROM inv)),
files AS (SELECT doc_id AS document_id, (['invoice-' || doc_id || '.pdf', 'purchase-order-' || doc_id || '.pdf', 'grn-' || doc_id || '.xlsx', '../x.png', 'notes.txt'])[doc_id % 5 + 1] AS filename,
    {_sql_pick("doc_id % 5", ("application/pdf", "application/pdf; charset=binary", "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet", "image/jpeg", "text/plain"))} AS content_type,
    text AS content, {_sql_pick("doc_id % 11", DOCUMENT_STATUSES)} AS status, make_timestamp((1704067200 + doc_id * 60) * 1000000) AS created_at FROM documents),
reviews AS (SELECT document_id AS task_id, document_id, filename, {_sql_pick("(document_id // 3) % 5", REVIEW_STATUSES)} AS status, {_sql_pick("document_id % 3", PRIORITIES)} AS priority, created_at FROM files WHERE document_id % 3 = 0),
history AS (SELECT user_id AS entity_id, event_id, ts, CASE event_type WHEN 'view' THEN 'PENDING' WHEN 'click' THEN 'IN_REVIEW' WHEN 'purchase' THEN 'APPROVED' WHEN 'signup' THEN 'CORRECTED' WHEN 'error' THEN 'REJECTED' END AS status FROM events),
actions AS (SELECT event_id AS action_id, user_id AS plan_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS action_order, {_sql_pick("event_id % 7", ACTION_STATUSES)} AS status, ts FROM events),
chunks AS (SELECT vec_id AS chunk_id, embedding, label::BIGINT AS policy_document_id, (label * 10 + vec_id % 2)::BIGINT AS policy_version_id, CASE WHEN vec_id % 5 <> 0 THEN 'ACTIVE' ELSE 'DRAFT' END AS status,
    CASE WHEN vec_id % 7 <> 0 THEN 'm1' ELSE 'm0' END AS model, vec_id % 11 = 0 AS stale, vec_id AS chunk_index FROM embeddings)
"""
