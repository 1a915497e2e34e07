"""Document texts to candidates, D1 to D17, over invoice texts written from the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import fixtures as X
from ..operators import documents as D
from .base import query, written


def texts(spark: SparkSession, d: str) -> DataFrame:
    """One text per invoice: labelled head and item lines; by invoice_id div 10 % 6: plain, without a number, number 'N/A', two numbers, stacked columns, empty."""
    item = F.struct("line_number", "invoice_line_id", F.concat(F.lit("Item L"), F.col("line_number").cast("string"), F.lit(" "), F.col("quantity").cast("decimal(18,2)").cast("string"), F.lit(" "), F.col("unit_price").cast("decimal(18,2)").cast("string")).alias("t"), F.concat_ws("\n", F.concat(F.lit("Item L"), F.col("line_number").cast("string")), F.col("quantity").cast("decimal(18,2)").cast("string"), F.col("unit_price").cast("decimal(18,2)").cast("string")).alias("s"))
    items = X.inv_line(spark, d).groupBy("invoice_id").agg(F.array_sort(F.collect_list(item)).alias("items"))
    own = X.inv(spark, d).join(items, "invoice_id", "left").join(X.vendors(spark, d), "vendor_id", "left")
    v, number = F.floor(F.col("invoice_id") / 10).cast("long") % 6, F.trim("invoice_number")
    label = F.when(v == 1, "").when(v == 2, "Invoice Number: N/A\n").when(v == 3, F.concat(F.lit("Invoice Number: A-"), F.col("invoice_id").cast("string"), F.lit(" / B-"), F.col("invoice_id").cast("string"), F.lit("\n"))).otherwise(F.concat(F.lit("Invoice Number: "), number, F.lit("\n")))
    head = F.concat(label, F.lit("Vendor: "), "name", F.lit("\nInvoice Date: "), F.col("invoice_date").cast("string"), F.lit("\nCurrency: USD\n"))
    lines = F.array_join(F.transform("items", lambda x: x["t"]), "\n")
    stacked = F.concat(F.lit("Description\nQty\nUnit Price\n"), F.array_join(F.transform("items", lambda x: x["s"]), "\n"))
    text = F.when(v == 5, "").when(v == 4, F.concat(head, F.coalesce(stacked, F.lit("")))).otherwise(F.concat(head, F.coalesce(lines, F.lit(""))))
    return own.select(F.col("invoice_id").alias("doc_id"), F.lit("scan.pdf").alias("filename"), F.lit(None).cast("string").alias("declared_type"), text.alias("full_text"), v.alias("variant"), F.when(F.col("items").isNull(), 0).otherwise(F.size("items")).alias("n_items")).repartition(4 * spark.sparkContext.defaultParallelism)  # few bytes, but long work on each row


def read(spark: SparkSession, d: str) -> DataFrame:
    """The texts with their labelled fields and stacked rows, written once for all that is derived from them."""
    return written(D.labelled_fields(texts(spark, d)))


_T = "t AS (SELECT invoice_id AS doc_id, (invoice_id // 10) % 6 AS v, trim(invoice_number) AS number, vendor_id, name, invoice_date, coalesce(n, 0) AS n FROM inv LEFT JOIN vendors USING (vendor_id) LEFT JOIN (SELECT invoice_id, count(*) AS n FROM inv_line GROUP BY 1) USING (invoice_id))"
_TYPE = "CASE WHEN v = 5 THEN 'UNKNOWN' ELSE 'INVOICE' END"
_OUTCOME = "CASE WHEN v = 3 OR v = 5 THEN 'REVIEW_REQUIRED' WHEN v IN (1, 2) OR n = 0 THEN 'VALIDATION_FAILED' ELSE 'READY_FOR_RECONCILIATION' END"


@query("d1_classify", f"{_T} SELECT doc_id, {_TYPE} AS detected_type FROM t")
def d1(spark, d):
    return D.classify(D.labelled_fields(texts(spark, d))).select("doc_id", "detected_type")


@query("d2_labelled_fields", f"{_T} SELECT doc_id, CASE WHEN v IN (0, 4) THEN number END AS invoice_number, CASE WHEN v <> 5 THEN name END AS vendor_name, CASE WHEN v <> 5 THEN invoice_date::VARCHAR END AS invoice_date, v = 3 AS ambiguous FROM t")
def d2(spark, d):
    read = D.labelled_fields(texts(spark, d))
    get = lambda k: F.try_element_at("fields", F.lit(k)).alias(k)
    return read.select("doc_id", get("invoice_number"), get("vendor_name"), get("invoice_date"), (F.size("ambiguous") > 0).alias("ambiguous"))


@query("d3_table_lines", "SELECT invoice_id AS doc_id, count(*) FILTER (invoice_line_id % 5 <> 0) AS n, round(sum(quantity::DOUBLE) FILTER (invoice_line_id % 5 <> 0), 4) AS quantity FROM inv_line GROUP BY 1 HAVING count(*) FILTER (invoice_line_id % 5 <> 0) > 0")
def d3(spark, d):
    empty = F.col("invoice_line_id") % 5 == 0
    rows = X.inv_line(spark, d).groupBy(F.col("invoice_id").alias("doc_id")).agg(F.collect_list(F.array(F.lit("x"), F.when(empty, "-").otherwise(F.col("quantity").cast("string")), F.when(empty, "").otherwise(F.concat(F.lit("$"), F.col("unit_price").cast("string"))))).alias("rows"))
    tables = rows.select("doc_id", F.array(F.struct(F.array(F.lit("Item"), F.lit(" Qty "), F.lit("Unit Price")).alias("headers"), "rows")).alias("tables"))
    total = F.aggregate("table_lines", F.lit(0.0), lambda a, x: a + x["quantity"].cast("double"))
    return D.table_lines(tables).select("doc_id", F.size("table_lines").cast("long").alias("n"), F.round(total, 4).alias("quantity"))


@query("d4_stacked_lines", f"{_T} SELECT doc_id, CASE WHEN v = 4 THEN n ELSE 0 END AS n_lines FROM t")
def d4(spark, d):
    return D.labelled_fields(texts(spark, d)).select("doc_id", F.size(D.stacked_lines()).cast("long").alias("n_lines"))


@query("d5_text_lines", f"{_T} SELECT doc_id, CASE WHEN v < 4 THEN n ELSE 0 END AS n_lines FROM t")
def d5(spark, d):
    return texts(spark, d).select("doc_id", F.size(D.text_lines()).cast("long").alias("n_lines"))


@query("d6_build_candidates", f"{_T} SELECT doc_id, CASE WHEN v IN (0, 4) THEN number END AS invoice_number, CASE WHEN v <> 5 THEN invoice_date END AS doc_date, CASE WHEN v = 5 THEN 0 ELSE n END AS n_lines, round(CASE WHEN v = 5 THEN 0 ELSE coalesce(q, 0) END, 2) AS quantity FROM t LEFT JOIN (SELECT invoice_id, sum(quantity::DECIMAL(18,2))::DOUBLE AS q FROM inv_line GROUP BY 1) s ON s.invoice_id = doc_id")
def d6(spark, d):
    c = D.build_candidates(D.classify(read(spark, d)))
    own = c.withColumn("doc_date", F.coalesce("doc_date", F.lit(None).cast("date")))
    total = F.aggregate("lines", F.lit(0.0), lambda a, x: a + F.coalesce(x["quantity"].cast("double"), F.lit(0.0)))
    return own.select("doc_id", "invoice_number", "doc_date", F.size("lines").cast("long").alias("n_lines"), F.round(total, 2).alias("quantity"))


_KINDS = r"""body AS (SELECT po_id, string_agg('Part L' || line_number || ' ' || quantity::DECIMAL(18,2) || ' ' || unit_price::DECIMAL(18,2), chr(10) ORDER BY seq) AS body FROM po_line GROUP BY 1),
txt AS (SELECT po_id * 100 + 1 AS doc_id, 'PURCHASE ORDER' || chr(10) || CASE WHEN po_id % 5 = 0 THEN '' ELSE 'PO Number: ' || po_number || chr(10) END || 'Supplier: ' || coalesce(name, '') || chr(10) || 'Order Date: ' || order_date
    || CASE WHEN po_id % 7 = 0 THEN ' or 2031-01-01' ELSE '' END || chr(10) || 'Currency: USD' || chr(10) || coalesce(body, '') AS text FROM po LEFT JOIN body USING (po_id) LEFT JOIN vendors USING (vendor_id)
  UNION ALL SELECT grn_id * 100 + 2, 'GOODS RECEIPT NOTE' || chr(10) || 'GRN Number: ' || grn_number || chr(10) || 'Receipt Date: ' || receipt_date || chr(10) || CASE WHEN grn_id % 2 = 0 THEN coalesce(body, '') ELSE 'Received: ' || grn_id % 90 + 1 || '.5' END FROM grn LEFT JOIN body USING (po_id)),
rd AS (SELECT doc_id, text, CASE WHEN starts_with(text, 'GOODS') THEN 'GRN' ELSE 'PO' END AS detected_type, nullif(regexp_extract(text, '(?:PO|GRN) Number: (\S+)', 1), '') AS number, contains(text, ' or ') AS twice,
    regexp_extract(text, '(?:Order|Receipt) Date: (\S+)', 1)::DATE AS stated, regexp_extract_all(text, 'Part L\d+ ([0-9.]+) [0-9.]+', 1) AS qs, nullif(regexp_extract(text, 'Received: ([0-9.]+)', 1), '') AS single FROM txt)"""


def other_texts(spark: SparkSession, d: str) -> DataFrame:
    """A text per order and per receipt; some orders without a number or with two dates, half of the receipts with one labelled quantity."""
    number = lambda c: F.col(c).cast("decimal(18,2)").cast("string")
    part = F.concat(F.lit("Part L"), F.col("line_number").cast("string"), F.lit(" "), number("quantity"), F.lit(" "), number("unit_price"))
    lines = written(X.po_line(spark, d)).groupBy("po_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", part.alias("t")))), lambda x: x["t"]), "\n").alias("body"))
    body, orders = F.coalesce("body", F.lit("")), X.po(spark, d).join(X.vendors(spark, d), "vendor_id", "left").join(lines, "po_id", "left")
    label = F.when(F.col("po_id") % 5 != 0, F.concat(F.lit("PO Number: "), "po_number", F.lit("\n"))).otherwise("")
    order = F.concat(F.lit("PURCHASE ORDER\n"), label, F.lit("Supplier: "), F.coalesce("name", F.lit("")), F.lit("\nOrder Date: "), F.col("order_date").cast("string"), F.when(F.col("po_id") % 7 == 0, " or 2031-01-01").otherwise(""), F.lit("\nCurrency: USD\n"), body)
    single = F.concat(F.lit("Received: "), (F.col("grn_id") % 90 + 1).cast("string"), F.lit(".5"))
    receipt = F.concat(F.lit("GOODS RECEIPT NOTE\nGRN Number: "), "grn_number", F.lit("\nReceipt Date: "), F.col("receipt_date").cast("string"), F.lit("\n"), F.when(F.col("grn_id") % 2 == 0, body).otherwise(single))
    rows = orders.select((F.col("po_id") * 100 + 1).alias("doc_id"), F.lit("purchase_order.pdf").alias("filename"), order.alias("full_text"))
    rows = rows.unionByName(X.grn(spark, d).join(lines, "po_id", "left").select((F.col("grn_id") * 100 + 2).alias("doc_id"), F.lit("scan.pdf").alias("filename"), receipt.alias("full_text")))
    return rows.withColumn("declared_type", F.lit(None).cast("string")).repartition(4 * spark.sparkContext.defaultParallelism)


@query(
    "d6_orders_and_receipts",
    f"""{_KINDS} SELECT doc_id, detected_type, number, CASE WHEN NOT twice THEN stated END AS doc_date, CASE WHEN single IS NOT NULL THEN 1 ELSE len(qs) END::BIGINT AS n_lines,
    CASE WHEN single IS NOT NULL THEN single::DOUBLE ELSE round(coalesce(list_sum(qs::DOUBLE[]), 0), 2) END AS quantity, (CASE WHEN twice THEN 1 ELSE 0 END)::BIGINT AS n_low,
    (CASE WHEN single IS NOT NULL THEN 1 ELSE 2 * len(qs) END)::BIGINT AS n_medium, (CASE WHEN number IS NULL THEN 0 ELSE 1 END + CASE WHEN detected_type = 'PO' THEN CASE WHEN twice THEN 2 ELSE 3 END ELSE 1 END)::BIGINT AS n_high,
    CASE WHEN twice THEN 'REVIEW_REQUIRED' WHEN number IS NULL OR (single IS NULL AND len(qs) = 0) THEN 'VALIDATION_FAILED' ELSE 'READY_FOR_RECONCILIATION' END AS outcome FROM rd""",
)
def d6_kinds(spark, d):
    c = D.understand(other_texts(spark, d))
    number = F.when(F.col("detected_type") == "GRN", F.col("grn_number")).otherwise(F.col("po_number"))
    total = F.aggregate("lines", F.lit(0.0), lambda a, x: a + F.coalesce(x["quantity"].cast("double"), F.lit(0.0)))
    sure = lambda level: F.size(F.filter("evidence", lambda e: e["confidence"] == level)).cast("long").alias(f"n_{level.lower()}")
    return c.select("doc_id", "detected_type", number.alias("number"), "doc_date", F.size("lines").cast("long").alias("n_lines"), F.round(total, 2).alias("quantity"), sure("LOW"), sure("MEDIUM"), sure("HIGH"), "outcome")


@query("d7_validate_candidates", f"{_T} SELECT doc_id, concat_ws(',', CASE WHEN v = 5 THEN 'UNKNOWN_OR_EMPTY' END, CASE WHEN v IN (1, 2, 3) THEN 'MISSING_INVOICE_NUMBER' END, CASE WHEN v <> 5 AND n = 0 THEN 'MISSING_LINES' END, CASE WHEN v = 3 THEN 'AMBIGUOUS_FIELD' END) AS codes FROM t")
def d7(spark, d):
    c = D.understand(read(spark, d))
    return c.select("doc_id", F.array_join(F.transform("issues", lambda i: i["code"]), ",").alias("codes"))


@query("d8_outcome", f"{_T} SELECT doc_id, {_OUTCOME} AS outcome FROM t")
def d8(spark, d):
    return D.understand(read(spark, d)).select("doc_id", "outcome")


@query("d9_route_reviews", f"{_T} SELECT doc_id, CASE WHEN v = 5 THEN 'HIGH' ELSE 'MEDIUM' END AS priority FROM t WHERE v IN (3, 5) AND doc_id % 20 <> 0")
def d9(spark, d):
    docs = read(spark, d)
    return D.route_reviews(D.understand(docs), docs.where("doc_id % 20 = 0")).select("doc_id", "priority")


#: Corrections of every document, in order; what holds and what doesn't is in the SQL below.
_CHANGES = (
    ("invoice_number", "first"), ("invoice_number", None), ("total_amount", "not a number"), ("lines[0].quantity", "5"), ("lines[0].quantity", "-5"), ("currency", "EURO!"), ("vendor_name", "  "), ("total_amount", "(7)"),
    ("doc_date", "31/01/24"), ("lines[99].quantity", "1"), ("lines[0].reference", "R1"), ("lines[0].line_number", "0"), ("tax_amount", "12.50"), ("tax_amount", ""), ("colour", "red"), ("invoice_date", "2024-02-29"),
)


@query(
    "d10_apply_corrections",
    f"""{_T} SELECT doc_id, CASE WHEN v <> 5 THEN 'FIX-' || doc_id END AS invoice_number, CASE WHEN v <> 5 THEN DATE '2024-02-29' END AS doc_date, CASE WHEN v <> 5 THEN 12.5 END::DOUBLE AS tax_amount,
    CASE WHEN v <> 5 AND n > 0 THEN 5 END::DOUBLE AS quantity, CASE WHEN v <> 5 AND n > 0 THEN 'R1' END AS reference,
    CASE WHEN v IN (3, 5) THEN 'REVIEW_REQUIRED' WHEN n = 0 THEN 'VALIDATION_FAILED' ELSE 'READY_FOR_RECONCILIATION' END AS outcome,
    CASE WHEN v = 5 THEN '1,2,3,4,5,6,7,8,9,10,11,12,13,14,15,16' WHEN n = 0 THEN '3,4,5,6,7,8,9,10,11,12,14,15' ELSE '3,5,6,7,8,9,10,12,14,15' END AS rejected FROM t""",
)
def d10(spark, d):
    docs = read(spark, d)
    value = lambda v: F.concat(F.lit("FIX-"), F.col("doc_id").cast("string")) if v is None else F.lit(v)
    changes = docs.select("doc_id", F.explode(F.array(*(F.struct(F.lit(i).alias("seq"), F.lit(p).alias("field_path"), value(v).alias("value")) for i, (p, v) in enumerate(_CHANGES, 1)))).alias("e")).select("doc_id", "e.*")
    understood = written(D.understand(docs).drop("issues", "is_valid", "requires_review", "outcome", "full_text", "fields", "evidence"))
    fixed, rejected = D.apply_corrections(understood, changes)
    refused = rejected.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("seq")), lambda x: x.cast("string")), ",").alias("rejected"))
    first = F.get("lines", F.lit(0))
    own = D.outcome(D.validate_candidates(fixed)).join(refused, "doc_id", "left")
    return own.select("doc_id", "invoice_number", "doc_date", F.col("tax_amount").cast("double").alias("tax_amount"), first["quantity"].cast("double").alias("quantity"), first["reference"].alias("reference"), "outcome", "rejected")


@query("d11_promotable", f"{_T} SELECT doc_id FROM t WHERE v IN (0, 4) AND n > 0 AND doc_id % 4 = 0")
def d11(spark, d):
    docs = read(spark, d)
    tasks = docs.select("doc_id", F.when(F.col("doc_id") % 4 == 0, "APPROVED").otherwise("PENDING").alias("status"))
    return D.promotable(D.understand(docs), tasks).select("doc_id")


@query("d12_promote", f"""{_T}, ln AS (SELECT doc_id, j + CASE WHEN v = 0 THEN 4 ELSE 0 END AS line_number FROM t, generate_series(1, n) g(j) WHERE v IN (0, 4)),
lk AS (SELECT doc_id, count(*) AS n_linked FROM ln WHERE EXISTS (SELECT 1 FROM po_line p WHERE p.po_id = doc_id // 10 AND p.line_number = ln.line_number) GROUP BY 1),
st AS (SELECT *, CASE WHEN v IN (0, 4) THEN number END AS own, CASE WHEN v NOT IN (0, 4) THEN 'no_number' WHEN (doc_id // 10) % 5 = 0 THEN 'reused' WHEN n = 0 THEN 'no_lines' ELSE 'new' END AS state FROM t)
SELECT doc_id, state, CASE WHEN state IN ('new', 'reused') THEN own END AS number, (CASE WHEN state = 'new' THEN vendor_id END)::VARCHAR AS vendor_id, CASE WHEN state = 'new' THEN n ELSE 0 END AS n_lines, CASE WHEN state = 'new' THEN coalesce(n_linked, 0) ELSE 0 END AS n_linked FROM st LEFT JOIN lk USING (doc_id)""")
def d12(spark, d):
    """Documents are linked to their order; the invoices of every fifth order are there already."""
    inv = X.inv(spark, d)
    own = D.understand(read(spark, d)).withColumn("purchase_order_id", F.floor(F.col("doc_id") / 10).cast("long"))
    there = inv.where("src_po_id % 5 = 0").withColumn("invoice_number", F.trim("invoice_number"))
    out = D.promote(written(own), X.vendors(spark, d), X.po(spark, d), X.po_line(spark, d), X.grn(spark, d), there)
    lines = out.lines.groupBy("doc_id").agg(F.count("*").alias("n_lines"), F.count("po_line_id").alias("n_linked"))
    zero, none = F.lit(0).cast("long"), F.lit(None).cast("string")
    rows = out.heads.join(lines, "doc_id").select("doc_id", F.lit("new").alias("state"), "number", F.col("vendor_id").cast("string").alias("vendor_id"), "n_lines", "n_linked")
    rows = rows.unionByName(out.reused.select("doc_id", F.lit("reused").alias("state"), "number", none.alias("vendor_id"), zero.alias("n_lines"), zero.alias("n_linked")))
    return rows.unionByName(out.rejected.select("doc_id", F.col("reason").alias("state"), none.alias("number"), none.alias("vendor_id"), zero.alias("n_lines"), zero.alias("n_linked")))


@query("d13_compare_candidates", """SELECT invoice_id AS doc_id, 'total_amount' AS path, CASE WHEN invoice_id % 6 = 0 THEN 'a_only' WHEN invoice_id % 4 = 0 THEN 'disagreement' ELSE 'agreement' END AS result, invoice_id % 6 <> 0 AND invoice_id % 4 = 0 AS financial FROM inv
UNION ALL SELECT invoice_id, 'lines.count', 'disagreement', true FROM inv WHERE invoice_id % 5 = 0 UNION ALL SELECT invoice_id, 'lines[0].line_number', 'agreement', false FROM inv
UNION ALL SELECT invoice_id, 'lines[0].description', 'disagreement', false FROM inv UNION ALL SELECT invoice_id, 'doc_date', CASE WHEN invoice_id % 3 = 0 THEN 'a_only' ELSE 'agreement' END, false FROM inv
UNION ALL SELECT invoice_id, 'currency', 'missing', false FROM inv UNION ALL SELECT invoice_id, 'invoice_number', 'b_only', false FROM inv""")
def d13(spark, d):
    inv, i = X.inv(spark, d), F.col("invoice_id")
    side = lambda **v: inv.select(i.alias("doc_id"), F.explode(F.array(*(F.struct(F.lit(p.replace("0_", "[0].").replace("lines_", "lines.")).alias("path"), x.cast("string").alias("value")) for p, x in v.items()))).alias("e")).select("doc_id", "e.*")
    a = side(total_amount=F.col("total_amount"), lines_count=F.lit("2"), lines0_line_number=F.lit("1"), lines0_description=F.lit("Bolt"), doc_date=F.col("invoice_date"), currency=F.lit(" "))
    wrong = F.concat(F.lit("$ "), (F.col("total_amount") + F.when(i % 4 == 0, 1).otherwise(0)).cast("string"))
    b = side(total_amount=F.when(i % 6 != 0, wrong), lines_count=F.when(i % 5 == 0, "3").otherwise("2"), lines0_line_number=F.lit("01"), lines0_description=F.lit("Nut"), doc_date=F.when(i % 3 == 0, " ").otherwise(F.col("invoice_date").cast("string")), invoice_number=F.lit("X"))
    return D.compare_candidates(a, b).select("doc_id", "path", "result", "financial")


def _grounded(spark: SparkSession, d: str) -> DataFrame:
    docs = written(texts(spark, d).join(X.inv(spark, d).select(F.col("invoice_id").alias("doc_id"), "invoice_date"), "doc_id").select("doc_id", "full_text", "invoice_date"))
    even, day = F.col("doc_id") % 2 == 0, F.col("invoice_date").cast("string")
    found = F.struct(F.lit("invoice_date").alias("path"), F.when(even, F.concat(F.lit("invoice  DATE "), day)).otherwise("no such value").alias("value"))
    cited = F.struct(F.lit("lines[0].tax_rate").alias("path"), F.lit("invoicedate").alias("value"))
    values = docs.select("doc_id", F.explode(F.array(found, cited, F.struct(F.lit("grn_number").alias("path"), F.lit(" ").alias("value")))).alias("e")).select("doc_id", "e.*")
    snippet = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("Date: "), day)).otherwise("not there")
    return D.grounded_values(values, docs, docs.select("doc_id", F.lit("tax_rate").alias("field_name"), snippet.alias("snippet")))


@query("d14_grounded_values", f"{_T} SELECT doc_id, 'invoice_date' AS path, doc_id % 2 = 0 AND v <> 5 AS grounded, false AS has_evidence FROM t UNION ALL SELECT doc_id, 'lines[0].tax_rate', false, true FROM t")
def d14(spark, d):
    return _grounded(spark, d)


@query("d14_unsupported_fields", f"{_T} SELECT doc_id, CASE WHEN doc_id % 2 = 0 AND v <> 5 THEN 'lines[0].tax_rate' ELSE 'invoice_date,lines[0].tax_rate' END AS unsupported, false AS is_grounded FROM t")
def d14_unsupported(spark, d):
    return D.unsupported_fields(_grounded(spark, d)).withColumn("unsupported", F.array_join("unsupported", ","))


def _checks(spark, d):
    i = F.col("invoice_id")
    return X.inv(spark, d).select(i.alias("doc_id"), F.when(i % 50 == 0, "timeout").alias("provider_error"), (i % 7 != 0).alias("structured_valid"), F.when(i % 11 == 0, F.array(F.lit("x"))).otherwise(F.array().cast("array<string>")).alias("unsupported"), (i % 13 != 0).alias("business_ok"), F.when(i % 17 == 0, 1).otherwise(0).alias("financial_disagreements"), (i % 3).alias("one_sided"), (i % 11 != 0).alias("grounded"), (i % 13 == 0).alias("hard_errors"))


_VERDICT = "CASE WHEN invoice_id % 50 = 0 OR invoice_id % 7 = 0 OR invoice_id % 11 = 0 OR invoice_id % 13 = 0 OR invoice_id % 17 = 0 THEN 'REVIEW_REQUIRED' WHEN invoice_id % 3 > 0 THEN 'MEDIUM' ELSE 'HIGH' END"


@query("d15_quality_verdict", f"SELECT invoice_id AS doc_id, {_VERDICT} AS quality FROM inv")
def d15(spark, d):
    return D.quality_verdict(_checks(spark, d)).select("doc_id", "quality")


@query("d16_needs_assist", f"{_T} SELECT doc_id, NOT (v IN (0, 4) AND n > 0) AS assist, CASE WHEN v IN (0, 4) AND n > 0 THEN '' ELSE concat_ws(',', 'outcome:' || {_OUTCOME}, CASE WHEN v = 5 THEN 'type:UNKNOWN' END, CASE WHEN v IN (3, 5) THEN 'requires_review' END, CASE WHEN v = 5 THEN 'issue:UNKNOWN_OR_EMPTY' END, CASE WHEN v IN (1, 2, 3) THEN 'issue:MISSING_INVOICE_NUMBER' END, CASE WHEN v <> 5 AND n = 0 THEN 'issue:MISSING_LINES' END, CASE WHEN v = 5 OR n = 0 THEN 'no_lines' END) END AS reasons FROM t")
def d16(spark, d):
    return D.needs_assist(D.understand(read(spark, d))).withColumn("reasons", F.array_join("reasons", ","))


@query("d17_assist_status", f"SELECT invoice_id AS doc_id, CASE WHEN invoice_id % 11 = 0 THEN 'EVIDENCE_FAILED' WHEN invoice_id % 13 = 0 THEN 'VALIDATION_FAILED' WHEN invoice_id % 17 = 0 THEN 'DISAGREEMENT' ELSE 'INVOKED' END AS state, CASE WHEN invoice_id % 17 = 0 OR invoice_id % 11 = 0 THEN 'HIGH' WHEN {_VERDICT} = 'HIGH' THEN 'LOW' ELSE 'MEDIUM' END AS priority FROM inv")
def d17(spark, d):
    return D.assist_status(D.quality_verdict(_checks(spark, d))).select("doc_id", "state", "priority")
