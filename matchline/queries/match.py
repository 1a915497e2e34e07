"""Three-way match, R1 to R15, and the sinks that follow it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import fixtures as X
from ..operators import reconcile as R
from ..sources import sinks
from ..sources.keyed import KeyedTable
from ..sources.stored import scratch
from .base import query, shared_folder, written


def tables(spark: SparkSession, d: str) -> R.Tables:
    return R.Tables(X.po(spark, d), X.po_line(spark, d), X.grn(spark, d), X.grn_line(spark, d), X.inv(spark, d), X.inv_line(spark, d))


def plain_tables(spark: SparkSession, d: str, keep: Callable[[DataFrame], DataFrame] = written) -> R.Tables:
    """The tables written once, by keep; receipts and invoices derive from the written order lines."""
    lines = keep(X.po_line(spark, d))
    items = keep(X.inv_line(spark, d, lines))
    return R.Tables(X.po(spark, d), lines, X.grn(spark, d), X.grn_line(spark, d, lines), keep(X.inv(spark, d, items)), items)


def written_tables(spark: SparkSession, d: str) -> R.Tables:
    """The tables that a match reads many times, in buckets of their order; all lines derive from the order lines, written for that."""
    with scratch(spark) as held:
        lines = held(X.po_line(spark, d))
        items = X.inv_line(spark, d, lines)
        return R.by_order(R.Tables(X.po(spark, d), lines, X.grn(spark, d), X.grn_line(spark, d, lines), X.inv(spark, d, items), items))


def _brief(drafts: DataFrame) -> DataFrame:
    ids = [F.col(c).cast("string").alias(c) for c in ("po_id", "grn_id", "invoice_id")]
    return drafts.select("exception_type", "severity", "rule", *ids, "fingerprint")


def _fp(*parts: str) -> str:
    return "sha256(" + " || '|' || ".join(p if p.startswith("'") else f"coalesce(({p})::VARCHAR, '')" for p in parts) + ")"


def _draft(kind: str, severity: str, rule: str, parts: list[str], source: str, po: str = "NULL", grn: str = "NULL", invoice: str = "NULL") -> str:
    return f"SELECT '{kind}' AS exception_type, '{severity}' AS severity, {rule if ' ' in rule or '.' in rule else repr(rule)} AS rule, ({po})::VARCHAR AS po_id, ({grn})::VARCHAR AS grn_id, ({invoice})::VARCHAR AS invoice_id, {_fp(repr(kind), *parts)} AS fingerprint FROM {source}"


LINK = """
units AS (SELECT po.po_id, inv.invoice_id FROM po FULL JOIN inv ON po.po_id = inv.po_id),
num AS (SELECT po_id, line_number, count(*) AS n, min(po_line_id) AS pid FROM po_line GROUP BY 1, 2),
glink AS (SELECT g.*, CASE WHEN g.po_line_id IS NOT NULL THEN p.po_line_id WHEN num.n = 1 THEN num.pid END AS linked,
    CASE WHEN g.po_line_id IS NOT NULL AND p.po_line_id IS NULL THEN 'missing_po_line_ref' WHEN g.po_line_id IS NOT NULL OR num.n = 1 THEN 'ok' ELSE 'ambiguous_or_missing_line' END AS link
  FROM grn_line g LEFT JOIN po_line p ON p.po_id = g.po_id AND p.po_line_id = g.po_line_id LEFT JOIN num ON num.po_id = g.po_id AND num.line_number = g.line_number),
ilink AS (SELECT g.*, CASE WHEN g.po_line_id IS NOT NULL THEN p.po_line_id WHEN num.n = 1 THEN num.pid END AS linked,
    CASE WHEN g.po_line_id IS NOT NULL AND p.po_line_id IS NULL THEN 'missing_po_line_ref' WHEN g.po_line_id IS NOT NULL OR num.n = 1 THEN 'ok' ELSE 'ambiguous_or_missing_line' END AS link
  FROM inv_line g LEFT JOIN po_line p ON p.po_id = g.po_id AND p.po_line_id = g.po_line_id LEFT JOIN num ON num.po_id = g.po_id AND num.line_number = g.line_number WHERE g.po_id IS NOT NULL),
rcv AS (SELECT po_id, linked AS po_line_id, sum(received_quantity) AS received, list(grn_line_id ORDER BY grn_line_id) AS ids FROM glink WHERE link = 'ok' GROUP BY 1, 2),
bil AS (SELECT invoice_id, po_id, linked AS po_line_id, sum(quantity) AS invoiced, list(invoice_line_id ORDER BY invoice_line_id) AS ids FROM ilink WHERE link = 'ok' GROUP BY 1, 2, 3),
gcount AS (SELECT po_id, count(*) AS n_grn, min(grn_id) AS one_grn, string_agg(grn_id::VARCHAR, '|' ORDER BY grn_id::VARCHAR) AS grns FROM grn GROUP BY 1),
qty AS (SELECT u.po_id, u.invoice_id, l.po_line_id, l.quantity AS ordered, coalesce(received, 0) AS received, coalesce(invoiced, 0) AS invoiced, n_grn, one_grn
  FROM units u JOIN gcount USING (po_id) JOIN po_line l USING (po_id) LEFT JOIN rcv USING (po_id, po_line_id) LEFT JOIN bil ON bil.invoice_id = u.invoice_id AND bil.po_line_id = l.po_line_id
  WHERE u.invoice_id IS NOT NULL AND (coalesce(received, 0) <> 0 OR coalesce(invoiced, 0) <> 0)),
norm AS (SELECT *, trim(regexp_replace(regexp_replace(lower(trim(invoice_number)), '[\\s_]+', '-', 'g'), '-{2,}', '-', 'g'), '-') AS nn FROM inv),
dup AS (SELECT a.invoice_id, a.po_id, a.vendor_id, a.nn, b.invoice_id AS other_id FROM norm a JOIN norm b ON a.vendor_id = b.vendor_id AND a.nn = b.nn AND a.invoice_id <> b.invoice_id)
"""

QTY = " UNION ALL ".join(
    _draft("QUANTITY_MISMATCH", "HIGH", r, [repr(r), "po_id", "po_line_id", "invoice_id"], f"qty WHERE {a} > {b}", "po_id", "CASE WHEN n_grn = 1 THEN one_grn END", "invoice_id")
    for r, a, b in (("invoiced_gt_received", "invoiced", "received"), ("received_gt_ordered", "received", "ordered"), ("invoiced_gt_ordered", "invoiced", "ordered"))
)
_VARIES = "((e.{0} = 0 AND i.{0} <> 0) OR abs(i.{0} - e.{0}) * 100 > 0 * abs(e.{0}) AND e.{0} <> 0)"
PRICE = _draft("PRICE_MISMATCH", "HIGH", "price", ["i.po_id", "i.linked", "i.invoice_id", "i.invoice_line_id"], f"ilink i JOIN po_line e ON e.po_line_id = i.linked WHERE i.link = 'ok' AND {_VARIES.format('unit_price')}", "i.po_id", invoice="i.invoice_id")
TAX = _draft("TAX_MISMATCH", "MEDIUM", "tax", ["i.po_id", "i.linked", "i.invoice_id", "i.invoice_line_id"], f"ilink i JOIN po_line e ON e.po_line_id = i.linked WHERE i.link = 'ok' AND {_VARIES.format('tax_rate')}", "i.po_id", invoice="i.invoice_id")
G_DATE = _draft("DATE_MISMATCH", "MEDIUM", "grn_before_po", ["'grn_before_po'", "po_id", "grn_id"], "grn JOIN po USING (po_id) WHERE receipt_date < order_date", "po_id", "grn_id")
I_DATE = _draft("DATE_MISMATCH", "MEDIUM", "invoice_before_po", ["'invoice_before_po'", "po.po_id", "invoice_id"], "inv JOIN po ON po.po_id = inv.po_id WHERE invoice_date < order_date", "po.po_id", invoice="invoice_id")
_WHY = {"missing_po_line_ref": "po_line_id", "ambiguous_or_missing_line": "line_number"}
G_LINK = " UNION ALL ".join(_draft("IDENTIFIER_MISMATCH", "HIGH", r, [repr(r), "grn_id", "grn_line_id", c], f"glink WHERE link = '{r}'", "po_id", "grn_id") for r, c in _WHY.items())
I_LINK = " UNION ALL ".join(_draft("IDENTIFIER_MISMATCH", "HIGH", r, [repr(r), "invoice_id", "invoice_line_id", c], f"ilink WHERE link = '{r}'", "po_id", invoice="invoice_id") for r, c in _WHY.items())
DUP = _draft("DUPLICATE_INVOICE", "CRITICAL", "duplicate_invoice", ["vendor_id", "nn", "invoice_id", "other_id"], "dup", "po_id", invoice="invoice_id")
MISSING = " UNION ALL ".join(
    f"SELECT 'MISSING_DOCUMENT' AS exception_type, 'CRITICAL' AS severity, '{r}' AS rule, po_id::VARCHAR AS po_id, (CASE WHEN n_grn = 1 THEN one_grn END)::VARCHAR AS grn_id, invoice_id::VARCHAR AS invoice_id, sha256('MISSING_DOCUMENT|{n}|' || coalesce(po_id::VARCHAR, '') || '|' || coalesce(invoice_id::VARCHAR, '') || coalesce('|' || grns, '')) AS fingerprint FROM units LEFT JOIN gcount USING (po_id) WHERE {w}"
    for r, n, w in (("missing_po", "PO", "po_id IS NULL"), ("missing_invoice", "INVOICE", "invoice_id IS NULL"), ("missing_grn", "GRN", "po_id IS NOT NULL AND invoice_id IS NOT NULL AND grns IS NULL"))
)
IN_UNIT = " UNION ALL ".join((MISSING, DUP, I_DATE, I_LINK, PRICE, TAX, QTY))
ON_ORDER = f"{G_LINK} UNION ALL {G_DATE}"
ALL = f"{LINK}, in_unit AS ({IN_UNIT}), on_order AS ({ON_ORDER})"
FIRST = """SELECT exception_type, severity, rule, po_id, grn_id, invoice_id, fingerprint FROM (SELECT *, row_number() OVER (PARTITION BY fingerprint ORDER BY po_id::BIGINT NULLS LAST, invoice_id::BIGINT NULLS LAST, grn_id::BIGINT NULLS LAST) AS r FROM (SELECT * FROM in_unit UNION ALL SELECT * FROM on_order)) WHERE r = 1"""
RESULTS = """
long AS (SELECT unit, exception_type, sum(n) AS n FROM (
    SELECT coalesce(invoice_id::BIGINT, -po_id::BIGINT - 1) AS unit, exception_type, count(DISTINCT fingerprint) AS n FROM in_unit GROUP BY 1, 2
    UNION ALL SELECT coalesce(u.invoice_id, -u.po_id - 1), o.exception_type, count(*) FROM units u JOIN on_order o ON o.po_id::BIGINT = u.po_id GROUP BY 1, 2) GROUP BY 1, 2),
cnt AS (SELECT unit, string_agg(exception_type || '=' || n::BIGINT, ',' ORDER BY exception_type) AS by_type, sum(n)::BIGINT AS n, bool_or(exception_type = 'MISSING_DOCUMENT') AS incomplete FROM long GROUP BY 1),
res AS (SELECT u.po_id, u.invoice_id, CASE WHEN incomplete THEN 'INCOMPLETE' WHEN coalesce(cnt.n, 0) > 0 THEN 'EXCEPTIONS_FOUND' ELSE 'MATCHED' END AS status, coalesce(cnt.n, 0)::BIGINT AS exception_count, coalesce(by_type, '') AS by_type,
    coalesce(l.n, 0)::BIGINT AS po_line_count, coalesce(n_grn, 0)::BIGINT AS grn_count, coalesce(il.n, 0)::BIGINT AS invoice_line_count, round(coalesce(l.q, 0)::DOUBLE, 4) AS total_ordered, round(coalesce(r.q, 0)::DOUBLE, 4) AS total_received, round(coalesce(b.q, 0)::DOUBLE, 4) AS total_invoiced
FROM units u LEFT JOIN cnt ON cnt.unit = coalesce(u.invoice_id, -u.po_id - 1) LEFT JOIN (SELECT po_id, count(*) AS n, sum(quantity) AS q FROM po_line GROUP BY 1) l ON l.po_id = u.po_id LEFT JOIN gcount ON gcount.po_id = u.po_id
LEFT JOIN (SELECT po_id, sum(received) AS q FROM rcv GROUP BY 1) r ON r.po_id = u.po_id LEFT JOIN (SELECT invoice_id, sum(invoiced) AS q FROM bil GROUP BY 1) b ON b.invoice_id = u.invoice_id LEFT JOIN (SELECT invoice_id, count(*) AS n FROM inv_line GROUP BY 1) il ON il.invoice_id = u.invoice_id)
"""


@query("r1_build_units", f"{LINK} SELECT po_id::VARCHAR AS po_id, invoice_id::VARCHAR AS invoice_id FROM units")
def r1(spark, d):
    return R.build_units(X.po(spark, d), X.inv(spark, d)).select(F.col("po_id").cast("string"), F.col("invoice_id").cast("string"))


@query("r2_link_grn_lines", f"{LINK} SELECT grn_line_id, linked::VARCHAR AS linked, link FROM glink")
def r2_grn(spark, d):
    return R.link_lines(X.grn_line(spark, d), X.po_line(spark, d)).select("grn_line_id", F.col("linked").cast("string"), "link")


@query("r2_link_invoice_lines", f"{LINK} SELECT invoice_line_id, linked::VARCHAR AS linked, link FROM ilink")
def r2_inv(spark, d):
    return R.link_lines(X.inv_line(spark, d).where("po_id IS NOT NULL"), X.po_line(spark, d)).select("invoice_line_id", F.col("linked").cast("string"), "link")


_PAIRS = """pairs AS (SELECT CASE WHEN invoice_id % 3 = 0 THEN src_po_id + 1 ELSE src_po_id END AS want, invoice_id, po_id AS ref FROM inv),
receipts AS (SELECT CASE WHEN grn_id % 4 = 0 THEN po_id + 1 ELSE po_id END AS want, grn_id, CASE WHEN grn_id % 7 <> 0 THEN po_id END AS ref FROM grn)"""


def _mixed_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Every third invoice is asked for with the next order."""
    return X.inv(spark, d).select(F.when(F.col("invoice_id") % 3 == 0, F.col("src_po_id") + 1).otherwise(F.col("src_po_id")).alias("po_id"), "invoice_id")


def _header(label: str, source: str, key: str) -> str:
    ids = {"grn": key} if label == "GRN" else {"invoice": key}
    none = _draft("IDENTIFIER_MISMATCH", "HIGH", "missing_po_header_ref", ["'missing_po_header_ref'", key, "want"], f"{source} WHERE ref IS NULL", "want", **ids)
    return none + " UNION ALL " + _draft("IDENTIFIER_MISMATCH", "HIGH", "po_header_mismatch", ["'po_header_mismatch'", key, "ref", "want"], f"{source} WHERE ref <> want", "want", **ids)


@query("r3_header_exceptions", f"{_PAIRS} {_header('Invoice', 'pairs', 'invoice_id')} UNION ALL {_header('GRN', 'receipts', 'grn_id')}")
def r3(spark, d):
    """Every fourth receipt is asked for with the next order, every seventh names none."""
    grn, i = X.grn(spark, d), F.col("grn_id")
    asked = grn.select(F.when(i % 4 == 0, F.col("po_id") + 1).otherwise(F.col("po_id")).alias("po_id"), "grn_id")
    named = grn.withColumn("po_id", F.when(i % 7 != 0, F.col("po_id")))
    return _brief(R.header_exceptions(_mixed_pairs(spark, d), X.inv(spark, d), "Invoice", "invoice_id").unionByName(R.header_exceptions(asked, named, "GRN", "grn_id")))


@query("r4_received_by_po_line", f"{LINK} SELECT po_id, po_line_id, round(received::DOUBLE, 4) AS received, array_to_string(ids, ',') AS grn_line_ids FROM rcv")
def r4(spark, d):
    got = R.received_by_po_line(R.link_lines(X.grn_line(spark, d), X.po_line(spark, d)))
    return got.select("po_id", "po_line_id", F.round(F.col("received").cast("double"), 4).alias("received"), F.array_join(F.col("grn_line_ids").cast("array<string>"), ",").alias("grn_line_ids"))


@query("r5_invoiced_by_po_line", f"{LINK} SELECT invoice_id, po_line_id, round(invoiced::DOUBLE, 4) AS invoiced, array_to_string(ids, ',') AS invoice_line_ids FROM bil")
def r5(spark, d):
    got = R.invoiced_by_po_line(R.link_lines(X.inv_line(spark, d).where("po_id IS NOT NULL"), X.po_line(spark, d)))
    return got.select("invoice_id", "po_line_id", F.round(F.col("invoiced").cast("double"), 4).alias("invoiced"), F.array_join(F.col("invoice_line_ids").cast("array<string>"), ",").alias("invoice_line_ids"))


@query("r6_quantity_exceptions", f"{LINK} {QTY}")
def r6(spark, d):
    t = tables(spark, d)
    g, i = R.link_lines(t.grn_line, t.po_line), R.link_lines(t.inv_line.where("po_id IS NOT NULL"), t.po_line)
    return _brief(R.quantity_exceptions(R.build_units(t.po, t.inv), t.po_line, t.grn, R.received_by_po_line(g), R.invoiced_by_po_line(i)))


@query("r7_price_exceptions", f"{LINK} {PRICE}")
def r7(spark, d):
    return _brief(R.drafts_of(R.link_lines(X.inv_line(spark, d).where("po_id IS NOT NULL"), X.po_line(spark, d)), [R.price_case()]))


@query("r8_tax_exceptions", f"{LINK} {TAX}")
def r8(spark, d):
    return _brief(R.drafts_of(R.link_lines(X.inv_line(spark, d).where("po_id IS NOT NULL"), X.po_line(spark, d)), [R.tax_case()]))


def _early(spark: SparkSession, d: str) -> DataFrame:
    return R.early_documents(X.po(spark, d), X.grn(spark, d), "grn_id").unionByName(R.early_documents(X.po(spark, d), X.inv(spark, d), "invoice_id"))


@query("r9_date_exceptions", f"{G_DATE} UNION ALL {I_DATE}")
def r9(spark, d):
    return _brief(_early(spark, d))


@query("r10_missing_documents", f"{LINK} {MISSING}")
def r10(spark, d):
    return _brief(R.missing_document_exceptions(R.build_units(X.po(spark, d), X.inv(spark, d)), X.grn(spark, d)))


@query("r11_duplicate_invoices", f"{LINK} {DUP}")
def r11(spark, d):
    return _brief(R.duplicate_invoice_exceptions(X.inv(spark, d)))


@query("r12_dedupe_drafts", f"{LINK}, in_unit AS ({I_DATE} UNION ALL {I_DATE}), on_order AS ({G_DATE}) {FIRST}")
def r12(spark, d):
    drafts = _early(spark, d)
    return _brief(R.dedupe_drafts(drafts.unionByName(drafts)))


@query("r13_r14_unit_results", f"{ALL}, {RESULTS} SELECT * REPLACE (po_id::VARCHAR AS po_id, invoice_id::VARCHAR AS invoice_id) FROM res")
def r13(spark, d):
    _, results = R.reconcile(written_tables(spark, d))
    by_type = F.array_join(F.transform(F.map_entries("by_type"), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))), ",")
    number = lambda c: F.round(F.col(c).cast("double"), 4).alias(c)
    return results.select(F.col("po_id").cast("string"), F.col("invoice_id").cast("string"), "status", "exception_count", by_type.alias("by_type"), "po_line_count", "grn_count", "invoice_line_count", number("total_ordered"), number("total_received"), number("total_invoiced"))


@query("r15_reconcile", f"{ALL} {FIRST}")
def r15(spark, d):
    drafts, _ = R.reconcile(written_tables(spark, d))
    return _brief(drafts)


# Sinks after a match: earlier exceptions are those of the fixture, drafts are date exceptions under half of their fingerprints.

_DRAFTS_SQL = f"""drafts AS (SELECT q.exception_type, q.severity, CASE WHEN inv.invoice_id % 2 = 0 THEN sha256(inv.invoice_id::VARCHAR) ELSE q.fingerprint END AS fingerprint, po.po_id, inv.invoice_id,
    'actual_value=' || inv.invoice_date || ',expected_value=' || order_date AS evidence, po.po_id || ',' || inv.invoice_id AS sources FROM ({I_DATE}) q JOIN inv ON inv.invoice_id = q.invoice_id::BIGINT JOIN po ON po.po_id = inv.po_id)"""


def _drafts(spark: SparkSession, d: str) -> DataFrame:
    early = R.early_documents(X.po(spark, d), X.inv(spark, d), "invoice_id")
    return early.withColumn("fingerprint", F.when(F.col("invoice_id") % 2 == 0, F.sha2(F.col("invoice_id").cast("string"), 256)).otherwise(F.col("fingerprint")))


S5 = f"""{_DRAFTS_SQL} SELECT coalesce(d.fingerprint, e.fingerprint) AS fingerprint, coalesce(d.exception_type, e.exception_type) AS exception_type, coalesce(d.severity, e.severity) AS severity,
    CASE WHEN e.fingerprint IS NULL OR (d.fingerprint IS NOT NULL AND e.status = 'RESOLVED') THEN 'OPEN' ELSE e.status END AS status,
    (CASE WHEN d.fingerprint IS NULL THEN e.purchase_order_id ELSE d.po_id END)::VARCHAR AS purchase_order_id, (CASE WHEN d.fingerprint IS NULL THEN e.goods_receipt_id END)::VARCHAR AS goods_receipt_id,
    (CASE WHEN d.fingerprint IS NULL THEN e.invoice_id ELSE d.invoice_id END)::VARCHAR AS invoice_id, coalesce(d.evidence, 'rule=earlier') AS evidence, coalesce(d.sources, '') AS sources,
    coalesce(d.fingerprint IS NULL AND e.status = 'RESOLVED', false) AS resolved FROM exceptions e FULL JOIN drafts d ON d.fingerprint = e.fingerprint"""


@query("s5_upsert_exceptions", S5)
def s5(spark, d):
    return _exception_rows(sinks.upsert_exceptions(_old_exceptions(spark, d), _drafts(spark, d)))


def _old_exceptions(spark: SparkSession, d: str) -> DataFrame:
    return X.exceptions(spark, d).withColumns({"resolved_at": F.when(F.col("status") == "RESOLVED", F.col("created_at")), "message": F.lit(""), "evidence": F.create_map(F.lit("rule"), F.lit("earlier"))})


def _exception_rows(new: DataFrame) -> DataFrame:
    ids = [F.col(c).cast("string").alias(c) for c in ("purchase_order_id", "goods_receipt_id", "invoice_id")]
    evidence = F.array_join(F.transform(F.array_sort(F.map_entries("evidence")), lambda e: F.concat_ws("=", e["key"], e["value"])), ",")
    return new.select("fingerprint", "exception_type", "severity", "status", *ids, evidence.alias("evidence"), F.coalesce(F.array_join("source_document_ids", ","), F.lit("")).alias("sources"), F.col("resolved_at").isNotNull().alias("resolved"))


@query("s5_stored_exceptions", S5)
def s5_stored(spark, d):
    """The same on a stored table: the drafts come in two runs and once more, each rewriting its buckets only."""
    table = KeyedTable(spark, shared_folder(spark, "exceptions"), ["fingerprint"], 32)
    table.change(_old_exceptions(spark, d), lambda old, new: new.withColumn("source_document_ids", F.lit(None).cast("array<string>")))
    drafts = written(_drafts(spark, d))
    for part in (drafts.where("invoice_id % 3 = 0"), drafts.where("invoice_id % 3 <> 0"), drafts.where("invoice_id % 3 = 0")):
        sinks.store_exceptions(table, part)
    return _exception_rows(table.read())


@query("s8_apply_invoice_outcome", f"""{ALL}, {RESULTS}
SELECT inv.invoice_id, CASE res.status WHEN 'MATCHED' THEN 'MATCHED' WHEN 'EXCEPTIONS_FOUND' THEN 'EXCEPTION' ELSE 'RECEIVED' END AS status FROM inv LEFT JOIN res ON res.invoice_id = inv.invoice_id""")
def s8(spark, d):
    t = written_tables(spark, d)
    _, results = R.reconcile(t)
    return sinks.apply_invoice_outcome(t.all_inv(), results).select("invoice_id", "status")


@query(
    "s9_check_intake_links",
    """l AS (SELECT n.*, CASE WHEN invoice_id % 230 < 10 THEN -vendor_id ELSE vendor_id END AS vendor_id FROM inv_line n JOIN (SELECT invoice_id, vendor_id FROM inv) USING (invoice_id))
    SELECT invoice_line_id AS line_id, violation FROM (SELECT invoice_line_id, CASE WHEN v.vendor_id IS NULL THEN 'missing_vendor' WHEN l.po_id IS NULL THEN 'no_order' WHEN l.po_line_id IS NULL THEN NULL WHEN p.po_id IS NULL THEN 'missing_order_line' WHEN p.po_id <> l.po_id THEN 'other_order' END AS violation
    FROM l LEFT JOIN po_line p ON p.po_line_id = l.po_line_id LEFT JOIN vendors v ON v.vendor_id = l.vendor_id) WHERE violation IS NOT NULL""",
)
def s9(spark, d):
    """Of 23 orders' invoices those of one name a vendor that doesn't exist."""
    head = X.inv(spark, d).select("invoice_id", F.when(F.col("invoice_id") % 230 < 10, -F.col("vendor_id")).otherwise(F.col("vendor_id")).alias("vendor_id"))
    lines = X.inv_line(spark, d).withColumnRenamed("invoice_line_id", "line_id").join(head, "invoice_id")
    return sinks.check_intake_links(lines, X.po_line(spark, d), X.vendors(spark, d)).select("line_id", "violation")
