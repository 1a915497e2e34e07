"""Risk scores (K1 to K8), summaries and work lists."""

from __future__ import annotations

import datetime
import functools

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import fixtures as X
from ..operators import reads as W
from ..operators import risk as K
from ..sources import sinks
from .base import query, written

AS_OF = datetime.date(2001, 6, 30)
KINDS, LEVELS = X.SIGNAL_TYPES, X.SEVERITIES


def _vendor_entities(spark: SparkSession, d: str) -> DataFrame:
    return X.vendors(spark, d).select(F.lit("VENDOR").alias("entity_type"), F.col("vendor_id").alias("entity_id"))


_case = lambda c, values: f"CASE {c} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in values.items()) + " END"
K1 = f"k1 AS (SELECT * FROM signals WHERE detected_at < TIMESTAMP '{AS_OF}' + INTERVAL 1 DAY)"
K2 = f"""{K1}, k2 AS (SELECT 'VENDOR' AS entity_type, vendor_id AS entity_id, anomaly_type, severity, detected_at, signal_id, fingerprint FROM k1 WHERE vendor_id IS NOT NULL
  UNION ALL SELECT 'INVOICE', invoice_id, anomaly_type, severity, detected_at, signal_id, fingerprint FROM k1 WHERE invoice_id IS NOT NULL UNION ALL SELECT 'PURCHASE_ORDER', po_id, anomaly_type, severity, detected_at, signal_id, fingerprint FROM k1 WHERE po_id IS NOT NULL)"""
K3 = f"""{K2}, days AS (SELECT *, greatest(date_diff('day', detected_at::DATE, DATE '{AS_OF}'), 0) AS n FROM k2),
k3 AS (SELECT *, round(({_case("anomaly_type", {k: w for k, (w, _) in K.WEIGHTS.items()})} * {_case("severity", {"LOW": "0.25", "MEDIUM": "0.50", "HIGH": "0.75", "CRITICAL": "1.00"})} * CASE WHEN n <= 30 THEN 1.00 WHEN n <= 90 THEN 0.75 WHEN n <= 180 THEN 0.50 ELSE 0.25 END)::DECIMAL(18,6), 4)::DECIMAL(18,4) AS contribution FROM days)"""
K4 = f"{K3}, k4 AS (SELECT entity_type, entity_id, anomaly_type, sum(contribution) AS raw, count(*) AS signal_count, least(sum(contribution), {_case('anomaly_type', {k: c for k, (_, c) in K.WEIGHTS.items()})}) AS capped FROM k3 GROUP BY 1, 2, 3)"
K5 = f"""{K4}, sc AS (SELECT entity_type, entity_id, sum(capped) AS agg, sum(signal_count)::BIGINT AS signal_count FROM k4 GROUP BY 1, 2),
pr AS (SELECT entity_type, entity_id, string_agg(fingerprint, '|' ORDER BY fingerprint) AS prints, {", ".join(f"count(*) FILTER (severity = '{s}') AS n_{s.lower()}" for s in LEVELS)} FROM k3 GROUP BY 1, 2),
k5 AS (SELECT 'VENDOR' AS entity_type, vendor_id AS entity_id, coalesce(least(100, greatest(0, ((agg * 10000)::BIGINT * 200 + 1800000) // 3600000)), 0)::BIGINT AS score, coalesce(signal_count, 0)::BIGINT AS signal_count, {", ".join(f"coalesce(n_{s.lower()}, 0)::BIGINT AS n_{s.lower()}" for s in LEVELS)},
    sha256('VENDOR|' || vendor_id || '|v1|{AS_OF}' || coalesce('|' || prints, '')) AS fingerprint FROM vendors v LEFT JOIN sc ON sc.entity_type = 'VENDOR' AND sc.entity_id = vendor_id LEFT JOIN pr ON pr.entity_type = 'VENDOR' AND pr.entity_id = vendor_id)
"""


@query("k1_signals_as_of", f"{K1} SELECT signal_id, anomaly_type, severity FROM k1")
def k1(spark, d):
    return K.signals_as_of(X.signals(spark, d), AS_OF).select("signal_id", "anomaly_type", "severity")


@query("k2_entity_signals", f"{K2} SELECT entity_type, entity_id, signal_id FROM k2")
def k2(spark, d):
    return K.entity_signals(K.signals_as_of(X.signals(spark, d), AS_OF)).select("entity_type", "entity_id", "signal_id")


@query("k3_contributions", f"{K3} SELECT entity_type, entity_id, signal_id, contribution::DOUBLE AS contribution FROM k3")
def k3(spark, d):
    rows = K.contributions(K.entity_signals(K.signals_as_of(X.signals(spark, d), AS_OF)), AS_OF)
    return rows.select("entity_type", "entity_id", "signal_id", F.col("contribution").cast("double").alias("contribution"))


@query("k4_type_breakdown", f"{K4} SELECT entity_type, entity_id, anomaly_type, raw::DOUBLE AS raw, capped::DOUBLE AS capped, signal_count FROM k4")
def k4(spark, d):
    rows = K.type_breakdown(K.contributions(K.entity_signals(K.signals_as_of(X.signals(spark, d), AS_OF)), AS_OF))
    return rows.select("entity_type", "entity_id", "anomaly_type", F.col("raw").cast("double").alias("raw"), F.col("capped").cast("double").alias("capped"), "signal_count")


@query("k5_score_profiles", f"{K5} SELECT *, CASE WHEN score >= 75 THEN 'CRITICAL' WHEN score >= 50 THEN 'HIGH' WHEN score >= 25 THEN 'MEDIUM' ELSE 'LOW' END AS risk_band FROM k5")
def k5(spark, d):
    rows = K.score_profiles(X.signals(spark, d), _vendor_entities(spark, d), AS_OF)
    return rows.select("entity_type", "entity_id", F.col("score").cast("long").alias("score"), "risk_band", "signal_count", "n_low", "n_medium", "n_high", "n_critical", "fingerprint")


_LATEST = "lp AS (SELECT * FROM (SELECT *, rank() OVER (PARTITION BY entity_type, entity_id, score_version ORDER BY as_of DESC) AS r FROM profiles) WHERE r = 1)"


@query("k6_latest_profiles", f"{_LATEST} SELECT profile_id, entity_id, score, risk_band FROM lp")
def k6(spark, d):
    return K.latest_profiles(X.profiles(spark, d)).select("profile_id", "entity_id", "score", "risk_band")


@query("k7_profile_history", "SELECT profile_id, entity_id, row_number() OVER w AS place, row_number() OVER w = 1 AS current FROM profiles WINDOW w AS (PARTITION BY entity_type, entity_id ORDER BY as_of DESC, calculated_at DESC, profile_id DESC)")
def k7(spark, d):
    return K.profile_history(X.profiles(spark, d)).select("profile_id", "entity_id", F.col("place").cast("long").alias("place"), "current")


@query("k8_list_latest_profiles", f"{_LATEST} SELECT profile_id, entity_id, score, name AS label, count(*) OVER () AS total FROM lp LEFT JOIN vendors ON vendor_id = entity_id WHERE risk_band = 'HIGH'")
def k8(spark, d):
    return K.list_latest_profiles(X.profiles(spark, d), X.vendors(spark, d), X.inv(spark, d), X.po(spark, d), band="HIGH").select("profile_id", "entity_id", "score", "label", "total")


@query("s7_append_profiles", "SELECT profile_id, fingerprint FROM (SELECT *, row_number() OVER (PARTITION BY entity_id, as_of ORDER BY fingerprint) AS r FROM profiles p WHERE profile_id % 3 <> 0 AND NOT EXISTS (SELECT 1 FROM profiles o WHERE o.profile_id % 3 = 0 AND o.entity_id = p.entity_id AND o.as_of = p.as_of)) WHERE r = 1")
def s7(spark, d):
    profiles = X.profiles(spark, d)
    return sinks.append_profiles(profiles.where("profile_id % 3 = 0"), profiles).select("profile_id", "fingerprint")


@query("w1_anomaly_summary", """SELECT 'type' AS kind, anomaly_type AS value, count(*) AS n FROM signals GROUP BY 2 UNION ALL SELECT 'severity', severity, count(*) FROM signals GROUP BY 2 UNION ALL SELECT 'day', strftime(detected_at, '%Y-%m-%d'), count(*) FROM signals GROUP BY 2
UNION ALL SELECT 'total', 'all', count(*) FROM signals UNION ALL SELECT 'distinct', 'vendors', count(DISTINCT vendor_id) FROM signals UNION ALL SELECT 'distinct', 'invoices', count(DISTINCT invoice_id) FROM signals UNION ALL SELECT 'distinct', 'orders', count(DISTINCT po_id) FROM signals""")
def w1(spark, d):
    return W.anomaly_summary(X.signals(spark, d))


_COUNTS = ", ".join([*(f"count(*) FILTER (anomaly_type = '{k}') AS n_{k.lower()}" for k in KINDS), *(f"count(*) FILTER (severity = '{s}') AS n_{s.lower()}" for s in LEVELS)])


@query("w2_vendor_anomaly_summary", f"SELECT vendor_id, count(*) AS total, {_COUNTS}, count(*) FILTER (detected_at >= TIMESTAMP '{AS_OF}' - INTERVAL 30 DAY) AS recent, count(DISTINCT invoice_id) AS invoices, count(DISTINCT po_id) AS orders, ((max((detected_at, signal_id)) FILTER (anomaly_type = 'REPEATED_MISMATCH'))[2] % 100 / 100)::DOUBLE AS exception_rate FROM signals GROUP BY 1")
def w2(spark, d):
    rate = F.format_string("0.%02d", F.col("signal_id") % 100)
    signals = X.signals(spark, d).withColumn("evidence", F.create_map(F.lit("exception_rate"), rate))
    return W.vendor_anomaly_summary(signals, AS_OF).withColumn("exception_rate", F.col("exception_rate").cast("double"))


@query(
    "w1_sketched_summary",
    f"""SELECT anomaly_type, count(*) AS n, count(DISTINCT vendor_id) AS vendors, count(DISTINCT invoice_id) AS invoices, count(DISTINCT po_id) AS orders, true AS close
    FROM signals WHERE detected_at::DATE BETWEEN DATE '{AS_OF}' - 700 AND DATE '{AS_OF}' GROUP BY 1""",
)
def w1_sketched(spark, d):
    """Exact counts, and whether those of the merged sketches of the same days lie within 4 standard errors (and 2 entities)."""
    signals = written(X.signals(spark, d))
    since = AS_OF - datetime.timedelta(days=700)
    about = W.sketched_summary(written(W.daily_sketches(signals)), "anomaly_type", since=since, until=AS_OF)
    own = signals.where(F.to_date("detected_at").between(F.lit(since), F.lit(AS_OF)))
    exact = own.groupBy("anomaly_type").agg(F.count("*").alias("n"), *(F.count_distinct(c).alias(name) for c, name in W.ENTITIES.items()))
    error = 4 * 1.04 / 2 ** (W.SKETCH_BITS / 2)
    near = functools.reduce(Column.__and__, (F.abs(F.col(f"about.{x}") - F.col(f"exact.{x}")) <= error * F.col(f"exact.{x}") + 2 for x in W.ENTITIES.values()))
    both = exact.alias("exact").join(about.alias("about"), "anomaly_type")
    return both.select("anomaly_type", "exact.n", *(f"exact.{x}" for x in W.ENTITIES.values()), (near & (F.col("about.n") == F.col("exact.n"))).alias("close"))


def _trend(name: str, period: str, label: str) -> None:
    @query(name, f"SELECT {label} AS period, count(*) AS n, count(*) FILTER (severity IN ('HIGH', 'CRITICAL')) AS n_severe FROM signals GROUP BY 1")
    def trend(spark, d):
        return W.anomaly_trends(X.signals(spark, d), period)


_trend("w3_trends_daily", "daily", "strftime(detected_at, '%Y-%m-%d')")
_trend("w3_trends_weekly", "weekly", "isoyear(detected_at) || '-W' || lpad(week(detected_at)::VARCHAR, 2, '0')")
_trend("w3_trends_monthly", "monthly", "strftime(detected_at, '%Y-%m')")


def _map_sql(table: str, column: str, keys: tuple[str, ...]) -> str:
    listed = ", ".join(f"('{k}')" for k in keys)
    return f"SELECT k AS key, (SELECT count(*) FROM {table} WHERE {column} = k) AS n FROM (VALUES {listed}) t(k) UNION ALL SELECT 'total', count(*) FROM {table}"


@query("w4_count_map", _map_sql("files", "status", (*X.DOCUMENT_STATUSES, "ARCHIVED")))
def w4(spark, d):
    return W.count_map(X.files(spark, d), "status", (*X.DOCUMENT_STATUSES, "ARCHIVED"))


_PARTS = {"documents": ("files", "status", X.DOCUMENT_STATUSES), "exception_status": ("exceptions", "status", X.EXCEPTION_STATUSES), "exception_severity": ("exceptions", "severity", LEVELS), "signals": ("signals", "severity", LEVELS), "reviews": ("reviews", "status", X.REVIEW_STATUSES), "bands": ("lp", "risk_band", LEVELS)}


@query("w5_dashboard_summary", f"{_LATEST} " + " UNION ALL ".join(f"SELECT '{n}' AS name, key, n FROM ({_map_sql(*p)})" for n, p in _PARTS.items()))
def w5(spark, d):
    source = lambda t: K.latest_profiles(X.profiles(spark, d)) if t == "lp" else getattr(X, t)(spark, d)
    return W.dashboard_summary({n: (source(t), c, k) for n, (t, c, k) in _PARTS.items()})


_NUMBERS = "nums AS (SELECT e.*, i.invoice_number, p.po_number, g.grn_number FROM exceptions e LEFT JOIN inv i ON i.invoice_id = e.invoice_id LEFT JOIN po p ON p.po_id = e.purchase_order_id LEFT JOIN grn g ON g.grn_id = e.goods_receipt_id)"


@query("w6_open_exceptions", f"{_NUMBERS} SELECT exception_id, status, invoice_number, po_number, grn_number FROM nums WHERE status IN ('OPEN', 'IN_REVIEW') ORDER BY created_at DESC, exception_id DESC LIMIT 50")
def w6(spark, d):
    return W.open_exceptions(X.exceptions(spark, d), X.inv(spark, d), X.po(spark, d), X.grn(spark, d), 50).select("exception_id", "status", "invoice_number", "po_number", "grn_number")


@query("w7_pending_reviews", "SELECT task_id, document_id, filename FROM reviews WHERE status = 'PENDING' ORDER BY created_at DESC, task_id DESC LIMIT 25")
def w7(spark, d):
    return W.pending_reviews(X.reviews(spark, d), X.files(spark, d), 25).select("task_id", "document_id", "filename")


_ACTIVITY = {"exception": ("exceptions", "exception_id", "created_at"), "signal": ("signals", "signal_id", "detected_at"), "profile": ("profiles", "profile_id", "calculated_at"), "document": ("files", "document_id", "created_at"), "review": ("reviews", "task_id", "created_at"), "action": ("actions", "action_id", "ts")}


@query("w8_recent_activity", "SELECT * FROM (" + " UNION ALL ".join(f"(SELECT '{k}' AS kind, {i} AS id, {a} AS \"at\" FROM {t} ORDER BY {a} DESC, {i} DESC LIMIT 20)" for k, (t, i, a) in _ACTIVITY.items()) + ") ORDER BY \"at\" DESC, kind DESC, id DESC LIMIT 60")
def w8(spark, d):
    sources = {k: getattr(X, t)(spark, d).select(F.col(i).alias("id"), F.col(a).cast("timestamp").alias("at")) for k, (t, i, a) in _ACTIVITY.items()}
    return W.recent_activity(sources, 20, 60)


_lines = lambda t, k: f"(SELECT {k}, count(*) AS n FROM {t} GROUP BY 1)"


@query("w9_list_purchase_orders", f"SELECT po_id, po_number, name AS vendor_name, coalesce(n, 0)::BIGINT AS line_count FROM po LEFT JOIN {_lines('po_line', 'po_id')} USING (po_id) LEFT JOIN vendors USING (vendor_id) WHERE po_number ILIKE '%1%' ORDER BY order_date DESC, po_id DESC LIMIT 500")
def w9_po(spark, d):
    rows, _ = W.page(W.list_purchase_orders(X.po(spark, d), X.po_line(spark, d), X.vendors(spark, d), query="1"), 500, 0, "order_date", "po_id")
    return rows.select("po_id", "po_number", "vendor_name", "line_count")


@query("w9_list_goods_receipts", f"SELECT grn_id, grn_number, po_number, coalesce(n, 0)::BIGINT AS line_count FROM grn LEFT JOIN {_lines('grn_line', 'grn_id')} USING (grn_id) LEFT JOIN po USING (po_id)")
def w9_grn(spark, d):
    return W.list_goods_receipts(X.grn(spark, d), X.grn_line(spark, d), X.po(spark, d)).select("grn_id", "grn_number", "po_number", "line_count")


@query("w9_list_invoices", f"SELECT inv.invoice_id, invoice_number, name AS vendor_name, po_number, coalesce(n, 0)::BIGINT AS line_count FROM inv LEFT JOIN {_lines('inv_line', 'invoice_id')} USING (invoice_id) LEFT JOIN vendors ON vendors.vendor_id = inv.vendor_id LEFT JOIN po ON po.po_id = inv.po_id WHERE inv.vendor_id % 1 = 0 AND status = 'RECEIVED'")
def w9_inv(spark, d):
    return W.list_invoices(X.inv(spark, d), X.inv_line(spark, d), X.vendors(spark, d), X.po(spark, d), status="RECEIVED").select("invoice_id", "invoice_number", "vendor_name", "po_number", "line_count")


@query("w10_list_exceptions", f"{_NUMBERS} SELECT exception_id, exception_type, invoice_number, po_number, grn_number FROM nums WHERE severity = 'HIGH' AND status = 'IN_REVIEW' AND (contains(lower(coalesce(invoice_number, '')), '77') OR contains(lower(coalesce(po_number, '')), '77') OR contains(lower(coalesce(grn_number, '')), '77'))")
def w10(spark, d):
    rows, _ = W.list_exceptions(X.exceptions(spark, d), X.inv(spark, d), X.po(spark, d), X.grn(spark, d), status="IN_REVIEW", query="77", severity="HIGH")
    return rows.select("exception_id", "exception_type", "invoice_number", "po_number", "grn_number")


@query("w10_exception_facets", f"{_NUMBERS} SELECT status, count(*) AS n FROM nums WHERE severity = 'HIGH' GROUP BY 1")
def w10_facets(spark, d):
    _, facets = W.list_exceptions(X.exceptions(spark, d), X.inv(spark, d), X.po(spark, d), X.grn(spark, d), status="OPEN", severity="HIGH")
    return facets


_PLAN_STATUSES = ("PROPOSED", "APPROVAL_REQUIRED", "APPROVED", "EXECUTING", "FAILED", "COMPLETED", "CANCELLED")
PLANS = f"plans AS (SELECT plan_id, plan_id * 10 AS exception_id, min(ts) AS created_at, {X._sql_pick('plan_id % 7', _PLAN_STATUSES)} AS status FROM actions GROUP BY plan_id)"


def plans(spark: SparkSession, d: str) -> DataFrame:
    return X.actions(spark, d).groupBy("plan_id").agg(F.min("ts").alias("created_at")).select("plan_id", (F.col("plan_id") * 10).alias("exception_id"), "created_at", X._pick(F.col("plan_id") % 7, _PLAN_STATUSES).alias("status"))


def _told(spark: SparkSession, d: str) -> DataFrame:
    return X.exceptions(spark, d).withColumn("message", F.concat(F.lit("Exception "), F.col("exception_id").cast("string"), F.lit(".")))


@query("w11_list_plans", f"{PLANS} SELECT plan_id, p.status, exception_type, 'Exception ' || e.exception_id || '.' AS exception_message, n AS action_count FROM plans p LEFT JOIN exceptions e USING (exception_id) LEFT JOIN {_lines('actions', 'plan_id')} USING (plan_id)")
def w11(spark, d):
    return W.list_plans(plans(spark, d), _told(spark, d), X.actions(spark, d)).select("plan_id", "status", "exception_type", "exception_message", "action_count")


@query("w12_list_documents", "SELECT document_id, filename, status FROM files WHERE document_id IN (SELECT document_id FROM reviews WHERE status = 'APPROVED')")
def w12(spark, d):
    return W.list_documents(X.files(spark, d), X.reviews(spark, d), review_status="APPROVED").select("document_id", "filename", "status")


_RELATED = """rel AS (SELECT po_id, count(*) AS n, count(*) FILTER (s = 'MATCHED') AS matched, count(*) FILTER (s = 'EXCEPTION') AS problems, count(*) FILTER (s NOT IN ('MATCHED', 'EXCEPTION')) AS pending FROM invs WHERE po_id IS NOT NULL GROUP BY 1),
rels AS (SELECT *, n || CASE WHEN n = 1 THEN ' related invoice — ' ELSE ' related invoices — ' END || concat_ws(', ', CASE WHEN matched = 1 THEN '1 matched' WHEN matched > 1 THEN matched || ' matched' END, CASE WHEN problems = 1 THEN '1 with a problem' WHEN problems > 1 THEN problems || ' with problems' END, CASE WHEN pending = 1 THEN '1 not matched yet' WHEN pending > 1 THEN pending || ' not matched yet' END) AS summary FROM rel)"""
_INVS = "invs AS (SELECT *, CASE invoice_id % 3 WHEN 0 THEN 'MATCHED' WHEN 1 THEN 'EXCEPTION' ELSE 'RECEIVED' END AS s FROM inv)"


def _settled(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("invoice_id") % 3
    return X.inv(spark, d).withColumn("status", F.when(i == 0, "MATCHED").when(i == 1, "EXCEPTION").otherwise("RECEIVED"))


_KINDS = ("INVOICE", "PO", "GRN", "UNKNOWN")
_FACTS = f"""docs AS (SELECT document_id, {X._sql_pick("document_id % 4", _KINDS)} AS document_type, CASE WHEN document_id % 6 = 1 THEN document_id END AS purchase_order_id, CASE WHEN document_id % 10 = 2 THEN document_id * 10 END AS goods_receipt_id,
  CASE WHEN document_id % 3 = 0 THEN document_id * 10 END AS linked_invoice FROM files),
read AS (SELECT document_id, {X._sql_pick("document_id % 3", _KINDS)} AS detected_type, CASE WHEN document_id % 2 = 0 THEN 'VALIDATION_FAILED' ELSE 'READY_FOR_RECONCILIATION' END AS extraction_outcome, CASE WHEN document_id % 5 <> 0 THEN 'PO-' || lpad(document_id::VARCHAR, 8, '0') END AS po_number,
  CASE WHEN document_id % 13 = 0 THEN 'Two numbers.' END AS ambiguity_summary FROM files WHERE document_id % 7 <> 0)"""


@query("w13_document_facts", f"""{_INVS}, {_RELATED}, {_FACTS}, lr AS (SELECT document_id, arg_max(status, (created_at, task_id)) AS review_status FROM reviews GROUP BY 1),
j AS (SELECT f.*, read.* EXCLUDE (document_id), lr.review_status, po.po_id AS named, invs.invoice_number AS number, invs.s, invs.invoice_id IS NOT NULL AS mine, coalesce(f.purchase_order_id, po.po_id) AS order_id FROM docs f LEFT JOIN read USING (document_id) LEFT JOIN lr USING (document_id) LEFT JOIN po ON po.po_number = read.po_number LEFT JOIN invs ON invs.invoice_id = linked_invoice)
SELECT j.document_id, detected_type, extraction_outcome, review_status, po_number, order_id IS NOT NULL AS purchase_order_ready, goods_receipt_id IS NOT NULL OR coalesce(purchase_order_id IN (SELECT po_id FROM grn), false) OR coalesce(named IN (SELECT po_id FROM grn), false) AS goods_receipt_ready,
  mine OR (coalesce(detected_type, document_type) IN ('PO', 'GRN') AND rels.summary IS NOT NULL) AS invoice_ready, number AS invoice_number, CASE WHEN s IN ('MATCHED', 'EXCEPTION') THEN s END AS reconciliation_status,
  CASE WHEN NOT mine AND coalesce(detected_type, document_type) IN ('PO', 'GRN') THEN rels.summary END AS related_invoice_summary, ambiguity_summary FROM j LEFT JOIN rels ON rels.po_id = order_id""")
def w13(spark, d):
    i = F.col("document_id")
    files = X.files(spark, d).select("document_id", X._pick(i % 4, _KINDS).alias("document_type"), F.when(i % 6 == 1, i).alias("purchase_order_id"), F.when(i % 10 == 2, i * 10).alias("goods_receipt_id"), F.when(i % 3 == 0, i * 10).alias("invoice_id"))
    number = F.when(i % 5 == 0, " ").otherwise(F.concat(F.lit(" PO-"), F.lpad(i.cast("string"), 8, "0")))
    results = X.files(spark, d).where("document_id % 7 <> 0").select("document_id", X._pick(i % 3, _KINDS).alias("detected_type"), F.when(i % 2 == 0, "VALIDATION_FAILED").otherwise("READY_FOR_RECONCILIATION").alias("outcome"), number.alias("po_number"), F.when(i % 13 == 0, "Two numbers.").alias("ambiguity_summary"))
    return W.document_facts(files, results, X.reviews(spark, d), _settled(spark, d), X.po(spark, d), X.grn(spark, d))


@query("w14_related_invoices", f"{_INVS}, {_RELATED} SELECT po_id, n, matched, problems, pending, summary FROM rels")
def w14(spark, d):
    return W.related_invoice_summary(_settled(spark, d))


@query("w15_review_queue", f"""q AS (SELECT *, {X._sql_pick("document_id % 4", _KINDS)} AS document_type FROM reviews WHERE status = 'PENDING' AND contains(lower(filename), 'invoice') AND document_id % 4 = 1)
SELECT task_id, priority, filename, document_type, created_at::VARCHAR AS created_at, (SELECT count(*) FROM q) AS total FROM q ORDER BY q.created_at DESC, task_id DESC LIMIT 50""")
def w15(spark, d):
    tasks = X.reviews(spark, d).withColumn("document_type", X._pick(F.col("document_id") % 4, _KINDS))
    rows, total = W.review_queue(tasks, 50, query="Invoice", status="PENDING", document_type="PO")
    # One row, beside a page of 50.
    return rows.select("task_id", "priority", "filename", "document_type", F.date_format("created_at", "yyyy-MM-dd HH:mm:ss").alias("created_at")).crossJoin(total)


_VERSIONS = f"""vers AS (SELECT label * 10 + k AS policy_version_id, label AS policy_document_id, {X._sql_pick("(label * 10 + k) % 3", ("ACTIVE", "SUPERSEDED", "DRAFT"))} AS status, 'v' || k AS vlabel, DATE '2024-01-01' + ((label * 10 + k) % 2)::INT AS effective_from
  FROM (SELECT DISTINCT label::BIGINT AS label FROM embeddings) CROSS JOIN (VALUES (0), (1), (2)) t(k)),
cc AS (SELECT policy_version_id, count(*) AS n FROM chunks GROUP BY 1), full_ AS (SELECT vers.*, coalesce(n, 0) AS n FROM vers LEFT JOIN cc USING (policy_version_id)),
lib AS (SELECT policy_document_id, count(*) AS version_count, sum(n)::BIGINT AS chunk_count, string_agg(policy_version_id || ':' || vlabel || ':' || status || ':' || n, ',' ORDER BY effective_from, vlabel) AS versions FROM full_ GROUP BY 1)"""


def _library(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Documents, of which every other one has no version, and three versions each of the rest; the third has no chunks."""
    own = X.chunks(spark, d).select("policy_document_id").distinct()
    number = F.col("policy_document_id") * 10 + F.col("k")
    versions = own.withColumn("k", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2)))).select(
        number.alias("policy_version_id"), "policy_document_id", X._pick(number % 3, ("ACTIVE", "SUPERSEDED", "DRAFT")).alias("status"),
        F.concat(F.lit("v"), F.col("k").cast("string")).alias("label"), F.date_add(F.lit(datetime.date(2024, 1, 1)), (number % 2).cast("int")).alias("effective_from"),
    )
    return own.unionByName(own.select((F.col("policy_document_id") + 1000000).alias("policy_document_id"))), versions


def _listed(library: DataFrame) -> DataFrame:
    one = lambda v: F.concat_ws(":", v["policy_version_id"].cast("string"), v["label"], v["status"], v["n"].cast("string"))
    return library.withColumn("versions", F.coalesce(F.array_join(F.transform("versions", one), ","), F.lit("")))


@query("w16_policy_library", f"{_VERSIONS} SELECT policy_document_id, version_count, chunk_count, versions FROM lib UNION ALL SELECT policy_document_id + 1000000, 0, 0, '' FROM lib")
def w16(spark, d):
    return _listed(W.policy_library(*_library(spark, d), X.chunks(spark, d)))


@query("w16_policy_library_status", f"{_VERSIONS} SELECT policy_document_id, version_count, chunk_count, versions FROM lib WHERE policy_document_id IN (SELECT policy_document_id FROM vers WHERE status = 'DRAFT')")
def w16_status(spark, d):
    return _listed(W.policy_library(*_library(spark, d), X.chunks(spark, d), "DRAFT"))


@query("w17_audit_trail", "SELECT event_id, entity_id, row_number() OVER (PARTITION BY entity_id ORDER BY ts, event_id) AS place FROM history")
def w17(spark, d):
    return W.audit_trail(X.history(spark, d), "entity_id", ("ts", "event_id")).select("event_id", "entity_id", F.col("place").cast("long").alias("place"))


# Two decisions for each action but those with event_id % 3 = 2; executions of every other action under shared keys.
APPROVALS = "approvals AS (SELECT action_id * 2 + k AS approval_id, action_id, CASE WHEN (action_id + k) % 3 = 0 THEN 'APPROVED' ELSE 'REJECTED' END AS decision, ts + to_seconds(k) AS created_at FROM actions CROSS JOIN (VALUES (0), (1)) t(k) WHERE action_id % 3 <> 2)"
EXECUTIONS = f"executions AS (SELECT action_id * 3 + k AS execution_id, action_id, 'key-' || ((action_id // 4) % 10000) AS idempotency_key, {X._sql_pick('(action_id + k) % 4', ('PENDING', 'RUNNING', 'SUCCEEDED', 'FAILED'))} AS status, ts + to_seconds(10 + k) AS started_at FROM actions CROSS JOIN (VALUES (0), (1)) t(k) WHERE action_id % 2 = 0)"


def approvals(spark: SparkSession, d: str) -> DataFrame:
    own = X.actions(spark, d).where("action_id % 3 <> 2").withColumn("k", F.explode(F.array(F.lit(0), F.lit(1))))
    at = F.col("ts").cast("timestamp") + F.make_dt_interval(secs=F.col("k"))
    return own.select((F.col("action_id") * 2 + F.col("k")).alias("approval_id"), "action_id", F.when((F.col("action_id") + F.col("k")) % 3 == 0, "APPROVED").otherwise("REJECTED").alias("decision"), at.alias("created_at"), at.alias("decided_at"))


def executions(spark: SparkSession, d: str) -> DataFrame:
    own = X.actions(spark, d).where("action_id % 2 = 0").withColumn("k", F.explode(F.array(F.lit(0), F.lit(1))))
    key = F.concat(F.lit("key-"), (F.floor(F.col("action_id") / 4).cast("long") % 10000).cast("string"))
    return own.select((F.col("action_id") * 3 + F.col("k")).alias("execution_id"), "action_id", key.alias("idempotency_key"), X._pick((F.col("action_id") + F.col("k")) % 4, ("PENDING", "RUNNING", "SUCCEEDED", "FAILED")).alias("status"), (F.col("ts").cast("timestamp") + F.make_dt_interval(secs=F.col("k") + 10)).alias("started_at"))


@query("w18_latest_approval", f"{APPROVALS}, la AS (SELECT action_id, arg_max(decision, (created_at, approval_id)) AS decision FROM approvals GROUP BY 1) SELECT a.action_id, decision, coalesce(decision <> 'APPROVED', true) AS blocked FROM actions a LEFT JOIN la USING (action_id)")
def w18(spark, d):
    return W.latest_approval(X.actions(spark, d), approvals(spark, d)).select("action_id", "decision", "blocked")


_ST = "st AS (SELECT plan_id, list(DISTINCT status) AS s FROM actions GROUP BY 1)"
_NO_MORE = "len(list_filter(s, lambda x: x NOT IN ({}))) = 0"


@query("w19_plan_status_execution", f"""{PLANS}, {_ST} SELECT plan_id, CASE WHEN p.status IN ('REJECTED', 'COMPLETED', 'CANCELLED', 'NO_ACTION_RECOMMENDED') THEN p.status WHEN list_contains(s, 'EXECUTING') THEN 'EXECUTING' WHEN list_contains(s, 'PENDING') THEN 'APPROVAL_REQUIRED' WHEN list_contains(s, 'FAILED') THEN 'FAILED'
  WHEN {_NO_MORE.format("'REJECTED', 'CANCELLED'")} THEN 'REJECTED' WHEN {_NO_MORE.format("'REJECTED', 'CANCELLED', 'COMPLETED'")} THEN 'COMPLETED' WHEN list_contains(s, 'APPROVED') THEN 'APPROVED' ELSE p.status END AS new_status FROM plans p JOIN st USING (plan_id)""")
def w19(spark, d):
    return W.plan_status(plans(spark, d), X.actions(spark, d), "execution").select("plan_id", "new_status")


@query("w19_plan_status_decision", f"""{PLANS}, {_ST}, dv AS (SELECT *, CASE WHEN list_contains(s, 'PENDING') THEN 'APPROVAL_REQUIRED' WHEN list_contains(s, 'REJECTED') AND NOT list_contains(s, 'APPROVED') THEN 'REJECTED' WHEN list_contains(s, 'APPROVED') THEN 'APPROVED' END AS v FROM plans JOIN st USING (plan_id))
SELECT plan_id, CASE WHEN status IN ('CANCELLED', 'COMPLETED', 'EXECUTING', 'NO_ACTION_RECOMMENDED') THEN status WHEN v = 'REJECTED' THEN v WHEN v IS NOT NULL AND status IN ('PROPOSED', 'APPROVAL_REQUIRED') THEN v ELSE status END AS new_status FROM dv""")
def w19_decision(spark, d):
    return W.plan_status(plans(spark, d), X.actions(spark, d), "decision").select("plan_id", "new_status")


@query("w20_blocked_actions", "SELECT action_id, coalesce(max(CASE WHEN status NOT IN ('COMPLETED', 'REJECTED', 'CANCELLED') THEN 1 ELSE 0 END) OVER (PARTITION BY plan_id ORDER BY action_order RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) = 1, false) AS blocked FROM actions")
def w20(spark, d):
    return W.blocked_actions(X.actions(spark, d)).select("action_id", "blocked")


@query("w21_illegal_transitions", """SELECT event_id, entity_id, previous, status FROM (SELECT *, lag(status) OVER (PARTITION BY entity_id ORDER BY ts, event_id) AS previous FROM history) WHERE previous <> status
AND NOT (previous = 'PENDING' AND status IN ('IN_REVIEW', 'APPROVED', 'CORRECTED', 'REJECTED') OR previous = 'IN_REVIEW' AND status IN ('APPROVED', 'CORRECTED', 'REJECTED') OR previous = 'CORRECTED' AND status = 'APPROVED')""")
def w21(spark, d):
    return W.illegal_transitions(X.history(spark, d)).select("event_id", "entity_id", "previous", "status")


@query("w22_duplicate_executions", f"{EXECUTIONS} SELECT 'shared_key' AS violation, idempotency_key AS subject, count(DISTINCT action_id) AS n FROM executions GROUP BY 2 HAVING count(DISTINCT action_id) > 1 UNION ALL SELECT 'several_runs', action_id::VARCHAR, count(*) FROM executions WHERE status IN ('PENDING', 'RUNNING', 'SUCCEEDED') GROUP BY 2 HAVING count(*) > 1")
def w22(spark, d):
    return W.duplicate_executions(executions(spark, d))


@query("w23_altered_parameters", """SELECT action_id, sha256('{"amount":"' || action_id || '","note":"n' || (action_id % 5) || '"}') AS current_hash FROM actions WHERE action_id % 4 = 0""")
def w23(spark, d):
    i = F.col("action_id")
    params = F.create_map(F.lit("note"), F.concat(F.lit("n"), (i % 5).cast("string")), F.lit("amount"), i.cast("string"))
    own = X.actions(spark, d).withColumn("parameters", params)
    from ..functions import scalars as S

    own = own.withColumn("approved_hash", F.when(i % 4 == 0, F.sha2(F.lit("other"), 256)).when(i % 4 == 1, S.parameters_hash("parameters")))
    return W.altered_parameters(own).select("action_id", "current_hash")


@query("w24_job_counts", "SELECT status, count(*) AS n FROM actions GROUP BY 1")
def w24(spark, d):
    return W.job_counts(X.actions(spark, d))


@query("w25_list_scans", "SELECT action_id AS scan_id, status FROM actions WHERE status = 'FAILED' ORDER BY ts DESC, action_id DESC LIMIT 200")
def w25(spark, d):
    scans = X.actions(spark, d).select(F.col("action_id").alias("scan_id"), F.col("ts").alias("requested_at"), "status")
    rows, _ = W.list_scans(scans, 200, status="FAILED")
    return rows.select("scan_id", "status")


@query("w26_plan_history", f"{APPROVALS}, {EXECUTIONS}, {PLANS}, hist AS (SELECT plan_id, 'approval' AS kind, approval_id AS id, approvals.created_at AS t FROM approvals JOIN actions USING (action_id) UNION ALL SELECT plan_id, 'execution', execution_id, started_at FROM executions JOIN actions USING (action_id) UNION ALL SELECT plan_id, 'grounding', plan_id * 2 + k, created_at + to_seconds(3600 * k) FROM plans CROSS JOIN (VALUES (0), (1)) t(k)) SELECT plan_id, kind, id, row_number() OVER (PARTITION BY plan_id ORDER BY t, kind, id) AS place FROM hist")
def w26(spark, d):
    """Each plan's exception was explained twice, an hour apart."""
    own = plans(spark, d)
    at = F.col("created_at").cast("timestamp") + F.make_dt_interval(hours=F.col("k"))
    groundings = own.withColumn("k", F.explode(F.array(F.lit(0), F.lit(1)))).select((F.col("plan_id") * 2 + F.col("k")).alias("grounding_id"), "exception_id", at.alias("created_at"))
    return W.plan_history(X.actions(spark, d), approvals(spark, d), executions(spark, d), own, groundings).select("plan_id", "kind", "id", F.col("place").cast("long").alias("place"))


_PROPOSED = f"""prop AS (SELECT plan_id, action_id AS position, action_order % 3 AS action_order, {X._sql_pick("action_id % 5", ("NOTIFY_VENDOR", "HOLD_INVOICE", "ESCALATE", "REWRITE_ALL", "NOTIFY_VENDOR"))} AS action_type, CASE WHEN action_id % 4 = 0 THEN '  ' WHEN action_id % 97 = 0 THEN repeat('x', 501) ELSE 'text' END AS reason FROM actions)"""


@query("w27_check_plan_actions", f"""{_PROPOSED}, chk AS (SELECT *, CASE WHEN action_type = 'REWRITE_ALL' THEN 'unknown_type' WHEN trim(reason) = '' THEN 'missing_parameter' WHEN length(reason) > 500 THEN 'parameter_too_long' END AS error FROM prop)
SELECT plan_id, position, error, (CASE WHEN error IS NULL THEN row_number() OVER (PARTITION BY plan_id, error IS NULL ORDER BY action_order, position) - 1 END)::VARCHAR AS new_order FROM chk""")
def w27(spark, d):
    i = F.col("action_id")
    own = X.actions(spark, d).select(
        "plan_id",
        i.alias("position"),
        (F.col("action_order") % 3).alias("action_order"),
        X._pick(i % 5, ("NOTIFY_VENDOR", "HOLD_INVOICE", "ESCALATE", "REWRITE_ALL", "NOTIFY_VENDOR")).alias("action_type"),
        F.create_map(F.lit("reason"), F.when(i % 4 == 0, "  ").when(i % 97 == 0, F.repeat(F.lit("x"), 501)).otherwise("text")).alias("parameters"),
    )
    rows = W.check_plan_actions(own, {k: ("reason",) for k in ("NOTIFY_VENDOR", "HOLD_INVOICE", "ESCALATE")})
    return rows.select("plan_id", "position", "error", F.col("new_order").cast("string").alias("new_order"))


@query("w28_exception_detail", f"""{_NUMBERS} SELECT exception_id, exception_type, severity, status, 'Exception ' || exception_id || '.' AS message, invoice_id::VARCHAR AS invoice_id, invoice_number, purchase_order_id::VARCHAR AS purchase_order_id, po_number, goods_receipt_id::VARCHAR AS goods_receipt_id, grn_number,
  concat_ws(',', purchase_order_id, goods_receipt_id, invoice_id) AS sources, 'kind=' || exception_type || ',level=' || severity AS evidence, strftime(created_at, '%Y-%m-%d %H:%M:%S') AS created_at, CASE WHEN status = 'RESOLVED' THEN strftime(created_at + INTERVAL 1 DAY, '%Y-%m-%d %H:%M:%S') END AS resolved_at FROM nums""")
def w28(spark, d):
    ids = ("purchase_order_id", "goods_receipt_id", "invoice_id")
    own = _told(spark, d).withColumns({
        "source_document_ids": F.array_compact(F.array(*(F.col(c).cast("string") for c in ids))),
        "evidence": F.create_map(F.lit("level"), F.col("severity"), F.lit("kind"), F.col("exception_type")),
        "resolved_at": F.when(F.col("status") == "RESOLVED", F.col("created_at") + F.expr("INTERVAL 1 DAY")),
    })
    evidence = F.array_join(F.transform(F.array_sort(F.map_entries("evidence")), lambda e: F.concat_ws("=", e["key"], e["value"])), ",")
    when = [F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c) for c in ("created_at", "resolved_at")]
    full = W.with_numbers(own, X.inv(spark, d), X.po(spark, d), X.grn(spark, d))
    return full.select("exception_id", "exception_type", "severity", "status", "message", "invoice_number", "po_number", "grn_number", *(F.col(c).cast("string").alias(c) for c in ids), F.array_join("source_document_ids", ",").alias("sources"), evidence.alias("evidence"), *when)
