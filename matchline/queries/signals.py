"""Anomaly signals, A1 to A11, and their sink."""

from __future__ import annotations

import datetime
import functools

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import fixtures as X
from ..operators import anomaly as A
from ..sources import sinks
from .base import query, written
from .match import _fp, plain_tables, tables

AS_OF = datetime.date(1998, 1, 1)


def brief(s: DataFrame) -> DataFrame:
    ids = [F.col(c).cast("string").alias(c) for c in ("vendor_id", "po_id", "invoice_id", "grn_id")]
    return s.select("anomaly_type", "severity", F.col("score").cast("double").alias("score"), *ids, "fingerprint")


def _sig(kind: str, severity: str, parts: list[str], source: str, vendor: str = "vendor_id", po: str = "NULL", invoice: str = "NULL", grn: str = "NULL") -> str:
    level = repr(severity) if severity.isupper() else severity
    return f"""SELECT '{kind}' AS anomaly_type, {level} AS severity, (CASE {level} WHEN 'LOW' THEN 0.25 WHEN 'MEDIUM' THEN 0.5 WHEN 'HIGH' THEN 0.75 ELSE 1.0 END)::DOUBLE AS score,
    ({vendor})::VARCHAR AS vendor_id, ({po})::VARCHAR AS po_id, ({invoice})::VARCHAR AS invoice_id, ({grn})::VARCHAR AS grn_id, {_fp(repr(kind), *parts)} AS fingerprint FROM {source}"""


def _percent(e: str, a: str) -> str:
    return "CASE " + " ".join(f"WHEN ({e} = 0 AND {a} <> 0) OR ({e} <> 0 AND abs({a} - {e}) * 100 >= {n} * abs({e})) THEN '{s}'" for s, n in (("CRITICAL", 50), ("HIGH", 25), ("MEDIUM", 10), ("LOW", 5))) + " END"


def _lines(column: str, kind: str) -> str:
    return _sig(kind, "sev", ["vendor_id", "invoice_id", "invoice_line_id", "po_line_id"], f"(SELECT l.*, inv.vendor_id, {_percent('p.' + column, 'l.' + column)} AS sev FROM inv_line l JOIN po_line p ON p.po_line_id = l.po_line_id AND p.po_id = l.po_id JOIN inv ON inv.invoice_id = l.invoice_id) WHERE sev IS NOT NULL", po="po_id", invoice="invoice_id")


NORM = "norm AS (SELECT *, trim(regexp_replace(regexp_replace(lower(trim(invoice_number)), '[\\s_]+', '-', 'g'), '-{2,}', '-', 'g'), '-') AS nn FROM inv)"
A1, A2 = _lines("unit_price", "PRICE_VARIANCE"), _lines("quantity", "QUANTITY_VARIANCE")
A3 = _sig("DUPLICATE_INVOICE", "HIGH", ["vendor_id", "nn"], "(SELECT vendor_id, nn, min(invoice_id) AS invoice_id, arg_min(po_id, invoice_id) AS po_id FROM norm GROUP BY 1, 2 HAVING count(*) > 1)", po="po_id", invoice="invoice_id")
_IP = "(SELECT inv.*, po.order_date FROM inv JOIN po ON po.po_id = inv.po_id)"
A4 = " UNION ALL ".join((
    _sig("TIMING_ANOMALY", "HIGH", ["'invoice_before_po'", "invoice_id", "po_id"], f"{_IP} WHERE invoice_date < order_date", po="po_id", invoice="invoice_id"),
    _sig("TIMING_ANOMALY", "MEDIUM", ["'invoice_before_grn'", "invoice_id", "grn_id"], "(SELECT inv.*, grn_id, receipt_date FROM inv JOIN grn ON grn.po_id = inv.po_id) WHERE invoice_date < receipt_date", po="po_id", invoice="invoice_id", grn="grn_id"),
    _sig("TIMING_ANOMALY", "LOW", ["'long_delay'", "invoice_id", "po_id"], f"{_IP} WHERE date_diff('day', order_date, invoice_date) > 30", po="po_id", invoice="invoice_id"),
))
# Means and ratios to 4 places, half to even, in whole ten-thousandths: DuckDB divides decimals as doubles.
_R4 = "(({a}) // ({b}) + CASE WHEN 2 * (({a}) % ({b})) > ({b}) OR (2 * (({a}) % ({b})) = ({b}) AND (({a}) // ({b})) % 2 = 1) THEN 1 ELSE 0 END)"
SPIKE = f"""own AS (SELECT *, (total_amount * 10000)::HUGEINT AS cur FROM inv),
sums AS (SELECT vendor_id, sum(cur) AS total, count(*) AS n, max((invoice_date, invoice_id)) AS latest FROM own GROUP BY 1),
base AS (SELECT own.*, sums.n, sums.latest, {_R4.format(a="sums.total - cur", b="(n - 1)")}::HUGEINT AS mean FROM own JOIN sums USING (vendor_id) WHERE n > 3),
spike AS (SELECT *, CASE WHEN ratio >= 50000 THEN 'CRITICAL' WHEN ratio >= 30000 THEN 'HIGH' WHEN ratio >= 20000 THEN 'MEDIUM' END AS sev FROM (SELECT *, {_R4.format(a="cur * 10000", b="mean")} AS ratio FROM base WHERE mean > 0))"""
_A5 = _sig("VENDOR_SPIKE", "sev", ["vendor_id", "invoice_id"], "spike WHERE sev IS NOT NULL", po="po_id", invoice="invoice_id")
A5_VENDOR = _A5 + " AND invoice_id = struct_extract(latest, 2)"
RATE = f"""ex AS (SELECT invoice_id, count(*) AS e FROM exceptions GROUP BY 1),
rate AS (SELECT *, CASE WHEN r >= 7500 THEN 'CRITICAL' WHEN r >= 5000 THEN 'HIGH' WHEN r >= 3000 THEN 'MEDIUM' END AS sev FROM (SELECT vendor_id, {_R4.format(a="e * 10000", b="n")} AS r FROM (SELECT vendor_id, count(*) AS n, coalesce(sum(e), 0)::BIGINT AS e FROM inv LEFT JOIN ex USING (invoice_id) WHERE invoice_date >= DATE '{AS_OF}' - 90 GROUP BY 1 HAVING count(*) >= 5)))"""
A6 = _sig("REPEATED_MISMATCH", "sev", ["vendor_id", "'90'", f"'{AS_OF}'"], "rate WHERE sev IS NOT NULL")
A7 = " UNION ALL ".join((A1, A2, A3, A4, _A5))


@query("a1_price_variance", A1)
def a1(spark, d):
    return brief(A.price_variance_signals(tables(spark, d)))


@query("a2_quantity_variance", A2)
def a2(spark, d):
    return brief(A.quantity_variance_signals(tables(spark, d)))


@query("a3_duplicate_invoices", f"{NORM} {A3}")
def a3(spark, d):
    return brief(A.duplicate_invoice_signals(X.inv(spark, d)))


@query("a4_timing", A4)
def a4(spark, d):
    return brief(A.timing_signals(X.po(spark, d), X.grn(spark, d), X.inv(spark, d)))


@query("a5_vendor_spike", f"{SPIKE} {_A5}")
def a5(spark, d):
    return brief(A.vendor_spike_signals(X.inv(spark, d)))


@query("a5_vendor_spike_latest", f"{SPIKE} {A5_VENDOR}")
def a5_latest(spark, d):
    return brief(A.vendor_spike_signals(X.inv(spark, d), "vendor"))


@query("a6_repeated_mismatch", f"{RATE} {A6}")
def a6(spark, d):
    return brief(A.repeated_mismatch_signals(X.inv(spark, d), X.exceptions(spark, d), AS_OF))


@query("a7_detect_invoices", f"{NORM}, {SPIKE} {A7}")
def a7(spark, d):
    return brief(A.detect_invoices(plain_tables(spark, d)))


@query("a8_detect_vendors", f"{SPIKE}, {RATE} {A5_VENDOR} UNION ALL {A6}")
def a8(spark, d):
    return brief(A.detect_vendors(X.inv(spark, d), X.exceptions(spark, d), AS_OF))


_SCOPE = f"""scope AS (SELECT * FROM exceptions WHERE status = 'OPEN'),
vs AS (SELECT DISTINCT coalesce(i.vendor_id, p.vendor_id)::VARCHAR AS vendor_id FROM scope s LEFT JOIN inv i ON i.invoice_id = s.invoice_id LEFT JOIN po p ON p.po_id = s.purchase_order_id),
dp AS (SELECT DISTINCT {_fp("'DUPLICATE_INVOICE'", "vendor_id", "nn")} AS fingerprint FROM norm WHERE invoice_id IN (SELECT invoice_id FROM scope)),
al AS ({A7}), mine AS (SELECT * FROM al WHERE CASE WHEN anomaly_type = 'DUPLICATE_INVOICE' THEN fingerprint IN (SELECT fingerprint FROM dp) ELSE invoice_id IN (SELECT invoice_id::VARCHAR FROM scope) END)"""


@query("a9_detect_exceptions", f"{NORM}, {SPIKE}, {RATE}, {_SCOPE} SELECT * FROM mine UNION ALL SELECT * FROM ({A5_VENDOR} UNION ALL {A6}) WHERE vendor_id IN (SELECT vendor_id FROM vs) AND fingerprint NOT IN (SELECT fingerprint FROM mine)")
def a9(spark, d):
    exceptions = written(X.exceptions(spark, d))
    return brief(A.detect_exceptions(exceptions.where("status = 'OPEN'"), plain_tables(spark, d), exceptions, AS_OF))


@query("a10_full_scan", f"{NORM}, {SPIKE}, {RATE} SELECT * FROM ({A7}) WHERE invoice_id::BIGINT > 1000 UNION ALL SELECT * FROM ({A5_VENDOR} UNION ALL {A6}) WHERE vendor_id::BIGINT > 100")
def a10(spark, d):
    rows, _ = A.full_scan(plain_tables(spark, d), written(X.exceptions(spark, d)), AS_OF, after_invoice=1000, after_vendor=100)
    return brief(rows)


@query("a10_scan_in_parts", f"{NORM}, {SPIKE}, {RATE} {A7} UNION ALL {A5_VENDOR} UNION ALL {A6}")
def a10_parts(spark, d):
    """A scan of everything in three parts, each after the last one's checkpoint; the parts share their baselines."""
    t, exceptions = plain_tables(spark, d), written(X.exceptions(spark, d))
    base = A.Baselines.of(t.inv)
    batch = max(1, -(-max(t.inv.count(), base.sums.count()) // 3))
    parts, at = [], (None, None)
    while True:
        rows, counts = A.full_scan(t, exceptions, AS_OF, *at, batch=batch, baselines=base)
        done = counts.first()
        if not done["invoices"] and not done["vendors"]:
            return brief(functools.reduce(DataFrame.unionByName, [*parts, rows]))
        parts.append(rows)
        at = tuple(new if new is not None else old for new, old in zip((done["last_invoice"], done["last_vendor"]), at))


@query("a11_signals_page", "SELECT signal_id, anomaly_type, severity, detected_at FROM signals WHERE severity IN ('HIGH', 'CRITICAL') ORDER BY detected_at DESC, signal_id DESC LIMIT 100")
def a11(spark, d):
    page, _ = A.list_signals_page(X.signals(spark, d), 100, high_or_critical=True)
    return page.select("signal_id", "anomaly_type", "severity", "detected_at")


@query("a11_two_pages", "SELECT signal_id, anomaly_type, severity FROM signals ORDER BY date_trunc('month', detected_at) DESC, signal_id DESC LIMIT 120")
def a11_pages(spark, d):
    """Signals of a month share one second and differ by microseconds; the second page follows the first one's cursor."""
    month = F.unix_micros(F.date_trunc("month", "detected_at"))
    own = written(X.signals(spark, d).withColumn("detected_at", F.timestamp_micros(month + F.rank().over(Window.partitionBy(F.date_trunc("month", "detected_at")).orderBy("signal_id")) % 1_000_000)))
    first, following = A.list_signals_page(own, 60)
    cursor = following.first()
    pages = first if cursor is None else first.unionByName(A.list_signals_page(own, 60, cursor["cursor"])[0])
    return pages.select("signal_id", "anomaly_type", "severity")


@query("s6_append_new_signals", f"{NORM} SELECT * FROM ({A3}) WHERE invoice_id::BIGINT % 4 <> 0")
def s6(spark, d):
    found = A.duplicate_invoice_signals(X.inv(spark, d))
    return brief(sinks.append_new_signals(found.where("invoice_id % 4 = 0"), found.unionByName(found)))
