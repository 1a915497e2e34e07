"""Scalar functions (N1 to N21) over key-derived texts, and intake."""

from __future__ import annotations

import datetime

from pyspark.sql import functions as F

from .. import fixtures as X
from ..functions import helpers as U
from ..functions import scalars as S
from ..sources import tables as T
from .base import query

_NN = "trim(regexp_replace(regexp_replace(lower(trim(invoice_number)), '[\\s_]+', '-', 'g'), '-{2,}', '-', 'g'), '-')"


@query("n1_normalize_invoice_number", f"SELECT invoice_id, {_NN} AS norm FROM inv")
def n1(spark, d):
    return X.inv(spark, d).select("invoice_id", S.normalize_invoice_number("invoice_number").alias("norm"))


@query("n2_fingerprint", "SELECT invoice_id, sha256('X|' || invoice_id || '|' || coalesce(po_id::VARCHAR, '') || '|' || invoice_date) AS fingerprint FROM inv")
def n2(spark, d):
    return X.inv(spark, d).select("invoice_id", S.fingerprint("X", F.col("invoice_id"), F.col("po_id"), F.col("invoice_date")).alias("fingerprint"))


_PAIR = "pair AS (SELECT l.invoice_line_id, p.unit_price AS e, l.unit_price AS a, p.quantity AS eq, l.quantity AS aq FROM inv_line l JOIN po_line p ON p.po_line_id = l.po_line_id)"


def _pair(spark, d):
    base = X.po_line(spark, d).select("po_line_id", F.col("unit_price").alias("e"), F.col("quantity").alias("eq"))
    return X.inv_line(spark, d).select("invoice_line_id", "po_line_id", F.col("unit_price").alias("a"), F.col("quantity").alias("aq")).join(base, "po_line_id")


@query("n3_percent_variance", f"{_PAIR} SELECT invoice_line_id, round(CASE WHEN e = 0 THEN CASE WHEN a = 0 THEN 0.0 ELSE 100.0 END ELSE abs(a::DOUBLE - e::DOUBLE) / abs(e::DOUBLE) * 100 END, 4) AS variance FROM pair")
def n3(spark, d):
    return _pair(spark, d).select("invoice_line_id", F.round(S.percent_variance("e", "a"), 4).alias("variance"))


@query("n4_exceeds", f"{_PAIR} SELECT invoice_line_id, (e = 0 AND a <> 0) OR (e <> 0 AND abs(a - e) * 100 > 10 * abs(e)) AS by_percent, aq - eq > 1 AS by_quantity FROM pair")
def n4(spark, d):
    return _pair(spark, d).select("invoice_line_id", S.exceeds_percent("e", "a", 10).alias("by_percent"), S.exceeds_quantity("aq", "eq", 1).alias("by_quantity"))


@query("n5_severity", f"{_PAIR} SELECT invoice_line_id, CASE WHEN (e = 0 AND a <> 0) OR (e <> 0 AND abs(a - e) * 100 >= 50 * e) THEN 'CRITICAL' WHEN e <> 0 AND abs(a - e) * 100 >= 25 * e THEN 'HIGH' WHEN e <> 0 AND abs(a - e) * 100 >= 10 * e THEN 'MEDIUM' WHEN e <> 0 AND abs(a - e) * 100 >= 5 * e THEN 'LOW' END AS severity, CASE WHEN aq >= 5 THEN 'CRITICAL' WHEN aq >= 3 THEN 'HIGH' WHEN aq >= 2 THEN 'MEDIUM' END AS by_ratio FROM pair")
def n5(spark, d):
    return _pair(spark, d).select("invoice_line_id", S.severity_percent("e", "a").alias("severity"), S.severity_ratio("aq").alias("by_ratio"))


@query("n6_severity_score", "SELECT signal_id, (CASE severity WHEN 'LOW' THEN 0.25 WHEN 'MEDIUM' THEN 0.5 WHEN 'HIGH' THEN 0.75 ELSE 1.0 END)::DOUBLE AS score FROM signals")
def n6(spark, d):
    return X.signals(spark, d).select("signal_id", S.severity_score("severity").cast("double").alias("score"))


@query("n7_explain_signal", "SELECT invoice_id, CASE WHEN invoice_id % 2 = 0 THEN '7.5 is 2.5x' ELSE 'is ' || invoice_id % 90 || ' days after' END AS said FROM inv")
def n7(spark, d):
    i = F.col("invoice_id")
    spike = F.create_map(F.lit("current_value"), F.lit("7.5"), F.lit("ratio"), F.lit("2.5"), F.lit("baseline_average"), F.lit("3"), F.lit("historical_invoice_count"), F.lit("4"))
    late = F.create_map(F.lit("timing_kind"), F.lit("long_po_to_invoice_delay"), F.lit("delay_days"), (i % 90).cast("string"), F.lit("threshold_days"), F.lit("30"))
    own = X.inv(spark, d).select("invoice_id", F.when(i % 2 == 0, "VENDOR_SPIKE").otherwise("TIMING_ANOMALY").alias("kind"), F.when(i % 2 == 0, spike).otherwise(late).alias("evidence"))
    _, sentence = S.explain_signal("kind", "evidence")
    return own.select("invoice_id", F.regexp_extract(sentence, r"(7.5 is 2.5x|is \d+ days after)", 1).alias("said"))


#: Texts by po_id % 8, with the DuckDB value of each normaliser beside.
_TEXTS = ["'  A  B\tc '", "'N/A'", "'not  provided'", "''", "NULL", "'--'", "'PO-' || po_id", "' none'"]


def _texts(spark, d, values):
    return X.po(spark, d).select("po_id", F.element_at(F.array(*(F.expr(v.replace("||", "||")) if v != "NULL" else F.lit(None).cast("string") for v in values)), (F.col("po_id") % len(values) + 1).cast("int")).alias("x"))


def _case(values, column="po_id"):
    return f"CASE {column} % {len(values)} " + " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(values)) + " END"


@query("n8_business_value", f"SELECT po_id, {_case(["'A B c'", "NULL", "NULL", "NULL", "NULL", "NULL", "'PO-' || po_id", "NULL"])} AS value FROM po")
def n8(spark, d):
    return _texts(spark, d, _TEXTS).select("po_id", S.normalize_business_value("x").alias("value"))


_MONEY = ["po_id || ',000.50'", "'$ ' || po_id", "'(' || po_id || ')'", "'12.3.4'", "'abc'", "''", "'€1,2'"]


@query("n9_money", f"SELECT po_id, {_case(["po_id * 1000 + 0.5", "po_id", "-po_id", "NULL", "NULL", "NULL", "12"])}::DOUBLE AS value FROM po")
def n9(spark, d):
    return _texts(spark, d, _MONEY).select("po_id", S.normalize_money("x").cast("double").alias("value"))


@query("n10_quantity", f"SELECT po_id, {_case(["po_id * 1000 + 0.5", "NULL", "NULL", "NULL", "NULL", "NULL", "NULL"])}::DOUBLE AS value FROM po")
def n10(spark, d):
    return _texts(spark, d, _MONEY).select("po_id", S.normalize_quantity("x").cast("double").alias("value"))


_PERCENT = ["(po_id % 100 + 2) || ' %'", "'0.18'", "'-3%'", "'1'", "'x%'"]


@query("n11_percentage", f"SELECT po_id, round(({_case(["(po_id % 100 + 2) / 100.0", "0.18", "NULL", "1", "NULL"])})::DOUBLE, 6) AS value FROM po")
def n11(spark, d):
    return _texts(spark, d, _PERCENT).select("po_id", F.round(S.normalize_percentage("x").cast("double"), 6).alias("value"))


_FORMATS = ("yyyy-MM-dd", "dd-MM-yyyy", "d/M/yyyy", "yyyy/MM/dd", "dd/MM/yy", "'on' yyyy")


@query("n12_date", f"SELECT po_id, CASE WHEN po_id % {len(_FORMATS)} < {len(_FORMATS) - 1} THEN order_date END AS value FROM po")
def n12(spark, d):
    text = F.element_at(F.array(*(F.date_format("order_date", f) for f in _FORMATS)), (F.col("po_id") % len(_FORMATS) + 1).cast("int"))
    return X.po(spark, d).select("po_id", S.normalize_date(text).alias("value"))


@query("n13_contains_escaped", "SELECT invoice_id, contains(lower(invoice_number), 'v_0') AS hit FROM inv")
def n13(spark, d):
    return X.inv(spark, d).select("invoice_id", S.contains_escaped("invoice_number", "V_0").alias("hit"))


@query("n14_drop_sensitive_keys", "SELECT event_id, 'note=' || event_id AS kept, CASE WHEN event_id % 2 = 0 THEN '{\"a\":[{\"b\":1}]}' ELSE '{\"c\":2}' END AS nested FROM events")
def n14(spark, d):
    e = F.col("event_id")
    own = spark.read.parquet(f"{d}/events.parquet").select(
        "event_id",
        F.create_map(F.lit("note"), e.cast("string"), F.lit("API_Key"), F.lit("x"), F.lit("refreshToken"), F.lit("y")).alias("m"),
        F.when(e % 2 == 0, '{"a":[{"b":1,"password":"p"}],"Secret":{"x":1}}').otherwise('{"c":2,"my_credential_id":"z"}').alias("j"),
    )
    flat = F.array_join(F.transform(F.map_entries(S.drop_sensitive_keys("m")), lambda x: F.concat_ws("=", x["key"], x["value"])), ",")
    return own.select("event_id", flat.alias("kept"), U.sanitize_json("j").alias("nested"))


@query("n15_hashes", """SELECT doc_id, sha256(coalesce(text, '')) AS content, sha256('{"a":"' || doc_id || '","b":"x"}') AS parameters FROM documents""")
def n15(spark, d):
    params = F.create_map(F.lit("b"), F.lit("x"), F.lit("a"), F.col("doc_id").cast("string"))
    return spark.read.parquet(f"{d}/documents.parquet").select("doc_id", S.content_sha256(F.coalesce("text", F.lit(""))).alias("content"), S.parameters_hash(params).alias("parameters"))


@query("n16_period_bucket", "SELECT signal_id, strftime(detected_at, '%Y-%m-%d') AS day, isoyear(detected_at) || '-W' || lpad(week(detected_at)::VARCHAR, 2, '0') AS week, strftime(detected_at, '%Y-%m') AS month FROM signals")
def n16(spark, d):
    return X.signals(spark, d).select("signal_id", S.period_bucket("detected_at", "daily").alias("day"), S.period_bucket("detected_at", "weekly").alias("week"), S.period_bucket("detected_at", "monthly").alias("month"))


@query("n17_recency", "SELECT signal_id, n::BIGINT AS days, (CASE WHEN n <= 30 THEN 1.0 WHEN n <= 90 THEN 0.75 WHEN n <= 180 THEN 0.5 ELSE 0.25 END)::DOUBLE AS multiplier FROM (SELECT signal_id, greatest(date_diff('day', detected_at::DATE, DATE '1999-06-30'), 0) AS n FROM signals)")
def n17(spark, d):
    days = S.days_since("detected_at", F.lit(datetime.date(1999, 6, 30)))
    return X.signals(spark, d).select("signal_id", days.cast("long").alias("days"), S.recency_multiplier(days).cast("double").alias("multiplier"))


@query("n18_score_and_band", "SELECT po_id, s::BIGINT AS score, CASE WHEN s >= 75 THEN 'CRITICAL' WHEN s >= 50 THEN 'HIGH' WHEN s >= 25 THEN 'MEDIUM' ELSE 'LOW' END AS band FROM (SELECT po_id, least(100, (po_id % 250 * 200 + 180) // 360) AS s FROM po)")
def n18(spark, d):
    score = S.normalize_score((F.col("po_id") % 250).cast("decimal(18,4)"))
    return X.po(spark, d).select("po_id", score.cast("long").alias("score"), S.band_for_score(score).alias("band"))


@query("n19_evaluation_normalizers", f"SELECT po_id, 'acme ' || po_id AS name, 'USD' AS currency, (po_id * 1000 + 0.5)::DOUBLE AS amount, CASE WHEN po_id % 2 = 0 OR day(order_date) > 12 THEN order_date END AS day FROM po")
def n19(spark, d):
    i = F.col("po_id").cast("string")
    day = F.when(F.col("po_id") % 2 == 0, F.date_format("order_date", "yyyy-MM-dd")).otherwise(F.date_format("order_date", "dd/MM/yyyy"))
    return X.po(spark, d).select("po_id", S.eval_name(F.concat(F.lit("  ACME \t"), i)).alias("name"), S.eval_currency(F.lit("usd 1")).alias("currency"), S.eval_decimal(F.concat(F.lit("$"), i, F.lit(",000.50"))).cast("double").alias("amount"), S.eval_date(day).alias("day"))


@query("n20_vectors", "SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: (x::DOUBLE) * x)), 4) AS squared, round(1 - least(1, greatest(-1, list_sum(list_transform(embedding, lambda x: x::DOUBLE * x)) / nullif(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x)), 0))), 4) AS distance FROM embeddings")
def n20(spark, d):
    own = spark.read.parquet(f"{d}/embeddings.parquet").withColumn("unit", S.l2_normalize("embedding"))
    squared = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x)
    return own.select("vec_id", F.round(squared, 4).alias("squared"), F.round(F.abs(S.cosine_distance("unit", "unit")), 4).alias("distance"))


@query(
    "n21_cursors",
    """SELECT signal_id, replace(replace(to_base64((strftime(ts, '%Y-%m-%dT%H:%M:%S') || CASE WHEN signal_id % 3 = 0 THEN '' ELSE '.' || lpad((signal_id % 3 * 1000 + 7)::VARCHAR, 6, '0') END || '+00:00|' || signal_id)::BLOB), '+', '-'), '/', '_') AS cursor,
    signal_id::VARCHAR AS key FROM (SELECT signal_id, detected_at AS ts FROM signals)""",
)
def n21(spark, d):
    """Two of three instants have a fraction of a second."""
    third = F.col("signal_id") % 3
    at = F.timestamp_micros(F.unix_micros("detected_at") + F.when(third == 0, 0).otherwise(third * 1000 + 7))
    own = X.signals(spark, d).withColumn("cursor", S.encode_cursor(at, "signal_id"))
    return own.select("signal_id", "cursor", S.decode_cursor("cursor")["key"].alias("key"))


@query("s1_typed_tables", "SELECT po_line_id, round(quantity::DOUBLE, 4) AS quantity, round(tax_rate::DOUBLE, 4) AS tax_rate, NULL::VARCHAR AS description FROM po_line")
def s1(spark, d):
    return T.typed(X.po_line(spark, d), "po_line").select("po_line_id", F.round(F.col("quantity").cast("double"), 4).alias("quantity"), F.round(F.col("tax_rate").cast("double"), 4).alias("tax_rate"), "description")


@query("s2_scope_tenant", "SELECT po_id, po_number FROM po WHERE coalesce(CASE WHEN po_id % 3 <> 0 THEN 't' || po_id % 3 END, 't2') = 't2'")
def s2(spark, d):
    own = X.po(spark, d).withColumn("tenant_id", F.when(F.col("po_id") % 3 != 0, F.concat(F.lit("t"), (F.col("po_id") % 3).cast("string"))))
    return T.scope_tenant(T.stamp_tenant(own, "t2"), "t2").select("po_id", "po_number")


@query("s3_validate_intake", """SELECT document_id, CASE document_id % 5 WHEN 3 THEN 'x.png' ELSE filename END AS safe_name, CASE WHEN strlen(coalesce(content, '')) = 0 THEN 'empty' WHEN strlen(content) > 20000 THEN 'too_large' WHEN document_id % 5 = 4 THEN 'extension' WHEN document_id % 5 = 3 THEN 'mime' END AS error FROM files""")
def s3(spark, d):
    return T.validate_intake(X.files(spark, d), 20_000).select("document_id", "safe_name", "error")


@query("s4_dedupe_content", "SELECT document_id, CASE WHEN first <> document_id THEN first::VARCHAR END AS duplicate_of FROM (SELECT document_id, min(document_id) OVER (PARTITION BY sha256(content)) AS first FROM files)")
def s4(spark, d):
    own = X.files(spark, d).withColumn("tenant_id", F.lit("t1"))
    return T.dedupe_content(own).select("document_id", F.col("duplicate_of").cast("string").alias("duplicate_of"))
