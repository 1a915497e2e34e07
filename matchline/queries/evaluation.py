"""Evaluation metrics, E1 to E16. Predictions are derived from order lines by key arithmetic."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import fixtures as X
from ..operators import evaluate as E
from .base import query



def _cases(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/benchmark.parquet").select(
        F.col("item_id").alias("case_id"), F.array((F.col("item_id") % 20).cast("string")).alias("section_ids"), F.array(F.substring_index("text", " ", 4), F.substring_index("text", " ", -3)).alias("markers")
    )


def _texts(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/documents.parquet").select(F.col("doc_id").alias("chunk_id"), (F.col("doc_id") % 200).cast("string").alias("section_id"), F.coalesce("text", F.lit("")).alias("content"))


@query("e1_expected_chunks", """m AS (SELECT item_id AS case_id, lower(array_to_string(string_split(text, ' ')[1:4], ' ')) AS a, lower(array_to_string(string_split(text, ' ')[-3:], ' ')) AS b FROM benchmark)
SELECT item_id AS case_id, doc_id AS chunk_id FROM benchmark JOIN documents ON doc_id % 200 = item_id % 20 UNION SELECT case_id, doc_id FROM m JOIN documents ON contains(lower(text), a) AND contains(lower(text), b)""")
def e1(spark, d):
    return E.expected_chunks(_cases(spark, d), _texts(spark, d))


# Ranked lists: of each order its lines by line number; those with a large quantity are expected.
_RANKED = "ranked AS (SELECT po_id AS case_id, po_line_id AS chunk_id, row_number() OVER (PARTITION BY po_id ORDER BY po_line_id) AS rank, quantity > 40 AS good FROM po_line)"


def _ranked(spark, d):
    own = X.po_line(spark, d)
    return own.select(F.col("po_id").alias("case_id"), F.col("po_line_id").alias("chunk_id"), F.col("seq").alias("rank")), own.where("quantity > 40").select(F.col("po_id").alias("case_id"), F.col("po_line_id").alias("chunk_id"))


_E2 = f"""{_RANKED}, e2 AS (SELECT po_id AS case_id, count(*) FILTER (good) AS n, {", ".join(f"count(*) FILTER (good AND rank <= {k}) AS n_{k}" for k in (1, 3, 5))}, min(rank) FILTER (good) AS first FROM po LEFT JOIN ranked ON po_id = case_id GROUP BY 1),
s2 AS (SELECT case_id, {", ".join(f"CASE WHEN n > 0 THEN (n_{k} > 0)::INT::DOUBLE END AS hit_{k}, CASE WHEN n > 0 THEN round(n_{k} / n, 6) END AS recall_{k}" for k in (1, 3, 5))}, CASE WHEN n > 0 THEN round(1.0 / first, 6) END::DOUBLE AS mrr FROM e2)"""
_METRICS = ("hit_1", "recall_1", "hit_3", "recall_3", "hit_5", "recall_5", "mrr")


def _scores(spark, d):
    ranked, expected = _ranked(spark, d)
    return E.retrieval_scores(ranked, expected, X.po(spark, d).select(F.col("po_id").alias("case_id")))


@query("e2_retrieval_scores", f"{_E2} SELECT case_id, {', '.join(_METRICS)} FROM s2")
def e2(spark, d):
    return _scores(spark, d).select("case_id", *(F.round(m, 6).alias(m) for m in _METRICS))


# Answers: an order cites its lines with an odd sequence, retrieved are the first four, expected those with a large quantity.
_ANSWERS = """ans AS (SELECT po_id AS case_id, list(po_line_id) FILTER (seq % 2 = 1) AS cited, list(po_line_id) FILTER (seq <= 4) AS retrieved, list(po_line_id) FILTER (quantity > 40) AS expected, po_id % 3 AS k FROM po_line GROUP BY po_id),
full_ans AS (SELECT case_id, coalesce(cited, []) AS cited, coalesce(retrieved, []) AS retrieved, coalesce(expected, []) AS expected, k, CASE WHEN case_id % 4 = 0 THEN 'INSUFFICIENT_EVIDENCE' ELSE 'SUPPORTED' END AS status, CASE WHEN case_id % 6 = 0 THEN 'INSUFFICIENT_EVIDENCE' ELSE 'SUPPORTED' END AS expected_status FROM ans),
sc AS (SELECT *, len(list_intersect(cited, retrieved)) / nullif(len(cited), 0) AS cp, len(list_intersect(expected, cited)) / nullif(len(expected), 0) AS cr, CASE WHEN k = 0 THEN NULL WHEN k = 1 THEN 0.5 ELSE 1.0 END AS fa FROM full_ans)"""


def _answers(spark, d):
    own = X.po_line(spark, d).groupBy(F.col("po_id").alias("case_id")).agg(
        F.collect_list(F.when(F.col("seq") % 2 == 1, F.col("po_line_id"))).alias("cited"), F.collect_list(F.when(F.col("seq") <= 4, F.col("po_line_id"))).alias("retrieved"), F.collect_list(F.when(F.col("quantity") > 40, F.col("po_line_id"))).alias("expected")
    )
    k = F.col("case_id") % 3
    facts = F.when(k == 0, F.create_map().cast("map<string,string>")).when(k == 1, F.create_map(F.lit("a"), F.lit("30 days"), F.lit("b"), F.lit("none such"))).otherwise(F.create_map(F.lit("a"), F.lit("NET")))
    status = lambda n: F.when(F.col("case_id") % n == 0, "INSUFFICIENT_EVIDENCE").otherwise("SUPPORTED")
    return own.select("*", facts.alias("facts"), F.lit("Payment net 30 days.").alias("text"), status(4).alias("status"), status(6).alias("expected_status"))


@query("e3_citations", f"{_ANSWERS} SELECT case_id, round(cp, 6) AS precision, round(cr, 6) AS recall FROM sc")
def e3(spark, d):
    return _answers(spark, d).select("case_id", F.round(E.citation_precision(F.col("cited"), F.col("retrieved")), 6).alias("precision"), F.round(E.citation_recall(F.col("cited"), F.col("expected")), 6).alias("recall"))


@query("e4_fact_accuracy", f"{_ANSWERS} SELECT case_id, fa::DOUBLE AS accuracy FROM sc")
def e4(spark, d):
    return _answers(spark, d).select("case_id", E.fact_accuracy(F.col("facts"), F.col("text")).alias("accuracy"))


@query("e5_retrieval_report", f"{_E2} " + " UNION ALL ".join(f"SELECT '{m}' AS metric, round(avg({m}), 4) AS mean, count({m}) AS defined, count(*) AS total FROM s2" for m in _METRICS))
def e5(spark, d):
    return E.mean_defined(_scores(spark, d), _METRICS)


@query("e6_grounding_report", f"{_ANSWERS} SELECT round(avg((status = expected_status)::INT) FILTER (expected_status <> 'SUPPORTED'), 6) AS abstention_accuracy, round(avg((status = expected_status)::INT), 6) AS status_match_rate, round(avg(cp) FILTER (expected_status = 'SUPPORTED'), 6) AS citation_precision, round(avg(cr) FILTER (expected_status = 'SUPPORTED'), 6) AS citation_recall, round(avg(fa) FILTER (expected_status = 'SUPPORTED'), 6)::DOUBLE AS fact_accuracy FROM sc")
def e6(spark, d):
    own = E.grounding_report(_answers(spark, d))
    return own.select(*(F.round(c, 6).alias(c) for c in own.columns))


_CITE = "len(list_intersect(cited, expected))"


@query("e7_grounding_errors", f"""{_ANSWERS} SELECT case_id, unnest(list_filter([CASE WHEN status <> expected_status THEN 'STATUS_MISMATCH' END, CASE WHEN status = 'SUPPORTED' AND expected_status = 'SUPPORTED' AND coalesce(fa, 1) < 1 THEN 'INCORRECT_ANSWER' END,
CASE WHEN status = 'SUPPORTED' AND expected_status <> 'SUPPORTED' THEN 'UNSUPPORTED_ANSWER' END, CASE WHEN len(list_intersect(cited, retrieved)) < len(cited) THEN 'UNKNOWN_CITATION' END, CASE WHEN len(cited) = 0 AND len(expected) > 0 THEN 'MISSING_CITATION' END,
CASE WHEN len(cited) > 0 AND len(expected) > 0 AND {_CITE} = 0 THEN 'WRONG_CITATION' END, CASE WHEN {_CITE} > 0 AND {_CITE} < len(cited) THEN 'EXTRA_CITATION' END], lambda x: x IS NOT NULL)) AS error FROM sc""")
def e7(spark, d):
    return E.grounding_errors(_answers(spark, d))


# Fields of an invoice case, expected against predicted: one missing, one unexpected, one wrong, by key.
_FIELDS = """ex AS (SELECT invoice_id AS case_id, 'total_amount' AS field, total_amount::VARCHAR AS value FROM inv UNION ALL SELECT invoice_id, 'invoice_number', invoice_number FROM inv UNION ALL SELECT invoice_id, 'invoice_date', invoice_date::VARCHAR FROM inv WHERE invoice_id % 9 <> 0),
fs AS (SELECT case_id, field, CASE WHEN field = 'total_amount' THEN CASE WHEN case_id % 5 = 0 THEN 'incorrect' ELSE 'correct' END WHEN field = 'invoice_number' THEN CASE WHEN case_id % 7 = 0 THEN 'missing' ELSE 'correct' END ELSE 'correct' END AS outcome FROM ex
  UNION ALL SELECT invoice_id, 'invoice_date', 'unexpected' FROM inv WHERE invoice_id % 9 = 0)"""


def _fields(spark, d):
    inv, i = X.inv(spark, d), F.col("invoice_id")
    row = lambda df, f, v: df.select(i.alias("case_id"), F.lit(f).alias("field"), v.cast("string").alias("value"))
    expected = row(inv, "total_amount", F.col("total_amount")).unionByName(row(inv, "invoice_number", F.col("invoice_number"))).unionByName(row(inv.where(i % 9 != 0), "invoice_date", F.col("invoice_date")))
    amount = F.col("total_amount") + F.when(i % 5 == 0, 1).otherwise(0)
    predicted = row(inv, "total_amount", F.concat(F.lit("$"), amount.cast("string"))).unionByName(row(inv.where(i % 7 != 0), "invoice_number", F.col("invoice_number"))).unionByName(row(inv, "invoice_date", F.col("invoice_date")))
    return expected, predicted


@query("e8_field_scores", f"{_FIELDS} SELECT * FROM fs")
def e8(spark, d):
    return E.field_scores(*_fields(spark, d)).select("case_id", "field", "outcome")


_LINES = """el AS (SELECT po_id AS case_id, po_line_id AS line, 'item ' || line_number AS key FROM po_line), pl AS (SELECT po_id AS case_id, po_line_id AS line, 'item ' || CASE WHEN (po_id + seq) % 6 = 0 THEN 99 ELSE line_number END AS key FROM po_line WHERE (po_id + seq) % 8 <> 0),
en AS (SELECT *, row_number() OVER (PARTITION BY case_id, key ORDER BY line) AS n FROM el), pn AS (SELECT *, row_number() OVER (PARTITION BY case_id, key ORDER BY line) AS n FROM pl),
ml AS (SELECT coalesce(en.case_id, pn.case_id) AS case_id, en.line AS expected_line, pn.line AS predicted_line FROM en FULL JOIN pn ON en.case_id = pn.case_id AND en.key = pn.key AND en.n = pn.n)"""


def _lines(spark, d):
    own, h = X.po_line(spark, d), F.col("po_id") + F.col("seq")
    row = lambda df, n: df.select(F.col("po_id").alias("case_id"), F.col("po_line_id").alias("line_number"), F.lit(None).cast("string").alias("item_identifier"), F.concat(F.lit(" Item  "), n.cast("string")).alias("description"))
    return row(own, F.col("line_number")), row(own.where(h % 8 != 0), F.when(h % 6 == 0, 99).otherwise(F.col("line_number")))


@query("e9_match_lines", f"{_LINES} SELECT case_id, expected_line::VARCHAR AS expected_line, predicted_line::VARCHAR AS predicted_line FROM ml")
def e9(spark, d):
    return E.match_lines(*_lines(spark, d)).select("case_id", F.col("expected_line").cast("string"), F.col("predicted_line").cast("string"))


_CASE = f"""{_FIELDS}, cs AS (SELECT case_id, {", ".join(f"count(*) FILTER (outcome = '{o}') AS {o}" for o in ("correct", "missing", "incorrect", "unexpected"))} FROM fs GROUP BY 1)"""


def _case_scores(spark, d):
    fields = E.field_scores(*_fields(spark, d))
    none = X.inv(spark, d).where(F.lit(False)).select(F.col("invoice_id").alias("case_id"), F.lit(None).cast("long").alias("expected_line"), F.lit(None).cast("long").alias("predicted_line"))
    return E.case_scores(fields, none)


@query("e10_case_scores", f"""{_CASE}, {_LINES}, lp AS (SELECT case_id * 10 AS case_id, count(*) FILTER (expected_line IS NOT NULL AND predicted_line IS NOT NULL) AS lines_matched, count(*) FILTER (predicted_line IS NULL) AS lines_missing, count(*) FILTER (expected_line IS NULL) AS lines_extra FROM ml GROUP BY 1),
al AS (SELECT case_id, {", ".join(f"coalesce({c}, 0)::BIGINT AS {c}" for c in ("correct", "missing", "incorrect", "unexpected", "lines_matched", "lines_missing", "lines_extra"))} FROM cs FULL JOIN lp USING (case_id))
SELECT *, round(correct / nullif(correct + incorrect, 0), 4) AS accuracy, round(correct / nullif(correct + incorrect + missing, 0), 4) AS completeness, missing + incorrect + unexpected + lines_missing + lines_extra = 0 AS exact_match, missing + incorrect + lines_missing + lines_extra = 0 AS success FROM al""")
def e10(spark, d):
    """The lines of each order belong to the case of its first invoice."""
    pairs = E.match_lines(*_lines(spark, d)).withColumn("case_id", F.col("case_id") * 10)
    return E.case_scores(E.field_scores(*_fields(spark, d)), pairs)


@query("e11_aggregate_scores", f"{_CASE} SELECT count(*) AS cases, sum(correct)::BIGINT AS correct, sum(missing)::BIGINT AS missing, sum(incorrect)::BIGINT AS incorrect, sum(unexpected)::BIGINT AS unexpected, count(*) FILTER (missing + incorrect + unexpected = 0) AS exact, round(sum(correct) / sum(correct + incorrect), 4) AS accuracy, round(sum(correct) / sum(correct + incorrect + missing), 4) AS completeness, round(count(*) FILTER (missing + incorrect + unexpected = 0) / count(*), 4) AS exact_match FROM cs")
def e11(spark, d):
    return E.aggregate_scores(_case_scores(spark, d))


@query("e11_error_breakdown", f"{_FIELDS} SELECT CASE outcome WHEN 'missing' THEN 'MISSING_FIELD' WHEN 'unexpected' THEN 'UNEXPECTED_FIELD' ELSE 'NUMERIC_MISMATCH' END AS category, count(*) AS n FROM fs WHERE outcome <> 'correct' GROUP BY 1")
def e11_errors(spark, d):
    return E.error_breakdown(E.field_scores(*_fields(spark, d)))




@query("e12_compare_modes", "SELECT event_type AS metric, round(avg(value) FILTER (event_id % 2 = 1) - avg(value) FILTER (event_id % 2 = 0), 3) AS delta FROM events GROUP BY 1")
def e12(spark, d):
    events = spark.read.parquet(f"{d}/events.parquet")
    side = lambda k: events.where(F.col("event_id") % 2 == k).groupBy(F.col("event_type").alias("metric")).agg(F.avg("value").alias("value"))
    return E.compare_modes(side(0), side(1)).select("metric", F.round(F.col("b") - F.col("a"), 3).alias("delta"))


@query("e12_regression_failures", "SELECT c_mktsegment AS metric FROM customer GROUP BY 1 HAVING avg(c_acctbal) < 4500 OR c_mktsegment = 'HOUSEHOLD'")
def e12_floor(spark, d):
    customers = spark.read.parquet(f"{d}/customer.parquet").groupBy(F.col("c_mktsegment").alias("metric")).agg(F.avg("c_acctbal").alias("value"))
    floors = customers.select("metric", F.lit(4500.0).alias("floor"))
    return E.regression_failures(customers.where("metric <> 'HOUSEHOLD'"), floors).select("metric")


@query("e13_positional_scores", "SELECT po_id AS case_id, round(count(*) FILTER (seq % 3 <> 1 AND seq % 5 <> 1) / nullif(count(*) FILTER (seq % 5 <> 1), 0), 4) AS accuracy, round(count(*) FILTER (seq % 5 <> 1) / count(*), 4) AS completeness FROM po_line GROUP BY 1")
def e13(spark, d):
    own = X.po_line(spark, d)
    row = lambda df, v: df.select(F.col("po_id").alias("case_id"), F.col("seq").alias("line_number"), F.lit("quantity").alias("field"), v.cast("string").alias("value"))
    return E.positional_scores(row(own, F.col("quantity")), row(own.where("seq % 5 <> 1"), F.col("quantity") + F.when(F.col("seq") % 3 == 1, 1).otherwise(0)))


@query("e14_plan_metrics", """pm AS (SELECT event_id AS id, event_id % 5 <> 0 AS plan_valid, event_id % 7 <> 0 AS ok, CASE event_id % 4 WHEN 0 THEN NULL ELSE event_id % 4 = 1 END AS hit, event_id % 500 = 3 AS unsafe FROM events)
SELECT count(*) AS cases, round(100.0 * count(*) FILTER (plan_valid) / count(*), 2) AS plan_validity, round(100.0 * count(*) FILTER (ok) / count(*), 2) AS allowlist, round(100.0 * count(hit) FILTER (hit) / count(hit), 2) AS coverage, count(*) FILTER (NOT hit) AS n_failed, count(*) FILTER (unsafe OR id % 1000 = 1) AS n_unsafe FROM pm""")
def e14(spark, d):
    i = F.col("event_id")
    none = F.lit(None).cast("boolean")
    rows = spark.read.parquet(f"{d}/events.parquet").select(
        i.cast("string").alias("case_id"), (i % 5 != 0).alias("plan_valid"), (i % 7 != 0).alias("allowlist_ok"), F.lit(True).alias("parameters_valid"), F.when(i % 4 != 0, i % 4 == 1).alias("expected_action_hit"), none.alias("abstention_correct"), none.alias("grounding_ok"),
        (i % 500 == 3).alias("unsafe"), F.array(F.when(i % 1000 == 1, "DELETE_ALL").otherwise("NOTIFY_VENDOR")).alias("proposed_action_types"),
    )
    return E.plan_metrics(rows, ("DELETE_ALL",)).select("cases", "plan_validity", "allowlist", "coverage", F.size("failed").cast("long").alias("n_failed"), F.size("unsafe").cast("long").alias("n_unsafe"))


@query("e15_latency_summary", "SELECT event_type AS stage, count(*) AS n, min(value) AS least, round(median(value), 6) AS median, quantile_disc(value, 0.95) AS p95, max(value) AS most FROM events GROUP BY 1")
def e15(spark, d):
    return E.latency_summary(spark.read.parquet(f"{d}/events.parquet").select(F.col("event_type").alias("stage"), F.col("value").alias("ms"))).withColumn("median", F.round("median", 6))


@query("e16_usage_cost", "SELECT event_id, CASE WHEN event_type = 'error' THEN 'COST_UNAVAILABLE' ELSE 'ESTIMATED' END AS status, CASE WHEN event_type <> 'error' THEN round((event_id * 3 + 10 * 15) / 1000000.0, 6) END::DOUBLE AS cost FROM events")
def e16(spark, d):
    events = spark.read.parquet(f"{d}/events.parquet")
    usage = events.select("event_id", F.col("event_type").alias("model"), F.col("event_id").alias("input_tokens"), F.lit(10).alias("output_tokens"))
    prices = spark.createDataFrame([(m, 3.0, 15.0) for m in ("view", "click", "purchase", "signup")], "model string, input_price double, output_price double")
    return E.usage_cost(usage, prices).select("event_id", "status", F.round("cost", 6).alias("cost"))
