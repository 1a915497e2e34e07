"""Summaries and work lists over stored signals, exceptions, documents, reviews and plans.

Lists take the newest rows first and join names to the few rows they keep; counts are pre-aggregated per key.
"""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S


def filtered(df: DataFrame, **equal) -> DataFrame:
    """Rows whose columns equal the given values; None doesn't filter."""
    for c, v in equal.items():
        if v is not None:
            df = df.where(F.col(c) == F.lit(v))
    return df


def newest(df: DataFrame, n: int, *order: str) -> DataFrame:
    return df.orderBy(*(F.desc(c) for c in order)).limit(n)


def page(df: DataFrame, limit: int, offset: int, *order: str) -> tuple[DataFrame, DataFrame]:
    """A page, newest first, and a row with the total."""
    rows = df.orderBy(*(F.desc(c) for c in order)).offset(offset).limit(limit)
    return rows, df.agg(F.count("*").alias("total"))


def anomaly_summary(signals: DataFrame) -> DataFrame:
    """One pass over (type), (severity), (day) and all rows: kind, value, n and, for all, distinct entities."""
    own = signals.select("anomaly_type", "severity", F.date_format("detected_at", "yyyy-MM-dd").alias("day"))
    sets = own.groupingSets([["anomaly_type"], ["severity"], ["day"], []], "anomaly_type", "severity", "day").agg(F.count("*").alias("n"), F.grouping_id().alias("g"))
    counts = sets.select(
        F.when(F.col("g") == 3, "type").when(F.col("g") == 5, "severity").when(F.col("g") == 6, "day").otherwise("total").alias("kind"),
        F.coalesce("anomaly_type", "severity", "day", F.lit("all")).alias("value"),
        "n",
    )
    distinct = signals.agg(*(F.count_distinct(c).alias(n) for c, n in (("vendor_id", "vendors"), ("invoice_id", "invoices"), ("po_id", "orders"))))
    spread = F.explode(F.array(*(F.struct(F.lit("distinct").alias("kind"), F.lit(n).alias("value"), F.col(n).alias("n")) for n in ("vendors", "invoices", "orders")))).alias("e")
    return counts.unionByName(distinct.select(spread).select("e.*"))


#: log2 of a sketch's cells; the standard error of a count is about 1.04 / sqrt(cells): 0.8 %.
SKETCH_BITS = 14
ENTITIES = {"vendor_id": "vendors", "invoice_id": "invoices", "po_id": "orders"}


def daily_sketches(signals: DataFrame) -> DataFrame:
    """W1 to W3 kept per day: day, anomaly_type, severity, n and a mergeable sketch of each kind of entity.

    Days that are over don't change, so a new day is appended and no signal is read twice.
    """
    own = signals.withColumn("day", F.to_date("detected_at"))
    return own.groupBy("day", "anomaly_type", "severity").agg(F.count("*").alias("n"), *(F.hll_sketch_agg(F.col(c), F.lit(SKETCH_BITS)).alias(name) for c, name in ENTITIES.items()))


def sketched_summary(sketches: DataFrame, *by: str, since: datetime.date | None = None, until: datetime.date | None = None) -> DataFrame:
    """Counts and about how many distinct entities over a range of days (both ends in), per `by` (day, anomaly_type, severity)."""
    own = sketches
    if since is not None:
        own = own.where(F.col("day") >= F.lit(since))
    if until is not None:
        own = own.where(F.col("day") <= F.lit(until))
    return own.groupBy(*by).agg(F.sum("n").alias("n"), *(F.hll_sketch_estimate(F.hll_union_agg(name)).alias(name) for name in ENTITIES.values()))


def vendor_anomaly_summary(signals: DataFrame, as_of: datetime.date, recent_days: int = 30) -> DataFrame:
    """Per vendor totals, counts by type and severity, recent count, affected invoices and orders, and exception_rate.

    exception_rate is what the evidence (a map) of the vendor's latest REPEATED_MISMATCH states; null without one.
    """
    latest = F.when(F.col("anomaly_type") == "REPEATED_MISMATCH", F.struct("detected_at", "signal_id"))
    recent = F.col("detected_at") >= F.lit(as_of - datetime.timedelta(days=recent_days)).cast("timestamp")
    kinds = ("PRICE_VARIANCE", "QUANTITY_VARIANCE", "DUPLICATE_INVOICE", "TIMING_ANOMALY", "VENDOR_SPIKE", "REPEATED_MISMATCH")
    return signals.where("vendor_id IS NOT NULL").groupBy("vendor_id").agg(
        F.count("*").alias("total"),
        *(F.count_if(F.col("anomaly_type") == k).alias(f"n_{k.lower()}") for k in kinds),
        *(F.count_if(F.col("severity") == s).alias(f"n_{s.lower()}") for s in S.SEVERITY_SCORES),
        F.count_if(recent).alias("recent"),
        F.count_distinct("invoice_id").alias("invoices"),
        F.count_distinct("po_id").alias("orders"),
        F.max_by(F.try_element_at("evidence", F.lit("exception_rate")), latest).cast("decimal(18,4)").alias("exception_rate"),
    )


def anomaly_trends(signals: DataFrame, period: str, since: datetime.date | None = None, until: datetime.date | None = None) -> DataFrame:
    """Signals and HIGH or CRITICAL ones per period; periods without signals have no row."""
    own = signals
    if since:
        own = own.where(F.col("detected_at") >= F.lit(since).cast("timestamp"))
    if until:
        own = own.where(F.col("detected_at") < F.lit(until + datetime.timedelta(days=1)).cast("timestamp"))
    return own.groupBy(S.period_bucket("detected_at", period).alias("period")).agg(F.count("*").alias("n"), F.count_if(F.col("severity").isin("HIGH", "CRITICAL")).alias("n_severe"))


def count_map(df: DataFrame, column: str, keys: tuple[str, ...]) -> DataFrame:
    """Key and n for each of the keys, zeros included, and for 'total' (all rows)."""
    counts = df.groupBy(F.col(column).alias("key")).agg(F.count("*").alias("n"))
    wanted = df.sparkSession.range(1).select(F.explode(F.array(*(F.lit(k) for k in keys))).alias("key"))
    own = wanted.join(counts, "key", "left").select("key", F.coalesce("n", F.lit(0)).alias("n"))
    return own.unionByName(counts.agg(F.lit("total").alias("key"), F.coalesce(F.sum("n"), F.lit(0)).alias("n")))


def dashboard_summary(parts: dict[str, tuple[DataFrame, str, tuple[str, ...]]]) -> DataFrame:
    """Name -> (table, column, keys) in one long table: name, key, n."""
    out = None
    for name, (df, column, keys) in parts.items():
        rows = count_map(df, column, keys).select(F.lit(name).alias("name"), "key", "n")
        out = rows if out is None else out.unionByName(rows)
    return out


def with_numbers(exceptions: DataFrame, inv: DataFrame, po: DataFrame, grn: DataFrame) -> DataFrame:
    """Exceptions with the numbers of their invoice, order and receipt."""
    return (
        exceptions.join(inv.select("invoice_id", "invoice_number"), "invoice_id", "left")
        .join(po.select(F.col("po_id").alias("purchase_order_id"), "po_number"), "purchase_order_id", "left")
        .join(grn.select(F.col("grn_id").alias("goods_receipt_id"), "grn_number"), "goods_receipt_id", "left")
    )


def open_exceptions(exceptions: DataFrame, inv: DataFrame, po: DataFrame, grn: DataFrame, n: int) -> DataFrame:
    """The newest n that are open or in review, cut before the joins."""
    return with_numbers(newest(exceptions.where(F.col("status").isin("OPEN", "IN_REVIEW")), n, "created_at", "exception_id"), inv, po, grn)


def pending_reviews(reviews: DataFrame, files: DataFrame, n: int) -> DataFrame:
    """W7."""
    top = newest(reviews.where("status = 'PENDING'"), n, "created_at", "task_id")
    return top.drop("filename").join(files.select("document_id", "filename"), "document_id")


def recent_activity(sources: dict[str, DataFrame], k: int, n: int) -> DataFrame:
    """Kind -> (id, at); the newest k of each, then the newest n of all."""
    out = None
    for kind, df in sources.items():
        rows = newest(df.select("id", "at"), k, "at", "id").select(F.lit(kind).alias("kind"), "id", "at")
        out = rows if out is None else out.unionByName(rows)
    return newest(out, n, "at", "kind", "id")


def with_line_count(head: DataFrame, lines: DataFrame, key: str) -> DataFrame:
    counts = lines.groupBy(key).agg(F.count("*").alias("line_count"))
    return head.join(counts, key, "left").withColumn("line_count", F.coalesce("line_count", F.lit(0)))


def list_purchase_orders(po: DataFrame, po_line: DataFrame, vendors: DataFrame, vendor_id: int | None = None, query: str | None = None) -> DataFrame:
    """Orders with vendor name and number of lines; `page` cuts them."""
    own = filtered(po, vendor_id=vendor_id)
    if query:
        own = own.where(S.contains_escaped("po_number", query))
    return with_line_count(own, po_line, "po_id").join(vendors.select("vendor_id", F.col("name").alias("vendor_name")), "vendor_id", "left")


def list_goods_receipts(grn: DataFrame, grn_line: DataFrame, po: DataFrame, po_id: int | None = None, query: str | None = None) -> DataFrame:
    own = filtered(grn, po_id=po_id)
    if query:
        own = own.where(S.contains_escaped("grn_number", query))
    return with_line_count(own, grn_line, "grn_id").join(po.select("po_id", "po_number"), "po_id", "left")


def list_invoices(inv: DataFrame, inv_line: DataFrame, vendors: DataFrame, po: DataFrame, status: str | None = None, vendor_id: int | None = None, query: str | None = None) -> DataFrame:
    own = filtered(inv, status=status, vendor_id=vendor_id)
    if query:
        own = own.where(S.contains_escaped("invoice_number", query))
    named = with_line_count(own, inv_line, "invoice_id").join(vendors.select("vendor_id", F.col("name").alias("vendor_name")), "vendor_id", "left")
    return named.join(po.select("po_id", "po_number"), "po_id", "left")


def list_exceptions(exceptions: DataFrame, inv: DataFrame, po: DataFrame, grn: DataFrame, status: str | None = None, query: str | None = None, **equal) -> tuple[DataFrame, DataFrame]:
    """Rows, searched over the three numbers, and counts per status that the status filter doesn't touch."""
    own = with_numbers(filtered(exceptions, **equal), inv, po, grn)
    if query:
        own = own.where(S.contains_escaped(F.coalesce("invoice_number", F.lit("")), query) | S.contains_escaped(F.coalesce("po_number", F.lit("")), query) | S.contains_escaped(F.coalesce("grn_number", F.lit("")), query))
    return filtered(own, status=status), own.groupBy("status").agg(F.count("*").alias("n"))


def list_plans(plans: DataFrame, exceptions: DataFrame, actions: DataFrame, status: str | None = None, exception_id: int | None = None) -> DataFrame:
    """Plans with type and message of their exception and the number of their actions."""
    counts = actions.groupBy("plan_id").agg(F.count("*").alias("action_count"))
    named = exceptions.select("exception_id", "exception_type", F.col("message").alias("exception_message"))
    own = filtered(plans, status=status, exception_id=exception_id)
    return own.join(named, "exception_id", "left").join(counts, "plan_id", "left").withColumn("action_count", F.coalesce("action_count", F.lit(0)))


def list_documents(files: DataFrame, reviews: DataFrame, status: str | None = None, review_status: str | None = None, results: DataFrame | None = None, outcome: str | None = None) -> DataFrame:
    """Documents by own status, and by that of any review or extraction result, each once."""
    own = filtered(files, status=status)
    if review_status:
        own = own.join(reviews.where(F.col("status") == review_status), "document_id", "left_semi")
    if outcome and results is not None:
        own = own.join(results.where(F.col("outcome") == outcome), "document_id", "left_semi")
    return own


def related_invoice_summary(inv: DataFrame) -> DataFrame:
    """Per order the number of matched, problem and pending invoices, and a sentence."""
    own = inv.where("po_id IS NOT NULL").groupBy("po_id").agg(F.count("*").alias("n"), F.count_if(F.col("status") == "MATCHED").alias("matched"), F.count_if(F.col("status") == "EXCEPTION").alias("problems"))
    own = own.withColumn("pending", F.col("n") - F.col("matched") - F.col("problems"))
    part = lambda c, one, many: F.when(F.col(c) == 1, one).when(F.col(c) > 1, F.concat(F.col(c).cast("string"), F.lit(many)))
    said = F.concat_ws(", ", part("matched", "1 matched", " matched"), part("problems", "1 with a problem", " with problems"), part("pending", "1 not matched yet", " not matched yet"))
    return own.withColumn("summary", F.concat(F.col("n").cast("string"), F.when(F.col("n") == 1, " related invoice — ").otherwise(" related invoices — "), said))


def document_facts(files: DataFrame, results: DataFrame, reviews: DataFrame, inv: DataFrame, po: DataFrame, grn: DataFrame) -> DataFrame:
    """What is known of each document and its order.

    files(document_id, document_type, purchase_order_id, goods_receipt_id, invoice_id), results(document_id,
    detected_type, outcome, po_number, ambiguity_summary; one per document). An order is linked, or named by the
    result. Only orders and receipts without an invoice of their own speak of the invoices related to their order.
    """
    latest = reviews.groupBy("document_id").agg(F.max_by("status", F.struct("created_at", "task_id")).alias("review_status"))
    read = results.select("document_id", "detected_type", F.col("outcome").alias("extraction_outcome"), F.nullif(F.trim("po_number"), F.lit("")).alias("po_number"), "ambiguity_summary")
    named = po.groupBy("po_number").agg(F.min("po_id").alias("_named"))
    own_invoice = inv.select("invoice_id", "invoice_number", F.col("status").alias("_status"), F.lit(True).alias("_own"))
    received = grn.where("po_id IS NOT NULL").select("po_id").distinct()
    related = related_invoice_summary(inv).select(F.col("po_id").alias("_order"), F.col("summary").alias("_summary"))
    own = files.select("document_id", "document_type", "purchase_order_id", "goods_receipt_id", "invoice_id").join(read, "document_id", "left").join(latest, "document_id", "left")
    own = own.join(named, "po_number", "left").join(own_invoice, "invoice_id", "left").withColumn("_order", F.coalesce("purchase_order_id", "_named")).join(related, "_order", "left")
    for order, seen in (("purchase_order_id", "_got_linked"), ("_named", "_got_named")):
        own = own.join(received.select(F.col("po_id").alias(order), F.lit(True).alias(seen)), order, "left")
    mine = F.coalesce("_own", F.lit(False))
    told = F.when(~mine & F.coalesce("detected_type", "document_type").isin("PO", "GRN"), F.col("_summary"))
    return own.select(
        "document_id", "detected_type", "extraction_outcome", "review_status", "po_number",
        F.coalesce("purchase_order_id", "_named").isNotNull().alias("purchase_order_ready"),
        (F.col("goods_receipt_id").isNotNull() | F.coalesce("_got_linked", "_got_named", F.lit(False))).alias("goods_receipt_ready"),
        (mine | told.isNotNull()).alias("invoice_ready"),
        F.when(mine, F.col("invoice_number")).alias("invoice_number"),
        F.when(mine & F.col("_status").isin("MATCHED", "EXCEPTION"), F.col("_status")).alias("reconciliation_status"),
        told.alias("related_invoice_summary"),
        "ambiguity_summary",
    )


def review_queue(reviews: DataFrame, limit: int, offset: int = 0, query: str | None = None, **equal) -> tuple[DataFrame, DataFrame]:
    """A page of tasks by status, document_type, priority and file name, newest first, and a row with their total."""
    own = filtered(reviews, **equal)
    return page(own.where(S.contains_escaped("filename", query)) if query else own, limit, offset, "created_at", "task_id")


def policy_library(documents: DataFrame, versions: DataFrame, chunks: DataFrame, status: str | None = None) -> DataFrame:
    """All documents with their versions (by effective_from, label) and chunk counts; with a status, those that have such a version.

    documents(policy_document_id), versions(policy_version_id, policy_document_id, status, label, effective_from).
    Documents without versions and versions without chunks count 0.
    """
    counts = chunks.groupBy("policy_version_id").agg(F.count("*").alias("n"))
    own = versions.join(counts, "policy_version_id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    listed = F.array_sort(F.collect_list(F.struct("effective_from", "label", "policy_version_id", "status", "n")))  # versions of one document
    grouped = own.groupBy("policy_document_id").agg(F.count("*").alias("version_count"), F.sum("n").alias("chunk_count"), listed.alias("versions"))
    out = documents.join(grouped, "policy_document_id", "left").withColumns({"version_count": F.coalesce("version_count", F.lit(0)), "chunk_count": F.coalesce("chunk_count", F.lit(0))})
    return out.where(F.exists("versions", lambda v: v["status"] == status)) if status else out


def audit_trail(events: DataFrame, key: str = "plan_id", order: tuple[str, ...] = ("created_at", "event_id")) -> DataFrame:
    """Place of each event among its plan's or action's."""
    return events.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy(*order)))


def latest_approval(actions: DataFrame, approvals: DataFrame) -> DataFrame:
    """Each action's newest decision; blocked unless that approves."""
    newest_ = approvals.groupBy("action_id").agg(F.max_by("decision", F.struct("created_at", "decided_at", "approval_id")).alias("decision"))
    return actions.join(newest_, "action_id", "left").withColumn("blocked", ~F.coalesce(F.col("decision") == "APPROVED", F.lit(False)))


#: Statuses that decisions don't change.
SETTLED_PLANS = ("CANCELLED", "COMPLETED", "EXECUTING", "NO_ACTION_RECOMMENDED")
FINAL_PLANS = ("REJECTED", "COMPLETED", "CANCELLED", "NO_ACTION_RECOMMENDED")


def plan_status(plans: DataFrame, actions: DataFrame, stage: str) -> DataFrame:
    """new_status, which a plan's actions give it after their execution or after decisions; settled plans stay."""
    some = lambda s: F.bool_or(F.col("action_status") == s)
    every = lambda *s: F.bool_and(F.col("action_status").isin(*s))
    own, waiting = actions.select("plan_id", F.col("status").alias("action_status")), F.col("status").isin("PROPOSED", "APPROVAL_REQUIRED")
    if stage == "execution":
        ladder = F.when(some("EXECUTING"), "EXECUTING").when(some("PENDING"), "APPROVAL_REQUIRED").when(some("FAILED"), "FAILED").when(every("REJECTED", "CANCELLED"), "REJECTED").when(every("COMPLETED", "REJECTED", "CANCELLED"), "COMPLETED").when(some("APPROVED"), "APPROVED")
        change = ~F.col("status").isin(*FINAL_PLANS) & F.col("derived").isNotNull()
    elif stage == "decision":
        ladder = F.when(some("PENDING"), "APPROVAL_REQUIRED").when(some("REJECTED") & ~some("APPROVED"), "REJECTED").when(some("APPROVED"), "APPROVED")
        change = ~F.col("status").isin(*SETTLED_PLANS) & ((F.col("derived") == "REJECTED") | (F.col("derived").isNotNull() & waiting))
    else:
        raise ValueError(f"unknown stage {stage!r}")
    derived = own.groupBy("plan_id").agg(ladder.alias("derived"))
    return plans.join(derived, "plan_id", "left").withColumn("new_status", F.when(F.coalesce(change, F.lit(False)), F.col("derived")).otherwise(F.col("status"))).drop("derived")


def blocked_actions(actions: DataFrame) -> DataFrame:
    """Whether an earlier action of the plan is neither completed, rejected nor cancelled."""
    before = Window.partitionBy("plan_id").orderBy("action_order").rangeBetween(Window.unboundedPreceding, -1)
    open_ = (~F.col("status").isin("COMPLETED", "REJECTED", "CANCELLED")).cast("int")
    return actions.withColumn("blocked", F.coalesce(F.max(open_).over(before) == 1, F.lit(False)))


#: Allowed changes of status.
TRANSITIONS = {
    "review": {"PENDING": ("IN_REVIEW", "APPROVED", "CORRECTED", "REJECTED"), "IN_REVIEW": ("APPROVED", "CORRECTED", "REJECTED"), "CORRECTED": ("APPROVED",)},
    "action": {"PENDING": ("APPROVED", "REJECTED", "CANCELLED", "EXECUTING"), "APPROVED": ("EXECUTING", "CANCELLED"), "EXECUTING": ("COMPLETED", "FAILED"), "FAILED": ("EXECUTING",)},
    "plan": {
        "PROPOSED": ("APPROVAL_REQUIRED", "APPROVED", "REJECTED", "CANCELLED"),
        "APPROVAL_REQUIRED": ("APPROVED", "REJECTED", "EXECUTING", "CANCELLED"),
        "APPROVED": ("EXECUTING", "CANCELLED"),
        "EXECUTING": ("COMPLETED", "FAILED", "CANCELLED", "APPROVED", "APPROVAL_REQUIRED"),
        "FAILED": ("EXECUTING", "APPROVED", "APPROVAL_REQUIRED", "COMPLETED"),
    },
    "execution": {"PENDING": ("RUNNING", "FAILED"), "RUNNING": ("SUCCEEDED", "FAILED")},
}


def illegal_transitions(history: DataFrame, kind: str = "review", order: tuple[str, ...] = ("ts", "event_id")) -> DataFrame:
    """Consecutive statuses of an entity that the table doesn't allow (staying the same is no change)."""
    before = F.lag("status").over(Window.partitionBy("entity_id").orderBy(*order))
    allowed = F.lit(False)
    for old, new in TRANSITIONS[kind].items():
        allowed = allowed | ((F.col("previous") == old) & F.col("status").isin(*new))
    return history.withColumn("previous", before).where(F.col("previous").isNotNull() & (F.col("previous") != F.col("status")) & ~allowed)


def duplicate_executions(executions: DataFrame) -> DataFrame:
    """Keys used by several actions, and actions with several active or succeeded runs."""
    shared = executions.groupBy("idempotency_key").agg(F.count_distinct("action_id").alias("n")).where("n > 1").select(F.lit("shared_key").alias("violation"), F.col("idempotency_key").alias("subject"), "n")
    live = executions.where(F.col("status").isin("PENDING", "RUNNING", "SUCCEEDED")).groupBy("action_id").agg(F.count("*").alias("n")).where("n > 1")
    return shared.unionByName(live.select(F.lit("several_runs").alias("violation"), F.col("action_id").cast("string").alias("subject"), "n"))


def altered_parameters(actions: DataFrame) -> DataFrame:
    """actions(parameters, approved_hash) whose parameters' hash has changed since approval."""
    own = actions.withColumn("current_hash", S.parameters_hash("parameters"))
    return own.where(F.col("approved_hash").isNotNull() & (F.col("approved_hash") != F.col("current_hash")))


def job_counts(jobs: DataFrame) -> DataFrame:
    """W24."""
    return jobs.groupBy("status").agg(F.count("*").alias("n"))


def list_scans(scans: DataFrame, limit: int, offset: int = 0, **equal) -> tuple[DataFrame, DataFrame]:
    """W25."""
    return page(filtered(scans, **equal), limit, offset, "requested_at", "scan_id")


def plan_history(actions: DataFrame, approvals: DataFrame, executions: DataFrame, plans: DataFrame, groundings: DataFrame) -> DataFrame:
    """Approvals and executions of a plan's actions and grounding results of its exception, with their place in time."""
    of = actions.select("action_id", "plan_id")
    event = lambda df, kind, key, at: df.select("plan_id", F.lit(kind).alias("kind"), F.col(key).alias("id"), F.col(at).alias("at"))
    rows = event(approvals.join(of, "action_id"), "approval", "approval_id", "created_at").unionByName(event(executions.join(of, "action_id"), "execution", "execution_id", "started_at"))
    rows = rows.unionByName(event(groundings.select("grounding_id", "exception_id", F.col("created_at").alias("grounded_at")).join(plans.select("plan_id", "exception_id"), "exception_id"), "grounding", "grounding_id", "grounded_at"))
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("plan_id").orderBy("at", "kind", "id")))


def check_plan_actions(proposed: DataFrame, required: dict[str, tuple[str, ...]], longest: int = 500) -> DataFrame:
    """proposed(plan_id, position, action_order, action_type, parameters map) with error, and new_order of valid rows.

    required: the parameters that each known action type needs.
    """
    alone = Window.partitionBy("plan_id")
    missing = F.lit(False)
    for kind, names in required.items():
        for name in names:
            missing = missing | ((F.col("action_type") == kind) & (F.trim(F.coalesce(F.element_at("parameters", name), F.lit(""))) == ""))
    too_long = F.exists(F.map_values("parameters"), lambda v: F.length(v) > longest)
    own = proposed.withColumn("_n", F.count("*").over(alone)).withColumn("_none", F.bool_or(F.col("action_type") == "NO_ACTION").over(alone))
    error = F.when(~F.col("action_type").isin("NO_ACTION", *required), "unknown_type").when(F.col("_none") & (F.col("_n") > 1), "no_action_with_actions").when(missing, "missing_parameter").when(F.coalesce(too_long, F.lit(False)), "parameter_too_long")
    own = own.withColumn("error", error).drop("_n", "_none")
    place = F.row_number().over(Window.partitionBy("plan_id", F.col("error").isNull()).orderBy("action_order", "position"))
    return own.withColumn("new_order", F.when(F.col("error").isNull(), place - 1))
