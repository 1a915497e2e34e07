"""Anomaly signals of all invoices and vendors in one job. All signals have the columns of `SIGNAL`."""

from __future__ import annotations

import datetime
import functools
from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions.folds import folded
from ..sources.stored import scratch, written
from .reconcile import Tables

SIGNAL = ("anomaly_type", "severity", "score", "vendor_id", "po_id", "invoice_id", "grn_id", "evidence", "fingerprint")


@dataclass(frozen=True)
class Config:
    percent_steps: tuple = S.PERCENT_STEPS
    spike_steps: tuple = S.RATIO_STEPS
    rate_steps: tuple = S.RATE_STEPS
    spike_history: int = 3
    mismatch_history: int = 5
    window_days: int = 90
    long_delay_days: int = 30


def _signal(df: DataFrame, kind: str, severity: Column | str, parts: list, evidence: dict[str, Column], vendor: str | None = "vendor_id", po: str | None = None, invoice: str | None = None, grn: str | None = None) -> DataFrame:
    ident = lambda c: F.col(c) if c else F.lit(None).cast("long")
    level = F.lit(severity) if isinstance(severity, str) else severity
    pairs = [x for k, v in evidence.items() for x in (F.lit(k), v.cast("string"))]
    return df.select(
        F.lit(kind).alias("anomaly_type"), level.alias("severity"), S.severity_score(level).alias("score"), ident(vendor).alias("vendor_id"), ident(po).alias("po_id"), ident(invoice).alias("invoice_id"), ident(grn).alias("grn_id"),
        F.create_map(*pairs).alias("evidence"), S.fingerprint(kind, *parts).alias("fingerprint"),
    )


def _line_signals(t: Tables, column: str, kind: str, config: Config, names: tuple[str, str]) -> DataFrame:
    """Lines linked by key to a line of their invoice's own order; no fallback to line numbers."""
    lines = t.inv_line.where("po_line_id IS NOT NULL AND po_id IS NOT NULL").select("invoice_line_id", "invoice_id", "po_id", "po_line_id", "line_number", F.col(column).alias("actual"))
    base = t.po_line.select("po_line_id", F.col("po_id").alias("owner"), F.col(column).alias("expected"))
    joined = lines.join(base, "po_line_id").where("owner = po_id").withColumn("severity", S.severity_percent("expected", "actual", config.percent_steps)).where("severity IS NOT NULL")
    own = joined.join(t.inv.select("invoice_id", "vendor_id"), "invoice_id")
    evidence = {names[0]: F.col("expected"), names[1]: F.col("actual"), "variance_amount": F.abs(F.col("actual") - F.col("expected")), "variance_percent": F.bround(S.percent_variance("expected", "actual"), 2), "purchase_order_line_id": F.col("po_line_id"), "invoice_line_id": F.col("invoice_line_id"), "line_number": F.col("line_number")}
    return _signal(own, kind, F.col("severity"), [F.col("vendor_id"), F.col("invoice_id"), F.col("invoice_line_id"), F.col("po_line_id")], evidence, po="po_id", invoice="invoice_id")


def price_variance_signals(t: Tables, config: Config = Config()) -> DataFrame:
    """A1."""
    return _line_signals(t, "unit_price", "PRICE_VARIANCE", config, ("po_unit_price", "invoice_unit_price"))


def quantity_variance_signals(t: Tables, config: Config = Config()) -> DataFrame:
    """A2: 0 against 0 is no variance, 0 against more is 100 %."""
    return _line_signals(t, "quantity", "QUANTITY_VARIANCE", config, ("expected_quantity", "invoiced_quantity"))


def duplicate_invoice_signals(inv: DataFrame) -> DataFrame:
    """A3: one signal for each vendor and normalized number with two invoices or more, in the row of the smallest id.

    Groups are counted before any id is looked at; the ids of groups of two and more are joined as sorted rows stream by.
    """
    own = inv.select("vendor_id", S.normalize_invoice_number("invoice_number").alias("norm"), "invoice_id", "po_id")
    many = own.groupBy("vendor_id", "norm").agg(F.count("*").alias("n"), F.min("invoice_id").alias("invoice_id"), F.min_by("po_id", "invoice_id").alias("po_id")).where("n > 1")
    members = own.select(F.col("vendor_id").alias("v"), F.col("norm").alias("m"), F.col("invoice_id").cast("string").alias("id"))
    members = many.join(members, F.col("vendor_id").eqNullSafe(F.col("v")) & F.col("norm").eqNullSafe(F.col("m"))).drop("v", "m")
    groups = folded(members, ["vendor_id", "norm"], "id", "text")
    evidence = {"vendor_id": F.col("vendor_id"), "normalized_invoice_number": F.col("norm"), "invoice_ids": F.col("folded"), "duplicate_count": F.col("n")}
    return _signal(groups, "DUPLICATE_INVOICE", "HIGH", [F.col("vendor_id"), F.col("norm")], evidence, po="po_id", invoice="invoice_id")


def timing_signals(po: DataFrame, grn: DataFrame, inv: DataFrame, config: Config = Config()) -> DataFrame:
    """A4: invoices before their order, before each receipt of it, or long after it."""
    own = inv.where("po_id IS NOT NULL").select("invoice_id", "vendor_id", "po_id", "invoice_date").join(po.select("po_id", "order_date"), "po_id")
    kind, dates = "TIMING_ANOMALY", {"invoice_date": F.col("invoice_date"), "po_date": F.col("order_date"), "purchase_order_id": F.col("po_id"), "invoice_id": F.col("invoice_id")}
    early = _signal(own.where("invoice_date < order_date"), kind, "HIGH", ["invoice_before_po", F.col("invoice_id"), F.col("po_id")], {"timing_kind": F.lit("invoice_before_po")} | dates, po="po_id", invoice="invoice_id")
    delay = F.datediff("invoice_date", "order_date")
    late = _signal(own.where(delay > config.long_delay_days), kind, "LOW", ["long_delay", F.col("invoice_id"), F.col("po_id")], {"timing_kind": F.lit("long_po_to_invoice_delay"), "delay_days": delay, "threshold_days": F.lit(config.long_delay_days)} | dates, po="po_id", invoice="invoice_id")
    receipts = inv.where("po_id IS NOT NULL").select("invoice_id", "vendor_id", "po_id", "invoice_date").join(grn.select("po_id", "grn_id", "receipt_date"), "po_id").where("invoice_date < receipt_date")
    before = _signal(receipts, kind, "MEDIUM", ["invoice_before_grn", F.col("invoice_id"), F.col("grn_id")], {"timing_kind": F.lit("invoice_before_grn"), "invoice_date": F.col("invoice_date"), "grn_date": F.col("receipt_date"), "grn_id": F.col("grn_id"), "invoice_id": F.col("invoice_id")}, po="po_id", invoice="invoice_id", grn="grn_id")
    return early.unionByName(before).unionByName(late)


def vendor_sums(inv: DataFrame) -> DataFrame:
    """A vendor's total, number and latest (date, id) of invoices: what A5 compares with."""
    return inv.groupBy("vendor_id").agg(F.sum("total_amount").alias("total"), F.count("*").alias("n"), F.max(F.struct("invoice_date", "invoice_id")).alias("latest"))


def vendor_spike_signals(inv: DataFrame, scope: str = "invoice", config: Config = Config(), sums: DataFrame | None = None) -> DataFrame:
    """A5: an invoice against the mean of the vendor's other invoices of any date.

    Sums per vendor are joined back and the invoice taken out, so a large vendor is no window partition.
    scope: every invoice, or each vendor's latest by (date, id) only. sums: vendor_sums of all invoices, where inv is a part.
    """
    sums = vendor_sums(inv) if sums is None else sums
    own = inv.join(sums.where(F.col("n") > config.spike_history), "vendor_id")
    if scope == "vendor":
        own = own.where("invoice_id = latest.invoice_id")
    mean = F.bround((F.col("total") - F.col("total_amount")) / (F.col("n") - 1), 4).cast("decimal(18,4)")
    own = own.withColumn("mean", mean).where("mean > 0").withColumn("ratio", F.bround(F.col("total_amount") / F.col("mean"), 4).cast("decimal(18,4)"))
    own = own.withColumn("severity", S.severity_ratio("ratio", config.spike_steps)).where("severity IS NOT NULL")
    evidence = {"historical_invoice_count": F.col("n") - 1, "baseline_average": F.col("mean"), "current_value": F.col("total_amount"), "ratio": F.col("ratio")}
    return _signal(own, "VENDOR_SPIKE", F.col("severity"), [F.col("vendor_id"), F.col("invoice_id")], evidence, po="po_id", invoice="invoice_id")


def repeated_mismatch_signals(inv: DataFrame, exceptions: DataFrame, as_of: datetime.date, config: Config = Config()) -> DataFrame:
    """A vendor's exceptions over its invoices since as_of - window (no upper end); exceptions are counted per invoice first."""
    start = as_of - datetime.timedelta(days=config.window_days)
    counts = exceptions.where("invoice_id IS NOT NULL").groupBy("invoice_id").agg(F.count("*").alias("e"))
    window = inv.where(F.col("invoice_date") >= F.lit(start)).select("invoice_id", "vendor_id").join(counts, "invoice_id", "left")
    rates = window.groupBy("vendor_id").agg(F.count("*").alias("n"), F.coalesce(F.sum("e"), F.lit(0)).alias("e")).where(F.col("n") >= config.mismatch_history)
    rates = rates.withColumn("rate", F.bround(F.col("e").cast("decimal(18,0)") / F.col("n").cast("decimal(18,0)"), 4).cast("decimal(18,4)"))
    own = rates.withColumn("severity", S.severity_rate("rate", config.rate_steps)).where("severity IS NOT NULL")
    evidence = {"invoice_count": F.col("n"), "exception_count": F.col("e"), "exception_rate": F.col("rate"), "window_days": F.lit(config.window_days), "window_start": F.lit(start), "window_end": F.lit(as_of), "vendor_id": F.col("vendor_id")}
    return _signal(own, "REPEATED_MISMATCH", F.col("severity"), [F.col("vendor_id"), config.window_days, as_of], evidence)


def detect_invoices(t: Tables, config: Config = Config()) -> DataFrame:
    """A1 to A5 for all invoices."""
    parts = [price_variance_signals(t, config), quantity_variance_signals(t, config), duplicate_invoice_signals(t.inv), timing_signals(t.po, t.grn, t.inv, config), vendor_spike_signals(t.inv, "invoice", config)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def detect_vendors(inv: DataFrame, exceptions: DataFrame, as_of: datetime.date, config: Config = Config()) -> DataFrame:
    """Each vendor's latest invoice (A5) and its exception rate."""
    return vendor_spike_signals(inv, "vendor", config).unionByName(repeated_mismatch_signals(inv, exceptions, as_of, config))


@dataclass(frozen=True)
class Baselines:
    """What signals of a few invoices need to know of all: vendors' sums (A5) and duplicate groups (A3).

    Computed once and written, scans in parts read a row per vendor and group instead of all invoices.
    """

    sums: DataFrame
    duplicates: DataFrame

    @staticmethod
    def of(inv: DataFrame) -> Baselines:
        return Baselines(written(vendor_sums(inv)), written(duplicate_invoice_signals(inv)))


def scoped_parts(invoices: DataFrame, t: Tables, config: Config = Config(), sums: DataFrame | None = None, keep: Callable[[DataFrame], DataFrame] = written) -> list[DataFrame]:
    """A1, A2, A4 and A5 of some invoices (rows of t.inv): what they touch is looked up below the rules.

    Their lines, orders and receipts, and their vendors' sums (over t.inv unless given), are all that the rules see.
    keep writes the lines, which go with it.
    """
    ids = invoices.select("invoice_id")
    values = ("po_id", "po_line_id", "unit_price", "quantity")
    lines = keep(t.inv_line.select("invoice_line_id", "invoice_id", "line_number", *values).join(ids, "invoice_id", "left_semi"))
    own = replace(t, inv=invoices, inv_line=lines, po_line=keep(t.po_line.select(*values).join(lines.select("po_line_id"), "po_line_id", "left_semi")))
    sums = vendor_sums(t.inv.join(invoices.select("vendor_id"), "vendor_id", "left_semi")) if sums is None else sums
    return [price_variance_signals(own, config), quantity_variance_signals(own, config), timing_signals(t.po, t.grn, invoices, config), vendor_spike_signals(invoices, "invoice", config, sums)]


def detect_scoped(invoices: DataFrame, t: Tables, config: Config = Config(), sums: DataFrame | None = None) -> DataFrame:
    """The signals of `scoped_parts`."""
    return functools.reduce(DataFrame.unionByName, scoped_parts(invoices, t, config, sums))


def detect_exceptions(scope: DataFrame, t: Tables, exceptions: DataFrame, as_of: datetime.date, config: Config = Config()) -> DataFrame:
    """Signals of the invoices behind scope's exceptions and of their vendors; an order's vendor where no invoice is known.

    The closure of scope comes first: its invoices, their vendors, and all invoices of those vendors, which hold every
    duplicate and every mean that its signals depend on. The rules see nothing else. A vendor's signal is kept only if no
    invoice's has its fingerprint.
    """
    invoices = scope.where("invoice_id IS NOT NULL").select("invoice_id").distinct()
    known = scope.join(t.inv.select("invoice_id", F.col("vendor_id").alias("iv")), "invoice_id", "left").join(t.po.select(F.col("po_id").alias("purchase_order_id"), F.col("vendor_id").alias("pv")), "purchase_order_id", "left")
    vendors = written(known.select(F.coalesce("iv", "pv").alias("vendor_id")).where("vendor_id IS NOT NULL").distinct())
    # Invoices without a vendor are duplicates of each other by number alone.
    loose = t.inv.where("vendor_id IS NULL").withColumn("_norm", S.normalize_invoice_number("invoice_number"))
    numbers = loose.join(invoices, "invoice_id", "left_semi").select(F.col("_norm").alias("_n"))
    loose = loose.join(numbers, F.col("_norm").eqNullSafe(F.col("_n")), "left_semi").drop("_norm")
    closure = t.inv.join(vendors, "vendor_id", "left_semi").unionByName(loose)
    peers = written(closure.join(invoices.withColumn("in_scope", F.lit(True)), "invoice_id", "left"))
    inv, own = peers.drop("in_scope"), peers.where("in_scope").drop("in_scope")
    found = detect_scoped(own, replace(t, inv=inv), config)
    # A duplicate's signal stands in the row of the group's smallest id, whichever member is in scope.
    asked = own.select(S.fingerprint("DUPLICATE_INVOICE", F.col("vendor_id"), S.normalize_invoice_number("invoice_number")).alias("fingerprint"))
    found = written(found.unionByName(duplicate_invoice_signals(inv).join(asked, "fingerprint", "left_semi").select(*SIGNAL)))
    counted = exceptions.join(inv.select("invoice_id"), "invoice_id", "left_semi")
    more = detect_vendors(inv, counted, as_of, config).join(vendors, "vendor_id", "left_semi").join(found.select("fingerprint"), "fingerprint", "left_anti")
    return found.select(*SIGNAL).unionByName(more.select(*SIGNAL))


def full_scan(t: Tables, exceptions: DataFrame, as_of: datetime.date, after_invoice: int | None = None, after_vendor: int | None = None, batch: int | None = None, config: Config = Config(), baselines: Baselines | None = None) -> tuple[DataFrame, DataFrame]:
    """A10: signals of the invoices and vendors after a checkpoint, at most `batch` of each in id order, and the scan's counts.

    The counts hold the new checkpoint and, as errors, scanned invoices without vendor or date, which the rules on those
    can't judge. The rules see the scanned ids' own rows and the baselines, so a scan in parts that shares its baselines
    costs about what one scan costs and finds the same; append_new_signals makes a repeated scan add nothing.
    """
    base = baselines or Baselines.of(t.inv)
    after = lambda df, c, k: df.where(F.col(c) > k) if k is not None else df
    invoices, vendors = after(t.inv, "invoice_id", after_invoice), after(base.sums, "vendor_id", after_vendor).where("vendor_id IS NOT NULL")
    if batch:
        invoices, vendors = invoices.orderBy("invoice_id").limit(batch), vendors.orderBy("vendor_id").limit(batch)
    invoices, vendors = written(invoices), written(vendors)
    latest = t.inv.join(vendors.select(F.col("latest.invoice_id").alias("invoice_id")), "invoice_id", "left_semi")
    start = as_of - datetime.timedelta(days=config.window_days)
    recent = t.inv.where(F.col("invoice_date") >= F.lit(start)).join(vendors.select("vendor_id"), "vendor_id", "left_semi")
    with scratch(t.inv.sparkSession) as held:
        parts = scoped_parts(invoices, t, config, base.sums, held)
        parts += [base.duplicates.join(invoices.select("invoice_id"), "invoice_id", "left_semi"), vendor_spike_signals(latest, "vendor", config, vendors), repeated_mismatch_signals(recent, exceptions, as_of, config)]
        # One after the other: the shuffles of a part go before the next one's come.
        rows = functools.reduce(DataFrame.unionByName, [written(p.select(*SIGNAL)) for p in parts])
    blind = F.count_if(F.col("vendor_id").isNull() | F.col("invoice_date").isNull())
    counts = invoices.agg(F.count("*").alias("invoices"), F.max("invoice_id").alias("last_invoice"), blind.alias("errors"))
    counts = counts.crossJoin(vendors.agg(F.count("*").alias("vendors"), F.max("vendor_id").alias("last_vendor"))).crossJoin(rows.agg(F.count("*").alias("signals")))
    return rows, counts


def list_signals_page(signals: DataFrame, limit: int = 50, cursor: str | tuple | None = None, **filters) -> tuple[DataFrame, DataFrame]:
    """A page by (detected_at, signal_id) descending, and its next cursor (a row, none at the end).

    filters: anomaly_type, severity, vendor_id, invoice_id, po_id; high_or_critical; since, until (instants). cursor:
    that of the page before, or (detected_at, signal_id) of its last row. limit: 1 to 500.
    """
    cursor = S.cursor_values(cursor) if isinstance(cursor, str) else cursor
    if not 1 <= limit <= 500:
        raise ValueError("limit must be from 1 to 500")
    own = signals
    for c in ("anomaly_type", "severity", "vendor_id", "invoice_id", "po_id"):
        if filters.get(c) is not None:
            own = own.where(F.col(c) == filters[c])
    if filters.get("high_or_critical"):
        own = own.where(F.col("severity").isin("HIGH", "CRITICAL"))
    if filters.get("since") is not None:
        own = own.where(F.col("detected_at") >= F.lit(filters["since"]))
    if filters.get("until") is not None:
        own = own.where(F.col("detected_at") <= F.lit(filters["until"]))
    if cursor:
        own = own.where((F.col("detected_at") < F.lit(cursor[0])) | ((F.col("detected_at") == F.lit(cursor[0])) & (F.col("signal_id") < cursor[1])))
    top = own.orderBy(F.desc("detected_at"), F.desc("signal_id")).limit(limit + 1)
    page = top.orderBy(F.desc("detected_at"), F.desc("signal_id")).limit(limit)
    last = page.orderBy("detected_at", "signal_id").limit(1)
    following = last.crossJoin(top.agg(F.count("*").alias("n"))).where(F.col("n") > limit).select(S.encode_cursor("detected_at", "signal_id").alias("cursor"))
    return page, following
