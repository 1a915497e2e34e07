"""Three-way match of all purchase orders, receipts and invoices in one job.

Units are (po, invoice) pairs. Received quantities sum over all receipts of an order, invoiced ones over one invoice.
Drafts have one schema (see `DRAFT`); a draft that concerns an order's receipts only is written once per order and
counted in every unit of the order.
"""

from __future__ import annotations

import functools
from dataclasses import dataclass, replace
from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..sources.stored import are_spread, at_once, bucketed, written

DRAFT = ("exception_type", "severity", "rule", "po_id", "grn_id", "invoice_id", "message", "fingerprint", "evidence")
#: Order in which rules are tried; of drafts with one fingerprint the first counts.
RULE_ORDER = (
    "missing_po", "missing_invoice", "missing_grn", "duplicate_invoice", "missing_po_header_ref", "po_header_mismatch", "grn_before_po", "invoice_before_po",
    "missing_po_line_ref", "ambiguous_or_missing_line", "price", "tax", "invoiced_gt_received", "received_gt_ordered", "invoiced_gt_ordered",
)


@dataclass(frozen=True)
class Config:
    """Tolerances: quantity absolute, price and tax in percent."""

    quantity: Decimal = Decimal(0)
    price_percent: Decimal = Decimal(0)
    tax_percent: Decimal = Decimal(0)


@dataclass(frozen=True)
class Tables:
    """loose, loose_line: further invoices, without an order, which by_order keeps apart; buckets: how many it wrote, 0 for other tables."""

    po: DataFrame
    po_line: DataFrame
    grn: DataFrame
    grn_line: DataFrame
    inv: DataFrame
    inv_line: DataFrame
    loose: DataFrame | None = None
    loose_line: DataFrame | None = None
    buckets: int = 0

    def all_inv(self) -> DataFrame:
        return self.inv if self.loose is None else self.inv.unionByName(self.loose)

    def all_inv_line(self) -> DataFrame:
        return self.inv_line if self.loose_line is None else self.inv_line.unionByName(self.loose_line)

    def kept(self, df: DataFrame, placed: bool = False) -> DataFrame:
        """df, which has a po_id, written once in these tables' buckets, if they are in buckets. placed: it comes from them alone, joined on po_id."""
        return bucketed(df, "po_id", self.buckets, placed) if self.buckets else df


def by_order(t: Tables, buckets: int | None = None) -> Tables:
    """The tables written once, in buckets of po_id: linking, sums and rules of an order reuse one distribution.

    buckets: spark.sql.shuffle.partitions unless given. Lines and documents without an order meet no order and are left
    out, but for invoices, which stay as `loose`. Where one order has so many lines that it would fill half a bucket,
    nothing is bucketed: joins that shuffle can split such an order, buckets can't.
    """
    n = buckets or int(t.po.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    own = lambda df: df.where("po_id IS NOT NULL")
    every = (t.po, t.po_line, t.grn, t.grn_line, t.inv, t.inv_line)
    if not are_spread([own(df) for df in (t.po_line, t.grn_line, t.inv_line)], "po_id", n):
        return Tables(*at_once([functools.partial(written, df) for df in every]))
    tables = [functools.partial(bucketed, own(df), "po_id", n) for df in every]
    loose = [functools.partial(written, df.where("po_id IS NULL")) for df in (t.inv, t.inv_line)]
    return Tables(*at_once([*tables, *loose]), buckets=n)


def _null() -> Column:
    return F.lit(None).cast("long")


def case(test: Column | None, kind: str, severity: str, rule: str, parts: list, message: Column, evidence: dict[str, Column], po: Column | None = None, grn: Column | None = None, invoice: Column | None = None) -> Column:
    """A draft as a struct where test holds (None: always), else null."""
    pairs = [x for k, v in evidence.items() for x in (F.lit(k), v.cast("string"))]
    one = F.struct(
        F.lit(kind).alias("exception_type"),
        F.lit(severity).alias("severity"),
        F.lit(rule).alias("rule"),
        (po if po is not None else _null()).cast("long").alias("po_id"),
        (grn if grn is not None else _null()).cast("long").alias("grn_id"),
        (invoice if invoice is not None else _null()).cast("long").alias("invoice_id"),
        message.alias("message"),
        S.fingerprint(kind, *parts).alias("fingerprint"),
        F.create_map(*pairs).alias("evidence"),
    )
    return one if test is None else F.when(test, one)


def drafts_of(df: DataFrame, cases: list[Column], ordered: bool = False) -> DataFrame:
    """The drafts of all rows, in one pass over them whatever the number of rules.

    ordered: with the row's own po_id as _order, which keeps the buckets that df may be in.
    """
    own = ["_order"] if ordered else []
    one = cases[0].alias("_d") if len(cases) == 1 else F.explode(F.array(*cases)).alias("_d")
    return df.select(*(F.col("po_id").alias(c) for c in own), one).where("_d IS NOT NULL").select(*own, "_d.*")


def build_units(po: DataFrame, inv: DataFrame) -> DataFrame:
    """(po_id, invoice_id); orders without invoice and invoices without (known) order have a null side."""
    return order_units(po, inv).unionByName(orphan_units(po, inv.where("po_id IS NOT NULL"), inv.where("po_id IS NULL")))


def order_units(po: DataFrame, inv: DataFrame) -> DataFrame:
    """The units with an order."""
    return po.select("po_id").join(inv.where("po_id IS NOT NULL").select("invoice_id", "po_id"), "po_id", "left")


def orphan_units(po: DataFrame, named: DataFrame, loose: DataFrame) -> DataFrame:
    """The units without one. Invoices that name none (loose) don't pass through the join, where they would meet in one task."""
    unknown = named.join(po.select("po_id"), "po_id", "left_anti")
    return unknown.select("invoice_id").unionByName(loose.select("invoice_id")).select(_null().alias("po_id"), "invoice_id")


#: Columns of the order line that a linked line carries, as order_<name>.
CARRIED = ("line_number", "unit_price", "tax_rate")


def link_lines(lines: DataFrame, po_line: DataFrame) -> DataFrame:
    """R2: lines(po_id, po_line_id, line_number, ...) -> with linked (po_line_id or null) and link (ok or a reason).

    A given po_line_id must exist on the order; without one, line_number must name exactly one of its lines. The order
    line's own values come along as order_<name>, so that no rule has to join it again.
    """
    carried = [c for c in CARRIED if c in po_line.columns]
    by_key = po_line.select(F.col("po_id").alias("k_po"), F.col("po_line_id").alias("k_line"), *(F.col(c).alias(f"k_{c}") for c in carried))
    # Where a number names one line, the least value is that line's.
    numbers = po_line.groupBy(F.col("po_id").alias("n_po"), F.col("line_number").alias("n_number")).agg(F.count("*").alias("n_lines"), F.min("po_line_id").alias("n_line"), *(F.min(c).alias(f"n_{c}") for c in carried))
    joined = lines.join(by_key, (F.col("po_id") == F.col("k_po")) & (F.col("po_line_id") == F.col("k_line")), "left").join(numbers, (F.col("po_id") == F.col("n_po")) & (F.col("line_number") == F.col("n_number")), "left")
    given, one = F.col("po_line_id").isNotNull(), F.coalesce(F.col("n_lines") == 1, F.lit(False))
    pick = lambda c: F.when(given, F.col(f"k_{c}")).when(one, F.col(f"n_{c}"))
    return joined.select(
        *lines.columns,
        pick("line").alias("linked"),
        F.when(given & F.col("k_line").isNull(), "missing_po_line_ref").when(given | one, "ok").otherwise("ambiguous_or_missing_line").alias("link"),
        F.coalesce("n_lines", F.lit(0)).alias("candidate_count"),
        *(pick(c).alias(f"order_{c}") for c in carried),
    )


def link_cases(label: str, line: str, document: str) -> list[Column]:
    """Drafts of a line that R2 couldn't link."""
    d, key = F.col(document), F.col(line)
    ids = {"grn": d} if label == "GRN" else {"invoice": d}
    base = {"document_type": F.lit(label), "document_id": d, "line_id": key, "purchase_order_id": F.col("po_id")}
    gone = case(
        F.col("link") == "missing_po_line_ref", "IDENTIFIER_MISMATCH", "HIGH", "missing_po_line_ref", ["missing_po_line_ref", d, key, F.col("po_line_id")],
        F.format_string(f"{label} line names order line %s, which order %s doesn't have.", F.col("po_line_id"), F.col("po_id")),
        base | {"referenced_purchase_order_line_id": F.col("po_line_id")}, po=F.col("po_id"), **ids,
    )
    vague = case(
        F.col("link") == "ambiguous_or_missing_line", "IDENTIFIER_MISMATCH", "HIGH", "ambiguous_or_missing_line", ["ambiguous_or_missing_line", d, key, F.col("line_number")],
        F.format_string(f"{label} line %s fits no single line of order %s.", F.col("line_number"), F.col("po_id")),
        base | {"line_number": F.col("line_number"), "candidate_count": F.col("candidate_count")}, po=F.col("po_id"), **ids,
    )
    return [gone, vague]


def header_exceptions(pairs: DataFrame, documents: DataFrame, label: str, document: str) -> DataFrame:
    """pairs(po_id, document) that were asked for, documents(document, po_id): no order named, or another one."""
    own = pairs.select("po_id", document).join(documents.select(document, F.col("po_id").alias("ref")), document)
    d, ids = F.col(document), {"grn": F.col(document)} if label == "GRN" else {"invoice": F.col(document)}
    evidence = {"document_type": F.lit(label), "document_id": d, "expected_purchase_order_id": F.col("po_id"), "actual_purchase_order_id": F.col("ref")}
    none = case(F.col("ref").isNull(), "IDENTIFIER_MISMATCH", "HIGH", "missing_po_header_ref", ["missing_po_header_ref", d, F.col("po_id")], F.lit(f"{label} names no purchase order."), evidence, po=F.col("po_id"), **ids)
    other = case(F.col("ref") != F.col("po_id"), "IDENTIFIER_MISMATCH", "HIGH", "po_header_mismatch", ["po_header_mismatch", d, F.col("ref"), F.col("po_id")], F.format_string(f"{label} names order %s, not %s.", F.col("ref"), F.col("po_id")), evidence, po=F.col("po_id"), **ids)
    return drafts_of(own, [none, other])


def received_by_po_line(linked: DataFrame) -> DataFrame:
    """Over all receipts of the order."""
    return linked.where("link = 'ok'").groupBy("po_id", F.col("linked").alias("po_line_id")).agg(F.sum("received_quantity").cast("decimal(18,4)").alias("received"), F.array_sort(F.collect_list("grn_line_id")).alias("grn_line_ids"))


def invoiced_by_po_line(linked: DataFrame) -> DataFrame:
    """Per invoice."""
    return linked.where("link = 'ok'").groupBy("invoice_id", "po_id", F.col("linked").alias("po_line_id")).agg(F.sum("quantity").cast("decimal(18,4)").alias("invoiced"), F.array_sort(F.collect_list("invoice_line_id")).alias("invoice_line_ids"))


def with_receipts(units: DataFrame, grn: DataFrame) -> DataFrame:
    """Units that have an order, with its receipts: n_grn, one_grn (the least) and grns (ids as text, sorted; empty: none)."""
    receipts = grn.groupBy("po_id").agg(F.count("*").alias("n_grn"), F.min("grn_id").alias("one_grn"), F.array_sort(F.collect_list(F.col("grn_id").cast("string"))).alias("grns"))
    own = units.where("po_id IS NOT NULL").join(receipts, "po_id", "left")
    return own.withColumns({"n_grn": F.coalesce("n_grn", F.lit(0)), "grns": F.coalesce("grns", F.array().cast("array<string>"))})


def without_order(units: DataFrame, like: DataFrame) -> DataFrame:
    """Units without an order, with the columns of `like`: no receipts, no dates."""
    known = {"invoice_id": F.col("invoice_id"), "n_grn": F.lit(0).cast("long"), "grns": F.array().cast("array<string>")}
    return units.where("po_id IS NULL").select(*(known.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in like.schema))


def quantity_exceptions(units: DataFrame, po_line: DataFrame, grn: DataFrame, received: DataFrame, invoiced: DataFrame, config: Config = Config()) -> DataFrame:
    """Units with an invoice and a receipt; lines without either quantity are skipped."""
    return quantity_drafts(with_receipts(units.where("po_id IS NOT NULL AND invoice_id IS NOT NULL"), grn), po_line, received, invoiced, config)


def quantity_drafts(heads: DataFrame, po_line: DataFrame, received: DataFrame, invoiced: DataFrame, config: Config = Config(), ordered: bool = False) -> DataFrame:
    """R6 of units with their receipts."""
    own = heads.where("po_id IS NOT NULL AND invoice_id IS NOT NULL AND n_grn > 0").select("po_id", "invoice_id", "n_grn", "one_grn")
    lines = own.join(po_line.select("po_id", "po_line_id", "line_number", F.col("quantity").alias("ordered")), "po_id")
    zero = F.lit(0).cast("decimal(18,4)")
    full = (
        lines.join(received.select("po_id", "po_line_id", "received", "grn_line_ids"), ["po_id", "po_line_id"], "left")
        .join(invoiced.select("po_id", "invoice_id", "po_line_id", "invoiced", "invoice_line_ids"), ["po_id", "invoice_id", "po_line_id"], "left")
        .withColumns({"received": F.coalesce("received", zero), "invoiced": F.coalesce("invoiced", zero)})
        .where("received <> 0 OR invoiced <> 0")
    )
    rules = [("invoiced_gt_received", "invoiced", "received"), ("received_gt_ordered", "received", "ordered"), ("invoiced_gt_ordered", "invoiced", "ordered")]
    cases = F.array(*(F.when(S.exceeds_quantity(a, b, config.quantity), F.struct(F.lit(r).alias("rule"), F.lit(a).alias("what"), F.lit(b).alias("against"), F.col(a).alias("actual"), F.col(b).alias("expected"))) for r, a, b in rules))
    hit = full.withColumn("x", F.explode(F.array_compact(cases)))
    kind = "QUANTITY_MISMATCH"
    text = F.format_string("Quantity %s (%s) exceeds %s (%s) on order line %s.", F.col("x.actual").cast("string"), F.col("x.what"), F.col("x.expected").cast("string"), F.col("x.against"), F.col("line_number"))
    ids = lambda c: F.coalesce(F.array_join(c, ","), F.lit(""))
    evidence = {"rule": F.col("x.rule"), "purchase_order_line_id": F.col("po_line_id"), "ordered_quantity": F.col("ordered"), "received_quantity": F.col("received"), "invoiced_quantity": F.col("invoiced"), "expected_value": F.col("x.expected"), "actual_value": F.col("x.actual"), "variance": F.col("x.actual") - F.col("x.expected"), "grn_line_ids": ids("grn_line_ids"), "invoice_line_ids": ids("invoice_line_ids")}
    out = drafts_of(hit, [case(None, kind, "HIGH", "", [F.col("x.rule"), F.col("po_id"), F.col("po_line_id"), F.col("invoice_id")], text, evidence, po=F.col("po_id"), grn=F.when(F.col("n_grn") == 1, F.col("one_grn")), invoice=F.col("invoice_id"))], ordered)
    return out.withColumn("rule", F.col("evidence")["rule"])


def _value_case(column: str, kind: str, severity: str, rule: str, tolerance: Decimal, label: str) -> Column:
    actual, expected = F.col(column), F.col(f"order_{column}")
    text = F.format_string(f"{label} mismatch on order line %s: %s against %s.", F.col("order_line_number"), actual.cast("string"), expected.cast("string"))
    evidence = {"purchase_order_line_id": F.col("linked"), "invoice_line_id": F.col("invoice_line_id"), "expected_value": expected, "actual_value": actual, "absolute_variance": F.abs(actual - expected), "percentage_variance": F.bround(S.percent_variance(f"order_{column}", column), 4)}
    test = (F.col("link") == "ok") & S.exceeds_percent(f"order_{column}", column, tolerance)
    return case(test, kind, severity, rule, [F.col("po_id"), F.col("linked"), F.col("invoice_id"), F.col("invoice_line_id")], text, evidence, po=F.col("po_id"), invoice=F.col("invoice_id"))


def price_case(config: Config = Config()) -> Column:
    """R7, of a linked invoice line."""
    return _value_case("unit_price", "PRICE_MISMATCH", "HIGH", "price", config.price_percent, "Unit price")


def tax_case(config: Config = Config()) -> Column:
    """R8, of a linked invoice line."""
    return _value_case("tax_rate", "TAX_MISMATCH", "MEDIUM", "tax", config.tax_percent, "Tax rate")


def early_documents(po: DataFrame, docs: DataFrame, key: str) -> DataFrame:
    """docs(key, po_id, day) dated before their order; key is grn_id or invoice_id."""
    return early_drafts(docs.join(po.select("po_id", "order_date"), "po_id"), key)


def early_drafts(docs: DataFrame, key: str, ordered: bool = False) -> DataFrame:
    """R9 of documents with their order's date."""
    day, rule, label = ("receipt_date", "grn_before_po", "Receipt") if key == "grn_id" else ("invoice_date", "invoice_before_po", "Invoice")
    own = docs.where(F.col(day) < F.col("order_date"))
    ids = {"grn": F.col(key)} if key == "grn_id" else {"invoice": F.col(key)}
    text = F.format_string(f"{label} %s is dated %s, before its order (%s).", F.col(key), F.col(day).cast("string"), F.col("order_date").cast("string"))
    return drafts_of(own, [case(None, "DATE_MISMATCH", "MEDIUM", rule, [rule, F.col("po_id"), F.col(key)], text, {"expected_value": F.col("order_date"), "actual_value": F.col(day)}, po=F.col("po_id"), **ids)], ordered)


def missing_document_exceptions(units: DataFrame, grn: DataFrame) -> DataFrame:
    """Units without an order, without an invoice, or with both but no receipt."""
    named = with_receipts(units, grn)
    return missing_drafts(named.unionByName(without_order(units, named)))


def missing_drafts(own: DataFrame, ordered: bool = False) -> DataFrame:
    """R10 of units with their receipts."""
    cases = []
    for rule, name, test in (("missing_po", "PO", "po_id IS NULL"), ("missing_invoice", "INVOICE", "invoice_id IS NULL"), ("missing_grn", "GRN", "po_id IS NOT NULL AND invoice_id IS NOT NULL AND size(grns) = 0")):
        head = F.concat_ws("|", F.lit(name), F.coalesce(F.col("po_id").cast("string"), F.lit("")), F.coalesce(F.col("invoice_id").cast("string"), F.lit("")))
        identity = F.when(F.size("grns") > 0, F.concat_ws("|", head, F.array_join("grns", "|"))).otherwise(head)
        cases.append(case(F.expr(test), "MISSING_DOCUMENT", "CRITICAL", rule, [identity], F.lit(f"Required document missing: {name}."), {"missing_document": F.lit(name), "goods_receipt_ids": F.array_join("grns", ",")}, po=F.col("po_id"), grn=F.when(F.size("grns") == 1, F.col("one_grn")), invoice=F.col("invoice_id")))
    return drafts_of(own, cases, ordered)


def duplicate_invoice_exceptions(inv: DataFrame) -> DataFrame:
    """One draft for each ordered pair of a vendor's invoices with one normalized number.

    Groups of one are dropped before the self-join; the pairs are the result itself.
    """
    own = inv.select("invoice_id", "vendor_id", "po_id", "invoice_number", S.normalize_invoice_number("invoice_number").alias("norm"))
    many = own.groupBy("vendor_id", "norm").agg(F.count("*").alias("n")).where("n > 1").drop("n")
    group = own.join(many, ["vendor_id", "norm"])
    other = group.select("vendor_id", "norm", F.col("invoice_id").alias("other_id"), F.col("invoice_number").alias("other_number"))
    pairs = group.join(other, ["vendor_id", "norm"]).where("invoice_id <> other_id")
    text = F.format_string("Invoice %s of vendor %s has the number of invoice %s.", F.col("invoice_number"), F.col("vendor_id"), F.col("other_number"))
    return drafts_of(pairs, [case(None, "DUPLICATE_INVOICE", "CRITICAL", "duplicate_invoice", [F.col("vendor_id"), F.col("norm"), F.col("invoice_id"), F.col("other_id")], text, {"vendor_id": F.col("vendor_id"), "normalized_invoice_number": F.col("norm"), "duplicate_invoice_id": F.col("other_id"), "duplicate_invoice_number": F.col("other_number")}, po=F.col("po_id"), invoice=F.col("invoice_id"))])


def dedupe_drafts(drafts: DataFrame, *keys: str) -> DataFrame:
    """The first draft per fingerprint (and keys), by the rules' order, then by ids."""
    order = F.array_position(F.array(*(F.lit(r) for r in RULE_ORDER)), F.col("rule"))
    first = Window.partitionBy(*keys, "fingerprint").orderBy(order, F.col("po_id").asc_nulls_last(), F.col("invoice_id").asc_nulls_last(), F.col("grn_id").asc_nulls_last())
    return drafts.withColumn("_r", F.row_number().over(first)).where("_r = 1").drop("_r")


def reconcile(t: Tables, config: Config = Config(), pairs: DataFrame | None = None, receipts: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """All drafts, one per fingerprint, and one result per unit.

    pairs(po_id, invoice_id), if given, are reconciled instead of the units that the invoices' references make, and
    receipts(po_id, grn_id), if given, count for these orders instead of the receipts that name them.
    """
    everything = t.all_inv()
    if pairs is None:
        named, loose = (t.inv, t.loose) if t.loose is not None else (t.inv.where("po_id IS NOT NULL"), t.inv.where("po_id IS NULL"))
        dated = t.po.select("po_id", "order_date").join(named.select("po_id", "invoice_id", "invoice_date"), "po_id", "left")
        orphans = orphan_units(t.po, named, loose)
    else:
        dates = everything.where("invoice_id IS NOT NULL").select("invoice_id", "invoice_date")
        dated = pairs.where("po_id IS NOT NULL").join(t.po.select("po_id", "order_date"), "po_id", "left").join(dates, "invoice_id", "left")
        orphans = pairs.where("po_id IS NULL")
    known, billed = t.po.select("po_id"), dated.where("invoice_id IS NOT NULL").select("po_id", "invoice_id")
    inv_line = t.all_inv_line().drop("po_id").join(billed, "invoice_id") if pairs is not None else t.inv_line.where("po_id IS NOT NULL")
    headers = header_exceptions(billed, everything, "Invoice", "invoice_id") if pairs is not None else None
    if receipts is not None:
        asked = receipts.select("po_id", "grn_id").distinct()
        wrong = header_exceptions(asked.join(known, "po_id", "left_semi"), t.grn, "GRN", "grn_id")
        t = replace(t, grn=t.grn.drop("po_id").join(asked, "grn_id"), grn_line=t.grn_line.drop("po_id").join(asked, "grn_id"))
    # Without its order nothing of a document is matched. Each side's lines are linked once; one pass tries all their rules.
    # A unit with its dates and receipts is what R6, R9 and R10 read.
    linked = [link_lines(x.join(known, "po_id", "left_semi"), t.po_line) for x in (t.grn_line, inv_line)]
    placed = pairs is None and receipts is None
    g, i, heads = at_once([functools.partial(t.kept, df, placed) for df in (*linked, with_receipts(dated, t.grn))])
    received, invoiced = received_by_po_line(g), invoiced_by_po_line(i)
    on_order = drafts_of(g, link_cases("GRN", "grn_line_id", "grn_id")).unionByName(early_documents(t.po, t.grn, "grn_id"))
    if receipts is not None:
        on_order = on_order.unionByName(wrong)
    # No two of these give drafts of one fingerprint, so each counts its own where its rows are.
    in_unit = [
        missing_drafts(heads, ordered=True),
        missing_drafts(without_order(orphans, heads), ordered=True),
        duplicate_invoice_exceptions(everything).withColumn("_order", F.col("po_id")),
        early_drafts(heads.where("invoice_id IS NOT NULL"), "invoice_id", ordered=True),
        drafts_of(i, [*link_cases("Invoice", "invoice_line_id", "invoice_id"), price_case(config), tax_case(config)], ordered=True),
        quantity_drafts(heads, t.po_line, received, invoiced, config, ordered=True),
    ]
    if headers is not None:
        in_unit.append(headers.withColumn("_order", F.col("po_id")))
    drafts = dedupe_drafts(functools.reduce(DataFrame.unionByName, [*(x.drop("_order") for x in in_unit), on_order]))
    return drafts, unit_results(heads.select("po_id", "invoice_id", "n_grn"), orphans.select("po_id", "invoice_id"), in_unit, on_order, t, received, invoiced)


def unit_results(units: DataFrame, orphans: DataFrame, in_unit: list[DataFrame], on_order: DataFrame, t: Tables, received: DataFrame, invoiced: DataFrame) -> DataFrame:
    """Counts by type, totals and status of each unit: units(po_id, invoice_id, n_grn), and those without an order.

    in_unit: drafts with _order, by the sources that give them; a fingerprint has one source. Orders' sums are joined in
    the orders' buckets; what is known by invoice meets the units once, under the unit's key.
    """
    # A duplicate's draft names the order its invoice refers to; the unit is known by the invoice then.
    key = F.coalesce("invoice_id", -F.col("po_id") - 1)

    def counted(drafts: DataFrame) -> DataFrame:
        own = drafts.select("_order", key.alias("unit"), "exception_type", "fingerprint").distinct()
        return own.groupBy("_order", "unit", "exception_type").agg(F.count("*").alias("n")).drop("_order")

    mine = functools.reduce(DataFrame.unionByName, map(counted, in_unit))
    shared = on_order.groupBy("po_id", "exception_type").agg(F.count("*").alias("n"))
    long = mine.unionByName(units.withColumn("unit", key).join(shared, "po_id").select("unit", "exception_type", "n")).groupBy("unit", "exception_type").agg(F.sum("n").alias("n"))
    counts = long.groupBy("unit").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("exception_type", "n")))).alias("by_type"), F.sum("n").alias("exception_count"), F.bool_or(F.col("exception_type") == "MISSING_DOCUMENT").alias("incomplete"))
    ordered = t.po_line.groupBy("po_id").agg(F.count("*").alias("po_line_count"), F.sum("quantity").alias("total_ordered"))
    got = received.groupBy("po_id").agg(F.sum("received").alias("total_received"))
    billed = invoiced.where("invoice_id IS NOT NULL").groupBy(F.col("invoice_id").alias("unit")).agg(F.sum("invoiced").alias("total_invoiced"))
    lines = t.all_inv_line().where("invoice_id IS NOT NULL").groupBy(F.col("invoice_id").alias("unit")).agg(F.count("*").alias("invoice_line_count"))
    known = units.withColumnRenamed("n_grn", "grn_count").join(ordered, "po_id", "left").join(got, "po_id", "left")
    own = known.unionByName(orphans, allowMissingColumns=True).withColumn("unit", key)
    full = own.join(counts, "unit", "left").join(billed, "unit", "left").join(lines, "unit", "left")
    full = full.withColumns({c: F.when(F.col("invoice_id").isNotNull(), F.col(c)) for c in ("total_invoiced", "invoice_line_count")})
    n = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    total = lambda c: F.coalesce(c, F.lit(0)).cast("decimal(28,4)").alias(c)
    return full.select(
        "po_id",
        "invoice_id",
        F.when(F.coalesce("incomplete", F.lit(False)), "INCOMPLETE").when(F.coalesce("exception_count", F.lit(0)) > 0, "EXCEPTIONS_FOUND").otherwise("MATCHED").alias("status"),
        n("exception_count"),
        F.coalesce("by_type", F.create_map().cast("map<string,bigint>")).alias("by_type"),
        n("po_line_count"),
        n("grn_count"),
        n("invoice_line_count"),
        total("total_ordered"),
        total("total_received"),
        total("total_invoiced"),
    )
