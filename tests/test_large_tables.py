"""What keeps queries within time and disk on large tables: work done once a row, narrow exchanges, tables that go when they are used up."""

import datetime
import os
import re
from decimal import Decimal

from pyspark.sql import functions as F

from matchline.functions import helpers
from matchline.operators import documents as D
from matchline.operators import reconcile as R
from matchline.registry import QUERIES
from matchline.sources import stored

INVOICE = "Invoice Number: INV-7\nVendor: Acme\nInvoice Date: 2024-01-05\nCurrency: USD\n  Bolt M8  5 2.50 \nNut 3 x\nNut\t7\t1,000.25"


def _docs(spark, *texts):
    rows = [(i, "scan.pdf", None, t) for i, t in enumerate(texts, 1)]
    return spark.createDataFrame(rows, "doc_id long, filename string, declared_type string, full_text string")


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_corrections_are_judged_once(spark):
    own = D.understand(_docs(spark, INVOICE)).drop("issues", "is_valid", "requires_review", "outcome")
    changes = spark.createDataFrame([(1, 1, "lines[1].quantity", "9"), (1, 2, "lines[1].quantity", "-9"), (1, 3, "currency", "eur"), (1, 4, "lines[2].quantity", "1"), (1, 5, None, "x")], "doc_id long, seq int, field_path string, value string")
    fixed, rejected = D.apply_corrections(own, changes)
    assert "RLIKE" not in _plan(rejected)
    row = fixed.select("currency", "lines.quantity", "lines.unit_price").first()
    assert row["currency"] == "eur" and [float(q) for q in row["quantity"]] == [5, 9] and [float(p) for p in row["unit_price"]] == [2.5, 1000.25]
    assert {(r["seq"], r["reason"]) for r in rejected.collect()} == {(2, "not positive"), (4, "no such line"), (5, "unknown field")}


def _shuffle_files(spark):
    files = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().getAllFiles()
    return {name for i in range(files.size()) if (name := files.apply(i).getName()).startswith("shuffle_")}


def test_written_tables_leave_no_shuffle_files(spark):
    before = _shuffle_files(spark)
    own = stored.written(spark.range(1000).repartition(3, "id"))
    kept = stored.bucketed(own, "id", 3)
    assert not _shuffle_files(spark) - before
    assert spark.conf.get(stored._CLEANUP) == "false"
    assert kept.count() == 1000


def test_scratch_tables_go(spark):
    with stored.scratch(spark) as held:
        table = held(spark.range(10))
        paths = table.inputFiles()
        assert table.count() == 10 and all(os.path.exists(p.removeprefix("file://")) for p in paths)
    assert not any(os.path.exists(p.removeprefix("file://")) for p in paths)


def test_unit_results_exchange_no_fingerprints(spark):
    lines = spark.createDataFrame([(10 * o + k, o, k, k, Decimal(5), Decimal(2), Decimal(0)) for o in (1, 2, 3) for k in (1, 2)], "po_line_id long, po_id long, seq long, line_number long, quantity decimal(18,4), unit_price decimal(18,4), tax_rate decimal(8,4)")
    po = spark.createDataFrame([(o, f"PO-{o}", 7, datetime.date(2024, 1, 1)) for o in (1, 2, 3)], "po_id long, po_number string, vendor_id long, order_date date")
    grn = spark.createDataFrame([(10, 1, datetime.date(2024, 1, 2)), (20, 2, datetime.date(2023, 1, 2))], "grn_id long, po_id long, receipt_date date")
    grn_line = lines.where("po_id < 3").select((F.col("po_line_id") + 100).alias("grn_line_id"), (F.col("po_id") * 10).alias("grn_id"), "po_id", "line_number", F.col("quantity").alias("received_quantity"), "po_line_id")
    inv = spark.createDataFrame([(100, 1, 7, "A", datetime.date(2024, 1, 3)), (200, 2, 7, "B", datetime.date(2024, 1, 3)), (201, 2, 7, "b", datetime.date(2024, 1, 3)), (900, None, 8, "Z", datetime.date(2024, 1, 3))], "invoice_id long, po_id long, vendor_id long, invoice_number string, invoice_date date")
    inv_line = inv.where("po_id IS NOT NULL").select("invoice_id", "po_id").join(lines, "po_id").select((F.col("po_line_id") * 1000 + F.col("invoice_id")).alias("invoice_line_id"), "invoice_id", "po_id", "line_number", "quantity", F.when(F.col("invoice_id") == 200, F.col("unit_price") + 1).otherwise(F.col("unit_price")).cast("decimal(18,4)").alias("unit_price"), "tax_rate", "po_line_id")
    t = R.by_order(R.Tables(po, lines, grn, grn_line, inv, inv_line), 3)
    _, results = R.reconcile(t)
    plan = results._jdf.queryExecution().executedPlan().toString()
    # Two sources aren't in buckets, the invoices without an order and the duplicates; all other drafts stay where they are.
    assert len(found := re.findall(r"hashpartitioning\([^)]*fingerprint[^)]*\)", plan)) <= 2 and all(x.count("#") == 4 for x in found), found
    got = {(r["po_id"], r["invoice_id"]): (r["status"], r["exception_count"], r["grn_count"], r["invoice_line_count"], float(r["total_invoiced"])) for r in results.collect()}
    assert got == {
        (1, 100): ("MATCHED", 0, 1, 2, 10.0), (2, 200): ("EXCEPTIONS_FOUND", 4, 1, 2, 10.0), (2, 201): ("EXCEPTIONS_FOUND", 2, 1, 2, 10.0),
        (3, None): ("INCOMPLETE", 1, 0, 0, 0.0), (None, 900): ("INCOMPLETE", 1, 0, 0, 0.0),
    }


def test_invoice_outcome_reads_the_written_invoices(spark):
    out = QUERIES["s8_apply_invoice_outcome"](spark, "/root/testdata/sf0.001")
    assert "lineitem" not in " ".join(out.inputFiles())


def test_embedding_exchanges_texts_once(spark):
    docs = spark.createDataFrame([(1, "Bolt bolt nut"), (2, "Bolt bolt nut"), (3, "!?"), (4, None)], "doc_id long, text string")
    own = helpers.embed_batch(docs, "text", 8)
    plan = own._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"Exchange hashpartitioning", plan)) <= 2, plan
    rows = {r["doc_id"]: r["vector"] for r in own.collect()}
    assert len(rows) == 4 and rows[1] == rows[2] and all(len(v) == 8 and abs(sum(x * x for x in v) - 1) < 1e-5 for v in rows.values())
    assert rows[3] != rows[4]


def _kept_folders(spark):
    root = spark.conf.get("spark.checkpoint.dir", "").removeprefix("file://")
    return {x for x in os.listdir(root) if x.startswith("scratch-") and os.listdir(f"{root}/{x}")} if os.path.isdir(root) else set()


def test_scan_writes_its_parts_apart_and_drops_what_they_read(spark):
    rows = QUERIES["a10_full_scan"](spark, "/root/testdata/sf0.001")
    folders = {os.path.dirname(f) for f in rows.inputFiles()}
    assert len(folders) > 1 and not _kept_folders(spark)


def test_types_are_voted_on_once(spark):
    plan = _plan(D.classify(D.labelled_fields(_docs(spark, INVOICE))).select("detected_type"))
    assert plan.count("amount\\s*due") == 1


def test_letters_without_case_are_hints_too(spark):
    row = D.labelled_fields(_docs(spark, "İnvoice No: 7\nınvoice date: 2024-01-05")).select("fields").first()
    assert row["fields"] == {"invoice_number": "7", "invoice_date": "2024-01-05"}
