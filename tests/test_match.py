"""Boundary cases of the three-way match, signals, scores and scalars on literal rows."""

import datetime
from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from matchline.functions import texts as text_functions
from matchline.operators import policy
from matchline.functions import scalars as S
from matchline.operators import anomaly as A
from matchline.operators import reads as W
from matchline.operators import reconcile as R
from matchline.operators import risk as K
from matchline.sources import sinks
from matchline.sources import tables as T

DAY = datetime.date(2024, 1, 10)
SCHEMAS = {
    "po": "po_id long, po_number string, vendor_id long, order_date date",
    "po_line": "po_line_id long, po_id long, line_number long, quantity decimal(18,4), unit_price decimal(18,4), tax_rate decimal(8,4)",
    "grn": "grn_id long, grn_number string, po_id long, receipt_date date",
    "grn_line": "grn_line_id long, grn_id long, po_id long, line_number long, received_quantity decimal(18,4), po_line_id long",
    "inv": "invoice_id long, invoice_number string, vendor_id long, po_id long, invoice_date date, total_amount decimal(18,4), status string",
    "inv_line": "invoice_line_id long, invoice_id long, po_id long, line_number long, quantity decimal(18,4), unit_price decimal(18,4), tax_rate decimal(8,4), po_line_id long",
}


def tables(spark, received=(100,), invoiced=100, price=500, po=True, inv=True, link=11):
    rows = {
        "po": [(1, "PO-1", 7, DAY)] if po else [],
        "po_line": [(11, 1, 1, D(100), D(500), D("0.18"))] if po else [],
        "grn": [(20 + i, f"G{i}", 1, DAY) for i in range(len(received))],
        "grn_line": [(200 + i, 20 + i, 1, 1, D(q), 11) for i, q in enumerate(received)],
        "inv": [(30, "INV-1", 7, 1 if po else None, DAY, D(invoiced) * price, "RECEIVED")] if inv else [],
        "inv_line": [(300, 30, 1 if po else None, 1, D(invoiced), D(price), D("0.18"), link)] if inv else [],
    }
    return R.Tables(**{k: spark.createDataFrame(v, SCHEMAS[k]) for k, v in rows.items()})


def outcome(t, **config):
    drafts, results = R.reconcile(t, R.Config(**config))
    return sorted(r.rule for r in drafts.collect()), [r.status for r in results.collect()]


def test_full_and_split_delivery_match(spark):
    assert outcome(tables(spark)) == ([], ["MATCHED"])
    assert outcome(tables(spark, received=(40, 30), invoiced=70)) == ([], ["MATCHED"])


def test_quantity_rules(spark):
    assert outcome(tables(spark, received=(110,))) == (["received_gt_ordered"], ["EXCEPTIONS_FOUND"])
    assert outcome(tables(spark, received=(90,)))[0] == ["invoiced_gt_received"]
    assert outcome(tables(spark, received=(90,)), quantity=D(10))[0] == []


def test_price_tolerance_is_strict(spark):
    assert outcome(tables(spark, price=550))[0] == ["price"]
    assert outcome(tables(spark, price=550), price_percent=D(10))[0] == []


def test_missing_documents(spark):
    assert outcome(tables(spark, po=False)) == (["missing_po"], ["INCOMPLETE"])
    assert outcome(tables(spark, received=())) == (["missing_grn"], ["INCOMPLETE"])
    assert outcome(tables(spark, inv=False)) == (["missing_invoice"], ["INCOMPLETE"])


def test_dangling_link(spark):
    assert "missing_po_line_ref" in outcome(tables(spark, link=999))[0]
    assert outcome(tables(spark, link=None))[0] == []  # one line has the number


def test_result_does_not_depend_on_partitions(spark):
    t = tables(spark, received=(110,))
    cut = lambda n: R.Tables(**{k: getattr(t, k).repartition(n) for k in SCHEMAS})
    assert outcome(cut(1)) == outcome(cut(7))


@pytest.mark.parametrize("actual,severity", [("104.99", None), ("105", "LOW"), ("110", "MEDIUM"), ("125", "HIGH"), ("150", "CRITICAL"), ("50", "CRITICAL")])
def test_percent_ladder(spark, actual, severity):
    row = spark.createDataFrame([(D(100), D(actual))], "e decimal(18,4), a decimal(18,4)")
    assert row.select(S.severity_percent("e", "a")).first()[0] == severity


def test_zero_expected(spark):
    row = spark.createDataFrame([(D(0), D(0)), (D(0), D(3))], "e decimal(18,4), a decimal(18,4)")
    assert [tuple(r) for r in row.select(S.percent_variance("e", "a"), S.severity_percent("e", "a")).collect()] == [(0.0, None), (100.0, "CRITICAL")]


def test_spike_needs_three_others(spark):
    inv = lambda n: spark.createDataFrame([(i, f"N{i}", 7, None, DAY, D(10 if i else 50), "RECEIVED") for i in range(n)], SCHEMAS["inv"])
    assert A.vendor_spike_signals(inv(3)).count() == 0
    assert [r.severity for r in A.vendor_spike_signals(inv(4)).collect()] == ["CRITICAL"]


SIGNALS = "signal_id long, anomaly_type string, severity string, vendor_id long, po_id long, invoice_id long, detected_at timestamp, fingerprint string"


@pytest.mark.parametrize(
    "n,kind,severity,age,score,band",
    [(1, "PRICE_VARIANCE", "HIGH", 0, 6, "LOW"), (10, "TIMING_ANOMALY", "CRITICAL", 0, 11, "LOW"), (1, "DUPLICATE_INVOICE", "CRITICAL", 31, 10, "LOW"), (0, "", "", 0, 0, "LOW")],
)
def test_risk_score(spark, n, kind, severity, age, score, band):
    at = datetime.datetime(2024, 6, 30) - datetime.timedelta(days=age)
    signals = spark.createDataFrame([(i, kind, severity, 7, None, None, at, str(i)) for i in range(n)], SIGNALS)
    entity = spark.createDataFrame([("VENDOR", 7)], "entity_type string, entity_id long")
    got = K.score_profiles(signals, entity, datetime.date(2024, 6, 30)).first()
    assert (got.score, got.risk_band) == (score, band)


def test_appending_again_adds_nothing(spark):
    found = A.timing_signals(*(getattr(tables(spark), k) for k in ("po", "grn")), tables(spark).inv.withColumn("invoice_date", F.lit(datetime.date(2024, 1, 1))))
    new = sinks.append_new_signals(found.where(F.lit(False)), found)
    assert new.count() == found.count() == 2
    assert sinks.append_new_signals(new, found).count() == 0


def test_normalizers(spark):
    row = spark.createDataFrame([("(1,234.50)", " 18 % ", "31/12/98", " N/A ", " Inv__ 7 - ")], "m string, p string, d string, b string, n string")
    got = row.select(S.normalize_money("m"), S.normalize_percentage("p"), S.normalize_date("d"), S.normalize_business_value("b"), S.normalize_invoice_number("n")).first()
    assert (float(got[0]), float(got[1]), got[2], got[3], got[4]) == (-1234.5, 0.18, datetime.date(1998, 12, 31), None, "inv-7")


def test_chunks_are_bounded_and_contiguous(spark):
    texts = ["# A\n\n" + "word " * 800, "", "plain", "## 2.1 Terms\n\na  \nb\n \nc", "# Only\r\n## Heads", "x" * 450, None, "intro\n# Über uns!\ntext\n#no head\n\n\nmore " + "y" * 300]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {}
    for r in policy.chunks(frame, 200).orderBy("doc_id", "chunk_index").collect():
        got.setdefault(r.doc_id, []).append((r.chunk_index, r.section_id, r.section_title, r.content))
    assert [g[0] for g in got[0]] == list(range(len(got[0]))) and all(len(g[3]) <= 200 for c in got.values() for g in c)
    assert " ".join(g[3] for g in got[0]).split() == ["word"] * 800 and [len(g[3]) for g in got[0][:-1]] == [199] * (len(got[0]) - 1)
    assert got[2] == [(0, "preamble", "Preamble", "plain")] and got[4] == [(0, "body", None, "# Only\n## Heads")] and 1 not in got and 6 not in got
    assert got[3] == [(0, "2.1", "2.1 Terms", "a\nb\n\nc")] and [len(g[3]) for g in got[5]] == [200, 200, 50]
    assert [g[1:] for g in got[7]] == [("preamble", "Preamble", "intro"), ("ber-uns", "Über uns!", "text\n#no head"), ("ber-uns", "Über uns!", "more " + "y" * 195), ("ber-uns", "Über uns!", "y" * 105)]
    sections = {(r.doc_id, r.place): (r.section_id, r.n_blocks) for r in policy.sections(frame).collect()}
    assert sections[(3, 0)] == ("2.1", 2) and sections[(7, 1)] == ("ber-uns", 2) and sections[(0, 0)] == ("a", 1)


def test_labels(spark):
    texts = [
        "Invoice Number: A-1 / B-2\n", "Invoice No: N/A\nInvoice No: X9", "Invoice No: 7 / 8", "Vendor: ACME / Globex\nInvoice #: A-1|B-2",
        "PURCHASE ORDER\nPO-5001\nOrder Date: 2024-01-05\nCurrency: eur\nSubtotal: $1,200.50\nTax amount 20\nOrder total: 1,220.50", "GRN No: G-7\nSupplier name - Müller GmbH  &  Co\nReceived date: 5/6/24 or 7/6/24", None,
    ]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, full_text string")
    got = {r.doc_id: (r.fields, r.ambiguous) for r in text_functions.read_labels(frame, "full_text").collect()}
    assert got[0] == ({}, ["invoice_number"]) and got[1] == ({"invoice_number": "X9"}, []) and got[2] == ({}, ["invoice_number"])
    assert got[3] == ({"invoice_number": "A-1"}, ["vendor_name"]) and got[6] == ({}, [])
    assert got[4] == ({"po_number": "PO-5001", "order_date": "2024-01-05", "currency": "eur", "subtotal": "$1,200.50", "tax_amount": "20", "total_amount": "1,220.50"}, [])
    assert got[5] == ({"grn_number": "G-7", "vendor_name": "Müller GmbH & Co"}, ["receipt_date"])


def test_stacked_tables(spark):
    texts = [
        "Description\nQty\nPrice\npen\n2\n3.50\nTotal\n7\n0", "x\nSKU / Item\nQuantity\nUnit price\nGST\nA1\n3\n(3.50)\n18%\nB2\nfew\n₹4\n5\nC3\n?\n?\n1",
        "Description\nPrice\nRate\nx\n1\n2", "Qty\nPrice", None, "Qty\nUOM\nRate\n$5\nbox\nnone",
    ]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, full_text string")
    got = {r.doc_id: [tuple(x) for x in r.stacked] for r in text_functions.stacked_rows(frame, "full_text").collect()}
    assert got == {0: [("pen", "2", "3.50", None, None)], 1: [(None, "3", "(3.50)", "18%", "A1"), (None, "few", "₹4", "5", "B2")], 2: [], 3: [], 4: [], 5: []}


def test_intake_and_plan_status(spark):
    files = spark.createDataFrame([("../a.pdf", "application/pdf; x", b"1"), ("a.exe", "x", b"1"), ("a.png", "image/jpeg", b"1"), ("a.pdf", "application/pdf", b""), ("a.pdf", "application/pdf", b"12345")], "filename string, content_type string, content binary")
    assert [(r.safe_name, r.error) for r in T.validate_intake(files, 4).collect()] == [("a.pdf", None), ("a.exe", "extension"), ("a.png", "mime"), ("a.pdf", "empty"), ("a.pdf", "too_large")]
    plans = spark.createDataFrame([(1, "EXECUTING"), (2, "PROPOSED"), (3, "COMPLETED")], "plan_id long, status string")
    actions = spark.createDataFrame([(1, "COMPLETED"), (1, "REJECTED"), (2, "REJECTED"), (2, "APPROVED"), (3, "PENDING")], "plan_id long, status string")
    get = lambda stage: {r.plan_id: r.new_status for r in W.plan_status(plans, actions, stage).collect()}
    assert get("execution") == {1: "COMPLETED", 2: "APPROVED", 3: "COMPLETED"}
    assert get("decision") == {1: "EXECUTING", 2: "APPROVED", 3: "COMPLETED"}


def test_receipts_asked_for_with_another_order(spark):
    grn = spark.createDataFrame([(5, 1), (6, None), (7, 2)], "grn_id long, po_id long")
    asked = spark.createDataFrame([(1, 5), (1, 6), (1, 7)], "po_id long, grn_id long")
    found = R.header_exceptions(asked, grn, "GRN", "grn_id").collect()
    assert sorted((r.rule, r.grn_id, r.evidence["actual_purchase_order_id"]) for r in found) == [("missing_po_header_ref", 6, None), ("po_header_mismatch", 7, "2")]


def test_upsert_refreshes_references(spark):
    from matchline.sources import sinks

    old = spark.createDataFrame([("a", "T", "LOW", "m", "RESOLVED", None, 1, 9), ("b", "T", "LOW", "m", "IN_REVIEW", None, 2, 9)], "fingerprint string, exception_type string, severity string, message string, status string, resolved_at timestamp, invoice_id long, goods_receipt_id long")
    new = spark.createDataFrame([("a", "U", "HIGH", "n", 7, None, 3, {"k": "v"}), ("c", "U", "HIGH", "n", 8, None, 4, {})], "fingerprint string, exception_type string, severity string, message string, po_id long, grn_id long, invoice_id long, evidence map<string,string>")
    rows = {r.fingerprint: r for r in sinks.upsert_exceptions(old, new).collect()}
    assert (rows["a"].status, rows["a"].purchase_order_id, rows["a"].goods_receipt_id, rows["a"].invoice_id, rows["a"].evidence, rows["a"].source_document_ids) == ("OPEN", 7, None, 3, {"k": "v"}, ["7", "3"])
    assert (rows["b"].status, rows["b"].invoice_id, rows["b"].goods_receipt_id, rows["b"].evidence) == ("IN_REVIEW", 2, 9, None)
    assert (rows["c"].status, rows["c"].invoice_id) == ("OPEN", 4)


def test_promotion_reuses_links_and_refuses(spark):
    from matchline.operators import documents as D

    line = lambda n, q=1: (n, "x", q, 2)
    rows = [(1, "INVOICE", "I1", None, None, " ACME ", "2024-01-01", [line(1), line(9)], 10), (2, "INVOICE", "I1", None, None, "ACME", "2024-01-01", [line(1)], None), (3, "INVOICE", "I0", None, None, None, None, [], None),
            (4, "GRN", None, None, "G1", None, "2024-01-01", [line(1)], None), (5, "GRN", None, "P1", "G2", None, "2024-01-01", [line(1)], None), (6, "PO", None, "P2", None, "New", "2024-01-01", [line(1, 0)], None), (7, "PO", None, "P3", None, "New", None, [line(1)], None), (8, "PO", None, "P4", None, "New", "2024-01-01", [line(1)], None)]
    frame = spark.createDataFrame(rows, "doc_id long, detected_type string, invoice_number string, po_number string, grn_number string, vendor_name string, doc_date string, lines array<struct<line_number:int,description:string,quantity:int,unit_price:int>>, purchase_order_id long")
    frame = frame.selectExpr("* except (doc_date, lines)", "cast(doc_date AS date) AS doc_date", "cast(NULL AS string) AS currency", "cast(NULL AS int) AS subtotal", "1 AS tax_amount", "2 AS total_amount", "transform(lines, x -> named_struct('line_number', x.line_number, 'description', x.description, 'quantity', x.quantity, 'unit_price', x.unit_price, 'tax_rate', cast(NULL AS int))) AS lines")
    table = lambda data, schema: spark.createDataFrame(data, schema)
    out = D.promote(frame, table([(3, "ACME")], "vendor_id long, name string"), table([(10, "P1")], "po_id long, po_number string"), table([(100, 10, 1)], "po_line_id long, po_id long, line_number long"), table([], "grn_id long, grn_number string"), table([(50, "I0")], "invoice_id long, invoice_number string"))
    assert sorted((r.doc_id, r.vendor_id, r.po_id, r.currency) for r in out.heads.na.fill(0).collect()) == [(1, 3, 10, "USD"), (5, 0, 10, "USD"), (8, 0, 0, "USD")]
    assert sorted((r.doc_id, r.line_number, r.po_line_id or 0) for r in out.lines.collect()) == [(1, 1, 100), (1, 9, 0), (5, 1, 100), (8, 1, 0)]
    assert sorted((r.doc_id, r.id or 0) for r in out.reused.collect()) == [(2, 0), (3, 50)]
    assert sorted((r.doc_id, r.reason) for r in out.rejected.collect()) == [(4, "no_order"), (6, "bad_quantity"), (7, "no_date")]
    assert [r.name for r in out.vendors.collect()] == ["New"]
