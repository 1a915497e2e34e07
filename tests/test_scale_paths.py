"""What was built for large tables, on small ones: buckets, closures, folds, pivots, stored changes, restarts."""

import datetime
import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from matchline.functions import scalars as S
from matchline.functions.folds import folded
from matchline.functions.nearest import nearest
from matchline.operators import anomaly as A
from matchline.operators import documents as D
from matchline.operators import evaluate as E
from matchline.operators import reads as W
from matchline.operators import reconcile as R
from matchline.sources import sinks
from matchline.sources.keyed import Conflict, KeyedTable
from matchline.streaming import jobs


def rows_of(df):
    return sorted(str(tuple(r)) for r in df.collect())


# Match and anomaly


def small_tables(spark, hot=0):
    """Orders 1 to 12 of three vendors; invoice 7 names no order, 8 an unknown one; `hot` more lines of order 1."""
    rng = random.Random(3)
    day = datetime.date(2024, 1, 1)
    n = range(1, 13)
    po = spark.createDataFrame([(i, f"PO-{i}", i % 3, day + datetime.timedelta(i), "USD") for i in n], "po_id long, po_number string, vendor_id long, order_date date, currency string")
    lines = [(i * 10 + k, i, k, float(5 + k), 10.0, 0.1) for i in n for k in (1, 2)] + [(10_000 + k, 1, 50 + k, 1.0, 1.0, 0.1) for k in range(hot)]
    kind = "decimal(18,4)"
    numbers = lambda df: df.select(*(F.col(c).cast(kind).alias(c) if c in ("quantity", "unit_price", "received_quantity", "total_amount") else F.col(c).cast("decimal(8,4)").alias(c) if c == "tax_rate" else c for c in df.columns))
    po_line = numbers(spark.createDataFrame(lines, "po_line_id long, po_id long, line_number long, quantity double, unit_price double, tax_rate double"))
    grn = spark.createDataFrame([(i, f"G-{i}", i, day + datetime.timedelta(i + rng.choice([-3, 4]))) for i in n if i % 5], "grn_id long, grn_number string, po_id long, receipt_date date")
    grn_line = numbers(spark.createDataFrame([(i * 10 + k, i, i, k, 5.0 + k + i % 2, i * 10 + k if i % 3 else None) for i in n if i % 5 for k in (1, 2)], "grn_line_id long, grn_id long, po_id long, line_number long, received_quantity double, po_line_id long"))
    ref = {7: None, 8: 99}
    heads = [(i, f"INV {i if i not in (4, 10) else 4}", i % 3, ref.get(i, i), day + datetime.timedelta(i + rng.choice([-2, 3, 50])), "USD", "RECEIVED", 100.0 if i != 9 else 900.0) for i in n if i != 6]
    inv = numbers(spark.createDataFrame(heads, "invoice_id long, invoice_number string, vendor_id long, po_id long, invoice_date date, currency string, status string, total_amount double"))
    items = [(i * 10 + k, i, ref.get(i, i), k, 5.0 + k + i % 4, 10.0 + i % 3, 0.1 if i % 4 else 0.2, i * 10 + k if i % 4 else None) for i in n if i != 6 for k in (1, 2)]
    inv_line = numbers(spark.createDataFrame(items, "invoice_line_id long, invoice_id long, po_id long, line_number long, quantity double, unit_price double, tax_rate double, po_line_id long"))
    return R.Tables(po, po_line, grn, grn_line, inv, inv_line)


@pytest.mark.parametrize("hot", [0, 3000])
def test_bucketed_tables_give_the_same_match(spark, hot):
    plain = small_tables(spark, hot)
    stored = R.by_order(plain, 4)
    assert stored.buckets == (0 if hot else 4)  # an order that would fill a bucket keeps its tables out of buckets
    for got, want in zip(R.reconcile(stored), R.reconcile(plain)):
        as_text = lambda df: df.select(*(F.to_json(c).alias(c) if c in ("by_type", "evidence") else c for c in sorted(df.columns)))
        assert rows_of(as_text(got)) == rows_of(as_text(want))


def test_one_exchange_less_per_rule(spark):
    """Rules of bucketed tables join without exchanges: what is left deals out duplicates and fingerprints."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        drafts, _ = R.reconcile(R.by_order(small_tables(spark), 4))
        plan = drafts._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange") <= 12
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def exceptions_of(spark):
    return spark.createDataFrame([(i, i if i % 4 else None, i) for i in range(1, 13)], "exception_id long, invoice_id long, purchase_order_id long")


def test_scoped_detection_equals_filtered_detection(spark):
    t, as_of = small_tables(spark), datetime.date(2024, 2, 1)
    config = A.Config(spike_history=2, mismatch_history=1)
    exceptions = exceptions_of(spark)
    scope = exceptions.where("exception_id in (4, 9, 10)")
    everything = A.detect_invoices(t, config)
    ids = [9, 10]
    own = everything.where(F.col("anomaly_type") != "DUPLICATE_INVOICE").where(F.col("invoice_id").isin(ids)).unionByName(everything.where("anomaly_type = 'DUPLICATE_INVOICE'"))  # invoices 4 and 10 are the only group
    vendors = A.detect_vendors(t.inv, exceptions, as_of, config).where(F.col("vendor_id").isin(9 % 3, 10 % 3, 4 % 3))
    want = own.unionByName(vendors.join(own.select("fingerprint"), "fingerprint", "left_anti").select(own.columns))
    brief = lambda df: df.select("anomaly_type", "severity", "vendor_id", "invoice_id", "fingerprint")
    assert rows_of(brief(A.detect_exceptions(scope, t, exceptions, as_of, config))) == rows_of(brief(want))


def test_scan_in_parts_finds_what_one_scan_finds(spark):
    t, exceptions, as_of = small_tables(spark), exceptions_of(spark), datetime.date(2024, 2, 1)
    config, base = A.Config(spike_history=2, mismatch_history=1), A.Baselines.of(t.inv)
    whole, counts = A.full_scan(t, exceptions, as_of, config=config)
    parts, at = [], (None, None)
    for _ in range(10):
        rows, done = A.full_scan(t, exceptions, as_of, *at, batch=4, config=config, baselines=base)
        parts += rows_of(rows.select("fingerprint", "anomaly_type"))
        done = done.first()
        if not done["invoices"] and not done["vendors"]:
            break
        at = (done["last_invoice"] or at[0], done["last_vendor"] if done["last_vendor"] is not None else at[1])
    assert sorted(parts) == rows_of(whole.select("fingerprint", "anomaly_type")) and len(parts) > 10
    assert counts.first()["errors"] == 0 and counts.first()["signals"] == len(parts)


def test_duplicates_without_vendor_or_number(spark):
    rows = [(1, None, "A-1", 5), (2, None, "a_1", 6), (3, 1, None, 7), (4, 1, None, 8), (5, 1, "B", None), (10, None, "A 1", 1)]
    inv = spark.createDataFrame(rows, "invoice_id long, vendor_id long, invoice_number string, po_id long")
    found = A.duplicate_invoice_signals(inv).collect()
    assert sorted((r.invoice_id, r.po_id, r.evidence["invoice_ids"]) for r in found) == [(1, 5, "1,10,2"), (3, 7, "3,4")]


# Folds


def test_digest_of_an_entity_with_a_million_items(spark):
    n = 1_000_000
    rows = spark.range(n).select(F.lit("V").alias("kind"), F.lit(1).cast("long").alias("id"), F.sha2(F.col("id").cast("string"), 256).alias("item"), F.lit("head").alias("head"))
    rows = rows.unionByName(spark.createDataFrame([("V", 2, "b", "x"), ("V", 2, "a", "x"), ("W", None, "c", "y"), ("V", 3, None, "z")], "kind string, id long, item string, head string"))
    got = {(r.kind, r.id): r.folded for r in folded(rows, ["kind", "id"], "item", "sha256", "head").collect()}
    items = sorted(hashlib.sha256(str(i).encode()).hexdigest() for i in range(n))
    assert got == {("V", 1): hashlib.sha256(("head|" + "|".join(items)).encode()).hexdigest(), ("V", 2): hashlib.sha256(b"x|a|b").hexdigest(), ("W", None): hashlib.sha256(b"y|c").hexdigest()}


# Nearest vectors


@pytest.mark.parametrize("pivots,block", [(0, 8192), (6, 8192), (6, 40)])
def test_nearest_equals_brute_force(spark, pivots, block):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(5, 8))
    rows = [(centres[i % 5] + rng.normal(size=8) * 0.2).round(3).tolist() for i in range(300)] + [[1.0] + [0.0] * 7] * 120 + [[0.0] * 8] * 3
    queries = [rows[7], rows[100], [0.0] * 8, rows[301], *(rng.normal(size=(60, 8)).round(3).tolist())]
    chunk_rows = spark.createDataFrame([(i, i % 11, v) for i, v in enumerate(rows)] + [(9999, 0, None)], "chunk_id long, chunk_index long, vector array<double>")
    asked = spark.createDataFrame([(i, v) for i, v in enumerate(queries)] + [(9999, None)], "query_id long, vector array<double>")
    found = nearest(asked, chunk_rows, 4, pivots, block).collect()
    got = {}
    for r in found:
        got.setdefault(r.query_id, []).append((round(r.distance, 9), r.chunk_index, r.chunk_id))
    unit = lambda m: m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)
    distance = 1 - np.clip(unit(np.array(queries)) @ unit(np.array(rows)).T, -1, 1)
    for q in range(len(queries)):
        want = sorted((round(distance[q, i], 9), i % 11, i) for i in range(len(rows)))[:4]
        assert sorted(got[q])[:4] == want
    if pivots and block < 100:
        assert len(got[0]) < len(got[2])  # a vector of zeros meets every block, one among the rows is spared some


# Evaluation


def test_markers_are_found_whatever_their_tokens(spark):
    texts = ["Alpha beta gamma delta.", "xalpha beta", "one % two", "nothing", "ALPHABET soup", "béta Gamma-ray"]
    markers = [["beta gamma d"], ["alpha"], ["%"], ["pha beta"], ["soup", "alphabet"], ["absent token here"], ["a"], ["gamma-r"], []]
    chunks = spark.createDataFrame([(i, "s", t) for i, t in enumerate(texts)], "chunk_id long, section_id string, content string")
    cases = spark.createDataFrame([(i, [], m) for i, m in enumerate(markers)], "case_id long, section_ids array<string>, markers array<string>")
    want = sorted((c, k) for c, m in enumerate(markers) for k, t in enumerate(texts) if m and all(x.lower() in t.lower() for x in m))
    assert sorted((r.case_id, r.chunk_id) for r in E.expected_chunks(cases, chunks).collect()) == want


def test_latency_ranks_are_exact(spark):
    rng = np.random.default_rng(2)
    own = {"a": rng.exponential(size=5000).tolist(), "b": [1.0] * 4000 + [2.0], "c": [3.0], "d": [1.0, 4.0], None: [5.0, 6.0, 7.0]}
    rows = [(s, v) for s, values in own.items() for v in values] + [("a", None), ("e", None)]
    got = {r.stage: r for r in E.latency_summary(spark.createDataFrame(rows, "stage string, ms double")).collect()}
    for s, values in own.items():
        values = sorted(values)
        r = got[s]
        assert (r.least, r.most, r.p95) == (values[0], values[-1], values[(95 * len(values) + 99) // 100 - 1])
        assert r.median == pytest.approx(float(np.median(values)))
    assert got["a"].n == 5001 and got["e"].median is None


# Reads and documents


def test_pages_within_one_second(spark):
    at = datetime.datetime(2024, 5, 1, 12, 0, 0)
    rows = [(i, "T", "HIGH", 1, 1, 1, at + datetime.timedelta(microseconds=i // 2)) for i in range(5)]
    signals = spark.createDataFrame(rows, "signal_id long, anomaly_type string, severity string, vendor_id long, invoice_id long, po_id long, detected_at timestamp")
    seen, cursor = [], None
    for _ in range(4):
        page, following = A.list_signals_page(signals, 2, cursor)
        seen.append([r.signal_id for r in page.collect()])
        after = following.first()
        if after is None:
            break
        cursor = after["cursor"]
    assert seen == [[4, 3], [2, 1], [0]]
    for bad in ("not-a-cursor", "bm8tYmFy"):
        with pytest.raises(ValueError):
            A.list_signals_page(signals, 2, bad)


def test_mismatch_rate_of_the_latest_signal(spark):
    day = datetime.datetime(2024, 1, 1)
    rows = [(1, "REPEATED_MISMATCH", {"exception_rate": "0.5"}, day), (2, "REPEATED_MISMATCH", {"exception_rate": "0.25"}, day + datetime.timedelta(1)), (3, "VENDOR_SPIKE", {"exception_rate": "9"}, day + datetime.timedelta(2))]
    signals = spark.createDataFrame([(i, k, "HIGH", 7, i, i, e, t) for i, k, e, t in rows], "signal_id long, anomaly_type string, severity string, vendor_id long, invoice_id long, po_id long, evidence map<string,string>, detected_at timestamp")
    assert float(W.vendor_anomaly_summary(signals, day.date()).first()["exception_rate"]) == 0.25


def test_corrections_follow_the_rules_of_their_fields(spark):
    text = "Invoice Number: INV-1\nVendor: Acme\nInvoice Date: 2024-01-05\nCurrency: USD\n\tDescription | x 4 5\n\tBolt 3 2.50\t"
    docs = spark.createDataFrame([(1, "scan.pdf", None, text)], "doc_id long, filename string, declared_type string, full_text string")
    own = D.understand(docs).drop("issues", "is_valid", "requires_review", "outcome")
    assert [(x.description, int(x.quantity)) for x in own.first()["lines"]] == [("Bolt", 3)]
    changes = [
        ("lines[0].quantity", "-5", "not positive"), ("currency", "EURO!", "not three letters"), ("vendor_name", " ", "empty"), ("vendor_name", "N/A", "empty"), ("total_amount", "(7)", "not a number"),
        ("doc_date", "31/01/24", "not an ISO date"), ("lines[99].quantity", "1", "no such line"), ("lines[0].colour", "x", "unknown field"), ("lines[0]", "x", "unknown field"), ("lines[0].line_number", "0", "not a line number"),
        ("lines[0].unit_price", "-1", "negative"), ("lines[0].reference", "R-9", None), ("lines[0].line_number", "4", None), ("invoice_number", "good", None), ("invoice_number", "N/A", "empty"),
        ("invoice_date", "2024-02-29", None), ("vendor_name", None, None), ("lines[0].quantity", "1e1", None), ("tax_amount", "7", None), ("tax_amount", None, None),
    ]
    corrections = spark.createDataFrame([(1, i, p, v) for i, (p, v, _) in enumerate(changes)] + [(2, 0, "currency", "EUR")], "doc_id long, seq int, field_path string, value string")
    fixed, rejected = D.apply_corrections(own, corrections)
    assert {(r.doc_id, r.seq): r.reason for r in rejected.collect()} == {(1, i): why for i, (_, _, why) in enumerate(changes) if why} | {(2, 0): "no candidate"}
    r = fixed.first()
    assert (r.invoice_number, r.vendor_name, r.doc_date, r.tax_amount, r.currency) == ("good", None, datetime.date(2024, 2, 29), None, "USD")
    assert (int(r.lines[0].quantity), r.lines[0].reference, r.lines[0].line_number) == (10, "R-9", 4)


def test_casefold_is_that_of_the_language(spark):
    texts = ["Straße ΣΊΣΥΦΟΣ", "İı ﬁ ŉ", "𐐀 abc", "", None]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(S.casefold("t").alias("f")).collect()
    assert [r.f for r in got] == [t.casefold() if t is not None else None for t in texts]


# Stored tables


def signal_rows(spark, ids):
    return spark.createDataFrame([(f"{i:04d}", i, 1, "T") for i in ids], "fingerprint string, invoice_id long, po_id long, anomaly_type string")


def test_a_change_rewrites_its_buckets_alone(spark, tmp_path):
    table = KeyedTable(spark, f"file://{tmp_path}/t", ["fingerprint"], 16)
    table.change(signal_rows(spark, range(400)), lambda old, new: new)
    before = table.manifest()["folders"]
    few = signal_rows(spark, [3, 1000])
    table.change(few, lambda old, new: old.unionByName(new).dropDuplicates(["fingerprint"]))
    after, touched = table.manifest()["folders"], table.touched(few)
    assert 1 <= len(touched) <= 2 and all((before[b] != after[b]) == (b in touched) for b in before)
    assert table.read().count() == 401 and table.read(1).count() == 400
    table.vacuum(1)
    assert table.read().count() == 401 and table.manifest()["version"] == 2


def test_signals_are_stored_once_whatever_is_repeated(spark, tmp_path):
    table = KeyedTable(spark, f"file://{tmp_path}/t", ["fingerprint"], 4)
    for ids in ([1, 2, 2], [2, 3], [2, 3], []):
        sinks.store_signals(table, signal_rows(spark, ids))
    assert sorted(r.invoice_id for r in table.read().collect()) == [1, 2, 3]


def test_a_writer_that_dies_or_is_overtaken_leaves_the_table(spark, tmp_path):
    table = KeyedTable(spark, f"file://{tmp_path}/t", ["fingerprint"], 4)
    sinks.store_signals(table, signal_rows(spark, [1]))

    def dies(old, new):
        raise RuntimeError("gone")

    with pytest.raises(RuntimeError):
        table.change(signal_rows(spark, [2]), dies)
    with pytest.raises(Conflict):
        table.commit(0, table.manifest()["schema"], {})
    other, turns = KeyedTable(spark, f"file://{tmp_path}/t", ["fingerprint"], 4), []

    def overtaken(old, new):
        if not turns:
            sinks.store_signals(other, signal_rows(spark, [3]))
        turns.append(1)
        return sinks.append_new_signals(old, new)

    table.change(signal_rows(spark, [2, 3]), overtaken, append=True)
    assert len(turns) == 2 and sorted(r.invoice_id for r in table.read().collect()) == [1, 2, 3]


def test_a_stream_that_stops_in_the_middle_adds_nothing_twice(spark, tmp_path):
    t = small_tables(spark)
    folder = f"file://{tmp_path}"
    for i in range(3):
        t.inv.where(F.col("invoice_id") % 3 == i).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    sink, calls = KeyedTable(spark, f"{folder}/out", ["fingerprint"], 4), []

    def tables(s, batch):
        calls.append(1)
        if len(calls) == 2:
            raise RuntimeError("killed")
        return t

    for _ in range(2):
        stream = spark.readStream.schema(t.inv.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
        query = jobs.scan_stream(stream, tables, sink, f"{folder}/state")
        try:
            query.awaitTermination()
        except Exception as e:
            assert "killed" in str(e)
    # The last batch ran, was stored, and is then repeated as after a failure before its commit.
    sinks.store_signals(sink, jobs.scan_batch(t.inv.where("invoice_id % 3 = 2"), t))
    got, want = rows_of(sink.read().select("fingerprint")), rows_of(A.detect_invoices(t).select("fingerprint").distinct())
    assert got == want and len(calls) == 4
