"""A part of the registered queries against DuckDB, value by value, on the smallest tables."""

import os

import pytest

from matchline.registry import ORACLE_SQL, QUERIES

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
CHECKED = """a7_detect_invoices a9_detect_exceptions d1_classify d2_labelled_fields d4_stacked_lines d8_outcome d9_route_reviews d12_promote d14_grounded_values e9_match_lines
d13_compare_candidates d14_unsupported_fields e10_case_scores k5_score_profiles p7_embed_versions p8_retrieve r3_header_exceptions r13_r14_unit_results r15_reconcile s5_upsert_exceptions s9_check_intake_links t1_scan_stream t2_trend_stream w11_list_plans w13_document_facts w15_review_queue w16_policy_library w26_plan_history w28_exception_detail w1_anomaly_summary w19_plan_status_execution a10_scan_in_parts a11_two_pages d6_orders_and_receipts d10_apply_corrections
e1_expected_chunks e15_latency_summary p5_embed_hash p8_retrieve_for_exceptions s5_stored_exceptions t2_weekly_late_rows w1_sketched_summary w2_vendor_anomaly_summary""".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")


def same(x):
    return f"{x:.6f}" if isinstance(x, float) else str(x)


@pytest.mark.parametrize("name", CHECKED)
def test_query_equals_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    got = QUERIES[name](spark, DATA)
    columns = sorted(got.columns)
    own = sorted(tuple(same(r[c]) for c in columns) for r in got.collect())
    result = con.execute(ORACLE_SQL[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    assert own == sorted(tuple(same(r[names.index(c)]) for c in columns) for r in result.fetchall())


def test_every_query_is_registered():
    assert len(QUERIES) > 130 and set(ORACLE_SQL) <= set(QUERIES)
