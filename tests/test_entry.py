"""Registered queries against their SQL on the small tables, and the shape of their plans."""

import pathlib
import subprocess
import sys

import duckdb
import pytest

import __spark_entry__ as entry
import check
from muster.registry import REGISTRY

FOLDER = "/root/testdata/sf0.001"
SAMPLE = [
    "c1_normalize", "c12_classify", "c15_title", "c20_token_score", "r4_search_roster", "f2_has_lesson", "f5_text_filter",
    "j1_reconcile_slots", "j2_attribute_mismatches", "j6_occupancy_grid", "j10_assign_cells", "j13_nearest_match",
    "a7_weekly_lessons", "a8_block_counts", "a10_day_period_counts", "q10_dataset_digest", "q12_archive_rules", "s2_roster_from_cells",
    "t2_post_records", "u2_multiset_diff", "w1_sequence_breaks", "w4_status_changes", "o2_page",
    "q13_audit_full_report", "j7_school_map", "j9_match_by_media", "c19_osa_distance", "q7_class_overlap", "j14_unallocated", "j10_page_lessons",
    "q10_differing_ranges", "q10_diff_in_ranges", "f5_text_filter_many", "s4_scan_files", "s3_snapshot_files", "s1_payload_metadata",
    "s5_report_document", "a17_import_report_rows", "t3_archive_metadata",
]


@pytest.fixture(scope="module")
def con():
    connection = duckdb.connect()
    for table in check.TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    return connection


@pytest.mark.parametrize("key", SAMPLE)
def test_query_equals_its_sql(spark, con, key):
    df = entry.queries()[key](spark, FOLDER)
    cursor = con.execute(entry.oracle_sql()[key])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == sorted(df.columns)
    assert check.canonical([tuple(r) for r in df.collect()], df.columns) == check.canonical(cursor.fetchall(), names)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_entry_returns_rows(spark):
    assert entry.entry(spark).count() > 0


def test_every_query_has_sql():
    assert set(REGISTRY) <= set(entry.oracle_sql()) <= set(entry.queries())


def test_scans_read_only_what_they_need(spark):
    plan = entry.queries()["f3_slot_containment"](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema" in plan and "l_tax" not in plan and "l_shipdate" not in plan


def test_entry_works_without_the_optional_package():
    code = (
        "import sys\n"
        "class Gone:\n"
        "    def find_spec(self, name, path=None, target=None):\n"
        "        if name.startswith(('muster.llm', 'corpus_pipeline')):\n"
        "            raise ImportError(name)\n"
        "sys.meta_path.insert(0, Gone())\n"
        "import __spark_entry__ as e\n"
        "from muster.registry import REGISTRY\n"
        "assert set(e.queries()) == set(e.oracle_sql()) == set(REGISTRY)\n"
    )
    subprocess.run([sys.executable, "-c", code], check=True, cwd=pathlib.Path(entry.__file__).parent)
