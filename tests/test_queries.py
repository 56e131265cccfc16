"""Registered queries against their SQL, on the smallest tables."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
from oracle.compare import differences
from oracle.queries import ORACLE, QUERIES
from tests.conftest import SF

CHECKED = ["mod2_whole_scan", "mod1_fast_scan", "url4_extract_urls", "url5_url_risk", "key2_short_words", "cus1_user_rules",
           "src3_directory_scan", "src5_binary_filter", "src9_target_types", "src10_keyword_rows", "ren2_hidden_element",
           "ren3_hidden_link", "ren5_cloaking", "agg1_statistics", "agg5_page_verdicts", "agg6_counters", "set2_first_of_location", "dom0_elements", "src6_decode", "src12_user_rule_rows",
           "snk2_csv_rows", "snk4_text_rows", "snk5_report_sections", "err1_errors", "udf1_user_detector", "udf3_csv_report",
           "udf3_json_report", "mod3_run_of_targets", "key1_keywords", "hid3_color_match", "cus2_flags"]


@pytest.fixture(scope="module")
def tables():
    connection = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        connection.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return connection


@pytest.mark.parametrize("name", CHECKED)
def test_query_equals_sql(spark, tables, name):
    ours, theirs, only_ours, only_theirs = differences(QUERIES[name](spark, SF), tables, ORACLE[name])
    assert ours == theirs and not only_ours and not only_theirs


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE)


def test_entry(spark):
    assert entry.entry(spark).count() == 50
