"""A sample of the catalog against DuckDB; all of it with FLEETLINT_ALL_QUERIES=1."""

import os
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

import __spark_entry__ as entry_point  # noqa: E402
from check import TABLES, rows_of  # noqa: E402

SF_DIR = "/root/testdata/sf0.001"
SAMPLE = [
    "s1_load_trees", "rule_sec_secret", "rule_arch_circ", "rule_doc_lowdocstrings", "s2_skip_rules", "s5_calls", "a2_category_scores",
    "a8_summaries", "w2_changes", "t2_first_findings", "u1_all_findings", "r12_rebuilt_files", "g5_decisions",
    "g7_verdicts", "j11_compare_findings", "k4_report_lines",
]

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="test tables not at hand")


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{SF_DIR}/{name}.parquet')")
    return con


@pytest.mark.parametrize("name", list(entry_point.oracle_sql()) if os.environ.get("FLEETLINT_ALL_QUERIES") else SAMPLE)
def test_query(spark, con, name):
    df = entry_point.queries()[name](spark, SF_DIR)
    result = con.execute(entry_point.oracle_sql()[name])
    assert rows_of(df.columns, df.collect()) == rows_of([d[0] for d in result.description], result.fetchall())


def test_every_query_has_sql():
    corpus = {n for n in entry_point.queries() if n.startswith("op") or n == "pipeline"}
    assert set(entry_point.queries()) - set(entry_point.oracle_sql()) - corpus == set()
    assert set(entry_point.oracle_sql()) <= set(entry_point.queries())
