"""Versions of a keyed table: base, changes and tombstones."""

import glob

from pyspark.sql import functions as F

from fleetlint.operators import explore
from fleetlint.operators.versions import VersionedTable

SCHEMA = "k int, part string, value string"


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_versions_read_as_a_rewrite_would(spark, tmp_path):
    base = spark.createDataFrame([(k, "a", f"v{k}") for k in range(10)] + [(3, "b", "other part")], SCHEMA)
    table = VersionedTable.over(base, ["k", "part"], str(tmp_path / "t"))
    want = [{(r.k, r.part): r.value for r in base.collect()}]
    steps = [
        ([(3, "a", "new"), (20, "a", "added")], [(5, "a")]),
        ([(5, "a", "back"), (3, "a", "newer")], [(20, "a"), (99, "x")]),
        ([], [(0, "a")]),
    ]
    for changed, gone in steps:
        for _again in range(2):  # a repeated commit changes nothing
            number = table.commit(
                spark.createDataFrame(changed, SCHEMA), spark.createDataFrame(gone, "k int, part string"), len(want))
        state = {k: v for k, v in want[-1].items() if k not in gone} | {(k, p): v for k, p, v in changed}
        want.append(state)
        assert number == table.latest == len(want) - 1
    for number, state in enumerate(want):
        assert rows(table.read(number)) == sorted((*k, v) for k, v in state.items())
    changes = {(r.k, r.part): r.change for r in table.changes(1).collect()}
    assert changes == {(3, "a"): "modified", (20, "a"): "added", (5, "a"): "removed"}


def test_unchanged_rows_are_not_written(spark, tmp_path):
    base = spark.range(5_000).selectExpr("cast(id AS int) k", "'a' part", "repeat('x', 50) value")
    base.write.parquet(str(tmp_path / "base"))
    base = spark.read.parquet(str(tmp_path / "base"))
    table = VersionedTable.over(base, ["k", "part"], str(tmp_path / "t"))
    table.commit(base.filter("k < 3").withColumn("value", F.lit("new")))
    assert table.rows(1).count() == 3 and table.read().count() == 5_000
    assert not glob.glob(str(tmp_path / "t" / "base*"))
    plan = table.read()._jdf.queryExecution().toString()
    # The base is read where it lies and meets broadcast keys; no exchange of its rows.
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan and "ShuffledHashJoin" not in plan


def test_overlapping_and_odd_ranges(spark):
    files = spark.createDataFrame(
        [(1, "a.py", "one\ntwo\nthree\nfour\n"), (1, "empty.py", ""), (2, "a.py", "x")], "repo_id int, path string, content string")
    ranges = [
        (1, "a.py", 1, 3, "p"), (1, "a.py", 2, 2, "q"), (1, "a.py", 2, None, "r"), (1, "a.py", 3, 99, "s"), (1, "a.py", 0, 2, "t"),
        (1, "a.py", 5, 6, "u"), (1, "a.py", 3, 2, "v"), (1, "a.py", None, None, "w"), (1, "empty.py", 1, 1, "x"), (1, "a.py", 2, 2, "q")]
    got = explore.snippets(spark.createDataFrame(ranges, "repo_id int, path string, start_line int, end_line int, tag string"), files)
    assert got.columns == ["repo_id", "path", "start_line", "end_line", "tag", "snippet"]
    assert sorted((r.tag, r.snippet) for r in got.collect()) == [
        ("p", "one\ntwo\nthree"), ("q", "two"), ("q", "two"), ("r", "two"), ("s", "three\nfour"), ("t", ""), ("u", ""),
        ("v", ""), ("w", ""), ("x", "")]
