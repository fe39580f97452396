"""Skewed keys, repeated runs and plan shapes."""

import random

import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fleetlint.operators import scoring
from fleetlint.operators.rules import structure
from fleetlint.operators.sequence import first_rows, number_rows
from fleetlint.plans import audit as plan


@pytest.fixture(scope="module")
def skewed(spark):
    rng = random.Random(7)
    rows = [(1 if rng.random() < 0.6 else rng.randrange(2, 40), k, rng.randrange(100)) for k in range(4000)]
    rng.shuffle(rows)
    return spark.createDataFrame(rows, "repo_id bigint, k bigint, v int").repartition(7)


@pytest.mark.parametrize("parts", ["1", "4", "13"])
def test_numbering_equals_a_plain_window(spark, skewed, parts):
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        got = number_rows(skewed, ["repo_id"], ["k"], previous={"v": "before"})
        window = W.partitionBy("repo_id").orderBy("k")
        want = skewed.select("repo_id", "k", "v", F.row_number().over(window).cast("bigint").alias("seq"),
                             F.lag("v").over(window).alias("before"))
        assert sorted(map(tuple, got.select("repo_id", "k", "v", "seq", "before").collect()), key=str) == sorted(
            map(tuple, want.collect()), key=str)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_hot_key_is_spread_over_parts(spark, skewed):
    ranged = skewed.repartitionByRange(8, "repo_id", "k").withColumn("p", F.spark_partition_id())
    assert ranged.filter("repo_id = 1").select("p").distinct().count() >= 4


def test_top_rows_are_limited_before_the_shuffle(skewed):
    text = first_rows(skewed, ["repo_id"], ["k"], 6)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in text and "Partial" in text


def plan_text(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_path_only_rules_read_no_content_and_parse_nothing(spark, fleet_of, tmp_path):
    path = str(tmp_path / "files")
    fleet_of({"a": {"a.py": "x = 1\n"}}).write.parquet(path)
    files = spark.read.parquet(path)
    text = plan_text(plan.findings(files, ["ARCH-INIT"]))
    assert "MapInArrow" not in text and "content" not in text.split("ReadSchema")[1].split("\n")[0]
    assert "is_python" in text.split("PushedFilters")[1].split("\n")[0]
    assert plan_text(plan.scan_files(files)).count("MapInArrow") == 1


def test_no_cross_joins_in_the_audit(fleet_of):
    audit = plan.Audit(fleet_of({"a": {"a.py": "import b\n", "b.py": "import a\n"}}))
    for table in (audit.findings, audit.scorecards, audit.summaries):
        text = plan_text(table)
        assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_result_does_not_depend_on_partitioning(spark, fleet_of):
    repos = {f"r{k}": {f"src/m{j}.py": "def f(a=[]):\n    return eval(a)\n" for j in range(k)} for k in range(1, 9)}
    files = fleet_of(repos)
    one = plan.findings(files.coalesce(1)).drop("metadata").collect()
    many = plan.findings(files.repartition(11)).drop("metadata").collect()
    assert sorted(map(tuple, one), key=str) == sorted(map(tuple, many), key=str)


def test_import_edges_with_salt_equal_a_plain_join(spark):
    rows = [(1, f"m{k}.py", True, ["os", "m1", f"m{k - 1}"]) for k in range(1, 200)]
    scanned = spark.createDataFrame(rows, "repo_id bigint, path string, is_python boolean, import_roots array<string>")
    want = {("1", f"m{k}", d) for k in range(1, 200) for d in ("m1", f"m{k - 1}") if d != f"m{k}" and d != "m0"}
    got = {(str(r.repo_id), r.src_stem, r.dst_stem) for r in structure.import_edges(scanned, scanned).collect()}
    assert got == want
    assert structure.import_edges(scanned, scanned).count() == len(want)


def test_rounding_is_half_up_in_integers(spark):
    df = spark.createDataFrame([(7049,), (7050,), (7149,), (7150,)], "k int")
    assert [r[0] for r in df.select(scoring.round_thousandths(F.col("k"))).collect()] == [70, 71, 71, 72]


def test_full_scan_reads_text_of_code_and_notes_only(spark, fleet_of, tmp_path):
    path = str(tmp_path / "files")
    fleet_of({"a": {"a.py": "x = 1\n", "data.json": "{}", "README.md": "# A\n"}}).write.parquet(path)
    text = plan_text(plan.scan_files(spark.read.parquet(path)))
    scans = [(part.split("PushedFilters")[1].split("\n")[0], part.split("ReadSchema")[1].split("\n")[0])
             for part in text.split("FileScan")[1:]]
    assert len(scans) == 2
    assert any("is_python" in pushed and "content" in schema for pushed, schema in scans)
    assert any("content" not in schema for _, schema in scans)
    assert plan.scan_files(spark.read.parquet(path)).count() == 3
