"""What moves and how often: plans and files that must not grow faster than the input."""

import glob

import pytest
from pyspark.sql import functions as F

from fleetlint import catalog
from fleetlint.operators import explore, mldata, repair
from fleetlint.plans import report
from fleetlint.plans.audit import Audit
from fleetlint.plans.repair import Repair
from fleetlint.sources import corpus
from fleetlint.streaming import arrivals


@pytest.fixture
def settings(spark):
    """Sets options for one test."""
    old = {}

    def put(**options):
        for key, value in options.items():
            name = key.replace("__", ".")
            old[name] = spark.conf.get(name)
            spark.conf.set(name, value)

    yield put
    for name, value in old.items():
        spark.conf.set(name, value)


def operators(df, name):
    """The input columns of every operator of a kind, from the plan in words."""
    text = df._jdf.queryExecution().explainString(
        df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    return [part.split("Input")[1].split("\n")[0] for part in text.split("\n\n") if f") {name}\n" in part and "Input" in part]


def stored(spark, files, tmp_path):
    files.write.parquet(str(tmp_path / "files"))
    return spark.read.parquet(str(tmp_path / "files"))


def test_export_is_compressed(spark, tmp_path):
    rows = spark.range(3000).select(
        (F.col("id") % 7).alias("repo_id"), F.lit("finding").alias("section"), F.col("id").cast("string").alias("key"),
        F.to_json(F.struct(F.lit("Missing file").alias("title"), F.col("id"))).alias("json"))
    report.write_diagnosis(rows, str(tmp_path / "out"))
    assert glob.glob(str(tmp_path / "out" / "bucket=*" / "*.json.gz"))
    assert not glob.glob(str(tmp_path / "out" / "bucket=*" / "*.json"))
    back = report.read_diagnosis(spark, str(tmp_path / "out"), "finding")
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, rows.collect()))


def test_comparing_rewritten_files_moves_digests_only(spark, fleet_of, tmp_path, settings):
    settings(spark__sql__autoBroadcastJoinThreshold="-1")
    files = stored(spark, fleet_of({"a": {"a.py": "x = 1\n", "b.py": "y = 1\n", "c.py": "z = 1\n"}}), tmp_path)
    new = spark.createDataFrame([(0, "a.py", "x = 2\n"), (0, "b.py", "y = 1\n"), (0, "d.py", "w = 1\n")],
                                "repo_id bigint, path string, content string")
    changes = explore.rewritten_files(files, new)
    moved = operators(changes, "Exchange")
    assert moved and not any("content" in columns for columns in moved)
    assert sorted(map(tuple, changes.collect())) == [(0, "a.py", "modified"), (0, "d.py", "added")]


def test_proposals_meet_digests_only(spark, fleet_of, tmp_path, settings):
    settings(spark__sql__autoBroadcastJoinThreshold="-1")
    files = stored(spark, fleet_of({"a": {"a.py": "x = 1\n", "b.py": "y = 1\n"}}), tmp_path)
    accepted = spark.createDataFrame(
        [("F1", "cause", "x = 2\n", 0, "SEC-SHELL", "a.py", "T"), ("F2", None, "y = 1\n", 0, "SEC-SHELL", "b.py", "T")],
        "finding_id string, root_cause string, replacement_code string, repo_id bigint, rule_id string, path string, title string")
    patches = repair.proposal_patches(accepted, files)
    assert not any("content" in columns for columns in operators(patches, "Exchange"))
    assert [r.finding_id for r in patches.collect()] == ["F1"]


def test_texts_of_few_files_are_not_shuffled(spark, fleet_of, tmp_path):
    files = stored(spark, fleet_of({"a": {"a.py": "import subprocess\nsubprocess.run('ls', shell=True)\n"}}), tmp_path)
    patches = spark.range(1).select(
        F.lit(0).cast("bigint").alias("repo_id"), F.lit("F1").alias("finding_id"), F.lit("SEC-SHELL").alias("rule_id"),
        F.lit("a.py").alias("path"), F.lit("x = 1\n").alias("replacement_code")).union(
            spark.createDataFrame([(0, "F2", "DOC-NOREADME", "README.md", "# A\n")], "a bigint, b string, c string, d string, e string"))
    # Shuffled as patches are once they are a table of their own.
    given = repair.with_originals(patches.repartition(3), files)
    assert not any("content" in columns for columns in operators(given, "Exchange"))
    assert {(r.finding_id, r.original_code[:6]) for r in given.collect()} == {("F1", "import"), ("F2", "")}

    audit = Audit(files, for_repair=True)
    again = Repair(audit, corpus.test_runs)
    again.repaired = spark.createDataFrame([(0, "a.py", "x = 3\n")], "repo_id bigint, path string, content string")
    assert not any("content" in columns for columns in operators(again.repaired_files, "Exchange"))
    assert [(r.repo_name, r.loc) for r in again.repaired_files.collect()] == [("a", 1)]


def test_a_table_of_many_splits_keeps_its_tasks(spark, tmp_path, settings):
    settings(spark__sql__files__openCostInBytes="1k", spark__sql__files__maxPartitionBytes="1k")
    for name, parts in (("many", 16), ("few", 2)):
        docs = spark.range(400).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), F.col("id")).alias("text"))
        docs.coalesce(1).repartition(parts).write.parquet(str(tmp_path / name / "documents.parquet"))
    many = catalog.Fleet(spark, str(tmp_path / "many")).files
    assert len(many.inputFiles()) > 3 * spark.sparkContext.defaultParallelism
    few = catalog.Fleet(spark, str(tmp_path / "few")).files
    assert many.exceptAll(few).count() == 0 and many.count() == few.count() > 400


def test_stream_scan_writes_few_files_per_folder(spark, tmp_path, settings):
    settings(spark__sql__files__openCostInBytes="1k", spark__sql__files__maxPartitionBytes="1k")
    rows = [(1, "r", f"src/m{k}.py", "def f(a=[]):\n    return a\n", 28, True, 2) for k in range(24)]
    landing, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "cp"))
    spark.createDataFrame(rows, arrivals.SOURCE_SCHEMA).repartition(12).write.parquet(landing)
    arrivals.start_scan(spark, landing, out, checkpoint).awaitTermination()
    assert len(glob.glob(f"{out}/scan/batch_id=*/repo_bucket=*/*.parquet")) <= arrivals.FILES_PER_BUCKET
    found = arrivals.current_findings(spark, out)
    assert found.filter("rule_id = 'QUAL-MUT'").count() == 24
    assert found.filter("rule_id = 'DOC-NOREADME'").count() == 1


def test_contamination_makes_the_grams_of_all_documents_once(spark, tmp_path, monkeypatch):
    words = "a b c d e f g h i j"
    spark.createDataFrame([(1, words), (1, "x " + words), (2, "too short"), (None, words), (3, None)],
                          "doc_id bigint, text string").write.parquet(str(tmp_path / "docs"))
    made = []
    once = mldata.materialise
    monkeypatch.setattr(mldata, "materialise", lambda df, name: made.append(name) or once(df, name))
    docs = spark.read.parquet(str(tmp_path / "docs"))
    held = spark.createDataFrame([(1, "b c d e f g h i")], "item_id bigint, text string")
    found = mldata.contamination(docs, held)
    text = found._jdf.queryExecution().executedPlan().toString()
    assert made == ["gram_totals"] and text.count("text#") and text.count(str(tmp_path / "docs")[-20:]) <= 1
    assert sorted(map(tuple, found.collect()), key=str) == [(1, 2, 7), (None, 0, 3)]
