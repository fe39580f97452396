"""Trees on disk, reports, timeline log and streams."""

from datetime import datetime

from pyspark.sql import functions as F

from fleetlint.operators import timeline
from fleetlint.plans import report
from fleetlint.plans.audit import Audit
from fleetlint.sources.files import list_trees, load_trees, read_listed, read_trees, source_lines, write_trees
from fleetlint.sources.trees import TreeReader
from fleetlint.streaming import arrivals, snapshots


def test_load_trees(spark, tmp_path):
    root = tmp_path / "demo"
    for name, data in {
        "a/b/__init__.py": b"", ".gitignore": b".env\n", ".github/workflows/ci.yml": b"on: push\n",
        "bad.py": b"x = '\xff\xfe'\r\ny = 1", "big.txt": b"x" * (2 * 1024 * 1024 + 1),
        "edge.txt": b"x" * (2 * 1024 * 1024), "node_modules/x.py": b"", ".venv/y.py": b"", "p.PNG": b"", ".png": b"z",
        "a.tar.gz": b"", "build/z.py": b"", "LICENSE": b"MIT\n", "A.PY": b"",
    }.items():
        target = root / name
        target.parent.mkdir(parents=True, exist_ok=True)
        target.write_bytes(data)
    (root / "link").symlink_to(root / "a")
    rows = {r.path: r for r in load_trees(spark, [str(root)]).collect()}
    assert set(rows) == {"a/b/__init__.py", ".gitignore", ".github/workflows/ci.yml", "bad.py", "edge.txt", ".png",
                         "LICENSE", "A.PY"}
    assert rows["bad.py"].content == "x = '��'\ny = 1" and rows["bad.py"].loc == 2
    assert rows["bad.py"].repo_name == "demo" and rows["bad.py"].is_python and not rows["A.PY"].is_python
    strict = {r.path for r in load_trees(spark, [str(root)], admit_dirs=()).collect()}
    assert strict == set(rows) - {".github/workflows/ci.yml"}


def test_what_cannot_be_read_is_a_row(spark, tmp_path):
    (tmp_path / "r" / "src").mkdir(parents=True)
    (tmp_path / "r" / "src" / "a.py").write_text("x = 1\n")
    (tmp_path / "r" / "gone.py").symlink_to(tmp_path / "nowhere")
    rows = {(r.root[len(str(tmp_path)):], r.path): r for r in
            read_trees(spark, [str(tmp_path / "r"), f"file://{tmp_path}/none"]).collect() if r.root.startswith("/")}
    assert rows["/r", "src/a.py"].content == b"x = 1\n" and rows["/r", "src/a.py"].error is None
    assert rows["/r", "gone.py"].error and rows["/r", "gone.py"].content is None
    missing = read_trees(spark, [f"file://{tmp_path}/none"]).collect()
    assert len(missing) == 1 and missing[0].path == "" and "none" in missing[0].error
    assert load_trees(spark, [str(tmp_path / "r")]).count() == 1
    vanished = spark.createDataFrame([(str(tmp_path / "r"), "src/b.py", 3, None)], list_trees(spark, []).schema)
    assert [(r.content, bool(r.error)) for r in read_listed(vanished).collect()] == [(None, True)]
    assert list_trees(spark, []).collect() == []


def test_trees_are_dealt_to_tasks(tmp_path):
    for k in range(40):
        folder = tmp_path / "big" / "src" / f"p{k}" / "q"
        folder.mkdir(parents=True)
        (folder / "m.py").write_text("")
        (tmp_path / "big" / f"top{k}.py").write_text("")
    reader = TreeReader({"parent": str(tmp_path), "splits": "8"})
    parts = reader.partitions()
    rows = [r for p in parts for r in reader.read(p)]
    assert len(parts) == 8 and len(rows) == len({r[1] for r in rows}) == 80
    assert max(sum(1 for _ in reader.read(p)) for p in parts) <= 12


def test_written_trees_are_read_back(spark, fleet_of, tmp_path):
    files = fleet_of({"r": {"a.py": "x = 1\n", ".gitignore": "é\n", "p/__init__.py": ""}, "s": {"_b.py": "y"}})
    assert write_trees(files, f"file://{tmp_path}/t") == 4 == write_trees(files, f"file://{tmp_path}/t")
    back = load_trees(spark, parent=f"file://{tmp_path}/t").select("repo_name", "path", "content", "loc", "is_python")
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, files.select(*back.columns).collect()))
    assert write_trees(files.limit(0), str(tmp_path / "none")) == 0


def test_lines(spark, fleet_of):
    files = fleet_of({"r": {"a": "x\r\ny\rz\n\n", "b": "", "c": "\n", "d": "q"}})
    got = [(r.path, r.line_no, r.text) for r in source_lines(files).collect()]
    assert sorted(got) == [("a", 1, "x"), ("a", 2, "y"), ("a", 3, "z"), ("a", 4, ""), ("c", 1, ""), ("d", 1, "q")]
    assert {r.path: r.loc for r in files.collect()} == {"a": 4, "b": 0, "c": 1, "d": 1}


def test_report_files_are_whole_and_ordered(spark, fleet_of, tmp_path):
    files = fleet_of({"r": {f"src/m{k:03}.py": "eval(x)\n" for k in range(150)}, "s": {"a.py": "x = 1\n"}})
    audit = Audit(files, scanned_at=datetime(2023, 5, 6, 7, 8))
    lines = report.report_lines(audit)
    out = str(tmp_path / "reports")
    report.write_reports(lines, out)
    text = "\n".join(r.text for r in report.read_report(spark, out, 0).collect())
    want = [r.text for r in lines.filter("repo_id = 0").orderBy("section", "ord", "place", "sub").collect()]
    assert text.rstrip("\n").split("\n") == "\n".join(want).split("\n")
    assert text.startswith("# Audit of r\nScanned on 2023-05-06 at 07:08 UTC.\n150 files, 150 of them Python; 150 lines.\n")
    assert "\n151. " in text and text.count(". Arbitrary Code Execution") == 150 and text.count("(critical, ") == 151
    assert sorted(map(tuple, report.read_reports(spark, out).collect())) == sorted(map(tuple, lines.collect()))
    records = report.diagnosis_records(audit)
    report.write_diagnosis(records, str(tmp_path / "json"))
    back = spark.read.json(str(tmp_path / "json"))
    assert back.count() == audit.findings.count() + 2


def test_timeline_log(spark, tmp_path):
    rows = [(1, k, datetime(2024, 1, 1 + k), score, '{"Security": 1.5}' if k else "{bad", 10, k, "" if k < 3 else "By hand")
            for k, score in enumerate([71, 68, 80, 80])]
    shots = spark.createDataFrame(rows, timeline.SNAPSHOT_SCHEMA)
    log = str(tmp_path / "log")
    for _ in range(2):
        timeline.record_snapshots(shots.filter("snapshot_id < 2"), log, "a")
    timeline.record_snapshots(shots.filter("snapshot_id >= 2"), log, "b")
    back = timeline.read_snapshots(spark, log, 1)
    assert [r.category_scores for r in back.orderBy("ts").collect()] == [{}] + [{"Security": 1.5}] * 3
    entries = timeline.timeline(back.select(*shots.columns)).orderBy("version_no").collect()
    assert [(e.version, e.description) for e in entries] == [
        ("v1", "Initial scan & diagnosis"), ("v2", "Repaired 1 issues (Score -0.3)"),
        ("v3", "Repaired 2 issues (Score +1.2)"), ("v4", "By hand")]
    path = timeline.trajectory(back).first()
    assert (path.first_tenths, path.latest_tenths, path.versions, path.delta_text) == (71, 80, 4, "+0.9")


def test_arrivals_in_two_batches(spark, fleet_of, tmp_path):
    landing, out, cp = (str(tmp_path / d) for d in ("in", "out", "cp"))
    first = {"r": {"a.py": "eval(x)\n", "b.py": "x = 1\n"}, "s": {"a.py": "exec(x)\n"}}
    second = {"r": {"a.py": "y = 1\n", "README.md": "short"}}
    fleet_of(first).coalesce(1).write.parquet(landing)
    arrivals.start_scan(spark, landing, out, cp).awaitTermination()
    one = arrivals.current_findings(spark, out)
    assert one.filter("rule_id = 'SEC-EXEC'").count() == 2 and one.filter("rule_id = 'DOC-NOREADME'").count() == 2
    fleet_of(second).coalesce(1).write.mode("append").parquet(landing)
    arrivals.start_scan(spark, landing, out, cp).awaitTermination()
    now = arrivals.current_findings(spark, out).drop("scope", "metadata")
    final = {"r": {**first["r"], **second["r"]}, "s": first["s"]}
    want = Audit(fleet_of(final)).findings.drop("metadata")
    assert sorted(map(tuple, now.select(*want.columns).collect()), key=str) == sorted(map(tuple, want.collect()), key=str)


def test_snapshot_stream_drops_repeats(spark, tmp_path):
    folder = tmp_path / "events"
    rows = [(k, datetime(2024, 1, 1, k), 7, "view", 5.0 * k, "{}") for k in range(6)]
    schema = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(folder))
    log, cp = str(tmp_path / "log"), str(tmp_path / "cp")
    for _ in range(2):
        snapshots.start_recording(snapshots.read_event_stream(spark, str(folder)), log, cp).awaitTermination()
        spark.createDataFrame(rows[3:], schema).coalesce(1).write.mode("append").parquet(str(folder))
    recorded = snapshots.recorded(spark, log)
    assert recorded.count() == 6
    assert snapshots.recorded(spark, log, "repeated").count() == 3
    assert snapshots.recorded(spark, log, "late").count() == 0
    assert recorded.filter(F.col("overall_tenths") == 35).count() == 1
