"""The timeline's log: whole scans, few files."""

from datetime import datetime

from fleetlint.operators import timeline
from fleetlint.operators.snapshot_log import MANIFEST_SCHEMA, SnapshotLog


def scan(spark, number, repos=5):
    rows = [(r, number, datetime(2024, 1, 1 + number % 9), 50 + number, '{"Security": 1.5}' if r else "{bad", 3, 0, "")
            for r in range(repos)]
    return spark.createDataFrame(rows, timeline.SNAPSHOT_SCHEMA)


def keys(rows):
    return sorted((r.repo_id, r.snapshot_id, r.scan_id) for r in rows.collect())


def test_many_scans_are_few_folders(spark, tmp_path):
    log = SnapshotLog(spark, str(tmp_path), folders=3, writers=2)
    assert log.read().collect() == [] and log.live() == []
    for k in range(9):
        assert log.commit(scan(spark, k), f"s{k}")
        assert not log.commit(scan(spark, k), f"s{k}")
        assert len(log.live()) <= 3
    assert keys(log.read()) == sorted((r, k, f"s{k}") for r in range(5) for k in range(9))
    assert keys(log.read(2)) == [(2, k, f"s{k}") for k in range(9)]
    scores = {r.repo_id: r.category_scores for r in log.read().collect()}
    assert scores[0] == {} and scores[1] == {"Security": 1.5}
    log.compact()
    assert len(log.live()) == 1 and len(log.read(1).inputFiles()) <= 18
    assert not log.commit(scan(spark, 0), "s0")


def test_a_scan_that_fails_is_not_seen(spark, tmp_path):
    log = SnapshotLog(spark, str(tmp_path))
    log.commit(scan(spark, 0), "a")
    log._write(scan(spark, 1).selectExpr("*", "'b' AS scan_id"))  # written, but never named
    assert keys(log.read()) == [(r, 0, "a") for r in range(5)]
    assert log.commit(scan(spark, 1), "b") and len(keys(log.read())) == 10
    assert log.commit(scan(spark, 2).limit(0), "none") and not log.commit(scan(spark, 2), "none")
    assert len(keys(log.read())) == 10


def test_large_folders_are_left_alone(spark, tmp_path):
    log = SnapshotLog(spark, str(tmp_path), folders=2, small=10)
    log.commit(scan(spark, 0, repos=20), "big")
    big = log.live()
    for k in (1, 2, 3):
        log.commit(scan(spark, k), f"s{k}")
    assert set(big) <= set(log.live()) and len(keys(log.read())) == 35
    assert log.manifest().select(*[c.split()[0] for c in MANIFEST_SCHEMA.split(", ")]).count() == 4
