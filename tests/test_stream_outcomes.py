"""What becomes of arriving snapshots: kept, late or repeated, and nothing else."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from fleetlint.operators.timeline import SNAPSHOT_SCHEMA
from fleetlint.streaming import snapshots

START = datetime(2024, 1, 10)


def row(repo, snapshot, hours, tenths=50):
    return (repo, snapshot, START + timedelta(hours=hours), tenths, "{}", 1, 0, "")


def test_outcomes_of_batches(spark, tmp_path):
    batches = [
        [row(1, 1, 0), row(1, 1, 0), row(1, 1, 1), row(2, 1, 48), row(2, 2, 24.0)],
        # The newest was at 48 h, so 24 h is the bound: what lies on it is late.
        [row(3, 1, 24), row(3, 2, 24.001), row(2, 1, 48), row(2, 2, 30), row(4, 1, 0), row(4, 1, 0)],
        [],
        [row(2, 1, 60, 51), row(5, 1, 200), row(5, 1, 199), row(None, 7, 70), row(None, 7, 70)],
        [row(2, 1, 180), row(5, 1, 200), row(6, 1, 176)],
    ]
    want = {
        (0, "kept"): [(1, 1, 0, 1), (2, 1, 48, 1), (2, 2, 24, 1)], (0, "repeated"): [(1, 1, 0, 1), (1, 1, 1, 1)],
        (1, "late"): [(3, 1, 24, 1), (4, 1, 0, 2)], (1, "kept"): [(3, 2, 24.001, 1)],
        (1, "repeated"): [(2, 1, 48, 1), (2, 2, 30, 1)],
        (2, "repeated"): [(2, 1, 60, 1), (5, 1, 200, 1)], (2, "kept"): [(5, 1, 199, 1), (None, 7, 70, 2)],
        # 200 h is the newest; the key of 48 h is forgotten, it lies more than two days back.
        (3, "kept"): [(2, 1, 180, 1)], (3, "repeated"): [(5, 1, 200, 1)], (3, "late"): [(6, 1, 176, 1)],
    }
    landing, log, checkpoint = (str(tmp_path / n) for n in ("in", "log", "cp"))
    total = 0
    for batch in batches:
        if batch:
            spark.createDataFrame(batch, SNAPSHOT_SCHEMA).coalesce(1).write.mode("append").parquet(landing)
        stream = spark.readStream.schema(SNAPSHOT_SCHEMA).parquet(landing)
        snapshots.start_recording(stream, log, checkpoint).awaitTermination()
        total += len(batch)
    got = {}
    for outcome in snapshots.OUTCOMES:
        for r in snapshots.recorded(spark, log, outcome).collect():
            hours = round((r.ts - START).total_seconds() / 3600, 3)
            got.setdefault((r.batch_id, outcome), []).append((r.repo_id, r.snapshot_id, hours, r.copies))
    assert {k: sorted(v, key=repr) for k, v in got.items()} == {k: sorted(v, key=repr) for k, v in want.items()}
    assert sum(c for rows in got.values() for *_, c in rows) == total
    # The state holds what lies within two bounds, and the newest time.
    state = spark.read.parquet(f"{log}/state/batch_id=3")
    assert sorted((r.repo_id or 0, r.snapshot_id or 0) for r in state.collect()) == [(0, 0), (2, 1), (5, 1)]


def test_a_repeated_batch_changes_nothing(spark):
    rows = spark.createDataFrame([row(1, 1, 0), row(1, 2, 5)], SNAPSHOT_SCHEMA)
    known = spark.createDataFrame([(1, 2)], "repo_id bigint, snapshot_id bigint")
    out = [
        sorted((r.snapshot_id, r.outcome, r.copies) for r in
               snapshots.outcomes(rows.repartition(n), known, F.lit(None).cast("timestamp"), "1 day").collect())
        for n in (1, 3)
    ]
    assert out[0] == out[1] == [(1, "kept", 1), (2, "repeated", 1)]
