"""Snapshots arriving as a stream, recorded once each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from fleetlint.operators.timeline import SNAPSHOT_SCHEMA, snapshots_from_events

EVENT_SCHEMA = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


def read_event_stream(spark: SparkSession, path: str) -> DataFrame:
    return snapshots_from_events(spark.readStream.schema(EVENT_SCHEMA).parquet(path))


KEY = ["repo_id", "snapshot_id"]
OUTCOMES = ("kept", "late", "repeated")


def outcomes(batch: DataFrame, known: DataFrame, newest: Column, lateness: str) -> DataFrame:
    """Every distinct row of a batch with what becomes of it and how many times: ``outcome``, ``copies``.

    A row is late if it lies ``lateness`` or more behind the newest row of the
    batches before. Of the others with one key the first by time is kept,
    unless ``known`` has the key; the rest are repeats. Rows without a key
    cannot be told apart and are kept. Copies are counted
    before any shuffle, so a row that is repeated many times is no hot key.
    """
    columns = batch.columns
    late = F.coalesce(F.col("ts") <= newest - F.expr(f"INTERVAL {lateness}"), F.lit(False))
    rows = batch.groupBy(*columns).agg(F.count(F.lit(1)).alias("n")).withColumn("late", late)
    whole = F.struct("ts", *[c for c in columns if c != "ts"])
    firsts = rows.filter("not late").groupBy(*KEY).agg(F.min(whole).alias("first"))
    new = firsts.join(known.select(*KEY), KEY, "left_anti")
    nameless = F.col(KEY[0]).isNull() | F.col(KEY[1]).isNull()
    kept = F.when(F.col("late"), 0).when(nameless, F.col("n")).otherwise(
        F.coalesce(whole == F.col("first"), F.lit(False)).cast("bigint"))
    marked = rows.join(new, KEY, "left").withColumn("kept", kept.cast("bigint"))

    def part(outcome, copies):
        return F.when(copies > 0, F.struct(F.lit(outcome).alias("outcome"), copies.alias("copies")))

    parts = F.array(
        part("late", F.when(F.col("late"), F.col("n")).otherwise(0).cast("bigint")), part("kept", F.col("kept")),
        part("repeated", F.when(F.col("late"), 0).otherwise(F.col("n") - F.col("kept")).cast("bigint")))
    return marked.select(*columns, F.inline(F.filter(parts, lambda x: x.isNotNull())))


def start_recording(
    snapshots: DataFrame, log: str, checkpoint: str, lateness: str = "1 day", **trigger
) -> StreamingQuery:
    """Record arriving snapshots once each; late and repeated ones come out beside them.

    One stream decides about every row, so kept, late and repeated rows are
    together exactly what arrived. ``log/rows`` gets a folder per batch and
    outcome. ``log/state`` keeps, per batch, the newest time so far and the keys
    a repeat of which need not be late yet (two lateness bounds back): it grows
    with the bound, not with the history. A batch reads the state that the one
    before left and writes its own folders over if it is repeated.
    """

    def handle(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        state_type = batch.select(*KEY, "ts").schema
        if batch_id:
            before = spark.read.schema(state_type).parquet(f"{log}/state/batch_id={batch_id - 1}")
            mark = before.agg(F.max("ts").alias("newest")).first()["newest"]
        else:
            before, mark = spark.createDataFrame([], state_type), None
        known = before.filter("repo_id is not null")
        rows = f"{log}/rows/batch_id={batch_id}"
        outcomes(batch, known, F.lit(mark).cast("timestamp"), lateness).write.mode("overwrite").partitionBy("outcome").parquet(rows)
        written = spark.read.schema(T.StructType([
            *batch.schema.fields, T.StructField("copies", T.LongType()), T.StructField("outcome", T.StringType())])).parquet(rows)
        newest = written.agg(F.greatest(F.max("ts"), F.lit(mark).cast("timestamp")).alias("t")).first()["t"]
        horizon = F.lit(newest).cast("timestamp") - 2 * F.expr(f"INTERVAL {lateness}")
        kept = written.filter("outcome = 'kept'").select(*KEY, "ts")
        none = F.lit(None).cast("bigint")
        top = spark.range(1).select(none.alias("repo_id"), none.alias("snapshot_id"), F.lit(newest).cast("timestamp").alias("ts"))
        (known.unionByName(kept).filter((F.col("ts") > horizon) & F.col("repo_id").isNotNull()).unionByName(top)
         .write.mode("overwrite").parquet(f"{log}/state/batch_id={batch_id}"))

    return (snapshots.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"availableNow": True})).start())


def recorded(spark: SparkSession, log: str, outcome: str = "kept") -> DataFrame:
    """The rows of one outcome, with ``copies`` and ``batch_id``."""
    schema = SNAPSHOT_SCHEMA + ", copies bigint, outcome string, batch_id bigint"
    return spark.read.schema(schema).parquet(f"{log}/rows").filter(F.col("outcome") == outcome)
