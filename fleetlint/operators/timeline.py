"""Health timeline: an append-only snapshot table, versions computed on read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlint.functions import text as tx
from fleetlint.operators.sequence import number_rows

SNAPSHOT_SCHEMA = (
    "repo_id bigint, snapshot_id bigint, ts timestamp, overall_tenths int, "
    "category_scores_json string, total_issues bigint, fixes_applied bigint, description string"
)
ORDER = ["ts", "snapshot_id"]


def snapshots_from_cards(cards: DataFrame, fixes: DataFrame | None = None) -> DataFrame:
    """Snapshot rows of one scan; ``fixes`` holds ``(repo_id, fixes_applied)``."""
    base = cards.withColumn("ts", F.current_timestamp())
    if fixes is None:
        base = base.withColumn("fixes_applied", F.lit(0).cast("bigint"))
    else:
        base = base.join(fixes, "repo_id", "left").na.fill(0, ["fixes_applied"])
    return base.select(
        "repo_id", F.unix_micros("ts").alias("snapshot_id"), "ts", "overall_tenths",
        F.to_json("category_scores").alias("category_scores_json"), "total_issues", "fixes_applied",
        F.lit("").alias("description"),
    )


def snapshots_from_events(events: DataFrame) -> DataFrame:
    """Snapshots read off the ``events`` table: one user stands for one repository."""
    tenths = (10 + F.floor("value").cast("bigint") % 91).cast("int")
    scores = F.to_json(F.create_map(F.lit("Security"), tenths))
    return events.select(
        F.col("user_id").cast("bigint").alias("repo_id"),
        F.col("event_id").cast("bigint").alias("snapshot_id"),
        F.col("ts").cast("timestamp").alias("ts"),
        tenths.alias("overall_tenths"),
        F.when(F.col("event_id") % 50 == 0, "{broken").otherwise(scores).alias("category_scores_json"),
        (F.col("event_id") % 40).cast("bigint").alias("total_issues"),
        (F.col("event_id") % 5).cast("bigint").alias("fixes_applied"),
        F.when(F.col("event_type") == "signup", "First contact").otherwise("").alias("description"),
    )


def record_snapshots(snapshots: DataFrame, path: str, scan_id: str, writers: int = 16) -> None:
    """Add the snapshots of one scan; recording the same scan again changes nothing.

    A scan has a folder of its own, written over as a whole, and in it one
    folder per day, since one per repository would be millions of tiny files.
    Rows of one repository are spread over the ``writers`` files of a day and
    sorted, so that a filter on it skips most of each file.
    """
    (snapshots.withColumn("snapshot_date", F.to_date("ts"))
     .repartition("snapshot_date", F.pmod(F.xxhash64("repo_id", "snapshot_id"), F.lit(writers)))
     .sortWithinPartitions("snapshot_date", "repo_id")
     .write.mode("overwrite").partitionBy("snapshot_date").parquet(f"{path}/scan_id={scan_id}"))


def read_snapshots(spark: SparkSession, path: str, repo_id: int | None = None) -> DataFrame:
    """The log with decoded scores; unreadable JSON gives an empty map."""
    log = spark.read.schema(SNAPSHOT_SCHEMA + ", scan_id string, snapshot_date date").parquet(path)
    if repo_id is not None:
        log = log.filter(F.col("repo_id") == repo_id)
    return decoded_scores(log)


def decoded_scores(log: DataFrame) -> DataFrame:
    """Add the scores by category; unreadable JSON gives an empty map."""
    decoded = F.from_json("category_scores_json", "map<string,double>")
    return log.withColumn("category_scores", F.coalesce(decoded, F.create_map().cast("map<string,double>")))


def timeline(snapshots: DataFrame) -> DataFrame:
    """Version label, change against the previous snapshot and description."""
    numbered = number_rows(
        snapshots, ["repo_id"], ORDER, seq="version_no", previous={"overall_tenths": "previous_tenths"}
    )
    delta = F.col("overall_tenths") - F.col("previous_tenths")
    signed = F.concat(F.when(delta >= 0, "+").otherwise(""), tx.tenths_text(delta))
    repaired = F.concat(
        F.lit("Repaired "), F.col("fixes_applied").cast("string"), F.lit(" issues (Score "), signed, F.lit(")")
    )
    given = F.coalesce("description", F.lit(""))
    return numbered.withColumns({
        "version": F.concat(F.lit("v"), F.col("version_no").cast("string")),
        "delta_tenths": delta,
        "description": F.when(given != "", given)
        .when(F.col("version_no") == 1, "Initial scan & diagnosis").otherwise(repaired),
    })


def trajectory(snapshots: DataFrame) -> DataFrame:
    """First and latest score per repository, by partial aggregation only."""
    at = F.struct(*ORDER)
    ends = snapshots.groupBy("repo_id").agg(
        F.min_by("overall_tenths", at).alias("first_tenths"),
        F.max_by("overall_tenths", at).alias("latest_tenths"),
        F.count(F.lit(1)).alias("versions"),
    )
    delta = F.col("latest_tenths") - F.col("first_tenths")
    return ends.withColumns({
        "delta_tenths": delta,
        "delta_text": F.concat(F.when(delta >= 0, "+").otherwise(""), tx.tenths_text(delta)),
    })


def in_order(rows: DataFrame) -> DataFrame:
    return rows.orderBy("repo_id", *ORDER)
