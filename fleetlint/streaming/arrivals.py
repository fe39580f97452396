"""Scan files as they land in a table folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from fleetlint.model import RULE_IDS
from fleetlint.operators.rules import FILE_RULES
from fleetlint.plans.audit import hits_of, repo_rows, scan_files, to_findings
from fleetlint.session import materialise

SOURCE_SCHEMA = (
    "repo_id bigint, repo_name string, path string, content string, size_bytes bigint, "
    "is_python boolean, loc int"
)
# Scan rows are kept in this many folders by repository, so that a batch reads
# back only the folders of the repositories it touched.
BUCKETS = 256
# A folder's rows of one batch go to this many files at most, so that the number
# of files does not grow with the tasks of the scan.
FILES_PER_BUCKET = 4
WIDE_RULES = [r for r in RULE_IDS if r not in FILE_RULES]
# What only the rules of single files look at.
FILE_COLUMNS = ["hits", "parse_ok", "error_line", "error_text", "fact_errors"]


def latest_rows(rows: DataFrame) -> DataFrame:
    """The newest scan row of every file."""
    columns = [c for c in rows.columns if c not in ("repo_id", "path")]
    newest = rows.groupBy("repo_id", "path").agg(
        F.max_by(F.struct(*columns), "batch_id").alias("row"))
    return newest.select("repo_id", "path", "row.*")


def start_scan(spark: SparkSession, source: str, out: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Scan each arriving file once.

    ``out/scan`` gets the per-file rows, ``out/findings`` the findings: file
    rules for the files of the batch, wider rules (a missing README, circular
    imports) for the repositories the batch touched, judged on all their files
    so far. Every batch writes its own folder in overwrite mode, so a batch
    that is repeated after a failure leaves no duplicates.
    """
    stream = spark.readStream.schema(SOURCE_SCHEMA).parquet(source)

    def handle(batch: DataFrame, batch_id: int) -> None:
        rows_path = f"{out}/scan/batch_id={batch_id}"
        bucket = F.pmod(F.xxhash64("repo_id"), F.lit(BUCKETS)).cast("int")
        part = F.pmod(F.xxhash64("path"), F.lit(FILES_PER_BUCKET))
        scan_files(batch).withColumn("repo_bucket", bucket).repartition("repo_bucket", part).write.mode(
            "overwrite").partitionBy("repo_bucket").parquet(rows_path)
        fresh = spark.read.parquet(rows_path)
        of_files = to_findings(hits_of(fresh, None, list(FILE_RULES)))
        touched = fresh.select("repo_id").distinct()
        # At most BUCKETS numbers.
        folders = [r[0] for r in fresh.select("repo_bucket").distinct().collect()]
        so_far = spark.read.schema(
            T.StructType([*fresh.schema.fields, T.StructField("batch_id", T.LongType())])).parquet(f"{out}/scan")
        # Five steps read these rows, none of them the hits of single files.
        known = materialise(latest_rows(
            so_far.filter((F.col("batch_id") <= batch_id) & F.col("repo_bucket").isin(folders)).drop(
                *FILE_COLUMNS).join(touched, "repo_id", "left_semi")), "known")
        of_repos = to_findings(hits_of(known, repo_rows(known), WIDE_RULES))
        of_files.withColumn("scope", F.lit("file")).unionByName(
            of_repos.withColumn("scope", F.lit("repository"))
        ).write.mode("overwrite").parquet(f"{out}/findings/batch_id={batch_id}")

    return (stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"availableNow": True})).start())


def current_findings(spark: SparkSession, out: str) -> DataFrame:
    """Findings valid now: per file those of its last batch, for wider rules
    those of the last batch that touched the repository."""
    found = spark.read.parquet(f"{out}/findings")
    rows = spark.read.parquet(f"{out}/scan").select("repo_id", "path", "batch_id")
    last_file = rows.groupBy("repo_id", "path").agg(F.max("batch_id").alias("batch_id"))
    last_repo = rows.groupBy("repo_id").agg(F.max("batch_id").alias("batch_id"))
    of_files = found.filter("scope = 'file'").join(last_file, ["repo_id", "path", "batch_id"], "left_semi")
    of_repos = found.filter("scope = 'repository'").join(last_repo, ["repo_id", "batch_id"], "left_semi")
    return of_files.unionByName(of_repos)
