"""The timeline's log with a manifest: whole scans or nothing, and few files however many scans.

``data/`` holds one folder per commit, never written again. ``manifest/`` names
the scans and the folders their snapshots are in; a reader opens what the
newest epoch of it names and nothing else. A commit first writes its folder and
then appends one manifest file, so a scan that fails half-way is not seen. A
compaction writes the rows of all small folders into one and starts a new epoch
in one file; folders of old epochs stay readable for those who still use them.

Defined cases: a scan recorded once more changes nothing; a scan without
snapshots is recorded with none; an empty log reads as no rows. Writers of one
log follow one another.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlint.operators.timeline import SNAPSHOT_SCHEMA, decoded_scores

MANIFEST_SCHEMA = "scan_id string, folder string, n_rows bigint"


class SnapshotLog:
    """``folders``: compact beyond so many; ``small``: only folders of fewer rows are put together."""

    def __init__(self, spark: SparkSession, path: str, folders: int = 32, small: int = 50_000_000, writers: int = 16):
        self.spark, self.path = spark, path.rstrip("/")
        self.folders, self.small, self.writers = folders, small, writers

    def manifest(self) -> DataFrame:
        """Scans of the newest epoch: ``scan_id, folder, n_rows, epoch``."""
        schema = MANIFEST_SCHEMA + ", epoch int"
        try:
            named = self.spark.read.schema(schema).parquet(f"{self.path}/manifest")
        except AnalysisException as missing:
            if missing.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], schema)
        newest = named.agg(F.max("epoch").alias("epoch")).first().epoch
        return named.filter(F.col("epoch") == newest)

    def _epoch(self) -> int:
        return self.manifest().agg(F.coalesce(F.max("epoch"), F.lit(0)).alias("epoch")).first().epoch

    def _write(self, snapshots: DataFrame) -> tuple[str, int]:
        """A new folder with these rows, by day and sorted by repository; its name and number of rows."""
        folder = uuid.uuid4().hex
        target = f"{self.path}/data/folder={folder}"
        (snapshots.withColumn("snapshot_date", F.to_date("ts"))
         .repartition("snapshot_date", F.pmod(F.xxhash64("repo_id", "snapshot_id"), F.lit(self.writers)))
         .sortWithinPartitions("snapshot_date", "repo_id")
         .write.partitionBy("snapshot_date").parquet(target))
        return folder, self._rows([folder]).count()

    def _rows(self, folders: list[str]) -> DataFrame:
        schema = SNAPSHOT_SCHEMA + ", scan_id string, folder string, snapshot_date date"
        if not folders:
            return self.spark.createDataFrame([], schema).drop("folder")
        return self.spark.read.schema(schema).option("basePath", f"{self.path}/data").parquet(
            *(f"{self.path}/data/folder={f}" for f in folders)).drop("folder")

    def live(self) -> list[str]:
        """Folders that readers open; compaction bounds their number but for the large ones."""
        return sorted(r.folder for r in self.manifest().filter("n_rows > 0").select("folder").distinct().collect())

    def commit(self, snapshots: DataFrame, scan_id: str) -> bool:
        """Record a scan; False if the log has it already."""
        if self.manifest().filter(F.col("scan_id") == scan_id).head():
            return False
        folder, n = self._write(snapshots.withColumn("scan_id", F.lit(scan_id)))
        self.spark.createDataFrame([(scan_id, folder, n)], MANIFEST_SCHEMA).coalesce(1).write.mode("append").parquet(
            f"{self.path}/manifest/epoch={self._epoch()}")
        if len(self.live()) > self.folders:
            self.compact()
        return True

    def compact(self) -> None:
        """Put the rows of all small folders into one and name the scans anew."""
        named = self.manifest()
        sizes = named.groupBy("folder").agg(F.sum("n_rows").alias("n")).filter(f"n < {self.small}")
        old = sorted(r.folder for r in sizes.collect())
        if len(old) < 2:
            return
        filled = [f for f in old if f in set(self.live())]
        folder, _ = self._write(self._rows(filled))
        moved = F.col("folder").isin(old)
        fresh = named.withColumn("folder", F.when(moved, F.lit(folder)).otherwise(F.col("folder"))).drop("epoch")
        fresh.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/manifest/epoch={self._epoch() + 1}")

    def read(self, repo_id: int | None = None) -> DataFrame:
        """Snapshots of all recorded scans with decoded scores."""
        rows = self._rows(self.live())
        if repo_id is not None:
            rows = rows.filter(F.col("repo_id") == repo_id)
        return decoded_scores(rows)
