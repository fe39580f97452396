"""Facts kept by what a text holds: equal texts are parsed once, ever.

A store is a folder with one folder per scan; in it are the facts of the texts
which no earlier scan had, keyed by the SHA-256 of the text. Facts count only
for the tool that made them (``tool_version``: the extractor, the wanted facts
and the Python grammar), so a new tool parses anew and old facts stay readable.
A scan moves keys and digests; where few texts are new, their keys are small
enough for Spark to broadcast, and no other text leaves its file row.

Defined cases: rows that are not Python or have no content have no digest and
null facts; equal texts in any number of files are one row of the store; a scan
that is repeated under its name writes its folder over; an empty table adds
nothing. Scans add to a store one after the other.
"""

from __future__ import annotations

import hashlib
import sys

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlint.operators.facts import FACT_TYPES, PARSE_COLUMNS, extract_facts

#: Raise it whenever the extractor gives other facts for the same text.
EXTRACTOR = 1
KEYS = ["repo_id", "path"]


def tool_version(want, call_names=None) -> str:
    """Names the tool: equal names give equal facts for equal texts."""
    calls = "all" if call_names is None else ",".join(sorted(call_names))
    settings = f"{EXTRACTOR}|{'.'.join(map(str, sys.version_info[:2]))}|{','.join(sorted(want))}|{calls}"
    return hashlib.sha256(settings.encode()).hexdigest()[:16]


class FactStore:
    """Facts of a tool below ``path``."""

    def __init__(self, spark: SparkSession, path: str, want=tuple(FACT_TYPES), call_names=None):
        self.spark, self.want, self.call_names = spark, tuple(want), call_names
        self.path = f"{path.rstrip('/')}/tool={tool_version(want, call_names)}"
        facts = ", ".join(f"{name} {FACT_TYPES[name]}" for name in self.want)
        self.schema = f"digest string, {PARSE_COLUMNS}, fact_errors array<string>" + (f", {facts}" if facts else "")

    def _read(self, *but: str) -> DataFrame:
        """What all scans but the named ones kept."""
        schema = self.schema + ", scan_id string"
        try:
            kept = self.spark.read.schema(schema).parquet(self.path)
        except AnalysisException as missing:
            if missing.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], schema)  # nothing was kept so far
        return kept.filter(~F.col("scan_id").isin(*but)) if but else kept

    @staticmethod
    def digests(files: DataFrame) -> DataFrame:
        """The Python files with content, and the digest of it."""
        return files.filter("is_python AND content IS NOT NULL").withColumn(
            "digest", F.sha2(F.col("content").cast("binary"), 256))

    def unknown(self, files: DataFrame, scan_id: str) -> DataFrame:
        """One file, the first by its key, of every text that no other scan has kept."""
        first = self.digests(files).groupBy("digest").agg(F.min(F.struct(*KEYS)).alias("at"))
        return first.join(self._read(scan_id).select("digest"), "digest", "left_anti").select("at.*", "digest")

    def add(self, files: DataFrame, scan_id: str) -> DataFrame:
        """Parse the texts that are new and keep their facts; gives what the scan kept."""
        new = self.digests(files).select(*KEYS, "is_python", "content", "digest").join(
            self.unknown(files, scan_id), [*KEYS, "digest"])
        facts = extract_facts(new, self.want, self.call_names)
        columns = [c.strip().split(" ")[0] for c in PARSE_COLUMNS.split(",")]
        out = f"{self.path}/scan_id={scan_id}"
        # A file table may hold a row twice.
        facts.select("digest", *columns, "fact_errors", *self.want).dropDuplicates(["digest"]).write.mode(
            "overwrite").parquet(out)
        return self.spark.read.schema(self.schema).parquet(out)

    def facts_of(self, files: DataFrame) -> DataFrame:
        """Every file without its text, with the facts kept for it (null where there are none).

        The facts of a digest are one row, so only the side of the files can be skewed: a text that a third of
        all files hold is split by the adaptive join.
        """
        digest = F.when(F.col("is_python"), F.sha2(F.col("content").cast("binary"), 256))
        rows = files.withColumn("digest", digest).drop("content")
        return rows.join(self._read().drop("scan_id"), "digest", "left")
