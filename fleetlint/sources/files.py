"""File tables: listing trees, skip rules, decoding and lookups."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlint.functions import text as tx
from fleetlint.model import IGNORE_DIRS, IGNORE_EXTENSIONS, MAX_FILE_BYTES
from fleetlint.session import ship
from fleetlint.sources.trees import TreeSource, storage_of

CONTENT_SCHEMA = "root string, path string, size_bytes bigint, content binary, error string"

# Dot directories that hold files the rules look for.
ADMITTED_DOT_DIRS = (".github",)


def list_trees(
    spark: SparkSession, roots: list[str] | None = None, parent: str | None = None, admit_dirs=ADMITTED_DOT_DIRS,
) -> DataFrame:
    """Every file below the given repository roots, or below all subfolders of ``parent``:
    ``root, path, size_bytes, error``. Ignored directories are never entered.

    A folder or link that cannot be read is a row with an error.
    """
    ship(spark)
    spark.dataSource.register(TreeSource)
    reader = spark.read.format(TreeSource.name()).option("skip", json.dumps(IGNORE_DIRS)).option(
        "admit", json.dumps(list(admit_dirs))).option("splits", str(spark.sparkContext.defaultParallelism))
    if roots is not None:
        reader = reader.option("roots", json.dumps(roots))
    if parent is not None:
        reader = reader.option("parent", parent)
    return reader.load()


def _read_bytes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for item in batch.to_pylist():
            data = error = None
            try:
                system, base = storage_of(item["root"])
                with system.open_input_stream(f"{base}/{item['path']}", compression=None) as handle:
                    data = handle.read()
            except OSError as failed:
                error = str(failed)
            yield pa.record_batch(
                [pa.array([item["root"]]), pa.array([item["path"]]), pa.array([item["size_bytes"]], pa.int64()),
                 pa.array([data], pa.binary()), pa.array([error], pa.string())],
                names=["root", "path", "size_bytes", "content", "error"],
            )


def read_listed(listed: DataFrame) -> DataFrame:
    """Add ``content`` to listed files; where a file cannot be read it is null and ``error`` says why."""
    spark = listed.sparkSession
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    read = listed.filter("error IS NULL").repartition(tasks, "root", "path").mapInArrow(_read_bytes, CONTENT_SCHEMA)
    return read.unionByName(listed.filter("error IS NOT NULL"), allowMissingColumns=True)


def read_trees(
    spark: SparkSession, roots: list[str] | None = None, parent: str | None = None, admit_dirs=ADMITTED_DOT_DIRS,
) -> DataFrame:
    """Files of trees with their bytes, and rows with ``error`` for what could not be listed or read.

    Skip rules run before any file is opened.
    """
    return read_listed(keep_files(list_trees(spark, roots, parent, admit_dirs), admit_dirs))


def load_trees(
    spark: SparkSession, roots: list[str] | None = None, admit_dirs=ADMITTED_DOT_DIRS, parent: str | None = None,
) -> DataFrame:
    """``source_files`` of trees on any storage; ``read_trees`` has what could not be read as well."""
    raw = read_trees(spark, roots, parent, admit_dirs).filter("error IS NULL")
    named = raw.withColumn("repo_name", tx.base_name(F.col("root"))).withColumn(
        "repo_id", F.xxhash64("root")
    )
    return decode_files(named)


def _write_files(parent: str):
    """Write each row's text below ``parent``; a repeated task writes the same files over."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = storage_of(parent)
        for batch in batches:
            for name, path, text in zip(*(batch.column(c).to_pylist() for c in ("repo_name", "path", "content"))):
                if ".." in f"{name}/{path}".split("/") or "/" in name:
                    raise ValueError(f"{name}: {path} leads out of its tree")
                target = f"{base}/{name}/{path}"
                system.create_dir(target.rsplit("/", 1)[0], recursive=True)
                with system.open_output_stream(target, compression=None) as out:
                    out.write((text or "").encode("utf-8"))
            yield pa.record_batch([pa.array([batch.num_rows], pa.int64())], names=["n"])

    return run


def write_trees(files: DataFrame, parent: str) -> int:
    """Write a file table as trees, one folder per repository name; gives the number of files."""
    ship(files.sparkSession)
    wrote = files.select("repo_name", "path", "content").mapInArrow(_write_files(parent), "n bigint")
    return wrote.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first().n


def tree_entries(files: DataFrame) -> DataFrame:
    """Files and directories of the trees in a file table: ``repo_id, path, is_dir, depth, n_files, total_bytes``.

    A directory sums up what lies below it; sums are combined before the shuffle.
    """
    parts = F.split("path", "/")
    above = F.when(F.size(parts) > 1, F.transform(
        F.sequence(F.lit(1), F.size(parts) - 1), lambda k: F.array_join(F.slice(parts, 1, k), "/")))
    own = files.select(
        "repo_id", "path", F.lit(False).alias("is_dir"), F.lit(1).cast("bigint").alias("n_files"),
        F.col("size_bytes").alias("total_bytes"))
    dirs = files.select("repo_id", F.explode(above).alias("path"), "size_bytes").groupBy("repo_id", "path").agg(
        F.lit(True).alias("is_dir"), F.count(F.lit(1)).alias("n_files"), F.sum("size_bytes").alias("total_bytes"))
    depth = F.length("path") - F.length(F.replace("path", F.lit("/"), F.lit("")))
    return own.unionByName(dirs).withColumn("depth", depth)


def skip_dir(name: Column, admit_dirs=ADMITTED_DOT_DIRS) -> Column:
    hit = name.isin(*IGNORE_DIRS) | name.startswith(".")
    return hit & ~name.isin(*admit_dirs) if admit_dirs else hit


def skip_reason(files: DataFrame, admit_dirs=ADMITTED_DOT_DIRS, max_bytes: int | None = MAX_FILE_BYTES) -> Column:
    """Why a file is not scanned, or null. ``max_bytes`` is the size limit (2 MiB unless given; None: no limit).

    A missing size is taken from the content, where there is one.
    """
    dirs = F.split(tx.dir_name(F.col("path")), "/")
    reason = F.when(F.exists(dirs, lambda d: skip_dir(d, admit_dirs)), "ignored directory").when(
        F.lower(tx.suffix(F.col("path"))).isin(*IGNORE_EXTENSIONS), "ignored extension")
    if max_bytes is not None:
        size = F.col("size_bytes")
        if "content" in files.columns:
            size = F.coalesce(size, F.octet_length("content").cast("bigint"))
        reason = reason.when(size > max_bytes, "too large")
    return reason


def keep_files(files: DataFrame, admit_dirs=ADMITTED_DOT_DIRS, max_bytes: int | None = MAX_FILE_BYTES) -> DataFrame:
    """The files to scan: none in ignored directories, with binary extensions or over the size limit."""
    return files.filter(skip_reason(files, admit_dirs, max_bytes).isNull())


def skipped_files(files: DataFrame, admit_dirs=ADMITTED_DOT_DIRS, max_bytes: int | None = MAX_FILE_BYTES) -> DataFrame:
    """The files that ``keep_files`` leaves out, with the reason."""
    return files.withColumn("reason", skip_reason(files, admit_dirs, max_bytes)).filter("reason IS NOT NULL").select(
        *[c for c in ("repo_id", "root", "path", "size_bytes") if c in files.columns], "reason")


def decode_files(files: DataFrame) -> DataFrame:
    """Bytes (or text) to the ``source_files`` columns."""
    if dict(files.dtypes)["content"] == "binary":
        text = F.make_valid_utf8(F.col("content").cast("string"))
    else:
        text = F.col("content")
    return files.select(
        "repo_id", "repo_name", "path", tx.universal_newlines(text).alias("content"), "size_bytes"
    ).withColumns(
        {"is_python": F.col("path").endswith(".py"), "loc": tx.count_lines(F.col("content"))}
    )


def python_files(files: DataFrame) -> DataFrame:
    return files.filter("is_python")


def find_files(files: DataFrame, wanted: DataFrame, how: str = "left_semi") -> DataFrame:
    """Exact look-up of ``(repo_id, path)``: left_semi, left_anti or left.

    ``left_anti`` gives the wanted rows that no file matches.
    """
    keys = ["repo_id", "path"]
    if how == "left_anti":
        return wanted.join(files.select(*keys), keys, "left_anti")
    if how == "left":
        return wanted.join(files, keys, "left")
    return files.join(wanted.select(*keys), keys, "left_semi")


def source_lines(files: DataFrame) -> DataFrame:
    """One row per line, numbered from 1."""
    return files.select(
        "repo_id", "path", F.posexplode(tx.split_lines(F.col("content"))).alias("pos", "text")
    ).select("repo_id", "path", (F.col("pos") + 1).alias("line_no"), "text")


def repo_counters(files: DataFrame) -> DataFrame:
    """Files, Python files and lines (of all files) per repository."""
    return files.groupBy("repo_id").agg(
        F.count(F.lit(1)).alias("total_files"),
        F.count_if("is_python").alias("python_files"),
        F.sum("loc").alias("total_loc"),
    )


def repos_having(files: DataFrame, paths: list[str]) -> DataFrame:
    """Repositories with at least one of the paths at hand."""
    return files.filter(F.col("path").isin(*paths)).select("repo_id").distinct()


def repos_lacking(files: DataFrame, paths: list[str]) -> DataFrame:
    return files.select("repo_id").distinct().join(
        repos_having(files, paths), "repo_id", "left_anti"
    )


