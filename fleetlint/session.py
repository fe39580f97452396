"""Session settings and the shared scratch folder."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# A source file may be 2 MiB, so record batches to Python are kept small.
_RUNTIME_DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "500",
}


_SHIPPED: set[str] = set()
_LOCAL_ROOTS: dict[str, str] = {}


def local_session(cpus: int | str, app: str, memory: str = "12g", partitions: int | None = None) -> SparkSession:
    """A local session for tests and benchmarks."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions or cpus))
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", memory)
        # Call sites are looked up for every column otherwise, which makes
        # large expressions slow to build.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return tune(spark)


def tune(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings every job of this package relies on."""
    for key, value in _RUNTIME_DEFAULTS.items():
        spark.conf.set(key, value)
    ship(spark)
    return spark


def ship(spark: SparkSession) -> None:
    """Make this package importable in the Python workers of all executors."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    package = os.path.dirname(os.path.abspath(__file__))
    target = os.path.join(tempfile.mkdtemp(prefix="fleetlint-code-"), "fleetlint_code")
    archive = shutil.make_archive(target, "zip", os.path.dirname(package), os.path.basename(package))
    spark.sparkContext.addPyFile(archive)
    _SHIPPED.add(app)


def scratch_root(spark: SparkSession) -> str:
    """The folder all executors share, named by ``spark.checkpoint.dir``.

    Only a local session that names none (tests) gets a temporary folder.
    """
    context = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if root:
        return root.rstrip("/")
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    app = context.applicationId
    if app not in _LOCAL_ROOTS:
        _LOCAL_ROOTS[app] = tempfile.mkdtemp(prefix="fleetlint-")
    return _LOCAL_ROOTS[app]


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_root(spark)}/fleetlint/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write an intermediate table once and read it back.

    Cuts the lineage, survives lost executors, and later readers still get
    column pruning and filter push-down, which ``checkpoint()`` would lose.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Deal rows to ``spark.fleetlint.scanPartitions`` tasks before a CPU-heavy step, where that is set.

    Meant for inputs of few splits, such as one file without row groups. At
    scale it stays unset: the scan yields enough splits and nothing is
    shuffled. The hash keys make a retried task produce the same rows.
    """
    ship(df.sparkSession)
    wanted = df.sparkSession.conf.get("spark.fleetlint.scanPartitions", None)
    return df.repartition(int(wanted), *keys) if wanted else df
