"""Helpers that the corpus operators share: reading tables, passes over texts, linked groups."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetlint.session import materialise, tune

#: A pass over texts: takes the UTF-8 bytes of a batch, returns one Arrow array per added field.
TextPass = Callable[[list[bytes]], list[pa.Array]]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    tune(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def column(name: str):
    """A column by its exact name, whatever characters it has."""
    return F.col("`" + name.replace("`", "``") + "`")


def annotate(
    df: DataFrame, carry: list[str], text_col: str, make_pass: Callable[[], TextPass], fields: list[T.StructField]
) -> DataFrame:
    """``row`` (a struct of the carried columns) and what ``make_pass`` measures of every whole text.

    One Arrow pass without a shuffle; ``make_pass`` runs once per task, so its
    caches live as long as the task. A null text counts as the empty one. The
    struct keeps carried columns apart from the measures, whatever their names.
    """
    tune(df.sparkSession)
    source = df.select(
        F.struct(*[column(c).alias(c) for c in carry]).alias("row"),
        F.coalesce(column(text_col).cast("binary"), F.expr("X''")).alias("raw"),
    )
    schema = T.StructType([source.schema["row"], *fields])
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        measure = make_pass()
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([batch.column(0), *measure(batch.column(1).to_pylist())], names=names)

    return source.mapInArrow(run, schema)


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """``node, root`` for every node of ``edges`` (two long columns ``a``, ``b``): the smallest node reachable.

    Rounds of large-star and small-star: each node's neighbours are linked to
    the smallest of them, first upwards, then downwards, until nothing changes
    (logarithmic in the size of a group). Minima are combined before every
    shuffle and no neighbour list is ever built, so a hub is no hot task;
    only per-round tables are kept, in the shared scratch folder.
    """
    spark = edges.sparkSession
    current = edges.select(
        F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")
    ).where("hi <> lo").distinct()
    current, mark = _settle(current, name)
    while mark[0]:
        both = current.unionByName(current.select(F.col("lo").alias("hi"), F.col("hi").alias("lo")))
        least = both.groupBy("hi").agg(F.least(F.min("lo"), F.first("hi")).alias("m"))
        large = (
            both.join(least, "hi").where("lo > hi")
            .select(F.col("lo").alias("hi"), F.col("m").alias("lo")).where("hi <> lo").distinct()
        )
        least = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = (
            large.join(least, "hi").where("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
            .unionByName(least.select("hi", F.col("m").alias("lo"))).where("hi <> lo").distinct()
        )
        current, now = _settle(small, name)
        if now == mark:
            break
        mark = now
    roots = current.select(F.col("hi").alias("node"), F.col("lo").alias("root"))
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct()) if mark[0] else (
        spark.createDataFrame([], "node long, root long")
    )


def _settle(pairs: DataFrame, name: str) -> tuple[DataFrame, tuple]:
    """The pairs, written once, with their number and a checksum."""
    kept = materialise(pairs, name)
    n, check = kept.agg(
        F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))
    ).first()
    return kept, (n, check)
