"""Numbering and previous values per key, without one task per key.

``row_number() over (partition by key ...)`` puts a whole key into one task.
Here keys and order alone are range-partitioned, so a hot key spans many
partitions; each part is numbered on its own and shifted by the sizes of the
parts before it (prefix sums in two passes). The positions then join the rows
by key and order: no other column is copied, written or sorted for it.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from fleetlint.session import materialise


def number_rows(
    df: DataFrame, keys: list[str], order: list[str], seq: str = "seq", previous: dict[str, str] | None = None
) -> DataFrame:
    """Add a 1-based ``seq`` per key and, for each ``{column: alias}``, the
    value of the row before. ``keys + order`` must identify a row.

    The ranged keys are written once: their part numbers have to be the same in
    both uses, and a recomputed range exchange might cut elsewhere.
    """
    previous = previous or {}
    place = [*keys, *order]
    narrow = df.select(*place, *[c for c in previous if c not in place])
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = narrow.repartitionByRange(parts, *place).withColumn("_part", F.spark_partition_id())
    fixed = materialise(ranged, "ranged")

    position = F.struct(*order)
    sizes = fixed.groupBy(*keys, "_part").agg(
        F.count(F.lit(1)).alias("_n"),
        *[F.max_by(c, position).alias(f"_last_{c}") for c in previous],
    )
    before = W.partitionBy(*keys).orderBy("_part")
    # Only parts that continue a key: at most one per part, so never more rows
    # than partitions, and safe to broadcast.
    shifts = sizes.select(
        *keys, "_part",
        F.sum("_n").over(before.rowsBetween(W.unboundedPreceding, -1)).alias("_shift"),
        *[F.lag(f"_last_{c}").over(before).alias(f"_carry_{c}") for c in previous],
    ).filter(F.col("_shift").isNotNull())

    local = W.partitionBy(*keys, "_part").orderBy(*order)
    numbered = fixed.withColumns({
        "_local": F.row_number().over(local),
        **{f"_lag_{c}": F.lag(c).over(local) for c in previous},
    })
    joined = numbered.join(F.broadcast(shifts), [*keys, "_part"], "left")
    first = F.col("_local") == 1
    numbers = joined.select(
        *[F.col(c).alias(f"_at_{c}") for c in place],
        (F.col("_local") + F.coalesce("_shift", F.lit(0))).cast("bigint").alias(seq),
        *[F.when(first, F.col(f"_carry_{c}")).otherwise(F.col(f"_lag_{c}")).alias(a)
          for c, a in previous.items()],
    )
    same = reduce(and_, [df[c].eqNullSafe(F.col(f"_at_{c}")) for c in place])
    return df.join(numbers, same).select(*[df[c] for c in df.columns], seq, *previous.values())


def first_rows(df: DataFrame, keys: list[str], order: list[str], n: int) -> DataFrame:
    """The first ``n`` rows per key. Spark limits each input partition to ``n``
    rows per key before the shuffle, so a hot key stays small."""
    window = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(window)).filter(F.col("rank") <= n)
