"""Exact global positions without sorting everything in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

PREFIX = 4        # hex digits: 65,536 even buckets, which also bounds the offset table


def seeded_key(row_id: Column, seed: int) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), row_id.cast("string")))


def global_position(df: DataFrame, key: str, limit: int) -> DataFrame:
    """The ``limit`` rows with the smallest hex hash in ``key``, with their 0-based global position.

    Bucket counts give each bucket's offset; only buckets that start before ``limit`` are ranked, each in
    its own window. Hash buckets are even because every row has its own key.
    """
    bucketed = df.withColumn("_bucket", F.substring(F.col(key), 1, PREFIX))
    counts = bucketed.groupBy("_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (counts.select("_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
               .where(F.col("_offset") < limit))
    rank = F.row_number().over(Window.partitionBy("_bucket").orderBy(key))
    return (bucketed.join(F.broadcast(offsets), "_bucket")
            .withColumn("position", (F.col("_offset") + rank - 1).cast("long"))
            .where(F.col("position") < limit).drop("_bucket", "_offset"))
