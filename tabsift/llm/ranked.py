"""Ranks inside groups of any size, without a window that gathers a group in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from tabsift.llm.common import cut_lineage


def ranked(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """The rows with ``rank`` (from 0, by the order columns, nulls first) and ``n``, the size of their group.

    Rows are cut into ranges of (group, order, tie), so a large group lies in many ranges; counts of each group and range, which are at most groups plus
    ranges, give the first rank of each range. Ties are ordered by ``tie``, a seeded number that is stored with the rows, so equal rows spread
    over ranges too. The group must not be null; ``rows`` should be a stored table, as it is read twice. The names ``rank``, ``n``, ``tie``, ``place`` and ``part``
    are taken.
    """
    by = [group, *order, "tie"]
    held = rows.withColumn("tie", F.rand(11)).repartitionByRange(*(F.col(c).asc_nulls_first() for c in by)).sortWithinPartitions(*by)
    held = cut_lineage(held.withColumn("place", F.monotonically_increasing_id()).drop("tie"))
    held = held.withColumn("part", F.shiftright("place", 33))
    parts = held.groupBy(group, "part").agg(F.min("place").alias("first"), F.count("*").alias("size"))
    whole = Window.partitionBy(group)
    before = whole.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = parts.select(group, "part", (F.coalesce(F.sum("size").over(before), F.lit(0)) - F.col("first")).alias("shift"), F.sum("size").over(whole).alias("n"))
    return held.join(base, [group, "part"]).withColumn("rank", F.col("place") + F.col("shift")).drop("part", "place", "shift")
