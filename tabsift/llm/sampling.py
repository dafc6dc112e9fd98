"""Bounded samples of labelled rows, drawn by hash so that they don't depend on how rows are partitioned."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, Window as W

from tabsift.llm.common import unused


def held_out(row_id: Column) -> Column:
    """The fold that no classifier learns from: CRC-32 of the id as text leaves 1 on division by 3. A null id is never held out."""
    return F.coalesce(F.crc32(row_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def draw(rows: DataFrame, group: str, wanted: int) -> DataFrame:
    """At most ``wanted`` rows of each value of ``group``: those of the lowest hashes of all columns; all different rows where there are fewer.

    Rows should carry their id, so that copies of a text are drawn each for itself. Rows that repeat all columns count once, so of a group with
    many of them fewer than wanted may come. Counts of groups go to the driver; there are as many as labels. Only rows below a hash bound that
    leaves a little more than the number wanted are ranked.
    """
    counts = {r[0]: r[1] for r in rows.groupBy(group).count().collect()}
    if not counts:
        return rows.limit(0)
    # Six standard deviations more than wanted.
    bounds = {k: min(1.0, (wanted + 6 * wanted ** 0.5 + 6) / n) for k, n in counts.items() if k is not None}
    share = F.element_at(F.create_map(*(F.lit(x) for pair in bounds.items() for x in pair)), F.col(group)) if bounds else F.lit(None).cast("double")
    place = unused(rows, "place")
    hashed = rows.withColumn(place, F.xxhash64(*(F.col(f"`{c}`") for c in rows.columns)))
    few = hashed.filter(F.shiftrightunsigned(place, 24) < share * float(1 << 40)).dropDuplicates([group, place])
    rank = unused(few, "rank")
    order = W.partitionBy(group).orderBy(F.shiftrightunsigned(place, 24), place)
    return few.withColumn(rank, F.row_number().over(order)).filter(F.col(rank) <= wanted).drop(place, rank)
