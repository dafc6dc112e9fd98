"""Statistics of integer and floating columns as numbers, never as text.

Counts and extremes come from one aggregation. Exact distinct counts of integers that fill a good part of their range are bits of bitmaps, so a key
column shuffles an eighth of a byte per possible value; other numbers are grouped as they are.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F, types as T

from tabsift.config import BINARY_SETS
from tabsift.dataset import Dataset

INTEGERS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
FLOATS = (T.FloatType, T.DoubleType)
#: A bitmap is used while it has at most this many bits for each value that is there; its cell in a grouping would take 64.
BITS_PER_VALUE = 32
#: Integers up to here are exact as doubles.
EXACT = 1 << 53


def numeric_facts(ds: Dataset) -> tuple[int, dict[str, tuple]]:
    """The number of rows, and (count, least, greatest) of each integer and floating column; one row goes to the driver."""
    columns = ds.columns_of((*INTEGERS, *FLOATS))
    if not columns:
        return 0, {}
    found = [f(F.col(f"`{c}`")).alias(f"{name}{i}") for i, c in enumerate(columns) for name, f in (("n", F.count), ("low", F.min), ("high", F.max))]
    row = ds.df.agg(F.count(F.lit(1)).alias("rows"), *found).first()
    return row["rows"], {c: (row[f"n{i}"], row[f"low{i}"], row[f"high{i}"]) for i, c in enumerate(columns)}


def _cells(ds: Dataset, values: dict[str, Column]) -> DataFrame:
    """(column, x): one row per cell that isn't null."""
    cells = F.array(*[F.struct(F.lit(c).alias("column"), v.alias("x")) for c, v in values.items()])
    return ds.df.select(F.explode(cells).alias("cell")).select("cell.*").where(F.col("x").isNotNull())


def dense_distinct(ds: Dataset, lows: dict[str, int]) -> DataFrame:
    """(column, distinct): bits set in bitmaps of the distances from each column's least value."""
    cells = _cells(ds, {c: F.col(f"`{c}`").cast("long") - F.lit(low) + F.lit(1) for c, low in lows.items()})
    maps = (cells.groupBy("column", F.bitmap_bucket_number("x").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("x")).alias("bits")))
    return maps.groupBy("column").agg(F.sum(F.bitmap_count("bits")).alias("distinct"))


def grouped_distinct(ds: Dataset, columns: list[str]) -> DataFrame:
    """(column, distinct, crowd, integral): crowd is the most values that round to one integer."""
    cells = _cells(ds, {c: F.col(f"`{c}`").cast("double") for c in columns})
    nearest = F.rint("x")
    close = (F.col("x") == nearest) | (F.abs(F.col("x") - nearest) <= 1e-8 + 1e-5 * F.abs(nearest))
    per_integer = (cells.groupBy("column", "x").agg(F.lit(1).alias("one")).groupBy("column", nearest.alias("nearest"))
                   .agg(F.count(F.lit(1)).alias("numbers"), F.min(close).alias("integral")))
    return per_integer.groupBy("column").agg(F.sum("numbers").alias("distinct"), F.max("numbers").alias("crowd"), F.min("integral").alias("integral"))


def native_measures(ds: Dataset) -> tuple[list[str], DataFrame | None]:
    """The columns that are measured as numbers, and one row for each: counts, distinct values, and what key and binary tests ask for.

    Integers that no double holds exactly are left to the grouping of texts, whose numbers are doubles.
    """
    rows, facts = numeric_facts(ds)
    integers = ds.columns_of(INTEGERS)
    facts = {c: f for c, f in facts.items() if not (c in integers and f[0] and max(abs(f[1]), abs(f[2])) >= EXACT)}
    if not facts:
        return [], None
    filled = [c for c, f in facts.items() if f[0]]
    dense = {c: facts[c][1] for c in filled if c in integers and facts[c][2] - facts[c][1] < BITS_PER_VALUE * facts[c][0]}
    others = [c for c in filled if c not in dense]
    parts = []
    if dense:
        parts.append(dense_distinct(ds, dense).select("column", "distinct", F.lit(1).cast("long").alias("crowd"), F.lit(True).alias("integral")))
    if others:
        parts.append(grouped_distinct(ds, others))
    zero_one, zero = [s == ["0", "1"] for s in BINARY_SETS], F.lit(0).cast("long")
    empty = [c for c in facts if c not in filled]
    if empty:
        parts.append(ds.df.sparkSession.createDataFrame([(c,) for c in empty], "column string")
                     .select("column", zero.alias("distinct"), zero.alias("crowd"), F.lit(None).cast("boolean").alias("integral")))
    count = F.element_at(F.create_map(*(F.lit(x) for c in facts for x in (c, facts[c][0]))), F.col("column")).cast("long")
    coded = [c for c, (n, low, high) in facts.items() if c in integers and n and low >= 0 and high <= 1]
    flags = [(F.col("column").isin(coded) if coded and own else F.lit(False)).alias(f"binary_{i}") for i, own in enumerate(zero_one)]
    total = F.lit(rows).cast("long")
    return list(facts), reduce(DataFrame.unionByName, parts).select(
        "column", total.alias("freq"), (total - count).alias("missing_count"), F.col("distinct").alias("distinct_count"), count.alias("strict_count"),
        zero.alias("marker_count"), zero.alias("plain_dates"), *flags, count.alias("loose_count"), F.col("distinct").alias("distinct_numbers"), "crowd", "integral", zero.alias("dates"))
