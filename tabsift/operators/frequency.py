"""The value-frequency table and the per-column statistics read from it.

``value_frequency`` is the shared intermediate: one row per (column, distinct value). Partial
aggregation collapses repeated values before the shuffle, so a value holding a third of all rows
costs one row per task. All later groupings of it are sums, counts and extremes with constant state.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from tabsift.config import BINARY_SETS
from tabsift.dataset import NUMERIC, TEMPORAL, Dataset
from tabsift.functions import exprs as X
from tabsift.functions.dates import with_date_shape
from tabsift.operators.native_counts import native_measures


def unpivot_text(ds: Dataset, columns: list[str], keep: list[str] | None = None) -> DataFrame:
    """One (column, value) row per cell, every value as text."""
    keep = keep or []
    wide = ds.df.select(*[F.col(k) for k in keep], *[ds.text(c).alias(c) for c in columns])
    return wide.unpivot(keep, [F.col(f"`{c}`") for c in columns], "column", "value")


def value_frequency(ds: Dataset, columns: list[str] | None = None) -> DataFrame:
    return (unpivot_text(ds, columns or ds.columns)
            .groupBy("column", "value").agg(F.count(F.lit(1)).alias("freq")))


def value_counts(ds: Dataset, columns: list[str] | None = None) -> DataFrame:
    """Counts of normalised tokens, NULL left out."""
    return (unpivot_text(ds, columns or ds.columns).where(F.col("value").isNotNull())
            .groupBy("column", X.normalize(F.col("value")).alias("token"))
            .agg(F.count(F.lit(1)).alias("freq")))


def _numbers(ds: Dataset) -> tuple[Column, Column]:
    """Strict and comma-tolerant number of each value; natively numeric columns need no grammar check."""
    value, column = F.col("value"), F.col("column")
    native, flags = ds.columns_of(NUMERIC), ds.columns_of(T.BooleanType)
    strict, loose = X.number(value), X.number_comma(value)
    if flags:
        strict = F.when(column.isin(flags), F.when(value == "true", 1.0).when(value == "false", 0.0)).otherwise(strict)
    if native:
        cast = value.try_cast("double")
        strict, loose = F.when(column.isin(native), cast).otherwise(strict), F.when(column.isin(native), cast).otherwise(loose)
    return strict, loose


def ordinals(columns: list[str]) -> Column:
    return F.element_at(X.literal_map({c: i for i, c in enumerate(columns)}), F.col("column"))


def column_measures(ds: Dataset) -> DataFrame:
    """One row per column with every count the profiles and role rules need.

    A chain of groupings, (column, value) -> (column, number) -> (column, nearest integer) -> (column, date shape) ->
    (column); each is smaller than the one before and none gathers values in memory. Texts that are dates keep their shape
    until the last one, which takes the shape and reading that the most values have. Integer and floating columns are measured as
    numbers and only meet the others in the result.
    """
    config = ds.config
    native, measured = native_measures(ds)
    rest = [c for c in ds.columns if c not in native]
    parts = ([_text_measures(ds, rest)] if rest else []) + ([measured] if native else [])
    per_column = reduce(DataFrame.unionByName, parts)
    binary = reduce(lambda a, b: a | b, [F.coalesce(F.col(f"binary_{i}"), F.lit(False)) for i in range(len(BINARY_SETS))])
    filled = F.col("freq") - F.col("missing_count")
    return per_column.select(
        ordinals(ds.columns).alias("ordinal"), "column", F.col("freq").alias("n_rows"), "missing_count",
        filled.alias("non_missing"), "distinct_count", "strict_count", "loose_count", "distinct_numbers",
        "marker_count", binary.alias("is_binary"),
        ((filled > 0) & ((X.safe_div(F.col("loose_count"), filled) < config["roles"]["numeric_parse"])
                         | (F.coalesce(F.col("integral"), F.lit(False)) & (F.col("crowd") <= 1)))).alias("key_like"),
        X.safe_div(F.greatest("dates", "plain_dates"), filled).alias("date_rate"))


def _text_measures(ds: Dataset, columns: list[str]) -> DataFrame:
    """The chain of groupings of the columns that aren't measured as numbers."""
    config = ds.config
    value, freq = F.col("value"), F.col("freq")
    norm = X.normalize(value)
    markers = [m.strip().lower() for m in config["missingness"]["semantic_markers"]]
    temporal = ds.columns_of(TEMPORAL)
    is_temporal = F.col("column").isin(temporal) if temporal else F.lit(False)
    present = value.isNotNull()

    strict, loose = _numbers(ds)
    native = ds.columns_of(NUMERIC)
    worded = ~F.col("column").isin(native) if native else F.lit(True)
    per_value = (value_frequency(ds, columns)
                 .withColumn("norm", norm)
                 .withColumn("strict", strict).withColumn("num", loose))
    per_value = with_date_shape(per_value, value, worded & ~is_temporal)
    per_value = per_value.withColumn("shape", F.when(F.col("num").isNull(), F.col("shape")))
    plain = F.when(is_temporal & present, freq).when(F.col("num").isNotNull() & F.col("month_first"), freq).otherwise(0)
    measures = [
        F.sum(freq).alias("freq"),
        F.sum(F.when(~present, freq).otherwise(0)).alias("missing_count"),
        F.sum(present.cast("long")).alias("distinct_count"),
        F.sum(F.when(F.col("strict").isNotNull(), freq).otherwise(0)).alias("strict_count"),
        F.sum(F.when(F.col("norm").isin(markers), freq).otherwise(0)).alias("marker_count"),
    ]
    measures += [F.min(F.when(present, F.col("norm").isin(s))).alias(f"binary_{i}") for i, s in enumerate(BINARY_SETS)]
    measures += [F.sum(plain).alias("plain_dates"), *(F.sum(F.when(F.col(c), freq).otherwise(0)).alias(c) for c in ("month_first", "day_first"))]
    carried = ["freq", "missing_count", "distinct_count", "strict_count", "marker_count", "plain_dates"]
    dated = ["month_first", "day_first"]
    binaries = [f"binary_{i}" for i in range(len(BINARY_SETS))]

    def roll_up(*more: str) -> list[Column]:
        return [F.sum(c).alias(c) for c in [*carried, *more]] + [F.min(b).alias(b) for b in binaries]

    nearest = F.rint("num")
    close = (F.col("num") == nearest) | (F.abs(F.col("num") - nearest) <= 1e-8 + 1e-5 * F.abs(nearest))
    per_number = per_value.groupBy("column", "num", "shape").agg(*measures)
    per_integer = (per_number.groupBy("column", nearest.alias("nearest"), "shape")
                   .agg(*roll_up(*dated), F.count("num").alias("numbers"), F.min(close).alias("integral"),
                        F.sum(F.when(F.col("num").isNotNull(), F.col("freq")).otherwise(0)).alias("loose_count")))
    per_shape = (per_integer.groupBy("column", "shape")
                 .agg(*roll_up(*dated, "numbers", "loose_count"), F.max("numbers").alias("crowd"), F.min("integral").alias("integral")))
    best = F.max(F.when(F.col("shape").isNotNull(), F.greatest("month_first", "day_first")).otherwise(0))
    per_column = (per_shape.groupBy("column")
                  .agg(*roll_up("loose_count"), F.sum("numbers").alias("distinct_numbers"), F.max("crowd").alias("crowd"),
                       F.min("integral").alias("integral"), best.alias("dates")))
    return per_column.select("column", "freq", "missing_count", "distinct_count", "strict_count", "marker_count", "plain_dates", *binaries, "loose_count",
                             "distinct_numbers", "crowd", "integral", "dates")


HEAD_ROWS = 200


def first_values(ds: Dataset, k: int, columns: list[str] | None = None) -> DataFrame:
    """The first ``k`` non-missing values of each column in row order, repeats included.

    One top-k over the first rows settles every column that is reasonably filled. One more scan is for all others together: their cells are
    ranked within each task first, which passes on at most ``k`` of a column.
    """
    columns, row = columns or ds.columns, F.col(f"`{ds.row_id}`")
    head = ds.df.select(row.alias("row_id"), *[ds.text(c).alias(c) for c in columns]).orderBy("row_id").limit(HEAD_ROWS).collect()
    settled = {c: [r[c] for r in head if r[c] is not None][:k] for c in columns}
    whole = len(head) < HEAD_ROWS
    rows = [(c, i + 1, v) for c in columns if whole or len(settled[c]) == k for i, v in enumerate(settled[c])]
    found = ds.df.sparkSession.createDataFrame(rows, "column string, position long, value string")
    sparse = [c for c in columns if not whole and len(settled[c]) < k]
    if not sparse:
        return found
    cells = F.array(*[F.struct(F.lit(c).alias("column"), ds.text(c).alias("value")) for c in sparse])
    cells = ds.df.select(row.alias("row_id"), F.explode(F.filter(cells, lambda c: c["value"].isNotNull())).alias("cell")).select("row_id", "cell.*")
    rank = F.row_number().over(Window.partitionBy("column").orderBy("row_id"))
    first = cells.withColumn("position", rank).where(F.col("position") <= k)
    return found.unionByName(first.select("column", F.col("position").cast("long").alias("position"), "value"))
