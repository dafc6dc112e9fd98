"""Shared output conventions of the registered queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, types as T


def rounded(df: DataFrame) -> DataFrame:
    """Doubles to six decimals and all integers to BIGINT, so engines can be compared value by value."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = F.round(c.cast("double"), 6).alias(f.name)
        elif isinstance(f.dataType, (T.ByteType, T.ShortType, T.IntegerType)):
            c = c.cast("long").alias(f.name)
        out.append(c)
    return df.select(*out)
