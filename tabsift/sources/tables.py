"""Result tables on shared storage: partitioned by dataset, overwritten as a whole, read back by name."""

from __future__ import annotations

from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from tabsift.sources.commits import committed


def write_table(df: DataFrame, base: str, table: str, fmt: str = "parquet") -> str:
    """One directory per dataset; only the partitions present in ``df`` are replaced."""
    path = f"{base}/{table}"
    (df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("header", True)
     .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
     .partitionBy("dataset").format(fmt).save(path))
    return path


def read_table(spark: SparkSession, base: str, table: str, fmt: str = "parquet") -> DataFrame | None:
    """The table, as committed or else as written by :func:`write_table`, or None where it is missing or empty."""
    try:
        df = committed(spark, base, table)
        if df is None:
            df = spark.read.option("header", True).format(fmt).load(f"{base}/{table}")
        return None if df.isEmpty() else df
    except AnalysisException:
        return None


def write_json(df: DataFrame, path: str) -> None:
    """One JSON document per row, NULL fields kept."""
    df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value")).write.mode("overwrite").text(path)


def union_profiles(profiles: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), profiles)
