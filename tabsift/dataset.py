"""A dataset: one cleaned DataFrame, its row key and its metadata."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager
from dataclasses import dataclass, field, replace

from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from tabsift.config import CONFIG, merge_metadata
from tabsift.functions.exprs import normalize, number, number_comma

NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)
TEMPORAL = (T.TimestampType, T.TimestampNTZType, T.DateType)


def shared_folder(spark: SparkSession) -> str:
    """This application's folder below the one that the cluster shares.

    That is spark.checkpoint.dir, else the folder given to ``setCheckpointDir``. Only a local session, whose tasks all run on
    this machine, may do without: its folder is TABSIFT_SCRATCH or a temporary one.
    """
    context = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not configured:
        if not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        configured = os.environ.get("TABSIFT_SCRATCH") or os.path.join(tempfile.gettempdir(), "tabsift")
    return f"{configured.rstrip('/')}/tabsift-{context.applicationId}"


def cut_lineage(df: DataFrame, folder: str | None = None) -> DataFrame:
    """Write the rows to the shared folder (or one below it) and read them back, so lost executors cost no recomputation."""
    spark = df.sparkSession
    path = f"{folder or shared_folder(spark)}/rows-{uuid.uuid4().hex}"
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_folder(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def drop_scratch(spark: SparkSession) -> None:
    """Remove what this application wrote with :func:`cut_lineage`, once its results have been stored."""
    drop_folder(spark, shared_folder(spark))


@contextmanager
def steps_of(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """A :func:`cut_lineage` for tables that are needed only inside the block; what outlives it has to be stored apart.

    Shuffle files go with the plans that made them, which the driver forgets when it collects garbage.
    """
    folder = f"{shared_folder(spark)}/steps-{uuid.uuid4().hex}"
    try:
        yield lambda df: cut_lineage(df, folder)
    finally:
        drop_folder(spark, folder)
        spark._jvm.java.lang.System.gc()


def at_once(calls: list[Callable], workers: int = 4) -> list:
    """The results of independent calls, whose Spark jobs run side by side: many of them are too small to fill a cluster."""
    with ThreadPoolExecutor(max(1, min(workers, len(calls)))) as pool:
        return [f.result() for f in [pool.submit(inheritable_thread_target(c)) for c in calls]]


def with_row_id(df: DataFrame, row_id: str = "row_id") -> DataFrame:
    """Number the rows once and keep the numbering on shared storage; it is never computed twice."""
    return cut_lineage(df.withColumn(row_id, F.monotonically_increasing_id()))


def small_table(df: DataFrame) -> DataFrame:
    """A local relation of a table whose size follows the number of columns, rules or issue types, or a report's length, never the rows."""
    return df.sparkSession.createDataFrame(df.collect(), df.schema)


def blank_markers(df: DataFrame, columns: list[str], markers: list[str]) -> DataFrame:
    """Technical missing markers in string columns become NULL, NaN in floating columns too."""
    known = sorted({m.strip().lower() for m in markers})
    types = {f.name: f.dataType for f in df.schema.fields}

    def clean(name: str) -> Column:
        c = F.col(f"`{name}`")
        if name not in columns:
            return c
        if isinstance(types[name], T.StringType):
            return F.when(~normalize(c).isin(known), c).alias(name)
        if isinstance(types[name], (T.FloatType, T.DoubleType)):
            return F.when(~F.isnan(c), c).alias(name)
        return c

    return df.select([clean(f) for f in df.columns])


@dataclass(frozen=True)
class Dataset:
    name: str
    df: DataFrame
    row_id: str
    metadata: dict = field(default_factory=dict)
    config: dict = field(default_factory=lambda: CONFIG)
    encoding_note: str = "utf8"
    auto: dict = field(default_factory=dict)

    @classmethod
    def of(cls, name: str, df: DataFrame, row_id: str, metadata: dict | None = None,
           config: dict | None = None, encoding_note: str = "utf8") -> "Dataset":
        config = config or CONFIG
        complex_columns = [f.name for f in df.schema.fields
                           if isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType, T.BinaryType))]
        if complex_columns:
            raise ValueError(f"a dataset is a flat table; nested or binary columns: {complex_columns}")
        columns = [c for c in df.columns if c != row_id]
        clean = blank_markers(df, columns, config["missingness"]["technical_markers"])
        return cls(name, clean, row_id, merge_metadata(metadata), config, encoding_note)

    @property
    def columns(self) -> list[str]:
        return [c for c in self.df.columns if c != self.row_id]

    def dtype(self, column: str) -> T.DataType:
        return self.df.schema[column].dataType

    def columns_of(self, kinds) -> list[str]:
        return [c for c in self.columns if isinstance(self.dtype(c), kinds)]

    def text(self, column: str) -> Column:
        return F.col(f"`{column}`").cast("string")

    def strict_number(self, column: str) -> Column:
        """Dot decimals only; booleans count as 0/1."""
        kind = self.dtype(column)
        if isinstance(kind, NUMERIC):
            return F.col(f"`{column}`").cast("double")
        if isinstance(kind, T.BooleanType):
            return F.col(f"`{column}`").cast("int").cast("double")
        return number(self.text(column))

    def loose_number(self, column: str) -> Column:
        """Decimal commas accepted; booleans are words here and do not parse."""
        if isinstance(self.dtype(column), NUMERIC):
            return F.col(f"`{column}`").cast("double")
        return number_comma(self.text(column))

    def with_metadata(self, **changes) -> "Dataset":
        return replace(self, metadata={**self.metadata, **changes})

    def with_df(self, df: DataFrame) -> "Dataset":
        return replace(self, df=df)
