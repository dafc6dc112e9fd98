"""Helpers of the operators in this package."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tabsift.dataset import cut_lineage

__all__ = ["cut_lineage", "ship", "col", "pick", "ascii_lower", "row_key", "unused"]

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Once for each application, gives executors this package's source, so that tasks need no installed copy."""
    if spark.sparkContext.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parents[2]
    path = os.path.realpath(os.path.join(tempfile.mkdtemp(), "tabsift-source.zip"))
    with zipfile.ZipFile(path, "w") as out:
        for file in sorted(root.joinpath("tabsift").rglob("*.py")):
            out.write(file, file.relative_to(root))
    spark.sparkContext.addPyFile(path)
    _shipped.add(spark.sparkContext.applicationId)


def col(name: str) -> Column:
    """A column by its plain name, dots and spaces included."""
    return F.col("`" + name.replace("`", "``") + "`")


def pick(df: DataFrame, **names: str) -> DataFrame:
    """Only these columns, under the given names, so that other columns can't clash."""
    return df.select(*(col(old).alias(new) for new, old in names.items()))


def unused(df: DataFrame, name: str) -> str:
    """The name, with underscores after it until no column has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def ascii_lower(text: Column) -> Column:
    """A-Z lowered, all else as it is."""
    return F.translate(text, UPPER, LOWER)


def row_key(row_id: Column, text: Column) -> Column:
    """128 bits that are equal for rows of equal id and text, and else differ; nulls are values of their own."""
    return F.md5(F.concat(F.coalesce(F.concat(F.lit("+"), row_id.cast("string")), F.lit("-")), F.lit("\n"),
                          F.coalesce(F.concat(F.lit("+"), text), F.lit("-"))))
