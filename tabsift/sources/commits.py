"""Result tables of a dataset that become visible all at once.

All tables of a run are written to a folder of their own. Only then a manifest, which names the folder, the tables and what they were made from, is put
in place by one rename. Readers follow the newest manifest of each dataset, so a run that was stopped between two tables leaves nothing to read, and a
later run knows which datasets are finished.
"""

from __future__ import annotations

import hashlib
import json
import time
import uuid

from pyspark.sql import DataFrame, SparkSession

RUNS, MANIFESTS = "runs", "manifests"


def _folder(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark._jsc.hadoopConfiguration())


def fingerprint(spark: SparkSession, path: str, *settings) -> str:
    """What a run is made from: the file's path, length and time, and the settings."""
    place, files = _folder(spark, path)
    status = files.getFileStatus(place)
    made_from = [path, status.getLen(), status.getModificationTime(), *settings]
    return hashlib.sha256(json.dumps(made_from, sort_keys=True, default=str).encode()).hexdigest()


def commit(spark: SparkSession, base: str, dataset: str, result: dict[str, DataFrame], source: str) -> None:
    """Write every table, then make them the dataset's tables."""
    run = uuid.uuid4().hex
    for name, df in result.items():
        df.write.parquet(f"{base}/{RUNS}/{run}/{name}")
    manifest = json.dumps({"dataset": dataset, "run": run, "source": source, "tables": sorted(result)})
    folder, files = _folder(spark, f"{base}/{MANIFESTS}")
    files.mkdirs(folder)
    draft, _ = _folder(spark, f"{base}/{MANIFESTS}/.{run}.draft")
    final, _ = _folder(spark, f"{base}/{MANIFESTS}/{time.time_ns():020d}-{run}.json")
    out = files.create(draft, True)
    try:
        out.write(bytearray(manifest.encode("utf-8")))
    finally:
        out.close()
    if not files.rename(draft, final):
        raise OSError(f"{final.toString()} can't be put in place")


def manifests(spark: SparkSession, base: str) -> dict[str, dict]:
    """The newest manifest of each dataset; there are as many as files were assessed."""
    folder, files = _folder(spark, f"{base}/{MANIFESTS}")
    if not files.exists(folder):
        return {}
    names = sorted(f.getPath().toString() for f in files.listStatus(folder) if f.getPath().getName().endswith(".json"))
    if not names:
        return {}
    rows = spark.read.text(names, wholetext=True).selectExpr("_metadata.file_name AS name", "value").collect()
    found = [json.loads(r["value"]) for r in sorted(rows, key=lambda r: r["name"])]
    return {m["dataset"]: m for m in found}


def finished(spark: SparkSession, base: str) -> dict[str, str]:
    """dataset -> what its tables were made from."""
    return {name: m["source"] for name, m in manifests(spark, base).items()}


def committed(spark: SparkSession, base: str, table: str) -> DataFrame | None:
    """The table over all datasets that have it, or None."""
    paths = [f"{base}/{RUNS}/{m['run']}/{table}" for m in manifests(spark, base).values() if table in m["tables"]]
    return spark.read.option("mergeSchema", True).parquet(*paths) if paths else None
