import numpy as np
import pytest
from pyspark.sql import functions as F

from tabsift.dataset import Dataset
from tabsift.operators import native_counts
from tabsift.operators.frequency import column_measures, first_values

NAMES = ["n_rows", "missing_count", "non_missing", "distinct_count", "strict_count", "loose_count", "distinct_numbers", "marker_count", "is_binary", "key_like"]


@pytest.fixture(scope="module")
def numbers(spark):
    rng = np.random.default_rng(3)
    rows = []
    for k in range(2_000):
        gap = rng.random() < 0.1
        rows.append((k, k * 3 - 1000, None if gap else int(rng.integers(0, 2)), int(rng.integers(-2**40, 2**40)), float(rng.normal()), float(rng.integers(0, 50)), None if gap else float(k) / 2,
                     None, 7, 2**60 + int(rng.integers(0, 5)), float(rng.choice([1.0, 1.0 + 1e-9, 2.0]))))
    return spark.createDataFrame(rows, "row_id long, dense int, flag int, sparse long, noise double, coded double, half double, nothing long, one short, huge long, near double").repartition(6)


def _measures(df):
    return {r.column: tuple(r[n] for n in NAMES) for r in column_measures(Dataset.of("d", df, "row_id")).collect()}


def test_numbers_are_measured_as_their_texts_are(spark, numbers):
    """Against the grouping of texts; whole doubles print with a point there, so they are no 0/1 codes in either."""
    texts = numbers.select("row_id", *(F.col(c).cast("string").alias(c) for c in numbers.columns[1:]))
    expected = _measures(texts)
    found = _measures(numbers)
    assert found == expected
    assert found["flag"][8] and found["dense"][9] and not found["near"][9] and found["nothing"][2] == 0


def test_no_native_number_becomes_text(spark, numbers):
    ds = Dataset.of("d", numbers.drop("huge"), "row_id")
    plan = column_measures(ds)._jdf.queryExecution().optimizedPlan().toString()
    assert "bitmap_construct_agg" in plan and "as string" not in plan
    used, _ = native_counts.native_measures(Dataset.of("d", numbers, "row_id"))
    assert "huge" not in used and len(used) == 9


def test_no_rows(spark, numbers):
    assert {v[:4] for v in _measures(numbers.limit(0)).values()} <= {(0, 0, 0, 0)}


def test_first_values_of_sparse_columns_are_one_scan(spark):
    """Whatever the number of sparse columns: the plan reads the table once, and a job more for the head."""
    names = [f"c{i}" for i in range(12)]
    df = spark.range(5_000).select(F.col("id").alias("row_id"), *(F.when(F.col("id") % 401 == i, F.concat(F.lit("v"), F.col("id"))).alias(c) for i, c in enumerate(names))).repartition(5)
    ds = Dataset.of("d", df, "row_id")
    out = first_values(ds, 5)
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Range (0") <= 1
    found = {}
    for r in out.orderBy("column", "position").collect():
        found.setdefault(r.column, []).append(r.value)
    assert found == {c: [f"v{i + 401 * j}" for j in range(5)] for i, c in enumerate(names)}
