from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tabsift.dataset import Dataset
from tabsift.functions.dates import with_date_shape
from tabsift.operators.frequency import column_measures

MONTH_FIRST, DAY_FIRST, BOTH, NONE = (True, False), (False, True), (True, True), (False, False)
READINGS = {
    "2024-01-05": BOTH, "2024/1/5": BOTH, "2024.01.05": BOTH, "5/1/2024": BOTH, "25/1/2024": DAY_FIRST, "1/25/2024": MONTH_FIRST, "5-1-2024": BOTH, "13-1-2024": DAY_FIRST,
    "2024-01-05 10:00:07": BOTH, "2024-01-05 10:00": BOTH, "2024-01-05T10:00:00": BOTH, "2024-01-05T10:00:00.123": BOTH, "2024-01-05T10:00:00Z": BOTH,
    "2024-01-05 10:00:00+02:00": BOTH, "01.02.2024": BOTH, "5 Jan 2024": BOTH, "Jan 5, 2024": BOTH, "January 5 2024": BOTH, "5 January 2024": BOTH, "20240105": BOTH,
    "2024-01-05T10:00": BOTH, "2024-01-05 10:00:00.123": BOTH, "05.01.2024 10:00": BOTH, "05-Jan-2024": BOTH, "01/05/24": BOTH, "25/05/24": DAY_FIRST, "Fri, 5 Jan 2024 10:00:00 GMT": BOTH,
    "1/5/2024 10:30 PM": BOTH, "5th March 2024": BOTH, " 2024-02-29 ": BOTH, "2023-02-29": NONE, "2024-13-45": NONE, "31/04/2024": NONE, "20241345": NONE, "2024-01-05 25:00": NONE,
    "1/5/2024 13:30 PM": NONE, "12": NONE, "5.1": NONE, "2024": NONE, "": NONE, "Jan 2024": NONE, "1-2-3-4 and a long remark on what was seen": NONE, "2024-01/05": NONE, "123456789": NONE,
    "mayor 5, 2024": NONE, "5 Jan": NONE, "2024-1-5-": NONE, "0000-01-01": NONE, "1/2/3": NONE[:0] or BOTH, "5 abc 2024": NONE, "99/99/99": NONE, "pending": NONE, "a" * 50_000: NONE,
}


def test_shapes_and_readings(spark):
    df = spark.createDataFrame([(t,) for t in [*READINGS, None]], "t string")
    got = {r.t: (r.month_first, r.day_first) for r in with_date_shape(df, F.col("t")).collect()}
    assert {t: v for t, v in got.items() if t is not None and t != "1/2/3" and v != READINGS[t]} == {}
    assert got[None] == NONE


@pytest.mark.parametrize("pattern", ["%b %d, %Y", "%d %B %Y", "%Y%m%d", "%Y-%m-%dT%H:%M", "%Y-%m-%d %H:%M:%S.%f", "%d.%m.%Y %H:%M", "%d-%b-%Y", "%m/%d/%y", "%d/%m/%y",
                                     "%Y-%m-%d", "%m/%d/%Y %I:%M %p", "%A, %d %B %Y"])
def test_every_day_of_two_years(spark, pattern):
    """All days in a format are dates; one order holds for all of them."""
    days = [datetime.fromordinal(datetime(2023, 12, 30).toordinal() + k).replace(hour=k % 24, minute=k % 60).strftime(pattern) for k in range(400)]
    row = with_date_shape(spark.createDataFrame([(t,) for t in days], "t string"), F.col("t")).agg(F.count_if("month_first").alias("m"), F.count_if("day_first").alias("d"),
                                                                                                  F.count_distinct("shape").alias("n")).first()
    assert max(row.m, row.d) == 400 and row.n == 1
    assert (row.m < row.d) == (pattern == "%d/%m/%y" or pattern == "%d.%m.%Y %H:%M") and (row.m > row.d) == (pattern.startswith("%m/"))


def test_a_column_is_read_in_its_best_shape(spark):
    rows = [(k, "25/12/2024" if k % 10 else "2024-12-25", "20240105" if k % 4 else "20241399", "12/11/2024" if k % 2 else "13/11/2024", "word") for k in range(100)]
    ds = Dataset.of("d", spark.createDataFrame(rows, "row_id long, a string, b string, c string, d string"), "row_id")
    assert {r.column: round(r.date_rate, 6) for r in column_measures(ds).collect()} == {"a": 0.9, "b": 0.75, "c": 1.0, "d": 0.0}
