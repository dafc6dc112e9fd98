import math

import pytest
from pyspark.sql import functions as F

from tabsift.functions import exprs as X

NUMBERS = [("1", 1.0, 1.0), (" 1 ", 1.0, 1.0), ("1e3", 1000.0, 1000.0), ("+3", 3.0, 3.0), (".5", 0.5, 0.5), ("5.", 5.0, 5.0),
           ("inf", math.inf, math.inf), ("-Infinity", -math.inf, -math.inf), ("nan", None, None), ("1_000", None, None),
           ("0x10", None, None), ("True", None, None), ("1d", None, None), ("1f", None, None), ("1,5", None, 1.5), ("", None, None)]


def test_number_grammar(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _, _) in enumerate(NUMBERS)], "i int, t string")
    rows = df.select("i", X.number(F.col("t")).alias("a"), X.number_comma(F.col("t")).alias("b")).orderBy("i").collect()
    assert [(r.a, r.b) for r in rows] == [(a, b) for _, a, b in NUMBERS]


def test_canonical_category(spark):
    words = ["Control", "Control(9)", "Control (9)", "grade 1", "grade 2", "A-b_c/d"]
    got = [r.c for r in spark.createDataFrame([(w,) for w in words], "w string").select(X.canonical_category(F.col("w")).alias("c")).collect()]
    assert got == ["control", "control", "control", "grade1", "grade2", "abcd"]


@pytest.mark.parametrize("value,expected", [(None, 0.0), (float("nan"), 0.0), (-1.0, 0.0), (0.25, 0.25), (7.0, 1.0)])
def test_clip01(spark, value, expected):
    df = spark.createDataFrame([(value,)], "x double")
    assert df.select(X.clip01(F.col("x")).alias("y")).first().y == expected


def test_safe_div_and_score_value(spark):
    df = spark.createDataFrame([(1.0, 0.0, "True"), (1.0, 4.0, "0.4"), (1.0, None, "words"), (3.0, 2.0, "7")], "a double, b double, t string")
    rows = df.select(X.safe_div(F.col("a"), F.col("b")).alias("q"), X.score_value(F.col("t")).alias("s")).collect()
    assert [r.q for r in rows] == [0.0, 0.25, 0.0, 1.5] and [r.s for r in rows] == [1.0, 0.4, 0.0, 1.0]


def test_assemble_documentation_skips_blank_fields(spark):
    df = spark.range(1).select(X.assemble_documentation({"title": F.lit("t"), "license": F.lit(""), "abstract": F.lit("a")},
                                                        X.literal_map({"v": "d", "w": ""})).alias("x"))
    assert df.first().x == "title: t\nabstract: a\nVariable v: d"
