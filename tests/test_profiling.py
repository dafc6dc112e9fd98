import random

import pytest

from tabsift import CONFIG, Dataset, merge_metadata
from tabsift.operators import accuracy, missing, roles
from tabsift.operators.frequency import column_measures, first_values


def one_column(spark, values, name="x", metadata=None):
    rows = [(i, v) for i, v in enumerate(values)]
    return Dataset.of("d", spark.createDataFrame(rows, f"row_id long, `{name}` string"), "row_id", metadata)


def numbers(n):
    return [str(i) for i in range(n)]


CODES = ["alpha", "beta", "gamma", "delta", "omega", "zeta"]
SENTINELS = [
    (numbers(40) + ["ex"] * 5, {"ex"}),
    (numbers(40) + [c for c in CODES for _ in range(2)], set()),
    (numbers(40) + ["x" * 21] * 5, set()),
    (numbers(40) + ["ex"], set()),
    (numbers(14) + ["ex"] * 86, set()),
    (numbers(40) + [f"w{i}" for i in range(6)] + ["ex"] * 2, set()),
    (["1", "2", "3"] * 10 + ["a"] * 2 + ["b"] * 2, set()),
    (numbers(40) + ["Not Tested"] * 5, set()),
    (numbers(40) + ["EX "] * 2 + ["ex"] * 3, {"ex"}),
]


@pytest.mark.parametrize("values,expected", SENTINELS)
def test_sentinels(spark, values, expected):
    assert set(missing.sentinel_map(one_column(spark, values)).get("x", [])) == expected


KEYS = [(numbers(50), True), ([f"{i}.25" for i in range(50)], False), (["112946.26", "473274.17"], True),
        (numbers(90) + [f"w{i}" for i in range(10)], True), (["1.2", "1.4", "1.3"] * 3, False)]


@pytest.mark.parametrize("values,expected", KEYS)
def test_key_like(spark, values, expected):
    assert column_measures(one_column(spark, values)).first()["key_like"] is expected


BINARY = [(["0", "1"], True), (["Yes", "no "], True), (["M"], True), (["male", "f"], False), (["0", "1", "2"], False), ([None, None], False)]


@pytest.mark.parametrize("values,expected", BINARY)
def test_binary(spark, values, expected):
    assert column_measures(one_column(spark, values)).first()["is_binary"] is expected


ROLES = [
    ("anything", numbers(40), {"semantic_roles": {"anything": "custom"}}, "custom"),
    ("Code", numbers(40), {"id_fields": ["code "]}, "identifier"),
    ("y", numbers(40), {"target_fields": ["Y"]}, "target_or_outcome"),
    ("z", [None] * 40, {}, "empty_or_missing_only"),
    ("patient_id", numbers(40), {}, "identifier"),
    ("flag", ["yes", "no"] * 20, {}, "binary"),
    ("diagnosis", ["a", "b", "c"] * 20, {}, "target_or_outcome"),
    ("note", ["a", "b", "c"] * 20, {}, "free_text"),
    ("grade", ["1", "2", "3"] * 20, {}, "ordinal_or_categorical"),
    ("weight", numbers(40) + [None] * 20, {}, "continuous_measurement_high_missingness"),
    ("weight", numbers(40), {}, "continuous_measurement"),
    ("amount", numbers(40), {}, "continuous_numeric"),
    ("date_of_birth", [f"2020-01-{i % 28 + 1}" for i in range(60)], {}, "date_time"),
    ("mix", numbers(40) + [f"w{i}" for i in range(30)], {}, "mixed_numeric_requires_review"),
    ("kind", ["a", "b", "c"] * 20, {}, "categorical_nominal"),
    ("words", [f"word {i}" for i in range(60)], {}, "free_text_or_high_cardinality"),
]


def test_role_rules(spark):
    for name, values, metadata, expected in ROLES:
        ds = one_column(spark, values, name, metadata)
        role = roles.rule_role(roles.column_stats(ds)[0], ds.metadata, CONFIG).first()["role"]
        assert role == expected, (name, role)


def test_statistics_do_not_depend_on_partitions_or_order(spark):
    values = numbers(60) + ["ex"] * 7 + [None] * 5
    shuffled = values[:]
    random.Random(1).shuffle(shuffled)
    a = one_column(spark, values)
    b = one_column(spark, shuffled)
    pick = ["distinct_count", "missing_count", "loose_count", "distinct_numbers"]
    left = column_measures(a.with_df(a.df.repartition(1))).select(pick).first()
    right = column_measures(b.with_df(b.df.repartition(8))).select(pick).first()
    assert left == right


def test_first_values_of_sparse_columns(spark):
    values = [None] * 300 + ["late"] * 3
    got = [(r["position"], r["value"]) for r in first_values(one_column(spark, values), 2).orderBy("position").collect()]
    assert got == [(1, "late"), (2, "late")]


def test_completeness_scores_and_issues(spark):
    df = spark.createDataFrame([(0, "1", "n/a"), (1, "2", "pending"), (2, "3", "x"), (3, "4", None)], "row_id long, a string, b string")
    ds = Dataset.of("d", df, "row_id", {"critical_fields": ["b"]})
    scores = {r["component"]: r["score"] for r in missing.completeness_components(ds, {}).collect()}
    assert scores == {"technical_cell": 0.75, "semantic_cell": 0.625, "required_fields": 0.625, "critical_fields": 0.25, "complete_rows": 0.25}
    found = missing.completeness_issues(ds, missing.missingness(ds, {})).collect()
    assert [(r["issue_type"], r["count"], r["severity"]) for r in found] == [("critical_field_missingness", 3, "high")]


def test_duplicates_with_one_hot_row(spark):
    df = spark.createDataFrame([("a", None)] * 500 + [("b", str(i)) for i in range(500)], "x string, y string")
    row = accuracy.duplicate_rows(df, ["x", "y"]).first()
    assert (row["n_rows"], row["distinct_rows"], row["duplicate_rows"]) == (1000, 501, 499)


def test_metadata_defaults_and_nested_columns(spark):
    assert merge_metadata({"id_fields": None, "title": "t"})["id_fields"] == []
    with pytest.raises(ValueError):
        Dataset.of("d", spark.createDataFrame([(1, [1])], "row_id long, v array<int>"), "row_id")


def test_category_variants_leave_wide_columns_alone(spark):
    few = accuracy.category_variants(one_column(spark, ["Control", "Control(9)", "Case"] * 5), ["x"]).first()
    assert (few["n_variants"], few["example"]) == (2, "Control / Control(9)")
    assert accuracy.category_variants(one_column(spark, [f"w{i}" for i in range(60)]), ["x"]).count() == 0


def test_value_counts_keep_every_digit_of_a_number(spark, tmp_path):
    import __spark_entry__ as registered
    balances = [711.56, 0.125, 0.126, 1e25, -3.0, 100.0]
    spark.createDataFrame([(i + 1, i, "A", b) for i, b in enumerate(balances)], "c_custkey long, c_nationkey long, c_mktsegment string, c_acctbal double").write.parquet(f"{tmp_path}/customer.parquet")
    rows = registered.queries()["value_counts"](spark, str(tmp_path)).where("column = 'balance_value'").collect()
    assert sorted((r["token"], r["freq"]) for r in rows) == sorted((t, 1) for t in ("711.56", "0.125", "0.126", "1.0e25", "-3", "100"))
