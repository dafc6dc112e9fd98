"""Completeness: placeholder codes, technical and semantic missingness, cell and row scores."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F, types as T

from tabsift.dataset import Dataset
from tabsift.functions import exprs as X
from tabsift.operators.frequency import column_measures, unpivot_text, value_counts


def sentinel_candidates(ds: Dataset, measures: list) -> list[str]:
    """Columns whose counts still allow placeholder codes; all others are settled without a shuffle.

    At most ``max_token_fraction`` of the values may be codes and 90 % of the rest must be numbers,
    which bounds the numeric share from below.
    """
    rule = ds.config["missingness"]["sentinels"]
    floor = 0.90 * (1 - rule["max_token_fraction"]) - 1e-6
    return [m["column"] for m in measures
            if rule["enabled"] and m["non_missing"] > m["loose_count"] > 0
            and m["loose_count"] / m["non_missing"] >= floor and m["distinct_numbers"] >= 3]


def detect_sentinels(ds: Dataset, measures: list | None = None) -> DataFrame:
    """(column, token): the few repeated non-numeric codes of otherwise numeric columns."""
    spark = ds.df.sparkSession
    rule = ds.config["missingness"]["sentinels"]
    measures = column_measures(ds).collect() if measures is None else measures
    columns = sentinel_candidates(ds, measures)
    empty = spark.createDataFrame([], "column string, token string, freq long")
    if not columns:
        return empty
    known = {m.strip().lower() for kind in ("technical_markers", "semantic_markers")
             for m in ds.config["missingness"][kind]}
    codes = (value_counts(ds, columns)
             .where(X.number_comma(F.col("token")).isNull() & (F.length("token") <= rule["max_token_length"])
                    & (F.col("freq") >= rule["min_token_count"])))
    totals = spark.createDataFrame(
        [(m["column"], m["non_missing"], m["loose_count"], m["distinct_numbers"]) for m in measures if m["column"] in columns],
        "column string, filled long, numeric long, numbers long")
    share = X.safe_div(F.col("numeric"), F.col("filled") - F.col("coded"))
    accepted = (codes.groupBy("column").agg(F.count(F.lit(1)).alias("n_codes"), F.sum("freq").alias("coded"))
                .where(F.col("n_codes") <= rule["max_distinct_tokens"])
                .join(F.broadcast(totals), "column")
                .where(X.safe_div(F.col("coded"), F.col("filled")) <= rule["max_token_fraction"])
                .where((share >= 1 - 1e-9) | (X.safe_div(F.col("numeric"), F.col("filled")) >= rule["min_numeric_fraction"]))
                .where(share >= 0.90)
                .where(F.col("numbers") >= F.greatest(F.lit(3), 2 * F.col("n_codes")))
                .select("column"))
    return (codes.join(F.broadcast(accepted), "column", "left_semi")
            .where(~F.col("token").isin(sorted(known))).select("column", "token", "freq"))


def sentinel_map(ds: Dataset, measures: list | None = None) -> dict[str, list[str]]:
    """The codes on the driver: at most ``max_distinct_tokens`` per column."""
    found: dict[str, list[str]] = {}
    for row in detect_sentinels(ds, measures).collect():
        found.setdefault(row["column"], []).append(row["token"])
    return {c: sorted(tokens) for c, tokens in found.items()}


def unusable(ds: Dataset, column: str, sentinels: dict[str, list[str]]) -> Column:
    """True where a present cell is a semantic marker or one of the column's codes; both are words."""
    if not isinstance(ds.dtype(column), T.StringType):
        return F.lit(False)
    tokens = {m.strip().lower() for m in ds.config["missingness"]["semantic_markers"]} | set(sentinels.get(column, []))
    return F.coalesce(X.normalize(ds.text(column)).isin(sorted(tokens)), F.lit(False))


def usable_number(ds: Dataset, column: str, sentinels: dict[str, list[str]]) -> Column:
    """The cell as a number with placeholder codes and markers as NULL."""
    codes = sentinels.get(column)
    parsed = ds.loose_number(column)
    return F.when(~X.normalize(ds.text(column)).isin(codes), parsed) if codes else parsed


def missingness(ds: Dataset, sentinels: dict[str, list[str]]) -> DataFrame:
    """Technical and semantic missingness per column: one scan, partial sums only in the shuffle."""
    columns = ds.columns
    sums = [F.count(F.lit(1)).alias("n_rows")]
    for i, c in enumerate(columns):
        sums.append(F.count_if(F.col(f"`{c}`").isNull()).alias(f"t{i}"))
        sums.append(F.count_if(unusable(ds, c, sentinels)).alias(f"s{i}"))
    totals = ds.df.agg(*sums)
    cells = F.array(*[F.struct(F.lit(i).alias("ordinal"), F.lit(c).alias("column"), F.col(f"t{i}").alias("technical_missing"),
                               F.col(f"s{i}").alias("semantic_unusable")) for i, c in enumerate(columns)])
    both = F.col("technical_missing") + F.col("semantic_unusable")
    rows = F.col("n_rows")
    return (totals.select("n_rows", F.inline(cells))
            .select("ordinal", "column", "n_rows", "technical_missing", "semantic_unusable", both.alias("total_unusable"),
                    X.safe_div(F.col("technical_missing"), rows).alias("technical_missing_rate"),
                    X.safe_div(both, rows).alias("semantic_adjusted_unusable_rate"),
                    X.safe_div(F.col("semantic_unusable"), rows).alias("semantic_adjustment_delta")))


def incomplete_rows(ds: Dataset, sentinels: dict[str, list[str]]) -> DataFrame:
    """Rows, and rows with at least one missing or unusable cell."""
    bad = F.exists(F.array(*[F.col(f"`{c}`").isNull() | unusable(ds, c, sentinels) for c in ds.columns]), lambda x: x)
    return ds.df.agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(bad).alias("incomplete_rows"))


def declared(ds: Dataset) -> tuple[list[str], list[str], list[str]]:
    """Required and critical columns after the fallbacks, and the critical ones as declared."""
    required = [c for c in ds.metadata["required_fields"] if c in ds.columns]
    critical = [c for c in ds.metadata["critical_fields"] if c in ds.columns]
    required_used = required or ds.columns
    return required_used, critical or required_used, critical


def field_completeness(miss: DataFrame, columns: list[str]) -> DataFrame:
    """1 - unusable cells / cells over the named columns, by semi-join with the declared list."""
    wanted = miss.sparkSession.createDataFrame([(c,) for c in columns], "column string")
    return (miss.join(F.broadcast(wanted), "column", "left_semi")
            .agg((1 - X.safe_div(F.sum("total_unusable"), F.max("n_rows") * F.lit(max(len(columns), 1)))).alias("score")))


def cell_completeness(miss: DataFrame) -> DataFrame:
    cells = F.sum("n_rows")
    return miss.agg((1 - X.safe_div(F.sum("technical_missing"), cells)).alias("technical_cell"),
                    (1 - X.safe_div(F.sum("total_unusable"), cells)).alias("semantic_cell"))


def components(df: DataFrame, weights: dict[str, float]) -> DataFrame:
    """Wide scores to (component, score, weight, weighted_score)."""
    rows = F.array(*[F.struct(F.lit(k).alias("component"), X.clip01(F.col(k)).alias("score"), F.lit(w).alias("weight"))
                     for k, w in weights.items()])
    return (df.select(F.inline(rows))
            .select("component", "score", "weight", (F.col("score") * F.col("weight")).alias("weighted_score")))


def completeness_components(ds: Dataset, sentinels: dict[str, list[str]]) -> DataFrame:
    """All five completeness scores from a single scan of the rows."""
    required, critical, _ = declared(ds)
    unusable_of = {c: F.col(f"`{c}`").isNull() | unusable(ds, c, sentinels) for c in ds.columns}

    def cells(columns, flag) -> Column:
        return F.sum(reduce(lambda a, b: a + b, [flag(c).cast("long") for c in columns]))

    flags = F.array(*[unusable_of[c] for c in ds.columns])
    totals = ds.df.agg(
        F.count(F.lit(1)).alias("n"),
        cells(ds.columns, lambda c: F.col(f"`{c}`").isNull()).alias("technical"),
        cells(ds.columns, lambda c: unusable_of[c]).alias("total"),
        cells(required, lambda c: unusable_of[c]).alias("required"),
        cells(critical, lambda c: unusable_of[c]).alias("critical"),
        F.count_if(F.exists(flags, lambda x: x)).alias("rows_hit"))
    n, width = F.col("n"), len(ds.columns)
    scores = totals.select(
        (1 - X.safe_div(F.col("technical"), n * width)).alias("technical_cell"),
        (1 - X.safe_div(F.col("total"), n * width)).alias("semantic_cell"),
        (1 - X.safe_div(F.col("required"), n * len(required))).alias("required_fields"),
        (1 - X.safe_div(F.col("critical"), n * len(critical))).alias("critical_fields"),
        (1 - X.safe_div(F.col("rows_hit"), n)).alias("complete_rows"))
    return components(scores, ds.config["scoring"]["C"])


def completeness_issues(ds: Dataset, miss: DataFrame) -> DataFrame:
    critical = declared(ds)[2]
    rate, delta = F.col("semantic_adjusted_unusable_rate"), F.col("semantic_adjustment_delta")
    is_critical = F.col("column").isin(critical) if critical else F.lit(False)

    def found(kind, count, severity, rule):
        return F.struct(F.lit(kind).alias("issue_type"), F.col(count).alias("count"),
                        severity.alias("severity"), F.lit(rule).alias("rule"))

    first = (F.when(is_critical & (rate > 0), found("critical_field_missingness", "total_unusable", F.lit("high"), "metadata critical_fields"))
             .when(delta > 0, found("semantic_unusable_values", "semantic_unusable", F.lit("medium"), "config semantic_missing_markers"))
             .when(rate >= 0.20, found("high_missingness", "total_unusable", F.when(rate >= 0.40, "high").otherwise("medium"), "auto: >=20% missing")))
    return (miss.select("column", first.alias("i")).where(F.col("i").isNotNull())
            .select(F.lit("C").alias("dimension"), F.lit("completeness").alias("method"), "i.issue_type", "column",
                    "i.count", "i.severity", F.lit("review").alias("hitl_decision"), "i.rule"))


def missingness_effect(miss: DataFrame) -> DataFrame:
    label = (F.when(F.col("semantic_adjustment_delta") > 0,
                    "Semantic missing markers increase the unusable-value burden for this variable.")
             .otherwise("No semantic missingness adjustment for this variable."))
    return (miss.drop("n_rows", "ordinal").withColumn("baseline", F.lit("generic_missingness_vs_semantic_adjustment"))
            .withColumn("interpretation", label))


def without_sentinels(ds: Dataset, sentinels: DataFrame, columns: list[str]) -> DataFrame:
    """Cells that are not one of their column's codes, by anti-join on (column, token).

    The code list is bounded (five per column), so it is the side that is broadcast.
    """
    cells = (unpivot_text(ds, columns, [ds.row_id]).where(F.col("value").isNotNull())
             .withColumn("token", X.normalize(F.col("value"))))
    return cells.join(F.broadcast(sentinels.select("column", "token")), ["column", "token"], "left_anti").drop("token")


def ranked_missing(miss: DataFrame, k: int) -> DataFrame:
    """The k columns with the highest adjusted rate."""
    return (miss.orderBy(F.desc("semantic_adjusted_unusable_rate"), "ordinal").limit(k)
            .select("column", "semantic_adjusted_unusable_rate"))
