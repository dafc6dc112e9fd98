"""The ranked review register, its summary and the row sample for reviewers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from tabsift.config import DEFAULT_REASON, DIMENSION_WORDS, ISSUE_REASONS
from tabsift.dataset import Dataset, small_table
from tabsift.functions import exprs as X
from tabsift.operators.ranking import global_position, seeded_key

NO_ROLE = "unassigned/dataset-level"


def issue_explanation(role: Column) -> Column:
    """One template sentence per issue record."""
    word = F.coalesce(F.try_element_at(X.literal_map(DIMENSION_WORDS), F.col("dimension")), F.lit("Quality"))
    reason = F.coalesce(F.try_element_at(X.literal_map(ISSUE_REASONS), F.col("issue_type")), F.lit(DEFAULT_REASON))
    column = F.when(F.col("column").isNull() | (F.col("column") == "") | (F.lower("column") == "nan"), "(dataset-level)").otherwise(F.col("column"))
    rule = F.when(F.coalesce("rule", F.lit("")) == "", "configured check").otherwise(F.col("rule"))
    return F.format_string(
        "%s issue '%s' on column '%s' (semantic role: %s); triggered by %s [%s], affecting %d value(s). "
        "Human review needed because %s; the engine does not auto-correct data.",
        word, F.replace("issue_type", F.lit("_"), F.lit(" ")), column, role, F.replace("method", F.lit("_"), F.lit(" ")),
        rule, F.col("count"), reason)


def with_roles(issues: DataFrame, roles: DataFrame) -> DataFrame:
    """Left lookup of each issue's column; dataset-level and unknown columns get the default label."""
    known = roles.select("column", F.col("role").alias("_role"))
    return issues.join(F.broadcast(known), "column", "left").withColumn("role", F.coalesce("_role", F.lit(NO_ROLE))).drop("_role")


def priority(metadata: dict, config: dict) -> Column:
    review = config["review"]
    rank = F.coalesce(F.try_element_at(X.literal_map(review["severity_rank"]), F.lower("severity")), F.lit(1))
    critical = sorted({c.strip().lower() for c in metadata["critical_fields"]})
    is_critical = F.coalesce(X.normalize(F.col("column")).isin(critical), F.lit(False)) if critical else F.lit(False)
    role_review = F.col("issue_type").isin("semantic_role_disagreement", "low_semantic_role_confidence")
    return (rank + F.when(is_critical, review["critical_boost"]).otherwise(0)
            + F.when(role_review, review["role_review_boost"]).otherwise(0) + F.log1p(F.col("count").cast("double")))


def triage_register(issues: DataFrame, roles: DataFrame, metadata: dict, config: dict, dataset: str = "dataset") -> DataFrame:
    """Issues ranked by priority; ties are broken by dimension, type and column.

    The window runs over issue records, a few per column of a dataset.
    """
    scored = (with_roles(issues, roles).withColumn("priority_score", priority(metadata, config))
              .withColumn("hitl_explanation", issue_explanation(F.col("role"))).withColumn("dataset", F.lit(dataset)))
    order = Window.partitionBy("dataset").orderBy(F.desc("priority_score"), "dimension", "issue_type", F.asc_nulls_first("column"), "rule")
    return (scored.withColumn("priority_rank", F.row_number().over(order).cast("long"))
            .withColumn("suggested_decision_options", F.lit(" | ".join(config["review"]["decisions"])))
            .select("dataset", "priority_rank", "dimension", "method", "issue_type", "column", "count", "severity", "priority_score", "rule",
                    "suggested_decision_options", "hitl_explanation"))


def top_triage(register: DataFrame, k: int) -> DataFrame:
    return register.where(F.col("priority_rank") <= k)


def triage_summary(issues: DataFrame) -> DataFrame:
    """Per dimension: issue records, affected values and high-severity records; one ``none`` row when empty."""
    summary = issues.groupBy("dimension").agg(F.count("issue_type").alias("n_issue_types"), F.sum("count").alias("total_count"),
                                              F.count_if(F.lower("severity") == "high").alias("high_severity"))
    nothing = (issues.agg(F.count(F.lit(1)).alias("n")).where("n = 0")
               .select(F.lit("none").alias("dimension"), *[F.lit(0).cast("long").alias(c) for c in ("n_issue_types", "total_count", "high_severity")]))
    return summary.unionByName(nothing)


def review_sample(ds: Dataset, flags: DataFrame | None) -> DataFrame:
    """Anomalous, then incomplete, then seeded control rows, none twice.

    Control rows come from all rows not yet taken, so their tags follow the row, not the stratum. Each
    stratum is a top-k of configured size over keys and tags; the row contents are fetched last, for the
    chosen keys only.
    """
    sizes = ds.config["review"]
    row = F.col(f"`{ds.row_id}`").alias("row_id")
    incomplete = F.exists(F.array(*[F.col(f"`{c}`").isNull() for c in ds.columns]), lambda x: x)
    if flags is None:
        tagged = ds.df.select(row, incomplete.alias("incomplete"), F.lit(False).alias("anomalous"))
    else:
        hits = flags.where("ensemble_flag").select("row_id", F.lit(True).alias("anomalous"))
        tagged = (ds.df.select(row, incomplete.alias("incomplete")).join(hits, "row_id", "left")
                  .withColumn("anomalous", F.coalesce("anomalous", F.lit(False))))

    def untaken(taken):
        return tagged.join(F.broadcast(taken.select("row_id")), "row_id", "left_anti")

    first = small_table(tagged.where("anomalous").orderBy("row_id").limit(sizes["anomaly_rows"]))
    second = small_table(untaken(first).where("incomplete").orderBy("row_id").limit(sizes["incomplete_rows"]))
    third = small_table(untaken(first.unionByName(second)).withColumn("key", seeded_key(F.col("row_id"), ds.config["random_seed"]))
                        .orderBy("key").limit(sizes["control_rows"]).drop("key"))
    chosen = reduce(DataFrame.unionByName, [first, second, third])
    values = ds.df.select(row, X.row_json(ds.columns).alias("row_values_json"))
    chosen = values.join(F.broadcast(chosen), "row_id")
    source = F.concat_ws("+", F.when(F.col("anomalous"), "semantic_ai_anomaly_candidate"), F.when(F.col("incomplete"), "incomplete_record"))
    return chosen.select(F.col("row_id").alias("row_index"), F.when(source == "", "control_record").otherwise(source).alias("candidate_source"),
                         "row_values_json", F.lit("").alias("manual_decision"),
                         F.lit(" | ".join(sizes["decisions"])).alias("allowed_decisions"), F.lit("").alias("reviewer"), F.lit("").alias("rationale"))


def control_rows(df: DataFrame, row_id: str, n: int, seed: int) -> DataFrame:
    """Seeded sample without replacement with its draw position."""
    keyed = df.select(F.col(f"`{row_id}`").alias("row_id"), seeded_key(F.col(f"`{row_id}`"), seed).alias("key"))
    return global_position(keyed, "key", n).select("row_id", "position")
