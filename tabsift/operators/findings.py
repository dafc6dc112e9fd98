"""Roll-ups of the result tables: check counts, effects and the criteria verdict."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

FLAGS = {"anomaly_selected": "accuracy_anomaly_detection_semantic", "domain_range_selected": "accuracy_domain_range",
         "allowed_values_selected": "accuracy_allowed_values", "identifier_checks": "accuracy_identifier_uniqueness",
         "required_fields": "completeness_required_field", "critical_fields": "completeness_critical_field",
         "quasi_identifiers": "reuse_quasi_identifier", "low_confidence_to_hitl": "flag_low_confidence_for_hitl",
         "selection_differs_from_uniform": "anomaly_selection_differs"}


def check_counts(selection: DataFrame) -> DataFrame:
    return selection.agg(F.count(F.lit(1)).alias("n_variables"), F.count_distinct("semantic_role").alias("n_roles"),
                         *[F.count_if(F.col(c)).alias(name) for name, c in FLAGS.items()])


def role_counts(selection: DataFrame) -> DataFrame:
    return selection.groupBy("semantic_role").agg(F.count(F.lit(1)).alias("n_variables"))


def effects(anomaly: DataFrame, miss: DataFrame, reuse: DataFrame) -> DataFrame:
    """One row: columns, rows and rates per policy, variables with a semantic burden, and both R scores."""
    def pick(flag, name):
        return F.max(F.when((F.col("hitl_prioritisation") == "not_semantic") == F.lit(flag), F.col(name)))

    plain = F.col("method") == "metadata_checklist_only"
    a = anomaly.agg(pick(True, "n_columns").alias("generic_cols"), pick(True, "flagged_rows").alias("generic_rows"),
                    pick(True, "flagged_rate").alias("generic_rate"), pick(False, "n_columns").alias("semantic_cols"),
                    pick(False, "flagged_rows").alias("semantic_rows"), pick(False, "flagged_rate").alias("semantic_rate"))
    m = miss.agg(F.count_if(F.col("semantic_adjustment_delta") > 0).alias("semantic_missing_vars"))
    r = reuse.agg(F.max(F.when(plain, F.col("R_score"))).alias("reuse_checklist_only"),
                  F.max(F.when(~plain, F.col("R_score"))).alias("reuse_hybrid"))
    one = F.lit(1).alias("one")      # three one-row aggregates side by side
    return a.select("*", one).join(m.select("*", one), "one").join(r.select("*", one), "one").drop("one")


CRITERIA = [("RQ1", "Semantic roles inferred and used to select checks"),
            ("RQ2", "Semantic assessment differs from uniform profiling (measurable effect)"),
            ("RQ3", "Interpretable three-dimension profile (C, A, R) with breakdowns produced"),
            ("HITL", "Human-in-the-loop triage register produced"),
            ("EVAL", "Quantitative evaluation present (controlled error injection)"),
            ("SCOPE", "No automatic data repair/imputation of the dataset (by design)")]


def criteria(met: dict[str, bool], spark) -> DataFrame:
    """Six criteria and whether all of them hold."""
    rows = [(key, label, bool(met[key])) for key, label in CRITERIA]
    table = spark.createDataFrame(rows, "id string, label string, met boolean")
    verdict = table.agg(F.bool_and("met").alias("aim_met"))
    return table.select("*", F.lit(1).alias("one")).join(verdict.select("aim_met", F.lit(1).alias("one")), "one").drop("one")


def criteria_met(tables: dict[str, DataFrame | None]) -> dict[str, bool]:
    """Which criteria the available result tables satisfy; an absent table is None."""
    selection, profile = tables.get("rq1_check_selection_map"), tables.get("rq3_quality_profile")
    counts = check_counts(selection).first() if selection is not None else None
    differs = counts is not None and counts["selection_differs_from_uniform"] > 0
    anomaly = tables.get("anomaly_baseline_comparison")
    if anomaly is not None:
        spread = anomaly.agg(F.count_distinct("n_columns").alias("c"), F.count_distinct("flagged_rows").alias("r")).first()
        differs = differs or max(spread["c"], spread["r"]) > 1
    return {"RQ1": counts is not None and counts["n_roles"] >= 1,
            "RQ2": differs or tables.get("rq2_semantic_vs_uniform") is not None,
            "RQ3": profile is not None and {"C(D)", "A(D)", "R(D)"} <= set(profile.columns),
            "HITL": tables.get("hitl_triage_register") is not None,
            "EVAL": tables.get("controlled_error_baseline") is not None, "SCOPE": True}
