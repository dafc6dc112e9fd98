"""Dimension scores, the composite, its sensitivity to the weights, and the comparison tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from tabsift.functions import exprs as X


def weighted(scores: dict[str, Column], weights: dict[str, float]) -> Column:
    return X.clip01(reduce(lambda a, b: a + b, [X.clip01(scores[k]) * F.lit(w) for k, w in weights.items()]))


def component_rows(scores: dict[str, Column], weights: dict[str, float]) -> Column:
    return F.array(*[F.struct(F.lit(k).alias("component"), X.clip01(scores[k]).alias("score"), F.lit(w).alias("weight"),
                              (X.clip01(scores[k]) * F.lit(w)).alias("weighted_score")) for k, w in weights.items()])


def composite_index(config: dict) -> Column:
    """Over columns ``A``, ``C`` and ``R``."""
    w = config["scoring"]["composite"]
    return X.clip01(w["A"] * F.col("A") + w["C"] * F.col("C") + w["R"] * F.col("R"))


def weight_sensitivity(scores: DataFrame, config: dict) -> DataFrame:
    """Each score vector under every weight scenario; the scenarios are inlined as a constant array."""
    scenarios = F.array(*[F.struct(F.lit(name).alias("scenario"), *[F.lit(w[d]).alias(f"{d}_weight") for d in ("A", "C", "R")])
                          for name, w in config["scoring"]["scenarios"].items()])
    total = X.clip01(F.col("A_weight") * F.col("A") + F.col("C_weight") * F.col("C") + F.col("R_weight") * F.col("R"))
    return (scores.select("*", F.inline(scenarios)).withColumn("composite", total)
            .withColumn("meets_threshold", F.col("composite") >= config["scoring"]["thresholds"]["composite"]))


def sensitivity_range(sensitivity: DataFrame, keys: list[str]) -> DataFrame:
    return sensitivity.groupBy(*keys).agg(F.min("composite").alias("lowest"), F.max("composite").alias("highest"))


def threshold_flags(scores: DataFrame, config: dict) -> DataFrame:
    limits = config["scoring"]["thresholds"]
    return scores.select("*", *[(F.col(k) >= v).alias(f"{k}_meets_threshold") for k, v in limits.items()])


def semantic_vs_uniform(profiles: DataFrame, anomaly: DataFrame | None, miss: DataFrame, reuse: DataFrame | None) -> DataFrame:
    """Up to four summary rows that set the plain view beside the role-aware one."""
    def row(df, aspect, uniform, semantic, effect):
        return df.select(F.lit(aspect).alias("comparison_aspect"), uniform.alias("uniform_view"), semantic.alias("semantic_view"),
                         F.lit(effect).alias("effect"))

    roles = profiles.agg(F.count_if(F.col("role_changed_by_semantic_layer")).alias("changed"), F.count(F.lit(1)).alias("n"))
    rows = [row(roles, "variable_classification", F.format_string("%d columns unchanged", F.col("n") - F.col("changed")),
                F.format_string("%d columns reclassified by meaning", "changed"),
                "Semantic roles change which checks apply to reclassified variables.")]
    if anomaly is not None:
        def pick(flag, name):
            return F.max(F.when((F.col("hitl_prioritisation") == "not_semantic") == F.lit(flag), F.col(name)))
        both = anomaly.agg(pick(True, "n_columns").alias("gc"), pick(True, "flagged_rows").alias("gr"),
                           pick(False, "n_columns").alias("sc"), pick(False, "flagged_rows").alias("sr"))
        rows.append(row(both, "accuracy_anomaly_detection", F.format_string("%d cols, %d rows flagged", "gc", "gr"),
                        F.format_string("%d cols, %d rows flagged", "sc", "sr"),
                        "Semantic selection restricts detection to measurement-type variables and feeds HITL triage."))
    gains = miss.agg(F.count_if(F.col("semantic_adjustment_delta") > 0).alias("n"))
    rows.append(row(gains, "completeness_missingness", F.lit("technical NaN only"),
                    F.format_string("%d variables gain semantic-unusable burden", "n"),
                    "Semantic missing markers reprioritise completeness gaps."))
    if reuse is not None:
        plain = F.col("method") == "metadata_checklist_only"
        both = reuse.agg(F.max(F.when(plain, F.col("R_score"))).alias("a"), F.max(F.when(~plain, F.col("R_score"))).alias("b"))
        rows.append(row(both, "reuse_readiness", F.format_string("checklist-only R=%.3f", "a"),
                        F.format_string("four-facet hybrid R=%.3f", "b"),
                        "Text similarity, privacy and machine-readability refine the reuse score."))
    return reduce(DataFrame.unionByName, rows)


def best_detector(metrics: DataFrame) -> DataFrame:
    """The row with the highest F1; the first method name wins a tie."""
    return metrics.orderBy(F.desc("f1"), "method").limit(1)
