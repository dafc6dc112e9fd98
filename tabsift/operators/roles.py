"""Uniform types, rule-based and embedding roles, and zero-configuration metadata."""

from __future__ import annotations

import re
from dataclasses import replace
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from tabsift.config import ANOMALY_ROLES, DATE_LIKE, TEXT_LIKE_ROLES
from tabsift.dataset import Dataset
from tabsift.functions import exprs as X
from tabsift.operators.frequency import column_measures, first_values
from tabsift.operators.missing import sentinel_map

STATS = ("ordinal int, column string, dtype string, n_rows long, missing_count long, non_missing long, "
         "distinct_count long, strict_count long, loose_count long, distinct_numbers long, usable_count long, "
         "is_binary boolean, key_like boolean, date_rate double, date_like boolean, sample_values string, "
         "sentinels array<string>")


def column_stats(ds: Dataset) -> tuple[DataFrame, dict[str, list[str]]]:
    """One local row per column plus the placeholder codes.

    Roles decide which columns later scans touch, so this is the one barrier: its result has as many
    rows as the dataset has columns.
    """
    measures = column_measures(ds).collect()
    sentinels = sentinel_map(ds, measures)
    coded: dict[str, int] = {}
    if sentinels:
        hits = ds.df.agg(*[F.count_if(X.normalize(ds.text(c)).isin(t)).alias(c) for c, t in sentinels.items()]).first()
        coded = hits.asDict()
    samples: dict[str, list[str]] = {}
    for row in first_values(ds, 20).orderBy("column", "position").collect():
        samples.setdefault(row["column"], []).append(row["value"])
    types = {f.name: f.dataType.simpleString() for f in ds.df.schema.fields}
    rows = []
    for m in sorted(measures, key=lambda r: r["ordinal"]):
        c = m["column"]
        rows.append((m["ordinal"], c, types[c], m["n_rows"], m["missing_count"], m["non_missing"], m["distinct_count"],
                     m["strict_count"], m["loose_count"], m["distinct_numbers"],
                     m["non_missing"] - m["marker_count"] - coded.get(c, 0), m["is_binary"], m["key_like"],
                     m["date_rate"], bool(re.search(DATE_LIKE, " ".join(samples.get(c, [])))),
                     ", ".join(samples.get(c, [])[:5]), sentinels.get(c, [])))
    return ds.df.sparkSession.createDataFrame(rows, STATS), sentinels


def base_profile(stats: DataFrame) -> DataFrame:
    rows = F.col("n_rows")
    return stats.select(
        "ordinal", "column", "dtype", "missing_count", X.safe_div(F.col("missing_count"), rows).alias("missing_rate"),
        F.col("distinct_count").alias("unique_count"), X.safe_div(F.col("distinct_count"), rows).alias("unique_rate"),
        X.safe_div(F.col("strict_count"), F.col("non_missing")).alias("non_missing_numeric_rate"), "sample_values")


def _verdict(role: str | Column, confidence: float | Column, note: str | Column) -> Column:
    def lit(x):
        return x if isinstance(x, Column) else F.lit(x)
    return F.struct(lit(role).alias("role"), lit(confidence).cast("double").alias("role_confidence"), lit(note).alias("notes"))


def _first(rules: list[tuple[Column, Column]]) -> Column:
    return F.coalesce(*[F.when(condition, verdict) for condition, verdict in rules])


def uniform_type(stats: DataFrame, config: dict) -> DataFrame:
    """Data-type profile that knows nothing about meaning."""
    r = config["roles"]
    numeric = X.safe_div(F.col("strict_count"), F.col("non_missing")) >= r["numeric_parse"]
    verdict = _first([
        (F.col("non_missing") == 0, _verdict("empty_or_missing_only", 0.40, "no non-missing values")),
        (numeric, _verdict("numeric", 0.90, "uniform dtype/numeric parsing")),
        (F.col("date_like") & (F.col("date_rate") >= 0.80), _verdict("date_time", 0.80, "uniform date parsing")),
        (F.col("is_binary"), _verdict("binary", 0.90, "uniform binary values")),
        (F.col("distinct_count") <= r["low_cardinality"], _verdict("categorical", 0.80, "uniform low-cardinality values")),
        (F.lit(True), _verdict("text_or_high_cardinality", 0.60, "uniform fallback"))])
    return stats.select("column", verdict.alias("v")).select("column", "v.role", "v.role_confidence", "v.notes")


def _named(column: Column, names: list[str]) -> Column:
    wanted = sorted({str(n).strip().lower() for n in names})
    return X.normalize(column).isin(wanted) if wanted else F.lit(False)


def _role_rules(metadata: dict, config: dict, evidence: Column | None) -> list[tuple[Column, Column]]:
    r, col = config["roles"], F.col("column")
    overrides = {str(k): str(v) for k, v in (metadata.get("semantic_roles") or {}).items()}
    rows, filled = F.col("n_rows"), F.col("non_missing")
    missing_rate = X.safe_div(F.col("missing_count"), rows)
    numeric_rate = X.safe_div(F.col("loose_count"), F.col("usable_count"))
    distinct = F.when(numeric_rate > 0, F.col("distinct_numbers")).otherwise(F.col("distinct_count"))
    ranges = list((metadata.get("valid_ranges") or {}).keys())
    measured = X.matches_any(col, r["measurement_patterns"]) | (col.isin(ranges) if ranges else F.lit(False))
    numeric = numeric_rate >= r["numeric_parse"]
    few = distinct <= r["low_cardinality"]
    share_text = F.format_string("partial numeric parsing=%.2f", numeric_rate)

    rules = []
    if overrides:
        rules.append((col.isin(list(overrides)),
                      _verdict(F.element_at(X.literal_map(overrides), col), 1.0, "metadata semantic role override")))
    rules += [
        (_named(col, metadata["id_fields"]), _verdict("identifier", 1.0, "metadata id field")),
        (_named(col, metadata["target_fields"]), _verdict("target_or_outcome", 1.0, "metadata target field")),
        (filled == 0, _verdict("empty_or_missing_only", 0.40, "no non-missing values")),
        (X.matches_any(col, r["id_patterns"]) & (X.safe_div(F.col("distinct_count"), rows) >= r["high_uniqueness"]) & F.col("key_like"),
         _verdict("identifier", 0.90, "configured id-like pattern, high uniqueness, key-like values")),
        (F.col("is_binary"), _verdict("binary", 0.92, "binary observed value set")),
    ]
    if evidence is not None:
        loose_share = X.safe_div(F.col("loose_count"), rows)
        contradicts = (loose_share >= r["numeric_parse"]) & evidence["role"].isin(TEXT_LIKE_ROLES)
        rules.append((evidence["role"].isNotNull() & ~contradicts,
                      _verdict(evidence["role"], evidence["confidence"], evidence["note"])))
    rules += [
        (X.matches_any(col, r["target_patterns"]), _verdict("target_or_outcome", 0.85, "configured target-like pattern")),
        (X.matches_any(col, r["text_patterns"]), _verdict("free_text", 0.80, "configured text-like pattern")),
        (numeric & few & ~measured, _verdict("ordinal_or_categorical", 0.82,
                                             F.format_string("few numeric-coded values; missing=%.2f", missing_rate))),
        (numeric & measured & (missing_rate >= 0.20), _verdict("continuous_measurement_high_missingness", 0.88,
                                                              F.format_string("measurement-like; missing=%.2f", missing_rate))),
        (numeric & measured, _verdict("continuous_measurement", 0.88, "measurement-like numeric variable")),
        (numeric, _verdict("continuous_numeric", 0.80, "numeric variable without domain override")),
        (X.matches_any(col, r["date_patterns"]) & (F.col("date_rate") >= 0.60),
         _verdict("date_time", 0.82, "configured date-like pattern")),
        (numeric_rate >= r["mixed_numeric"], _verdict("mixed_numeric_requires_review", 0.55, share_text)),
        (few, _verdict("categorical_nominal", 0.78, "limited observed categories")),
        (F.lit(True), _verdict("free_text_or_high_cardinality", 0.55, "semantic role requires review"))]
    return rules


def rule_role(stats: DataFrame, metadata: dict, config: dict) -> DataFrame:
    """The ordered rule list, first match wins."""
    return (stats.select("column", _first(_role_rules(metadata, config, None)).alias("v"))
            .select("column", "v.role", "v.role_confidence", "v.notes"))


def unit_literals(vectors: dict[str, list[float]], name: str) -> Column:
    """A bounded set of named vectors, scaled to length 1, as one constant array."""
    entries = []
    for key, v in vectors.items():
        size = sum(x * x for x in v) ** 0.5 or 1.0
        entries.append(F.struct(F.lit(key).alias(name), F.lit([float(x) / size for x in v]).alias("v")))
    return F.array(*entries)


def embedding_role(vectors: DataFrame, key: str, vector: str, prototypes: dict[str, list[float]], config: dict) -> DataFrame:
    """Nearest role prototype by cosine; below the minimum similarity the evidence is withheld.

    The prototype set is one vector per role of the closed vocabulary and travels as a literal.
    """
    table = unit_literals(prototypes, "role")
    scored = F.transform(table, lambda p: F.struct(X.cosine(p["v"], F.col("vector"), F.col("norm")).alias("sim"), p["role"].alias("role")))
    best = (vectors.select(key, F.col(vector).alias("vector")).withColumn("norm", X.length(F.col("vector")))
            .select(key, F.explode(F.array(F.array_max(scored))).alias("best")))
    kept = F.col("best.sim") >= config["roles"]["embedding_min_similarity"]
    return best.select(key, F.when(kept, F.col("best.role")).alias("embedding_role"),
                       F.col("best.sim").alias("similarity"),
                       F.when(kept, X.clip01(0.55 + 0.45 * F.col("best.sim"))).alias("embedding_confidence"))


def _with_evidence(stats: DataFrame, evidence: DataFrame | None) -> DataFrame:
    if evidence is None:
        return (stats.withColumn("embedding_role", F.lit(None).cast("string"))
                .withColumn("similarity", F.lit(None).cast("double"))
                .withColumn("embedding_confidence", F.lit(None).cast("double")))
    return stats.join(evidence.select("column", "embedding_role", "similarity", "embedding_confidence"), "column", "left")


def _evidence_struct() -> Column:
    note = F.format_string("embedding match (sim=%.2f)", F.col("similarity"))
    return F.struct(F.col("embedding_role").alias("role"), F.col("embedding_confidence").alias("confidence"), note.alias("note"))


def final_role(stats: DataFrame, metadata: dict, config: dict, evidence: DataFrame | None = None) -> DataFrame:
    """Rules with embedding evidence admitted after the structural rules."""
    rules = _role_rules(metadata, config, _evidence_struct())
    return (_with_evidence(stats, evidence).select("column", _first(rules).alias("v"))
            .select("column", "v.role", "v.role_confidence", "v.notes"))


def role_provenance(stats: DataFrame, metadata: dict, config: dict, evidence: DataFrame | None = None) -> DataFrame:
    """Rule, embedding and final role side by side, with the source and the review flag."""
    both = (_with_evidence(stats, evidence)
            .withColumn("r", _first(_role_rules(metadata, config, None)))
            .withColumn("f", _first(_role_rules(metadata, config, _evidence_struct()))))
    emb, rule, final = F.col("embedding_role"), F.col("r.role"), F.col("f.role")
    disagree = F.coalesce(emb != rule, F.lit(False))
    source = (F.when(emb.isNull(), "rule_based").when((emb == rule) & (final == rule), "agreement")
              .when((final == emb) & (emb != rule), "embedding").when((final == rule) & (emb != rule), "rule_based")
              .otherwise("embedding"))
    confidence = F.col("f.role_confidence")
    return both.select(
        "column", rule.alias("semantic_role_rule_based"), F.round("r.role_confidence", 3).alias("semantic_role_rule_confidence"),
        F.col("r.notes").alias("semantic_role_rule_evidence"), F.coalesce(emb, F.lit("")).alias("semantic_role_embedding"),
        F.round("embedding_confidence", 3).alias("semantic_role_embedding_confidence"),
        F.when(emb.isNotNull(), F.format_string("embedding match (sim=%.2f)", F.col("similarity")))
        .otherwise("embedding unavailable or below threshold").alias("semantic_role_embedding_evidence"),
        final.alias("semantic_role_final"), F.round(confidence, 3).alias("semantic_role_confidence"),
        source.alias("semantic_role_source"), disagree.alias("semantic_role_disagreement"),
        ((confidence < config["roles"]["low_confidence"]) | disagree).alias("requires_semantic_review"))


# --- automatic metadata ------------------------------------------------------------------------

def direct_identifiers(stats: DataFrame, metadata: dict, config: dict) -> DataFrame:
    a = config["auto_inference"]
    return (stats.where((F.col("non_missing") > 0) & ~_named(F.col("column"), metadata["direct_identifiers"])
                        & X.matches_any(F.col("column"), a["direct_identifier_patterns"]))
            .select("ordinal", "column"))


def target_fields(stats: DataFrame, metadata: dict, config: dict) -> DataFrame:
    return (stats.where((F.col("non_missing") > 0) & ~_named(F.col("column"), metadata["target_fields"])
                        & X.matches_any(F.col("column"), config["roles"]["target_patterns"]))
            .select("ordinal", "column"))


def id_fields(stats: DataFrame, metadata: dict, config: dict) -> DataFrame:
    unique = X.safe_div(F.col("distinct_count"), F.greatest(F.col("n_rows"), F.lit(1)))
    near = unique >= config["auto_inference"]["near_unique"]
    by_name = X.matches_any(F.col("column"), config["roles"]["id_patterns"]) & (unique >= config["roles"]["high_uniqueness"])
    return (stats.where((F.col("non_missing") > 0) & F.col("key_like") & (near | by_name)
                        & ~_named(F.col("column"), metadata["id_fields"]))
            .select("ordinal", "column"))


def exclude_declared(stats: DataFrame, excluded: DataFrame) -> DataFrame:
    """Columns that are no identifier, target or direct identifier, compared by normalised name."""
    taken = excluded.select(X.normalize(F.col("column")).alias("taken")).distinct()
    return stats.join(F.broadcast(taken), X.normalize(F.col("column")) == F.col("taken"), "left_anti")


def quasi_identifiers(stats: DataFrame, excluded: DataFrame, metadata: dict, config: dict, cap: bool = True) -> DataFrame:
    a, r = config["auto_inference"], config["roles"]
    free = exclude_declared(stats, excluded).where(
        (F.col("non_missing") > 0) & ~_named(F.col("column"), metadata["quasi_identifiers"]))
    unique = X.safe_div(F.col("distinct_count"), F.greatest(F.col("n_rows"), F.lit(1)))
    by_name = X.matches_any(F.col("column"), a["quasi_identifier_patterns"])
    spread = ((F.col("distinct_count") >= a["cardinality_min"]) & (unique <= a["cardinality_max_ratio"])
              & ~X.matches_any(F.col("column"), r["text_patterns"]))
    found = free.where(by_name | spread).select("ordinal", "column", by_name.alias("by_name"))
    return cap_quasi_identifiers(found, a["max_quasi_identifiers"]) if cap else found


def cap_quasi_identifiers(found: DataFrame, keep: int) -> DataFrame:
    """At most ``keep`` columns, name matches first; within the cap the column order stays.

    The window runs over one row per column of the dataset.
    """
    order = Window.orderBy(F.desc("by_name"), "ordinal")
    total = F.count(F.lit(1)).over(Window.partitionBy())
    ranked = found.select("*", F.row_number().over(order).alias("choice"), total.alias("total"))
    position = F.when(F.col("total") > keep, F.col("choice")).otherwise(F.col("ordinal"))
    return ranked.where(F.col("choice") <= keep).select("ordinal", "column", "by_name", position.cast("long").alias("position"))


AUTO_KEYS = ["id_fields", "target_fields", "direct_identifiers", "quasi_identifiers"]


def auto_metadata(stats: DataFrame, metadata: dict, config: dict) -> DataFrame:
    """(kind, position, column) of everything detected from the data alone."""
    spark = stats.sparkSession
    if not config["auto_inference"]["enabled"]:
        return spark.createDataFrame([], "kind string, position long, column string")
    found = {"id_fields": id_fields, "target_fields": target_fields, "direct_identifiers": direct_identifiers}
    parts = [f(stats, metadata, config).select(F.lit(k).alias("kind"), F.col("ordinal").cast("long").alias("position"), "column")
             for k, f in found.items()]
    stated = [(c,) for k in found for c in metadata[k]]
    excluded = reduce(DataFrame.unionByName, [p.select("column") for p in parts],
                      spark.createDataFrame(stated, "column string"))
    quasi = quasi_identifiers(stats, excluded, metadata, config).select(F.lit("quasi_identifiers").alias("kind"), "position", "column")
    return reduce(DataFrame.unionByName, parts + [quasi])


def merge_lists(user: Column, auto: Column) -> Column:
    """User entries first, then detected ones the user did not name."""
    return F.concat(user, F.array_except(auto, user))


def apply_auto_metadata(ds: Dataset, stats: DataFrame) -> Dataset:
    """The dataset with detected fields merged under the user's."""
    found: dict[str, list[str]] = {k: [] for k in AUTO_KEYS}
    for row in auto_metadata(stats, ds.metadata, ds.config).orderBy("kind", "position").collect():
        found[row["kind"]].append(row["column"])
    merged = {k: list(ds.metadata[k]) + [c for c in found[k] if c not in ds.metadata[k]] for k in AUTO_KEYS}
    return replace(ds, metadata={**ds.metadata, **merged}, auto=found)


# --- profiles and check selection --------------------------------------------------------------

def semantic_profile(stats: DataFrame, metadata: dict, config: dict, evidence: DataFrame | None = None) -> DataFrame:
    return (base_profile(stats).join(final_role(stats, metadata, config, evidence), "column")
            .join(role_provenance(stats, metadata, config, evidence), "column"))


def uniform_profile(stats: DataFrame, config: dict) -> DataFrame:
    return base_profile(stats).join(uniform_type(stats, config), "column")


def compare_profiles(semantic: DataFrame, uniform: DataFrame) -> DataFrame:
    def side(df, suffix):
        return df.select("column", *[F.col(c).alias(f"{c}_{suffix}") for c in ("role", "role_confidence", "notes")])
    changed = F.col("role_semantic") != F.col("role_uniform")
    return (side(semantic, "semantic").join(F.broadcast(side(uniform, "uniform")), "column")
            .withColumn("role_changed_by_semantic_layer", changed)
            .withColumn("interpretation", F.when(changed, "Semantic layer changes how checks are selected or interpreted.")
                        .otherwise("Uniform and semantic layers agree.")))


def check_selection(profile: DataFrame, metadata: dict, config: dict) -> DataFrame:
    """Which checks each column's role selects, against what a plain numeric rule would do."""
    col, role = F.col("column"), F.col("role")

    def exact(names):
        return col.isin(list(names)) if names else F.lit(False)

    semantic = role.isin(ANOMALY_ROLES)
    uniform = F.col("non_missing_numeric_rate") >= 0.98
    return profile.select(
        col, role.alias("semantic_role"), "role_confidence",
        F.lit(True).alias("completeness_missing_check"),
        _named(col, metadata["required_fields"]).alias("completeness_required_field"),
        _named(col, metadata["critical_fields"]).alias("completeness_critical_field"),
        (role == "identifier").alias("accuracy_identifier_uniqueness"),
        (role.contains("numeric") | role.contains("measurement")).alias("accuracy_type_consistency"),
        exact(metadata["valid_ranges"]).alias("accuracy_domain_range"),
        exact(metadata["allowed_values"]).alias("accuracy_allowed_values"),
        semantic.alias("accuracy_anomaly_detection_semantic"), uniform.alias("accuracy_anomaly_detection_uniform"),
        (semantic != uniform).alias("anomaly_selection_differs"),
        _named(col, metadata["quasi_identifiers"]).alias("reuse_quasi_identifier"),
        _named(col, metadata["direct_identifiers"]).alias("reuse_direct_identifier"),
        (F.col("role_confidence") < config["roles"]["low_confidence"]).alias("flag_low_confidence_for_hitl"))


def routed_columns(profile: DataFrame, stats: DataFrame) -> DataFrame:
    """(policy, ordinal, column): numeric columns by data type, by rule role and by final role."""
    uniform = (stats.where((F.col("non_missing") > 0) & (F.col("strict_count") >= 0.98 * F.col("non_missing")))
               .select(F.lit("uniform_dtype_routing").alias("policy"), "ordinal", "column"))
    rules = (profile.where(F.col("semantic_role_rule_based").isin(ANOMALY_ROLES))
             .select(F.lit("rule_based_semantic_routing").alias("policy"), "ordinal", "column"))
    final = (profile.where(F.col("role").isin(ANOMALY_ROLES))
             .select(F.lit("transformer_augmented_routing").alias("policy"), "ordinal", "column"))
    return uniform.unionByName(rules).unionByName(final)


def routing(profile: DataFrame, stats: DataFrame) -> dict[str, list[str]]:
    policies = {"uniform_dtype_routing": [], "rule_based_semantic_routing": [], "transformer_augmented_routing": []}
    for row in routed_columns(profile, stats).orderBy("policy", "ordinal").collect():
        policies[row["policy"]].append(row["column"])
    return policies
