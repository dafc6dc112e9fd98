"""Accuracy without detectors: structure, domain rules, cross-field rules and category spellings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from tabsift.config import CATEGORY_ROLES
from tabsift.dataset import Dataset
from tabsift.functions import exprs as X
from tabsift.operators.frequency import unpivot_text
from tabsift.operators.missing import unusable

ISSUE = ("dimension string, method string, issue_type string, column string, count long, severity string, "
         "hitl_decision string, rule string")
ISSUE_COLUMNS = ["dimension", "method", "issue_type", "column", "count", "severity", "hitl_decision", "rule"]


def issue_columns(dimension: str, method: str, issue_type: Column, column: Column, count: Column, severity: Column,
                  decision: str, rule: Column) -> list[Column]:
    """The eight fields of an issue record."""
    return [F.lit(dimension).alias("dimension"), F.lit(method).alias("method"), issue_type.alias("issue_type"),
            column.cast("string").alias("column"), count.cast("long").alias("count"), severity.alias("severity"),
            F.lit(decision).alias("hitl_decision"), rule.alias("rule")]


def empty_issues(spark) -> DataFrame:
    return spark.createDataFrame([], ISSUE)


def union_issues(parts: list[DataFrame]) -> DataFrame:
    """Bag union; a table that lacks a field contributes NULL there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


# --- structure -----------------------------------------------------------------------------------

def present_non_numeric(ds: Dataset, columns: list[str], sentinels: dict[str, list[str]]) -> DataFrame:
    """Per column, present values that are neither codes nor markers and still are no numbers."""
    counts = ds.df.agg(*[F.count_if(F.col(f"`{c}`").isNotNull() & ~unusable(ds, c, sentinels) & ds.loose_number(c).isNull())
                         .alias(f"n{i}") for i, c in enumerate(columns)])
    rows = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"n{i}").alias("non_numeric")) for i, c in enumerate(columns)])
    return counts.select(F.inline(rows))


def duplicate_rows(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows minus distinct rows. Copies collapse in the map-side aggregation, so a hot row is cheap."""
    copies = df.groupBy(*[F.col(f"`{c}`") for c in columns]).agg(F.count(F.lit(1)).alias("copies"))
    return copies.agg(F.coalesce(F.sum("copies"), F.lit(0)).alias("n_rows"), F.count(F.lit(1)).alias("distinct_rows"),
                      F.coalesce(F.sum(F.col("copies") - 1), F.lit(0)).alias("duplicate_rows"))


def identifier_duplicates(stats: DataFrame, profile: DataFrame) -> DataFrame:
    ids = profile.where(F.col("role") == "identifier").select("column")
    return (stats.join(F.broadcast(ids), "column", "left_semi")
            .select("column", (F.col("non_missing") - F.col("distinct_count")).alias("duplicates")))


def structural_issues(ds: Dataset, stats: DataFrame, profile: DataFrame) -> DataFrame:
    """Issues read from the per-column statistics; only the duplicate rows need the rows themselves."""
    role = F.col("role")
    facts = stats.select("column", "non_missing", "distinct_count", "usable_count", "loose_count").join(profile, "column")
    repeats = (facts.where(role == "identifier").withColumn("count", F.col("non_missing") - F.col("distinct_count"))
               .where("count > 0").select(*issue_columns("A", "structural", F.lit("identifier_duplicate"), F.col("column"),
                                                         F.col("count"), F.lit("high"), "review", F.lit(""))))
    words = (facts.where(role.contains("numeric") | role.contains("measurement"))
             .withColumn("count", F.col("usable_count") - F.col("loose_count")).where("count > 0")
             .select(*issue_columns("A", "structural", F.lit("non_numeric_observed_value"), F.col("column"),
                                    F.col("count"), F.lit("high"), "review", F.lit(""))))
    disagree = F.col("semantic_role_disagreement")
    rule = F.format_string("rule=%s; embedding=%s; final=%s; confidence=%.3f", "semantic_role_rule_based",
                           "semantic_role_embedding", "semantic_role_final", "role_confidence")
    review = profile.where("requires_semantic_review").select(*issue_columns(
        "A", "semantic_role_provenance", F.when(disagree, "semantic_role_disagreement").otherwise("low_semantic_role_confidence"),
        F.col("column"), F.lit(1), F.when(disagree, "medium").otherwise("low"), "schema_confirmation", rule))
    copies = (duplicate_rows(ds.df, ds.columns).where("duplicate_rows > 0")
              .select(*issue_columns("A", "structural", F.lit("duplicate_rows"), F.lit(None), F.col("duplicate_rows"),
                                     F.lit("high"), "review", F.lit(""))))
    return union_issues([repeats, words, review, copies])


def structural_score(issues: DataFrame, cells: int) -> DataFrame:
    burden = F.coalesce(F.sum("count"), F.lit(0))
    return issues.agg(X.clip01(1 - X.safe_div(burden, F.lit(cells))).alias("score"))


# --- domain rules --------------------------------------------------------------------------------

def domain_counts(ds: Dataset, kinds: tuple[str, ...] = ("allowed", "range")) -> DataFrame:
    """(ordinal, column, kind, checks, violations, rule) for every declared rule, in one scan."""
    allowed, ranges = ds.metadata["allowed_values"] or {}, ds.metadata["valid_ranges"] or {}
    sums, rows = [], []
    for i, c in enumerate(ds.columns):
        if c in allowed and "allowed" in kinds:
            values = allowed[c] if isinstance(allowed[c], list) else [allowed[c]]
            known = sorted({str(v).strip().lower() for v in values})
            present = F.col(f"`{c}`").isNotNull()
            bad = present & ~X.normalize(ds.text(c)).isin(known)
            sums += [F.count_if(present).alias(f"ac{i}"), F.count_if(bad).alias(f"av{i}")]
            rows.append((i, c, "allowed", f"ac{i}", f"av{i}", "metadata allowed_values"))
        if c in ranges and "range" in kinds:
            low, high = ranges[c]
            x = ds.strict_number(c)
            sums += [F.count(x).alias(f"rc{i}"), F.count_if((x < F.lit(low)) | (x > F.lit(high))).alias(f"rv{i}")]
            rows.append((i, c, "range", f"rc{i}", f"rv{i}", f"metadata valid_ranges: [{low}, {high}]"))
    if not rows:
        return ds.df.sparkSession.createDataFrame(
            [], "ordinal int, column string, kind string, checks long, violations long, rule string")
    table = F.array(*[F.struct(F.lit(i).alias("ordinal"), F.lit(c).alias("column"), F.lit(k).alias("kind"),
                               F.col(a).alias("checks"), F.col(b).alias("violations"), F.lit(r).alias("rule"))
                      for i, c, k, a, b, r in rows])
    return ds.df.agg(*sums).select(F.inline(table))


def domain_features(counts: DataFrame) -> DataFrame:
    return (counts.groupBy("column").agg(F.sum("checks").alias("domain_checks"), F.sum("violations").alias("domain_violations"))
            .where("domain_checks > 0")
            .withColumn("domain_score", X.clip01(1 - X.safe_div(F.col("domain_violations"), F.col("domain_checks")))))


def domain_score(features: DataFrame) -> DataFrame:
    """The unweighted mean over columns; 1 without any rule."""
    return features.agg(X.clip01(F.coalesce(F.avg("domain_score"), F.lit(1.0))).alias("score"))


def domain_issues(counts: DataFrame) -> DataFrame:
    kind = F.when(F.col("kind") == "allowed", "allowed_value_violation").otherwise("range_violation")
    return counts.where("violations > 0").select(*issue_columns("A", "domain", kind, F.col("column"), F.col("violations"),
                                                                F.lit("high"), "review", F.col("rule")))


# --- cross-field rules ---------------------------------------------------------------------------

def rule_counts(ds: Dataset) -> DataFrame:
    """(position, issue_type, column, severity, checks, violations); rules on unknown columns drop out."""
    sums, rows = [], []

    def add(position, issue_type, label, severity, valid, bad):
        sums.extend([F.count_if(valid).alias(f"c{position}"), F.count_if(valid & bad).alias(f"v{position}")])
        rows.append((position, issue_type, label, severity))

    for position, rule in enumerate(ds.metadata["consistency_rules"] or []):
        kind = rule.get("type")
        if kind == "not_greater_than" and rule.get("left") in ds.columns and rule.get("right") in ds.columns:
            a, b = ds.strict_number(rule["left"]), ds.strict_number(rule["right"])
            add(position, "left_greater_than_right", f"{rule['left']}>{rule['right']}", "high",
                a.isNotNull() & b.isNotNull(), a > b)
        elif kind == "non_negative" and rule.get("field") in ds.columns:
            x = ds.strict_number(rule["field"])
            add(position, "negative_value", rule["field"], "medium", x.isNotNull(), x < 0)
        elif (kind == "sum_equals" and rule.get("fields") and rule.get("total") in ds.columns
              and all(f in ds.columns for f in rule["fields"])):
            parts = reduce(lambda a, b: a + b, [ds.strict_number(f) for f in rule["fields"]])
            total = ds.strict_number(rule["total"])
            add(position, "sum_mismatch", rule["total"], "medium", parts.isNotNull() & total.isNotNull(),
                F.abs(parts - total) > F.lit(float(rule.get("tolerance", 1e-6))))
    if not rows:
        return ds.df.sparkSession.createDataFrame(
            [], "position int, issue_type string, column string, severity string, checks long, violations long")
    table = F.array(*[F.struct(F.lit(p).alias("position"), F.lit(t).alias("issue_type"), F.lit(c).alias("column"),
                               F.lit(s).alias("severity"), F.col(f"c{p}").alias("checks"), F.col(f"v{p}").alias("violations"))
                      for p, t, c, s in rows])
    return ds.df.agg(*sums).select(F.inline(table))


def consistency_score(counts: DataFrame) -> DataFrame:
    """Pooled over all rules; 1 without any check."""
    checks = F.coalesce(F.sum("checks"), F.lit(0))
    return counts.agg(F.when(checks > 0, X.clip01(1 - X.safe_div(F.sum("violations"), checks))).otherwise(1.0).alias("score"))


def consistency_issues(counts: DataFrame) -> DataFrame:
    return counts.where("violations > 0").select(*issue_columns(
        "A", "inconsistency", F.col("issue_type"), F.col("column"), F.col("violations"), F.col("severity"), "review",
        F.lit("metadata consistency_rules")))


# --- category spellings --------------------------------------------------------------------------

def category_variants(ds: Dataset, columns: list[str], limit: int | None = None) -> DataFrame:
    """Per checked column: spellings that share a canonical form, and up to three such groups as text.

    The distinct count is taken first, so surface forms are only gathered for columns that hold at most
    ``limit`` of them.
    """
    limit = limit or max(ds.config["roles"]["low_cardinality"], 50)
    if not columns:
        return ds.df.sparkSession.createDataFrame([], "column string, n_variants long, example string")
    surface = (unpivot_text(ds, columns).where(F.col("value").isNotNull())
               .select("column", X.strip(F.col("value")).alias("surface")).distinct())
    checked = surface.groupBy("column").agg(F.count(F.lit(1)).alias("forms")).where(F.col("forms") <= limit)
    groups = (surface.join(F.broadcast(checked.select("column")), "column", "left_semi")
              .groupBy("column", X.canonical_category(F.col("surface")).alias("canon"))
              .agg(F.array_sort(F.collect_list("surface")).alias("forms"))
              .withColumn("split", F.size("forms") > 1))
    collapsing = F.array_sort(F.collect_list(F.when(F.col("split"), F.struct("canon", "forms"))))
    example = F.concat_ws("; ", F.transform(F.slice(collapsing, 1, 3), lambda g: F.concat_ws(" / ", g["forms"])))
    return groups.groupBy("column").agg(F.sum(F.when(F.col("split"), F.size("forms")).otherwise(0)).cast("long").alias("n_variants"),
                                        example.alias("example"))


def category_score(variants: DataFrame) -> DataFrame:
    return variants.agg(F.when(F.count(F.lit(1)) > 0, X.clip01(1 - X.safe_div(F.count_if(F.col("n_variants") > 0), F.count(F.lit(1)))))
                        .otherwise(1.0).alias("score"))


def category_issues(variants: DataFrame) -> DataFrame:
    return variants.where("n_variants > 0").select(*issue_columns(
        "A", "inconsistency", F.lit("inconsistent_category_encoding"), F.col("column"), F.col("n_variants"), F.lit("medium"),
        "review", F.concat(F.lit("variants collapse to same category: "), F.col("example"))))


def category_columns(profile: DataFrame) -> list[str]:
    return [r["column"] for r in profile.where(F.col("role").isin(CATEGORY_ROLES)).select("column").collect()]
