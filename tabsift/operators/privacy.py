"""k-anonymity over quasi-identifiers and the privacy facet."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tabsift.dataset import Dataset
from tabsift.functions import exprs as X
from tabsift.operators.accuracy import empty_issues, issue_columns, union_issues

K = "assessable boolean, n_rows long, n_classes long, min_equivalence_class long, at_risk_fraction double, k_score double"


def class_sizes(df: DataFrame, quasi: list[str]) -> DataFrame:
    """Equivalence classes with their size; NULL is a value of its own."""
    return df.groupBy(*[F.col(f"`{c}`") for c in quasi]).agg(F.count(F.lit(1)).alias("class_size"))


def k_anonymity(df: DataFrame, quasi: list[str], config: dict) -> DataFrame:
    """Smallest class, share of records in classes below k, and the score; always one row.

    Class sizes are enough for all three, so rows are never joined back.
    """
    used = [c for c in quasi if c in df.columns]
    rule = config["reuse"]["privacy"]
    if not used:
        return df.sparkSession.createDataFrame([(False, None, None, None, None, 0.0)], K)
    size = F.col("class_size")
    rows = F.coalesce(F.sum(size), F.lit(0))
    risky = F.coalesce(F.sum(F.when(size < rule["k_min"], size).otherwise(0)), F.lit(0))
    totals = class_sizes(df, used).agg(rows.alias("n_rows"), F.count(F.lit(1)).alias("n_classes"),
                                       F.min(size).alias("min_equivalence_class"), risky.alias("risky"))
    share = F.when(F.col("n_rows") > 0, F.col("risky") / F.when(F.col("n_rows") > 0, F.col("n_rows")))
    score = X.clip01(1 - F.least(share, F.lit(rule["risk_cap"])) / F.lit(rule["risk_cap"]))
    return totals.select((F.col("n_rows") > 0).alias("assessable"), "n_rows", "n_classes", "min_equivalence_class",
                         share.alias("at_risk_fraction"), F.when(F.col("n_rows") > 0, score).otherwise(0.0).alias("k_score"))


def class_size_per_record(df: DataFrame, key: str, quasi: list[str]) -> DataFrame:
    """Each record with the size of its class.

    A window would put a whole class into one task; this joins the aggregated classes back, so the runtime
    can broadcast them when they are small and split a skewed class when they are not.
    """
    sizes = class_sizes(df, quasi).withColumnsRenamed({c: f"_{c}" for c in quasi})
    match = [F.col(f"`{c}`").eqNullSafe(F.col(f"_{c}")) for c in quasi]
    return df.join(sizes, match).select(key, *quasi, "class_size")


def privacy_score_flag(metadata: dict, documentation: Column) -> Column:
    """Explicit flag, else whether the documentation (or a privacy field) mentions privacy."""
    flags = metadata.get("reuse_readiness") or {}
    if "privacy_documentation" in flags:
        return X.score_value(F.lit(str(flags["privacy_documentation"])))
    if metadata.get("privacy"):
        return F.lit(1.0)
    return F.when(F.contains(F.lower(documentation), F.lit("privacy")), 1.0).otherwise(0.0)


def privacy_components(ds: Dataset, documentation: DataFrame) -> DataFrame:
    """(component, score, weight, weighted_score); ``documentation`` is one row with a ``text`` column."""
    weights = ds.config["reuse"]["privacy"]["weights"]
    direct = [c for c in ds.metadata["direct_identifiers"] if c in ds.columns]
    k = k_anonymity(ds.df, ds.metadata["quasi_identifiers"], ds.config)
    flag = documentation.select(privacy_score_flag(ds.metadata, F.col("text")).alias("score"))
    parts = [("direct_identifier_handling", k.select(F.lit(0.0 if direct else 1.0).alias("score"))),
             ("k_anonymity", k.select(F.col("k_score").alias("score"))), ("privacy_documentation", flag)]
    rows = [df.select(F.lit(name).alias("component"), "score", F.lit(weights[name]).alias("weight")) for name, df in parts]
    return rows[0].unionByName(rows[1]).unionByName(rows[2]).withColumn("weighted_score", F.col("score") * F.col("weight"))


def privacy_issues(ds: Dataset, documentation: DataFrame) -> DataFrame:
    spark = ds.df.sparkSession
    direct = [c for c in ds.metadata["direct_identifiers"] if c in ds.columns]
    quasi = [c for c in ds.metadata["quasi_identifiers"] if c in ds.columns]
    k = k_anonymity(ds.df, quasi, ds.config)
    parts = [empty_issues(spark)]
    if direct:
        source = "auto-detected" if set(direct) & set(ds.auto.get("direct_identifiers", [])) else "metadata"
        parts.append(k.select(*issue_columns("R", "privacy", F.lit("direct_identifier_present"), F.lit(",".join(direct)), F.lit(len(direct)),
                                             F.lit("high"), "review", F.lit(f"{source} direct identifiers"))))
    parts.append(k.where(~F.col("assessable")).select(*issue_columns(
        "R", "privacy", F.lit("no_quasi_identifiers_found"), F.lit(None), F.lit(1), F.lit("low"), "documentation",
        F.lit("no demographic/quasi-identifier columns detected"))))
    source = "auto-detected" if set(quasi) & set(ds.auto.get("quasi_identifiers", [])) else "declared"
    parts.append(k.where("assessable and at_risk_fraction > 0").select(*issue_columns(
        "R", "privacy", F.lit("low_k_anonymity_records"), F.lit(",".join(quasi)), F.round(F.col("at_risk_fraction") * F.col("n_rows")),
        F.lit("high"), "review", F.lit(f"{source} QIs; records below k={ds.config['reuse']['privacy']['k_min']}"))))
    flag = documentation.select(privacy_score_flag(ds.metadata, F.col("text")).alias("score"))
    parts.append(flag.where("score < 1").select(*issue_columns(
        "R", "privacy", F.lit("privacy_documentation_gap"), F.lit(None), F.lit(1), F.lit("medium"), "documentation",
        F.lit("privacy_documentation"))))
    return union_issues(parts)
