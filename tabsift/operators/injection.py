"""Controlled errors with known truth, and how well the detectors find them."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, functions as F

from tabsift.dataset import Dataset, at_once, cut_lineage
from tabsift.functions import exprs as X
from tabsift.operators.anomaly import Detection, detections, flagged
from tabsift.operators.missing import sentinel_map
from tabsift.operators.quantiles import exact_quantiles
from tabsift.operators.ranking import global_position, seeded_key

POLICIES = [("uniform_dtype_routing", "technical data type"),
            ("rule_based_semantic_routing", "lexical and distributional rules"),
            ("transformer_augmented_routing", "rules plus sentence-transformer")]
CONTRASTS = [("uniform_to_rule", "uniform_dtype_routing", "rule_based_semantic_routing", False),
             ("rule_to_transformer", "rule_based_semantic_routing", "transformer_augmented_routing", True),
             ("uniform_to_transformer", "uniform_dtype_routing", "transformer_augmented_routing", False)]


def eligible_columns(ds: Dataset, measures: list) -> list[str]:
    """Numeric by data type and no target."""
    targets = {t.strip().lower() for t in ds.metadata["target_fields"]}
    return [m["column"] for m in sorted(measures, key=lambda m: m["ordinal"])
            if m["column"].strip().lower() not in targets and m["non_missing"]
            and m["strict_count"] / m["non_missing"] >= 0.98]


def injection_plan(ds: Dataset, columns: list[str], n_rows: int, rate: float) -> DataFrame:
    """(row_id, position, column, error_type): seeded rows without replacement, columns and types in turn."""
    kinds = ds.config["injection"]["error_types"]
    n = min(n_rows, max(1, int(n_rows * rate)))
    keyed = ds.df.select(F.col(f"`{ds.row_id}`").alias("row_id"), seeded_key(F.col(f"`{ds.row_id}`"), ds.config["random_seed"]).alias("key"))
    chosen = global_position(keyed, "key", n)

    def turn(names):
        return F.element_at(F.array(*[F.lit(x) for x in names]), (F.col("position") % len(names) + 1).cast("int"))

    return chosen.select("row_id", "position", turn(columns).alias("column"), turn(kinds).alias("error_type"))


def inject_errors(ds: Dataset, columns: list[str], n_rows: int, rate: float) -> tuple[Dataset, DataFrame]:
    """The corrupted dataset and its truth (row_id, column, error_type).

    The plan is a small share of the rows, joined on the row key; the join side is left to the runtime
    size statistics.
    """
    if not columns or not n_rows:
        return ds, ds.df.select(F.col(f"`{ds.row_id}`").alias("row_id"), F.lit("").alias("column"), F.lit("").alias("error_type")).limit(0)
    plan = cut_lineage(injection_plan(ds, columns, n_rows, rate))
    numbers = cut_lineage(ds.df.select(*[ds.strict_number(c).alias(c) for c in columns]))
    tails = exact_quantiles(numbers, {c: F.col(f"`{c}`") for c in columns}, [0.99])
    kind = F.col("_error")

    def corrupted(c):
        if c not in columns:
            return F.col(f"`{c}`")
        x = ds.strict_number(c)
        high = tails[c][0] * 10 if tails[c][0] is not None else 9999.0
        return (F.when(F.coalesce(F.col("_column") != c, F.lit(True)), x).when(kind == "numeric_sentinel", -999.0)
                .when(kind == "high_outlier", float(high))).alias(c)

    marked = ds.df.join(plan.select(F.col("row_id").alias(ds.row_id), F.col("column").alias("_column"), F.col("error_type").alias("_error")),
                        ds.row_id, "left")
    rows = marked.select(F.col(f"`{ds.row_id}`"), *[corrupted(c) for c in ds.columns])
    return ds.with_df(cut_lineage(rows)), plan.select("row_id", "column", "error_type")


def newly_flagged(before: DataFrame, after: DataFrame) -> DataFrame:
    """(row_id, predicted): flagged afterwards and not before, aligned on the row key."""
    old = before.select("row_id", F.col("ensemble_flag").alias("was"))
    return after.select("row_id", "ensemble_flag").join(old, "row_id").select("row_id", (F.col("ensemble_flag") & ~F.col("was")).alias("predicted"))


def confusion_metrics(predictions: DataFrame) -> DataFrame:
    """Binary precision, recall and F1 over (truth, predicted); empty denominators give 0."""
    hit = F.count_if(F.col("truth") & F.col("predicted"))
    predicted, truth = F.count_if(F.col("predicted")), F.count_if(F.col("truth"))
    return (predictions.agg(hit.alias("tp"), predicted.alias("newly_flagged_rows"), truth.alias("injected_error_rows"))
            .withColumn("precision", X.safe_div(F.col("tp"), F.col("newly_flagged_rows")))
            .withColumn("recall", X.safe_div(F.col("tp"), F.col("injected_error_rows")))
            .withColumn("f1", X.safe_div(2 * F.col("tp"), F.col("newly_flagged_rows") + F.col("injected_error_rows")))
            .drop("tp"))


def evaluate(before: Detection, after: Detection, truth: DataFrame) -> dict:
    """Metrics of the change in flags; no detection on either side predicts nothing."""
    if before.flags is None or after.flags is None:
        return {"precision": 0.0, "recall": 0.0, "f1": 0.0, "newly_flagged_rows": 0,
                "injected_error_rows": truth.count(), "pre_existing_flagged_rows": 0}
    predictions = (newly_flagged(before.flags, after.flags)
                   .join(truth.select("row_id", F.lit(True).alias("truth")), "row_id", "left")
                   .select(F.coalesce("truth", F.lit(False)).alias("truth"), "predicted"))
    return {**confusion_metrics(predictions).first().asDict(), "pre_existing_flagged_rows": flagged(before)}


METRICS = ("method string, injection_rate double, precision double, recall double, f1 double, newly_flagged_rows long, "
           "injected_error_rows long, pre_existing_flagged_rows long")


def controlled_error_baseline(ds: Dataset, profile, n_rows: int, baseline: dict[str, Detection]) -> DataFrame:
    """Profiles are inferred again on the corrupted data, so routing may change with the errors.

    ``profile(ds)`` answers (measures, sentinels, policies) of a dataset.
    """
    spark, rates = ds.df.sparkSession, ds.config["injection"]["rates"]
    if not ds.config["injection"]["enabled"] or not rates:
        return spark.createDataFrame([], METRICS)
    measures, _, _ = profile(ds)
    columns = eligible_columns(ds, measures)
    methods = (("generic_anomaly_delta", "uniform_dtype_routing", False), ("semantic_hitl_anomaly_delta", "transformer_augmented_routing", True))

    def at_rate(rate: float) -> list[tuple]:
        broken, truth = inject_errors(ds, columns, n_rows, rate)
        _, sentinels, policies = profile(broken)

        found = detections(broken, [(policies[policy], proposed) for _, policy, proposed in methods], sentinels, n_rows)

        def of(method: str, proposed: bool, after: Detection) -> tuple:
            m = evaluate(baseline["generic" if not proposed else "semantic"], after, truth)
            return (method, float(rate), m["precision"], m["recall"], m["f1"], m["newly_flagged_rows"], m["injected_error_rows"], m["pre_existing_flagged_rows"])

        return at_once([partial(of, method, proposed, after) for (method, _, proposed), after in zip(methods, found)])

    return spark.createDataFrame([row for rows in at_once([partial(at_rate, rate) for rate in rates]) for row in rows], METRICS)


def locked_parameters(config: dict) -> dict:
    a = config["anomaly"]
    return {"iqr_multiplier": a["proposed"]["iqr_multiplier"], "modified_z_threshold": a["proposed"]["z_threshold"],
            "ensemble_min_methods": a["ensemble"]["min_methods"], "ensemble_require_ml_method": a["ensemble"]["require_ml_method"],
            "parameter_lock": "semantic_hitl_fixed_v1"}


LOCK = ("iqr_multiplier double, modified_z_threshold double, ensemble_min_methods int, ensemble_require_ml_method boolean, "
        "parameter_lock string")


def ablation_detections(ds: Dataset, policies: dict[str, list[str]], sentinels, n_rows: int) -> dict[str, Detection]:
    """One detection per policy, all with the strict ensemble; equal column sets are computed once."""
    keys = list(dict.fromkeys(tuple(policies[policy]) for policy, _ in POLICIES))
    done = dict(zip(keys, detections(ds, [(list(key), True) for key in keys], sentinels, n_rows)))
    return {policy: done[tuple(policies[policy])] for policy, _ in POLICIES}


def ablation_burden(ds: Dataset, detections: dict[str, Detection]) -> DataFrame:
    lock, counts, rows = tuple(locked_parameters(ds.config).values()), {}, []
    for policy, evidence in POLICIES:
        d = detections[policy]
        hit = counts.setdefault(id(d), flagged(d) if id(d) not in counts else counts[id(d)])
        rows.append((policy, evidence, len(d.columns), ",".join(d.columns), hit, hit / d.n_rows if d.n_rows else 0.0, *lock))
    return ds.df.sparkSession.createDataFrame(
        rows, f"policy string, role_evidence string, n_columns long, columns string, flagged_rows long, flagged_rate double, {LOCK}")


def ablation_errors(ds: Dataset, detections: dict[str, Detection], measures: list, sentinels) -> DataFrame:
    """Injected errors with each policy's columns held fixed."""
    lock = tuple(locked_parameters(ds.config).values())
    n_rows = detections[POLICIES[0][0]].n_rows
    columns = eligible_columns(ds, measures)

    def at_rate(rate: float) -> list[tuple]:
        broken, truth = inject_errors(ds, columns, n_rows, rate)
        codes = sentinel_map(broken)
        after = ablation_detections(broken, {p: detections[p].columns for p, _ in POLICIES}, codes, n_rows)
        pairs = {(id(detections[p]), id(after[p])): (detections[p], after[p]) for p, _ in POLICIES}
        metrics = dict(zip(pairs, at_once([partial(evaluate, *pair, truth) for pair in pairs.values()])))
        found = [(policy, evidence, metrics[id(detections[policy]), id(after[policy])]) for policy, evidence in POLICIES]
        return [(policy, evidence, float(rate), len(detections[policy].columns), m["injected_error_rows"], m["newly_flagged_rows"],
                 m["pre_existing_flagged_rows"], m["precision"], m["recall"], m["f1"], *lock) for policy, evidence, m in found]

    rows = [row for found in at_once([partial(at_rate, rate) for rate in ds.config["injection"]["rates"]]) for row in found]
    return ds.df.sparkSession.createDataFrame(
        rows, "policy string, role_evidence string, injection_rate double, n_columns long, injected_error_rows long, "
              f"newly_flagged_rows long, pre_existing_flagged_rows long, precision double, recall double, f1 double, {LOCK}")


def ablation_contrasts(burden: DataFrame) -> DataFrame:
    """Three named differences between policies, by self-join of the burden table."""
    pairs = burden.sparkSession.createDataFrame(
        CONTRASTS, "contrast string, reference_policy string, comparison_policy string, isolates_transformer_routing_effect boolean")
    measures = ["n_columns", "flagged_rows", "flagged_rate"]
    reference = burden.select(F.col("policy").alias("reference_policy"), *[F.col(m).alias(f"r_{m}") for m in measures])
    other = burden.select(F.col("policy").alias("comparison_policy"), "parameter_lock", *[F.col(m).alias(f"o_{m}") for m in measures])
    return (pairs.join(reference, "reference_policy").join(other, "comparison_policy")
            .select("contrast", "reference_policy", "comparison_policy", "isolates_transformer_routing_effect",
                    (F.col("o_n_columns") - F.col("r_n_columns")).alias("column_count_delta"),
                    (F.col("o_flagged_rows") - F.col("r_flagged_rows")).alias("flagged_rows_delta"),
                    (F.col("o_flagged_rate") - F.col("r_flagged_rate")).alias("flagged_rate_delta"), "parameter_lock"))
