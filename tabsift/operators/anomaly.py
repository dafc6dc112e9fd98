"""Distributional detectors on routed numeric columns, their ensemble and the reports around them."""

from __future__ import annotations

from dataclasses import dataclass
from functools import partial, reduce

from pyspark.sql import Column, DataFrame, functions as F

from tabsift.dataset import Dataset, at_once, cut_lineage, steps_of
from tabsift.functions import exprs as X
from tabsift.operators import forest, neighbours
from tabsift.operators.accuracy import ISSUE, issue_columns
from tabsift.operators.missing import usable_number
from tabsift.operators.quantiles import exact_quantiles


def anomaly_matrix(ds: Dataset, columns: list[str], sentinels: dict[str, list[str]]) -> DataFrame:
    """Row key plus the routed columns as numbers, codes and markers as NULL."""
    return ds.df.select(F.col(f"`{ds.row_id}`").alias("row_id"), *[usable_number(ds, c, sentinels).alias(c) for c in columns])


def stored_matrix(ds: Dataset, columns: list[str], sentinels: dict[str, list[str]]) -> DataFrame:
    """The matrix parsed once and kept on shared storage: quantiles, moments and flags scan it many times."""
    return cut_lineage(anomaly_matrix(ds, columns, sentinels))


def quantile_table(matrix: DataFrame, columns: list[str]) -> dict[str, dict[str, float | None]]:
    """q1, median, q3, q99 and median absolute deviation per column, exact, NULL ignored."""
    quartiles = exact_quantiles(matrix, {c: F.col(f"`{c}`") for c in columns}, [0.25, 0.5, 0.75, 0.99])
    known = [c for c in columns if quartiles[c][1] is not None]
    mads = exact_quantiles(matrix, {c: F.abs(F.col(f"`{c}`") - F.lit(quartiles[c][1])) for c in known}, [0.5])
    return {c: {"q1": q[0], "median": q[1], "q3": q[2], "q99": q[3], "mad": mads[c][0] if c in mads else None}
            for c, q in quartiles.items()}


def quantile_frame(spark, table: dict) -> DataFrame:
    rows = [(c, q["q1"], q["median"], q["q3"], q["q99"], q["mad"]) for c, q in table.items()]
    return spark.createDataFrame(rows, "column string, q1 double, median double, q3 double, q99 double, mad double")


def _any(conditions: list[Column]) -> Column:
    if not conditions:
        return F.lit(False)
    return F.exists(F.array(*conditions), lambda x: x) if len(conditions) > 64 else reduce(lambda a, b: a | b, conditions)


def iqr_flag(columns: list[str], centres: dict, multiplier: float) -> Column:
    """Any column outside its quartiles by more than ``multiplier`` times a positive IQR."""
    tests = []
    for c in columns:
        q = centres[c]
        if q["q1"] is not None and q["q3"] - q["q1"] > 0:
            margin = multiplier * (q["q3"] - q["q1"])
            x = F.col(f"`{c}`")
            tests.append(F.coalesce((x < q["q1"] - margin) | (x > q["q3"] + margin), F.lit(False)))
    return _any(tests)


def modified_z_flag(columns: list[str], centres: dict, threshold: float) -> Column:
    tests = []
    for c in columns:
        q = centres[c]
        if q["mad"]:
            z = F.abs(0.6745 * (F.col(f"`{c}`") - q["median"]) / q["mad"])
            tests.append(F.coalesce(z > threshold, F.lit(False)))
    return _any(tests)


def median_fill(matrix: DataFrame, columns: list[str], centres: dict) -> DataFrame:
    """NULL to the column's median (0 without any value); only ever for the detector input."""
    def filled(c):
        return F.coalesce(F.col(f"`{c}`"), F.lit(float(centres[c]["median"] or 0.0))).alias(c)
    return matrix.select("row_id", *[filled(c) for c in columns])


def imputation_footprint(matrix: DataFrame, columns: list[str]) -> DataFrame:
    counts = matrix.agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.col(f"`{c}`").isNull()).alias(f"m{i}") for i, c in enumerate(columns)])
    rows = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"m{i}").alias("imputed_cells")) for i, c in enumerate(columns)])
    return counts.select("n", F.inline(rows)).select("column", "imputed_cells", X.safe_div(F.col("imputed_cells"), F.col("n")).alias("imputed_rate"))


def standard_scale(filled: DataFrame, columns: list[str]) -> DataFrame:
    """(x - mean) / population standard deviation; a constant column is only centred."""
    moments = filled.agg(*[f(f"`{c}`").alias(f"{k}{i}") for i, c in enumerate(columns)
                           for k, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    scaled = [((F.col(f"`{c}`") - F.lit(moments[f"m{i}"])) / F.lit(moments[f"s{i}"] or 1.0)).alias(c) for i, c in enumerate(columns)]
    return filled.select("row_id", *scaled)


def contamination(n: int, config: dict) -> float:
    rule = config["anomaly"]["isolation_forest"]
    return min(rule["contamination_max"], max(rule["contamination_min"], rule["expected_cases"] / n))


def neighbour_count(n: int, config: dict) -> int:
    rule = config["anomaly"]["local_outlier_factor"]
    return max(1, min(rule["max_neighbors"], max(rule["min_neighbors"], n // rule["divisor"]), n - 1))


def isolation_scores(scaled: DataFrame, columns: list[str], config: dict) -> DataFrame:
    rule = config["anomaly"]["isolation_forest"]
    trees, size = forest.fit(scaled, "row_id", columns, rule["trees"], rule["subsample"], config["random_seed"])
    return scaled.withColumn("isolation_score", forest.score_column(scaled.sparkSession, trees, size, columns))


def outlier_factors(scaled: DataFrame, columns: list[str], k: int, **options) -> DataFrame:
    """The matrix with a ``lof`` column; every copy of a point carries the point's factor."""
    return scaled.join(neighbours.local_outlier_factor(scaled, columns, k, **options), columns)


@dataclass(frozen=True)
class Detection:
    """``flags`` is None where the gate on rows and columns was not passed."""

    columns: list[str]
    n_rows: int
    flags: DataFrame | None
    footprint: DataFrame | None = None
    methods: tuple[str, ...] = ()


def detect(ds: Dataset, columns: list[str], sentinels: dict[str, list[str]], proposed: bool, n_rows: int | None = None) -> Detection:
    """All detectors over one column set; the flags are written once and read back."""
    return detections(ds, [(columns, proposed)], sentinels, n_rows)[0]


def detections(ds: Dataset, wanted: list[tuple[list[str], bool]], sentinels: dict[str, list[str]], n_rows: int | None = None) -> list[Detection]:
    """One detection per column set and strictness. Quantiles of a column and learned scores of a column set don't depend on the
    strictness, so the rows are parsed and measured once for all of them."""
    rule = ds.config["anomaly"]
    n = ds.df.count() if n_rows is None else n_rows
    sets = list(dict.fromkeys(tuple(c) for c, _ in wanted if len(c) >= rule["min_columns"] and n >= rule["min_rows"]))
    if not sets:
        return [Detection(c, n, None) for c, _ in wanted]
    together = list(dict.fromkeys(c for columns in sets for c in columns))
    matrix = stored_matrix(ds, together, sentinels)
    centres = quantile_table(matrix, together)
    learned = dict(zip(sets, at_once([partial(learned_flags, matrix, list(columns), centres, n, ds.config) for columns in sets])))

    def one(columns: list[str], proposed: bool) -> Detection:
        if tuple(columns) not in learned:
            return Detection(columns, n, None)
        limits = rule["proposed" if proposed else "baseline"]
        flags = matrix.select("row_id", iqr_flag(columns, centres, limits["iqr_multiplier"]).alias("iqr"),
                              modified_z_flag(columns, centres, limits["z_threshold"]).alias("modified_z"))
        found, names = learned[tuple(columns)]
        if found is not None:
            flags = flags.join(found, "row_id")
        methods = ["iqr", "modified_z", *names]
        flags = cut_lineage(with_ensemble(flags, methods, names, proposed, ds.config))
        return Detection(columns, n, flags, imputation_footprint(matrix, columns), tuple(methods))

    return at_once([partial(one, *w) for w in wanted])


def both_policies(policies: dict[str, list[str]]) -> list[tuple[list[str], bool]]:
    """What :func:`detections` takes for the loose limits on all numeric columns and the strict ensemble on routed ones."""
    return [(policies["uniform_dtype_routing"], False), (policies["transformer_augmented_routing"], True)]


def learned_flags(matrix: DataFrame, columns: list[str], centres: dict, n: int, config: dict) -> tuple[DataFrame | None, list[str]]:
    """(row_id, a flag per learned detector) and the detectors' names; no table where all are disabled."""
    rule = config["anomaly"]
    use_forest, use_lof = rule["isolation_forest"]["enabled"], rule["local_outlier_factor"]["enabled"]
    if not (use_forest or use_lof):
        return None, []
    learned = []
    with steps_of(matrix.sparkSession) as store:
        scaled = store(standard_scale(median_fill(matrix, columns, centres), columns))
        scores, factors = at_once([(lambda: isolation_scores(scaled, columns, config)) if use_forest else (lambda: scaled),
                                   (lambda: neighbours.local_outlier_factor(scaled, columns, neighbour_count(n, config), store)) if use_lof else (lambda: None)])
        if use_forest:
            learned.append(("isolation_forest", "isolation_score"))
        if use_lof:
            scores = scores.join(factors, columns)
            learned.append(("local_outlier_factor", "lof"))
        scores = cut_lineage(scores.drop(*columns))
    cuts = exact_quantiles(scores, {s: -F.col(s) for _, s in learned}, [contamination(n, config)])
    return scores.select("row_id", *[(-F.col(s) < cuts[s][0]).alias(m) for m, s in learned]), [m for m, _ in learned]


def with_ensemble(flags: DataFrame, methods: list[str], learned: list[str], proposed: bool, config: dict) -> DataFrame:
    """Method count, and the ensemble: enough methods with a learned one among them, or (baseline) any."""
    rule = config["anomaly"]["ensemble"]
    count = reduce(lambda a, b: a + b, [F.col(m).cast("long") for m in methods])
    if not proposed:
        ensemble = _any([F.col(m) for m in methods])
    else:
        ensemble = count >= rule["min_methods"]
        if rule["require_ml_method"] and learned:
            ensemble = ensemble & _any([F.col(m) for m in learned])
    return flags.withColumn("method_count", count).withColumn("ensemble_flag", ensemble)


def anomaly_summary(flags: DataFrame, methods: tuple[str, ...]) -> DataFrame:
    names = [*methods, "ensemble_flag"]
    counts = flags.agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.col(m)).alias(m) for m in names])
    rows = F.array(*[F.struct(F.lit(m).alias("method"), F.col(m).alias("flagged_rows")) for m in names])
    return counts.select("n", F.inline(rows)).select("method", "flagged_rows", X.safe_div(F.col("flagged_rows"), F.col("n")).alias("flagged_rate"))


def anomaly_score(flags: DataFrame) -> DataFrame:
    return flags.agg(F.count_if(F.col("ensemble_flag")).alias("flagged_rows"),
                     X.clip01(1 - X.safe_div(F.count_if(F.col("ensemble_flag")), F.count(F.lit(1)))).alias("score"))


def flagged(detection: Detection) -> int:
    return detection.flags.where("ensemble_flag").count() if detection.flags is not None else 0


def policy_comparison(spark, generic: Detection, semantic: Detection) -> DataFrame:
    """One row per policy: all numeric columns with loose limits, routed columns with the strict ensemble."""
    rows = []
    for d, method, use in ((generic, "generic_anomaly_detection_all_numeric_columns", "not_semantic"),
                           (semantic, "semantic_variable_aware_anomaly_detection_with_hitl_triage", "semantic_review_candidates")):
        hit = flagged(d)
        rate = hit / d.n_rows if d.n_rows else 0.0
        rows.append((method, ",".join(d.columns), len(d.columns), hit, rate, 1.0 if d.flags is None else max(0.0, 1 - rate), use))
    return spark.createDataFrame(rows, "method string, numeric_columns_used string, n_columns long, flagged_rows long, "
                                       "flagged_rate double, A_anomaly_score double, hitl_prioritisation string")


def anomaly_issue(spark, detection: Detection) -> DataFrame:
    """One dataset-level issue if any row is an ensemble candidate."""
    if detection.flags is None:
        return spark.createDataFrame([], ISSUE)
    return (detection.flags.agg(F.count_if(F.col("ensemble_flag")).alias("count")).where("count > 0")
            .select(*issue_columns("A", "semantic_ai_anomaly", F.lit("ensemble_anomaly_candidate"), F.lit(None), F.col("count"),
                                   F.lit("medium"), "review", F.lit("semantic anomaly candidates for HITL triage"))))
