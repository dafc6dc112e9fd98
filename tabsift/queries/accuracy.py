"""Queries of structure, domain, cross-field and category checks, privacy and anomaly detection."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from tabsift.config import ANOMALY_ROLES, CATEGORY_ROLES, CONFIG, with_config
from tabsift.dataset import at_once, cut_lineage, steps_of
from tabsift.functions import exprs as X
from tabsift.operators import accuracy, anomaly, injection, missing, privacy, roles, triage
from tabsift.operators.frequency import column_measures
from tabsift.plans.assess import accuracy_issues, profile
from tabsift.queries import fixtures as T, sqltext as S
from tabsift.queries.profiling import EMPTY, RULED, both, labelled, over
from tabsift.queries.shapes import rounded

QUERIES, ORACLES = {}, {}
# Learned detectors off: everything left can be stated in SQL.
PLAIN = with_config(anomaly={"isolation_forest": {**CONFIG["anomaly"]["isolation_forest"], "enabled": False},
                             "local_outlier_factor": {**CONFIG["anomaly"]["local_outlier_factor"], "enabled": False}})


def add(name, sql, run):
    QUERIES[name] = lambda spark, folder: rounded(run(spark, folder))
    if sql is not None:
        ORACLES[name] = sql


# --- structure -----------------------------------------------------------------------------------
def _non_numeric(s, d):
    ds = T.visits(s, d)
    return accuracy.present_non_numeric(ds, ds.columns, missing.sentinel_map(ds))


add("present_non_numeric", over("visits", select=S.finish('SELECT "column", usable_count - loose_count AS non_numeric FROM visits_stats', ints="non_numeric")), _non_numeric)

DUP = S.DATASETS["visits"]["columns"]
add("duplicate_rows", S.with_ctes(S.clean("visits"), select=S.finish(
    "SELECT (SELECT count(*) FROM visits) AS n_rows, count(*) AS distinct_rows, (SELECT count(*) FROM visits) - count(*) AS duplicate_rows "
    f"FROM (SELECT DISTINCT {', '.join(DUP)} FROM visits)", ints="n_rows distinct_rows duplicate_rows")),
    lambda s, d: accuracy.duplicate_rows(T.visits(s, d).df, DUP))


def _id_dups(s, d):
    p = profile(T.cohort(s, d, {"id_fields": ["subject_id", "segment"]}), infer=False)
    return accuracy.identifier_duplicates(p.stats, p.semantic)


add("identifier_duplicates", over("cohort", select=S.finish(
    "SELECT \"column\", non_missing - distinct_count AS duplicates FROM cohort_stats WHERE \"column\" IN ('subject_id', 'segment')", ints="duplicates")), _id_dups)

ID_META = {**T.COHORT_METADATA, "id_fields": ["subject_id"]}
ID_RULES = S.rule_cases(ID_META)


def _structural(name, rules):
    rule_text = ("'rule=' || role || '; embedding=; final=' || role || '; confidence=' || format('{:.3f}', role_confidence)")
    return f"""SELECT 'A' AS dimension, 'structural' AS method, 'identifier_duplicate' AS issue_type, "column", non_missing - distinct_count AS count, 'high' AS severity,
  'review' AS hitl_decision, '' AS rule FROM r WHERE role = 'identifier' AND non_missing > distinct_count
 UNION ALL SELECT 'A', 'structural', 'non_numeric_observed_value', "column", usable_count - loose_count, 'high', 'review', '' FROM r
  WHERE (contains(role, 'numeric') OR contains(role, 'measurement')) AND usable_count > loose_count
 UNION ALL SELECT 'A', 'semantic_role_provenance', 'low_semantic_role_confidence', "column", 1, 'low', 'schema_confirmation', {rule_text} FROM r WHERE role_confidence < 0.65
 UNION ALL SELECT 'A', 'structural', 'duplicate_rows', NULL, n, 'high', 'review', '' FROM (SELECT count(*) - (SELECT count(*) FROM (SELECT DISTINCT {', '.join(S.DATASETS[name]['columns'])} FROM {name})) AS n FROM {name}) WHERE n > 0"""


def structural_sql(name, rules, select):
    ranked = f"r AS (SELECT *, {S.role_columns(rules)} FROM {name}_stats), structural AS ({_structural(name, rules)})"
    return over(name, extra=(ranked,), select=select)


def _struct_issues(ds):
    p = profile(ds, infer=False)
    return accuracy.structural_issues(p.ds, p.stats, p.semantic)


add("structural_issues", structural_sql("visits", S.rule_cases(), S.finish("SELECT * FROM structural", ints="count")), lambda s, d: _struct_issues(T.visits(s, d)))
add("structural_score", structural_sql("cohort", ID_RULES, S.finish(
    f"SELECT {S.clip('1 - sum(count) / ((SELECT count(*) FROM cohort) * 14.0)')} AS score FROM structural", "score")),
    lambda s, d: accuracy.structural_score(_struct_issues(T.cohort(s, d, ID_META)), T.cohort(s, d).df.count() * 14))

# --- domain and cross-field rules -----------------------------------------------------------------
AGE = S.number("age")
DOMAIN = f"""domain AS (SELECT 2 AS ordinal, 'age' AS "column", 'range' AS kind, count({AGE}) AS checks, count(*) FILTER ({AGE} < 18 OR {AGE} > 80) AS violations,
  'metadata valid_ranges: [18, 80]' AS rule FROM cohort
 UNION ALL SELECT 4, 'grp', 'allowed', count(grp), count(*) FILTER ({S.norm('grp')} NOT IN ('control', 'case')), 'metadata allowed_values' FROM cohort)"""


def domain(s, d):
    return accuracy.domain_counts(T.cohort(s, d))


def cohort_sql(*extra, select):
    return S.with_ctes(S.clean("cohort"), *extra, select=select)


for name, kind in (("check_allowed_values", "allowed"), ("check_valid_range", "range")):
    add(name, cohort_sql(DOMAIN, select=S.finish(f"SELECT \"column\", checks, violations FROM domain WHERE kind = '{kind}'", ints="checks violations")),
        lambda s, d, kind=kind: accuracy.domain_counts(T.cohort(s, d), (kind,)).select("column", "checks", "violations"))
FEATURES = f"features AS (SELECT \"column\", sum(checks) AS domain_checks, sum(violations) AS domain_violations, {S.clip('1 - sum(violations) / sum(checks)')} AS domain_score FROM domain GROUP BY 1)"
add("domain_scores", cohort_sql(DOMAIN, FEATURES, select=S.finish(
    "SELECT \"column\", domain_checks, domain_violations, domain_score FROM features UNION ALL SELECT '(dataset)', NULL, NULL, avg(domain_score) FROM features",
    "domain_score", "domain_checks domain_violations")),
    lambda s, d: accuracy.domain_features(domain(s, d)).unionByName(
        accuracy.domain_score(accuracy.domain_features(domain(s, d))).select(F.lit("(dataset)").alias("column"), F.lit(None).cast("long").alias("domain_checks"),
                                                                             F.lit(None).cast("long").alias("domain_violations"), F.col("score").alias("domain_score"))))

A, D, PA, PB, PT = (S.number(c) for c in ("admission_day", "discharge_day", "part_a", "part_b", "part_total"))
RULES = f"""rules AS (SELECT 0 AS position, 'left_greater_than_right' AS issue_type, 'admission_day>discharge_day' AS "column", 'high' AS severity,
  count(*) FILTER ({A} IS NOT NULL AND {D} IS NOT NULL) AS checks, count(*) FILTER ({A} > {D}) AS violations FROM cohort
 UNION ALL SELECT 1, 'sum_mismatch', 'part_total', 'medium', count(*) FILTER ({PA} + {PB} IS NOT NULL AND {PT} IS NOT NULL), count(*) FILTER (abs({PA} + {PB} - {PT}) > 1e-6) FROM cohort
 UNION ALL SELECT 2, 'negative_value', 'balance_value', 'medium', count(balance_value), count(*) FILTER (balance_value < 0) FROM cohort)"""
for name, position in (("check_not_greater_than", 0), ("check_sum_equals", 1), ("check_non_negative", 2)):
    add(name, cohort_sql(RULES, select=S.finish(f'SELECT issue_type, "column", severity, checks, violations FROM rules WHERE position = {position}', ints="checks violations")),
        lambda s, d, p=position: accuracy.rule_counts(T.cohort(s, d)).where(F.col("position") == p).drop("position"))
add("rules_missing_column", cohort_sql(RULES, select=S.finish("SELECT * FROM rules", ints="position checks violations")), lambda s, d: accuracy.rule_counts(T.cohort(s, d)))
add("consistency_score", cohort_sql(RULES, select=S.finish(f"SELECT {S.clip('1 - sum(violations) / sum(checks)')} AS score FROM rules", "score")),
    lambda s, d: accuracy.consistency_score(accuracy.rule_counts(T.cohort(s, d))))

# --- categories ----------------------------------------------------------------------------------
VARIANTS = f"""surface AS (SELECT DISTINCT "column", {S.strip('value')} AS surface FROM cohort_vf WHERE value IS NOT NULL
   AND "column" IN (SELECT "column" FROM (SELECT "column", {S.role_columns(S.rule_cases())} FROM cohort_stats) WHERE role IN {S.names(CATEGORY_ROLES)})),
 checked AS (SELECT * FROM surface WHERE "column" IN (SELECT "column" FROM surface GROUP BY 1 HAVING count(*) <= 50)),
 groups AS (SELECT "column", {S.canon('surface')} AS canon, count(*) AS n, string_agg(surface, ' / ' ORDER BY surface) AS forms FROM checked GROUP BY 1, 2),
 placed AS (SELECT *, row_number() OVER (PARTITION BY "column", n > 1 ORDER BY canon) AS place FROM groups),
 variants AS (SELECT "column", sum(CASE WHEN n > 1 THEN n ELSE 0 END) AS n_variants, coalesce(string_agg(forms, '; ' ORDER BY canon) FILTER (n > 1 AND place <= 3), '') AS example FROM placed GROUP BY 1)"""


def variants(s, d):
    p = profile(T.cohort(s, d, EMPTY), infer=False)
    return accuracy.category_variants(p.ds, accuracy.category_columns(p.semantic))


add("category_variants", over("cohort", extra=(VARIANTS,), select=S.finish("SELECT * FROM variants", ints="n_variants")), variants)
add("category_score", over("cohort", extra=(VARIANTS,), select=S.finish("SELECT 1 - count(*) FILTER (n_variants > 0) / count(*) AS score FROM variants", "score")),
    lambda s, d: accuracy.category_score(variants(s, d)))

# --- privacy -------------------------------------------------------------------------------------
QI = ["nation_code", "segment", "sex"]
PART_QI = ["p_brand", "p_type", "p_size"]


def k_sql(table, qis, label):
    return (f"SELECT '{label}' AS dataset, true AS assessable, sum(n) AS n_rows, count(*) AS n_classes, min(n) AS min_equivalence_class, sum(n) FILTER (n < 5) / sum(n) AS at_risk_fraction, "
            f"1 - least(coalesce(sum(n) FILTER (n < 5), 0) / sum(n), 0.5) / 0.5 AS k_score FROM (SELECT count(*) AS n FROM {table} GROUP BY {', '.join(qis)})")


def _k(s, d):
    parts = [privacy.k_anonymity(T.cohort(s, d).df, QI, CONFIG).select(F.lit("cohort").alias("dataset"), "*"),
             privacy.k_anonymity(T.table(s, d, "part"), PART_QI, CONFIG).select(F.lit("part").alias("dataset"), "*"),
             privacy.k_anonymity(T.visits(s, d).df, ["smoker_flag", "priority"], CONFIG).select(F.lit("visits").alias("dataset"), "*")]
    return reduce(DataFrame.unionByName, parts)


K_SQL = " UNION ALL ".join([k_sql("cohort", QI, "cohort"), k_sql("part", PART_QI, "part"), k_sql("visits", ["smoker_flag", "priority"], "visits")])
add("k_anonymity", S.with_ctes(S.clean("cohort"), S.clean("visits"), select=S.finish(
    f"SELECT * REPLACE (coalesce(at_risk_fraction, 0) AS at_risk_fraction) FROM ({K_SQL})", "at_risk_fraction k_score", "n_rows n_classes min_equivalence_class")), _k)
add("class_size_per_record", "SELECT p_partkey, p_brand, p_type, CAST(p_size AS BIGINT) AS p_size, count(*) OVER (PARTITION BY p_brand, p_type, p_size) AS class_size FROM part",
    lambda s, d: privacy.class_size_per_record(T.table(s, d, "part"), "p_partkey", PART_QI))

# --- detectors -----------------------------------------------------------------------------------
M_COLS = S.DATASETS["measures"]["columns"]
QUANT = "quant AS (" + " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.5) AS median, quantile_cont({c}, 0.75) AS q3, quantile_cont({c}, 0.99) AS q99, "
    f"(SELECT quantile_cont(abs({c} - m), 0.5) FROM measures, (SELECT quantile_cont({c}, 0.5) AS m FROM measures)) AS mad FROM measures" for c in M_COLS) + ")"


def m_sql(*extra, select):
    return S.with_ctes(S.clean("measures"), *extra, select=select)


def matrix(s, d):
    return anomaly.anomaly_matrix(T.measures(s, d), M_COLS, {})


def measured(s, d):
    """The stored matrix and its quantiles."""
    m = anomaly.stored_matrix(T.measures(s, d), M_COLS, {})
    return m, anomaly.quantile_table(m, M_COLS)


def centres(s, d):
    return measured(s, d)[1]


add("column_quantiles", m_sql(QUANT, select=S.finish('SELECT "column", q1, median, q3, q99 FROM quant', "q1 median q3 q99")),
    lambda s, d: anomaly.quantile_frame(s, centres(s, d)).drop("mad"))
add("column_mad", m_sql(QUANT, select=S.finish('SELECT "column", mad FROM quant', "mad")), lambda s, d: anomaly.quantile_frame(s, centres(s, d)).select("column", "mad"))


def _cohort_matrix(s, d):
    p = profile(T.cohort(s, d), infer=False)
    return anomaly.anomaly_matrix(p.ds, p.policies["transformer_augmented_routing"], p.sentinels)


C_COLS = ["age", "glucose", "admission_day", "discharge_day", "part_a", "part_b", "part_total", "nation_code", "balance_value"]


def c_number(c):
    if c in ("nation_code", "balance_value"):
        return f"CAST({c} AS DOUBLE)"
    return f"CASE WHEN {S.norm(c)} IN (SELECT token FROM cohort_sentinels WHERE \"column\" = '{c}') THEN NULL ELSE {S.loose(c)} END"


add("anomaly_matrix", over("cohort", select=S.finish("SELECT row_id, " + ", ".join(f"{c_number(c)} AS {c}" for c in C_COLS) + " FROM cohort", " ".join(C_COLS))), _cohort_matrix)


def filled(s, d):
    m, c = measured(s, d)
    return anomaly.median_fill(m, M_COLS, c)


def q(c, f):
    return f"(SELECT {f} FROM quant WHERE \"column\" = '{c}')"


def iqr_sql(k):
    return " OR ".join(f"coalesce({q(c, 'q3 - q1')} > 0 AND ({c} < {q(c, f'q1 - {k} * (q3 - q1)')} OR {c} > {q(c, f'q3 + {k} * (q3 - q1)')}), false)" for c in M_COLS)


def z_sql(t):
    return " OR ".join(f"coalesce({q(c, 'mad')} > 0 AND abs(0.6745 * ({c} - {q(c, 'median')}) / {q(c, 'mad')}) > {t}, false)" for c in M_COLS)


FLAGS = f"flags AS (SELECT row_id, {iqr_sql(3.0)} AS iqr, {z_sql(4.5)} AS modified_z, {iqr_sql(1.5)} AS iqr_loose, {z_sql(3.5)} AS modified_z_loose FROM measures)"


def _iqr(s, d):
    m, c = measured(s, d)
    return m.select("row_id", anomaly.iqr_flag(M_COLS, c, 3.0).alias("proposed"), anomaly.iqr_flag(M_COLS, c, 1.5).alias("baseline"))


def _z(s, d):
    m, c = measured(s, d)
    return m.select("row_id", anomaly.modified_z_flag(M_COLS, c, 4.5).alias("proposed"), anomaly.modified_z_flag(M_COLS, c, 3.5).alias("baseline"))


add("iqr_flags", m_sql(QUANT, FLAGS, select="SELECT row_id, iqr AS proposed, iqr_loose AS baseline FROM flags"), _iqr)
add("modified_z_flags", m_sql(QUANT, FLAGS, select="SELECT row_id, modified_z AS proposed, modified_z_loose AS baseline FROM flags"), _z)

FILLED = "filled AS (SELECT row_id, " + ", ".join(f"coalesce({c}, {q(c, 'median')}, 0) AS {c}" for c in M_COLS) + " FROM measures)"
add("median_fill", m_sql(QUANT, FILLED, select=S.finish("SELECT * FROM filled", " ".join(M_COLS))), lambda s, d: filled(s, d))
add("standard_scale", m_sql(QUANT, FILLED, select=S.finish("SELECT row_id, " + ", ".join(
    f"({c} - (SELECT avg({c}) FROM filled)) / coalesce(nullif((SELECT stddev_pop({c}) FROM filled), 0), 1) AS {c}" for c in M_COLS) + " FROM filled", " ".join(M_COLS))),
    lambda s, d: anomaly.standard_scale(filled(s, d), M_COLS))
add("imputation_footprint", m_sql(select=S.finish(" UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", count(*) - count({c}) AS imputed_cells, {S.div(f'count(*) - count({c})', 'count(*)')} AS imputed_rate FROM measures" for c in M_COLS), "imputed_rate", "imputed_cells")),
    lambda s, d: anomaly.imputation_footprint(matrix(s, d), M_COLS))


def plain(s, d, proposed=True):
    return anomaly.detect(T.measures(s, d, config=PLAIN), M_COLS, {}, proposed)


ENS = "ens AS (SELECT row_id, iqr, modified_z, CAST(iqr AS BIGINT) + CAST(modified_z AS BIGINT) AS method_count, iqr AND modified_z AS ensemble_flag FROM flags)"
add("ensemble_flags", m_sql(QUANT, FLAGS, ENS, select="SELECT * FROM ens"), lambda s, d: plain(s, d).flags)
add("anomaly_summary", m_sql(QUANT, FLAGS, ENS, select=S.finish(" UNION ALL ".join(
    f"SELECT '{m}' AS method, count(*) FILTER ({m}) AS flagged_rows, count(*) FILTER ({m}) / count(*) AS flagged_rate FROM ens" for m in ("iqr", "modified_z", "ensemble_flag")), "flagged_rate", "flagged_rows")),
    lambda s, d: (lambda x: anomaly.anomaly_summary(x.flags, x.methods))(plain(s, d)))
add("anomaly_score", m_sql(QUANT, FLAGS, ENS, select=S.finish("SELECT count(*) FILTER (ensemble_flag) AS flagged_rows, 1 - count(*) FILTER (ensemble_flag) / count(*) AS score FROM ens", "score", "flagged_rows")),
    lambda s, d: anomaly.anomaly_score(plain(s, d).flags))
add("anomaly_issue", m_sql(QUANT, FLAGS, ENS, select=(
    "SELECT 'A' AS dimension, 'semantic_ai_anomaly' AS method, 'ensemble_anomaly_candidate' AS issue_type, NULL::VARCHAR AS \"column\", count(*) AS count, 'medium' AS severity, "
    "'review' AS hitl_decision, 'semantic anomaly candidates for HITL triage' AS rule FROM ens WHERE ensemble_flag HAVING count(*) > 0")), lambda s, d: anomaly.anomaly_issue(s, plain(s, d)))
POLICY = f"""SELECT 'generic_anomaly_detection_all_numeric_columns' AS method, '{",".join(M_COLS)}' AS numeric_columns_used, 4 AS n_columns, count(*) FILTER (iqr_loose OR modified_z_loose) AS flagged_rows,
  count(*) FILTER (iqr_loose OR modified_z_loose) / count(*) AS flagged_rate, 1 - count(*) FILTER (iqr_loose OR modified_z_loose) / count(*) AS A_anomaly_score, 'not_semantic' AS hitl_prioritisation FROM flags
 UNION ALL SELECT 'semantic_variable_aware_anomaly_detection_with_hitl_triage', '{",".join(M_COLS)}', 4, count(*) FILTER (ensemble_flag), count(*) FILTER (ensemble_flag) / count(*),
  1 - count(*) FILTER (ensemble_flag) / count(*), 'semantic_review_candidates' FROM ens"""


def policies(s, d):
    p = profile(T.measures(s, d, config=PLAIN), infer=False)
    return anomaly.policy_comparison(s, *anomaly.detections(p.ds, anomaly.both_policies(p.policies), p.sentinels))


add("anomaly_policy_comparison", m_sql(QUANT, FLAGS, ENS, select=S.finish(POLICY, "flagged_rate A_anomaly_score", "n_columns flagged_rows")), policies)


def _scaled(s, d):
    with steps_of(s) as store:
        m = store(anomaly.anomaly_matrix(T.measures(s, d), M_COLS, {}))
        return cut_lineage(anomaly.standard_scale(anomaly.median_fill(m, M_COLS, anomaly.quantile_table(m, M_COLS)), M_COLS))


add("isolation_forest", None, lambda s, d: anomaly.isolation_scores(_scaled(s, d), M_COLS, CONFIG).select("row_id", "isolation_score"))
add("local_outlier_factor", None, lambda s, d: anomaly.outlier_factors(_scaled(s, d), M_COLS, 35).select("row_id", "lof"))

# The factor itself, over whole numbers with many equal distances: SQL compares all pairs, ties go to the smaller coordinates.
BUYERS = """SELECT c_custkey AS row_id, CAST(floor(c_acctbal / 100) AS DOUBLE) AS balance, CAST(count(o_orderkey) AS DOUBLE) AS orders, CAST(floor(coalesce(max(o_totalprice), 0) / 10000) AS DOUBLE) AS largest
 FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey, c_acctbal"""
B_COLS = ["balance", "orders", "largest"]
LOF = (f"WITH x AS ({BUYERS}), pairs AS (SELECT a.row_id AS p, b.row_id AS o, sqrt(" + " + ".join(f"(a.{c} - b.{c}) * (a.{c} - b.{c})" for c in B_COLS) + ") AS d, " + ", ".join(f"b.{c}" for c in B_COLS)
       + " FROM x a JOIN x b ON a.row_id <> b.row_id), near AS (SELECT p, o, d FROM (SELECT *, row_number() OVER (PARTITION BY p ORDER BY d, " + ", ".join(B_COLS) + ", o) AS r FROM pairs) WHERE r <= 35), "
       "reach AS (SELECT p, max(d) AS k FROM near GROUP BY p), dens AS (SELECT n.p, 1 / (avg(greatest(r.k, n.d)) + 1e-10) AS density FROM near n JOIN reach r ON r.p = n.o GROUP BY n.p) "
       "SELECT n.p AS row_id, avg(o.density) / any_value(i.density) AS lof FROM near n JOIN dens o ON o.p = n.o JOIN dens i ON i.p = n.p GROUP BY n.p")


def _buyers(s, d):
    return s.sql(BUYERS.replace("FROM customer", "FROM {c}").replace("JOIN orders", "JOIN {o}"), c=T.table(s, d, "customer"), o=T.table(s, d, "orders"))


add("local_outlier_factor_buyers", S.finish(LOF, "lof"),
    lambda s, d: anomaly.outlier_factors(cut_lineage(_buyers(s, d)), B_COLS, 35, leaf_points=100).select("row_id", "lof"))


def _full(s, d):
    p = profile(T.cohort(s, d))
    return anomaly.detect(p.ds, p.policies["transformer_augmented_routing"], p.sentinels, True).flags


add("ensemble_flags_learned", None, _full)

# --- controlled errors ---------------------------------------------------------------------------
ORDERED = "ordered AS (SELECT row_id, md5('42:' || row_id) AS key, row_number() OVER (ORDER BY md5('42:' || row_id)) - 1 AS position FROM measures)"
PLAN = ("plan AS (SELECT row_id, position, [" + ", ".join(f"'{c}'" for c in M_COLS) + "][position % 4 + 1] AS \"column\", ['set_missing', 'numeric_sentinel', 'high_outlier'][position % 3 + 1] AS error_type "
        "FROM ordered WHERE position < greatest(1, CAST(floor((SELECT count(*) FROM measures) * 0.05) AS BIGINT)))")
BROKEN = "broken AS (SELECT m.row_id, " + ", ".join(
    f"CASE WHEN p.\"column\" IS DISTINCT FROM '{c}' THEN m.{c} WHEN error_type = 'numeric_sentinel' THEN -999.0 WHEN error_type = 'high_outlier' THEN 10 * {q(c, 'q99')} END AS {c}" for c in M_COLS) + \
    " FROM measures m LEFT JOIN plan p USING (row_id))"
add("sample_control_rows", m_sql(ORDERED, select="SELECT row_id, position FROM ordered WHERE position < 30"), lambda s, d: triage.control_rows(T.measures(s, d).df, "row_id", 30, 42))
add("inject_cycle", m_sql(ORDERED, PLAN, select='SELECT row_id, position, "column", error_type FROM plan'),
    lambda s, d: (lambda ds: injection.injection_plan(ds, M_COLS, ds.df.count(), 0.05))(T.measures(s, d)))


def broken(s, d):
    ds = T.measures(s, d, config=PLAIN)
    columns = injection.eligible_columns(ds, column_measures(ds).collect())
    return ds, *injection.inject_errors(ds, columns, ds.df.count(), 0.05)


add("inject_errors", m_sql(QUANT, ORDERED, PLAN, BROKEN, select=S.finish("SELECT * FROM broken", " ".join(M_COLS))), lambda s, d: broken(s, d)[1].df)
QUANT2 = QUANT.replace("quant AS", "quant2 AS").replace("FROM measures", "FROM broken")
FLAGS2 = FLAGS.replace("flags AS", "flags2 AS").replace("FROM quant ", "FROM quant2 ").replace("FROM measures", "FROM broken")
AFTER = ("after AS (SELECT f.row_id, f2.iqr AND f2.modified_z AND NOT (f.iqr AND f.modified_z) AS predicted, p.row_id IS NOT NULL AS truth, f.iqr AND f.modified_z AS was "
         "FROM flags f JOIN flags2 f2 USING (row_id) LEFT JOIN plan p USING (row_id))")
ALL = (QUANT, FLAGS, ORDERED, PLAN, BROKEN, QUANT2, FLAGS2, AFTER)


def _before_after(s, d):
    ds, bad, truth = broken(s, d)
    n = ds.df.count()
    return injection.newly_flagged(*(x.flags for x in at_once([lambda x=x: anomaly.detect(x, M_COLS, {}, True, n) for x in (ds, bad)])))


add("join_before_after_flags", m_sql(*ALL, select="SELECT row_id, predicted FROM after"), _before_after)


def _confusion(s, d):
    ds, bad, truth = broken(s, d)
    n = ds.df.count()
    before, after = at_once([lambda x=x: anomaly.detect(x, M_COLS, {}, True, n) for x in (ds, bad)])
    m = injection.evaluate(before, after, truth)
    return s.createDataFrame([(m["precision"], m["recall"], m["f1"], m["newly_flagged_rows"], m["injected_error_rows"], m["pre_existing_flagged_rows"])],
                             "precision double, recall double, f1 double, newly_flagged_rows long, injected_error_rows long, pre_existing_flagged_rows long")


HIT, PRED, TRUE = "count(*) FILTER (predicted AND truth)", "count(*) FILTER (predicted)", "count(*) FILTER (truth)"
add("confusion_metrics", m_sql(*ALL, select=S.finish(
    f"SELECT {S.div(HIT, PRED)} AS precision, {S.div(HIT, TRUE)} AS recall, {S.div(f'2 * {HIT}', f'{PRED} + {TRUE}')} AS f1, {PRED} AS newly_flagged_rows, {TRUE} AS injected_error_rows, "
    "count(*) FILTER (was) AS pre_existing_flagged_rows FROM after", "precision recall f1", "newly_flagged_rows injected_error_rows pre_existing_flagged_rows")), _confusion)


def _controlled(s, d):
    p = profile(T.cohort(s, d))
    n = p.ds.df.count()

    def again(ds):
        x = profile(ds, infer=False)
        return column_measures(ds).collect(), x.sentinels, x.policies

    before = dict(zip(("generic", "semantic"), anomaly.detections(p.ds, anomaly.both_policies(p.policies), p.sentinels, n)))
    return injection.controlled_error_baseline(p.ds, again, n, before)


add("controlled_error_eval", None, _controlled)


def _ablation(s, d, learned=True):
    """The cohort under three policies; embedding evidence is absent, so two of them route alike."""
    p = profile(T.cohort(s, d, config=None if learned else PLAIN), infer=False)
    return p, injection.ablation_detections(p.ds, p.policies, p.sentinels, p.ds.df.count())


add("ablation_burden", None, lambda s, d: (lambda x: injection.ablation_burden(x[0].ds, x[1]))(_ablation(s, d)))
add("ablation_errors", None, lambda s, d: (lambda x: injection.ablation_errors(x[0].ds, x[1], column_measures(x[0].ds).collect(), x[0].sentinels))(_ablation(s, d)))

U_COLS = ["subject_id", "admission_day", "discharge_day", "part_a", "part_b", "part_total", "nation_code", "balance_value"]
CM = "cm AS (SELECT row_id, " + ", ".join(f"{c_number(c)} AS {c}" for c in dict.fromkeys(U_COLS + C_COLS)) + " FROM cohort)"
CQ = "quant AS (" + " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.5) AS median, quantile_cont({c}, 0.75) AS q3, "
    f"(SELECT quantile_cont(abs({c} - m), 0.5) FROM cm, (SELECT quantile_cont({c}, 0.5) AS m FROM cm)) AS mad FROM cm" for c in dict.fromkeys(U_COLS + C_COLS)) + ")"


def hits(columns):
    global M_COLS
    keep, M_COLS = M_COLS, columns
    text = f"({iqr_sql(3.0)}) AND ({z_sql(4.5)})"
    M_COLS = keep
    return f"(SELECT count(*) FILTER ({text}) FROM cm)"


BURDEN = f"""burden AS (SELECT policy, n_columns, flagged_rows, flagged_rows / (SELECT count(*) FROM cohort) AS flagged_rate FROM (
  SELECT 'uniform_dtype_routing' AS policy, {len(U_COLS)} AS n_columns, {hits(U_COLS)} AS flagged_rows
  UNION ALL SELECT 'rule_based_semantic_routing', {len(C_COLS)}, {hits(C_COLS)} UNION ALL SELECT 'transformer_augmented_routing', {len(C_COLS)}, {hits(C_COLS)}))"""
CONTRAST = """SELECT p.contrast, p.a AS reference_policy, p.b AS comparison_policy, p.isolated AS isolates_transformer_routing_effect, y.n_columns - x.n_columns AS column_count_delta,
 y.flagged_rows - x.flagged_rows AS flagged_rows_delta, y.flagged_rate - x.flagged_rate AS flagged_rate_delta, 'semantic_hitl_fixed_v1' AS parameter_lock
 FROM (VALUES ('uniform_to_rule', 'uniform_dtype_routing', 'rule_based_semantic_routing', false), ('rule_to_transformer', 'rule_based_semantic_routing', 'transformer_augmented_routing', true),
 ('uniform_to_transformer', 'uniform_dtype_routing', 'transformer_augmented_routing', false)) p(contrast, a, b, isolated) JOIN burden x ON x.policy = p.a JOIN burden y ON y.policy = p.b"""


def contrasts(s, d):
    p, found = _ablation(s, d, learned=False)
    return injection.ablation_contrasts(injection.ablation_burden(p.ds, found))


CONTRAST_SQL = over("cohort", extra=(CM, CQ, BURDEN), select=S.finish(CONTRAST, "flagged_rate_delta", "column_count_delta flagged_rows_delta"))
add("ablation_contrasts", CONTRAST_SQL, contrasts)
add("join_policy_contrast", over("cohort", extra=(CM, CQ, BURDEN), select=S.finish(
    f"SELECT contrast, column_count_delta, flagged_rows_delta FROM ({CONTRAST})", ints="column_count_delta flagged_rows_delta")),
    lambda s, d: contrasts(s, d).select("contrast", "column_count_delta", "flagged_rows_delta"))


def _burden(s, d):
    p, found = _ablation(s, d, learned=False)
    return injection.ablation_burden(p.ds, found).select("policy", "n_columns", "flagged_rows", "flagged_rate", "iqr_multiplier", "modified_z_threshold", "parameter_lock")


add("ablation_burden_statistical", over("cohort", extra=(CM, CQ, BURDEN), select=S.finish(
    "SELECT policy, n_columns, flagged_rows, flagged_rate, 3.0 AS iqr_multiplier, 4.5 AS modified_z_threshold, 'semantic_hitl_fixed_v1' AS parameter_lock FROM burden",
    "flagged_rate iqr_multiplier modified_z_threshold", "n_columns flagged_rows")), _burden)
