"""Queries of scoring, triage, review samples and findings."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabsift.config import CONFIG, DEFAULT_REASON, ISSUE_REASONS
from tabsift.dataset import at_once
from tabsift.functions import exprs as X
from tabsift.operators import accuracy, anomaly, findings, injection, missing, privacy, reuse, roles, scoring, triage
from tabsift.plans.assess import accuracy_issues, assess, profile
from tabsift.queries import accuracy as QA, fixtures as T, profiling as QP, reuse as QR, sqltext as S
from tabsift.queries.profiling import over
from tabsift.queries.shapes import rounded
from tabsift.sources.tables import union_profiles

QUERIES, ORACLES = {}, {}


def add(name, sql, run):
    QUERIES[name] = lambda spark, folder: rounded(run(spark, folder))
    if sql is not None:
        ORACLES[name] = sql


# --- scores --------------------------------------------------------------------------------------
def score_vectors(s, d):
    """One score vector per supplier, as if each were a dataset."""
    return T.table(s, d, "supplier").select(F.col("s_suppkey").alias("dataset"), X.clip01(F.col("s_acctbal") / 9000).alias("A"),
                                            X.clip01(0.8 + F.col("s_nationkey") / 100).alias("C"), X.clip01(F.abs(F.col("s_acctbal")) / 11000).alias("R"))


VECTORS = (f"vectors AS (SELECT s_suppkey AS dataset, {S.clip('s_acctbal / 9000')} AS A, {S.clip('0.8 + s_nationkey / 100')} AS C, {S.clip('abs(s_acctbal) / 11000')} AS R FROM supplier)")
COMPOSITE = S.clip("0.4 * A + 0.3 * C + 0.3 * R")
add("composite_index", S.with_ctes(VECTORS, select=S.finish(f"SELECT *, {COMPOSITE} AS composite FROM vectors", "A C R composite")),
    lambda s, d: score_vectors(s, d).withColumn("composite", scoring.composite_index(CONFIG)))
SCENARIOS = ("scenarios(scenario, A_weight, C_weight, R_weight) AS (VALUES ('expert_original', 0.40::DOUBLE, 0.30::DOUBLE, 0.30::DOUBLE), ('equal_dimensions', 0.3334, 0.3333, 0.3333), "
             "('conservative_health_data', 0.45, 0.35, 0.20), ('reuse_focused_open_science', 0.30, 0.25, 0.45))")
SENS = f"sens AS (SELECT *, composite >= 0.85 AS meets_threshold FROM (SELECT *, {S.clip('A_weight * A + C_weight * C + R_weight * R')} AS composite FROM vectors CROSS JOIN scenarios))"
add("weight_sensitivity", S.with_ctes(VECTORS, SCENARIOS, SENS, select=S.finish("SELECT * FROM sens", "A C R A_weight C_weight R_weight composite")),
    lambda s, d: scoring.weight_sensitivity(score_vectors(s, d), CONFIG))
add("sensitivity_range", S.with_ctes(VECTORS, SCENARIOS, SENS, select=S.finish("SELECT dataset, min(composite) AS lowest, max(composite) AS highest FROM sens GROUP BY 1", "lowest highest")),
    lambda s, d: scoring.sensitivity_range(scoring.weight_sensitivity(score_vectors(s, d), CONFIG), ["dataset"]))
add("threshold_flags", S.with_ctes(VECTORS, select=S.finish(
    f"SELECT *, C >= 0.95 AS C_meets_threshold, A >= 0.95 AS A_meets_threshold, R >= 0.80 AS R_meets_threshold, composite >= 0.85 AS composite_meets_threshold FROM (SELECT *, {COMPOSITE} AS composite FROM vectors)", "A C R composite")),
    lambda s, d: scoring.threshold_flags(score_vectors(s, d).withColumn("composite", scoring.composite_index(CONFIG)), CONFIG))

# --- accuracy score of the cohort, with statistical detectors ------------------------------------
ID_RULES = S.rule_cases(QA.ID_META)
RANKED = f"r AS (SELECT *, {S.role_columns(ID_RULES)} FROM cohort_stats), structural AS ({QA._structural('cohort', ID_RULES)})"
VARIANTS = QA.VARIANTS.replace(S.role_columns(S.rule_cases()), S.role_columns(ID_RULES))
A_PARTS = {"structural": S.clip("1 - (SELECT sum(count) FROM structural) / ((SELECT count(*) FROM cohort) * 14.0)"), "domain": "(SELECT avg(domain_score) FROM features)",
           "anomaly": f"1 - {QA.hits(QA.C_COLS)} / (SELECT count(*) FROM cohort)",
           "inconsistency": f"least((SELECT {S.clip('1 - sum(violations) / sum(checks)')} FROM rules), (SELECT 1 - count(*) FILTER (n_variants > 0) / count(*) FROM variants))",
           "schema_confidence": "(SELECT avg(role_confidence) FROM r)"}
WA = CONFIG["scoring"]["A"]
A_SCORE = "ascore AS (" + " UNION ALL ".join(f"SELECT '{k}' AS component, CAST({v} AS DOUBLE) AS score, CAST({WA[k]} AS DOUBLE) AS weight" for k, v in A_PARTS.items()) + ")"
A_CTES = (RANKED, QA.DOMAIN, QA.FEATURES, QA.RULES, VARIANTS, QA.CM, QA.CQ, A_SCORE)


def accuracy_components(s, d):
    p = profile(T.cohort(s, d, QA.ID_META, QA.PLAIN), infer=False)
    _, scores = accuracy_issues(p)
    values = {k: v.first()["score"] for k, v in scores.items()}
    found = anomaly.detect(p.ds, p.policies["transformer_augmented_routing"], p.sentinels, True)
    parts = {"structural": values["structural"], "domain": values["domain"], "anomaly": anomaly.anomaly_score(found.flags).first()["score"],
             "inconsistency": min(values["rules"], values["categories"]), "schema_confidence": p.semantic.agg(F.avg("role_confidence")).first()[0]}
    return s.range(1).select(F.inline(scoring.component_rows({k: F.lit(v) for k, v in parts.items()}, WA)))


add("accuracy_score", over("cohort", extra=A_CTES, select=S.finish("SELECT *, score * weight AS weighted_score FROM ascore", "score weight weighted_score")), accuracy_components)

# --- issues and triage ---------------------------------------------------------------------------
DOMAIN_ISSUES = ("SELECT 'A' AS dimension, 'domain' AS method, CASE kind WHEN 'allowed' THEN 'allowed_value_violation' ELSE 'range_violation' END AS issue_type, \"column\", violations AS count, "
                 "'high' AS severity, 'review' AS hitl_decision, rule FROM domain WHERE violations > 0")
RULE_ISSUES = "SELECT 'A', 'inconsistency', issue_type, \"column\", violations, severity, 'review', 'metadata consistency_rules' FROM rules WHERE violations > 0"
CATEGORY_ISSUES = ("SELECT 'A', 'inconsistency', 'inconsistent_category_encoding', \"column\", n_variants, 'medium', 'review', 'variants collapse to same category: ' || example FROM variants WHERE n_variants > 0")
ISSUES = ("issues AS (SELECT * FROM (" + QP.ISSUE_SQL + ") UNION ALL SELECT * FROM structural UNION ALL " + DOMAIN_ISSUES + " UNION ALL " + RULE_ISSUES + " UNION ALL " + CATEGORY_ISSUES
          + " UNION ALL SELECT 'R', 'privacy', 'low_k_anonymity_records', 'nation_code,segment,sex', CAST(round(" + QR.K_COHORT + " * (SELECT count(*) FROM cohort)) AS BIGINT), 'high', 'review', "
          "'declared QIs; records below k=5' WHERE " + QR.K_COHORT + " > 0 UNION ALL SELECT 'R', 'privacy', 'privacy_documentation_gap', NULL, 1, 'medium', 'documentation', 'privacy_documentation')")
I_CTES = (S.missing_table("cohort"), RANKED, QA.DOMAIN, QA.RULES, VARIANTS, ISSUES)


def all_issues(s, d):
    p = profile(T.cohort(s, d, QA.ID_META), infer=False)
    found, _ = accuracy_issues(p)
    miss = missing.missingness(p.ds, p.sentinels)
    return p, accuracy.union_issues([missing.completeness_issues(p.ds, miss), found, privacy.privacy_issues(p.ds, reuse.documentation_frame(p.ds))])


add("union_issues", over("cohort", extra=I_CTES, select=S.finish("SELECT * FROM issues", ints="count")), lambda s, d: all_issues(s, d)[1])
add("join_issue_role", over("cohort", extra=I_CTES, select=(
    "SELECT issue_type, i.\"column\", coalesce(r.role, 'unassigned/dataset-level') AS role FROM issues i LEFT JOIN r ON r.\"column\" = i.\"column\"")),
    lambda s, d: (lambda x: triage.with_roles(x[1], x[0].semantic).select("issue_type", "column", "role"))(all_issues(s, d)))

REASON = "CASE issue_type " + " ".join(f"WHEN {S.quote(k)} THEN {S.quote(v)}" for k, v in ISSUE_REASONS.items()) + f" ELSE {S.quote(DEFAULT_REASON)} END"
SENTENCE = ("CASE dimension WHEN 'C' THEN 'Completeness' WHEN 'A' THEN 'Accuracy' WHEN 'R' THEN 'Reuse readiness' ELSE 'Quality' END || ' issue ''' || replace(issue_type, '_', ' ') || ''' on column ''' || "
            "coalesce(nullif(\"column\", ''), '(dataset-level)') || ''' (semantic role: ' || role || '); triggered by ' || replace(method, '_', ' ') || ' [' || coalesce(nullif(rule, ''), 'configured check') || "
            f"'], affecting ' || CAST(count AS BIGINT) || ' value(s). Human review needed because ' || {REASON} || '; the engine does not auto-correct data.'")
REGISTER = f"""register AS (SELECT *, row_number() OVER (ORDER BY priority_score DESC, dimension, issue_type, "column" NULLS FIRST, rule) AS priority_rank,
  'true_issue | valid_extreme | false_positive | uncertain_requires_domain_review' AS suggested_decision_options, {SENTENCE} AS hitl_explanation FROM (
  SELECT i.*, coalesce(r.role, 'unassigned/dataset-level') AS role, CASE severity WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END + CASE WHEN coalesce({S.norm('i."column"')} = 'glucose', false) THEN 1 ELSE 0 END
   + CASE WHEN issue_type IN ('semantic_role_disagreement', 'low_semantic_role_confidence') THEN 1 ELSE 0 END + ln(1 + count) AS priority_score
  FROM issues i LEFT JOIN r ON r."column" = i."column"))"""


def register(s, d):
    p, issues = all_issues(s, d)
    return triage.triage_register(issues, p.semantic, p.ds.metadata, CONFIG, p.ds.name)


R_CTES = (*I_CTES, REGISTER)
add("triage_register", over("cohort", extra=R_CTES, select=S.finish(
    "SELECT 'cohort' AS dataset, priority_rank, dimension, method, issue_type, \"column\", count, severity, priority_score, rule, suggested_decision_options, hitl_explanation FROM register",
    "priority_score", "priority_rank count")), register)
add("triage_rank", over("cohort", extra=R_CTES, select=S.finish('SELECT priority_rank, dimension, issue_type, "column" FROM register', ints="priority_rank")),
    lambda s, d: register(s, d).select("priority_rank", "dimension", "issue_type", "column"))
add("fn_issue_explanation", over("cohort", extra=R_CTES, select='SELECT issue_type, "column", hitl_explanation FROM register'),
    lambda s, d: register(s, d).select("issue_type", "column", "hitl_explanation"))
add("top_triage", over("cohort", extra=R_CTES, select=S.finish('SELECT priority_rank, issue_type, "column", count FROM register WHERE priority_rank <= 5', ints="priority_rank count")),
    lambda s, d: triage.top_triage(register(s, d), 5).select("priority_rank", "issue_type", "column", "count"))
add("triage_summary", over("cohort", extra=I_CTES, select=S.finish(
    "SELECT dimension, count(*) AS n_issue_types, sum(count) AS total_count, count(*) FILTER (severity = 'high') AS high_severity FROM issues GROUP BY 1", ints="n_issue_types total_count high_severity")),
    lambda s, d: triage.triage_summary(all_issues(s, d)[1]))

# --- review sample -------------------------------------------------------------------------------
M = QA.M_COLS
SAMPLE = f"""tagged AS (SELECT m.row_id, e.ensemble_flag AS anomalous, {' OR '.join(f'm.{c} IS NULL' for c in M)} AS incomplete FROM measures m JOIN ens e USING (row_id)),
first AS (SELECT * FROM tagged WHERE anomalous ORDER BY row_id LIMIT 30),
second AS (SELECT * FROM tagged WHERE incomplete AND row_id NOT IN (SELECT row_id FROM first) ORDER BY row_id LIMIT 30),
third AS (SELECT * FROM tagged WHERE row_id NOT IN (SELECT row_id FROM first UNION ALL SELECT row_id FROM second) ORDER BY md5('42:' || row_id) LIMIT 30),
chosen AS (SELECT * FROM first UNION ALL SELECT * FROM second UNION ALL SELECT * FROM third)"""


def _sample(s, d):
    ds = T.measures(s, d, config=QA.PLAIN)
    out = triage.review_sample(ds, anomaly.detect(ds, M, {}, True).flags)
    values = F.from_json("row_values_json", ", ".join(f"{c} double" for c in M))               # the row's JSON, read back
    return out.withColumn("row", values).select(*[c for c in out.columns if c != "row_values_json"], "row.*")


add("review_sample", QA.m_sql(QA.QUANT, QA.FLAGS, QA.ENS, SAMPLE, select=(
    "SELECT row_id AS row_index, CASE WHEN anomalous AND incomplete THEN 'semantic_ai_anomaly_candidate+incomplete_record' WHEN anomalous THEN 'semantic_ai_anomaly_candidate' "
    "WHEN incomplete THEN 'incomplete_record' ELSE 'control_record' END AS candidate_source, '' AS manual_decision, 'true_issue | valid_extreme | false_positive | uncertain_requires_domain_review' AS allowed_decisions, "
    "'' AS reviewer, '' AS rationale, " + ", ".join(f"round(CAST({c} AS DOUBLE), 6) AS {c}" for c in M) + " FROM chosen JOIN measures USING (row_id)")), _sample)

# --- best detector, comparison, findings ---------------------------------------------------------
def _best(s, d):
    ds, bad, truth = QA.broken(s, d)
    n, parts = ds.df.count(), []
    found = at_once([lambda x=x: anomaly.detections(x, [(M, False), (M, True)], {}, n) for x in (ds, bad)])
    for method, before, after in zip(("generic_anomaly_delta", "semantic_hitl_anomaly_delta"), *found):
        m = injection.evaluate(before, after, truth)
        parts.append((method, m["precision"], m["recall"], m["f1"]))
    return scoring.best_detector(s.createDataFrame(parts, "method string, precision double, recall double, f1 double"))


LOOSE = QA.AFTER.replace("after AS", "after_loose AS").replace("f2.iqr AND f2.modified_z AND NOT (f.iqr AND f.modified_z)", "(f2.iqr_loose OR f2.modified_z_loose) AND NOT (f.iqr_loose OR f.modified_z_loose)")
METRIC = f"{S.div(QA.HIT, QA.PRED)} AS precision, {S.div(QA.HIT, QA.TRUE)} AS recall, {S.div(f'2 * {QA.HIT}', f'{QA.PRED} + {QA.TRUE}')} AS f1"
add("best_detector", QA.m_sql(*QA.ALL, LOOSE, select=S.finish(
    f"SELECT * FROM (SELECT 'generic_anomaly_delta' AS method, {METRIC} FROM after_loose UNION ALL SELECT 'semantic_hitl_anomaly_delta', {METRIC} FROM after) ORDER BY f1 DESC, method LIMIT 1", "precision recall f1")), _best)

COMPARE_CTES = (S.missing_table("cohort"), f"compared AS ({QP.COMPARE.replace('$', 'cohort').replace('@', S.quote('cohort'))})", QA.CM, QA.CQ)


def loose_hits(columns):
    keep, QA.M_COLS = QA.M_COLS, columns
    text = f"({QA.iqr_sql(1.5)}) OR ({QA.z_sql(3.5)})"
    QA.M_COLS = keep
    return f"(SELECT count(*) FILTER ({text}) FROM cm)"


def tables(s, d):
    """Profiles, anomaly policies, missingness and a reuse baseline of the cohort."""
    p = profile(T.cohort(s, d, {}, QA.PLAIN), infer=False)
    generic, semantic = anomaly.detections(p.ds, anomaly.both_policies(p.policies), p.sentinels)
    docs = QR._readiness(s, d).groupBy("method").agg(F.avg("R_score").alias("R_score"))
    return (p, roles.compare_profiles(p.semantic, p.uniform), anomaly.policy_comparison(s, generic, semantic),
            missing.missingness(p.ds, p.sentinels), docs)


REUSE_CTES = (*QR.DETAIL, QR.BASELINE, "docs AS (SELECT method, avg(R_score) AS R_score FROM baseline GROUP BY 1)")
PLAIN_R, HYBRID_R = "(SELECT R_score FROM docs WHERE method = 'metadata_checklist_only')", "(SELECT R_score FROM docs WHERE method <> 'metadata_checklist_only')"
GAIN = "(SELECT count(*) FROM cohort_miss WHERE semantic_adjustment_delta > 0)"
add("semantic_vs_uniform", over("cohort", extra=(*COMPARE_CTES, *REUSE_CTES), select=f"""
 SELECT 'variable_classification' AS comparison_aspect, count(*) FILTER (NOT role_changed_by_semantic_layer) || ' columns unchanged' AS uniform_view,
  count(*) FILTER (role_changed_by_semantic_layer) || ' columns reclassified by meaning' AS semantic_view, 'Semantic roles change which checks apply to reclassified variables.' AS effect FROM compared
 UNION ALL SELECT 'accuracy_anomaly_detection', '{len(QA.U_COLS)} cols, ' || {loose_hits(QA.U_COLS)} || ' rows flagged', '{len(QA.C_COLS)} cols, ' || {QA.hits(QA.C_COLS)} || ' rows flagged',
  'Semantic selection restricts detection to measurement-type variables and feeds HITL triage.'
 UNION ALL SELECT 'completeness_missingness', 'technical NaN only', {GAIN} || ' variables gain semantic-unusable burden', 'Semantic missing markers reprioritise completeness gaps.'
 UNION ALL SELECT 'reuse_readiness', 'checklist-only R=' || format('{{:.3f}}', {PLAIN_R}), 'four-facet hybrid R=' || format('{{:.3f}}', {HYBRID_R}), 'Text similarity, privacy and machine-readability refine the reuse score.'"""),
    lambda s, d: (lambda x: scoring.semantic_vs_uniform(x[1], x[2], x[3], x[4]))(tables(s, d)))

N_COHORT = "(SELECT count(*) FROM cohort)"
add("findings_effects", over("cohort", extra=(*COMPARE_CTES, *REUSE_CTES), select=S.finish(
    f"SELECT {len(QA.U_COLS)} AS generic_cols, {loose_hits(QA.U_COLS)} AS generic_rows, {loose_hits(QA.U_COLS)} / {N_COHORT} AS generic_rate, {len(QA.C_COLS)} AS semantic_cols, {QA.hits(QA.C_COLS)} AS semantic_rows, "
    f"{QA.hits(QA.C_COLS)} / {N_COHORT} AS semantic_rate, {GAIN} AS semantic_missing_vars, {PLAIN_R} AS reuse_checklist_only, {HYBRID_R} AS reuse_hybrid",
    "generic_rate semantic_rate reuse_checklist_only reuse_hybrid", "generic_cols generic_rows semantic_cols semantic_rows semantic_missing_vars")),
    lambda s, d: (lambda x: findings.effects(x[2], x[3], x[4]))(tables(s, d)))

SELECTION = f"selection AS ({QP.SELECTION})"
add("findings_check_counts", over("cohort", extra=(SELECTION,), select=S.finish(
    "SELECT count(*) AS n_variables, count(DISTINCT semantic_role) AS n_roles, " + ", ".join(f"count(*) FILTER ({c}) AS {n}" for n, c in findings.FLAGS.items()) + " FROM selection",
    ints="n_variables n_roles " + " ".join(findings.FLAGS))), lambda s, d: findings.check_counts(QP.selection(s, d)))
add("findings_role_counts", over("cohort", extra=(SELECTION,), select=S.finish("SELECT semantic_role, count(*) AS n_variables FROM selection GROUP BY 1", ints="n_variables")),
    lambda s, d: findings.role_counts(QP.selection(s, d)))


def _criteria(s, d):
    """The verdict over all tables, and over a run that left only an empty selection; of each criterion that can fail both answers are reached."""
    p, compared, policies, miss, docs = tables(s, d)
    score = missing.completeness_components(p.ds, p.sentinels).agg(X.clip01(F.sum("weighted_score")).alias("C(D)"))
    one = F.lit(1).alias("one")
    quality = (score.select("*", one).join(policies.agg(F.max("A_anomaly_score").alias("A(D)")).select("*", one), "one")
               .join(docs.agg(F.max("R_score").alias("R(D)")).select("*", one), "one").drop("one"))
    have = {"rq1_check_selection_map": QP.selection(s, d), "rq3_quality_profile": quality, "hitl_triage_register": register(s, d),
            "rq2_semantic_vs_uniform": scoring.semantic_vs_uniform(compared, policies, miss, docs), "anomaly_baseline_comparison": policies,
            "controlled_error_baseline": _best(s, d)}
    bare = {"rq1_check_selection_map": QP.selection(s, d).limit(0), "rq3_quality_profile": score}
    both = [findings.criteria(findings.criteria_met(x), s).withColumn("run", F.lit(name)) for name, x in (("complete", have), ("bare", bare))]
    return both[0].unionByName(both[1])


def criteria_sql(run: str, answers: dict[str, str]) -> str:
    return f"SELECT *, bool_and(met) OVER () AS aim_met, '{run}' AS run FROM (" + " UNION ALL ".join(
        f"SELECT {S.quote(k)} AS id, {S.quote(label)} AS label, {answers[k]} AS met" for k, label in findings.CRITERIA) + ")"


FOUND = {"RQ1": "(SELECT count(DISTINCT semantic_role) >= 1 FROM selection)", "RQ2": "(SELECT count(*) > 0 FROM selection)", "RQ3": "(SELECT count(*) > 0 FROM cohort)",
         "HITL": "(SELECT count(*) > 0 FROM cohort)", "EVAL": "(SELECT count(*) > 0 FROM measures)", "SCOPE": "true"}
add("findings_criteria", over("cohort", extra=(SELECTION, S.clean("measures")), select=criteria_sql("complete", FOUND) + " UNION ALL "
    + criteria_sql("bare", {k: "true" if k == "SCOPE" else "(SELECT count(*) < 0 FROM selection)" for k in FOUND})), _criteria)


# --- the profile of every dataset ----------------------------------------------------------------
def _profiles(s, d):
    parts = []
    for ds in (T.cohort(s, d), T.visits(s, d)):
        c = missing.completeness_components(ds, missing.sentinel_map(ds)).agg(X.clip01(F.sum("weighted_score")).alias("C(D)"))
        size = ds.df.agg(F.count("*").alias("rows")).first()["rows"]
        row = c.select(F.lit(ds.name).alias("dataset"), F.lit(size).cast("long").alias("rows"), F.lit(len(ds.columns)).alias("columns"), "C(D)")
        parts.append(row.withColumn("declared_quasi", F.lit(len(ds.metadata["quasi_identifiers"]))) if ds.metadata["quasi_identifiers"] else row)
    return union_profiles(parts)


add("catalog_profiles", over("cohort", "visits", extra=(*QP.MISS_CTES, QP.SCORE_CTE), select=S.finish(
    "SELECT dataset, CASE dataset WHEN 'cohort' THEN (SELECT count(*) FROM cohort) ELSE (SELECT count(*) FROM visits) END AS rows, CASE dataset WHEN 'cohort' THEN 14 ELSE 6 END AS columns, "
    "least(1.0, sum(score * weight)) AS \"C(D)\", CASE dataset WHEN 'cohort' THEN 3 END AS declared_quasi FROM completeness GROUP BY dataset", "C(D)", "rows columns declared_quasi")), _profiles)


def _quality(s, d):
    return assess(T.cohort(s, d), evaluate=False)["rq3_quality_profile"]


add("quality_profile", None, _quality)
