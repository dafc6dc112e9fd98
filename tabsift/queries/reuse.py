"""Queries of documentation evidence and reuse readiness; every document counts as one dataset's documentation."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabsift.config import CONFIG, DOCUMENTATION_COMPONENTS, STANDARDISATION_COMPONENTS, STOP_WORDS
from tabsift.operators import privacy, reuse
from tabsift.plans.assess import profile
from tabsift.queries import fixtures as T, sqltext as S
from tabsift.queries.profiling import EMPTY, both, labelled, over
from tabsift.queries.shapes import rounded

QUERIES, ORACLES = {}, {}


def add(name, sql, run):
    QUERIES[name] = lambda spark, folder: rounded(run(spark, folder))
    if sql is not None:
        ORACLES[name] = sql


def documents(s, d):
    return T.table(s, d, "documents").select("doc_id", "text")


# --- text similarity -----------------------------------------------------------------------------
TF = ("tf AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]{2,}')) AS term FROM documents) "
      f"WHERE term NOT IN {S.names(STOP_WORDS)} GROUP BY 1, 2)")


def tfidf_sql(components: dict, label: str) -> str:
    """CTE ``label`` (doc_id, component, text_similarity), from the definition of the weights."""
    n = 1 + len(components)
    prompts = reuse.prompt_terms(components)
    rows = ", ".join(f"({S.quote(c)}, {S.quote(t)}, {k})" for c, p in prompts.items() for t, k in p.items())
    idf = f"(ln((1.0 + {n}) / (1.0 + {{}})) + 1)"
    return f"""{label}_prompt AS (SELECT * FROM (VALUES {rows}) p(component, term, tf)),
{label}_df AS (SELECT term, count(DISTINCT component) AS df FROM {label}_prompt GROUP BY 1),
{label}_norm AS (SELECT doc_id, sqrt(sum(pow(tf * {idf.format('coalesce(df, 0) + 1')}, 2))) AS norm FROM tf LEFT JOIN {label}_df USING (term) GROUP BY 1),
{label}_pair AS (SELECT d.doc_id, p.component, p.tf AS ptf, {idf.format('df + CASE WHEN t.tf IS NULL THEN 0 ELSE 1 END')} AS idf, coalesce(t.tf, 0) AS dtf
  FROM (SELECT doc_id FROM documents) d CROSS JOIN {label}_prompt p JOIN {label}_df USING (term) LEFT JOIN tf t ON t.doc_id = d.doc_id AND t.term = p.term),
{label} AS (SELECT a.doc_id, component, coalesce(sum(ptf * dtf * idf * idf) / (sqrt(sum(pow(ptf * idf, 2))) * any_value(norm)), 0) AS text_similarity
  FROM {label}_pair a LEFT JOIN {label}_norm b ON a.doc_id = b.doc_id GROUP BY 1, 2)"""


DOC_SIM, STD_SIM = tfidf_sql(DOCUMENTATION_COMPONENTS, "docsim"), tfidf_sql(STANDARDISATION_COMPONENTS, "stdsim")
add("tfidf_similarity", S.with_ctes(TF, DOC_SIM, STD_SIM, select=S.finish("SELECT * FROM docsim UNION ALL SELECT * FROM stdsim", "text_similarity")),
    lambda s, d: reuse.tfidf_similarity(documents(s, d), DOCUMENTATION_COMPONENTS).unionByName(reuse.tfidf_similarity(documents(s, d), STANDARDISATION_COMPONENTS)))

# --- checklist and hybrid facet ------------------------------------------------------------------
def checklist_sql(components):
    return " UNION ALL ".join("SELECT doc_id, " + S.quote(c) + " AS component, CAST(CASE WHEN " + " OR ".join(
        f"contains(lower(text), {S.quote(k)})" for k in spec["keywords"]) + " THEN 1 ELSE 0 END AS DOUBLE) AS checklist FROM documents" for c, spec in components.items())


add("checklist_keywords", checklist_sql(DOCUMENTATION_COMPONENTS) + " UNION ALL " + checklist_sql(STANDARDISATION_COMPONENTS),
    lambda s, d: reuse.checklist(documents(s, d), DOCUMENTATION_COMPONENTS).unionByName(reuse.checklist(documents(s, d), STANDARDISATION_COMPONENTS)))

FLAGS = {"reuse_readiness": {"licence_or_usage_conditions": True, "provenance_or_etl": 0.5}, "variable_descriptions": {}}


def detail_sql(components, sim, label):
    flags = {"licence_or_usage_conditions": 1.0, "provenance_or_etl": 0.5, "variable_descriptions": 0.0}
    known = {c: v for c, v in flags.items() if c in components}
    case = "CASE component " + " ".join(f"WHEN {S.quote(c)} THEN CAST({v} AS DOUBLE)" for c, v in known.items()) + " ELSE checklist END" if known else "checklist"
    source = f"CASE WHEN component IN {S.names(list(known))} THEN 'metadata_flag' ELSE 'checklist' END" if known else "'checklist'"
    score = S.clip("(text_similarity - 0.05) / 0.4")
    return (f"{label} AS (SELECT doc_id, component, rule_score, rule_source, text_similarity, {score} AS text_score, 'tfidf_cosine_similarity' AS text_method, "
            f"0.55 * rule_score + 0.45 * {score} AS hybrid_component_score FROM (SELECT doc_id, component, {case} AS rule_score, {source} AS rule_source FROM ({checklist_sql(components)})) "
            f"LEFT JOIN {sim} USING (doc_id, component))")


DETAIL = (TF, DOC_SIM, STD_SIM, detail_sql(DOCUMENTATION_COMPONENTS, "docsim", "docdet"), detail_sql(STANDARDISATION_COMPONENTS, "stdsim", "stddet"))


def detail(s, d, components):
    return reuse.hybrid_detail(reuse.rule_scores(documents(s, d), components, FLAGS, CONFIG), reuse.text_scores(documents(s, d), components, CONFIG), CONFIG)


def details(s, d):
    """The details of both facets, from one count of the texts' words."""
    rows = documents(s, d)
    texts = reuse.facet_text_scores(rows, reuse.FACETS, CONFIG)
    return {name: reuse.hybrid_detail(reuse.rule_scores(rows, c, FLAGS, CONFIG), texts[name], CONFIG) for name, c in reuse.FACETS.items()}


DETAIL_D = "rule_score text_similarity text_score hybrid_component_score"
add("join_rule_text_scores", S.with_ctes(*DETAIL, select=S.finish("SELECT * FROM docdet", DETAIL_D)), lambda s, d: detail(s, d, DOCUMENTATION_COMPONENTS))
add("union_reuse_detail", S.with_ctes(*DETAIL, select=S.finish("SELECT *, 'documentation' AS facet FROM docdet UNION ALL SELECT *, 'standardisation' FROM stddet", DETAIL_D)),
    lambda s, d: reuse.union_details(details(s, d)))


def facet_sql(label):
    return (f"SELECT doc_id, {S.clip('avg(hybrid_component_score)')} AS score, avg(rule_score) AS rule_mean, count(*) FILTER (rule_score < 1) AS n_missing, "
            f"coalesce(string_agg(component, ', ' ORDER BY component) FILTER (rule_score < 1), '') AS missing FROM {label} GROUP BY 1")


add("hybrid_facet", S.with_ctes(*DETAIL, select=S.finish(
    f"SELECT *, CASE WHEN n_missing = 0 THEN 'none' WHEN score >= 0.34 THEN 'medium' ELSE 'high' END AS severity FROM ({facet_sql('docdet')})", "score rule_mean", "n_missing")),
    lambda s, d: reuse.hybrid_facet(detail(s, d, DOCUMENTATION_COMPONENTS)).withColumn(
        "severity", F.when(F.col("n_missing") == 0, "none").when(F.col("score") >= 0.34, "medium").otherwise("high")))
add("facet_issues", S.with_ctes(*DETAIL, select=S.finish(
    "SELECT 'R' AS dimension, 'metadata_checklist' AS method, 'standardisation_gaps' AS issue_type, NULL::VARCHAR AS \"column\", n_missing AS count, "
    f"CASE WHEN score >= 0.34 THEN 'medium' ELSE 'high' END AS severity, 'documentation' AS hitl_decision, 'missing: ' || missing AS rule FROM ({facet_sql('stddet')}) WHERE n_missing > 0", ints="count")),
    lambda s, d: reuse.facet_issues(reuse.hybrid_facet(detail(s, d, STANDARDISATION_COMPONENTS)), "standardisation"))


def blanked(s, d):
    return T.table(s, d, "documents").select("doc_id", F.when(F.col("doc_id") % 5 == 0, "  ").otherwise(F.col("text")).alias("text"))


BLANK = tfidf_sql(DOCUMENTATION_COMPONENTS, "docsim").replace("FROM documents", "FROM blanked")
add("no_documentation", S.with_ctes("blanked AS (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN '  ' ELSE text END AS text FROM documents)", TF.replace("FROM documents", "FROM blanked"), BLANK, select=S.finish(
    f"SELECT doc_id, component, text_similarity, CASE WHEN doc_id % 5 = 0 THEN 0.0 ELSE {S.clip('(text_similarity - 0.05) / 0.4')} END AS text_score, "
    "CASE WHEN doc_id % 5 = 0 THEN 'not_applied_no_documentation' ELSE 'tfidf_cosine_similarity' END AS text_method FROM docsim", "text_similarity text_score")),
    lambda s, d: reuse.text_scores(blanked(s, d), DOCUMENTATION_COMPONENTS, CONFIG))

# --- vectors -------------------------------------------------------------------------------------
NAMES = list(DOCUMENTATION_COMPONENTS)


def prompt_vectors(s, d):
    """Mean vector per component; labels are dealt out over the components."""
    rows = (T.table(s, d, "embeddings").select((F.col("label") % len(NAMES)).alias("label"), F.posexplode("embedding").alias("pos", "x"))
            .groupBy("label", "pos").agg(F.avg(F.col("x").cast("double")).alias("x")).orderBy("label", "pos").collect())
    out: dict[str, list[float]] = {}
    for r in rows:
        out.setdefault(NAMES[r["label"]], []).append(r["x"])
    return out


EMB = f"""proto AS (SELECT label, list(x ORDER BY pos) AS v FROM (SELECT label, pos, avg(CAST(embedding[pos] AS DOUBLE)) AS x FROM (SELECT embedding, label % {len(NAMES)} AS label FROM embeddings),
  (SELECT unnest(range(1, 65)) AS pos) GROUP BY 1, 2) GROUP BY label),
comp AS (SELECT unnest({NAMES}) AS component, unnest(range(0, {len(NAMES)})) AS label),
embsim AS (SELECT vec_id AS doc_id, component, list_cosine_similarity(CAST(embedding AS DOUBLE[]), v) AS text_similarity FROM embeddings, proto JOIN comp ON proto.label = comp.label)"""


def embedded(s, d):
    return reuse.embedding_scores(T.table(s, d, "embeddings").withColumnRenamed("vec_id", "doc_id"), "embedding", prompt_vectors(s, d), CONFIG)


add("embedding_doc_similarity", S.with_ctes(EMB, select=S.finish(
    f"SELECT *, {S.clip('(text_similarity - 0.15) / 0.4')} AS text_score, 'embedding_cosine_similarity' AS text_method FROM embsim", "text_similarity text_score")), embedded)


def _precedence(s, d):
    """Labelled documents carry a logit, others a vector where one exists, the rest only TF-IDF."""
    logits = T.table(s, d, "labels").select("doc_id", (F.col("quality") * 6.0 - 2.0 - F.col("toxic")).alias("logit"))
    vectors = embedded(s, d).select("doc_id", "component", F.col("text_similarity").alias("embedding"))
    sims = reuse.tfidf_similarity(documents(s, d), DOCUMENTATION_COMPONENTS)
    best = sims.join(logits, "doc_id", "left").join(vectors, ["doc_id", "component"], "left")
    score, method = reuse.similarity_precedence(F.col("logit"), F.col("embedding"), F.col("text_similarity"), CONFIG)
    return best.select("doc_id", "component", score.alias("text_score"), method.alias("text_method"))


add("similarity_precedence", S.with_ctes(TF, DOC_SIM, EMB, select=S.finish(f"""SELECT t.doc_id, t.component,
  CASE WHEN l.doc_id IS NOT NULL THEN 1 / (1 + exp(-(quality * 6.0 - 2.0 - toxic) / 4)) WHEN e.doc_id IS NOT NULL THEN {S.clip('(e.text_similarity - 0.15) / 0.4')}
    ELSE {S.clip('(t.text_similarity - 0.05) / 0.4')} END AS text_score,
  CASE WHEN l.doc_id IS NOT NULL THEN 'cross_encoder_reranking' WHEN e.doc_id IS NOT NULL THEN 'embedding_cosine_similarity' ELSE 'tfidf_cosine_similarity' END AS text_method
  FROM docsim t LEFT JOIN labels l USING (doc_id) LEFT JOIN embsim e ON e.doc_id = t.doc_id AND e.component = t.component""", "text_score")), _precedence)

# --- proposals, privacy, machine readability, totals ---------------------------------------------
def proposals(s, d):
    return T.table(s, d, "labels").select("doc_id", F.lit("units_or_value_labels").alias("component"), F.when(F.col("toxic") == 0, "proposed").otherwise("failed").alias("status"),
                                          F.col("quality").alias("present"))


def _confirmed(s, d):
    return reuse.rule_scores(documents(s, d), DOCUMENTATION_COMPONENTS, EMPTY, CONFIG, reuse.confirmed_proposals(proposals(s, d), True))


add("confirmed_proposals", f"""SELECT c.doc_id, component, CASE WHEN l.doc_id IS NOT NULL THEN 1.0 ELSE checklist END AS rule_score,
  CASE WHEN l.doc_id IS NOT NULL THEN 'llm_confirmed' ELSE 'checklist' END AS rule_source FROM ({checklist_sql(DOCUMENTATION_COMPONENTS)}) c
  LEFT JOIN (SELECT doc_id FROM labels WHERE toxic = 0 AND quality = 1) l ON l.doc_id = c.doc_id AND component = 'units_or_value_labels'""", _confirmed)

K_COHORT = "(SELECT coalesce(sum(n) FILTER (n < 5), 0) / sum(n) FROM (SELECT count(*) AS n FROM cohort GROUP BY nation_code, segment, sex))"


def _privacy(s, d):
    ds = T.cohort(s, d, {**T.COHORT_METADATA, "direct_identifiers": ["subject_id"], "documentation_text": "privacy reviewed"})
    doc = reuse.documentation_frame(ds)
    return privacy.privacy_components(ds, doc)


add("privacy_facet", S.with_ctes(S.clean("cohort"), select=S.finish(
    f"SELECT *, score * weight AS weighted_score FROM (SELECT 'direct_identifier_handling' AS component, 0.0 AS score, 0.4 AS weight UNION ALL "
    f"SELECT 'k_anonymity', 1 - least({K_COHORT}, 0.5) / 0.5, 0.4 UNION ALL SELECT 'privacy_documentation', 1.0, 0.2)", "score weight weighted_score")), _privacy)


def _privacy_issues(s, d):
    ds = T.cohort(s, d, {**T.COHORT_METADATA, "direct_identifiers": ["subject_id"]})
    return privacy.privacy_issues(ds, reuse.documentation_frame(ds))


add("privacy_issues", S.with_ctes(S.clean("cohort"), select=S.finish(
    f"""SELECT 'R' AS dimension, 'privacy' AS method, 'direct_identifier_present' AS issue_type, 'subject_id' AS "column", 1 AS count, 'high' AS severity, 'review' AS hitl_decision, 'metadata direct identifiers' AS rule
    UNION ALL SELECT 'R', 'privacy', 'low_k_anonymity_records', 'nation_code,segment,sex', round({K_COHORT} * (SELECT count(*) FROM cohort)), 'high', 'review', 'declared QIs; records below k=5' WHERE {K_COHORT} > 0
    UNION ALL SELECT 'R', 'privacy', 'privacy_documentation_gap', NULL, 1, 'medium', 'documentation', 'privacy_documentation'""", ints="count")), _privacy_issues)

MACHINE = (f"SELECT @ AS dataset, avg(CASE WHEN role_confidence >= 0.65 THEN 1.0 ELSE 0.0 END) AS typed, 1 - avg(CASE WHEN role IN ('mixed_numeric_requires_review', 'free_text_or_high_cardinality') "
           f"THEN 1.0 ELSE 0.0 END) AS parsed FROM (SELECT {S.role_columns(S.rule_cases())} FROM $_stats)")
#: Headers that a reader made up, and one that occurs twice, beside the cohort's own; the file was no UTF-8.
MESSY = ["_c3", "Unnamed: 7", "unnamed", "age"]


def _machine(ds):
    profiled = profile(ds, infer=False).semantic
    clean = reuse.machine_readability(profiled, ds.columns, "utf8", CONFIG).withColumn("header", F.lit("clean"))
    return clean.unionByName(reuse.machine_readability(profiled, [*ds.columns, *MESSY], "non_utf8_latin1_fallback", CONFIG).withColumn("header", F.lit("messy")))


def machine_sql(header: str, clean: str) -> str:
    return " UNION ALL ".join(f"SELECT dataset, '{header}' AS header, '{c}' AS component, CAST({v} AS DOUBLE) AS score, {w} AS weight FROM ({both(MACHINE)})"
                              for c, v, w in (("confident_typing", "typed", 0.4), ("clean_headers", clean, 0.3), ("parseable_values", "parsed", 0.3)))


# three headers have no name of their own; the fourth is the cohort's age again, but new to the visits
MESSY_SQL = "CASE dataset WHEN 'cohort' THEN 0.9 * (1 - 4 / 18) ELSE 0.9 * (1 - 3 / 10) END"
add("machine_readability", over("cohort", "visits", select=S.finish(
    f"SELECT dataset, header, component, score, weight, score * weight AS weighted_score FROM ({machine_sql('clean', '1.0')} UNION ALL {machine_sql('messy', MESSY_SQL)})", "score weight weighted_score")),
    labelled(_machine))


def _readiness(s, d):
    """Reuse score per document, with the cohort's privacy score for all of them."""
    found = details(s, d)
    doc, std = (reuse.hybrid_facet(found[c]).select("doc_id", F.col("score").alias(f"{n}_score"), F.col("rule_mean").alias(f"{n}_rule"))
                for n, c in (("doc", "documentation"), ("std", "standardisation")))
    k = privacy.k_anonymity(T.cohort(s, d).df, ["nation_code", "segment", "sex"], CONFIG).first()["k_score"]
    merged = doc.join(std, "doc_id")
    rows = reuse.readiness_baseline(F.col("doc_score"), F.col("std_score"), F.col("doc_rule"), F.col("std_rule"), F.lit(0.4 + 0.4 * k), F.lit(1.0), CONFIG)
    return merged.select("doc_id", F.inline(rows))


PRIV = f"(0.4 + 0.4 * (1 - least({K_COHORT}, 0.5) / 0.5))"
BASELINE = f"""baseline AS (SELECT a.doc_id, method, CASE method WHEN 'metadata_checklist_only' THEN {S.clip(f'0.4 * a.rule_mean + 0.2 * b.rule_mean + 0.25 * {PRIV} + 0.15')}
   ELSE {S.clip(f'0.4 * a.score + 0.2 * b.score + 0.25 * {PRIV} + 0.15')} END AS R_score,
  CASE method WHEN 'metadata_checklist_only' THEN 'Rule-based metadata completeness only (no text similarity).'
   ELSE 'Four-facet hybrid: checklist + TF-IDF text similarity + k-anonymity + machine-readability.' END AS description
  FROM ({facet_sql('docdet')}) a JOIN ({facet_sql('stddet')}) b USING (doc_id),
  (SELECT unnest(['metadata_checklist_only', 'hybrid_documentation_standardisation_privacy_machine_readability']) AS method))"""
add("reuse_readiness", S.with_ctes(S.clean("cohort"), *DETAIL, BASELINE, select=S.finish("SELECT * FROM baseline", "R_score")), _readiness)
