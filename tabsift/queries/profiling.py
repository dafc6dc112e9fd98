"""Queries of completeness, column statistics, roles and automatic metadata."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from tabsift.config import ANOMALY_ROLES, CONFIG
from tabsift.functions import exprs as X
from tabsift.operators import frequency, missing, roles, scoring
from tabsift.plans.assess import profile
from tabsift.queries import fixtures as T, sqltext as S
from tabsift.queries.shapes import rounded

QUERIES, ORACLES = {}, {}
CFG = CONFIG
EMPTY: dict = {}


def add(name, sql, run):
    QUERIES[name] = lambda spark, folder: rounded(run(spark, folder))
    if sql is not None:
        ORACLES[name] = sql


def over(*names, select, extra=()):
    parts = [c for n in names for c in (S.clean(n), S.statistics(n))]
    return S.with_ctes(*parts, *extra, select=select)


def both(sql: str, names=("cohort", "visits")) -> str:
    """The same select over each dataset, labelled."""
    return " UNION ALL ".join(sql.replace("$", n).replace("@", S.quote(n)) for n in names)


def stats_of(dataset, metadata=EMPTY):
    return lambda s, d: roles.column_stats(dataset(s, d, metadata))[0]


def labelled(run, *more):
    """Cohort and visits (and ``more``) together, with a dataset label."""
    def go(s, d):
        parts = [run(ds).select(F.lit(ds.name).alias("dataset"), "*") for ds in (T.cohort(s, d, EMPTY), T.visits(s, d), *(f(s, d) for f in more))]
        return reduce(lambda a, b: a.unionByName(b), parts)
    return go


def miss_of(ds):
    return missing.missingness(ds, missing.sentinel_map(ds))


# --- markers and missingness ---------------------------------------------------------------------
add("norm_technical_missing", S.with_ctes(S.clean("cohort"), select=S.finish("SELECT row_id, " + ", ".join(S.DATASETS["cohort"]["columns"]) + " FROM cohort", "balance_value")),
    lambda s, d: T.cohort(s, d).df.select("row_id", *S.DATASETS["cohort"]["columns"]))


def _mask(s, d):
    ds = T.cohort(s, d)
    codes = missing.sentinel_map(ds)
    return ds.df.select("row_id", *[missing.unusable(ds, c, codes).alias(c) for c in S.DATASETS["cohort"]["columns"]])


add("semantic_unusable_mask", over("cohort", select="SELECT row_id, " + ", ".join(
    f"{S.unusable('cohort', c)} AS {c}" for c in S.DATASETS["cohort"]["columns"]) + " FROM cohort"), _mask)


def as_decimal(column: str):
    """Balances as decimals, as engines print doubles in ways of their own; other values as they are."""
    return F.when(F.col("column") == "balance_value", F.col(column).try_cast("decimal(20,2)").cast("string")).otherwise(F.col(column)).alias(column)


def decimal_sql(column: str) -> str:
    return f"CASE WHEN \"column\" = 'balance_value' THEN CAST(TRY_CAST({column} AS DECIMAL(20,2)) AS VARCHAR) ELSE {column} END AS {column}"


#: Balances with all their digits, written without exponent and trailing zeros; what no decimal holds stays as it is, and so does any other token.
EXACT = "CASE WHEN \"column\" = 'balance_value' THEN coalesce(regexp_replace(CAST(TRY_CAST(token AS DECIMAL(38,14)) AS {text}), '[.]?0+$', ''), token) ELSE token END"


add("value_counts", over("cohort", select=S.finish(f'SELECT "column", {EXACT.format(text="VARCHAR")} AS token, freq FROM (SELECT "column", norm AS token, sum(freq) AS freq FROM cohort_val WHERE value IS NOT NULL GROUP BY 1, 2)', ints="freq")),
    lambda s, d: frequency.value_counts(T.cohort(s, d)).select("column", F.expr(EXACT.format(text="STRING").replace('"column"', "`column`")).alias("token"), "freq"))

PROFILE = ('SELECT @ AS dataset, "column", missing_count, ' + S.div("missing_count", "n_rows") + " AS missing_rate, distinct_count AS unique_count, "
           + S.div("distinct_count", "n_rows") + " AS unique_rate, " + S.div("strict_count", "non_missing") + " AS non_missing_numeric_rate FROM $_stats")


def _measures(ds):
    m = frequency.column_measures(ds)
    n = F.col("n_rows")
    return m.select("column", "missing_count", X.safe_div(F.col("missing_count"), n).alias("missing_rate"), F.col("distinct_count").alias("unique_count"),
                    X.safe_div(F.col("distinct_count"), n).alias("unique_rate"),
                    X.safe_div(F.col("strict_count"), F.col("non_missing")).alias("non_missing_numeric_rate"))


add("profile_columns", over("cohort", "visits", select=S.finish(both(PROFILE), "missing_rate unique_rate non_missing_numeric_rate", "missing_count unique_count")),
    labelled(_measures))

MISS = ('SELECT @ AS dataset, "column", n_rows, technical_missing, semantic_unusable, total_unusable, technical_missing_rate, '
        'semantic_adjusted_unusable_rate, semantic_adjustment_delta FROM $_miss')
MISS_D = "technical_missing_rate semantic_adjusted_unusable_rate semantic_adjustment_delta"
MISS_I = "n_rows technical_missing semantic_unusable total_unusable"
MISS_CTES = (S.missing_table("cohort"), S.missing_table("visits"))
add("missingness_profile", over("cohort", "visits", extra=MISS_CTES, select=S.finish(both(MISS), MISS_D, MISS_I)),
    labelled(lambda ds: miss_of(ds).drop("ordinal")))

add("completeness_cells", over("cohort", "visits", extra=MISS_CTES, select=S.finish(both(
    f"SELECT @ AS dataset, 1 - {S.div('sum(technical_missing)', 'sum(n_rows)')} AS technical_cell, 1 - {S.div('sum(total_unusable)', 'sum(n_rows)')} AS semantic_cell FROM $_miss"),
    "technical_cell semantic_cell")), labelled(lambda ds: missing.cell_completeness(miss_of(ds))))


def _fields(s, d):
    ds = T.cohort(s, d)
    miss = miss_of(ds)
    required, critical, _ = missing.declared(ds)
    parts = [missing.field_completeness(miss, c).select(F.lit(k).alias("component"), "score") for k, c in (("required_fields", required), ("critical_fields", critical))]
    return parts[0].unionByName(parts[1])


def _required_sql(cols, n):
    return f"1 - {S.div('sum(total_unusable)', f'max(n_rows) * {n}')} AS score FROM cohort_miss WHERE \"column\" IN {S.names(cols)}"


add("completeness_required_critical", over("cohort", extra=(S.missing_table("cohort"),), select=S.finish(
    f"SELECT 'required_fields' AS component, {_required_sql(['age', 'glucose'], 2)} UNION ALL SELECT 'critical_fields', {_required_sql(['glucose'], 1)}", "score")), _fields)

add("join_required_fields", over("cohort", extra=(S.missing_table("cohort"),), select=S.finish(
    "SELECT \"column\", total_unusable FROM cohort_miss WHERE \"column\" IN ('age', 'glucose')", ints="total_unusable")),
    lambda s, d: miss_of(T.cohort(s, d)).join(F.broadcast(s.createDataFrame([("age",), ("glucose",)], "column string")), "column", "left_semi")
    .select("column", "total_unusable"))

BAD_ROWS = {n: "count(*) FILTER (" + " OR ".join(f"{c} IS NULL OR {S.unusable(n, c)}" for c in S.DATASETS[n]["columns"]) + ")" for n in ("cohort", "visits")}


def _rows(ds):
    r = missing.incomplete_rows(ds, missing.sentinel_map(ds))
    return r.withColumn("complete_rows", 1 - X.safe_div(F.col("incomplete_rows"), F.col("n_rows")))


add("completeness_rows", over("cohort", "visits", select=S.finish(" UNION ALL ".join(
    f"SELECT '{n}' AS dataset, count(*) AS n_rows, {b} AS incomplete_rows, 1 - {S.div(b, 'count(*)')} AS complete_rows FROM {n}" for n, b in BAD_ROWS.items()),
    "complete_rows", "n_rows incomplete_rows")), labelled(_rows))

add("detect_sentinels", over("cohort", "visits", select=S.finish(both('SELECT @ AS dataset, "column", token, freq FROM $_sentinels'), ints="freq")),
    labelled(missing.detect_sentinels))

add("known_marker_difference", over("cohort", "visits", select=both(
    f'SELECT @ AS dataset, "column", token FROM $_codes WHERE token NOT IN {S.names(sorted({m.strip().lower() for m in S.TECHNICAL_MARKERS + S.SEMANTIC_MARKERS}))} '
    'AND "column" IN (SELECT "column" FROM $_accepted)')), labelled(lambda ds: missing.detect_sentinels(ds).select("column", "token")))

add("antijoin_sentinel_values", over("cohort", select=f'SELECT row_id, "column", {decimal_sql("value")} FROM (' + " UNION ALL ".join(
    f"SELECT row_id, '{c}' AS \"column\", CAST({c} AS VARCHAR) AS value FROM cohort WHERE {c} IS NOT NULL AND {S.norm(f'CAST({c} AS VARCHAR)')} NOT IN (SELECT token FROM cohort_sentinels WHERE \"column\" = '{c}')"
    for c in S.DATASETS["cohort"]["columns"]) + ")"),
    lambda s, d: missing.without_sentinels(T.cohort(s, d), missing.detect_sentinels(T.cohort(s, d)), S.DATASETS["cohort"]["columns"]).select("row_id", "column", as_decimal("value")))

NUMBERS = S.DATASETS["cohort"]["columns"]
add("fn_numeric_series", over("cohort", select="SELECT row_id, " + ", ".join(
    f"round(CASE WHEN {S.norm(f'CAST({c} AS VARCHAR)')} IN (SELECT token FROM cohort_sentinels WHERE \"column\" = '{c}') THEN NULL ELSE {S.loose(c) if c in S.DATASETS['cohort']['text'] else f'CAST({c} AS DOUBLE)'} END, 6) AS {c}"
    for c in NUMBERS) + " FROM cohort"), lambda s, d: _numeric(T.cohort(s, d)))


def _numeric(ds):
    codes = missing.sentinel_map(ds)
    return ds.df.select("row_id", *[missing.usable_number(ds, c, codes).alias(c) for c in NUMBERS])


W = CFG["scoring"]["C"]


def _score_sql(n, required, critical):
    def field(cols):
        return f"(SELECT 1 - {S.div('sum(total_unusable)', f'max(n_rows) * {len(cols)}')} FROM {n}_miss WHERE \"column\" IN {S.names(cols)})"
    parts = {"technical_cell": f"(SELECT 1 - {S.div('sum(technical_missing)', 'sum(n_rows)')} FROM {n}_miss)",
             "semantic_cell": f"(SELECT 1 - {S.div('sum(total_unusable)', 'sum(n_rows)')} FROM {n}_miss)",
             "required_fields": field(required), "critical_fields": field(critical),
             "complete_rows": f"(SELECT 1 - {S.div(BAD_ROWS[n], 'count(*)')} FROM {n})"}
    return " UNION ALL ".join(f"SELECT '{n}' AS dataset, '{k}' AS component, {S.clip(v)} AS score, CAST({W[k]} AS DOUBLE) AS weight" for k, v in parts.items())


SCORE_CTE = "completeness AS (" + _score_sql("cohort", ["age", "glucose"], ["glucose"]) + " UNION ALL " + _score_sql(
    "visits", S.DATASETS["visits"]["columns"], S.DATASETS["visits"]["columns"]) + ")"


def _components(s, d):
    parts = []
    for ds in (T.cohort(s, d), T.visits(s, d)):
        parts.append(missing.completeness_components(ds, missing.sentinel_map(ds)).select(F.lit(ds.name).alias("dataset"), "*"))
    return parts[0].unionByName(parts[1])


add("completeness_score", over("cohort", "visits", extra=(*MISS_CTES, SCORE_CTE), select=S.finish(
    "SELECT dataset, component, score, weight, score * weight AS weighted_score FROM completeness", "score weight weighted_score")), _components)

ISSUE_SQL = """SELECT 'C' AS dimension, 'completeness' AS method, issue_type, "column",
 CASE issue_type WHEN 'semantic_unusable_values' THEN semantic_unusable ELSE total_unusable END AS count,
 CASE issue_type WHEN 'critical_field_missingness' THEN 'high' WHEN 'semantic_unusable_values' THEN 'medium'
   ELSE CASE WHEN semantic_adjusted_unusable_rate >= 0.40 THEN 'high' ELSE 'medium' END END AS severity, 'review' AS hitl_decision,
 CASE issue_type WHEN 'critical_field_missingness' THEN 'metadata critical_fields' WHEN 'semantic_unusable_values' THEN 'config semantic_missing_markers'
   ELSE 'auto: >=20% missing' END AS rule
 FROM (SELECT *, CASE WHEN "column" = 'glucose' AND semantic_adjusted_unusable_rate > 0 THEN 'critical_field_missingness'
   WHEN semantic_adjustment_delta > 0 THEN 'semantic_unusable_values' WHEN semantic_adjusted_unusable_rate >= 0.20 THEN 'high_missingness' END AS issue_type
   FROM cohort_miss) WHERE issue_type IS NOT NULL"""
add("completeness_issues", over("cohort", extra=(S.missing_table("cohort"),), select=S.finish(ISSUE_SQL, ints="count")),
    lambda s, d: missing.completeness_issues(T.cohort(s, d), miss_of(T.cohort(s, d))))
add("issue_record", over("visits", extra=(S.missing_table("visits"),), select=S.finish(
    ISSUE_SQL.replace("cohort_miss", "visits_miss").replace("\"column\" = 'glucose'", "false"), ints="count")),
    lambda s, d: missing.completeness_issues(T.visits(s, d), miss_of(T.visits(s, d))))

add("missingness_effect", over("cohort", extra=(S.missing_table("cohort"),), select=S.finish(
    'SELECT "column", technical_missing, semantic_unusable, total_unusable, technical_missing_rate, semantic_adjusted_unusable_rate, semantic_adjustment_delta, '
    "'generic_missingness_vs_semantic_adjustment' AS baseline, CASE WHEN semantic_adjustment_delta > 0 THEN 'Semantic missing markers increase the unusable-value burden for this variable.' "
    "ELSE 'No semantic missingness adjustment for this variable.' END AS interpretation FROM cohort_miss", MISS_D, "technical_missing semantic_unusable total_unusable")),
    lambda s, d: missing.missingness_effect(miss_of(T.cohort(s, d))))

add("top_missing", over("cohort", extra=(S.missing_table("cohort"),), select=S.finish(
    'SELECT "column", semantic_adjusted_unusable_rate FROM cohort_miss ORDER BY semantic_adjusted_unusable_rate DESC, ordinal LIMIT 3', "semantic_adjusted_unusable_rate")),
    lambda s, d: missing.ranked_missing(miss_of(T.cohort(s, d)), 3))

# --- column tests --------------------------------------------------------------------------------
add("key_like", over("cohort", "visits", select=both('SELECT @ AS dataset, "column", key_like FROM $_stats')),
    labelled(lambda ds: frequency.column_measures(ds).select("column", "key_like")))
add("binary_test", over("cohort", "visits", select=both('SELECT @ AS dataset, "column", is_binary FROM $_stats')),
    labelled(lambda ds: frequency.column_measures(ds).select("column", "is_binary")))
add("sample_values", over("cohort", select=S.finish(f'SELECT "column", position, {decimal_sql("value")} FROM cohort_samples WHERE position <= 5', ints="position")),
    lambda s, d: frequency.first_values(T.cohort(s, d), 5).select("column", "position", as_decimal("value")))

# --- roles ---------------------------------------------------------------------------------------
ROLED = ("cohort", "visits", "stays")
add("uniform_type", over(*ROLED, select=S.finish(both(f'SELECT @ AS dataset, "column", {S.role_columns(S.uniform_cases())} FROM $_stats', ROLED), "role_confidence")),
    labelled(lambda ds: roles.uniform_type(roles.column_stats(ds)[0], ds.config), T.stays))
add("rule_role", over(*ROLED, select=S.finish(both(f'SELECT @ AS dataset, "column", {S.role_columns(S.rule_cases())} FROM $_stats', ROLED), "role_confidence")),
    labelled(lambda ds: roles.rule_role(roles.column_stats(ds)[0], ds.metadata, ds.config), T.stays))

OVERRIDES = {"id_fields": ["Subject_ID"], "target_fields": ["grp"], "semantic_roles": {"segment": "market_segment"}, "valid_ranges": {"discharge_day": [0, 2000]}}
add("metadata_role", over("cohort", select=S.finish(f'SELECT "column", {S.role_columns(S.rule_cases(OVERRIDES))} FROM cohort_stats', "role_confidence")),
    lambda s, d: roles.rule_role(roles.column_stats(T.cohort(s, d, OVERRIDES))[0], T.cohort(s, d, OVERRIDES).metadata, CFG))

ROLE_NAMES = ["identifier", "target_or_outcome", "continuous_measurement", "continuous_numeric", "ordinal_or_categorical", "categorical_nominal",
              "binary", "date_time", "free_text", "continuous_measurement_high_missingness"]


def prototypes(s, d):
    """Mean vector per label; labels number the roles of the closed vocabulary."""
    means = (T.table(s, d, "embeddings").where(F.col("label") < len(ROLE_NAMES)).select("label", F.posexplode("embedding").alias("pos", "x"))
             .groupBy("label", "pos").agg(F.avg(F.col("x").cast("double")).alias("x")).orderBy("label", "pos").collect())
    out: dict[str, list[float]] = {}
    for r in means:
        out.setdefault(ROLE_NAMES[r["label"]], []).append(r["x"])
    return out


EMB_CTES = f"""proto AS (SELECT label, list(x ORDER BY pos) AS v FROM (SELECT label, pos, avg(CAST(embedding[pos] AS DOUBLE)) AS x
  FROM embeddings, (SELECT unnest(range(1, 65)) AS pos) WHERE label < {len(ROLE_NAMES)} GROUP BY 1, 2) GROUP BY label),
role_name AS (SELECT unnest({[r for r in ROLE_NAMES]}) AS role, unnest(range(0, {len(ROLE_NAMES)})) AS label),
sims AS (SELECT vec_id, role, list_cosine_similarity(CAST(embedding AS DOUBLE[]), v) AS sim FROM embeddings, proto JOIN role_name USING (label)),
best AS (SELECT vec_id, arg_max(role, (sim, role)) AS role, max(sim) AS sim FROM sims GROUP BY 1),
embed AS (SELECT vec_id, CASE WHEN sim >= 0.30 THEN role END AS embedding_role, sim AS similarity,
  CASE WHEN sim >= 0.30 THEN {S.clip('0.55 + 0.45 * sim')} END AS embedding_confidence FROM best)"""


def evidence(s, d):
    return roles.embedding_role(T.table(s, d, "embeddings"), "vec_id", "embedding", prototypes(s, d), CFG)


add("embedding_role", S.with_ctes(EMB_CTES, select=S.finish("SELECT * FROM embed", "similarity embedding_confidence")), evidence)

# The i-th column of the cohort takes the evidence of vector i.
JOINED = "cohort_ev AS (SELECT st.*, e.embedding_role, e.similarity, e.embedding_confidence FROM cohort_stats st LEFT JOIN embed e ON e.vec_id = st.ordinal)"


def column_evidence(s, d, stats):
    return stats.select("ordinal", "column").join(evidence(s, d), F.col("ordinal") == F.col("vec_id")).drop("ordinal", "vec_id")


def _final(s, d):
    ds = T.cohort(s, d, EMPTY)
    stats = roles.column_stats(ds)[0]
    return roles.final_role(stats, ds.metadata, CFG, column_evidence(s, d, stats))


FINAL = S.role_columns(S.rule_cases(final=True))
add("final_role", over("cohort", extra=(EMB_CTES, JOINED), select=S.finish(f'SELECT "column", {FINAL} FROM cohort_ev', "role_confidence")), _final)


def _provenance(s, d):
    ds = T.cohort(s, d, EMPTY)
    stats = roles.column_stats(ds)[0]
    return roles.role_provenance(stats, ds.metadata, CFG, column_evidence(s, d, stats))


PROV = f"""SELECT "column", role_r AS semantic_role_rule_based, round(role_confidence_r, 3) AS semantic_role_rule_confidence, notes_r AS semantic_role_rule_evidence,
 coalesce(embedding_role, '') AS semantic_role_embedding, round(embedding_confidence, 3) AS semantic_role_embedding_confidence,
 CASE WHEN embedding_role IS NOT NULL THEN 'embedding match (sim=' || format('{{:.2f}}', similarity) || ')' ELSE 'embedding unavailable or below threshold' END AS semantic_role_embedding_evidence,
 role_f AS semantic_role_final, round(role_confidence_f, 3) AS semantic_role_confidence,
 CASE WHEN embedding_role IS NULL THEN 'rule_based' WHEN embedding_role = role_r AND role_f = role_r THEN 'agreement'
   WHEN role_f = embedding_role AND embedding_role <> role_r THEN 'embedding' WHEN role_f = role_r AND embedding_role <> role_r THEN 'rule_based' ELSE 'embedding' END AS semantic_role_source,
 coalesce(embedding_role <> role_r, false) AS semantic_role_disagreement,
 role_confidence_f < 0.65 OR coalesce(embedding_role <> role_r, false) AS requires_semantic_review
 FROM (SELECT *, {S.role_columns(S.rule_cases(), '_r')}, {S.role_columns(S.rule_cases(final=True), '_f')} FROM cohort_ev)"""
add("role_provenance", over("cohort", extra=(EMB_CTES, JOINED), select=PROV), _provenance)

# --- automatic metadata --------------------------------------------------------------------------
AUTO = (S.auto_lists("cohort"), S.auto_lists("visits"))


def auto(kind):
    return both(f"SELECT @ AS dataset, \"column\" FROM $_auto WHERE kind = '{kind}'")


add("auto_id_fields", over("cohort", "visits", extra=AUTO, select=auto("id_fields")),
    labelled(lambda ds: roles.id_fields(roles.column_stats(ds)[0], ds.metadata, CFG).select("column")))
add("auto_quasi_identifiers", over("cohort", "visits", extra=AUTO, select=S.finish(both(
    "SELECT @ AS dataset, position, \"column\" FROM $_auto WHERE kind = 'quasi_identifiers'"), ints="position")),
    labelled(lambda ds: roles.auto_metadata(roles.column_stats(ds)[0], ds.metadata, CFG).where("kind = 'quasi_identifiers'").select("position", "column")))
add("auto_metadata", over("cohort", "visits", extra=AUTO, select=S.finish(both('SELECT @ AS dataset, kind, position, "column" FROM $_auto'), ints="position")),
    labelled(lambda ds: roles.auto_metadata(roles.column_stats(ds)[0], ds.metadata, CFG)))


def renamed(s, d):
    """Customers under names the identifier and target patterns know."""
    from tabsift.dataset import Dataset
    df = T.table(s, d, "customer").select(F.col("c_custkey").alias("row_id"), F.col("c_custkey").alias("customer_id"), F.col("c_name").alias("full_name"),
                                          F.col("c_nationkey").alias("country"), F.col("c_mktsegment").alias("case_status"), F.lit(None).cast("string").alias("email"))
    return Dataset.of("contacts", df, "row_id", {"target_fields": ["nothing"]})


S.DATASETS["contacts"] = {"sql": "SELECT c_custkey AS row_id, c_custkey AS customer_id, c_name AS full_name, c_nationkey AS country, c_mktsegment AS case_status, "
                                 "CAST(NULL AS VARCHAR) AS email FROM customer", "text": ["full_name", "case_status", "email"],
                          "columns": ["customer_id", "full_name", "country", "case_status", "email"], "types": {"customer_id": "bigint", "country": "int"}}
CONTACTS = S.auto_lists("contacts")
add("detect_direct_identifiers", over("contacts", extra=(CONTACTS,), select="SELECT \"column\" FROM contacts_auto WHERE kind = 'direct_identifiers'"),
    lambda s, d: roles.direct_identifiers(roles.column_stats(renamed(s, d))[0], renamed(s, d).metadata, CFG).select("column"))
add("detect_target_fields", over("contacts", extra=(CONTACTS,), select="SELECT \"column\" FROM contacts_auto WHERE kind = 'target_fields'"),
    lambda s, d: roles.target_fields(roles.column_stats(renamed(s, d))[0], renamed(s, d).metadata, CFG).select("column"))


def _excluded(s, d):
    ds = renamed(s, d)
    stats = roles.column_stats(ds)[0]
    taken = roles.auto_metadata(stats, ds.metadata, CFG).where("kind <> 'quasi_identifiers'").select("column")
    return roles.exclude_declared(stats, taken).select("column")


add("exclude_declared", over("contacts", extra=(CONTACTS,), select='SELECT "column" FROM contacts_stats WHERE "column" NOT IN (SELECT "column" FROM contacts_found)'), _excluded)


def _capped(s, d):
    ds = T.cohort(s, d, EMPTY)
    stats = roles.column_stats(ds)[0]
    found = stats.where("non_missing > 0 and distinct_count >= 2").select("ordinal", "column", X.matches_any(F.col("column"), CFG["auto_inference"]["quasi_identifier_patterns"]).alias("by_name"))
    return roles.cap_quasi_identifiers(found, 8).select("column", "by_name", "position")


add("cap_quasi_identifiers", over("cohort", select=S.finish(
    f"SELECT \"column\", by_name, CASE WHEN total > 8 THEN choice ELSE ordinal END AS position FROM (SELECT *, row_number() OVER (ORDER BY by_name DESC, ordinal) AS choice, count(*) OVER () AS total "
    f"FROM (SELECT ordinal, \"column\", {S.matches('\"column\"', CFG['auto_inference']['quasi_identifier_patterns'])} AS by_name FROM cohort_stats WHERE non_missing > 0 AND distinct_count >= 2)) WHERE choice <= 8",
    ints="position")), _capped)


def _merged(s, d):
    ds = T.cohort(s, d)
    found = roles.auto_metadata(roles.column_stats(ds)[0], ds.metadata, CFG)
    lists = found.groupBy("kind").agg(F.transform(F.array_sort(F.collect_list(F.struct("position", "column"))), lambda e: e["column"]).alias("auto"))
    user = F.array(*[F.lit(c) for c in ds.metadata["quasi_identifiers"]])
    return lists.select("kind", F.array_join(roles.merge_lists(F.when(F.col("kind") == "quasi_identifiers", user).otherwise(F.array().cast("array<string>")), F.col("auto")), ",").alias("merged"))


add("merge_auto_metadata", over("cohort", extra=(S.auto_lists("cohort", T.COHORT_METADATA),), select=(
    "SELECT kind, CASE WHEN kind = 'quasi_identifiers' THEN 'nation_code,segment,sex,' ELSE '' END || string_agg(\"column\", ',' ORDER BY position) AS merged FROM cohort_auto GROUP BY 1")), _merged)

add("set_overlap", "SELECT p.page_id, list_has_any(regexp_split_to_array(lower(url), '[^a-z0-9]+'), ['example', 'news', 'com']) AS related FROM pages p",
    lambda s, d: T.table(s, d, "pages").select("page_id", F.arrays_overlap(X.tokenize_stem(F.col("url")), F.array(F.lit("example"), F.lit("news"), F.lit("com"))).alias("related")))

# --- profiles and selection ----------------------------------------------------------------------
SEM = S.role_columns(S.rule_cases(), "_semantic")
UNI = S.role_columns(S.uniform_cases(), "_uniform")
COMPARE = (f"SELECT *, role_semantic <> role_uniform AS role_changed_by_semantic_layer, CASE WHEN role_semantic <> role_uniform THEN "
           f"'Semantic layer changes how checks are selected or interpreted.' ELSE 'Uniform and semantic layers agree.' END AS interpretation FROM (SELECT @ AS dataset, \"column\", {SEM}, {UNI} FROM $_stats)")


def _compare(ds):
    p = profile(ds, infer=False)
    return roles.compare_profiles(p.semantic, p.uniform)


add("join_profile_comparison", over("cohort", "visits", select=S.finish(both(COMPARE), "role_confidence_semantic role_confidence_uniform")), labelled(_compare))

BASE = ('SELECT $ AS dataset, "column", dtype, missing_count, distinct_count AS unique_count, sample_values, ' + S.role_columns(S.rule_cases()) + f", {UNI} FROM $_stats")


def _build(ds):
    p = profile(ds, infer=False)
    right = p.uniform.select("column", *[F.col(c).alias(f"{c}_uniform") for c in ("role", "role_confidence", "notes")])
    return p.semantic.select("column", "dtype", "missing_count", "unique_count", "sample_values", "role", "role_confidence", "notes").join(right, "column")


add("build_profiles", over("cohort", "visits", select=S.finish(both(BASE.replace("$ AS dataset", "@ AS dataset")), "role_confidence role_confidence_uniform", "missing_count unique_count")), labelled(_build))

QI = ["nation_code", "segment", "sex"]
RULED = S.rule_cases(T.COHORT_METADATA)
ELIGIBLE = S.names(ANOMALY_ROLES)
NUM_RATE = S.div("strict_count", "non_missing")
SELECTION = f"""SELECT "column", role AS semantic_role, role_confidence, true AS completeness_missing_check, "column" IN ('age', 'glucose') AS completeness_required_field,
 "column" = 'glucose' AS completeness_critical_field, role = 'identifier' AS accuracy_identifier_uniqueness,
 contains(role, 'numeric') OR contains(role, 'measurement') AS accuracy_type_consistency, "column" = 'age' AS accuracy_domain_range, "column" = 'grp' AS accuracy_allowed_values,
 role IN {ELIGIBLE} AS accuracy_anomaly_detection_semantic, {NUM_RATE} >= 0.98 AS accuracy_anomaly_detection_uniform,
 (role IN {ELIGIBLE}) <> ({NUM_RATE} >= 0.98) AS anomaly_selection_differs, "column" IN {S.names(QI)} AS reuse_quasi_identifier, false AS reuse_direct_identifier,
 role_confidence < 0.65 AS flag_low_confidence_for_hitl FROM (SELECT *, {S.role_columns(RULED)} FROM cohort_stats)"""


def selection(s, d):
    p = profile(T.cohort(s, d), infer=False)
    return roles.check_selection(p.semantic, p.ds.metadata, CFG)


add("check_selection", over("cohort", select=S.finish(SELECTION, "role_confidence")), selection)


def _routed(ds):
    p = profile(ds, infer=False)
    return roles.routed_columns(p.semantic, p.stats)


ROUTED = (f"SELECT @ AS dataset, 'uniform_dtype_routing' AS policy, ordinal, \"column\" FROM $_stats WHERE non_missing > 0 AND {NUM_RATE} >= 0.98 "
          f"UNION ALL SELECT @, p.policy, ordinal, \"column\" FROM (SELECT *, {S.role_columns(S.rule_cases())} FROM $_stats), "
          f"(SELECT unnest(['rule_based_semantic_routing', 'transformer_augmented_routing']) AS policy) p WHERE role IN {ELIGIBLE}")
add("ablation_policies", over("cohort", "visits", select=S.finish(both(ROUTED), ints="ordinal")), labelled(_routed))
add("route_numeric_columns", over("cohort", "visits", select=S.finish("SELECT dataset, policy, string_agg(\"column\", ',' ORDER BY ordinal) AS columns, count(*) AS n_columns FROM ("
                                  + both(ROUTED) + ") WHERE policy <> 'rule_based_semantic_routing' GROUP BY 1, 2", ints="n_columns")),
    labelled(lambda ds: _routed(ds).where("policy <> 'rule_based_semantic_routing'").groupBy("policy").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "column"))), lambda e: e["column"]), ",").alias("columns"), F.count("*").alias("n_columns"))))

add("schema_confidence", over("cohort", "visits", select=S.finish(both(f"SELECT @ AS dataset, coalesce(avg(role_confidence), 1.0) AS schema_confidence FROM (SELECT {S.role_columns(S.rule_cases())} FROM $_stats)"), "schema_confidence")),
    labelled(lambda ds: profile(ds, infer=False).semantic.agg(F.coalesce(F.avg("role_confidence"), F.lit(1.0)).alias("schema_confidence"))))
