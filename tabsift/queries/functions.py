"""Queries of the scalar functions, each over a whole table."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabsift.config import CONFIG
from tabsift.functions import exprs as X
from tabsift.operators import missing
from tabsift.operators.frequency import column_measures
from tabsift.queries import fixtures as T, sqltext as S
from tabsift.queries.shapes import rounded

QUERIES, ORACLES = {}, {}
ROLES, REUSE, ANOMALY = CONFIG["roles"], CONFIG["reuse"], CONFIG["anomaly"]


def add(name, sql, run):
    QUERIES[name], ORACLES[name] = (lambda spark, folder: rounded(run(spark, folder))), sql


def raw(base_sql, base):
    return lambda spark, folder: T.view(spark, folder, base_sql, base)


COHORT, VISITS = raw(T.COHORT, "customer"), raw(T.VISITS, "orders")

add("fn_clip01", "SELECT c_custkey, round(greatest(0.0, least(1.0, c_acctbal / 5000)), 6) AS clipped FROM customer",
    lambda s, d: T.table(s, d, "customer").select("c_custkey", X.clip01(F.col("c_acctbal") / 5000).alias("clipped")))

add("fn_safe_div", f"SELECT p_partkey, round({S.div('p_retailprice', 'p_size % 3')}, 6) AS ratio FROM part",
    lambda s, d: T.table(s, d, "part").select("p_partkey", X.safe_div(F.col("p_retailprice"), F.col("p_size") % 3).alias("ratio")))

add("fn_normalize_name", f"SELECT row_id, {S.norm('sex')} AS sex, {S.norm('visit_note')} AS visit_note FROM ({T.COHORT})",
    lambda s, d: COHORT(s, d).select("row_id", X.normalize(F.col("sex")).alias("sex"), X.normalize(F.col("visit_note")).alias("visit_note")))

add("fn_matches_any", f"SELECT doc_id, {S.matches('text', ROLES['text_patterns'])} AS text_like, "
                      f"{S.matches('text', ROLES['measurement_patterns'])} AS measurement_like FROM documents",
    lambda s, d: T.table(s, d, "documents").select("doc_id", X.matches_any(F.col("text"), ROLES["text_patterns"]).alias("text_like"),
                                                   X.matches_any(F.col("text"), ROLES["measurement_patterns"]).alias("measurement_like")))

add("fn_score_value",
    f"SELECT row_id, CASE WHEN {S.norm('v')} = 'true' THEN 1.0 WHEN {S.norm('v')} = 'false' THEN 0.0 ELSE {S.clip(S.number('v'))} END AS score "
    f"FROM (SELECT row_id, CASE row_id % 5 WHEN 0 THEN 'True' WHEN 1 THEN 'false' WHEN 2 THEN age ELSE '0.' || part_a END AS v FROM ({T.COHORT}))",
    lambda s, d: COHORT(s, d).select("row_id", X.score_value(F.expr(
        "CASE row_id % 5 WHEN 0 THEN 'True' WHEN 1 THEN 'false' WHEN 2 THEN age ELSE concat('0.', part_a) END")).alias("score")))

add("fn_as_list", f"SELECT row_id, CASE WHEN age IS NULL THEN 0 ELSE 1 END::BIGINT AS n, coalesce(age, '') AS entries FROM ({T.COHORT})",
    lambda s, d: COHORT(s, d).select("row_id", F.size(X.as_list(F.col("age"))).alias("n"), F.array_join(X.as_list(F.col("age")), "|").alias("entries")))

add("fn_to_number_strict", f"SELECT row_id, round({S.number('glucose')}, 6) AS glucose, round({S.number('age')}, 6) AS age FROM ({T.COHORT})",
    lambda s, d: COHORT(s, d).select("row_id", X.number(F.col("glucose")).alias("glucose"), X.number(F.col("age")).alias("age")))

add("fn_to_number_comma", f"SELECT row_id, round({S.loose('glucose')}, 6) AS glucose, round({S.loose('age')}, 6) AS age FROM ({T.COHORT})",
    lambda s, d: COHORT(s, d).select("row_id", X.number_comma(F.col("glucose")).alias("glucose"), X.number_comma(F.col("age")).alias("age")))

add("fn_canonical_category", f"SELECT grp, {S.canon('grp')} AS canon, count(*) AS n FROM ({T.COHORT}) GROUP BY 1, 2 "
                             f"UNION ALL SELECT p_name, {S.canon('p_name')}, count(*) FROM part GROUP BY 1, 2",
    lambda s, d: COHORT(s, d).groupBy("grp", X.canonical_category(F.col("grp")).alias("canon")).agg(F.count("*").alias("n"))
    .union(T.table(s, d, "part").groupBy("p_name", X.canonical_category(F.col("p_name")).alias("canon")).agg(F.count("*").alias("n"))))

add("fn_date_like", f"SELECT row_id, regexp_matches(admission_date, {S.quote(S.DATE_LIKE)}) AS date_like FROM ({T.VISITS})",
    lambda s, d: VISITS(s, d).select("row_id", X.date_like(F.col("admission_date")).alias("date_like")))



def rated(ds):
    return column_measures(ds).select("column", "date_rate", (F.col("date_rate") >= 0.80).alias("uniform_date"), (F.col("date_rate") >= 0.60).alias("semantic_date"))


add("fn_parse_date_rate", S.with_ctes(*(c for n in ("visits", "stays") for c in (S.clean(n), S.statistics(n))), select=S.finish(
    " UNION ALL ".join(f'SELECT "column", date_rate, date_rate >= 0.80 AS uniform_date, date_rate >= 0.60 AS semantic_date FROM {n}_stats' for n in ("visits", "stays")), "date_rate")),
    lambda s, d: rated(T.visits(s, d)).unionByName(rated(T.stays(s, d))))

add("fn_tokenize_stem",
    "SELECT page_id, array_to_string(list_sort(list_distinct(list_filter(regexp_split_to_array(lower(url), '[^a-z0-9]+'), lambda t: length(t) > 1))), ' ') AS tokens FROM pages",
    lambda s, d: T.table(s, d, "pages").select("page_id", F.array_join(F.sort_array(X.tokenize_stem(F.col("url"))), " ").alias("tokens")))

add("fn_minmax_similarity", f"SELECT l_discount, round({S.clip('(l_discount - 0.05) / 0.4')}, 6) AS tfidf, round({S.clip('(l_discount * 6 - 0.15) / 0.4')}, 6) AS embedding, "
                            "count(*) AS n FROM lineitem GROUP BY l_discount",
    lambda s, d: T.table(s, d, "lineitem").groupBy("l_discount").agg(F.count("*").alias("n"))
    .withColumn("tfidf", X.minmax_similarity(F.col("l_discount"), *REUSE["tfidf_range"]))
    .withColumn("embedding", X.minmax_similarity(F.col("l_discount") * 6, *REUSE["embedding_range"])))

add("fn_logistic_score", "SELECT c_custkey, round(1 / (1 + exp(-(c_acctbal / 1000) / 4)), 6) AS score FROM customer",
    lambda s, d: T.table(s, d, "customer").select("c_custkey", X.logistic_score(F.col("c_acctbal") / 1000, REUSE["logit_midpoint"], REUSE["logit_scale"]).alias("score")))

add("fn_row_json", "SELECT o_orderkey, to_json({'o_orderkey': o_orderkey, 'o_custkey': o_custkey, 'o_orderstatus': o_orderstatus, 'o_orderpriority': o_orderpriority})::VARCHAR AS row_values_json FROM orders",
    lambda s, d: T.table(s, d, "orders").select("o_orderkey", X.row_json(["o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"]).alias("row_values_json")))

add("fn_assemble_documentation",
    "SELECT p_partkey, 'title: ' || p_name || chr(10) || 'description: ' || p_type || CASE WHEN p_size % 2 = 0 THEN chr(10) || 'license: ' || p_brand ELSE '' END "
    "|| chr(10) || 'Variable p_size: size ' || p_size AS document FROM part",
    lambda s, d: T.table(s, d, "part").select("p_partkey", X.assemble_documentation(
        {"title": F.col("p_name"), "description": F.col("p_type"), "license": F.when(F.col("p_size") % 2 == 0, F.col("p_brand")).otherwise("")},
        F.create_map(F.lit("p_size"), F.concat(F.lit("size "), F.col("p_size").cast("string")), F.lit("p_name"), F.lit(""))).alias("document")))

add("fn_interpretation", S.with_ctes(S.clean("cohort"), S.statistics("cohort"), S.missing_table("cohort"), select=(
    "SELECT \"column\", CASE WHEN semantic_adjustment_delta > 0 THEN 'Semantic missing markers increase the unusable-value burden for this variable.' "
    "ELSE 'No semantic missingness adjustment for this variable.' END AS interpretation FROM cohort_miss")),
    lambda s, d: _effect(s, d).select("column", "interpretation"))

add("fn_ratio_contamination",
    "SELECT c_nationkey, round(least(0.04, greatest(0.01, 25.0 / count(*))), 6) AS contamination, CAST(least(35, greatest(10, count(*) // 20)) AS BIGINT) AS k FROM customer GROUP BY 1",
    lambda s, d: T.table(s, d, "customer").groupBy("c_nationkey").agg(F.count("*").alias("n")).select(
        "c_nationkey", X.contamination(F.col("n"), 0.01, 0.04, 25.0).alias("contamination"), X.neighbour_count(F.col("n"), 10, 35, 20).alias("k")))


def _effect(spark, folder):
    ds = T.cohort(spark, folder)
    return missing.missingness_effect(missing.missingness(ds, missing.sentinel_map(ds)))
