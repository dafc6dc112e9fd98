"""Fragments of the DuckDB statements that the results are checked against."""

from __future__ import annotations

from tabsift.config import BINARY_SETS, CONFIG, DATE_LIKE, SEMANTIC_MARKERS, TECHNICAL_MARKERS
from tabsift.functions.exprs import INFINITE, NUMBER, any_pattern
from tabsift.queries.fixtures import COHORT, MEASURES, STAYS, VISITS

#: What the oracles parse dates with: every day format, alone and before every time of day.
DAYS = ["%Y-%m-%d", "%Y/%m/%d", "%Y.%m.%d", "%d/%m/%Y", "%m/%d/%Y", "%d-%m-%Y", "%m-%d-%Y", "%d.%m.%Y", "%m.%d.%Y", "%d/%m/%y", "%m/%d/%y", "%d %b %Y", "%d %B %Y", "%d-%b-%Y", "%b %d, %Y", "%B %d, %Y"]
TIMES = ["", " %H:%M", " %H:%M:%S", " %H:%M:%S.%f", "T%H:%M", "T%H:%M:%S", "T%H:%M:%S.%f"]
STRPTIME = [day + time for day in DAYS for time in TIMES] + ["%Y%m%d"]

STAY_DATES = ["named_date", "long_date", "compact_date", "minute_time", "fraction_time", "dotted_time", "dashed_date", "short_date", "mixed_date"]
DATASETS = {
    "cohort": {"sql": COHORT, "text": ["subject_id", "sex", "age", "glucose", "grp", "admission_day", "discharge_day", "part_a",
                                       "part_b", "part_total", "visit_note", "segment"],
               "columns": ["subject_id", "sex", "age", "glucose", "grp", "admission_day", "discharge_day", "part_a", "part_b",
                           "part_total", "visit_note", "nation_code", "segment", "balance_value"],
               "types": {"nation_code": "int", "balance_value": "double"}},
    "visits": {"sql": VISITS, "text": ["cust_code", "admission_date", "mixed_field", "empty_field", "priority"],
               "columns": ["cust_code", "admission_date", "mixed_field", "empty_field", "smoker_flag", "priority"],
               "types": {"smoker_flag": "int"}},
    "stays": {"sql": STAYS, "text": STAY_DATES, "columns": STAY_DATES, "types": {"named_date": "string"}},
    "measures": {"sql": MEASURES, "text": [], "columns": ["quantity_value", "price_value", "discount_rate", "tax_rate"],
                 "types": {c: "double" for c in ("quantity_value", "price_value", "discount_rate", "tax_rate")}},
}


def quote(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def names(values) -> str:
    return "(" + ", ".join(quote(v) for v in values) + ")" if values else "(NULL)"


def strip(x: str) -> str:
    return f"trim({x}, ' ' || chr(9) || chr(10) || chr(13))"


def norm(x: str) -> str:
    return f"lower({strip(x)})"


def number(x: str) -> str:
    t = strip(x)
    return (f"CASE WHEN regexp_matches({t}, {quote(NUMBER)}) OR regexp_matches({t}, {quote(INFINITE)}) "
            f"THEN TRY_CAST({t} AS DOUBLE) END")


def loose(x: str) -> str:
    return number(f"replace({x}, ',', '.')")


def matches(x: str, patterns: list[str]) -> str:
    return f"regexp_matches({norm(x)}, {quote(any_pattern(patterns))})"


def div(a: str, b: str) -> str:
    return f"coalesce(CAST({a} AS DOUBLE) / nullif(CAST({b} AS DOUBLE), 0), 0.0)"


def clip(x: str) -> str:
    return f"greatest(0.0, least(1.0, coalesce(CAST({x} AS DOUBLE), 0.0)))"


def canon(x: str) -> str:
    return (f"regexp_replace(regexp_replace(regexp_replace({norm(x)}, '[\\(\\[\\{{].*?[\\)\\]\\}}]', '', 'g'), '\\s+', '', 'g'), "
            f"'[.,;:\\-_/\\\\]+', '', 'g')")


def finish(sql: str, doubles: str = "", ints: str = "", columns: str = "*") -> str:
    """Doubles to six decimals, counts to BIGINT."""
    changes = [f'round(CAST("{c}" AS DOUBLE), 6) AS "{c}"' for c in doubles.split()]
    changes += [f'CAST("{c}" AS BIGINT) AS "{c}"' for c in ints.split()]
    replace = f" REPLACE ({', '.join(changes)})" if changes else ""
    return f"SELECT *{replace} FROM ({sql})" if columns == "*" else f"SELECT {columns} FROM (SELECT *{replace} FROM ({sql}))"


def clean(name: str) -> str:
    """CTEs ``name_raw`` and ``name``: the fixture, and the fixture without technical markers."""
    d = DATASETS[name]
    known = names(sorted({m.strip().lower() for m in TECHNICAL_MARKERS}))
    cells = ", ".join(f"CASE WHEN {norm(c)} IN {known} THEN NULL ELSE {c} END AS {c}" if c in d["text"] else c for c in d["columns"])
    return f"{name}_raw AS ({d['sql']}), {name} AS (SELECT row_id, {cells} FROM {name}_raw)"


def frequencies(name: str, columns: list[str] | None = None) -> str:
    """CTE ``name_vf`` (ordinal, column, value, freq)."""
    d = DATASETS[name]
    parts = [f"SELECT {i} AS ordinal, {quote(c)} AS \"column\", CAST({c} AS VARCHAR) AS value, count(*) AS freq FROM {name} GROUP BY 3"
             for i, c in enumerate(d["columns"]) if columns is None or c in columns]
    return f"{name}_vf AS (" + " UNION ALL ".join(parts) + ")"


def statistics(name: str) -> str:
    """CTE ``name_stats``: one row per column, as the engine's column statistics."""
    r = CONFIG["roles"]
    d = DATASETS[name]
    markers = names([m.strip().lower() for m in SEMANTIC_MARKERS])
    binary = " OR ".join(f"coalesce(bool_and(CASE WHEN value IS NOT NULL THEN norm IN {names(s)} END), false)" for s in BINARY_SETS)
    dates = ", ".join(f"sum(CASE WHEN day IS NOT NULL AND try_strptime(day, '{fmt}') IS NOT NULL THEN freq ELSE 0 END)" for fmt in STRPTIME)
    samples = " UNION ALL ".join(
        f"SELECT * FROM (SELECT {quote(c)} AS \"column\", row_id, CAST({c} AS VARCHAR) AS value, row_number() OVER (ORDER BY row_id) AS position "
        f"FROM {name} WHERE {c} IS NOT NULL ORDER BY row_id LIMIT 20)" for c in d["columns"])
    kinds = " ".join(f"WHEN {quote(c)} THEN {quote(t)}" for c, t in d["types"].items())
    rule = CONFIG["missingness"]["sentinels"]
    known = names(sorted({m.strip().lower() for m in TECHNICAL_MARKERS + SEMANTIC_MARKERS}))
    return f"""{frequencies(name)},
{name}_val AS (SELECT *, CASE WHEN length({strip('value')}) <= 40 AND regexp_matches({strip('value')}, '^([A-Za-z]{{3,9}}[ ,.]|[0-9]{{1,2}}[-/. ]|[0-9]{{4}}[-/. ]|[0-9]{{8}}$)') THEN {strip('value')} END AS day, {norm('value')} AS norm, {number('value')} AS strict, {loose('value')} AS num FROM {name}_vf),
{name}_base AS (SELECT ordinal, "column", sum(freq) AS n_rows, sum(CASE WHEN value IS NULL THEN freq ELSE 0 END) AS missing_count,
  sum(CASE WHEN value IS NOT NULL THEN freq ELSE 0 END) AS non_missing, count(value) AS distinct_count,
  sum(CASE WHEN strict IS NOT NULL THEN freq ELSE 0 END) AS strict_count, sum(CASE WHEN num IS NOT NULL THEN freq ELSE 0 END) AS loose_count,
  count(DISTINCT num) AS distinct_numbers, sum(CASE WHEN norm IN {markers} THEN freq ELSE 0 END) AS marker_count,
  ({binary}) AS is_binary,
  coalesce(bool_and(CASE WHEN num IS NOT NULL THEN abs(num - round_even(num, 0)) <= 1e-8 + 1e-5 * abs(round_even(num, 0)) END), false)
    AND count(DISTINCT round_even(num, 0)) = count(DISTINCT num) AS integral,
  greatest({dates}) AS date_hits FROM {name}_val GROUP BY ordinal, "column"),
{name}_codes AS (SELECT "column", norm AS token, sum(freq) AS freq FROM {name}_val
  WHERE value IS NOT NULL AND num IS NULL AND length(norm) <= {rule['max_token_length']} GROUP BY 1, 2 HAVING sum(freq) >= {rule['min_token_count']}),
{name}_coded AS (SELECT "column", count(*) AS n_codes, sum(freq) AS coded FROM {name}_codes GROUP BY 1),
{name}_accepted AS (SELECT c."column" FROM {name}_coded c JOIN {name}_base b ON b."column" = c."column"
  WHERE n_codes <= {rule['max_distinct_tokens']} AND coded / non_missing <= {rule['max_token_fraction']}
    AND ({div('loose_count', 'non_missing - coded')} >= 1 - 1e-9 OR {div('loose_count', 'non_missing')} >= {rule['min_numeric_fraction']})
    AND {div('loose_count', 'non_missing - coded')} >= 0.90 AND distinct_numbers >= greatest(3, 2 * n_codes)),
{name}_sentinels AS (SELECT "column", token, freq FROM {name}_codes WHERE "column" IN (SELECT "column" FROM {name}_accepted) AND token NOT IN {known}),
{name}_samples AS ({samples}),
{name}_text AS (SELECT "column", string_agg(value, ', ' ORDER BY position) FILTER (position <= 5) AS sample_values,
  regexp_matches(string_agg(value, ' ' ORDER BY position), {quote(DATE_LIKE)}) AS date_like FROM {name}_samples GROUP BY 1),
{name}_stats AS (SELECT b.*, CASE b."column" {kinds} ELSE 'string' END AS dtype,
  non_missing > 0 AND ({div('loose_count', 'non_missing')} < {r['numeric_parse']} OR integral) AS key_like,
  non_missing - marker_count - coalesce((SELECT sum(freq) FROM {name}_sentinels s WHERE s."column" = b."column"), 0) AS usable_count,
  {div('date_hits', 'non_missing')} AS date_rate, coalesce(t.date_like, false) AS date_like, coalesce(t.sample_values, '') AS sample_values
  FROM {name}_base b LEFT JOIN {name}_text t ON t."column" = b."column")"""


def rule_cases(metadata: dict | None = None, column: str = '"column"', evidence: str = "", final: bool = False) -> list[tuple[str, str, float, str]]:
    """(condition, role, confidence, note) in order."""
    m, r = metadata or {}, CONFIG["roles"]
    measured = f"({matches(column, r['measurement_patterns'])} OR {column} IN {names(list(m.get('valid_ranges', {})))})"
    measured = measured if m.get("valid_ranges") else matches(column, r["measurement_patterns"])
    rate = div("loose_count", "usable_count")
    distinct = f"(CASE WHEN {rate} > 0 THEN distinct_numbers ELSE distinct_count END)"
    missing = div("missing_count", "n_rows")
    numeric = f"{rate} >= {r['numeric_parse']}"
    few = f"{distinct} <= {r['low_cardinality']}"
    ids = names([x.lower() for x in m.get("id_fields", [])])
    targets = names([x.lower() for x in m.get("target_fields", [])])
    cases = []
    for c, role in m.get("semantic_roles", {}).items():
        cases.append((f"{column} = {quote(c)}", quote(role), "1.0", "'metadata semantic role override'"))
    cases += [
        (f"{norm(column)} IN {ids}", "'identifier'", "1.0", "'metadata id field'"),
        (f"{norm(column)} IN {targets}", "'target_or_outcome'", "1.0", "'metadata target field'"),
        ("non_missing = 0", "'empty_or_missing_only'", "0.40", "'no non-missing values'"),
        (f"{matches(column, r['id_patterns'])} AND {div('distinct_count', 'n_rows')} >= {r['high_uniqueness']} AND key_like", "'identifier'",
         "0.90", "'configured id-like pattern, high uniqueness, key-like values'"),
        ("is_binary", "'binary'", "0.92", "'binary observed value set'")]
    if final:
        contradicts = (f"({div('loose_count', 'n_rows')} >= {r['numeric_parse']} AND embedding_role IN "
                       "('free_text', 'categorical_nominal', 'date_time'))")
        cases.append((f"embedding_role IS NOT NULL AND NOT {contradicts}", "embedding_role", "embedding_confidence",
                      "'embedding match (sim=' || format('{:.2f}', similarity) || ')'"))
    cases += [
        (matches(column, r["target_patterns"]), "'target_or_outcome'", "0.85", "'configured target-like pattern'"),
        (matches(column, r["text_patterns"]), "'free_text'", "0.80", "'configured text-like pattern'"),
        (f"{numeric} AND {few} AND NOT {measured}", "'ordinal_or_categorical'", "0.82",
         f"'few numeric-coded values; missing=' || format('{{:.2f}}', {missing})"),
        (f"{numeric} AND {measured} AND {missing} >= 0.20", "'continuous_measurement_high_missingness'", "0.88",
         f"'measurement-like; missing=' || format('{{:.2f}}', {missing})"),
        (f"{numeric} AND {measured}", "'continuous_measurement'", "0.88", "'measurement-like numeric variable'"),
        (numeric, "'continuous_numeric'", "0.80", "'numeric variable without domain override'"),
        (f"{matches(column, r['date_patterns'])} AND date_rate >= 0.60", "'date_time'", "0.82", "'configured date-like pattern'"),
        (f"{rate} >= {r['mixed_numeric']}", "'mixed_numeric_requires_review'", "0.55",
         f"'partial numeric parsing=' || format('{{:.2f}}', {rate})"),
        (few, "'categorical_nominal'", "0.78", "'limited observed categories'"),
        ("true", "'free_text_or_high_cardinality'", "0.55", "'semantic role requires review'")]
    return cases


def case_of(cases, field: int) -> str:
    return "CASE " + " ".join(f"WHEN {c[0]} THEN {c[field]}" for c in cases) + " END"


def role_columns(cases, suffix: str = "") -> str:
    return (f"{case_of(cases, 1)} AS role{suffix}, CAST({case_of(cases, 2)} AS DOUBLE) AS role_confidence{suffix}, "
            f"{case_of(cases, 3)} AS notes{suffix}")


def uniform_cases() -> list[tuple[str, str, str, str]]:
    r = CONFIG["roles"]
    return [("non_missing = 0", "'empty_or_missing_only'", "0.40", "'no non-missing values'"),
            (f"{div('strict_count', 'non_missing')} >= {r['numeric_parse']}", "'numeric'", "0.90", "'uniform dtype/numeric parsing'"),
            ("date_like AND date_rate >= 0.80", "'date_time'", "0.80", "'uniform date parsing'"),
            ("is_binary", "'binary'", "0.90", "'uniform binary values'"),
            (f"distinct_count <= {r['low_cardinality']}", "'categorical'", "0.80", "'uniform low-cardinality values'"),
            ("true", "'text_or_high_cardinality'", "0.60", "'uniform fallback'")]


def auto_lists(name: str, metadata: dict | None = None) -> str:
    """CTEs ``name_auto`` (kind, position, column): everything detected from the data alone."""
    m, r, a = metadata or {}, CONFIG["roles"], CONFIG["auto_inference"]
    unique = div("distinct_count", "greatest(n_rows, 1)")

    def not_user(key):
        return f"{norm('\"column\"')} NOT IN {names([x.lower() for x in m[key]])}" if m.get(key) else "true"

    col = '"column"'
    stated = names([x.lower() for k in ("id_fields", "target_fields", "direct_identifiers") for x in m.get(k, [])] or ["\x01"])
    by_name = matches(col, a["quasi_identifier_patterns"])
    return f"""{name}_found AS (
  SELECT 'id_fields' AS kind, ordinal, {col} FROM {name}_stats WHERE non_missing > 0 AND key_like AND {not_user('id_fields')}
    AND ({unique} >= {a['near_unique']} OR ({matches(col, r['id_patterns'])} AND {unique} >= {r['high_uniqueness']}))
  UNION ALL SELECT 'target_fields', ordinal, {col} FROM {name}_stats WHERE non_missing > 0 AND {not_user('target_fields')} AND {matches(col, r['target_patterns'])}
  UNION ALL SELECT 'direct_identifiers', ordinal, {col} FROM {name}_stats WHERE non_missing > 0 AND {not_user('direct_identifiers')}
    AND {matches(col, a['direct_identifier_patterns'])}),
{name}_quasi_all AS (SELECT ordinal, {col}, {by_name} AS by_name FROM {name}_stats WHERE non_missing > 0 AND {not_user('quasi_identifiers')}
    AND {norm(col)} NOT IN (SELECT {norm(col)} FROM {name}_found) AND {norm(col)} NOT IN {stated}
    AND ({by_name} OR (distinct_count >= {a['cardinality_min']} AND {unique} <= {a['cardinality_max_ratio']} AND NOT {matches(col, r['text_patterns'])}))),
{name}_quasi_ranked AS (SELECT *, row_number() OVER (ORDER BY by_name DESC, ordinal) AS choice, count(*) OVER () AS total FROM {name}_quasi_all),
{name}_quasi AS (SELECT ordinal, {col}, by_name, CASE WHEN total > {a['max_quasi_identifiers']} THEN choice ELSE ordinal END AS position
  FROM {name}_quasi_ranked WHERE choice <= {a['max_quasi_identifiers']}),
{name}_auto AS (SELECT kind, ordinal AS position, {col} FROM {name}_found UNION ALL SELECT 'quasi_identifiers', position, {col} FROM {name}_quasi)"""


def unusable(name: str, column: str) -> str:
    """True where the cell is a semantic marker or one of the column's codes."""
    markers = ", ".join(quote(m.strip().lower()) for m in SEMANTIC_MARKERS)
    value = norm(f"CAST({column} AS VARCHAR)")
    return (f"coalesce({value} IN ({markers}) OR {value} IN (SELECT token FROM {name}_sentinels WHERE \"column\" = {quote(column)}), false)")


def missing_table(name: str) -> str:
    """CTE ``name_miss`` as the missingness table."""
    markers = names([m.strip().lower() for m in SEMANTIC_MARKERS])
    return f"""{name}_miss AS (SELECT *, technical_missing + semantic_unusable AS total_unusable, {div('technical_missing', 'n_rows')} AS technical_missing_rate,
  {div('technical_missing + semantic_unusable', 'n_rows')} AS semantic_adjusted_unusable_rate, {div('semantic_unusable', 'n_rows')} AS semantic_adjustment_delta
  FROM (SELECT v.ordinal, v."column", sum(v.freq) AS n_rows, sum(CASE WHEN value IS NULL THEN v.freq ELSE 0 END) AS technical_missing,
    sum(CASE WHEN v.norm IN {markers} OR s.token IS NOT NULL THEN v.freq ELSE 0 END) AS semantic_unusable
    FROM {name}_val v LEFT JOIN {name}_sentinels s ON s."column" = v."column" AND s.token = v.norm GROUP BY 1, 2))"""


def with_ctes(*ctes: str, select: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n" + select
