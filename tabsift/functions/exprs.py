"""Scalar building blocks as native ``Column`` expressions (no Python on executors)."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from tabsift.config import DATE_LIKE, DOCUMENTATION_KEYS

WHITESPACE = " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0"
NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
INFINITE = r"^[+-]?([iI][nN][fF]|[iI][nN][fF][iI][nN][iI][tT][yY])$"
WORD = r"[\p{L}\p{N}_]{2,}"


def clip01(x: Column) -> Column:
    """NULL and NaN count as 0; the rest is clamped to [0, 1]."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(F.nanvl(x.cast("double"), F.lit(0.0)), F.lit(0.0))))


def safe_div(num: Column, den: Column) -> Column:
    """Division that answers 0.0 where the denominator is 0 or NULL."""
    usable = den.isNotNull() & (den != 0)
    return F.when(usable, num.cast("double") / F.when(usable, den.cast("double"))).otherwise(F.lit(0.0))


def strip(x: Column) -> Column:
    return F.trim(x, F.lit(WHITESPACE))


def normalize(x: Column) -> Column:
    """The universal comparison form: outer whitespace dropped, lower case."""
    return F.lower(strip(x))


def any_pattern(patterns: list[str]) -> str:
    return "|".join(f"(?:{p})" for p in patterns)


def matches_any(x: Column, patterns: list[str]) -> Column:
    """Unanchored regex alternatives over the normalised text."""
    if not patterns:
        return F.lit(False)
    return normalize(x).rlike(any_pattern(patterns))


def score_value(x: Column) -> Column:
    """Flag text to a score: booleans to 1/0, numbers clamped, anything else 0."""
    text = normalize(x)
    return (F.when(text == "true", 1.0).when(text == "false", 0.0)
            .otherwise(clip01(number(text))))


def as_list(x: Column) -> Column:
    return F.when(x.isNull(), F.array().cast("array<string>")).otherwise(F.array(x.cast("string")))


def number(text: Column) -> Column:
    """Strict decimal grammar; NULL for everything else, including 'nan' and suffixed literals."""
    t = strip(text)
    return F.when(t.rlike(NUMBER) | t.rlike(INFINITE), t.try_cast("double"))


def number_comma(text: Column) -> Column:
    """As :func:`number`, but a decimal comma is accepted too."""
    return number(F.replace(text, F.lit(","), F.lit(".")))


def canonical_category(x: Column) -> Column:
    """Case, bracketed annotations, whitespace and separators removed."""
    plain = F.regexp_replace(normalize(x), r"[\(\[\{].*?[\)\]\}]", "")
    return F.regexp_replace(F.regexp_replace(plain, r"\s+", ""), r"[.,;:\-_/\\]+", "")


def date_like(x: Column) -> Column:
    return x.rlike(DATE_LIKE)


def tokenize_stem(x: Column) -> Column:
    tokens = F.split(F.lower(x), "[^a-z0-9]+")
    return F.array_distinct(F.filter(tokens, lambda t: F.length(t) > 1))


def words(x: Column) -> Column:
    return F.regexp_extract_all(F.lower(x), F.lit(WORD), F.lit(0))


def minmax_similarity(sim: Column, low: float, high: float) -> Column:
    return clip01((sim - F.lit(low)) / F.lit(max(high - low, 1e-9)))


def logistic_score(logit: Column, midpoint: float, scale: float) -> Column:
    return clip01(1.0 / (1.0 + F.exp(-(logit - F.lit(midpoint)) / F.lit(max(scale, 1e-9)))))


def contamination(n: Column, low: float, high: float, cases: float) -> Column:
    return F.least(F.lit(high), F.greatest(F.lit(low), F.lit(cases) / n))


def neighbour_count(n: Column, low: int, high: int, divisor: int) -> Column:
    return F.least(F.lit(high), F.greatest(F.lit(low), F.floor(n / F.lit(divisor)))).cast("long")


def row_json(columns: list[str]) -> Column:
    return F.to_json(F.struct(*[F.col(f"`{c}`") for c in columns]), {"ignoreNullFields": "false"})


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0),
                       lambda acc, v: acc + v)


def length(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(unit_vector: Column, a: Column, norm: Column) -> Column:
    """Cosine of a unit vector with ``a`` whose length is ``norm``; 0 for a zero vector."""
    return F.when(norm > 0, dot(unit_vector, a) / norm).otherwise(0.0)


def assemble_documentation(fields: dict[str, Column], descriptions: Column | None = None) -> Column:
    """``key: value`` lines in the fixed key order, then one line per described variable."""
    lines = [F.when(F.length(fields[k]) > 0, F.concat(F.lit(f"{k}: "), fields[k]))
             for k in DOCUMENTATION_KEYS if k in fields]
    if descriptions is not None:
        entries = F.filter(F.map_entries(descriptions), lambda e: F.length(e["value"]) > 0)
        lines.append(F.transform(entries, lambda e: F.concat(F.lit("Variable "), e["key"], F.lit(": "), e["value"])))
    return F.concat_ws("\n", *lines)


def literal_map(mapping: dict) -> Column:
    pairs = [F.lit(x) for item in mapping.items() for x in item]
    return F.create_map(*pairs)


def contains_any(text: Column, keywords: list[str]) -> Column:
    """Plain substring test against a bounded keyword list."""
    if not keywords:
        return F.lit(False)
    hit = F.contains(text, F.lit(keywords[0].lower()))
    for k in keywords[1:]:
        hit = hit | F.contains(text, F.lit(k.lower()))
    return hit
