"""Documentation evidence (keywords and text similarity), machine readability and the reuse score.

Everything works on a table of documents keyed by ``doc_id``: one row per dataset's documentation, or a whole
corpus. The component prompts are a bounded constant and travel as literals or as a broadcast term table.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from tabsift.config import AMBIGUOUS_ROLES, DOCUMENTATION_COMPONENTS, DOCUMENTATION_KEYS, STANDARDISATION_COMPONENTS, STOP_WORDS
from tabsift.dataset import Dataset
from tabsift.functions import exprs as X
from tabsift.operators.accuracy import issue_columns
from tabsift.operators.roles import unit_literals

FACETS = {"documentation": DOCUMENTATION_COMPONENTS, "standardisation": STANDARDISATION_COMPONENTS}


def prompt_terms(components: dict) -> dict[str, Counter]:
    stop = set(STOP_WORDS)
    return {name: Counter(w for w in re.findall(r"\w{2,}", " ".join(c["prompts"]).lower()) if w not in stop)
            for name, c in components.items()}


def _squares(words: Column) -> Column:
    """The sum of the squared counts of a text's words, in one walk over them in order: the n-th of equal words adds 2n - 1."""
    start = F.struct(F.lit("").alias("word"), F.lit(0).cast("long").alias("odd"), F.lit(0).cast("long").alias("before"))
    return F.aggregate(F.sort_array(words), start,
                       lambda a, w: F.struct(w.alias("word"), F.when(w == a["word"], a["odd"] + 2).otherwise(F.lit(1).cast("long")).alias("odd"),
                                             (a["before"] + a["odd"]).alias("before")),
                       lambda a: a["before"] + a["odd"])


def word_counts(documents: DataFrame, vocabulary: list[str]) -> DataFrame:
    """(doc_id, term, tf, squares, wordless): a row per document and vocabulary term in it, and one without a term.

    The latter has the sum of squared counts of all words but stop words, and how many of the document's texts have none; null texts
    count as no text. Texts that share an id are one document. A text's words are counted in its own row, and only those few numbers are
    shuffled; counts of repeated words meet by id and term only for ids that do repeat.
    """
    def cut(rows):
        return rows.where(F.col("text").isNotNull()).select("doc_id", F.filter(X.words(F.col("text")), lambda w: ~w.isin(STOP_WORDS)).alias("words"))

    def entry(term, tf=0, squares=0, wordless=0):
        numbers = {"tf": tf, "squares": squares, "wordless": wordless}
        return F.struct(term.cast("string").alias("term"), *[(v if isinstance(v, Column) else F.lit(v)).cast("long").alias(k) for k, v in numbers.items()])

    def counted(rows, squares):
        known = F.transform(F.filter("words", lambda w: w.isin(vocabulary)), lambda w: entry(w, tf=1))
        own = F.array(entry(F.lit(None), squares=squares, wordless=F.size("words") == 0))
        return rows.select("doc_id", F.inline(F.concat(known, own)))

    repeated = documents.groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias("repeated"))
    if repeated.isEmpty():
        parts = counted(cut(documents), _squares(F.col("words")))
    else:
        same = F.col("doc_id").eqNullSafe(F.col("repeated"))
        once, again = (cut(documents.join(repeated, same, how)) for how in ("left_anti", "left_semi"))
        merged = again.select("doc_id", F.explode("words").alias("term")).groupBy("doc_id", "term").count()
        merged = merged.select("doc_id", F.inline(F.array(entry(F.lit(None), squares=F.col("count") * F.col("count")))))
        parts = counted(once, _squares(F.col("words"))).unionByName(counted(again, F.lit(0))).unionByName(merged)
    return parts.groupBy("doc_id", "term").agg(*[F.sum(c).alias(c) for c in ("tf", "squares", "wordless")])


def tfidf_similarities(documents: DataFrame, facets: dict[str, dict]) -> DataFrame:
    """(facet, doc_id, component, text_similarity): cosine of each document with each component's prompts.

    Weights are fitted per document on that document and the prompts of a facet, so a term's weight depends only on the
    prompts and on whether the document has it. Prompt norms are a constant plus a correction for the terms
    the document shares; the rest of the document only enters its own norm. Words are counted once for all facets.
    """
    prompts = {f: prompt_terms(components) for f, components in facets.items()}
    vocabulary = sorted({t for p in prompts.values() for terms in p.values() for t in terms})
    columns, sums, scored = {"term": vocabulary}, [F.sum("squares").alias("squares"), F.sum("wordless").alias("wordless")], []
    for k, (facet, terms) in enumerate(prompts.items()):
        def idf(df, n=1 + len(terms)):
            return math.log((1 + n) / (1 + df)) + 1

        spread = {t: sum(t in p for p in terms.values()) for t in vocabulary}
        columns[f"present{k}"] = [idf(spread[t] + 1) ** 2 if spread[t] else None for t in vocabulary]
        columns[f"absent{k}"] = [idf(spread[t]) ** 2 if spread[t] else None for t in vocabulary]
        present, absent, rare = F.col(f"present{k}"), F.col(f"absent{k}"), idf(1) ** 2
        sums.append(F.sum(F.col("squares") * rare + F.coalesce(F.col("tf") * F.col("tf") * (present - rare), F.lit(0.0))).alias(f"norm{k}"))
        for i, (name, p) in enumerate(terms.items()):
            at = f"{k}_{i}"
            columns[f"p{at}"] = [float(p[t]) for t in vocabulary]
            base = sum(p[t] ** 2 * idf(spread[t]) ** 2 for t in p)
            sums.append(F.coalesce(F.sum(F.col("tf") * F.col(f"p{at}") * present), F.lit(0.0)).alias(f"dot{at}"))
            sums.append(F.coalesce(F.sum(F.col(f"p{at}") * F.col(f"p{at}") * (present - absent)), F.lit(0.0)).alias(f"extra{at}"))
            similar = X.safe_div(F.col(f"dot{at}"), F.sqrt(F.col(f"norm{k}") * (F.lit(base) + F.col(f"extra{at}"))))
            # Texts without a single word keep a row per component each.
            scored.append(F.struct(F.lit(facet).alias("facet"), F.lit(name).alias("component"), F.when(F.col("nth") > 0, 0.0).otherwise(similar).alias("text_similarity")))
    table = documents.sparkSession.createDataFrame(
        list(zip(*columns.values())), ", ".join(f"{c} {'string' if c == 'term' else 'double'}" for c in columns))
    per_doc = word_counts(documents, vocabulary).join(F.broadcast(table), "term", "left").groupBy("doc_id").agg(*sums)
    each = per_doc.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("wordless"))).alias("nth")).where("nth > 0 or squares > 0")
    return each.select("doc_id", F.inline(F.array(*scored))).select("facet", "doc_id", "component", "text_similarity")


def tfidf_similarity(documents: DataFrame, components: dict) -> DataFrame:
    """(doc_id, component, text_similarity) of one facet's components."""
    return tfidf_similarities(documents, {"": components}).drop("facet")


def facet_text_scores(documents: DataFrame, facets: dict[str, dict], config: dict) -> dict[str, DataFrame]:
    """TF-IDF similarity of each facet scaled to a score; blank documents are marked as not applied."""
    low, high = config["reuse"]["tfidf_range"]
    blank = documents.select("doc_id", (X.strip(F.coalesce("text", F.lit(""))) == "").alias("blank"))
    sims = tfidf_similarities(documents.withColumn("text", F.coalesce("text", F.lit(""))), facets).join(blank, "doc_id")
    scores = sims.select("facet", "doc_id", "component", "text_similarity",
                         F.when(F.col("blank"), 0.0).otherwise(X.minmax_similarity(F.col("text_similarity"), low, high)).alias("text_score"),
                         F.when(F.col("blank"), "not_applied_no_documentation").otherwise("tfidf_cosine_similarity").alias("text_method"))
    return {name: scores.where(F.col("facet") == name).drop("facet") for name in facets}


def text_scores(documents: DataFrame, components: dict, config: dict) -> DataFrame:
    """The text scores of one facet's components."""
    return facet_text_scores(documents, {"": components}, config)[""]


def embedding_scores(documents: DataFrame, vector: str, prompts: dict[str, list[float]], config: dict) -> DataFrame:
    """Cosine of document vectors with prompt vectors; the prompt set is a bounded literal."""
    low, high = config["reuse"]["embedding_range"]
    scored = F.transform(unit_literals(prompts, "component"), lambda p: F.struct(
        p["component"].alias("component"), X.cosine(p["v"], F.col("vector"), F.col("norm")).alias("text_similarity")))
    return (documents.select("doc_id", F.col(vector).alias("vector")).withColumn("norm", X.length(F.col("vector")))
            .select("doc_id", F.inline(scored))
            .select("doc_id", "component", "text_similarity", X.minmax_similarity(F.col("text_similarity"), low, high).alias("text_score"),
                    F.lit("embedding_cosine_similarity").alias("text_method")))


def similarity_precedence(logit: Column, embedding: Column, tfidf: Column, config: dict) -> tuple[Column, Column]:
    """Score and method of the best available evidence: cross-encoder, then embedding, then TF-IDF."""
    r = config["reuse"]
    score = F.coalesce(F.when(logit.isNotNull(), X.logistic_score(logit, r["logit_midpoint"], r["logit_scale"])),
                       F.when(embedding.isNotNull(), X.minmax_similarity(embedding, *r["embedding_range"])),
                       X.minmax_similarity(tfidf, *r["tfidf_range"]))
    method = (F.when(logit.isNotNull(), "cross_encoder_reranking").when(embedding.isNotNull(), "embedding_cosine_similarity")
              .otherwise("tfidf_cosine_similarity"))
    return score, method


def checklist(documents: DataFrame, components: dict, declared: dict | None = None) -> DataFrame:
    """(doc_id, component, checklist): 1.0 where any keyword occurs anywhere in the text; not looked for, and null, where ``declared`` has the component."""
    text = F.lower(F.coalesce("text", F.lit("")))
    hits = F.array(*[F.struct(F.lit(c).alias("component"), (F.lit(None) if c in (declared or {}) else X.contains_any(F.col("low"), spec["keywords"])).cast("double").alias("checklist"))
                     for c, spec in components.items()])
    return documents.select("doc_id", text.alias("low")).select("doc_id", F.inline(hits))


def explicit_flag(metadata: dict, component: str) -> object | None:
    """The declared flag: the readiness block first, else a metadata field of the same name."""
    flags = metadata.get("reuse_readiness") or {}
    return flags[component] if component in flags else metadata.get(component)


def flag_score(value: object) -> float:
    if isinstance(value, bool):
        return float(value)
    try:
        x = float(value)  # type: ignore[arg-type]
    except (TypeError, ValueError):
        return 0.0
    return 0.0 if x != x else max(0.0, min(1.0, x))


def rule_scores(documents: DataFrame, components: dict, metadata: dict, config: dict, confirmed: DataFrame | None = None) -> DataFrame:
    """Explicit flag, else checklist; a confirmed proposal lifts the score to 1.

    ``confirmed`` holds human-confirmed (doc_id, component) rows.
    """
    flags = {c: flag_score(explicit_flag(metadata, c)) for c in components if explicit_flag(metadata, c) is not None}
    flag = F.try_element_at(X.literal_map(flags), F.col("component")) if flags else F.lit(None).cast("double")
    base = checklist(documents, components, flags).withColumn("flag", flag)
    if confirmed is None:
        base = base.withColumn("agreed", F.lit(False))
    else:
        base = (base.join(confirmed.select("doc_id", "component", F.lit(True).alias("agreed")), ["doc_id", "component"], "left")
                .withColumn("agreed", F.coalesce("agreed", F.lit(False))))
    rule = F.coalesce("flag", X.clip01(F.col("checklist") * config["reuse"]["checklist_rule_weight"]))
    return base.select("doc_id", "component", F.when(F.col("agreed"), 1.0).otherwise(rule).alias("rule_score"),
                       F.when(F.col("flag").isNotNull(), "metadata_flag").when(F.col("agreed"), "llm_confirmed")
                       .otherwise("checklist").alias("rule_source"))


def confirmed_proposals(proposals: DataFrame, enabled: bool) -> DataFrame:
    """(doc_id, component) of proposals that may count: the layer is on, status is proposed, present is set."""
    return proposals.where(F.lit(enabled) & (F.col("status") == "proposed") & (F.col("present") == 1)).select("doc_id", "component")


def hybrid_detail(rules: DataFrame, texts: DataFrame, config: dict) -> DataFrame:
    """Rule and text evidence per component, joined on document and component."""
    r = config["reuse"]
    blend = r["checklist_weight"] * F.col("rule_score") + r["similarity_weight"] * F.coalesce("text_score", F.lit(0.0))
    return rules.join(texts, ["doc_id", "component"], "left").withColumn("hybrid_component_score", blend)


def hybrid_facet(detail: DataFrame) -> DataFrame:
    """(doc_id, score, rule_mean, n_missing, missing) per document."""
    order = F.array_sort(F.collect_list(F.when(F.col("rule_score") < 1, F.col("component"))))
    return detail.groupBy("doc_id").agg(
        X.clip01(F.avg("hybrid_component_score")).alias("score"), F.avg("rule_score").alias("rule_mean"),
        F.count_if(F.col("rule_score") < 1).alias("n_missing"), F.concat_ws(", ", order).alias("missing"))


def facet_issues(facet: DataFrame, name: str) -> DataFrame:
    severity = F.when(F.col("score") >= 0.34, "medium").otherwise("high")
    return facet.where("n_missing > 0").select(*issue_columns(
        "R", "metadata_checklist", F.lit(f"{name}_gaps"), F.lit(None), F.col("n_missing"), severity, "documentation",
        F.concat(F.lit("missing: "), F.col("missing"))))


def documentation_frame(ds: Dataset) -> DataFrame:
    """The dataset's own documentation text as a one-row table (doc_id = 0)."""
    m = ds.metadata
    fields = {k: F.lit(str(m[k])) for k in DOCUMENTATION_KEYS if m.get(k)}       # lists, numbers and true as Python writes them
    described = {k: str(v) for k, v in (m.get("variable_descriptions") or {}).items() if v}
    text = X.assemble_documentation(fields, X.literal_map(described) if described else None)
    return ds.df.sparkSession.range(1).select(F.col("id").alias("doc_id"), text.alias("text"))


def machine_readability(profile: DataFrame, columns: list[str], encoding_note: str, config: dict) -> DataFrame:
    """(component, score, weight, weighted_score) from the profile and the header."""
    weights = config["reuse"]["machine_readability"]
    bad = header_defects(columns)
    clean = max(0.0, 1 - bad / len(columns)) if columns else 0.0
    clean *= 0.9 if encoding_note == "non_utf8_latin1_fallback" else 1.0
    scores = profile.agg(
        X.clip01(F.avg((F.col("role_confidence") >= config["roles"]["low_confidence"]).cast("double"))).alias("confident_typing"),
        F.lit(clean).alias("clean_headers"),
        X.clip01(1 - F.coalesce(F.avg(F.col("role").isin(AMBIGUOUS_ROLES).cast("double")), F.lit(0.0))).alias("parseable_values"))
    rows = F.array(*[F.struct(F.lit(k).alias("component"), F.col(k).alias("score"), F.lit(w).alias("weight")) for k, w in weights.items()])
    return scores.select(F.inline(rows)).withColumn("weighted_score", F.col("score") * F.col("weight"))


def header_defects(columns: list[str]) -> int:
    """Unnamed headers (the reader's ``_cN`` names are such) plus repeated ones."""
    unnamed = sum(bool(re.match(r"unnamed|_c\d+$", c.lower())) for c in columns)
    return unnamed + len(columns) - len(set(columns))


def header_issues(columns: list[str], encoding_note: str) -> list[tuple]:
    found = []
    if encoding_note == "non_utf8_latin1_fallback":
        found.append(("R", "machine_readability", "non_utf8_encoding", None, 1, "low", "documentation", "encoding fallback"))
    if header_defects(columns):
        found.append(("R", "machine_readability", "unclean_headers", None, header_defects(columns), "medium", "schema_confirmation", "headers"))
    return found


def reuse_score(facets: DataFrame) -> DataFrame:
    return facets.agg(X.clip01(F.sum("weighted_score")).alias("R"))


def facet_table(scores: dict[str, Column], config: dict) -> Column:
    """The four facets with their weights as an array to inline."""
    weights = config["scoring"]["R"]
    return F.array(*[F.struct(F.lit(k).alias("facet"), scores[k].alias("score"), F.lit(w).alias("weight"),
                              (scores[k] * F.lit(w)).alias("weighted_score")) for k, w in weights.items()])


def readiness_baseline(documentation: Column, standardisation: Column, rule_documentation: Column, rule_standardisation: Column,
                       privacy: Column, machine: Column, config: dict) -> Column:
    """The checklist-only score beside the four-facet one, as an array to inline."""
    w = config["scoring"]["R"]
    rest = w["privacy"] * privacy + w["machine_readability"] * machine

    def entry(method, doc, std, text):
        return F.struct(F.lit(method).alias("method"), X.clip01(w["documentation"] * doc + w["standardisation"] * std + rest).alias("R_score"),
                        F.lit(text).alias("description"))

    return F.array(
        entry("metadata_checklist_only", rule_documentation, rule_standardisation,
              "Rule-based metadata completeness only (no text similarity)."),
        entry("hybrid_documentation_standardisation_privacy_machine_readability", documentation, standardisation,
              "Four-facet hybrid: checklist + TF-IDF text similarity + k-anonymity + machine-readability."))


def union_details(parts: dict[str, DataFrame]) -> DataFrame:
    """Component details of all facets in one table; missing fields become NULL."""
    labelled = [df.withColumn("facet", F.lit(name)) for name, df in parts.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), labelled)
