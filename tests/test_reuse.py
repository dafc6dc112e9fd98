"""Text similarity: words counted once and in their own row, whatever ids repeat."""

import math
from collections import Counter, defaultdict

import pytest

from tabsift.config import STOP_WORDS
from tabsift.operators import reuse
from tabsift.queries import reuse as queries

ODD = [(1, "data dictionary describes the variables, data data"), (2, "variable list"), (2, "variable list ünïts words words"), (3, None), (3, "  "),
       (4, ""), (4, "the a of"), (4, "version script Version"), (None, "metadata licence"), (None, "other words other"), (5, "words only other words"), (6, None), (7, "unit kg loinc")]


def expected(rows, components):
    """Similarities from the definition: one vector space per document, fitted on it and the prompts."""
    prompts = {c: dict(p) for c, p in reuse.prompt_terms(components).items()}
    n, counts, out = 1 + len(components), defaultdict(Counter), []
    for i, text in rows:
        words = Counter(w for w in "".join(x if x.isalnum() or x == "_" else " " for x in (text or "").lower()).split() if len(w) > 1 and w not in STOP_WORDS)
        if text is not None and not words:
            out += [(i, c, 0.0) for c in prompts]
        counts[i].update(words)
    for i, doc in counts.items():
        idf = {t: (math.log((1 + n) / (1 + sum(t in p for p in (doc, *prompts.values())))) + 1) for t in {*doc, *(t for p in prompts.values() for t in p)}}
        length = lambda p: math.sqrt(sum((k * idf[t]) ** 2 for t, k in p.items()))  # noqa: E731, B023
        out += [(i, c, sum(k * doc[t] * idf[t] ** 2 for t, k in p.items()) / length(p) / length(doc)) for c, p in prompts.items() if doc]
    return sorted((str(i), c, round(x, 9)) for i, c, x in out)


@pytest.mark.parametrize("rows", [ODD, [r for r in ODD if r[0] in (1, 5, 6, 7)], []])
def test_similarity_is_the_cosine_of_its_definition(spark, rows):
    found = reuse.tfidf_similarities(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), reuse.FACETS)
    for facet, components in reuse.FACETS.items():
        mine = found.where(found["facet"] == facet).drop("facet").collect()
        assert sorted((str(r.doc_id), r.component, round(r.text_similarity, 9)) for r in mine) == expected(rows, components)


def test_words_stay_in_their_row(spark):
    """One row per text and known term is shuffled, not one per word."""
    texts = spark.createDataFrame([(k, " ".join(f"word{j % 100}" for j in range(1000)) + " metadata") for k in range(5)], "doc_id long, text string")
    rows = reuse.word_counts(texts, ["metadata"]).collect()
    assert sorted((r.doc_id, r.term, r.tf, r.squares) for r in rows if r.term) == [(k, "metadata", 1, 0) for k in range(5)]
    assert sorted((r.doc_id, r.squares) for r in rows if not r.term) == [(k, 100 * 10 ** 2 + 1) for k in range(5)]


def test_both_facets_share_one_count(spark, tmp_path):
    spark.createDataFrame([r for r in ODD if r[0] in (1, 5, 6, 7)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    doc, std = (reuse.hybrid_facet(x).select("doc_id", "score") for x in queries.details(spark, str(tmp_path)).values())
    both = doc.join(std.withColumnRenamed("score", "other"), "doc_id")
    assert len(both.collect()) == 4
    final = both._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert final.count("regexp_extract_all(") == 1


def test_keywords_of_declared_components_are_not_looked_for(spark):
    texts = spark.createDataFrame([(1, "license and codebook")], "doc_id long, text string")
    flags = {"licence_or_usage_conditions": 0.5}
    found = {r.component: r.checklist for r in reuse.checklist(texts, queries.DOCUMENTATION_COMPONENTS, flags).collect()}
    assert found["licence_or_usage_conditions"] is None and found["metadata_or_data_dictionary"] == 1.0
    rules = {r.component: (r.rule_score, r.rule_source) for r in reuse.rule_scores(texts, queries.DOCUMENTATION_COMPONENTS, {"reuse_readiness": flags}, queries.CONFIG).collect()}
    assert rules["licence_or_usage_conditions"] == (0.5, "metadata_flag") and rules["metadata_or_data_dictionary"][1] == "checklist"
