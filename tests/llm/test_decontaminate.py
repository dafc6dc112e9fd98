import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from tabsift.llm.decontaminate import contamination, occurrences, postings, windows, words


def split(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, size=10):
    wins = {}
    for i, text in items:
        w = split(text)
        for k in range(max(len(w) - size + 1, 1) if w and i is not None else 0):
            wins.setdefault(tuple(w[k:k + size]), set()).add(i)
    out = {}
    for d, text in docs:
        w, hit, found = split(text), set(), set()
        for n in {len(x) for x in wins}:
            for k in range(len(w) - n + 1):
                if (own := wins.get(tuple(w[k:k + n]))):
                    hit |= set(range(k, k + n))
                    found |= own
        names = sorted(map(str, found))
        out[d] = (len(w), len(hit), len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), bool(hit))
    return out


def result(df):
    return {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in df.collect()}


def test_hits_equal_brute_force(spark):
    rng = random.Random(4)
    word = lambda: rng.choice(["a", "b", "c", "de", "Fg", "h1", "ÉÜ"])
    items = [(k, " ".join(word() for _ in range(rng.choice([1, 2, 3, 4, 9, 10, 11, 14])))) for k in range(25)] + [(30, None), (31, ""), (32, "?!"), (None, "a b"), (2, "zz yy")]
    docs = [(k, rng.choice([" ", ", ", "\n"]).join(word() for _ in range(rng.randrange(60)))) for k in range(40)]
    docs += [(100 + k, f"x {t or ''} y. {t or ''}") for k, (_, t) in enumerate(items)] + [(200, None), (201, "zz YY zz yy")]
    got = contamination(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert result(got) == brute(docs, items)


def test_hits_on_the_tables(spark, documents, folder):
    bench = spark.read.parquet(f"{folder}/benchmark.parquet")
    docs = [(r.doc_id, r.text) for r in documents.collect()]
    assert result(contamination(documents, bench)) == brute(docs, [(r.item_id, r.text) for r in bench.collect()])


def test_hits_on_odd_rows(spark, odd, none):
    bench = spark.createDataFrame([(1, "one TWO", "x"), (2, "gamma delta", "y")], "item_id long, text string, win string")
    out = contamination(odd, bench).collect()
    assert len(out) == odd.count() and contamination(none, bench).count() == 0
    assert {(r.doc_id, r.n_hit, r.n_items) for r in out if r.n_hit} == {(5, 2, 1), (7, 2, 1), (None, 2, 1)}
    empty = contamination(odd, bench.limit(0)).collect()
    assert len(empty) == odd.count() and not any(r.contaminated for r in empty)


def test_repeated_rows_repeat_hits_of_long_windows(spark):
    items = [(1, " ".join(f"t{k}" for k in range(12))), (2, "four words of text"), (3, "no such words stand anywhere at all")]
    docs = [(1, f"x {items[0][1]} y")] * 3 + [(None, f"{items[1][1]} {items[0][1]}")] * 2 + [(2, items[0][1]), (3, items[0][1]), (4, "nothing")]
    out = contamination(spark.createDataFrame(docs, "doc_id long, text string").repartition(4), spark.createDataFrame(items, "item_id long, text string"))
    assert out.count() == len(docs) and out.filter("contaminated").count() == len(docs) - 1
    assert result(out) == brute(docs, items)


@pytest.mark.parametrize("slack,share,expected", [(0, 1.0, {0}), (1, 1.0, {0, 1}), (0, 0.75, {0, 1, 2}), (2, 0.75, {0, 1, 2, 3})])
def test_proximity_matches(spark, slack, share, expected):
    texts = ["q w e r", "q x w e r", "q w e z", "q x y w e"]
    docs = spark.createDataFrame([(k, 0, t) for k, t in enumerate(texts)], "k1 long, k2 int, text string")
    parts = windows(spark.createDataFrame([(1, "q w e r")], "item_id int, text string")).select("win", "len", F.posexplode("terms").alias("off", "term"))
    found = occurrences(postings(docs), parts, slack, share)
    assert {r.k1 for r in found.select("k1").distinct().collect()} == expected


def test_index_holds_every_token(spark, documents):
    docs = documents.select(F.col("doc_id").alias("k1"), F.lit(0).alias("k2"), "text")
    assert postings(docs).count() == documents.agg(F.sum(F.size(words(F.col("text"))))).first()[0]


def test_plan_has_no_python(spark, documents, folder):
    plan = contamination(documents, spark.read.parquet(f"{folder}/benchmark.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan
