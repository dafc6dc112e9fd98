import hashlib
import re
from collections import Counter
from statistics import median

from pyspark.sql import functions as F

from tabsift.llm import fingerprint
from tabsift.llm.fingerprint import DIGITS, SUBSETS, document_fingerprints, edited_fingerprints


def cells(fingerprint):
    return [fingerprint[k:k + DIGITS] for k in range(0, SUBSETS * DIGITS, DIGITS)]


def likeness(a, b):
    if a == b or a[0] == "=" or b[0] == "=":
        return float(a == b)
    used = [(x, y) for x, y in zip(cells(a), cells(b)) if x[0] != "." or y[0] != "."]
    return sum(x == y for x, y in used) / len(used)


def check(rows, out):
    """Texts, ids in descending order, and likenesses against the definition; ids are distinct."""
    order = sorted(rows, key=lambda i: (i is not None, i), reverse=True)
    assert sorted(r.doc_id is None or r.doc_id for r in out) == sorted(i is None or i for i in rows)
    by = {r.doc_id: r for r in out}
    for k, i in enumerate(order):
        text, after = rows[i] or "", order[(k + 1) % len(order)]
        half, r = len(text) // 2, by[i]
        edited = text[:len(text) - half] + (rows[after] or "")[:half]
        assert r.n_chars == len(text) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert abs(r.near_edited - likeness(r.fingerprint, r.edited_fingerprint)) < 1e-9
        assert abs(r.near_next - likeness(r.fingerprint, by[after].fingerprint)) < 1e-9
    same = {}
    for i, text in rows.items():
        assert same.setdefault(text or "", by[i].fingerprint) == by[i].fingerprint
    return by


def test_edited_texts_and_likeness(documents):
    by = check({r.doc_id: r.text for r in documents.collect()}, edited_fingerprints(documents).collect())
    assert median(r.near_edited for r in by.values()) > 0.08 > 0.03 > median(r.near_next for r in by.values())


def test_odd_rows(spark, odd, none):
    once = odd.dropDuplicates(["doc_id"])
    check({r.doc_id: r.text for r in once.collect()}, edited_fingerprints(once).collect())
    assert edited_fingerprints(odd).count() == odd.count() and edited_fingerprints(none).count() == 0
    check({7: "only one text"}, edited_fingerprints(spark.createDataFrame([(7, "only one text")], "doc_id long, text string")).collect())
    assert document_fingerprints(none).count() == 0 and document_fingerprints(odd).count() == odd.count()


def test_both_ways_agree(documents):
    a = {r.doc_id: r.fingerprint for r in document_fingerprints(documents).collect()}
    assert a == {r.doc_id: r.fingerprint for r in edited_fingerprints(documents).collect()}


def test_plan_has_no_python(documents):
    plan = edited_fingerprints(documents)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan


def test_copies_do_not_change_the_lexicon(documents):
    """A third of the rows equal: all fingerprints are those of the same texts without copies."""
    once = documents.select("doc_id", "text").dropDuplicates(["text"]).cache()
    text = max((r.text for r in once.collect() if r.text), key=lambda t: len(set(t.split())))
    first = once.agg(F.max("doc_id")).first()[0] + 1
    copies = once.sparkSession.range(first, first + once.count() // 2).select(F.col("id").alias("doc_id"), F.lit(text).alias("text"))
    alone = {r.doc_id: r.fingerprint for r in document_fingerprints(once).collect()}
    mixed = edited_fingerprints(once.union(copies)).collect()
    assert alone == {r.doc_id: r.fingerprint for r in mixed if r.doc_id < first}
    assert not any(r.fingerprint.startswith("=") for r in mixed if r.doc_id >= first)
    assert median(r.near_edited for r in mixed if r.doc_id >= first) > 0


def test_many_repeated_texts_give_the_same_lexicon(documents, monkeypatch):
    docs = documents.union(documents.limit(20))
    few = {tuple(r) for r in fingerprint.lexicon(docs.select("text")).collect()}
    monkeypatch.setattr(fingerprint, "BROADCAST_ROWS", 3)
    assert few and few == {tuple(r) for r in fingerprint.lexicon(docs.select("text")).collect()}


def test_text_ids_and_ranges_of_bytes(documents, monkeypatch):
    """Ids that are texts follow their bytes; every range is one partition and no range is much larger than wanted."""
    named = documents.select(F.md5(F.col("doc_id").cast("string")).alias("doc_id"), "text")
    monkeypatch.setattr(fingerprint, "RANGE_BYTES", 2000)
    rows = named.collect()
    by = {r.doc_id: r for r in edited_fingerprints(named).collect()}
    check({r.doc_id: r.text for r in rows}, list(by.values()))
    placed = fingerprint.with_next(named).select("part", F.spark_partition_id().alias("at"), F.octet_length("text").alias("bytes"), "extra").collect()
    tasks, size = {}, {}
    for r in placed:
        tasks.setdefault(r["at"], set()).add(r.part)
        size[r.part] = size.get(r.part, 0) + (0 if r.extra else r.bytes)
    assert len(size) > 40 and all(len(parts) == 1 for parts in tasks.values())
    longest = max(len((r.text or "").encode()) for r in rows)
    assert max(size.values()) <= 2 * 2000 + longest


def brute_hashes(texts):
    """The fingerprint by its definition: band, three families of subsets, sorted terms hashed per subset."""
    words = lambda t: {w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", t.lower()) if w}
    distinct, df = {t or "" for t in texts}, Counter()
    for t in distinct:
        df.update(words(t))
    n, out = len(distinct), {}
    for t in distinct:
        subsets = {}
        for w in words(t):
            if 0.001 * n <= df[w] <= 0.2 * n:
                draw = int(hashlib.md5(w.encode()).hexdigest()[:12], 16)
                for k in range(3):
                    if draw // 64 ** (2 * k + 1) % 8 ** k == 0:
                        subsets.setdefault(draw // 64 ** (2 * k) % 64 + 64 * k, []).append(w)
        joined = "".join(hashlib.md5(" ".join(sorted(subsets[s], key=str.encode)).encode()).hexdigest()[:8] if s in subsets else "." * 8 for s in range(192))
        out[t] = joined if subsets else "=" + hashlib.md5(t.encode()).hexdigest()
    return out


def test_band_subsets_and_hashes_by_definition(documents):
    rows = documents.collect()
    expected = brute_hashes([r.text for r in rows])
    got = {r.doc_id: r.fingerprint for r in edited_fingerprints(documents).collect()}
    assert got == {r.doc_id: expected[r.text or ""] for r in rows}
