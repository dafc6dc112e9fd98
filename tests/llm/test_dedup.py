import random
import re
from collections import defaultdict

from pyspark.sql import functions as F

from tabsift.llm import minhash
from tabsift.llm.components import connected
from tabsift.llm.line_dedup import remove_boilerplate
from tabsift.llm.minhash import near_duplicate_groups
from tabsift.llm.substring_dedup import remove_repeats


def lines(*numbers):
    return "\n".join(" ".join(f"w{n}_{k}" for k in range(25)) for n in numbers)


def test_repeats_keep_the_first_place_and_offsets(spark):
    rows = [(3, lines(1, 2)), (1, lines(2, 9)), (2, lines(9, 2, 5)), (4, lines(2)), (5, None), (6, "short\nshort"), (7, lines(7, 7) + "\n")]
    out = {r.doc_id: r for r in remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    texts = dict(rows)
    assert out[1].n_removed == 0 and out[1].text == texts[1]
    assert out[2].text == lines(5) and out[3].text == lines(1) + "\n" and out[4].text == "" and out[5].text is None
    assert out[6].text == "short\nshort" and out[7].text == lines(7) + "\n"
    for i, r in out.items():
        for s in r.removed or ():
            assert texts[i][s.start:s.end] in (lines(2), lines(9, 2), lines(7)) and s.first_id in (1, 7)


def test_repeats_ranks_words_and_paragraphs(spark):
    a, b = lines(1), lines(1).upper().replace(" ", "   ")
    rows = spark.createDataFrame([(1, f"x\n\n{a}\n\ny", 2), (2, f"{b}\n\nz", 1)], "doc_id long, text string, rank int")
    out = {r.doc_id: r.text for r in remove_repeats(rows, rank_col="rank", unit="paragraph").collect()}
    assert out[2] == f"{b}\n\nz" and a not in out[1] and out[1].startswith("x") and out[1].endswith("y")


def _runs(rows, min_words=20):
    """(id, removed spans) by looking at every earlier sentence."""
    seen = set()
    for doc_id, text in sorted(rows):
        spans, run, words = [], [], 0
        for m in [*re.finditer(r"[^.!?\n]+[.!?]*[ \t]*|[.!?]+[ \t]*", text), None]:
            unit = m and tuple(m[0].lower().split())
            if m and not unit:
                continue
            if m and unit in seen:
                run, words = [*run, m.span()], words + len(unit)
                continue
            if words >= min_words:
                spans.append((run[0][0], run[-1][1]))
            run, words = [], 0
            if m:
                seen.add(unit)
        yield doc_id, spans


def test_whole_passages_go_whatever_their_lines(spark):
    """Passages of short lines and sentences, inside lines too; short units that recur alone stay."""
    short = ["\n".join(" ".join(f"p{p}l{k}w{j}" for j in range(12)) for k in range(8)) for p in range(3)]
    flowing = ["  ".join(f"S{p} s{k} one two three four{'.!?'[k % 3]}" for k in range(10)) for p in range(3)]
    rng, rows = random.Random(4), []
    for i in range(60):
        own = [f"Own {i} text {rng.randrange(1000)} and so on.", "It is.", "Yes!", f"no full stop {i}", "It is. Yes!"]
        parts = [rng.choice([*short, *flowing, *own, *own, *own, "", "  "]) for _ in range(rng.randint(1, 6))]
        rows.append((i, "".join(p + rng.choice(["\n", " ", "\n\n"]) for p in parts)))
    rows += [(100, short[0]), (101, short[0]), (102, f"mine {flowing[0]} and mine")]
    out = {r.doc_id: [(s.start, s.end) for s in r.removed] for r in remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()}
    assert out == dict(_runs(rows))
    assert out[101] == [(0, len(short[0]))] and sum(map(len, out.values())) > 30


def test_repeats_on_odd_rows(odd, none, long_text):
    out = remove_repeats(odd).collect()
    assert len(out) == odd.count() and remove_repeats(none).count() == 0
    assert {r.doc_id: r.text for r in out}[10] == "" and {r.doc_id: r.text for r in out}[4] == long_text


def test_lines_on_many_sites_go_but_for_the_first(spark):
    rows = [(i, f"own {i}\n  menu home \nbottom {i % 3}\n", f"s{i % 12}" if i else None) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = {r.doc_id: r for r in remove_boilerplate(df, min_sites=10).collect()}
    assert out[0].n_removed == 0 and out[1].text == "own 1\nbottom 1\n" and all(out[i].n_removed == 1 for i in range(1, 40))
    assert {r.n_removed for r in remove_boilerplate(df, min_sites=13).collect()} == {0}
    assert {r.n_removed for r in remove_boilerplate(df, min_sites=12, keep_first=False).collect()} == {1}
    assert {r.n_removed for r in remove_boilerplate(df, min_sites=4).collect()} == {0, 1, 2}


def test_near_threshold_lines_are_counted_exactly(spark):
    """Sketches of 64 registers are off by an eighth; the exact count decides."""
    rows = [(n * 100 + k, f"line {n}", f"s{k}") for n in range(30, 60) for k in range(n)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r.doc_id // 100 for r in remove_boilerplate(df, min_sites=45, lg_k=6).filter("n_removed > 0").select("doc_id").distinct().collect()}
    assert got == set(range(45, 60))


def test_boilerplate_on_odd_rows(odd, none, long_text):
    out = remove_boilerplate(odd, min_sites=2, count_col="gone")
    assert out.columns == [*odd.columns, "gone"] and out.count() == odd.count() and remove_boilerplate(none).count() == 0
    texts = defaultdict(list)
    for r in out.collect():
        texts[r.doc_id].append(r.text)
    assert texts[1] == [None] and texts[4] == [long_text] and texts[10] == [""] and texts[5] == ["one two"] * 2 and texts[3] == ["  \n\t "]


def brute_groups(rows):
    """Components of all pairs whose shingle sets are similar enough."""
    sets = {}
    for i, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets[i] = frozenset(tuple(w[k:k + 5]) for k in range(max(len(w) - 4, 1))) if w else frozenset()
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(i for i in sets if sets[i])
    for k, i in enumerate(ids):
        for j in ids[k + 1:]:
            both = len(sets[i] & sets[j])
            if 100 * both >= 85 * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    return {i: (len(sets[i]), root(i), root(i) == i) for i in sets}


def copies(seed=3, families=6, size=14):
    """Chains and stars of edited copies on both sides of the threshold."""
    rng, rows, i = random.Random(seed), [], 0
    for f in range(families):
        base = [f"f{f}w{k}" for k in range(120)]
        for c in range(size):
            words = list(rows[rng.randrange(len(rows))][1].split()) if rows and rng.random() < 0.2 else list(base)
            for _ in range(rng.choice([0, 1, 2, 3, 4])):
                words[rng.randrange(len(words))] = f"e{rng.randrange(10**6)}"
            rows.append((rng.randrange(10**6) * 100 + i, " ".join(words)))
            i += 1
    return rows


def test_groups_equal_brute_force(spark, documents):
    rows = copies() + [(r.doc_id + 10**9, r.text) for r in documents.collect()] + [(-1, "A b"), (-2, "a B"), (-3, ""), (-4, None), (-5, "\x0b \x0c")]
    out = near_duplicate_groups(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in out.collect()} == brute_groups(rows)


def test_large_candidate_groups_are_split_into_blocks(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", 3)
    rows = copies(seed=8, families=2, size=40)
    out = near_duplicate_groups(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in out.collect()} == brute_groups(rows)


def test_texts_of_a_shared_template_are_not_read(spark, monkeypatch):
    """Texts that share two thirds of their words are candidates of each other, but no block fetches their texts."""
    monkeypatch.setattr(minhash, "BLOCK", 16)
    template = " ".join(f"t{k}" for k in range(200))
    rows = [(i, template + " " + " ".join(f"own{i}x{k}" for k in range(100))) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, text string")
    minhash.ship(spark)
    reps = minhash._nodes(minhash.signatures(df)).cache()
    bands, buckets = minhash._candidates(reps)
    members = bands.join(buckets, "key").filter("node != leader")
    placed = minhash._block_pairs(members, spark.createDataFrame([], "node long, component long")).cache()
    assert placed.count() > 3000 and minhash._readers(placed, reps, 80).count() == 0
    assert {r.component_id for r in near_duplicate_groups(df, "id", percent=80).collect()} == set(range(300))


def test_two_texts_under_one_id_in_blocks(spark, monkeypatch):
    """An id that stands for two classes keeps the links of both, also where blocks find them; repeated rows change nothing."""
    monkeypatch.setattr(minhash, "BLOCK", 2)
    rows = copies(seed=8, families=2, size=40)
    low = min(i for i, _ in rows) - 1
    rows = [(low, rows[0][1]), (low, rows[-1][1])] + rows
    out = {(r.doc_id, r.component_id) for r in near_duplicate_groups(spark.createDataFrame(rows + rows[:9], "doc_id long, text string")).collect()}
    groups = brute_groups([(k, text) for k, (_, text) in enumerate(rows)])
    joined = {groups[0][1], groups[1][1]}
    for k, (i, _) in enumerate(rows):
        root = 0 if groups[k][1] in joined else groups[k][1]
        least = min(j for m, (j, _) in enumerate(rows) if (groups[m][1] in joined if root == 0 else groups[m][1] == root))
        assert (i, least) in out


def test_estimate_is_close_to_the_similarity():
    import numpy as np
    rng = np.random.default_rng(0)
    for share in (0.3, 0.6, 0.85, 1.0):
        n = 2000
        common = int(2 * n * share / (1 + share))
        pool = rng.integers(0, 2**64, 2 * n, dtype=np.uint64)
        a, b = pool[:n], np.concatenate((pool[:common], pool[n:2 * n - common]))
        both = minhash.pack(minhash.minima_of(np.concatenate((a, b)), np.array([n, len(b)]))).reshape(2, minhash.BITS, minhash.WORDS)
        equal = 1 - np.bitwise_count(np.bitwise_or.reduce(both[0] ^ both[1], axis=0)).sum() / minhash.MINIMA
        assert abs((equal - 2.0 ** -minhash.BITS) / (1 - 2.0 ** -minhash.BITS) - share) < 0.12


def test_groups_on_odd_rows(odd, none):
    out = near_duplicate_groups(odd).collect()
    assert len(out) == odd.count() and near_duplicate_groups(none).count() == 0
    by = defaultdict(set)
    for r in out:
        by[r.doc_id].add((r.n_shingles, r.component_id, r.kept))
    assert by[1] == {(0, 1, True)} and by[3] == {(0, 3, True)} and by[5] == {(1, 5, True)} and by[None] == {(2, None, True)}
    assert by[4] == {(19996, 4, True)} and by[10] == {(19996, 4, False)} and by[7] == {(2, 7, True)}


def test_components_of_chains_and_stars(spark):
    edges = [(k, k + 1) for k in range(1, 40)] + [(100, k) for k in range(101, 120)] + [(7, 7), (None, 3), (200, 201), (201, 200)]
    out = {r.node: r.component for r in connected(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    assert out == {k: 1 for k in range(1, 41)} | {k: 100 for k in range(100, 120)} | {200: 200, 201: 200}
    assert connected(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


def test_plans_hold_no_python_for_line_dedup(documents):
    plan = remove_boilerplate(documents)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan
