import random
import sys
from collections import defaultdict
from pathlib import Path

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

import corpus_pipeline as pipeline  # noqa: E402
from tabsift.llm.decontaminate import contamination  # noqa: E402
from tabsift.llm.line_dedup import remove_boilerplate  # noqa: E402
from tabsift.llm.minhash import near_duplicate_groups  # noqa: E402


@pytest.fixture(scope="module")
def stages(spark, folder):
    docs, out = spark.read.parquet(f"{folder}/documents.parquet"), []
    for _, stage in pipeline.STAGES:
        docs = stage(spark, docs, folder).cache()
        out.append(docs)
    return out


def test_each_stage_works_on_what_was_kept(spark, folder, documents, stages):
    language, lines, near, clean, packed = stages
    for df in stages[:-1]:
        assert df.columns == documents.columns
    assert language.count() >= 0.98 * documents.count()
    assert lines.count() == language.count()
    expected = {(r.doc_id, r.text) for r in remove_boilerplate(language).collect()}
    assert {(r.doc_id, r.text) for r in lines.collect()} == expected
    assert lines.filter("n_chars != char_length(text)").count() == 0
    assert {r.doc_id for r in near.collect()} == {r.doc_id for r in near_duplicate_groups(lines, percent=pipeline.NEAR_PERCENT).filter("kept").collect()}
    bench = spark.read.parquet(f"{folder}/benchmark.parquet")
    hit = {r.doc_id for r in contamination(near, bench).filter("contaminated").collect()}
    assert hit and {r.doc_id for r in clean.collect()} == {r.doc_id for r in near.collect()} - hit
    assert {r.doc_id for r in packed.collect()} == {r.doc_id for r in clean.collect()}


def test_near_duplicates_are_linked_from_four_fifths_on(spark, folder):
    """Against all pairs: of 116 shingles, one changed word leaves 0.92, two 0.84 and three 0.77."""
    rng, rows = random.Random(5), []
    for family in range(8):
        base = [f"f{family}w{k}" for k in range(120)]
        for n in (0, 1, 2, 2, 2, 3, 3, 4):
            text = list(base)
            for k in rng.sample(range(10, 110, 10), n):
                text[k] = f"e{len(rows)}x{k}"
            rows.append((len(rows), " ".join(text)))
    sets = [{tuple(w[k:k + 5]) for k in range(len(w) - 4)} for w in (text.split() for _, text in rows)]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    between = 0
    for j in range(len(rows)):
        for i in range(j):
            both, all_ = len(sets[i] & sets[j]), len(sets[i] | sets[j])
            between += 80 * all_ <= 100 * both < 85 * all_
            if 100 * both >= 80 * all_:
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    kept = pipeline.near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string"), folder)
    assert between and {r.doc_id for r in kept.collect()} == {i for i in range(len(rows)) if root(i) == i}


def test_texts_that_share_an_id_are_judged_apart(spark, folder):
    """A copy, a contaminated text and a repeated row go; other texts under their ids stay, and so do columns of any name."""
    item = next(r.text for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect() if len(r.text.split()) >= 10)
    plain = [" ".join(f"{w}{k}x" for k in range(40)) for w in ("red", "blue", "green")]
    rows = [(1, plain[0], "b"), (1, plain[1], "a"), (1, plain[1], "c"), (2, plain[0], "a"), (2, plain[2], "a"), (2, f"so {item} then", "a"),
            (None, plain[2], "z"), (None, f"{plain[2]} and what else", "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, own string")
    near = pipeline.near_duplicates(spark, docs, folder)
    kept = {tuple(r) for r in near.collect()}
    assert near.columns == docs.columns and near.count() == len(kept) == 4
    assert kept == {rows[0], rows[1], rows[4], rows[5]}
    clean = pipeline.benchmark(spark, near, folder)
    assert {tuple(r) for r in clean.collect()} == {rows[0], rows[1], rows[4]} and clean.columns == docs.columns


def test_run_gives_whole_sequences(spark, folder, stages):
    rows = pipeline.run(spark, folder).collect()
    assert {(r.doc_id, r.piece, r.ids_crc32) for r in rows} == {(r.doc_id, r.piece, r.ids_crc32) for r in stages[-1].collect()}
    spans = defaultdict(list)
    for r in rows:
        spans[r.sequence_id].append((r.offset, r.length))
    for parts in spans.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 4096


def test_stages_on_odd_rows(spark, folder, odd, none):
    for docs in (odd, none, odd.withColumn("n_removed", F.lit(1)).withColumn("__removed2", F.lit(2))):
        for name, stage in pipeline.STAGES:
            kept = stage(spark, docs, folder)
            if name != "packing":
                assert kept.columns == docs.columns and kept.count() <= docs.count(), name
            else:
                assert kept.select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()
