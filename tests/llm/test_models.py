import random
import zlib

import numpy as np
import pyarrow as pa

from tabsift.llm import langid, toxicity
from tabsift.llm.langid import Network, identify, windows_of
from tabsift.llm.toxicity import fit, slots


def fold(i):
    return zlib.crc32(str(i).encode()) % 3 == 1


def test_gradients_equal_differences():
    """The loss changes as the gradient says, for every kind of weight."""
    rng = np.random.default_rng(3)
    net = Network(3)
    net.weights = {k: v.astype(np.float64) for k, v in net.weights.items()}
    net.mask = net.mask.astype(np.float64)
    x, y = rng.integers(1, 256, (4, 40), dtype=np.uint8), np.array([0, 1, 2, 1])

    def loss():
        logits = net.pooled(x)[2] @ net.weights["out"] + net.weights["shift"]
        logits -= logits.max(axis=1, keepdims=True)
        return float((np.log(np.exp(logits).sum(axis=1)) - logits[np.arange(4), y]).mean())

    for name, g in net.gradients(x, y).items():
        flat = np.abs(g).ravel()
        for k in np.argsort(-flat)[:5]:
            at = np.unravel_index(k, g.shape)
            net.weights[name][at] += 1e-5
            up = loss()
            net.weights[name][at] -= 2e-5
            assert abs((up - loss()) / 2e-5 - g[at]) < 1e-4 * max(1, abs(g[at]))
            net.weights[name][at] += 1e-5


def test_windows_cover_whole_texts():
    texts = [b"", b"a", b"x" * langid.WINDOW, b"y" * (langid.WINDOW + 1), bytes(range(1, 200)) * 9]
    windows, counts = windows_of(np.frombuffer(b"".join(texts), dtype=np.uint8), np.cumsum([0, *map(len, texts)]))
    assert counts.tolist() == [-(-len(t) // langid.WINDOW) for t in texts]
    ends = np.cumsum(counts)
    for text, end, n in zip(texts, ends, counts):
        assert windows[end - n:end].tobytes().rstrip(b"\0") == text


def test_languages_are_told_apart_on_the_held_out_fold(spark):
    rng = random.Random(1)
    parts = {"xx": ["ka", "lo", "mi", "tu"], "yy": ["ber", "sch", "ung", "ein"], "zz": ["ñe", "ção", "ário", "ée"]}
    rows = [(i, " ".join("".join(rng.choices(parts[lang], k=3)) for _ in range(30)), lang if rng.random() < 0.9 else None)
            for i in range(600) for lang in [rng.choice(sorted(parts))]]
    # The held-out fold has wrong labels, which must not be learned.
    shown = spark.createDataFrame([(i, t, "wrong" if fold(i) else lang) for i, t, lang in rows], "doc_id long, text string, lang string")
    out = {r.doc_id: r for r in identify(shown).collect()}
    assert all(r.held_out == fold(i) and 0 <= r.score <= 1 for i, r in out.items())
    known = [(i, lang) for i, _, lang in rows if fold(i) and lang]
    assert sum(out[i].lang_pred == lang for i, lang in known) >= 0.97 * len(known)


def test_languages_on_the_tables(documents):
    out = {r.doc_id: r for r in identify(documents).collect()}
    rows = [r for r in documents.collect() if fold(r.doc_id) and r.lang]
    assert sum(out[r.doc_id].lang_pred == r.lang for r in rows) >= 0.85 * len(rows)


def test_languages_on_odd_rows(odd, none):
    out = identify(odd, epochs=1, steps=20).collect()
    assert len(out) == odd.count() and identify(none).count() == 0
    by = {r.doc_id: r.lang_pred for r in out}
    assert [by[k] for k in (1, 2, 3, 8)] == ["und"] * 4 and by[4] in ("en", "fr")
    assert {r.lang_pred for r in identify(odd.filter("lang is null and doc_id = 7")).collect()} == {"und"}


def test_features_start_at_words_and_stay_within_texts():
    data, offsets = np.frombuffer(b"Idiots!abcdefg", dtype=np.uint8), np.array([0, 7, 7, 14])
    row, slot = slots(data, offsets)
    assert set(row.tolist()) == {0, 2}
    alone = slots(np.frombuffer(b"idiots ", dtype=np.uint8), np.array([0, 7]))[1]
    assert sorted(slot[row == 0].tolist()) == sorted(alone.tolist())


def marked(n, seed, share):
    rng = random.Random(seed)
    words = ["".join(rng.choices("abcdefghij", k=5)) for _ in range(300)]
    out = []
    for _ in range(n):
        toxic = rng.random() < share
        out.append((" ".join(rng.choices(words, k=60) + (rng.choices(["zqvile", "zqhate", "zqscum"], k=3) if toxic else [])), toxic))
    return out


def test_risk_corrects_for_toxic_texts_among_the_unlabelled():
    sample = marked(1500, 1, 0.3)
    model = fit(pa.array([t for t, y in marked(400, 1, 1.0)], pa.large_string()), pa.array([t for t, _ in sample], pa.large_string()), 0.3)
    kept, w, bias = model
    hit = 0
    for text, y in marked(300, 1, 0.4):
        data = np.frombuffer(text.encode(), dtype=np.uint8)
        own = np.isin(kept, slots(data, np.array([0, len(data)]))[1])
        hit += (toxicity._sigmoid(w[own].sum() + bias) >= 0.7) == y
    assert hit >= 0.98 * 300


def test_toxic_texts_are_found_on_the_held_out_fold(spark):
    texts = marked(1200, 9, 0.25)
    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(texts)], "doc_id long, text string")
    # A third is labelled; labels of the held-out fold are turned round and must not be learned.
    labels = spark.createDataFrame([(i, int(y) if not fold(i) else int(not y)) for i, (_, y) in enumerate(texts) if i % 2], "doc_id long, toxic int")
    out = {r.doc_id: r for r in toxicity.toxicity(docs, labels).collect()}
    assert all(r.held_out == fold(i) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for i, r in out.items())
    held = [i for i in out if fold(i)]
    assert sum(out[i].predicted == texts[i][1] for i in held) >= 0.97 * len(held)


def test_toxicity_on_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(4, 1), (5, 0), (None, 1), (7, None)], "doc_id long, toxic int")
    out = toxicity.toxicity(odd, labels).collect()
    assert len(out) == odd.count() and toxicity.toxicity(none, labels).count() == 0
    assert all(0 <= r.score <= 1 for r in toxicity.toxicity(odd, labels.limit(0)).collect())


def test_features_of_long_texts_are_those_of_one_block(monkeypatch):
    rng = random.Random(4)
    texts = [" ".join(rng.choices(["ab", "réeuxpa", "réeuxvi", "x", "trash", "bomentes"], k=k)).encode() for k in (0, 1, 40, 700, 3)]
    data, offsets = np.frombuffer(b"".join(texts), dtype=np.uint8), np.cumsum([0, *map(len, texts)])
    whole = set(zip(*(x.tolist() for x in slots(data, offsets))))
    monkeypatch.setattr(toxicity, "BLOCK", 37)
    assert set(zip(*(x.tolist() for x in slots(data, offsets)))) == whole


def test_scores_are_sums_of_weights(spark, documents, folder):
    """The scores of Spark's tasks against features counted with a dictionary."""
    model = toxicity.train(documents, spark.read.parquet(f"{folder}/labels.parquet"))
    weight = dict(zip(model[0].tolist(), model[1].tolist()))
    got = {r.doc_id: r.score for r in toxicity.predict(documents, model).collect()}
    for r in documents.collect():
        data = np.frombuffer((r.text or "").encode(), dtype=np.uint8)
        total = sum(weight.get(s, 0.0) for s in set(slots(data, np.array([0, len(data)]))[1].tolist())) + model[2]
        assert abs(got[r.doc_id] - 1 / (1 + np.exp(-total))) < 1e-4


def test_samples_keep_their_bound(spark):
    from tabsift.llm.sampling import draw
    rows = spark.createDataFrame([(i, "copy" if i % 3 else f"text {i}", "a" if i % 10 else "b") for i in range(6000)] + [(1, "copy", "a")] * 3000 + [(2, None, None)],
                                 "id long, text string, g string").cache()
    got = [tuple(r) for r in draw(rows, "g", 500).collect()]
    # Of a's 8,400 rows 3,000 repeat one, so it gives fewer; b has none of these.
    assert len(got) == len(set(got)) and sum(g == "b" for _, _, g in got) == 500 and 300 < sum(g == "a" for _, _, g in got) <= 500
    assert sorted(got) == sorted(tuple(r) for r in draw(rows.repartition(7, "text"), "g", 500).collect())
    assert draw(rows, "g", 10_000).count() == 6000 and draw(rows.limit(0), "g", 5).count() == 0
