import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tabsift.llm import packing, pieces, token_counts as counting
from tabsift.llm.packing import pack, packed_documents
from tabsift.llm.packplan import plan
from tabsift.llm.token_counts import token_counts

WORDS, BYTES, PIECES = (public_tokenizers.path(n) for n in ("word_bpe_49k.json", "byte_bpe_50k.json", "piece_bpe_32k.model"))
ODD_TEXTS = ["", " ", "  ", "a  b", "a \n b", " lead", "trail ", "x  y", "a\x01b c", "<|endoftext|>", "it's we'll <|endoftext|> a<|startoftext|>b", "É é İ ß ΣΑΣ",
             "1234 5 67.8", "\t\t tab", "日本 語テキスト", "a b\n\nc  d", "don't. Stop, now", "�​ 　x"]


def texts():
    rng = random.Random(2)
    return ODD_TEXTS + ["".join(rng.choice([" ", "  ", "a", "Be", "ñ", ".", ",", "\n", "7", "'s", " ", "🙂"]) for _ in range(rng.randrange(40))) for _ in range(300)]


@pytest.mark.parametrize("path", [WORDS, BYTES])
def test_pieces_have_the_ids_of_the_text(path):
    own = Tokenizer.from_file(path)
    memory = packing._ids(path)
    for text in texts():
        counts, coded = pieces.cut(pa.array([text], pa.large_string()))
        parts = coded.cast(pa.large_string()).to_pylist()
        assert "".join(parts) == text and counts.tolist() == [len(parts)]
        expected = own.encode(text, add_special_tokens=False).ids
        assert [i for ids in pieces.encode(path, parts) for i in ids] == expected
        assert np.frombuffer(b"".join(memory.of(parts)), dtype="<u4").tolist() == expected


def test_counts_equal_the_library(spark, documents, monkeypatch):
    own = Tokenizer.from_file(BYTES)
    rows = [(k, t) for k, t in enumerate(texts())] + [(r.doc_id + 10_000, r.text) for r in documents.collect()]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    expected = {i: (i, len(t.encode()), n, n > 1024) for i, t in rows for n in [len(own.encode(t, add_special_tokens=False).ids)]}
    for head in (200_000, 50, 0):                       # all in the head, some, none
        monkeypatch.setattr(counting, "HEAD_ROWS", head)
        assert {r.doc_id: tuple(r) for r in token_counts(df, BYTES).collect()} == expected


def test_counts_of_sentencepiece(spark, documents):
    own = pieces.tokenizer(PIECES)
    out = {r.doc_id: r.n_tokens for r in token_counts(documents, PIECES).collect()}
    assert out == {r.doc_id: len(own.encode(r.text)) for r in documents.collect()}


def test_counts_on_odd_rows(odd, none):
    out = token_counts(odd, BYTES).collect()
    assert Counter(r.doc_id for r in out) == Counter(r.doc_id for r in odd.collect()) and token_counts(none, BYTES).count() == 0
    assert {(r.n_bytes, r.n_tokens) for r in out if r.doc_id in (1, 2)} == {(0, 0)}


def check_plan(histogram, capacity):
    p = plan(histogram, capacity)
    seen, used = defaultdict(list), defaultdict(list)
    for size, first, last, sequence, offset in zip(*(p[k].tolist() for k in ("size", "first", "last", "sequence", "offset"))):
        seen[size].append((first, last))
        for k in range(last - first):
            used[sequence + k].append((offset, size))
    for size, n in histogram.items():
        at = 0
        for first, last in sorted(seen[size]):
            assert first == at
            at = last
        assert at == n
    for parts in used.values():
        at = 0
        for offset, size in sorted(parts):
            assert offset == at
            at += size
        assert at <= capacity
    return len(used)


def test_plans_are_whole_and_tight():
    rng = np.random.default_rng(1)
    draws = [np.clip(rng.lognormal(4.2, 1.0, 4000), 1, 256), rng.integers(1, 257, 3000), rng.integers(60, 140, 900), np.full(77, 256), np.full(100, 129), np.ones(1000)]
    for lengths in draws:
        h = {int(k): int(n) for k, n in zip(*np.unique(lengths.astype(int), return_counts=True))}
        n, least = check_plan(h, 256), max(-(-sum(k * c for k, c in h.items()) // 256), sum(c for k, c in h.items() if k > 128))
        assert n <= 1.08 * least + 1
    assert check_plan({}, 256) == 0 and check_plan({1: 1}, 256) == 1


def test_packed_rows_equal_the_library(spark, documents):
    own = Tokenizer.from_file(WORDS)
    for capacity in (4096, 100):
        out = packed_documents(documents, WORDS, capacity=capacity).collect()
        got, sequences = {(r.doc_id, r.piece): r for r in out}, defaultdict(list)
        expected = {}
        for r in documents.collect():
            ids = own.encode(r.text, add_special_tokens=False).ids + [1]
            for k, s in enumerate(range(0, len(ids), capacity)):
                part = np.array(ids[s:s + capacity], dtype="<u4")
                expected[r.doc_id, k] = (s, len(part), zlib.crc32(part.tobytes()))
        assert {k: (r.start, r.length, r.ids_crc32) for k, r in got.items()} == expected and len(out) == len(expected)
        for r in out:
            sequences[r.sequence_id].append((r.offset, r.length))
        for parts in sequences.values():
            at = 0
            for offset, length in sorted(parts):
                assert offset == at
                at += length
            assert at <= capacity


def test_memory_of_pieces_is_bounded(monkeypatch):
    monkeypatch.setattr(packing, "REMEMBERED", 10)
    memory = packing.Ids(WORDS, True)
    first = memory.of([f"word{chr(97 + k)}" for k in range(26)])
    assert memory.of([f"word{chr(97 + k)}" for k in range(26)]) == first and len(memory.now) + len(memory.before) <= 60


def rows_of(path, texts, capacity=4096):
    """(id, piece, start, length, ids_crc32) of texts numbered from 0."""
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts, pa.string())], ["id", "text"])
    return [tuple(r.values()) for out in packing._pieces(iter([batch]), path, capacity) for r in out.to_pylist()]


def library_rows(path, texts, capacity=4096):
    own, out = Tokenizer.from_file(path), []
    for k, text in enumerate(texts):
        ids = own.encode(text or "", add_special_tokens=False).ids + [1]
        parts = [np.array(ids[s:s + capacity], dtype="<u4") for s in range(0, len(ids), capacity)]
        out += [(k, j, j * capacity, len(part), zlib.crc32(part.tobytes())) for j, part in enumerate(parts)]
    return out


@pytest.mark.parametrize("path", [WORDS, BYTES])
def test_rows_of_odd_texts_equal_the_library(path):
    rng = random.Random(5)
    bits = [*" \t\n\r\x0b\x0c\x1c\x85\xa0\u2028\u3000\x00\x01", "a", "Be", "É", "e\u0301", "h\u0331", "H\u0331", "\u0301", "ß", "×", "ñÑ", "ǅ", "İ", "K", "Σ", "ﬁ", "½", "日本", "🙂", *".,'\"()[]<>|#-_`^~", "'s", "'S", "'LL", "“", "7",
            "12", "<|endoftext|>", "<|ENDOFTEXT|>", "</w>", "w", "word", "Ünder", "straße"]
    many = ["".join(rng.choice(bits) for _ in range(rng.randrange(30))) for _ in range(6000)] + ODD_TEXTS + [None]
    assert rows_of(path, many) == library_rows(path, many)
    assert rows_of(path, many, 5) == library_rows(path, many, 5)
    assert rows_of(path, ["", None, " \n"]) == library_rows(path, ["", None, " \n"]) and rows_of(path, []) == []


def test_a_word_is_tokenised_once_whatever_stands_beside_it(monkeypatch):
    """Case, marks and line breaks beside a word make no new piece, and new words are no calls of their own."""
    asked = []
    monkeypatch.setattr(packing, "_workers", {})
    monkeypatch.setattr(packing, "encode", lambda path, parts: asked.extend(parts) or pieces.encode(path, parts))
    words = ["".join(random.Random(k).choices("abcdeéüñ", k=9)) for k in range(500)]
    variants = [f"({w.capitalize()},\n{w}. {w}!!\n\n{w}### [{w}]\t{w.upper()}" for w in words]
    assert rows_of(WORDS, variants) == library_rows(WORDS, variants)
    assert len(packing._ids(WORDS).now) <= len(words) + 10 and len(asked) <= 10


def test_packing_on_odd_rows(odd, none):
    out = packed_documents(odd, WORDS).collect()
    assert packed_documents(none, WORDS).count() == 0
    whole = Counter(r.doc_id for r in out if r.piece == 0)
    assert whole == Counter(r.doc_id for r in odd.collect())
    assert {r.length for r in out if r.doc_id in (1, 2, 3)} == {1}
    spans = [(r.sequence_id, r.offset) for r in out]
    assert len(set(spans)) == len(spans)


def test_one_common_length_is_spread(spark):
    rows = spark.range(5000).select(F.col("id"), F.lit(0).alias("piece"), F.lit(7).cast("long").alias("length"), F.lit(0).cast("long").alias("ids_crc32"))
    out = pack(rows, 70).groupBy("sequence_id").agg(F.sum("length").alias("n"), F.countDistinct("offset").alias("o"))
    assert out.count() == 500 and out.filter("n != 70 or o != 10").count() == 0


def test_a_long_pre_token_of_many_documents(spark):
    """A pre-token of more than HEAD_BYTES in every text, whose rows meet in several places: counts are the library's."""
    url = "https://example.com/" + "a-long-path/" * 9
    texts = [f"see {url} for item {i}" for i in range(400)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    library = Tokenizer.from_file(BYTES)
    got = {r.doc_id: r.n_tokens for r in token_counts(docs, BYTES).collect()}
    assert got == {i: len(library.encode(t, add_special_tokens=False).ids) for i, t in enumerate(texts)}
