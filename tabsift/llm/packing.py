"""Best-fit packing of tokenised documents into fixed-length sequences, by a linear grouping plan over their length histogram."""

from __future__ import annotations

import re
import zlib
from functools import cached_property
from typing import TYPE_CHECKING

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F, Window as W

from tabsift.llm.common import cut_lineage, pick, ship
from tabsift.llm.packplan import plan
from tabsift.llm.pieces import cut, encode, runs

if TYPE_CHECKING:
    from tokenizers import Tokenizer

CAPACITY, END_ID = 4096, 1
#: Ids of pieces that a worker remembers: two generations of at most so many pieces.
REMEMBERED = 300_000
#: New pieces are tokenised so many at a time.
JOINED = 1000
_latin = re.compile(r"[A-Za-zÀ-ÖØ-öø-ÿ]+")
#: A word of Latin letters between marks. Pre-tokenisation cuts at both ends of the word, but not always behind an apostrophe.
_marked = r"""^(?P<lead>[("\[]*)(?P<word>[A-Za-zÀ-ÖØ-öø-ÿ]+)(?P<mark>[!-/:-@\[-`{-~]*)$"""

#: What the short cuts rely on: white space only parts words, letters are lower-cased, a run of letters is one pre-token.
_normal = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
_split = {"type": "Sequence", "pretokenizers": [
    {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
    {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]}


class Ids:
    """The ids of pieces as little-endian 32-bit bytes; what was seen lately is remembered."""

    def __init__(self, path: str, lower: bool):
        self.path, self.lower, self.now, self.before = path, lower, {}, {}

    @cached_property
    def _merges(self) -> tuple[Tokenizer, np.ndarray]:
        """The tokenizer for words parted by single spaces, and which ids end a word."""
        from tokenizers import Tokenizer, pre_tokenizers as pre
        own = Tokenizer.from_file(self.path)
        own.normalizer = None
        own.pre_tokenizer = pre.Sequence([pre.Split(" ", "removed"), pre.ByteLevel(add_prefix_space=False, use_regex=False)])
        last = np.zeros(own.get_vocab_size(), dtype=bool)
        last[[i for name, i in own.get_vocab().items() if name.endswith("</w>")]] = True
        return own, last

    def _words(self, words: list[str]) -> list[bytes]:
        """Words of lower-case Latin letters alone, which no normalisation changes and no pre-tokenisation cuts: many at a time."""
        own, last = self._merges
        joined = (" ".join(words[k:k + JOINED]) for k in range(0, len(words), JOINED))
        ids = np.concatenate([np.array(e.ids, dtype="<u4") for text in joined for e in own.encode_batch_fast([text], add_special_tokens=False)])
        ends = 4 * (np.flatnonzero(last[ids]) + 1)
        if len(ends) != len(words):                                     # a letter that the vocabulary lacks
            return self._any(words)
        data = ids.tobytes()
        return [data[i:j] for i, j in zip([0, *ends.tolist()], ends.tolist())]

    def _any(self, pieces: list[str]) -> list[bytes]:
        return [np.array(ids, dtype="<u4").tobytes() for k in range(0, len(pieces), JOINED) for ids in encode(self.path, pieces[k:k + JOINED])]

    def of(self, pieces: list[str]) -> list[bytes]:
        now, before = self.now, self.before
        out = list(map(now.get, pieces))
        easy, bare, hard = [], [], []
        for k in [k for k, ids in enumerate(out) if ids is None]:
            piece = pieces[k]
            ids = before.get(piece)
            if ids is not None:
                out[k] = now[piece] = ids
            elif self.lower and _latin.fullmatch(word := piece.strip(" ")):
                easy.append(k)
                bare.append(word.lower())
            else:
                hard.append(k)
        for k, ids in zip(easy, self._words(bare) if easy else ()):
            out[k] = now[pieces[k]] = ids
        for k, ids in zip(hard, self._any([pieces[k] for k in hard])):
            out[k] = now[pieces[k]] = ids
        if len(now) > REMEMBERED:
            self.now, self.before = {}, now
        return out


_workers: dict[str, Ids] = {}


def _ids(path: str) -> Ids:
    """One memory per worker process. Short cuts are for vocabularies that normalise and cut by the rules above and end words with a mark."""
    if path not in _workers:
        import json
        lower = False
        if path.endswith(".json"):
            with open(path, encoding="utf-8") as f:
                kind = json.load(f)
            rules = kind["normalizer"], kind["pre_tokenizer"], kind["model"].get("end_of_word_suffix")
            lower = rules == (_normal, _split, "</w>") and all(re.fullmatch(r"<\S*[a-z]\S*", t["content"]) and not t["lstrip"] | t["rstrip"] for t in kind["added_tokens"])
        _workers[path] = Ids(path, lower)
    return _workers[path]


def _words(texts: pa.Array) -> tuple[np.ndarray, pa.DictionaryArray, pa.DictionaryArray]:
    """How many pieces between ASCII white space each text has, all pieces, coded, and the three parts of each distinct piece, coded:
    marks, a lower-case word or what else the piece is, and marks."""
    split = pc.ascii_split_whitespace(texts)
    counts = pc.list_value_length(split).to_numpy(zero_copy_only=False).astype(np.int64)
    coded = split.flatten().dictionary_encode()
    found = pc.extract_regex(coded.dictionary, _marked)
    lead, word, mark = (pc.struct_field(found, k) for k in range(3))
    known = found.is_valid()
    word, none = pc.if_else(known, pc.utf8_lower(word), coded.dictionary), pa.scalar("", pa.large_string())
    return counts, coded, pa.concat_arrays([pc.if_else(known, lead, none), word, pc.if_else(known, mark, none)]).dictionary_encode()


def _laid(raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All ids, and how many of them each piece has."""
    return np.frombuffer(b"".join(raw), dtype="<u4"), np.fromiter(map(len, raw), dtype=np.int64, count=len(raw)) // 4


def _spread(pool: np.ndarray, sizes: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids of pieces in the order of their codes, and where each piece ends."""
    each = sizes[codes]
    ends = np.cumsum(each)
    return pool[np.repeat((np.cumsum(sizes) - sizes)[codes] - (ends - each), each) + np.arange(int(ends[-1]) if len(ends) else 0)], ends


def _pieces(batches, path: str, capacity: int):
    memory = _ids(path)
    for batch in batches:
        for row, texts in runs(batch.column("text")):
            if memory.lower:
                counts, coded, parts = _words(texts)
                threes = parts.indices.to_numpy().reshape(3, -1).T.ravel()
                pool, ends = _spread(*_laid(memory.of(parts.dictionary.to_pylist())), threes)
                sizes = np.diff(ends[2::3], prepend=0)
            else:
                counts, coded = cut(texts)
                pool, sizes = _laid(memory.of(coded.dictionary.to_pylist()))
            flat, ends = _spread(pool, sizes, coded.indices.to_numpy())
            done = np.concatenate(([0], ends))[np.cumsum(counts)]
            own, piece, start, length, crc = [], [], [], [], []
            begin = 0
            for k, end in enumerate(done.tolist()):
                data = flat[begin:end].tobytes() + np.array([END_ID], dtype="<u4").tobytes()
                begin = end
                n = len(data) // 4
                for j, s in enumerate(range(0, n, capacity)):
                    part = data[4 * s:4 * (s + capacity)]
                    own.append(row + k)
                    piece.append(j)
                    start.append(s)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
            yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(own)), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))],
                                             ["id", "piece", "start", "length", "ids_crc32"])


def token_pieces(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """(id, piece, start, length, ids_crc32): each document's ids and an end id, cut only if they are more than ``capacity``."""
    ship(docs.sparkSession)
    rows = pick(docs, id=id_col, text=text_col)
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(lambda b: _pieces(b, path, capacity), f"id {kind}, piece int, start long, length long, ids_crc32 long")


def _place(batches, table):
    size, first, sequence, offset = (table.value[k] for k in ("size", "first", "sequence", "offset"))
    key = (size << 45) + first
    for batch in batches:
        length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
        at = np.searchsorted(key, (length << 45) + rank, side="right") - 1
        out = batch.drop_columns(["rank"])
        out = out.append_column("sequence_id", pa.array(sequence[at] + rank - first[at]))
        yield out.append_column("offset", pa.array(offset[at]))


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """The pieces with sequence_id and offset. ``length`` must lie in 1 to capacity.

    The plan is made from the histogram of lengths, which has at most ``capacity`` rows, and says which ranks of which length go into
    which sequences. Ranks come from counts per length and hash block, and a window within each, so a common length is spread.
    """
    spark = pieces.sparkSession
    ship(spark)
    blocks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    own = [c for c in pieces.columns]
    marked = cut_lineage(pieces.withColumn("block", F.pmod(F.xxhash64("id", "piece"), F.lit(blocks)).cast("int")))
    counts = cut_lineage(marked.groupBy("length", "block").agg(F.count("*").alias("n")))
    histogram = {r[0]: r[1] for r in counts.groupBy("length").agg(F.sum("n")).collect()}           # at most `capacity` rows
    table = spark.sparkContext.broadcast(plan(histogram, capacity))
    before = counts.withColumn("before", F.sum("n").over(W.partitionBy("length").orderBy("block").rowsBetween(W.unboundedPreceding, -1)))
    rank = F.row_number().over(W.partitionBy("length", "block").orderBy("id", "piece", "ids_crc32")) - 1
    ranked = marked.withColumn("rank", rank.cast("long")).join(before.select("length", "block", "before"), ["length", "block"])
    ranked = ranked.select(*own, (F.col("rank") + F.coalesce("before", F.lit(0))).alias("rank"))
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in ranked.schema if f.name != "rank")
    return ranked.mapInArrow(lambda b: _place(b, table), f"{kinds}, sequence_id long, offset long")


def packed_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32, sequence_id, offset.

    Null, empty and blank texts have the end id alone. Rows that repeat an id and text are packed as often as they stand there. Null ids
    are packed too. Other columns are ignored. No rows give no rows.
    """
    out = pack(token_pieces(docs, path, id_col, text_col, capacity), capacity)
    return out.withColumnRenamed("id", id_col)
