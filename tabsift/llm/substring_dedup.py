"""Substring dedup: units that repeat anywhere in the corpus stay at their earliest ranked place; runs of repeats go elsewhere."""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tabsift.llm.common import col, cut_lineage, ship

_word = re.compile(r"[^\x20\x09-\x0D]+")
#: A sentence ends with full stops, exclamation or question marks, and the blanks behind them; a line ends it too.
_pieces = {"sentence": re.compile(r"[^.!?\n]+[.!?]*[ \t\r\x0b\x0c]*|[.!?]+[ \t\r\x0b\x0c]*"), "line": re.compile(r"[^\n]+"),
           "paragraph": re.compile(r"(?:[^\n]|\n(?![ \t\r]*\n))+")}
#: Units that make up this share of all are joined by a broadcast of at most so many rows.
HOT = 1_000


def _words(piece: str) -> list[str]:
    return _word.findall(piece.lower())


def _units(batches, unit: str):
    """A row for each unit that has words: its number in the text and the digest of its words."""
    find = _pieces[unit].finditer
    for batch in batches:
        at, number, digests = [], [], []
        for row, text in enumerate(batch.column("text").to_pylist()):
            k = 0
            for m in find(text):
                if words := _words(m[0]):
                    at.append(row)
                    number.append(k)
                    digests.append(hashlib.blake2b(" ".join(words).encode("utf-8", "surrogatepass"), digest_size=16).digest())
                    k += 1
        own = batch.select(batch.schema.names[:-1]).take(pa.array(at, pa.int32()))
        yield pa.RecordBatch.from_arrays([*own.columns, pa.array(number, pa.int32()), pa.array(digests, pa.binary())], [*own.schema.names, "unit", "digest"])


def _runs(text: str, repeats, unit: str, min_words: int):
    """Maximal runs of neighbouring repeats that hold enough words together."""
    first_ids, run, words, k = {r["unit"]: r["first_id"] for r in repeats}, [], 0, 0
    for m in [*_pieces[unit].finditer(text), None]:
        own = _words(m[0]) if m else ()
        if m and not own:
            continue
        if k in first_ids and m:
            run.append((m.start(), m.end(), k))
            words += len(own)
        else:
            if words >= min_words:
                yield {"start": run[0][0], "end": run[-1][1], "unit": run[0][2], "units": len(run), "first_id": first_ids[run[0][2]]}
            run, words = [], 0
        k += 1


def _cut(batches, unit: str, min_words: int, kind):
    """Texts without the runs; with a run that begins a line goes the line break behind it."""
    for batch in batches:
        texts, spans = [], []
        for text, repeats in zip(batch.column("text").to_pylist(), batch.column("repeats").to_pylist()):
            runs, parts, done = list(_runs(text, repeats, unit, min_words)) if repeats else [], [], 0
            for s in runs:
                parts.append(text[done:s["start"]])
                whole = s["start"] == 0 or text[s["start"] - 1] == "\n"
                done = s["end"] + (whole and text[s["end"]:s["end"] + 1] == "\n")
            texts.append("".join([*parts, text[done:]]) if runs else text)
            spans.append(runs)
        yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(texts, pa.string()), pa.array(spans, kind)], ["id", "text", "removed"])


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rank_col: str | None = None,
                   unit: str = "sentence", min_words: int = 20) -> DataFrame:
    """One row per document: id, text without repeats, n_removed, removed (start, end, unit, units, first_id of each run that went).

    Units (lines, their sentences, or paragraphs) of any length are compared by a 128-bit digest of their words, lowered and with single spaces. The occurrence
    with the smallest (rank, id, text hash, unit number) is the first, nulls last; rank is the id unless ``rank_col`` is given. All
    others are repeats, and every maximal run of neighbouring repeats that holds ``min_words`` words goes, whatever the lengths of its units, so
    a passage goes as a whole while single short units that recur by chance stay. Offsets are code points of the original text; ``first_id`` is where the run's first
    unit stays. Units without words are not compared and go only inside a run. Per digest only a minimum and a count are aggregated; occurrences meet it in a join.

    Null texts stay null, empty ones empty. Rows that repeat an id and text hold the same occurrence, so they get the same result. A
    null id ranks last. Other columns are ignored. No rows give no rows.
    """
    ship(docs.sparkSession)
    rows = docs.select(col(id_col).alias("id"), col(rank_col or id_col).alias("rank"), col(text_col).alias("text"))
    own = ["id", "h", "rank"] if rank_col else ["id", "h"]
    rows = rows.withColumn("h", F.xxhash64("text")).select(*own, "text")               # tells rows of one id, or of none, apart
    kinds = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in own)
    units = cut_lineage(rows.filter("text != ''").mapInArrow(lambda b: _units(b, unit), f"{kinds}, unit int, digest binary"))
    ranks = [F.col("rank").isNull().alias("no_rank"), "rank"] if rank_col else []
    place = F.struct(*ranks, F.col("id").isNull().alias("no_id"), "id", "h", "unit")
    first = cut_lineage(units.groupBy("digest").agg(F.min(place).alias("first"), F.count("*").alias("n")).filter("n > 1"))
    # a unit that is at least every HOT-th one: at most HOT of them, whose many places are met where they lie
    hot = F.broadcast(first.filter(F.col("n") >= max(2, units.count() // HOT)))
    places = units.select("id", "h", "unit", "digest")
    met = places.join(hot, "digest").unionByName(places.join(hot, "digest", "left_anti").join(first, "digest"))
    again = (met.filter(~F.col("id").eqNullSafe(F.col("first.id")) | (F.col("h") != F.col("first.h")) | (F.col("unit") != F.col("first.unit"))).groupBy("id", "h")
             .agg(F.collect_set(F.struct("unit", F.col("first.id").alias("first_id"))).alias("repeats")))
    both = rows["id"].eqNullSafe(again["id"]) & (rows["h"] == again["h"])
    out = rows.join(again, both, "left").select(rows["id"], "text", "repeats")
    kind = rows.schema["id"].dataType.simpleString()
    span = f"array<struct<start:int,end:int,unit:int,units:int,first_id:{kind}>>"
    first_id = pa.field("first_id", _arrow_type(docs, id_col))
    arrow = pa.list_(pa.struct([*(pa.field(n, pa.int32()) for n in ("start", "end", "unit", "units")), first_id]))
    out = out.mapInArrow(lambda b: _cut(b, unit, min_words, arrow), f"id {kind}, text string, removed {span}")
    return out.select(F.col("id").alias(id_col), F.col("text").alias(text_col), F.size("removed").alias("n_removed"), "removed")


def _arrow_type(docs: DataFrame, id_col: str) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type
    return to_arrow_type(docs.select(col(id_col)).schema[0].dataType)
