"""Token counts: pieces are counted once per distinct pre-token, and documents sum the counts of theirs."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from tabsift.llm.common import cut_lineage, pick, ship
from tabsift.llm.pieces import cut, encode, runs

#: The most frequent pre-tokens go to all tasks: at most so many, of at most so many bytes each.
HEAD_ROWS, HEAD_BYTES = 400_000, 48
#: The rows of a longer pre-token, which no table of frequent ones holds however frequent it is, meet in so many places.
SALTS = 64
#: A task names those that it met so often; it forgets rarer ones whenever it holds so many.
LOCAL, HELD = 8, 400_000


def _frequent(batches):
    """(term, n): what is frequent within a task. What is left out here is counted all the same, only not by the head."""
    held: pa.Table | None = None
    for batch in batches:
        for _, texts in runs(batch.column("text")):
            _, coded = cut(texts)
            counts = np.bincount(coded.indices.to_numpy(), minlength=len(coded.dictionary))
            one = pa.table({"term": coded.dictionary.cast(pa.large_string()), "n": pa.array(counts, pa.int64())})
            if held is not None:
                one = pa.concat_tables([held, one]).group_by("term", use_threads=False).aggregate([("n", "sum")]).rename_columns(["term", "n"])
            held = one if one.num_rows <= HELD else one.filter(pc.greater(one["n"], 1))
    if held is not None:
        often = held.filter(pc.and_(pc.greater_equal(held["n"], LOCAL), pc.less_equal(pc.binary_length(held["term"]), HEAD_BYTES)))
        yield from often.cast(pa.schema([("term", pa.string()), ("n", pa.int64())])).to_batches()


def _sizes(terms: pa.Array, path: str) -> np.ndarray:
    out: list[int] = []
    for start in range(0, len(terms), 5000):
        out += map(len, encode(path, terms.slice(start, 5000).to_pylist()))
    return np.array(out, dtype=np.int64)


def _tokens(batches, path: str):
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column("term"), pa.array(_sizes(batch.column("term"), path))], ["term", "tokens"])


def head(texts: DataFrame, path: str) -> tuple[list[str], np.ndarray]:
    """Frequent pre-tokens and their numbers of ids: those above the lowest power of two that leaves at most HEAD_ROWS."""
    often = cut_lineage(texts.mapInArrow(_frequent, "term string, n long").groupBy("term").agg(F.sum("n").alias("n")))
    powers = {r[0]: r[1] for r in often.groupBy(F.floor(F.log2("n")).alias("p")).count().collect()}     # at most 63 rows
    least, total = 63, 0
    for p in sorted(powers, reverse=True):
        total += powers[p]
        if total > HEAD_ROWS:
            break
        least = p
    rows = often.filter(F.floor(F.log2("n")) >= least).select("term").mapInArrow(lambda b: _tokens(b, path), "term string, tokens long").toArrow()
    return rows.column("term").to_pylist(), rows.column("tokens").to_numpy()


def _weighed(batches, path: str):
    """Sorted (term, ...) rows with their number of ids in all: each pre-token is tokenised once, where its rows meet."""
    last, size = None, 0
    for batch in batches:
        coded = batch.column("term").dictionary_encode()
        names = coded.dictionary
        known = len(names) and names[0].as_py() == last
        sizes = _sizes(names.slice(int(known)), path)
        sizes = np.append(size, sizes) if known else sizes
        last, size = (names[-1].as_py(), sizes[-1]) if len(names) else (last, size)
        n = batch.column("n").to_numpy() * sizes[coded.indices.to_numpy()]
        yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("h"), pa.array(n)], ["id", "h", "n"])


def _frequencies(batches, known):
    """For each text a row with the sum over known pre-tokens, and a row with the frequency of each other pre-token."""
    values, tokens = known.value
    lookup = pa.array(values, pa.large_string())
    tokens = np.append(tokens, 0)
    for batch in batches:
        for row, texts in runs(batch.column("text")):
            counts, coded = cut(texts)
            place = pc.index_in(coded.dictionary.cast(pa.large_string()), lookup).fill_null(len(lookup)).to_numpy()
            codes = coded.indices.to_numpy()
            doc = np.repeat(np.arange(len(counts)), counts)
            at = place[codes]
            sums = np.bincount(doc, weights=tokens[at], minlength=len(counts)).astype(np.int64)
            rare = at == len(lookup)
            size = len(coded.dictionary)
            pairs, freq = np.unique(doc[rare] * size + codes[rare], return_counts=True)
            own = np.concatenate((np.arange(len(counts)), pairs // size))
            term = pa.concat_arrays([pa.nulls(len(counts), coded.dictionary.type), coded.dictionary.take(pa.array(pairs % size))])
            keys = batch.select(["id", "h"]).take(pa.array(own + row))
            size_of = batch.column("bytes").slice(row, len(counts)).to_numpy()
            sizes = pa.array(np.concatenate((size_of, np.zeros(len(pairs), dtype=np.int64))))
            yield pa.RecordBatch.from_arrays([*keys.columns, sizes, term.cast(pa.string()), pa.array(np.concatenate((sums, freq)), pa.int64())],
                                             ["id", "h", "bytes", "term", "n"])


def token_counts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 1024) -> DataFrame:
    """One row per document: id, n_bytes, n_tokens, over_limit.

    A pre-token is a stretch of text from one single space between two words to the next, its space included, so that a text's ids are
    those of its pre-tokens. Each distinct one is tokenised once for the whole corpus and its count joined to the frequencies of documents:
    the most frequent ones, a table of bounded size, where texts are read, and all others where their rows meet after a shuffle by pre-token.
    Rows of a long pre-token meet in up to SALTS places, each of which tokenises it once.

    Null texts count as empty: no tokens. Rows that repeat an id and text repeat the result. Null ids are an id of their own.
    Other columns are ignored. No rows give no rows.
    """
    ship(docs.sparkSession)
    rows = pick(docs, id=id_col, text=text_col).withColumn("text", F.coalesce("text", F.lit("")))
    known = docs.sparkSession.sparkContext.broadcast(head(rows.select("text"), path))
    keyed = rows.select("id", F.hash("text").alias("h"), F.octet_length("text").cast("long").alias("bytes"), "text")
    kind = rows.schema["id"].dataType.simpleString()
    own = cut_lineage(keyed.mapInArrow(lambda b: _frequencies(b, known), f"id {kind}, h int, bytes long, term string, n long"))
    salt = F.when(F.octet_length("term") > HEAD_BYTES, F.pmod(F.hash("id", "h"), F.lit(SALTS)))
    rare = (own.filter("term is not null").select("id", "h", "term", "n").repartition("term", salt).sortWithinPartitions("term")
            .mapInArrow(lambda b: _weighed(b, path), f"id {kind}, h int, n long"))
    both = own.filter("term is null").select("id", "h", "bytes", "n", F.lit(1).alias("c")).union(rare.select("id", "h", F.lit(0).cast("long"), "n", F.lit(0)))
    sums = both.groupBy("id", "h").agg(F.max("bytes").alias("bytes"), F.sum("n").alias("n"), F.sum("c").cast("int").alias("c"))
    total = (F.col("n") / F.col("c")).cast("long")
    return sums.select(F.col("id").alias(id_col), F.col("bytes").alias("n_bytes"), total.alias("n_tokens"), (total > limit).alias("over_limit"),
                       F.explode(F.array_repeat(F.lit(0), F.col("c")))).drop("col")
