"""Benchmark decontamination with a positional inverted index: postings of training tokens, lists intersected from the rarest term on."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F, Window as W

from tabsift.llm.common import ascii_lower, col, cut_lineage, pick

WINDOW = 10
#: Separators before A-Z is lowered: all ASCII but letters and digits.
SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Tables of at most so many rows of a few numbers are broadcast; larger ones are shuffled.
BROADCAST_ROWS = 1_000_000


def words(text: Column) -> Column:
    """Runs of letters, digits and non-ASCII characters."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SEPARATORS), "")


def lowered(word: Column) -> Column:
    """A-Z lowered and nothing else; the quicker function where the word is ASCII."""
    return F.when(F.octet_length(word) == F.char_length(word), F.lower(word)).otherwise(ascii_lower(word))


def _sized(df: DataFrame) -> DataFrame:
    """The stored table, marked for broadcast if it is small."""
    df = cut_lineage(df)
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def windows(bench: DataFrame, item_col: str = "item_id", text_col: str = "text", size: int = WINDOW) -> DataFrame:
    """(item, win, len, terms): windows of ``size`` consecutive words; an item of fewer, but not none, is one window. Equal windows share win."""
    rows = pick(bench, item=item_col, text=text_col).filter("item is not null")
    rows = rows.select("item", F.transform(words(F.col("text")), lowered).alias("w")).filter("size(w) > 0")
    start = F.explode(F.expr(f"sequence(1, greatest(size(w) - {size} + 1, 1))"))
    rows = rows.select("item", "w", start.alias("s")).select("item", F.slice("w", F.col("s"), size).alias("terms")).distinct()
    return rows.select("item", F.md5(F.array_join("terms", " ")).alias("win"), F.size("terms").alias("len"), "terms")


def postings(rows: DataFrame, vocabulary: DataFrame | None = None) -> DataFrame:
    """(term, k1, k2, pos) of (k1, k2, text) rows: where each token stands. With a vocabulary (word, term), only its words, as term."""
    tokens = rows.select("k1", "k2", F.posexplode(words(F.col("text"))).alias("pos", "raw"))
    tokens = tokens.select("k1", "k2", "pos", lowered(F.col("raw")).alias("word"))
    if vocabulary is None:
        return tokens.withColumnRenamed("word", "term")
    return tokens.join(vocabulary, "word").select("term", "k1", "k2", "pos")


def occurrences(index: DataFrame, parts: DataFrame, slack: int = 0, share: float = 1.0) -> DataFrame:
    """(win, len, k1, k2, start): places where a window's terms stand in order.

    ``parts`` has (win, len, off, term). A place counts if at least ``share`` of the terms stand within ``slack`` positions of their
    offset from start: 0 and 1.0 give exact phrases, other values proximity matches. Candidates come from the rarest term, or from
    so many of the rarest that one of them must match; repeated postings give one. Exact phrases then meet the lists of the second and third rarest
    term before all others.
    """
    n = index.groupBy("term").agg(F.count("*").alias("n"))
    order = W.partitionBy("win").orderBy("n", "off")
    parts = _sized(parts.join(n, "term", "left").withColumn("n", F.coalesce("n", F.lit(0))).withColumn("rank", F.row_number().over(order)))
    need = F.ceil(F.col("len") * F.lit(share) - 1e-9).cast("int")
    exact = slack == 0 and share >= 1
    alive = parts.groupBy("win").agg(F.sum(F.when(F.col("n") > 0, 1).otherwise(0)).alias("there"), F.first("len").alias("len")).filter(
        F.col("there") >= need)
    parts = _sized(parts.join(alive.select("win"), "win", "left_semi"))
    seeds = parts.filter(F.col("rank") <= F.col("len") - need + 1)
    found = (index.join(seeds, "term").withColumn("start", F.col("pos") - F.col("off"))
             .filter((F.col("start") >= 0) if exact else F.lit(True)).select("win", "len", "k1", "k2", "start"))
    found = found.distinct()
    for rank in (2, 3) if exact else ():
        step = _sized(parts.filter(F.col("rank") == rank).select("win", "off", "term"))
        lists = index.join(_sized(step.select("term").distinct()), "term", "left_semi")
        asked = found.join(step, "win", "left").withColumn("pos", F.col("start") + F.col("off"))
        done = asked.filter("term is null").select("win", "len", "k1", "k2", "start")
        met = asked.filter("term is not null").join(lists, ["term", "k1", "k2", "pos"], "left_semi").select("win", "len", "k1", "k2", "start")
        found = cut_lineage(met.union(done))
    if not exact:
        found = cut_lineage(found)
    own = index.join(_sized(found.select("k1", "k2").distinct()), ["k1", "k2"], "left_semi")
    rest = parts.filter("rank > 3") if exact else parts
    asked = found.join(rest.select("win", "off", "term"), "win", "left")
    if exact:
        asked = asked.withColumn("pos", F.col("start") + F.col("off"))
        met = asked.filter("term is not null").join(own, ["term", "k1", "k2", "pos"], "left_semi")
        whole = met.groupBy("win", "len", "k1", "k2", "start").agg(F.count("*").alias("c")).filter("c = len - 3").drop("c")
        return whole.union(asked.filter("term is null").select("win", "len", "k1", "k2", "start"))
    near = asked.withColumn("pos", F.explode(F.transform(F.sequence(F.lit(-slack), F.lit(slack)), lambda d: F.col("start") + F.col("off") + d)))
    met = near.join(own, ["term", "k1", "k2", "pos"], "left_semi").select("win", "len", "k1", "k2", "start", "off").distinct()
    return met.groupBy("win", "len", "k1", "k2", "start").agg(F.count("*").alias("c")).filter(F.col("c") >= need).drop("c")


def _covered(spans: Column) -> Column:
    """Positions inside any of the sorted spans (start, len)."""
    zero = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))

    def add(a: Column, s: Column) -> Column:
        end = s["start"] + s["len"]
        return F.struct((a["n"] + F.greatest(F.lit(0), end - F.greatest(s["start"], a["end"]))).alias("n"), F.greatest(a["end"], end).alias("end"))

    return F.aggregate(spans, zero, add, lambda a: a["n"])


def contamination(docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
                  item_text_col: str = "text", size: int = WINDOW) -> DataFrame:
    """One row per document: id, n_words, n_hit, n_items, items_sha256, contaminated.

    The index holds postings of those training tokens that benchmark items use; no other token can be part of a match.
    Null, empty and wordless texts have no words and no hits. Items without id or without words are left out; items that share an id are one. Rows
    that repeat an id and text repeat the result. Other columns are ignored. No items: nothing is hit. No documents: no rows.
    """
    key = [F.xxhash64("id", "text").alias("k1"), F.hash("text", "id").alias("k2")]
    rows = pick(docs, id=id_col, text=text_col).select("*", *key)
    wins = cut_lineage(windows(bench, item_col, item_text_col, size))
    used = wins.select("win", "len", "terms").distinct()
    parts = used.select("win", "len", F.posexplode("terms").alias("off", "word"))
    vocabulary = _sized(parts.select("word").distinct().withColumn("term", F.xxhash64("word")))
    parts = parts.withColumn("term", F.xxhash64("word")).drop("word")
    index = cut_lineage(postings(rows.select("k1", "k2", "text"), vocabulary))
    found = cut_lineage(occurrences(index, parts).distinct())
    hits = found.groupBy("k1", "k2").agg(_covered(F.array_sort(F.collect_set(F.struct("start", "len")))).cast("long").alias("n_hit"))
    items = (found.select("win", "k1", "k2").distinct().join(_sized(wins.select("win", "item")), "win").groupBy("k1", "k2")
             .agg(F.array_sort(F.collect_set(F.col("item").cast("string"))).alias("items")))
    out = (rows.select("id", "k1", "k2", F.size(words(F.col("text"))).cast("long").alias("n_words"))
           .join(hits.join(items, ["k1", "k2"]), ["k1", "k2"], "left"))
    named = F.coalesce("items", F.array().cast("array<string>"))
    return out.select(F.col("id").alias(id_col), "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
                      F.size(named).cast("long").alias("n_items"), F.sha2(F.array_join(named, ","), 256).alias("items_sha256"),
                      (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"))
