"""Document fingerprints by I-Match: distinct terms of a middle band of document frequencies, sorted and hashed per randomised lexicon subset."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F, Window as W

from tabsift.llm.common import col, cut_lineage

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Three families of 64 subsets with a 64th, a 512th and a 4096th of the lexicon, for short, middling and long texts.
FAMILY, SUBSETS, DIGITS = 64, 192, 8
#: Shares of distinct texts that a term must lie in. A lexicon has at most (mean distinct terms of a text) / LOW terms at any corpus size.
LOW, HIGH = 0.001, 0.2
#: Ranges of ids for each shuffle partition at least, and bytes of texts in a range: texts become many rows of terms, so a task takes few of them.
RANGES, RANGE_BYTES = 8, 2 << 20
#: Ids that the cuts between ranges are learned from, and ranges at most, as cuts are part of the plan; beyond that a range is larger and its window spills.
CUT_SAMPLE, MOST_RANGES = 50_000, 20_000
#: Lexicons of at most so many terms are broadcast; larger ones are shuffled.
BROADCAST_ROWS = 1_000_000


def terms(text: Column) -> Column:
    """Distinct lower-case words, in any order."""
    return F.array_distinct(F.array_remove(F.split(F.lower(text), SEPARATORS), ""))


def distinct_texts(texts: DataFrame) -> tuple[DataFrame, int]:
    """Each text of a (text) table once, and their number. Only digests and texts that repeat are shuffled, unless very many repeat."""
    own = F.unhex(F.md5("text"))
    copies = cut_lineage(texts.groupBy(own.alias("own")).agg(F.count("*").alias("c")))
    repeated = copies.filter("c > 1").select("own")
    n, several = copies.agg(F.count("*"), F.count_if(F.col("c") > 1)).first()
    if several > BROADCAST_ROWS:
        return texts.distinct(), n
    keyed, repeated = texts.select("text", own.alias("own")), F.broadcast(repeated)
    return keyed.join(repeated, "own", "left_anti").select("text").union(keyed.join(repeated, "own", "left_semi").select("text").distinct()), n


def lexicon(texts: DataFrame, low: float = LOW, high: float = HIGH) -> DataFrame:
    """(term, subset): the terms of a (text) table whose share of distinct texts lies in the band, dealt at random into subsets; stored.

    Copies of a text count once, so that a large group of them can't push its terms out of the band.
    """
    once, n = distinct_texts(texts)
    counts = once.select(F.explode(terms(F.col("text"))).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    draw = F.conv(F.substring(F.md5("term"), 1, 12), 16, 10).cast("long")
    member = lambda k: F.pmod(F.floor(draw / FAMILY ** (2 * k + 1)), F.lit(8 ** k)) == 0
    subset = F.array_compact(F.array(*(F.when(member(k), F.pmod(F.floor(draw / FAMILY ** (2 * k)), F.lit(FAMILY)) + FAMILY * k) for k in range(3))))
    band = cut_lineage(counts.filter((F.col("df") >= low * n) & (F.col("df") <= high * n)).select("term", F.explode(subset.cast("array<int>")).alias("subset")))
    return F.broadcast(band) if band.count() <= BROADCAST_ROWS else band


def fingerprints(texts: DataFrame, keys: list[str], meta: Column, band: DataFrame) -> DataFrame:
    """(keys, meta, hashes) of a table with unique ``keys`` and ``text``: for each subset a hash of the text's terms in it, or null.

    With a small lexicon, a table that is partitioned by one of the keys is not shuffled.
    """
    # The first, null term of each text carries what is to be kept of its row.
    own = texts.select("*", F.explode(F.concat(F.array(F.lit(None).cast("string")), terms(F.col("text")))).alias("term"))
    own = own.select(*keys, "term", F.when(F.col("term").isNull(), meta).alias("meta"))
    own = own.join(band, "term", "left").filter("term is null or subset is not null").select(*keys, "subset", "term", "meta")
    parts = own.groupBy(*keys, "subset").agg(F.substring(F.md5(F.array_join(F.array_sort(F.collect_list("term")), " ")), 1, DIGITS).alias("h"),
                                             F.first("meta", ignorenulls=True).alias("meta"))
    entry = F.when(F.col("subset").isNotNull(), F.struct("subset", "h"))
    whole = parts.groupBy(*keys).agg(F.map_from_entries(F.collect_list(entry)).alias("m"), F.first("meta", ignorenulls=True).alias("meta"))
    every = F.sequence(F.lit(0), F.lit(SUBSETS - 1))
    # An array of one binds the map to a name, so that it is built once a text.
    hashes = F.element_at(F.transform(F.array("m"), lambda m: F.transform(every, lambda s: F.try_element_at(m, s))), 1)
    return whole.select(*keys, "meta", hashes.alias("hashes"))


def render(hashes: Column, text_digest: Column) -> Column:
    """Hashes in a row, dots where the text has no term; "=" and the digest of the text if it has none at all."""
    none = F.size(F.array_compact(hashes)) == 0
    return F.when(none, F.concat(F.lit("="), text_digest)).otherwise(
        F.array_join(F.transform(hashes, lambda h: F.coalesce(h, F.lit("." * DIGITS))), ""))


def likeness(a: Column, b: Column, a_text: Column, b_text: Column) -> Column:
    """The share of equal hashes among the subsets that either text has terms of. Without any, 1 for equal text digests and else 0."""
    both = F.zip_with(a, b, lambda x, y: F.when(x.isNotNull() | y.isNotNull(), F.coalesce(x == y, F.lit(False))))
    used = F.array_compact(both)
    same = F.size(F.filter(used, lambda s: s)).cast("double")
    return F.when(a_text == b_text, 1.0).when(F.size(used) == 0, 0.0).otherwise(same / F.size(used))


def _range_of(x: Column, cuts: list, kind: str) -> Column:
    """How many of the sorted cuts are smaller, null counting as smallest: looked up among every k-th cut and then between two of these."""
    if not cuts:
        return F.lit(0)
    step = math.isqrt(len(cuts)) + 1
    groups = [cuts[k:k + step] for k in range(0, len(cuts), step)]
    array = lambda values: F.array(*(F.lit(v).cast(kind) for v in values))
    below = lambda values: F.coalesce(F.size(F.filter(values, lambda c: c < x)), F.lit(0))
    whole = below(array(g[-1] for g in groups))
    return (whole * step + below(F.try_element_at(F.array(*map(array, groups)), whole + 1))).cast("int")


def cut_points(rows: DataFrame) -> tuple[list, int]:
    """(cuts in ascending order, number of ranges at most) that give ranges of (id, text) rows about equal bytes, learned from a sample of ids drawn by hash.

    Ids are of any type that has an order. The sample is about CUT_SAMPLE distinct ids; a row counts as 64 bytes more than its text.
    """
    n = rows.count()
    share = min(1.0, CUT_SAMPLE / max(n, 1))
    drawn = rows.filter("id is not null").filter(F.pmod(F.xxhash64("id"), F.lit(1 << 40)) < share * float(1 << 40))
    sample = drawn.groupBy("id").agg(F.sum(F.octet_length("text") + 64).alias("bytes")).orderBy("id").collect()
    total = sum(r["bytes"] for r in sample)
    wanted = max(RANGES * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(total / share / RANGE_BYTES))
    wanted = min(wanted, MOST_RANGES)
    cuts, seen = [], 0
    for r in sample:
        seen += r["bytes"]
        if seen * wanted >= total * (len(cuts) + 1) and len(cuts) < wanted - 1:
            cuts.append(r["id"])
    return cuts, wanted


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(part, place, extra, id, text, next_text): each document with the text of the next one in descending id order, after the last the first.

    Ids, numbers or texts, are cut into ranges of about equal bytes, each of which is one partition. Each range also gets, as its extra last row, the first
    document of the range after it, so neighbours meet in a window within one range. Equal ids are ordered by text; null ids come last. Null texts count as empty.
    """
    spark = docs.sparkSession
    rows = docs.select(col(id_col).alias("id"), F.coalesce(col(text_col), F.lit("")).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    cuts, n = cut_points(rows)
    part = _range_of(F.col("id"), cuts, kind)
    firsts = sorted(rows.select(part.alias("part"), "id").groupBy("part").agg(F.max("id")).collect(), key=lambda r: -r[0])  # one row a range, MOST_RANGES at most
    heads = spark.createDataFrame([(r[0], firsts[(k + 1) % len(firsts)][1]) for k, r in enumerate(firsts)], f"part int, head {kind}")
    lead = rows.join(F.broadcast(heads), F.col("head").eqNullSafe(F.col("id"))).groupBy("part", "id").agg(F.min("text").alias("text"))
    both = rows.select(part.alias("part"), "id", "text", F.lit(False).alias("extra")).union(lead.select("part", "id", "text", F.lit(True)))
    order = W.partitionBy("part").orderBy("extra", F.col("id").desc_nulls_last(), "text")
    return both.repartitionById(n, "part").select("part", F.row_number().over(order).alias("place"), "extra", "id", "text", F.lead("text").over(order).alias("next_text"))


def document_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", low: float = LOW, high: float = HIGH) -> DataFrame:
    """(id, fingerprint) per document. Null texts count as empty; equal texts have equal fingerprints; repeated rows repeat the result."""
    rows = docs.select(col(id_col).alias("id"), F.coalesce(col(text_col), F.lit("")).alias("text"))
    once = rows.select("text", F.md5("text").alias("own")).distinct()
    prints = fingerprints(once, ["own"], F.lit(0), lexicon(rows.select("text"), low, high))
    return (rows.select("id", F.md5("text").alias("own")).join(prints, "own")
            .select(F.col("id").alias(id_col), render(F.col("hashes"), F.col("own")).alias("fingerprint")))


def edited_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", low: float = LOW, high: float = HIGH) -> DataFrame:
    """Fingerprints of every text and of the text whose second half is replaced by the start of the next document.

    Returns id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next. The next document is that of
    :func:`with_next`. Null texts count as empty. Equal texts have equal fingerprints, so rows that repeat an id and text repeat
    these, while what follows a row is its own. Other columns are ignored. No rows give no rows.
    """
    band = lexicon(docs.select(F.coalesce(col(text_col), F.lit("")).alias("text")), low, high)
    half = F.floor(F.char_length("text") / 2).cast("int")
    edited = F.concat(F.substr("text", F.lit(1), F.char_length("text") - half), F.substr("next_text", F.lit(1), half))
    versions = F.when(F.col("extra"), F.array("text")).otherwise(F.array(F.col("text"), edited))
    rows = with_next(docs, id_col, text_col)
    rows = rows.select("part", "place", "extra", "id", F.char_length("text").cast("long").alias("n_chars"), F.posexplode(versions).alias("which", "text"))
    kept = {"id": F.col("id"), "extra": F.col("extra"), "n_chars": F.col("n_chars"), "own": F.md5("text"), "sha": F.sha2("text", 256)}
    meta = F.named_struct(*(x for name, value in kept.items() for x in (F.lit(name), value)))
    prints = fingerprints(rows, ["part", "place", "which"], meta, band)
    pick = lambda k, c: F.first(F.when(F.col("which") == k, F.col(c)), ignorenulls=True)
    pairs = prints.groupBy("part", "place").agg(pick(0, "meta").alias("a"), pick(1, "meta").alias("b"), pick(0, "hashes").alias("x"), pick(1, "hashes").alias("y"))
    order = W.partitionBy("part").orderBy("place")
    pairs = pairs.withColumn("z", F.lead("x").over(order)).withColumn("c", F.lead("a.own").over(order)).filter("not a.extra")
    return pairs.select(F.col("a.id").alias(id_col), "a.n_chars", F.col("b.sha").alias("edited_sha256"),
                        render(F.col("x"), F.col("a.own")).alias("fingerprint"), render(F.col("y"), F.col("b.own")).alias("edited_fingerprint"),
                        likeness(F.col("x"), F.col("y"), F.col("a.own"), F.col("b.own")).alias("near_edited"),
                        likeness(F.col("x"), F.col("z"), F.col("a.own"), F.col("c")).alias("near_next"))
