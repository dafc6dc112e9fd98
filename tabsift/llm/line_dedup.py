"""Line dedup by distinct-site spread: lines that stand on many sites are boilerplate."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tabsift.llm.common import col, cut_lineage, row_key, unused

BLANKS = " \t\r\x0b\x0c"


def _lines(docs: DataFrame, id_col: str, text_col: str, site_col: str) -> DataFrame:
    """Two 64-bit hashes of every line that isn't blank, with its document and place."""
    rows = docs.select(F.unhex(row_key(col(id_col), col(text_col))).alias("key"), col(id_col).alias("id"), col(site_col).alias("site"),
                       F.posexplode(F.split(col(text_col), "\n")).alias("pos", "raw"))
    line = F.btrim(F.col("raw"), F.lit(BLANKS))
    return rows.filter(line != "").select("key", "id", F.col("site").cast("string").alias("site"), "pos", F.xxhash64(line).alias("h1"),
                                          F.xxhash64(F.lit("second"), line).alias("h2"))


def boilerplate(lines: DataFrame, min_sites: int, lg_k: int) -> DataFrame:
    """(h1, h2, first): lines on at least ``min_sites`` distinct sites, with their first place.

    Sites are estimated with a HyperLogLog sketch per line, merged by aggregation. Lines within four standard errors of the threshold,
    one site at least, are decided by an exact distinct count.
    """
    margin = max(1.0, 4 * 1.04 / 2 ** (lg_k / 2) * min_sites)
    place = F.struct(F.col("id").isNull().alias("no_id"), "id", "key", "pos")
    spread = cut_lineage(lines.groupBy("h1", "h2").agg(F.hll_sketch_estimate(F.hll_sketch_agg("site", F.lit(lg_k))).alias("sites"),
                                                       F.min(place).alias("first")).filter(F.col("sites") >= min_sites - margin))
    near = spread.filter(F.col("sites") <= min_sites + margin)
    pairs = lines.select("h1", "h2", "site").distinct()          # a common line is as many rows as it has sites
    exact = pairs.join(near, ["h1", "h2"], "left_semi").groupBy("h1", "h2").agg(F.count("site").alias("exact"))
    return spread.join(exact, ["h1", "h2"], "left").filter(F.coalesce("exact", "sites") >= min_sites).select("h1", "h2", "first")


def remove_boilerplate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source",
                       min_sites: int = 10, lg_k: int = 12, keep_first: bool = True, count_col: str = "n_removed") -> DataFrame:
    """The documents with all their columns, text without boilerplate lines, and the number of lines that went (a column of that name is replaced).

    Lines are compared without the blanks around them; blank lines always stay. A line on ``min_sites`` sites or more is removed from
    every document, but for its first place (smallest id, then text digest and line number; null ids last) if ``keep_first``, so that no
    passage is lost altogether; a text may become empty. Null sites don't count. Null texts stay null. Rows that repeat an id and text are the same place
    and get the same result. No rows give no rows.
    """
    lines = cut_lineage(_lines(docs, id_col, text_col, site_col))
    hit = lines.join(cut_lineage(boilerplate(lines, min_sites, lg_k)), ["h1", "h2"])      # stored, so that Spark can split a common line's rows
    if keep_first:
        hit = hit.filter("key != first.key or pos != first.pos")
    gone = hit.groupBy("key").agg(F.collect_set("pos").alias("gone"))
    own, removed, cut = unused(docs, "key"), unused(docs, "gone"), unused(docs, "lines")
    rows = docs.withColumn(own, F.unhex(row_key(col(id_col), col(text_col))))
    both = rows.join(gone.select(F.col("key").alias(own), F.col("gone").alias(removed)), own, "left")
    both = both.withColumn(cut, F.when(F.col(removed).isNotNull(), F.split(col(text_col), "\n")))
    places = F.array_except(F.sequence(F.lit(0), F.size(cut) - 1), F.col(removed))
    text = F.when(F.col(removed).isNull(), col(text_col)).otherwise(F.array_join(F.transform(places, lambda i: F.get(F.col(cut), i)), "\n"))
    return both.select(*(text.alias(c) if c == text_col else col(c) for c in docs.columns if c != count_col),
                       F.coalesce(F.size(removed), F.lit(0)).alias(count_col))
