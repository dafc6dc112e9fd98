"""Queries of the operators over the whole tables, and the SQL they are checked against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tabsift.llm.decontaminate import contamination
from tabsift.llm.fingerprint import edited_fingerprints
from tabsift.llm.langid import identify
from tabsift.llm.line_dedup import remove_boilerplate
from tabsift.llm.minhash import near_duplicate_groups
from tabsift.llm.packing import packed_documents
from tabsift.llm.structure_queries import ORACLES as STRUCTURE_ORACLES, QUERIES as STRUCTURE_QUERIES
from tabsift.llm.substring_dedup import remove_repeats
from tabsift.llm.token_counts import token_counts
from tabsift.llm.toxicity import toxicity
from tabsift.llm.warc import archive_path, captured_payloads, write_archives


def table(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary(name: str) -> str:
    """The place of a public vocabulary file on every machine."""
    import public_tokenizers
    return public_tokenizers.path(name)


def repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(table(spark, sf_dir))
    spans = F.coalesce(F.array_join(F.transform("removed", lambda s: F.concat_ws("-", s["start"], s["end"])), ","), F.lit(""))
    chars = F.coalesce(F.aggregate("removed", F.lit(0), lambda a, s: a + s["end"] - s["start"]), F.lit(0))
    return out.select("doc_id", "text", F.col("n_removed").cast("long").alias("n_removed"), spans.alias("removed_spans"), chars.cast("long").alias("removed_chars"))


def toxic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir), table(spark, sf_dir, "labels"))


def archived(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages, path = table(spark, sf_dir, "pages"), archive_path(spark)
    write_archives(pages, path)
    kind = pages.schema["page_id"].dataType
    out = captured_payloads(spark, path)
    return out.select(F.col("page").cast(kind).alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(kind).alias("refers_to"))


def near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_groups(table(spark, sf_dir))


def benchmark_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir), table(spark, sf_dir, "benchmark"))


def edited(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_fingerprints(table(spark, sf_dir))


def packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed_documents(table(spark, sf_dir), vocabulary("word_bpe_49k.json"))


def languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir))


def boilerplate_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_boilerplate(table(spark, sf_dir))
    return out.select("doc_id", "text", F.col("n_removed").cast("long").alias("n_removed"))


def counted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir), vocabulary("byte_bpe_50k.json"))


QUERIES = {
    "op1_substring_dedup": repeats,
    "op2_nnpu_toxicity": toxic,
    "op3_warc_transactions": archived,
    "op4_bbit_minhash": near_duplicates,
    "op5_positional_index": benchmark_hits,
    "op6_imatch": edited,
    "op7_linear_grouping": packed,
    "op8_byte_cnn": languages,
    "op9_site_spread": boilerplate_lines,
    "op10_token_counts": counted,
} | STRUCTURE_QUERIES

REPEATS_SQL = r"""
WITH cut AS (
  SELECT doc_id, regexp_extract_all(text, '[^.!?\n]+[.!?]*[ \t\r\x0b\x0c]*|[.!?]+[ \t\r\x0b\x0c]*|\n') AS pieces FROM documents WHERE text IS NOT NULL
), pieces AS (
  SELECT doc_id, unnest(pieces) AS piece, generate_subscripts(pieces, 1) AS at_piece FROM cut
), placed AS (
  SELECT doc_id, at_piece, piece, coalesce(sum(length(piece)) OVER (PARTITION BY doc_id ORDER BY at_piece ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start,
         list_filter(string_split_regex(lower(piece), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words
  FROM pieces
), units AS (
  SELECT doc_id, start, start + length(piece) AS stop, words, row_number() OVER (PARTITION BY doc_id ORDER BY at_piece) AS unit FROM placed WHERE len(words) > 0
), repeats AS (
  SELECT *, unit - row_number() OVER (PARTITION BY doc_id ORDER BY unit) AS island
  FROM (SELECT *, row_number() OVER (PARTITION BY words ORDER BY doc_id, unit) AS nth FROM units) WHERE nth > 1
), runs AS (
  SELECT doc_id, min(start) AS start, max(stop) AS stop FROM repeats GROUP BY doc_id, island HAVING sum(len(words)) >= 20
), edged AS (
  SELECT r.*, r.start = 0 OR substr(d.text, r.start, 1) = chr(10) AS whole FROM runs r JOIN documents d USING (doc_id)
), kept AS (
  SELECT p.doc_id, string_agg(piece, '' ORDER BY at_piece) AS text FROM placed p
  WHERE NOT EXISTS (SELECT 1 FROM edged r WHERE r.doc_id = p.doc_id AND p.start >= r.start AND (p.start < r.stop OR p.start = r.stop AND r.whole AND p.piece = chr(10)))
  GROUP BY p.doc_id
), told AS (
  SELECT doc_id, count(*) AS n_removed, string_agg(start || '-' || stop, ',' ORDER BY start) AS removed_spans, sum(stop - start)::BIGINT AS removed_chars FROM runs GROUP BY doc_id
)
SELECT d.doc_id, CASE WHEN d.text IS NOT NULL THEN coalesce(k.text, '') END AS text, coalesce(t.n_removed, 0) AS n_removed, coalesce(t.removed_spans, '') AS removed_spans,
       coalesce(t.removed_chars, 0) AS removed_chars
FROM documents d LEFT JOIN kept k USING (doc_id) LEFT JOIN told t USING (doc_id)
"""

SPREAD_SQL = r"""
WITH lines AS (
  SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS unit FROM documents WHERE text IS NOT NULL
), bare AS (
  SELECT *, trim(line, ' ' || chr(9) || chr(13) || chr(11) || chr(12)) AS body FROM lines
), spread AS (
  SELECT body, count(DISTINCT source) AS sites FROM bare WHERE body <> '' GROUP BY body
), marked AS (
  SELECT doc_id, line, unit, coalesce(sites, 0) >= 10 AND row_number() OVER (PARTITION BY b.body ORDER BY doc_id, unit) > 1 AS gone
  FROM bare b LEFT JOIN spread s ON b.body = s.body
), cut AS (
  SELECT doc_id, coalesce(string_agg(line, chr(10) ORDER BY unit) FILTER (WHERE NOT gone), '') AS text, count(*) FILTER (WHERE gone) AS n_removed
  FROM marked GROUP BY doc_id
)
SELECT d.doc_id, c.text, coalesce(c.n_removed, 0) AS n_removed FROM documents d LEFT JOIN cut c USING (doc_id)
"""

HITS_SQL = r"""
WITH words AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS w FROM documents
), items AS (
  SELECT item_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS w FROM benchmark WHERE item_id IS NOT NULL
), wins AS (
  SELECT DISTINCT item_id, array_to_string(w[s:s + 9], ' ') AS win, least(len(w), 10) AS size
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS s FROM items WHERE len(w) > 0)
), sizes AS (SELECT DISTINCT size FROM wins),
grams AS (
  SELECT doc_id, s, size, array_to_string(w[s:s + size - 1], ' ') AS win
  FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS s FROM words, sizes WHERE len(w) >= size)
), found AS (SELECT g.doc_id, g.s, g.size, i.item_id FROM grams g JOIN wins i ON g.win = i.win AND g.size = i.size),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + size)) AS p FROM (SELECT DISTINCT doc_id, s, size FROM found)) GROUP BY doc_id),
named AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM found) GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(h.n_hit, 0)::BIGINT AS n_hit, coalesce(n.n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(n.items, '')) AS items_sha256, coalesce(h.n_hit, 0) > 0 AS contaminated
FROM words d LEFT JOIN hit h USING (doc_id) LEFT JOIN named n USING (doc_id)
"""

ORACLES: dict[str, str] = {"op1_substring_dedup": REPEATS_SQL, "op5_positional_index": HITS_SQL, "op9_site_spread": SPREAD_SQL} | STRUCTURE_ORACLES
