"""Queries of conversation repair, the manifest and the url filter over the whole tables, and the SQL they are checked against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tabsift.llm.merkle import checked, field_digest, manifest
from tabsift.llm.repair import damaged, repair
from tabsift.llm.url_rules import judge

#: The rules that pages are judged by, and the fields of a manifest's leaf.
SITES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def repaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair(damaged(spark.read.parquet(f"{sf_dir}/conversations.parquet")), present_col="present")


def witnessed(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(*FIELDS)
    tampers = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0, F.lit(False))
    changed = F.when(tampers, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    rows = docs.select("doc_id", "source", field_digest(*FIELDS).alias("leaf"), changed.alias("text"), "lang", "n_chars")
    rows = rows.select("doc_id", "source", "leaf", field_digest(*FIELDS).alias("found"))
    out = checked(manifest(rows, "leaf", "source", ["doc_id"]), "found")
    hexed = {c: F.lower(F.hex(c)).alias(c) for c in ("leaf", "subroot", "root")}
    return out.select("doc_id", *hexed.values(), "proof_sha256", "folded_root", (F.col("folded_root") == F.lower(F.hex("root"))).alias("verified"))


def judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet"), SITES)


QUERIES = {"op11_audit_repair": repaired, "op12_witness_manifest": witnessed, "op13_rarest_token_rules": judged}

JUDGED_SQL = r"""
WITH cut AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), parts AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') AS path
  FROM cut
), judged AS (
  SELECT *, list_filter([{'rule': 'www.example.com/en/', 'host': 'www.example.com', 'path': '/en/', 'verdict': 'allow'},
                         {'rule': 'example.com/en/', 'host': 'example.com', 'path': '/en/', 'verdict': 'block'},
                         {'rule': 'net/es/', 'host': 'net', 'path': '/es/', 'verdict': 'block'}, {'rule': 'net/fr/', 'host': 'net', 'path': '/fr/', 'verdict': 'block'},
                         {'rule': 'com/', 'host': 'com', 'path': '/', 'verdict': 'allow'}],
                        lambda r: (host = r.host OR ends_with(host, '.' || r.host)) AND starts_with(path, r.path))[1] AS site,
         list_filter([{'pattern': '||docs.*/search^', 'regex': '^([^/]*\.)?docs\.(.|\n)*/search([^A-Za-z0-9_.%-]|$)', 'verdict': 'allow'},
                      {'pattern': '||cheap-pills.', 'regex': '^([^/]*\.)?cheap-pills\.', 'verdict': 'block'},
                      {'pattern': '/wp-login.php', 'regex': '/wp-login\.php', 'verdict': 'block'},
                      {'pattern': '||spam-farm.', 'regex': '^([^/]*\.)?spam-farm\.', 'verdict': 'block'},
                      {'pattern': '/checkout^', 'regex': '/checkout([^A-Za-z0-9_.%-]|$)', 'verdict': 'block'},
                      {'pattern': '||casino.', 'regex': '^([^/]*\.)?casino\.', 'verdict': 'block'},
                      {'pattern': '/cgi-bin/', 'regex': '/cgi-bin/', 'verdict': 'block'},
                      {'pattern': '/search^', 'regex': '/search([^A-Za-z0-9_.%-]|$)', 'verdict': 'block'},
                      {'pattern': '||porn.', 'regex': '^([^/]*\.)?porn\.', 'verdict': 'block'},
                      {'pattern': '||xxx.', 'regex': '^([^/]*\.)?xxx\.', 'verdict': 'block'}],
                     lambda r: regexp_matches(host || path, r.regex))[1] AS own
  FROM parts
)
SELECT page_id, host, path, site.rule AS rule, coalesce(site.verdict, own.verdict, 'allow') AS verdict, CASE WHEN site IS NULL THEN own.pattern END AS pattern FROM judged
"""

WITNESSED_SQL = r"""
WITH RECURSIVE fields AS (
  SELECT doc_id, source, coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
         || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS head, text,
         coalesce(list_reduce(list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::UBIGINT), lambda crc, byte:
           list_reduce([xor(crc, byte), 1, 2, 3, 4, 5, 6, 7, 8]::UBIGINT[], lambda x, k: xor(x // 2, (x % 2) * 3988292384::UBIGINT)), 4294967295::UBIGINT), 0) AS inverted
  FROM documents
), leaves AS (
  SELECT doc_id, source, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
         CASE WHEN doc_id IS NOT NULL AND xor(inverted, 4294967295::UBIGINT) % 2 = 0
              THEN sha256(head || coalesce(strlen(replace(text, chr(10), '')) || ':' || replace(text, chr(10), ''), '-'))
              ELSE sha256(head || coalesce(strlen(text) || ':' || text, '-')) END AS found
  FROM fields
), placed AS (
  SELECT *, coalesce('+' || source, '') AS grp, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place FROM leaves
), nodes AS (
  SELECT 0 AS level, grp, place, leaf AS digest FROM placed
  UNION ALL
  SELECT level + 1, grp, place // 3, sha256(string_agg(digest, '' ORDER BY place)) FROM (SELECT *, count(*) OVER (PARTITION BY grp) AS n FROM nodes) AS open
  WHERE n > 1 GROUP BY level, grp, place // 3
), subroots AS (
  SELECT grp, digest AS subroot, level AS height FROM (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY level DESC) AS last FROM nodes) WHERE last = 1
), tops AS (
  SELECT 0 AS level, row_number() OVER (ORDER BY grp) - 1 AS place, subroot AS digest FROM subroots
  UNION ALL
  SELECT level + 1, place // 3, sha256(string_agg(digest, '' ORDER BY place)) FROM (SELECT *, count(*) OVER () AS n FROM tops) AS open
  WHERE n > 1 GROUP BY level, place // 3
), every AS (
  SELECT level, grp, place, digest FROM nodes
  UNION ALL SELECT level, NULL, place, digest FROM tops
), runs AS (
  SELECT level, grp, place // 3 AS run, list(digest ORDER BY place) AS digests FROM every GROUP BY level, grp, place // 3
), homes AS (
  SELECT grp, subroot, height, row_number() OVER (ORDER BY grp) - 1 AS home FROM subroots
), fold AS (
  SELECT p.doc_id, p.leaf, p.found, p.grp, 0 AS step, p.place, p.found AS digest, '' AS proof FROM placed p
  UNION ALL
  SELECT f.doc_id, f.leaf, f.found, f.grp, f.step + 1, CASE WHEN f.step = h.height THEN h.home ELSE f.place END // 3,
         sha256(array_to_string(r.digests[1:own], '') || f.digest || array_to_string(r.digests[own + 2:], '')),
         f.proof || array_to_string(r.digests[1:own], '') || array_to_string(r.digests[own + 2:], '')
  FROM (SELECT f.*, h.height, h.home, (CASE WHEN f.step >= h.height THEN f.step - h.height ELSE f.step END) AS level FROM fold f JOIN homes h ON f.grp = h.grp) AS f
  JOIN homes h ON f.grp = h.grp
  JOIN runs r ON r.level = f.level AND r.grp IS NOT DISTINCT FROM CASE WHEN f.step >= h.height THEN NULL ELSE f.grp END
             AND r.run = CASE WHEN f.step = h.height THEN h.home ELSE f.place END // 3,
       LATERAL (SELECT CASE WHEN f.step = h.height THEN h.home ELSE f.place END % 3 AS own) AS places
  WHERE f.step < h.height + (SELECT max(level) FROM tops)
)
SELECT f.doc_id, f.leaf, h.subroot, (SELECT digest FROM tops ORDER BY level DESC LIMIT 1) AS root, sha256(f.proof) AS proof_sha256, f.digest AS folded_root,
       f.digest = (SELECT digest FROM tops ORDER BY level DESC LIMIT 1) AS verified
FROM fold f JOIN homes h ON f.grp = h.grp WHERE f.step = h.height + (SELECT max(level) FROM tops)
"""

#: Repair is a dynamic programme over strings; it is tested against all edits of small conversations instead.
ORACLES = {"op12_witness_manifest": WITNESSED_SQL, "op13_rarest_token_rules": JUDGED_SQL}
