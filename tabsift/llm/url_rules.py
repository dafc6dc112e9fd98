"""URL filters: pattern rules indexed by their rarest literal token; the tokens of a url fetch candidates, and only these run a regular expression."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tabsift.llm.common import ascii_lower, col

#: The method's own patterns, in the syntax of :func:`compiled`: spam farms, adult sites and pages that hold no text worth keeping.
PATTERNS = (
    ("block", "||spam-farm."), ("block", "||cheap-pills."), ("block", "||casino."), ("block", "||porn."), ("block", "||xxx."),
    ("block", "/cgi-bin/"), ("block", "/wp-login.php"), ("block", "/checkout^"), ("block", "/search^"), ("allow", "||docs.*/search^"),
)
#: Rule tables of at most this many characters are broadcast; larger ones are joined by salted tokens.
BROADCAST_CHARS = 16_000_000
SALTS = 16
COPIES = 65_536
_token = re.compile(r"[A-Za-z0-9]+")
_schema = "rule string, verdict string, layer int, size int, regex string, tokens array<string>"


def compiled(pattern: str) -> tuple[str, list[str]]:
    r"""The regular expression of a pattern, and the literal tokens that every url it fits must hold as whole tokens.

    ``||`` at the start stands for the begin of a host or one of its labels, ``|`` for the begin or the end, ``*`` for any run and ``^`` for a separator
    or the end. A token counts if it is bounded on both sides by something that can't extend it. Hosts are to be given in lower case.
    """
    body, head, tail = pattern, "", ""
    if body.startswith("||"):
        body, head = body[2:], r"^(?:[^/]*\.)?"
    elif body.startswith("|"):
        body, head = body[1:], "^"
    if body.endswith("|"):
        body, tail = body[:-1], r"\z"
    parts = [r"[\s\S]*" if c == "*" else r"(?:[^A-Za-z0-9_.%-]|\z)" if c == "^" else re.sub(r"([^A-Za-z0-9_])", r"\\\1", c) if c.isascii() else c for c in body]
    tokens = []
    for m in _token.finditer(body):
        left = body[m.start() - 1] != "*" if m.start() else bool(head)
        right = body[m.end()] != "*" if m.end() < len(body) else bool(tail)
        if left and right:
            tokens.append(m[0])
    return head + "".join(parts) + tail, sorted(set(tokens))


def _table(spark: SparkSession, sites: Sequence[tuple[str, str]], patterns: Sequence[tuple[str, str]]) -> tuple[DataFrame, int]:
    rows = [(rule, verdict, 1, len(rule), *compiled("||" + rule)) for verdict, rule in dict.fromkeys(sites)]
    rows += [(rule, verdict, 0, len(rule), *compiled(rule)) for verdict, rule in dict.fromkeys(patterns)]
    return spark.createDataFrame(rows, _schema), sum(len(r[0]) + len(r[4]) for r in rows)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lowered; path: from there up to ``?``, ``#`` or the end. Else both are empty."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    return ascii_lower(host), F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"^[^?#]*", 0)


def _tokens(address: Column) -> Column:
    return F.filter(F.array_distinct(F.split(address, "[^A-Za-z0-9]+")), lambda t: t != "")


def rule_index(addresses: DataFrame, rules: DataFrame) -> DataFrame:
    """The rules, each with one ``token``: of its literal tokens the one that the fewest addresses hold (ties: the smallest); '' if it has none.

    Only tokens that rules name are counted, so the counts are as many rows as rules have tokens.
    """
    named = rules.select(F.explode("tokens").alias("token")).distinct()
    seen = (addresses.select(F.explode(_tokens(F.col("address"))).alias("token")).join(F.broadcast(named), "token", "left_semi")
            .groupBy("token").agg(F.count("*").alias("held")))
    rarest = (rules.select("rule", "layer", F.explode("tokens").alias("token")).join(seen, "token", "left").groupBy("rule", "layer")
              .agg(F.min(F.struct(F.coalesce("held", F.lit(0)).alias("held"), "token"))["token"].alias("token")))
    return rules.drop("tokens").join(rarest, ["rule", "layer"], "left").withColumn("token", F.coalesce("token", F.lit("")))


def judge(pages: DataFrame, sites: Sequence[tuple[str, str]], patterns: Sequence[tuple[str, str]] = PATTERNS, default: str = "allow",
          id_col: str = "page_id", url_col: str = "url", broadcast_chars: int = BROADCAST_CHARS) -> DataFrame:
    """One row per page: id, host, path, rule (the longest site rule that fits, else null), verdict, pattern (that decided where no rule fits, else null).

    ``sites`` are (verdict, host/path) rules, whose hosts cover their subdomains and whose paths are prefixes; ``patterns`` are (verdict, pattern) and
    decide where no site rule fits, by the longest that does; without one the verdict is ``default``. Equal lengths: the greatest rule in byte order.

    A rule is a candidate of a url only if the url holds the rule's rarest token. Rules up to ``broadcast_chars`` are broadcast; more are
    joined by token, salted, as a common token may be in every url. Equal (id, url) rows are judged once and come back as many times.
    Urls that are null, empty or without ``://`` have an empty host and path and fit no site rule. Other columns are ignored. No rows give no rows.
    """
    rules, chars = _table(pages.sparkSession, sites, patterns)
    host, path = host_and_path(F.col("url"))
    rows = pages.select(col(id_col).alias("id"), col(url_col).alias("url"))
    address = F.concat("host", "path")
    index = rule_index(rows.select(F.concat(host, path).alias("address")), rules)
    distinct = rows.groupBy("id", "url").agg(F.count("*").alias("n")).withColumn("host", host).withColumn("path", path)
    asked = distinct.withColumn("token", F.explode(F.array_append(_tokens(address), F.lit(""))))      # '': rules without a literal token
    if chars <= broadcast_chars:
        met = asked.join(F.broadcast(index), "token", "left")
    else:
        asked = asked.withColumn("salt", F.pmod(F.xxhash64("id", "url"), F.lit(SALTS)))
        met = asked.join(index.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long")))), ["token", "salt"], "left")
    fits = F.when(F.when(F.col("regex").isNotNull(), F.rlike(address, F.col("regex"))), F.struct("layer", "size", "rule", "verdict"))
    best = met.withColumn("fit", fits).groupBy("id", "url", "n", "host", "path").agg(F.max("fit").alias("fit"))
    out = best.withColumn("block", F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / COPIES).cast("int"))))
    out = out.withColumn("copy", F.explode(F.sequence(F.lit(1), F.least(F.lit(COPIES), F.col("n") - F.col("block") * F.lit(COPIES)).cast("int"))))
    return out.select(F.col("id").alias(id_col), "host", "path", F.when(F.col("fit.layer") == 1, F.col("fit.rule")).alias("rule"),
                      F.coalesce("fit.verdict", F.lit(default)).alias("verdict"), F.when(F.col("fit.layer") == 0, F.col("fit.rule")).alias("pattern"))
