import re

import pytest
from pyspark.sql import functions as F

from tabsift.llm.structure_queries import SITES, judged
from tabsift.llm.url_rules import PATTERNS, compiled, judge

URLS = ["http://www.Example.COM/en/x?q=1", "https://example.com/en/", "https://example.com/en", "https://a.b.example.com/de/", "http://notexample.com/en/",
        "https://x.net/es/1", "https://x.net/fr/#t", "https://net/fr/", "https://xnet/fr/", "http://com", "http://com/", "example.com/en/", "", None, "://", "://net/es/",
        "https://spam-farm.org/en/", "https://my.cheap-pills.info", "https://cheap-pillsy.info/", "https://docs.x.org/a/search?q", "https://x.org/search", "https://x.org/searching",
        "https://x.org/wp-login.php", "https://x.org/é/checkout", "https://É.net/es/\n", "https://x.org/" + "a/" * 30_000 + "cgi-bin/", "a://b://net/es/", "https://user@x.net/es/", "https://x.net:80/es/"]


def _plain(url, sites, patterns):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host):])[0]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)

    def fits(rule):
        at, rest = rule.split("/", 1)
        return (host == at or host.endswith("." + at)) and path.startswith("/" + rest)

    site = max(((len(r), r, v) for v, r in sites if fits(r)), default=None)
    own = max(((len(p), p, v) for v, p in patterns if re.search(compiled(p)[0].replace(r"\z", r"\Z"), host + path)), default=None)
    return host, path, site and site[1], (site or own or (0, 0, "allow"))[2], own[1] if own and not site else None


@pytest.mark.parametrize("chars", [0, 1 << 20])
def test_against_all_rules_for_each_url(spark, chars):
    """Repeated rows come back as often; both ways of fetching rules agree with plain Python."""
    rows = [(k, u) for k, u in enumerate(URLS)] + [(1, URLS[1])] * 5 + [(None, URLS[5])] * 3
    pages = spark.createDataFrame(rows, "page_id long, url string").withColumn("rule", F.lit("clash")).withColumn("token", F.lit("clash")).withColumn("a.b", F.lit(1))
    out = judge(pages, SITES, broadcast_chars=chars)
    assert out.columns == ["page_id", "host", "path", "rule", "verdict", "pattern"]
    found = sorted((tuple(r) for r in out.collect()), key=repr)
    assert found == sorted(((k, *_plain(u, SITES, PATTERNS)) for k, u in rows), key=repr)


def test_many_rules_with_and_without_literals(spark):
    patterns = [("block", f"/bad{k}/") for k in range(300)] + [("block", "*evil*"), ("allow", "|good.org/bad7/|"), ("block", "x^y")]
    urls = [f"http://h{k}.org/bad{k}/p" for k in range(0, 320, 7)] + ["http://good.org/bad7/", "http://q.org/my-evil-page", "http://q.org/x/y", "http://q.org/xxy"]
    rows = list(enumerate(urls))
    found = {r.page_id: (r.host, r.path, r.rule, r.verdict, r.pattern) for r in judge(spark.createDataFrame(rows, "page_id long, url string"), SITES, patterns).collect()}
    assert found == {k: _plain(u, SITES, patterns) for k, u in rows}


def test_tokens_are_whole(spark):
    assert compiled("||example.com/en/")[1] == ["com", "en", "example"]
    assert compiled("cheap-pills.")[1] == ["pills"]            # cheap may go on to the left
    assert compiled("*a*b-c*")[1] == []
    assert compiled("|x.y|")[1] == ["x", "y"]


def test_common_tokens_are_not_the_index(spark):
    """Only candidates run expressions: the rarest of a rule's tokens fetches it."""
    from tabsift.llm.url_rules import _table, host_and_path, rule_index
    pages = spark.createDataFrame([(f"https://s{k}.example.com/en/{k}",) for k in range(50)] + [("https://cheap-pills.example.com/",)], "url string")
    host, path = host_and_path(F.col("url"))
    index = {r.rule: r.token for r in rule_index(pages.select(F.concat(host, path).alias("address")), _table(spark, SITES, PATTERNS)[0]).collect()}
    assert index["example.com/en/"] == "en" and index["com/"] == "com" and index["www.example.com/en/"] == "www" and index["||cheap-pills."] == "cheap"


def test_text_ids_empty_table_and_native_plan(spark, folder):
    text = spark.createDataFrame([("a", "http://x.net/es/"), ("b", None)], "page_id string, url string")
    assert {(r.page_id, r.verdict) for r in judge(text, SITES).collect()} == {("a", "block"), ("b", "allow")}
    assert judge(text.limit(0), SITES).collect() == []
    plan = judged(spark, folder)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan) and "html" not in plan
