import base64
import gzip
import hashlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tabsift.llm.warc import assemble, base32_sha1, captured_payloads, write_archives

PAGES = [(1, "http://a/1", "same"), (2, "http://a/2", "same"), (9, "http://a/9", "same"), (3, None, None), (4, "http://a/ 4\r\nX: y", ""), (5, "http://b", "é\r\n\r\nWARC/1.1\r\n\r\n end"),
         (6, "http://c", "x" * 300_000), (7, "http://d", "ü"), (7, "http://d", "ü"), (None, "http://e", "only"), (8, "http://f", "\r\n")]


def digest(text):
    return base64.b32encode(hashlib.sha1((text or "").encode()).digest()).decode()


def expected(min_bytes=0):
    last = {}
    for i, _, h in PAGES:
        if len((h or "").encode()) >= min_bytes:
            last[h or ""] = max(i if i is not None else -1, last.get(h or "", -1))
    out = set()
    for i, _, h in PAGES:
        first = last.get(h or "")
        again = first is not None and i is not None and first != i
        out.add((None if i is None else str(i), len((h or "").encode()), digest(h), "revisit" if again else "response", str(first) if again else None))
    return out


@pytest.fixture()
def pages(spark):
    return spark.createDataFrame(PAGES, "page_id long, url string, html string").withColumn("digest", F.lit("clash")).withColumn("value", F.lit("clash"))


@pytest.mark.parametrize("min_bytes", [0, 1, 5])
def test_round_trip(spark, pages, tmp_path, min_bytes):
    write_archives(pages.repartition(3), f"{tmp_path}/w", min_bytes=min_bytes)
    out = [tuple(r) for r in captured_payloads(spark, f"{tmp_path}/w").collect()]
    assert set(out) == expected(min_bytes) and len(out) == len(set(out))


def test_captures_are_nested(spark, pages, tmp_path):
    write_archives(pages, f"{tmp_path}/w")
    rows = assemble(spark, f"{tmp_path}/w").collect()
    assert len(rows) == len(PAGES) - 1
    for r in rows:
        assert r.request is not None and len(r.metadata) == 1 and (r.response is None) != (r.revisit is None)
        assert r.request.http.startswith("GET ") and r.request.target_uri == (r.response or r.revisit).target_uri
    texts = Counter(r.response.payload.decode() for r in rows if r.response)
    assert texts == Counter({h or "" for _, _, h in PAGES})


def test_no_pages(spark, pages, tmp_path):
    write_archives(pages.limit(0), f"{tmp_path}/w")
    assert captured_payloads(spark, f"{tmp_path}/w").count() == 0


def record(kind, name, block=b"", **fields):
    head = [b"WARC/1.0", b"WARC-Type: " + kind, b"WARC-Record-ID: " + name] + [f"{k.replace('_', '-')}: {v}".encode() for k, v in fields.items()]
    return b"\r\n".join([*head, b"content-length: %d" % len(block), b"", b""]) + block + b"\r\n\r\n"


def test_links_either_way_and_orphans(spark, tmp_path):
    """Records of other writers: a response that names its request, metadata of a request, one gzip member for each record."""
    http = {"Content_Type": "application/http"}
    parts = [record(b"warcinfo", b"<i>", b"software: x"), record(b"response", b"<r1>", b"HTTP/1.1 200 OK\r\n\r\nbody", WARC_Concurrent_To="<q1>", **http),
             record(b"request", b"<q1>", b"GET / HTTP/1.1\r\n\r\n", **http), record(b"metadata", b"<m1>", b"a: 1", WARC_Concurrent_To="<q1>"),
             record(b"metadata", b"<m2>", b"b: 2", WARC_Concurrent_To="<r1>"), record(b"request", b"<q2>", b"GET /2\r\n\r\n", WARC_Concurrent_To="<gone>", **http),
             record(b"metadata", b"<m3>", b"c: 3", WARC_Concurrent_To="<q2>")]
    (tmp_path / "a.warc.gz").write_bytes(b"".join(map(gzip.compress, parts[:4])))
    (tmp_path / "b.warc").write_bytes(b"".join(parts[4:]))
    rows = {r.capture_id: r for r in assemble(spark, str(tmp_path)).collect()}
    assert rows["<r1>"].response.payload == b"body" and rows["<r1>"].request.record_id == "<q1>"
    assert [m.record_id for m in rows["<r1>"].metadata] == ["<m1>", "<m2>"]
    assert rows["<q2>"].request.record_id == "<q2>" and rows["<q2>"].response is None and [m.record_id for m in rows["<q2>"].metadata] == ["<m3>"]
    assert set(rows) == {"<r1>", "<q2>"}


def test_payloads_are_measured_where_they_are_read(spark, tmp_path):
    """Sizes and digests of payloads are shuffled, not the payloads."""
    texts = [(i, f"http://a/{i}", "".join(hashlib.sha1(f"{i} {j}".encode()).hexdigest() for j in range(500))) for i in range(20)]
    write_archives(spark.createDataFrame(texts, "page_id long, url string, html string"), f"{tmp_path}/w")
    keep = lambda body: F.struct(F.octet_length(body).alias("bytes"), base32_sha1(body).alias("digest"))
    found = {(r.response.payload.bytes, r.response.payload.digest) for r in assemble(spark, f"{tmp_path}/w", keep).collect()}
    assert found == {(len(h), digest(h)) for _, _, h in texts}


def test_base32_of_any_digest(spark):
    data = [(str(k).encode(),) for k in range(3000)] + [(b"",)]
    for r in spark.createDataFrame(data, "data binary").select("data", base32_sha1(F.col("data")).alias("d")).collect():
        assert r.d == base64.b32encode(hashlib.sha1(bytes(r.data)).digest()).decode()
