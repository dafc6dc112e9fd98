"""WARC archives: transactions written as request, response or revisit, and metadata records, and assembled again from them."""

from __future__ import annotations

import gzip
import io
import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tabsift.dataset import shared_folder
from tabsift.llm.common import cut_lineage, pick, ship

CRLF = "\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
#: Records of one file, three for a page; a file is read by one task.
FILE_RECORDS = 24_000
#: Bytes of payload that a reading task passes on at once.
BATCH_BYTES = 8 << 20
RECORD = "record_id string, type string, concurrent_to array<string>, refers_to string, target_uri string, date string, payload_digest string, http string, payload binary"


def base32_sha1(data: Column) -> Column:
    """The SHA-1 of bytes in upper-case base32: fifteen hex digits are twelve digits to the base of 32, which are then renamed."""
    def digits(h: Column, start: int, n: int) -> Column:
        return F.lpad(F.conv(F.substring(h, start, n), 16, 32), n * 4 // 5, "0")

    # An array of one binds the hash to a name, so that it is computed once.
    plain = F.transform(F.array(F.sha1(data)), lambda h: F.concat(digits(h, 1, 15), digits(h, 16, 15), digits(h, 31, 10)))
    return F.translate(F.element_at(plain, 1), "0123456789ABCDEFGHIJKLMNOPQRSTUV", ALPHABET)


def _urn(*parts: Column) -> Column:
    h = F.md5(F.concat_ws("\n", *(F.coalesce(p.cast("string"), F.lit("")) for p in parts)))
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *(F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)))), F.lit(">"))


def _record(kind: Column, headers: list[tuple[str, Column]], block: Column) -> Column:
    """A record up to the end of its block; lines whose value is null are left out."""
    lines = [F.lit("WARC/1.1"), F.concat(F.lit("WARC-Type: "), kind), *(F.concat(F.lit(f"{n}: "), v) for n, v in headers),
             F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string"))]
    return F.concat(F.array_join(F.array_compact(F.array(*lines)), CRLF), F.lit(CRLF * 2), block)


def classify(pages: DataFrame, min_bytes: int) -> DataFrame:
    """(id, url, payload, digest, bytes, first): of equal payloads of ``min_bytes`` or more, the largest id is the response the others refer to.

    ``first`` is that id for the others, and null for responses. Only ids and digests are grouped; payloads move once, by id.
    """
    rows = pages.withColumn("digest", base32_sha1(F.col("payload").cast("binary"))).withColumn("bytes", F.octet_length("payload").cast("long"))
    ids = rows.select("id", "digest", "bytes").filter(F.col("bytes") >= min_bytes)
    last = ids.groupBy("digest").agg(F.max("id").alias("first"), F.count("*").alias("n")).filter("n > 1")
    others = ids.join(last, "digest").filter("not id <=> first").select("id", "digest", "first").distinct()
    return rows.join(others.select(F.col("id").alias("oid"), F.col("digest").alias("odigest"), "first"),
                     F.col("id").eqNullSafe(F.col("oid")) & (F.col("digest") == F.col("odigest")), "left").drop("oid", "odigest")


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_bytes: int = 0,
                   date: str = "2024-01-01T00:00:00Z") -> None:
    """Writes a request, a response or revisit, and a metadata record for every page, as gzipped files that Spark commits as a whole.

    Records end with two line breaks, which is the line separator that Spark's text writer puts after each. Null payloads are empty, null urls too.
    Control characters and spaces in urls become %20. Null ids are kept as null; of equal payloads they are the response only where no other is.
    Rows that repeat an id and payload repeat their records, which are read as one capture.
    """
    rows = pick(pages, id=id_col, url=url_col, payload=payload_col)
    rows = rows.withColumn("payload", F.coalesce("payload", F.lit(""))).withColumn("url", F.regexp_replace(F.coalesce("url", F.lit("")), r"[\x00-\x20\x7F]", "%20"))
    rows = classify(rows, min_bytes)
    named = lambda kind, i=F.col("id"): _urn(F.lit(kind), i, F.col("digest"))
    own = named("response")
    revisit = F.col("first").isNotNull()
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.col("bytes").cast("string"), F.lit(CRLF * 2))
    ask = F.concat(F.lit("GET "), F.col("url"), F.lit(f" HTTP/1.1{CRLF}{CRLF}"))
    base = [("WARC-Date", F.lit(date)), ("WARC-Target-URI", F.col("url"))]
    request = _record(F.lit("request"), [("WARC-Record-ID", named("request")), ("WARC-Concurrent-To", own), *base,
                                         ("Content-Type", F.lit("application/http; msgtype=request"))], ask)
    answer = _record(F.when(revisit, "revisit").otherwise("response"),
                     [("WARC-Record-ID", own), *base, ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
                      ("WARC-Profile", F.when(revisit, PROFILE)), ("WARC-Refers-To", F.when(revisit, named("response", F.col("first")))),
                      ("Content-Type", F.lit("application/http; msgtype=response"))], F.concat(http, F.when(revisit, "").otherwise(F.col("payload"))))
    fields = _record(F.lit("metadata"), [("WARC-Record-ID", named("metadata")), ("WARC-Concurrent-To", own), *base,
                                         ("Content-Type", F.lit("application/warc-fields"))], F.coalesce(F.concat(F.lit("page-id: "), F.col("id").cast("string"), F.lit(CRLF)), F.lit("")))
    out = rows.select(F.explode(F.array(request, answer, fields)).alias("value"))
    out.write.option("lineSep", CRLF * 2).option("compression", "gzip").option("maxRecordsPerFile", FILE_RECORDS).text(path)


def _header(source: io.BufferedIOBase) -> tuple[str, list[tuple[str, str]]] | None:
    """The first line and the named fields of a header; None at the end of the file."""
    line = source.readline()
    while line in (b"\r\n", b"\n"):                     # what ends the record before
        line = source.readline()
    if not line:
        return None
    fields: list[tuple[str, str]] = []
    for raw in iter(source.readline, b""):
        text = raw.decode("utf-8", "replace").rstrip("\r\n")
        if not text:
            break
        if text[0] in " \t" and fields:                 # a folded line
            fields[-1] = (fields[-1][0], f"{fields[-1][1]} {text.strip()}")
        else:
            name, _, value = text.partition(":")
            fields.append((name.strip().lower(), value.strip()))
    return line.decode("utf-8", "replace").strip(), fields


def _records(content: bytes, payloads: bool):
    source = io.BufferedReader(gzip.GzipFile(fileobj=io.BytesIO(content))) if content[:2] == b"\x1f\x8b" else io.BytesIO(content)
    while (head := _header(source)) is not None:
        version, fields = head
        if not version.startswith("WARC/"):
            raise ValueError(f"a WARC record was expected, found {version[:60]!r}")
        one = dict(reversed(fields))
        size = int(one["content-length"])
        block = source.read(size)
        if len(block) != size:
            raise ValueError("the archive ends within a record")
        kind, http = one.get("warc-type", ""), None
        if one.get("content-type", "").startswith("application/http"):
            http, _, block = block.partition(b"\r\n\r\n")
            http = http.decode("utf-8", "replace")
        if kind == "response" or not payloads:
            block = None if kind == "response" and not payloads else block
            yield (one.get("warc-record-id"), kind, [v for n, v in fields if n == "warc-concurrent-to"], one.get("warc-refers-to"),
                   one.get("warc-target-uri"), one.get("warc-date"), one.get("warc-payload-digest", "").removeprefix("sha1:") or None, http, block)


def _parse(batches, payloads: bool):
    schema = pa.schema([(n, t) for n, t in zip(("record_id", "type", "concurrent_to", "refers_to", "target_uri", "date", "payload_digest", "http", "payload"),
                                               (pa.string(), pa.string(), pa.list_(pa.string()), *[pa.string()] * 5, pa.binary()))])

    def batch(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    for files in batches:
        for content in files.column("content"):
            rows, held = [], 0
            for record in _records(content.as_py(), payloads):
                rows.append(record)
                held += len(record[-1] or b"")
                if held > BATCH_BYTES or len(rows) >= 4096:
                    yield batch(rows)
                    rows, held = [], 0
            if rows:
                yield batch(rows)


def read_records(spark: SparkSession, path: str, payloads: bool) -> DataFrame:
    """The responses of all archives below ``path``, or all records but without the payloads of responses; archives may be plain or
    gzipped, in one piece or record by record."""
    ship(spark)
    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInArrow(lambda b: _parse(b, payloads), RECORD)


def assemble(spark: SparkSession, path: str, keep: Callable[[Column], Column] | None = None) -> DataFrame:
    """One nested row per capture: capture_id, request, response, revisit, metadata (a list).

    A record belongs to the response or revisit that its WARC-Concurrent-To names, or that names it, or that a request named by it belongs
    to. Identifiers are resolved without payloads; responses then meet their other records in one join. Records that no response or revisit
    is concurrent to stand in rows of their own, with the request that they name if there is one. Records that repeat an identifier count once.
    ``keep`` makes what stands for the payload of a response, where it is read; by default payloads are moved whole.
    """
    links = cut_lineage(read_records(spark, path, False))           # without payloads, so this is small
    rest = links.filter("type != 'response'")
    whole = read_records(spark, path, True)
    if keep is not None:
        whole = whole.withColumn("payload", keep(F.col("payload")))
    shape = F.struct("record_id", "target_uri", "date", "http", "refers_to", "payload_digest", "payload")
    named = links.select("record_id", "type", F.explode("concurrent_to").alias("other"))
    answers = links.filter(F.col("type").isin("response", "revisit")).select("record_id").distinct()
    back = named.filter(F.col("type").isin("response", "revisit")).select(F.col("other").alias("record_id"), F.col("record_id").alias("anchor"))
    direct = named.join(answers.select(F.col("record_id").alias("other")), "other").select("record_id", F.col("other").alias("anchor")).union(back)
    direct = direct.groupBy("record_id").agg(F.min("anchor").alias("anchor"))
    asked = named.filter("type = 'metadata'").join(direct.select(F.col("record_id").alias("other"), F.col("anchor").alias("via")), "other")
    via = asked.groupBy("record_id").agg(F.min("via").alias("via"))
    loose = named.filter("type = 'metadata'").groupBy("record_id").agg(F.min("other").alias("loose"))
    others = (rest.filter(F.col("type").isin("request", "metadata")).join(direct, "record_id", "left").join(via, "record_id", "left").join(loose, "record_id", "left")
              .withColumn("capture_id", F.coalesce("anchor", "via", "loose", "record_id")))
    first = lambda kind: F.min(F.when(F.col("type") == kind, shape))
    around = others.groupBy("capture_id").agg(first("request").alias("request"), F.array_sort(F.collect_set(F.when(F.col("type") == "metadata", shape))).alias("metadata"))
    again = rest.filter("type = 'revisit'").select(F.col("record_id").alias("capture_id"), shape.alias("revisit")).dropDuplicates(["capture_id"])
    around = around.join(again, "capture_id", "full_outer")
    bodies = whole.select(F.col("record_id").alias("capture_id"), shape.alias("response")).dropDuplicates(["capture_id"])
    return bodies.join(around, "capture_id", "full_outer").select("capture_id", "request", "response", "revisit", "metadata")


def archive_path(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/warc-{uuid.uuid4().hex}"


def captured_payloads(spark: SparkSession, path: str) -> DataFrame:
    """(page, payload_bytes, payload_digest, record_type, refers_to) per capture; a revisit's bytes are those of the response that it refers to.

    ``page`` and ``refers_to`` are the page ids of metadata records, as text. Digests of responses are those of the payloads that were read.
    """
    rows = assemble(spark, path, lambda body: F.struct(F.octet_length(body).cast("long").alias("bytes"), base32_sha1(body).alias("digest")))
    page = F.nullif(F.regexp_extract(F.element_at(F.transform("metadata", lambda m: m["payload"].cast("string")), 1), r"page-id: ([^\r\n]*)", 1), F.lit(""))
    flat = rows.select("capture_id", page.alias("page"), F.col("response.payload.bytes").alias("bytes"),
                       F.when(F.col("response").isNotNull(), F.col("response.payload.digest")).otherwise(F.col("revisit.payload_digest")).alias("payload_digest"),
                       F.when(F.col("revisit").isNotNull(), "revisit").otherwise("response").alias("record_type"), F.col("revisit.refers_to").alias("target"))
    flat = cut_lineage(flat)
    full = flat.filter("record_type = 'response'").select(F.col("capture_id").alias("target"), F.col("page").alias("refers_to"), F.col("bytes").alias("whole"))
    return flat.join(full, "target", "left").select("page", F.coalesce("bytes", "whole").alias("payload_bytes"), "payload_digest", "record_type", "refers_to")
