"""Queries of sources and sinks, over files whose contents are derived from the given tables."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from tabsift.config import CONFIG, DATA_EXTENSIONS, DOC_NAME_HINTS, ROUTABLE_DATA_EXTENSIONS
from tabsift.dataset import shared_folder
from tabsift.functions import exprs as X
from tabsift.operators import accuracy, privacy
from tabsift.plans.assess import load_file, run_each
from tabsift.queries import fixtures as T, profiling as QP, sqltext as S
from tabsift.queries.profiling import both, labelled, over
from tabsift.queries.shapes import rounded
from tabsift.sources import files, tables

QUERIES, ORACLES = {}, {}


def add(name, sql, run):
    QUERIES[name] = lambda spark, folder: rounded(run(spark, folder))
    if sql is not None:
        ORACLES[name] = sql


def target(spark, name):
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


# --- sniffing ------------------------------------------------------------------------------------
ALL_FILES = (f"files AS (SELECT file_id, name, content FROM ({T.FILES}) UNION ALL SELECT -1 - doc_id, 'doc_' || CAST(doc_id AS VARCHAR) || '.csv', text FROM documents)")


def text_files(s, d):
    docs = T.table(s, d, "documents").select((-1 - F.col("doc_id")).alias("file_id"), F.concat(F.lit("doc_"), F.col("doc_id").cast("string"), F.lit(".csv")).alias("name"),
                                             F.col("text").alias("content"))
    return T.files(s, d).unionByName(docs)


def binary_files(s, d):
    """Every seventh part file ends in a Latin-1 byte sequence that is no UTF-8."""
    broken = (F.col("file_id") >= 0) & (F.col("file_id") % 7 == 0)
    return text_files(s, d).withColumn("content", F.when(broken, F.encode(F.concat("content", F.lit("µg")), "ISO-8859-1")).otherwise(F.encode("content", "UTF-8")))


BARE = "regexp_replace({}, '\"[^\"]*\"', '', 'g')"
SNIFF = f"""lines AS (SELECT file_id, name, content, list_slice(list_filter(regexp_split_to_array(content, '\\r\\n|\\n|\\r'), lambda x: trim(x) <> ''), 1, 50) AS lines FROM files),
tried AS (SELECT *, len(string_split({BARE.format('lines[1]')}, sep)) AS cols, list_max(list_transform(lines, lambda x: len(string_split({BARE.format('x')}, sep)))) AS widest,
  len(list_filter(lines, lambda x: len(string_split(x, sep)) = len(string_split({BARE.format('lines[1]')}, sep)))) / greatest(len(lines), 1) AS even
  FROM lines, (VALUES (',', 0), (';', 1), (chr(9), 2), ('|', 3)) t(sep, rank)),
sniffed AS (SELECT file_id, any_value(name) AS name, any_value(content) AS content, coalesce(arg_max(sep, (cols, even, -rank)) FILTER (cols > 1 AND widest <= cols AND (sep = chr(9) OR NOT ends_with(name, '.tsv'))), ',') AS separator FROM tried GROUP BY 1)"""


def sniff_sql(select):
    return S.with_ctes(ALL_FILES, SNIFF, select=select)


add("src_sniff_delimiter", sniff_sql("SELECT file_id, name, separator FROM sniffed"),
    lambda s, d: text_files(s, d).select("file_id", "name", files.sniff_separator(F.col("content"), F.col("name")).alias("separator")))
add("src_encoding_note", sniff_sql("SELECT file_id, CASE WHEN file_id >= 0 AND file_id % 7 = 0 THEN 'non_utf8_latin1_fallback' WHEN separator = ';' THEN 'utf8_semicolon' ELSE 'utf8' END AS encoding_note FROM sniffed"),
    lambda s, d: files.with_format(binary_files(s, d)).select("file_id", "encoding_note"))
add("src_decimal_comma", sniff_sql("SELECT file_id, CASE WHEN separator <> ',' AND regexp_matches(content, '\\d,\\d') THEN ',' ELSE '.' END AS decimal FROM sniffed"),
    lambda s, d: files.with_format(binary_files(s, d)).select("file_id", "decimal"))


def _read(s, d):
    """Orders written as semicolon files with decimal commas, documents and pages with quoted line breaks; all are sniffed and read back."""
    path = target(s, "orders-csv")
    comma = F.replace(F.col("o_totalprice").cast("string"), F.lit("."), F.lit(","))
    T.table(s, d, "orders").select("o_orderkey", comma.alias("o_totalprice"), "o_orderpriority").write.option("sep", ";").option("header", True).csv(path)
    df, note = load_file(s, path)
    parts = [df.select(F.lit("orders").alias("file"), F.col("o_orderkey").cast("long").alias("id"), X.number(F.col("o_totalprice")).alias("price"),
                       F.length("o_orderpriority").alias("chars"), F.md5("o_orderpriority").alias("digest"), F.lit(note).alias("note"))]
    for name, key, text, sep in (("documents", "doc_id", "text", "|"), ("pages", "page_id", "html", ",")):
        path = target(s, f"{name}-csv")
        plain = {"sep": sep, "header": True, "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
        T.table(s, d, name).select(key, text, F.lit("end").alias("tail")).write.options(**plain).csv(path)
        df, note = load_file(s, path)
        parts.append(df.select(F.lit(name).alias("file"), F.col(key).cast("long").alias("id"), F.lit(None).cast("double").alias("price"), F.length(text).alias("chars"),
                               F.md5(text).alias("digest"), F.concat(F.lit(note), F.lit(" "), F.col("tail")).alias("note")))
    return reduce(DataFrame.unionByName, parts)


add("src_read_delimited", "SELECT 'orders' AS file, o_orderkey AS id, round(o_totalprice, 6) AS price, length(o_orderpriority) AS chars, md5(o_orderpriority) AS digest, 'utf8_semicolon' AS note FROM orders "
    + "".join(f"UNION ALL SELECT '{t}', {k}, NULL, length({c}), md5({c}), 'utf8 end' FROM {t} " for t, k, c in (("documents", "doc_id", "text"), ("pages", "page_id", "html"))), _read)
add("src_list_datasets", f"SELECT file_id, name FROM ({T.FILES}) WHERE regexp_extract(name, '(\\.[^.]+)$', 1) IN {S.names(DATA_EXTENSIONS)}",
    lambda s, d: files.list_datasets(T.files(s, d), cap=CONFIG["max_datasets"]).select("file_id", "name"))


def _documentation(s, d):
    docs = T.table(s, d, "documents")
    kind = F.element_at(F.array(*[F.lit(x) for x in (".txt", ".md", ".csv", ".pdf")]), (F.col("doc_id") % 4 + 1).cast("int"))
    dirty = (F.col("doc_id") % 4 < 2) & (F.col("doc_id") % 9 == 0)
    body = F.encode("text", "UTF-8")
    rows = docs.select("doc_id", F.concat(F.lit("doc"), F.col("doc_id").cast("string"), kind).alias("name"),
                       F.when(dirty, F.concat(F.unhex(F.lit("FF")), body, F.unhex(F.lit("C3")))).otherwise(body).alias("content"))
    return files.documentation_text(rows).select("doc_id", "name", F.length("text").alias("chars"), F.md5("text").alias("digest"))


add("src_documentation_text", "SELECT doc_id, 'doc' || doc_id || ['.txt', '.md', '.csv'][doc_id % 4 + 1] AS name, length(text) AS chars, md5(text) AS digest FROM documents WHERE doc_id % 4 < 3", _documentation)

BODY = """CASE WHEN c_custkey % 11 = 0 THEN '{broken' ELSE concat('{"_instructions": "ignore", "title": "', c_name, '"', CASE WHEN c_custkey % 3 = 0 THEN concat(', "license": "', c_mktsegment, '"') ELSE '' END,
 ', "id_fields": ["k', CAST(c_custkey % 4 AS STRING), '"]}') END"""


def _metadata(s, d):
    rows = T.table(s, d, "customer").select(F.concat(F.lit("nation_"), F.col("c_nationkey").cast("string")).alias("dataset"),
                                            F.concat(F.lit("f"), F.lpad(F.col("c_custkey").cast("string"), 12, "0"), F.lit(".json")).alias("name"), F.expr(BODY).alias("body"))
    return files.merged_metadata(rows)


META = "SELECT 'nation_' || c_nationkey AS dataset, '{}' AS key, arg_max({}, c_custkey) AS value FROM customer WHERE c_custkey % 11 <> 0{} GROUP BY 1"
add("src_metadata_json", " UNION ALL ".join([META.format("title", "'\"' || c_name || '\"'", ""), META.format("license", "'\"' || c_mktsegment || '\"'", " AND c_custkey % 3 = 0"),
                                             META.format("id_fields", "'[\"k' || (c_custkey % 4) || '\"]'", "")]), _metadata)

HINT = " OR ".join(f"contains(lower(regexp_replace(name, '\\.[^.]*$', '')), {S.quote(h)})" for h in DOC_NAME_HINTS)
add("src_route_documentation", f"""SELECT file_id, name, CASE WHEN ext IN {S.names(ROUTABLE_DATA_EXTENSIONS)} AND ({HINT}) THEN 'documentation' WHEN ext IN {S.names(ROUTABLE_DATA_EXTENSIONS)} THEN 'data'
  WHEN ext IN ('.json', '.txt', '.md', '.pdf', '.docx') THEN 'metadata' ELSE 'ignored' END AS place FROM (SELECT *, lower(regexp_extract(name, '(\\.[^.]+)$', 1)) AS ext FROM ({T.FILES})
  UNION ALL SELECT -1 - page_id, NULL, url, lower(regexp_extract(url, '(\\.[^.]+)$', 1)) FROM pages)""".replace("SELECT *, lower(reg", "SELECT file_id, content, name, lower(reg"),
    lambda s, d: T.files(s, d).select("file_id", "name").unionByName(T.table(s, d, "pages").select((-1 - F.col("page_id")).alias("file_id"), F.col("url").alias("name")))
    .select("file_id", "name", files.route(F.col("name")).alias("place")))

# --- attaching documentation ---------------------------------------------------------------------
DOC_NAMES = """SELECT CASE c_custkey % 6 WHEN 0 THEN concat('readme_', CAST(c_custkey AS STRING), '.md') WHEN 1 THEN concat('study', CAST(c_nationkey AS STRING), '_metadata.json')
 WHEN 2 THEN concat('Survey ', c_mktsegment, ' ', CAST(c_custkey AS STRING), '.txt') WHEN 3 THEN concat('study', CAST(c_nationkey AS STRING), '-values', CAST(c_custkey AS STRING), '.csv')
 WHEN 4 THEN 'METADATA_GUIDE.md' ELSE concat('study', CAST(c_nationkey AS STRING), '.pdf') END AS name FROM customer"""


def _related(s, d):
    datasets = T.table(s, d, "nation").select(F.concat(F.lower("n_name"), F.lit("_study"), F.col("n_nationkey").cast("string")).alias("dataset"))
    return files.relate_documents(datasets, T.view(s, d, DOC_NAMES, "customer").distinct(), datasets.count())


STEM = "replace(replace(replace(replace(replace(lower(regexp_replace(name, '\\.[^.]*$', '')), 'metadata', ''), 'code book', ''), 'codebook', ''), 'readme', ''), 'dictionary', '')"
add("join_dataset_documents", f"""WITH docs AS (SELECT DISTINCT name, lower(regexp_extract(name, '(\\.[^.]+)$', 1)) AS ext FROM ({DOC_NAMES})),
 usable AS (SELECT *, ext <> '.json' AND ({HINT}) AS hinted FROM docs WHERE ext IN ('.json', '.txt', '.md', '.csv', '.tsv') AND lower(name) NOT IN ('metadata_guide.md', 'metadata_template.json')),
 sets AS (SELECT lower(n_name) || '_study' || n_nationkey AS dataset FROM nation)
 SELECT dataset, name FROM usable JOIN sets ON NOT hinted AND len(list_intersect(list_filter(regexp_split_to_array(dataset, '[^a-z0-9]+'), lambda t: length(t) > 1),
   list_filter(regexp_split_to_array({STEM}, '[^a-z0-9]+'), lambda t: length(t) > 1))) > 0 UNION ALL SELECT '*', name FROM usable WHERE hinted""", _related)

# --- result tables -------------------------------------------------------------------------------
def _sink(s, d):
    base = target(s, "results")
    df = labelled(lambda ds: QP.miss_of(ds).drop("ordinal"))(s, d)
    tables.write_table(df, base, "missingness")
    return tables.read_table(s, base, "missingness").select(*df.columns)


add("sink_result_tables", over("cohort", "visits", extra=QP.MISS_CTES, select=S.finish(both(QP.MISS), QP.MISS_D, QP.MISS_I)), _sink)
CLASSES = "SELECT nation_code, segment, sex, count(*) AS class_size FROM cohort GROUP BY 1, 2, 3"


def _json(s, d):
    path = target(s, "classes-json")
    df = privacy.class_sizes(T.cohort(s, d).df, ["nation_code", "segment", "sex"])
    tables.write_json(df, path)
    return s.read.schema(df.schema).json(path)


add("sink_json", S.with_ctes(S.clean("cohort"), select=S.finish(CLASSES, ints="nation_code class_size")), _json)


def _result(s, d):
    """A table read back by name; a table that is missing or empty reads as absent."""
    base = target(s, "results")
    df = privacy.class_sizes(T.cohort(s, d).df, ["nation_code", "segment", "sex"]).withColumn("dataset", F.lit("cohort"))
    tables.write_table(df, base, "classes", "csv")
    tables.write_table(df.where("class_size < 0"), base, "nothing")
    absent = [tables.read_table(s, base, n) is None for n in ("nothing", "never_written")]
    back = tables.read_table(s, base, "classes", "csv")
    return back.select(F.col("nation_code").cast("long").alias("nation_code"), "segment", "sex", F.col("class_size").cast("long").alias("class_size"), F.lit(all(absent)).alias("others_absent"))


add("src_result_table", S.with_ctes(S.clean("cohort"), select=S.finish(f"SELECT *, true AS others_absent FROM ({CLASSES})", ints="nation_code class_size")), _result)


def _status(s, d):
    """Three files of a folder: orders, visits with one row that has a cell too many, and one of a type that can't be read."""
    def count(path):
        return lambda: load_file(s, path)[0].count()

    base = target(s, "status")
    T.table(s, d, "orders").select("o_orderkey", "o_orderpriority").write.option("header", True).csv(f"{base}/good.csv")
    rows = T.visits(s, d).df.select(F.concat_ws(",", F.col("row_id").cast("string"), "cust_code", F.when(F.col("row_id") == LAST, F.lit("one,too,many"))).alias("id,code"))
    rows.write.option("header", True).option("sep", "\u0001").option("quote", "").csv(f"{base}/ragged.csv")          # lines as they are, below a header per part
    T.table(s, d, "nation").select("n_name").write.text(f"{base}/book.xlsx")
    status, results = run_each(s, {n: count(f"{base}/{n}") for n in ("good.csv", "ragged.csv", "book.xlsx")})
    sizes = s.createDataFrame(list(results.items()), "dataset string, n_rows long")
    return status.join(sizes, "dataset", "left")


#: The order whose row is ragged.
LAST = 5
add("catalog_status", "SELECT 'good.csv' AS dataset, 'ok' AS status, NULL::VARCHAR AS error, (SELECT count(*) FROM orders) AS n_rows "
    f"UNION ALL SELECT 'ragged.csv', 'failed', 'RaggedFile: ragged.csv: the row that starts with ''{LAST}'' has more than 2 cells', NULL "
    "UNION ALL SELECT 'book.xlsx', 'failed', 'ValueError: book.xlsx: files of type .xlsx can''t be read', NULL", _status)
