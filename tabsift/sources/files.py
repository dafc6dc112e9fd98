"""Files as rows: listing, sniffing, decoding, routing and attaching documentation.

Functions take DataFrames with ``name`` and ``content`` (binary) or ``text`` columns, so they work on a
``binaryFile`` listing of a folder and on any table that holds file contents.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tabsift.config import (DATA_EXTENSIONS, DOC_NAME_HINTS, DOCUMENT_EXTENSIONS, ROUTABLE_DATA_EXTENSIONS,
                            ROUTABLE_METADATA_EXTENSIONS, SCAFFOLDING_FILES, STEM_NOISE, merge_metadata)
from tabsift.functions import exprs as X
from tabsift.sources.delimited import cells, quoted_rows

SEPARATORS = [",", ";", "\t", "|"]
SNIFF_LINES = 50


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def extension(name: Column) -> Column:
    return F.lower(F.regexp_extract(name, r"(\.[^.]+)$", 1))


def stem(name: Column) -> Column:
    return F.regexp_replace(name, r"(?<=.)\.[^.]*$", "")


def file_rows(spark: SparkSession, folder: str) -> DataFrame:
    """One row per file with its bytes; meant for documentation and metadata, not for data files."""
    files = spark.read.format("binaryFile").load(folder)
    return files.select("path", file_name(F.col("path")).alias("name"), "length", "content")


def folder_listing(spark: SparkSession, folder: str) -> DataFrame:
    """(path, name, length) of a folder's files; unlike a scan it also shows empty files."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(path)
    rows = [(f.getPath().toString(), f.getPath().getName(), f.getLen()) for f in found if f.isFile()]
    return spark.createDataFrame(rows, "path string, name string, length long")


def list_datasets(files: DataFrame, extensions: list[str] | None = None, cap: int | None = None) -> DataFrame:
    """Accepted data files by name; the cap is the configured ``max_datasets``."""
    found = files.where(extension(F.col("name")).isin(extensions or DATA_EXTENSIONS)).orderBy("name")
    return found if cap is None else found.limit(cap)


def decode_text(content: Column) -> Column:
    """UTF-8 where valid, else Latin-1."""
    return F.when(is_utf8(content), content.cast("string")).otherwise(F.decode(content, "ISO-8859-1"))


def is_utf8(content: Column) -> Column:
    return F.is_valid_utf8(content.cast("string"))


def with_format(files: DataFrame) -> DataFrame:
    """Adds text, separator, decimal mark and encoding note to (name, content) rows."""
    valid = is_utf8(F.col("content"))
    out = files.withColumn("utf8", valid).withColumn("text", decode_text(F.col("content")))
    out = out.withColumn("separator", sniff_separator(F.col("text"), F.col("name")))
    note = (F.when(~F.col("utf8"), "non_utf8_latin1_fallback").when(F.col("separator") == ";", "utf8_semicolon").otherwise("utf8"))
    return out.withColumn("decimal", decimal_mark(F.col("text"), F.col("separator"))).withColumn("encoding_note", note).drop("utf8")


#: The first lines that hold more than white space, with the blank ones between them.
HEAD = r"^(?:[\s\x1c-\x1f\x85\xa0]*+[^\r\n]++(?:\r\n|\n|\r|$)){0,%d}+" % SNIFF_LINES


def sniff_separator(text: Column, name: Column) -> Column:
    """The candidate with the widest header, then the most even line widths; comma when none splits.

    A candidate is skipped when some line is wider than its header, as such a file does not parse. Only the head of the text is split, once.
    """
    head = F.filter(F.split(F.regexp_extract(text, HEAD, 0), r"\r\n|\n|\r"), lambda s: X.strip(s) != "")

    def width(line, sep):
        return F.size(F.split(line, "\\" + sep if sep != "\t" else sep))

    def best(lines):
        bare = F.transform(lines, lambda line: F.regexp_replace(line, '"[^"]*"', ""))

        def candidate(rank, sep):
            widths = F.transform(bare, lambda line: width(line, sep))
            header = F.try_element_at(widths, F.lit(1))
            even = F.size(F.filter(lines, lambda line: width(line, sep) == header)) / F.greatest(F.size(lines), F.lit(1))
            allowed = (header > 1) & (F.array_max(widths) <= header)
            if sep != "\t":
                allowed = allowed & (extension(name) != ".tsv")
            return F.when(allowed, F.struct(header.alias("columns"), even.alias("even"), F.lit(-rank).alias("rank"), F.lit(sep).alias("sep")))

        return F.array_max(F.array_compact(F.array(*[candidate(rank, sep) for rank, sep in enumerate(SEPARATORS)])))["sep"]

    return F.coalesce(F.transform(F.array(head), best)[0], F.lit(","))


def decimal_mark(text: Column, separator: Column) -> Column:
    return F.when((separator != ",") & text.rlike(r"\d,\d"), ",").otherwise(".")


class RaggedFile(ValueError):
    """A row has more cells than the header."""


def read_delimited(spark: SparkSession, path: str, separator: str, decimal: str = ".", encoding: str = "UTF-8", breaks: bool = True) -> DataFrame:
    """All columns as text; decimal commas become dots where a cell is such a number.

    Quoted cells may hold separators, doubled quotes and, with ``breaks``, line breaks, which stay as they are; a file with them is read in two passes, each in as
    many tasks as it has splits. Rows with fewer cells end in nulls, a row with more raises :class:`RaggedFile`.
    """
    reader = spark.read.option("sep", separator).option("header", True).option("encoding", encoding).option("quote", '"').option("escape", '"').option("multiLine", breaks)
    names = reader.csv(path).columns
    if not names:
        return spark.createDataFrame([], "`_c0` string").drop("_c0")
    if breaks:
        rows = cells(quoted_rows(spark, path, separator, encoding), names, separator)
    else:
        rows = reader.schema(", ".join(f"c{i} string" for i in range(len(names) + 1))).csv(path)
    extra = f"c{len(names)}"
    if (over := rows.where(F.col(extra).isNotNull()).select("c0", extra).first()) is not None:
        raise RaggedFile(f"{path.rsplit('/', 1)[-1]}: the row that starts with {over[0]!r} has more than {len(names)} cells")

    def cell(i: int) -> Column:
        value = F.col(f"c{i}")
        return value if decimal == "." else F.regexp_replace(value, r"^(\s*[+-]?\d*),(\d+\s*)$", "$1.$2")

    return rows.select(*[cell(i).alias(n) for i, n in enumerate(names)])


def documentation_text(files: DataFrame) -> DataFrame:
    """(name, text) of readable documentation: text files drop bad bytes, tables fall back to Latin-1."""
    content, kind = F.col("content"), extension(F.col("name"))
    cleaned = F.when(is_utf8(content), content.cast("string")).otherwise(
        F.replace(F.make_valid_utf8(content.cast("string")), F.lit("�"), F.lit("")))
    text = F.when(kind.isin(".txt", ".md"), cleaned).when(kind.isin(".csv", ".tsv"), decode_text(content))
    return files.withColumn("text", text).where(F.col("text").isNotNull()).drop("content")


def route(name: Column) -> Column:
    """Where an incoming file belongs: data, metadata, documentation or ignored."""
    hinted = X.contains_any(F.lower(stem(name)), DOC_NAME_HINTS)
    kind = extension(name)
    return (F.when(kind.isin(ROUTABLE_DATA_EXTENSIONS) & hinted, "documentation").when(kind.isin(ROUTABLE_DATA_EXTENSIONS), "data")
            .when(kind.isin(ROUTABLE_METADATA_EXTENSIONS), "metadata").otherwise("ignored"))


def document_tokens(name: Column) -> Column:
    """Tokens of the stem once the words that mark documentation are gone."""
    plain = F.lower(stem(name))
    for word in STEM_NOISE:
        plain = F.replace(plain, F.lit(word), F.lit(""))
    return X.tokenize_stem(plain)


EVERY_DATASET = "*"


def relate_documents(datasets: DataFrame, documents: DataFrame, n_datasets: int) -> DataFrame:
    """(dataset, name): which documentation belongs to which dataset.

    Shared stem tokens are found by an equi-join on exploded tokens. A documentation-named file, or any file
    when there is a single dataset, belongs to all of them and is kept as one row for ``*`` instead of one
    row per dataset. Structured JSON needs shared tokens or a single dataset.
    """
    usable = documents.where(extension(F.col("name")).isin(DOCUMENT_EXTENSIONS) & ~F.lower("name").isin(SCAFFOLDING_FILES))
    is_json = extension(F.col("name")) == ".json"
    hinted = X.contains_any(F.lower(stem(F.col("name"))), DOC_NAME_HINTS) & ~is_json
    to_all = F.lit(True) if n_datasets == 1 else hinted
    everywhere = usable.where(to_all).select(F.lit(EVERY_DATASET).alias("dataset"), "name")
    left = datasets.select("dataset", F.explode(X.tokenize_stem(F.col("dataset"))).alias("token"))
    right = usable.where(~to_all).select("name", F.explode(document_tokens(F.col("name"))).alias("token"))
    return left.join(right, "token").select("dataset", "name").distinct().unionByName(everywhere)


def merged_metadata(bodies: DataFrame) -> DataFrame:
    """(dataset, key, value): per key the value, as JSON, of the last file in name order; unreadable JSON is skipped."""
    parsed = bodies.select("dataset", "name", F.explode(F.from_json("body", "map<string,variant>")).alias("key", "value"))
    return (parsed.where(F.col("key") != "_instructions").withColumn("value", F.to_json("value")).groupBy("dataset", "key")
            .agg(F.max_by("value", "name").alias("value")))


def metadata_dict(rows: list) -> dict:
    """Collected (key, JSON value) rows of one dataset as a metadata dictionary with defaults."""
    return merge_metadata({r["key"]: json.loads(r["value"]) if r["value"] is not None else None for r in rows})
