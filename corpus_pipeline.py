"""From raw documents to packed sequences: the stages that a training corpus passes, each over all that its predecessor kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents. Extra columns of the
input are kept, whatever their names; the stages add none. Null, empty and letterless texts are rejected by the first stage. Line dedup may leave a
text empty or without letters, which then stays and is packed. Decisions are made for an id and its text, so texts that share an id don't share
a verdict; of rows that repeat an id and text, near_dedup keeps one, the first by its columns as JSON. Rows without an id are told apart by their text.
An empty table passes through all stages.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from tabsift.llm.common import col, cut_lineage, unused
from tabsift.llm.decontaminate import contamination
from tabsift.llm.langid import UNKNOWN, predict, train
from tabsift.llm.line_dedup import remove_boilerplate
from tabsift.llm.minhash import near_duplicate_groups
from tabsift.llm.packing import packed_documents
from tabsift.llm.queries import vocabulary

#: A text goes if no language was found, or if the best one has less than this mean probability.
LEAST_SCORE = 0.3
#: Documents whose shingle sets are so similar, in hundredths, are near duplicates.
NEAR_PERCENT = 80


def _decided(docs: DataFrame, judge: Callable[[DataFrame, str], DataFrame], keep: str, once: bool = False) -> DataFrame:
    """The documents that a verdict keeps.

    Operators get an id of its own for each pair of id and text (64 bits of the text's hash tell texts of one id apart), ordered by id with
    nulls last. With ``once``, one row stays of those that repeat an id and text.
    """
    own, other = unused(docs, "own"), unused(docs, "other")
    key = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.xxhash64("text").alias("text"))
    rows = docs.withColumn(own, key)
    kept = judge(rows, own).filter(keep).select(col(own).alias(other)).distinct()
    rows = rows.join(kept, F.col(own) == F.col(other), "left_semi")
    if once:
        several = cut_lineage(rows.groupBy(own).count().filter("count > 1").select(F.col(own).alias(other)))
        if several.take(1):
            same = F.col(own) == F.col(other)
            whole = F.struct(*map(col, docs.columns))
            least = rows.join(several, same, "left_semi").groupBy(own).agg(F.min_by(whole, F.to_json(whole)).alias(other)).select(f"{other}.*")
            return rows.join(several, same, "left_anti").drop(own).union(least)
    return rows.drop(own)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that could be told (byte convolutional network, learned from their own languages)."""
    model = train(docs)
    return _decided(docs, lambda rows, key: predict(rows, model, key), f"lang_pred != '{UNKNOWN}' and score >= {LEAST_SCORE}")


def boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines that stand on many sites; the first place of such a line stays."""
    removed = unused(docs, "removed")
    out = remove_boilerplate(docs, count_col=removed)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col(removed) > 0, F.char_length("text").cast("long")).otherwise(F.col("n_chars")))
    return out.drop(removed)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group, the one with the smallest id; one row of those that repeat an id and text."""
    return _decided(docs, lambda rows, key: near_duplicate_groups(rows, key, percent=NEAR_PERCENT), "kept", once=True)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any benchmark passage."""
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return _decided(docs, lambda rows, key: contamination(rows, bench, key), "not contaminated")


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of the documents with their place in sequences of a fixed length."""
    return packed_documents(docs, vocabulary("word_bpe_49k.json"))


STAGES = [
    ("language_id", language),
    ("line_dedup", boilerplate),
    ("near_dedup", near_duplicates),
    ("decontamination", benchmark),
    ("packing", packing),
]

#: Trained networks, signatures and token ids aren't SQL; the stages are tested against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; what a stage returns is stored before the next one reads it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = cut_lineage(docs)
    return docs
