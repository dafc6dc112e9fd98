import pytest

LONG = " ".join(f"word{k % 977}x{k}" for k in range(20_000))
#: Nulls, empty and blank texts, a very long one, repeated rows, and columns whose names clash with results.
ODD = [
    (1, None, "en", "a"), (2, "", "en", "a"), (3, "  \n\t ", None, None), (4, LONG, "en", "b"), (5, "one two", "en", "b"), (5, "one two", "en", "b"),
    (None, "alpha beta gamma delta epsilon zeta", "en", "c"), (7, "alpha beta gamma delta epsilon zeta", None, "c"), (8, "!!! ??? 123", "en", None),
    (9, "ÀÉ \x01 <|endoftext|> tab\tnew\nline  two  spaces ", "fr", "d"), (10, LONG, "en", "e"),
]
SCHEMA = "doc_id long, text string, lang string, source string"
CLASH = ["id", "key", "n", "kept", "score", "held_out", "n_removed", "digest", "a.b", "row", "length", "part", "term", "rank", "n_words", "lines", "__gone", "__key", "__kept"]


@pytest.fixture(scope="session")
def odd(spark):
    from pyspark.sql import functions as F
    df = spark.createDataFrame(ODD, SCHEMA).withColumn("n_chars", F.char_length("text").cast("long"))
    return df.select("*", *(F.lit("clash").alias(c) for c in CLASH)).repartition(3)


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)


@pytest.fixture(scope="session")
def folder():
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def documents(spark, folder):
    return spark.read.parquet(f"{folder}/documents.parquet")


@pytest.fixture(scope="session")
def long_text():
    return LONG
