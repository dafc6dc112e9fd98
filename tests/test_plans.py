"""Physical plans of the scale-critical operators, and SQL checks over the small test tables."""

from pathlib import Path

import pytest

from tabsift.queries.fixtures import TABLES
from tabsift.queries.registry import collect

DATA = Path("/root/testdata/sf0.001")
needs_data = pytest.mark.skipif(not DATA.exists(), reason="test tables are not mounted")


def plan(df):
    return df._jdf.queryExecution().toString()


@needs_data
@pytest.mark.parametrize("name", ["k_anonymity", "duplicate_rows", "class_size_per_record", "tfidf_similarity", "weight_sensitivity",
                                  "embedding_role", "join_dataset_documents", "inject_cycle"])
def test_no_cross_join(spark, name):
    text = plan(collect()[0][name](spark, str(DATA)))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


@needs_data
def test_scans_are_pruned(spark):
    text = plan(collect()[0]["class_size_per_record"](spark, str(DATA)))
    assert "p_retailprice" not in text.split("== Physical Plan ==")[1]


QUICK = ["fn_to_number_comma", "fn_canonical_category", "norm_technical_missing", "profile_columns", "detect_sentinels", "duplicate_rows",
         "domain_scores", "rules_missing_column", "k_anonymity", "class_size_per_record", "column_quantiles", "inject_cycle",
         "tfidf_similarity", "checklist_keywords", "weight_sensitivity", "src_sniff_delimiter", "join_dataset_documents"]


@needs_data
@pytest.mark.parametrize("name", QUICK)
def test_query_equals_sql(spark, name):
    import duckdb
    from tools.check_oracles import canonical
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    queries, oracles = collect()
    df = queries[name](spark, str(DATA))
    cursor = con.execute(oracles[name])
    columns = [c[0] for c in cursor.description]
    assert canonical([tuple(r) for r in df.collect()], df.columns) == canonical(cursor.fetchall(), columns)


def test_every_statement_has_a_query():
    queries, oracles = collect()
    assert set(oracles) <= set(queries) and len(queries) >= 145


def test_queries_are_listed_without_a_session():
    """Tools read the names before Spark starts."""
    import subprocess
    import sys
    from pathlib import Path
    code = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"
    done = subprocess.run([sys.executable, "-c", code], cwd=Path(__file__).resolve().parents[1], capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr[-2000:]
    queries, statements = map(int, done.stdout.split())
    assert queries >= statements > 140
