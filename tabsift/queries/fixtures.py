"""Input views over the given tables; the same SQL text runs in Spark and in DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tabsift.dataset import Dataset

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
          "embeddings", "pages", "benchmark", "labels", "conversations"]

COHORT = """
SELECT
  c_custkey AS row_id,
  CAST(CASE WHEN c_custkey % 50 = 7 THEN c_custkey - 1 ELSE c_custkey END AS STRING) AS subject_id,
  CASE WHEN c_custkey % 2 = 0 THEN 'male' ELSE 'Female ' END AS sex,
  CASE WHEN c_custkey % 11 = 0 THEN CAST(NULL AS STRING)
       WHEN c_custkey % 17 = 0 THEN 'Not Tested'
       WHEN c_custkey % 19 = 0 THEN 'N/A'
       ELSE CAST(18 + (c_custkey * 7) % 71 AS STRING) END AS age,
  CASE WHEN c_custkey % 13 = 0 THEN 'HAEM'
       WHEN c_custkey % 29 = 0 THEN 'excl'
       WHEN c_custkey % 5 = 0 THEN concat(CAST(4 + c_custkey % 6 AS STRING), ',', CAST(c_custkey % 10 AS STRING))
       ELSE concat(CAST(4 + c_custkey % 6 AS STRING), '.', CAST(c_custkey % 97 AS STRING)) END AS glucose,
  CASE c_custkey % 4 WHEN 0 THEN 'Control' WHEN 1 THEN 'Control(9)' WHEN 2 THEN 'control (9)' ELSE 'Case' END AS grp,
  CAST(1000 + c_custkey % 30 AS STRING) AS admission_day,
  CAST(1000 + c_custkey % 30 + (CASE WHEN c_custkey % 23 = 0 THEN -3 ELSE c_custkey % 9 END) AS STRING) AS discharge_day,
  CAST(c_custkey % 8 AS STRING) AS part_a,
  CAST(c_custkey % 5 AS STRING) AS part_b,
  CAST(c_custkey % 8 + c_custkey % 5 + (CASE WHEN c_custkey % 31 = 0 THEN 1 ELSE 0 END) AS STRING) AS part_total,
  CASE WHEN c_custkey % 6 = 0 THEN '-' WHEN c_custkey % 6 = 1 THEN ' '
       ELSE concat('seen by clinic ', CAST(c_custkey % 40 AS STRING)) END AS visit_note,
  c_nationkey AS nation_code,
  c_mktsegment AS segment,
  CASE WHEN c_custkey % 97 = 0 THEN c_acctbal * 100 ELSE c_acctbal END AS balance_value
FROM customer
"""

VISITS = """
SELECT o_orderkey AS row_id,
  CAST(o_custkey AS STRING) AS cust_code,
  CASE WHEN o_orderkey % 20 = 0 THEN 'pending'
       WHEN o_orderkey % 20 = 1 THEN '2024/13/45'
       ELSE concat('2024-', CASE WHEN o_orderkey % 12 + 1 < 10 THEN '0' ELSE '' END,
                   CAST(o_orderkey % 12 + 1 AS STRING), '-1', CAST(o_orderkey % 9 AS STRING)) END AS admission_date,
  CASE WHEN o_orderkey % 3 = 0 THEN concat('code', CAST(o_orderkey % 40 AS STRING))
       ELSE CAST(o_orderkey % 500 AS STRING) END AS mixed_field,
  CAST(NULL AS STRING) AS empty_field,
  CASE WHEN o_orderkey % 7 = 0 THEN CAST(NULL AS INT) ELSE CAST(o_orderkey % 2 AS INT) END AS smoker_flag,
  o_orderpriority AS priority
FROM orders
"""

# One way to write a date per column, one row in nine or so broken; the last column mixes two ways.
STAYS = """
SELECT row_id,
  CASE WHEN row_id % 9 = 0 THEN 'Jan 40, 2024' ELSE concat(substring(mon, 1, 3), ' ', d, ', 2024') END AS named_date,
  CASE WHEN row_id % 10 = 0 THEN '5 Brumaire 2024' ELSE concat(d, ' ', mon, ' 2024') END AS long_date,
  CASE WHEN row_id % 11 = 0 THEN '20241345' ELSE concat('2024', mm, dd) END AS compact_date,
  CASE WHEN row_id % 12 = 0 THEN '2024-01-05T25:00' ELSE concat('2024-', mm, '-', dd, 'T10:', dd) END AS minute_time,
  CASE WHEN row_id % 13 = 0 THEN '2024-02-30 10:00:00.123' ELSE concat('2024-', mm, '-', dd, ' 10:00:00.', mm, '3') END AS fraction_time,
  CASE WHEN row_id % 14 = 0 THEN '31.04.2024 10:00' ELSE concat(dd, '.', mm, '.2024 10:00') END AS dotted_time,
  CASE WHEN row_id % 15 = 0 THEN '05-Foo-2024' ELSE concat(dd, '-', substring(mon, 1, 3), '-2024') END AS dashed_date,
  CASE WHEN row_id % 16 = 0 THEN '13/32/24' ELSE concat(mm, '/', dd, '/24') END AS short_date,
  CASE WHEN row_id % 3 = 0 THEN concat(d, '/', m, '/2024') ELSE concat('2024-', mm, '-', dd) END AS mixed_date
FROM (
  SELECT c_custkey AS row_id, CAST(c_custkey % 28 + 1 AS STRING) AS d, CAST(c_custkey % 12 + 1 AS STRING) AS m, lpad(CAST(c_custkey % 28 + 1 AS STRING), 2, '0') AS dd,
    lpad(CAST(c_custkey % 12 + 1 AS STRING), 2, '0') AS mm,
    split_part('January February March April May June July August September October November December', ' ', CAST(c_custkey % 12 + 1 AS INT)) AS mon
  FROM customer
) AS days
"""

MEASURES = """
SELECT concat(CAST(l_orderkey AS STRING), '-', CAST(l_linenumber AS STRING), '-',
              CAST(l_partkey AS STRING), '-', CAST(l_suppkey AS STRING)) AS row_id,
  CASE WHEN l_orderkey % 41 = 0 THEN CAST(NULL AS DOUBLE) ELSE l_quantity END AS quantity_value,
  CASE WHEN l_orderkey % 997 = 0 THEN l_extendedprice * 10 ELSE l_extendedprice END AS price_value,
  CASE WHEN l_orderkey % 503 = 0 THEN CAST(-999 AS DOUBLE) ELSE l_discount END AS discount_rate,
  l_tax AS tax_rate
FROM lineitem
"""

# One delimited file per part, cycling through six shapes: separators, decimal comma, bad headers.
FILES = """
SELECT p_partkey AS file_id,
  concat(CASE p_partkey % 7 WHEN 0 THEN 'codebook_' WHEN 1 THEN 'notes_' ELSE 'cohort_' END, CAST(p_partkey AS STRING),
         CASE p_partkey % 6 WHEN 2 THEN '.tsv' ELSE '.csv' END) AS name,
  CASE p_partkey % 6
    WHEN 0 THEN concat('id;val;txt', chr(10), CAST(p_partkey AS STRING), ';', CAST(p_size AS STRING), ',5;', p_name)
    WHEN 1 THEN concat('id,val,txt', chr(10), CAST(p_partkey AS STRING), ',', CAST(p_size AS STRING), '.5,', p_name)
    WHEN 2 THEN concat('id', chr(9), 'val', chr(10), CAST(p_partkey AS STRING), chr(9), p_brand)
    WHEN 3 THEN concat('id|val', chr(10), chr(10), CAST(p_partkey AS STRING), '|', p_type, ',y')
    WHEN 4 THEN concat('id', chr(10), CAST(p_partkey AS STRING))
    ELSE concat('id,,val,val', chr(10), '1,2,3,', CAST(p_size AS STRING)) END AS content
FROM part
"""

COHORT_METADATA = {
    "required_fields": ["age", "glucose"], "critical_fields": ["glucose"],
    "valid_ranges": {"age": [18, 80]}, "allowed_values": {"grp": ["Control", "Case"]},
    "consistency_rules": [
        {"type": "not_greater_than", "left": "admission_day", "right": "discharge_day"},
        {"type": "sum_equals", "fields": ["part_a", "part_b"], "total": "part_total"},
        {"type": "non_negative", "field": "balance_value"},
        {"type": "non_negative", "field": "no_such_column"},
    ],
    "quasi_identifiers": ["nation_code", "segment", "sex"],
}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def view(spark: SparkSession, folder: str, sql: str, base: str) -> DataFrame:
    """The fixture SQL over one given table, without leaving a temporary view behind."""
    return spark.sql(sql.replace(f"FROM {base}", "FROM {source}"), source=table(spark, folder, base))


def cohort(spark, folder, metadata=COHORT_METADATA, config=None) -> Dataset:
    return Dataset.of("cohort", view(spark, folder, COHORT, "customer"), "row_id", metadata, config)


def visits(spark, folder, metadata=None, config=None) -> Dataset:
    return Dataset.of("visits", view(spark, folder, VISITS, "orders"), "row_id", metadata, config)


def stays(spark, folder, metadata=None, config=None) -> Dataset:
    return Dataset.of("stays", view(spark, folder, STAYS, "customer"), "row_id", metadata, config)


def measures(spark, folder, metadata=None, config=None) -> Dataset:
    return Dataset.of("measures", view(spark, folder, MEASURES, "lineitem"), "row_id", metadata, config)


def files(spark, folder) -> DataFrame:
    return view(spark, folder, FILES, "part")
