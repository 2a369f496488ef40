"""An entity view over the driver's tables: three registries of noisy business records, and which records match."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: The same text runs in Spark and in DuckDB.
ENTITIES = """
WITH ids AS (
  SELECT 'source1' AS source, 's1_' || CAST(c_custkey AS STRING) AS entity_id, c_custkey AS k, 0 AS v FROM {customer}
  UNION ALL
  SELECT 'source2', 's2_' || CAST(p_partkey AS STRING),
         CASE WHEN p_partkey % 3 = 2 THEN p_partkey + 1000003 ELSE p_partkey END, 1 + p_partkey % 4 FROM {part}
  UNION ALL
  SELECT 'source3', 's3_' || CAST(o_orderkey AS STRING),
         CASE WHEN o_orderkey % 20 = 0 THEN o_custkey ELSE o_orderkey + 2000003 END, (o_orderkey * 7) % 5
  FROM {orders} WHERE o_orderkey % 10 = 0
), w AS (
  SELECT source, entity_id, k, v,
    CASE k % 6 WHEN 0 THEN 'Hotel ' WHEN 1 THEN 'The ' WHEN 2 THEN 'Maison ' ELSE '' END AS pre,
    CASE k % 8 WHEN 0 THEN 'Golden' WHEN 1 THEN 'Phoenix' WHEN 2 THEN 'Royal' WHEN 3 THEN 'Silver'
               WHEN 4 THEN 'Western' WHEN 5 THEN 'Modern' WHEN 6 THEN 'Orient' ELSE 'Blue' END AS w1,
    CASE WHEN v = 2 THEN 'C0ffee' ELSE 'Coffee' END AS w2,
    translate(CAST((k * 7919) % 10007 AS STRING), '0123456789', 'bakelimoru') AS w3,
    CASE (k + v) % 6 WHEN 0 THEN ' Inc.' WHEN 1 THEN ' LLC' WHEN 2 THEN ' SARL' WHEN 3 THEN ' Pvt. Ltd.'
                     WHEN 4 THEN '' ELSE ' & Co' END AS suf,
    CAST(k % 180 + 1 + CASE WHEN v = 4 THEN 1 ELSE 0 END AS STRING) AS door,
    CASE k % 5 WHEN 0 THEN 'Main ' WHEN 1 THEN 'Linden ' WHEN 2 THEN 'Harbor ' WHEN 3 THEN 'Victor ' ELSE 'Station ' END ||
    CASE WHEN v % 2 = 0 THEN 'Street' ELSE 'St' END AS street,
    CASE WHEN k % 4 = 0 THEN ', Suite ' || CAST(k % 15 + 1 AS STRING) ELSE '' END AS unit,
    CASE WHEN v = 3 THEN '' ELSE ', ' || CAST(10000 + (k * 37) % 900 AS STRING) END AS pin,
    CASE k % 4 WHEN 0 THEN CASE WHEN v % 2 = 0 THEN 'United States' ELSE 'USA' END
               WHEN 1 THEN 'France' WHEN 2 THEN CASE WHEN v % 2 = 0 THEN 'India' ELSE 'IND' END ELSE '' END AS country
  FROM ids)
SELECT source, entity_id,
  pre || CASE WHEN v = 3 THEN w2 || ' ' || w1 ELSE w1 || ' ' || w2 END || ' ' || w3 || suf AS business_name,
  door || ' ' || street || unit || pin AS business_address, country,
  CASE k % 7 WHEN 0 THEN 'Austin' WHEN 1 THEN 'Lyon' WHEN 2 THEN 'Pune' WHEN 3 THEN '' ELSE 'Port ' || w3 END AS city,
  CASE k % 3 WHEN 0 THEN 'TX' WHEN 1 THEN 'WA' ELSE '' END AS state,
  CASE WHEN v = 3 THEN '' ELSE CAST(10000 + (k * 37) % 900 AS STRING) END AS zip,
  CASE WHEN v = 1 THEN '' ELSE '+1 (' || substr(CAST(2000000000 + k AS STRING), 1, 3) || ') ' || substr(CAST(2000000000 + k AS STRING), 4, 7) END AS phone
FROM w
"""

TRUTH = """
SELECT 's1_' || CAST(p_partkey AS STRING) AS s1_id, 's2_' || CAST(p_partkey AS STRING) AS cand_id
FROM {part} WHERE p_partkey % 3 <> 2 AND p_partkey IN (SELECT c_custkey FROM {customer})
UNION ALL
SELECT 's1_' || CAST(o_custkey AS STRING), 's3_' || CAST(o_orderkey AS STRING)
FROM {orders} WHERE o_orderkey % 20 = 0 AND o_custkey IN (SELECT c_custkey FROM {customer})
"""
NAMES = ("customer", "part", "orders")


def in_duckdb(sql: str) -> str:
    return sql.format(**{n: n for n in NAMES})


def _read(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    return spark.sql(sql, **{n: spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in NAMES})


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, ENTITIES)


def truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, TRUTH)
