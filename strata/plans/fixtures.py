"""The driver's tables seen as key-value data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.resolve import table_stats

#: Entries of one log segment or table.
SEGMENT = 1000


def kv_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overwrites and tombstones: users' properties, deleted by errors."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.select(F.col("user_id").cast("string").alias("key"), F.when(F.col("event_type") == "error", "").otherwise(F.col("props")).alias("val"), F.col("event_id").alias("seq"))


def sst_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same, dealt to tables with overlapping key ranges (fid, the newest last)."""
    return kv_events(spark, sf_dir).withColumn("fid", F.expr(f"seq div {SEGMENT}"))


def kv_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unique keys whose byte order is not their numeric order."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return o.select(F.col("o_orderkey").cast("string").alias("key"), F.col("o_orderpriority").alias("val"), F.col("o_orderkey").alias("seq"))


def kv_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys with long common prefixes, in tables of one size each."""
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    return p.select(F.concat("p_name", F.lit("#"), F.col("p_partkey").cast("string")).alias("key"), F.col("p_brand").alias("val"), F.col("p_partkey").alias("seq"), F.col("p_size").cast("bigint").alias("fid"))


def kv_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    return c.select(F.col("c_name").alias("key"), F.col("c_mktsegment").alias("val"), F.col("c_custkey").alias("seq"))


def order_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Table statistics over orders: fid, min_key, max_key, num_rows, bytes."""
    return table_stats(kv_orders(spark, sf_dir).withColumn("fid", F.expr("seq div 500")))


def level_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables of events, dealt to four levels, with a size, an age and whether they are busy."""
    t = table_stats(sst_events(spark, sf_dir))
    return t.select("fid", (F.col("fid") % 4).cast("bigint").alias("level"), "min_key", "max_key", "bytes", (100 - F.col("fid") * 3).alias("created"), (F.col("fid") % 8 == 4).alias("busy"))


def changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A manifest log: a file for each customer is created, every third deleted again, and a few changes
    are wrong (deleted twice, or never created)."""
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("fid"), F.col("c_nationkey").cast("bigint").alias("level"))
    made = c.filter("fid % 50 <> 7").select((F.col("fid") * 10).alias("version"), "fid", F.lit("CREATE").alias("op"), (F.col("level") % 7).alias("level"))
    gone = c.filter("fid % 3 = 0").select((F.col("fid") * 10 + 5).alias("version"), "fid", F.lit("DELETE").alias("op"), (F.col("level") % 7).alias("level"))
    twice = c.filter("fid % 30 = 0").select((F.col("fid") * 10 + 6).alias("version"), "fid", F.lit("DELETE").alias("op"), (F.col("level") % 7).alias("level"))
    return made.unionByName(gone).unionByName(twice)


#: The same in SQL, as common table expressions.
SQL = {
    "kv_events": "kv_events AS (SELECT CAST(user_id AS VARCHAR) AS key, CASE WHEN event_type = 'error' THEN '' ELSE props END AS val, event_id AS seq FROM events)",
    "sst_events": f"sst_events AS (SELECT *, seq // {SEGMENT} AS fid FROM kv_events)",
    "kv_orders": "kv_orders AS (SELECT CAST(o_orderkey AS VARCHAR) AS key, o_orderpriority AS val, o_orderkey AS seq FROM orders)",
    "kv_parts": "kv_parts AS (SELECT p_name || '#' || CAST(p_partkey AS VARCHAR) AS key, p_brand AS val, p_partkey AS seq, CAST(p_size AS BIGINT) AS fid FROM part)",
    "kv_customers": "kv_customers AS (SELECT c_name AS key, c_mktsegment AS val, c_custkey AS seq FROM customer)",
    "latest_events": "latest_events AS (SELECT key, arg_max(val, seq) AS val, max(seq) AS seq FROM kv_events GROUP BY key)",
    "stats_events": "stats_events AS (SELECT fid, min(key) AS min_key, max(key) AS max_key, count(*) AS num_rows, CAST(sum(octet_length(encode(key)) + octet_length(encode(val))) AS BIGINT) AS bytes FROM sst_events GROUP BY fid)",
    "order_tables": "order_tables AS (SELECT seq // 500 AS fid, min(key) AS min_key, max(key) AS max_key, count(*) AS num_rows, CAST(sum(octet_length(encode(key)) + octet_length(encode(val))) AS BIGINT) AS bytes FROM kv_orders GROUP BY ALL)",
    "level_tables": "level_tables AS (SELECT fid, CAST(fid % 4 AS BIGINT) AS level, min_key, max_key, bytes, 100 - fid * 3 AS created, fid % 8 = 4 AS busy FROM stats_events)",
    "changes": """changes AS (
  SELECT c_custkey * 10 AS version, c_custkey AS fid, 'CREATE' AS op, CAST(c_nationkey % 7 AS BIGINT) AS level FROM customer WHERE c_custkey % 50 <> 7
  UNION ALL SELECT c_custkey * 10 + 5, c_custkey, 'DELETE', CAST(c_nationkey % 7 AS BIGINT) FROM customer WHERE c_custkey % 3 = 0
  UNION ALL SELECT c_custkey * 10 + 6, c_custkey, 'DELETE', CAST(c_nationkey % 7 AS BIGINT) FROM customer WHERE c_custkey % 30 = 0)""",
    "live_files": "live_files AS (SELECT fid, arg_max(level, version) AS level FROM changes GROUP BY fid HAVING arg_max(op, version) = 'CREATE')",
}
