"""The engine's roles over the given tables: which columns play messages, facts, places, alerts and so on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def messages(spark: SparkSession, d: str) -> DataFrame:
    """raw_message_id, source, text, published_at, received_at: one message a minute."""
    published = F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, doc_id, 0)")
    received = F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, doc_id, doc_id % 600)")
    return table(spark, d, "documents").select(F.col("doc_id").alias("raw_message_id"), "source", "text", published.alias("published_at"), received.alias("received_at"))


def facts(spark: SparkSession, d: str) -> DataFrame:
    """fact_id, source_id, observed_at, category, object_count, k, place_id, dest_id: one fact per event."""
    k = F.get_json_object("props", "$.k").cast("int")
    return table(spark, d, "events").select(
        F.col("event_id").alias("fact_id"), F.col("user_id").alias("source_id"), F.col("ts").cast("timestamp_ntz").alias("observed_at"), F.col("event_type").alias("category"),
        F.floor("value").cast("int").alias("object_count"), k.alias("k"), (k % 25).alias("place_id"), ((k * 7 + 3) % 25).alias("dest_id"),
    )


FACTS_SQL = """facts AS (
  SELECT event_id AS fact_id, user_id AS source_id, ts AS observed_at, event_type AS category, CAST(floor(value) AS INTEGER) AS object_count,
    CAST(props->>'$.k' AS INTEGER) AS k, CAST(props->>'$.k' AS INTEGER) % 25 AS place_id, (CAST(props->>'$.k' AS INTEGER) * 7 + 3) % 25 AS dest_id
  FROM events)"""


def places(spark: SparkSession, d: str) -> DataFrame:
    """place_id, name, parent_id, lon, lat: regions (ids from 100) and the nations in them, on a fixed grid."""
    nation = table(spark, d, "nation").select(F.col("n_nationkey").alias("place_id"), F.col("n_name").alias("name"), (F.col("n_regionkey") + 100).alias("parent_id"))
    region = table(spark, d, "region").select((F.col("r_regionkey") + 100).alias("place_id"), F.col("r_name").alias("name"), F.lit(None).cast("int").alias("parent_id"))
    i = F.col("place_id") % 100
    return nation.unionByName(region).withColumns({"lon": 24.0 + (i % 5) * 3.0, "lat": 46.0 + F.floor(i / 5) * 1.5})


PLACES_SQL = """places AS (
  SELECT *, 24.0 + (place_id % 100 % 5) * 3.0 AS lon, 46.0 + floor(place_id % 100 / 5) * 1.5 AS lat FROM (
    SELECT n_nationkey AS place_id, n_name AS name, n_regionkey + 100 AS parent_id FROM nation
    UNION ALL SELECT r_regionkey + 100, r_name, NULL FROM region))"""


def worked(spark: SparkSession, d: str) -> DataFrame:
    """message_id, line, source_id, status, received_at, processed_at, amount: messages with their processing."""
    o, i, c = (table(spark, d, t) for t in ("orders", "lineitem", "customer"))
    return o.join(i, o.o_orderkey == i.l_orderkey).join(c, o.o_custkey == c.c_custkey).select(
        F.col("o_orderkey").alias("message_id"), F.col("l_linenumber").alias("line"), F.col("c_nationkey").alias("source_id"), F.col("o_orderstatus").alias("status"),
        F.col("o_orderdate").cast("timestamp_ntz").alias("received_at"), F.col("l_shipdate").cast("timestamp_ntz").alias("processed_at"), F.col("l_extendedprice").alias("amount"),
    )


WORKED_SQL = """worked AS (
  SELECT o_orderkey AS message_id, l_linenumber AS line, c_nationkey AS source_id, o_orderstatus AS status, o_orderdate AS received_at, l_shipdate AS processed_at,
    l_extendedprice AS amount
  FROM orders JOIN lineitem ON o_orderkey = l_orderkey JOIN customer ON o_custkey = c_custkey)"""


def posts(spark: SparkSession, d: str) -> DataFrame:
    """source, post_key, edit, text: conversations as posts and their turns as edits."""
    return table(spark, d, "conversations").select(F.col("role").alias("source"), F.col("conv_id").alias("post_key"), F.col("turn").alias("edit"), "text")
