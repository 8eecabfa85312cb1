"""The driver's tables under the names and columns that the operators use."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.functions import times


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def behaviours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(event_id, user_id, item_id, action, ts, seconds, value) of `events`; the item is the number in props."""
    return table(spark, sf_dir, "events").select(
        "event_id",
        "user_id",
        F.get_json_object("props", "$.k").cast("int").alias("item_id"),
        F.col("event_type").alias("action"),
        "ts",
        times.unix_seconds("ts").alias("seconds"),
        "value",
    )


#: The same for SQL twins: put in front of a query as its first WITH.
BEHAVIOURS_SQL = """WITH ev AS (
  SELECT event_id, user_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS item_id, event_type AS action, ts,
         CAST(floor(epoch_us(ts) / 1000000) AS BIGINT) AS seconds, value FROM events
)"""


def purchases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(user_id, item_id, quantity, ts) of order lines."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_partkey").alias("item_id"), F.col("l_quantity").alias("quantity"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("user_id"), F.col("o_orderdate").alias("ts"))
    return lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select("user_id", "item_id", "quantity", "ts", "l_orderkey")
