"""Behaviour events as JSON messages. The Kafka source itself needs its connector on the class path."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

EVENT = "event_id long, event_type string, user_id long, item_id int, ts timestamp_ntz, value double"


def serialised(df: DataFrame, key: str = "user_id") -> DataFrame:
    """(key, value): one JSON message a row, keyed so that a user's messages stay in order."""
    return df.select(F.col(key).cast("string").alias("key"), F.to_json(F.struct(*df.columns)).alias("value"))


def deserialised(messages: DataFrame, schema: str = EVENT, value: Column | str = "value") -> DataFrame:
    """Columns of the events, and `raw`; what isn't JSON gives nulls."""
    raw = F.col(value) if isinstance(value, str) else value
    return messages.select(raw.cast("string").alias("raw"), F.from_json(raw.cast("string"), schema).alias("e")).select("raw", "e.*")


def read_stream(spark: SparkSession, servers: str, topic: str, **options: str) -> DataFrame:
    """Offsets are kept in the query's checkpoint, so there is nothing to commit."""
    return spark.readStream.format("kafka").options(**{"kafka.bootstrap.servers": servers, "subscribe": topic, "startingOffsets": "earliest"} | options).load()


def write(df: DataFrame, servers: str, topic: str, **options: str) -> None:
    serialised(df).write.format("kafka").options(**{"kafka.bootstrap.servers": servers, "topic": topic, "kafka.acks": "all"} | options).save()
