"""A feature store on Parquet: an offline history, a view of the newest values, and syncing one to the other."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.sources import files

SCHEMA = "entity_type string, entity_id long, feature string, value double, ts timestamp_ntz"


def write_features(df: DataFrame, path: str) -> None:
    """Appends (entity_type, entity_id, feature, value, ts), one folder for each feature."""
    files.write(df, path, "parquet", mode="append", by=["entity_type", "feature"])


def read_features(spark: SparkSession, path: str, entity_type: str, features: list[str], entities: DataFrame | None = None, start: str | None = None, end: str | None = None) -> DataFrame:
    """History of some features; folders of other features aren't read."""
    found = spark.read.parquet(path).filter((F.col("entity_type") == entity_type) & F.col("feature").isin(features))
    if start:
        found = found.filter(F.col("ts") >= F.lit(start).cast("timestamp_ntz"))
    if end:
        found = found.filter(F.col("ts") < F.lit(end).cast("timestamp_ntz"))
    return found if entities is None else found.join(entities.select("entity_id"), "entity_id", "left_semi")


def online(history: DataFrame, ttl_days: int | None = None) -> DataFrame:
    """(entity_type, entity_id, features): a map of the newest value of each feature, those past their time left out."""
    fresh = history if ttl_days is None else files.retained(history, ttl_days)
    newest = fresh.groupBy("entity_type", "entity_id", "feature").agg(F.max_by("value", "ts").alias("value"))
    pairs = F.array_sort(F.collect_list(F.struct("feature", "value")))
    return newest.groupBy("entity_type", "entity_id").agg(F.map_from_entries(pairs).alias("features"))


def sync(spark: SparkSession, offline: str, store: str, entity_type: str) -> int:
    """Writes the newest values of an entity type to the online table; the number of entities synced."""
    found = online(spark.read.parquet(offline).filter(F.col("entity_type") == entity_type))
    found.write.mode("overwrite").parquet(store)
    return spark.read.parquet(store).count()


def statistics(history: DataFrame) -> DataFrame:
    return history.groupBy("feature").agg(
        F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"), F.min("value").alias("min"), F.max("value").alias("max"), F.stddev_pop("value").alias("std")
    )
