"""Ingest with dead letters, and filters of the behaviour stream."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.operators.validate import split_valid

WATERMARK = "10 minutes"


def files(spark: SparkSession, path: str, schema: str, kind: str = "json", per_trigger: int = 1000) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).format(kind).load(path)


def once_each(stream: DataFrame, key: str = "event_id", ts: str = "ts", late: str = WATERMARK) -> DataFrame:
    """Events once each; copies are known as long as the watermark keeps their key."""
    return stream.withWatermark(ts, late).dropDuplicatesWithinWatermark([key])


def only(stream: DataFrame, actions: list[str], action: str = "action") -> DataFrame:
    return stream.filter(F.col(action).isin(actions))


def start_ingest(stream: DataFrame, rules: Mapping[str, Column], good: str, dead: str, checkpoint: str, available_now: bool = True):
    """Valid rows to `good`, the others with their errors to `dead`; offsets are kept in `checkpoint`.

    A batch that is run again overwrites its own folder, so no row is written twice.
    """

    def batch(df: DataFrame, number: int) -> None:
        df = df.persist()
        valid, broken = split_valid(df, rules)
        valid.write.mode("overwrite").parquet(f"{good}/batch={number}")
        broken.write.mode("overwrite").parquet(f"{dead}/batch={number}")
        df.unpersist()

    writer = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
