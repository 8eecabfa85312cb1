"""A data source of its own: landed days of events, of which only those in the asked time range are opened.

    ranges.read(spark, folder).filter("seconds >= 1704200000")

The folder holds one folder a day (day=19723, days since the epoch) of Parquet files, in a file system that all executors mount. The
range comes from the options `start` and `end` (seconds, the end left out) and from filters on `seconds`, whichever is narrower.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from urllib.parse import unquote, urlparse

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual

SCHEMA = "event_id long, user_id long, item_id int, action string, seconds long, value double"
DAY = 86400
PUSHDOWN = "spark.sql.python.filterPushdown.enabled"


def land(df: DataFrame, folder: str) -> None:
    """Writes rows of SCHEMA, a folder a day; a day with many rows is written by several tasks."""
    names = [f.split()[0] for f in SCHEMA.split(", ")]
    dated = df.select(*names, F.floor(F.col("seconds") / DAY).cast("int").alias("day"))
    dated.hint("rebalance", "day").write.mode("append").partitionBy("day").parquet(folder)


def read(spark: SparkSession, folder: str, **options: str | int) -> DataFrame:
    """The rows of a folder; registers the source and lets this session push filters to sources in Python."""
    spark.conf.set(PUSHDOWN, "true")
    spark.dataSource.register(EventRange)
    return spark.read.format("event_range").options(**options).load(folder)


def _local(path: str) -> str:
    parsed = urlparse(path)
    if parsed.scheme not in ("", "file"):
        raise ValueError(f"{path} isn't in a mounted file system; read it with spark.read.parquet")
    return unquote(parsed.path) if parsed.scheme else path


@dataclass
class Day(InputPartition):
    """The files of one day, and the seconds asked for."""

    files: list[str]
    low: int
    high: int


class EventRange(DataSource):
    @classmethod
    def name(cls) -> str:
        return "event_range"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return EventRangeReader(dict(self.options), [f.name for f in schema.fields])


class EventRangeReader(DataSourceReader):
    def __init__(self, options: dict[str, str], names: list[str]):
        self.folder, self.names, self.trace = _local(options["path"]), names, options.get("trace")
        self.low, self.high = int(options.get("start", -(1 << 62))), int(options.get("end", 1 << 62))

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Narrows the range; Spark still applies all filters, so rows that the range can't tell apart are right too."""
        for f in filters:
            if getattr(f, "attribute", None) == ("seconds",):
                if isinstance(f, (EqualTo, GreaterThanOrEqual)):
                    self.low = max(self.low, f.value)
                if isinstance(f, GreaterThan):
                    self.low = max(self.low, f.value + 1)
                if isinstance(f, LessThan):
                    self.high = min(self.high, f.value)
                if isinstance(f, (EqualTo, LessThanOrEqual)):
                    self.high = min(self.high, f.value + 1)
            yield f

    def partitions(self) -> list[InputPartition]:
        """A partition for each day that overlaps the range; the folders are listed, no file is opened."""
        found: list[InputPartition] = []
        for entry in sorted(os.listdir(self.folder)):
            if not entry.startswith("day=") or not entry[4:].lstrip("-").isdigit():
                continue
            day = int(entry[4:])
            if day * DAY < self.high and (day + 1) * DAY > self.low:
                where = os.path.join(self.folder, entry)
                files = sorted(os.path.join(where, f) for f in os.listdir(where) if f.endswith(".parquet"))
                found.append(Day(files, self.low, self.high))
        return found or [Day([], 0, 0)]

    def read(self, partition: Day) -> Iterator[pa.RecordBatch]:
        for file in partition.files:
            if self.trace:  # a mark for each file opened
                with open(os.path.join(_local(self.trace), uuid.uuid4().hex), "w") as mark:
                    mark.write(file)
            for batch in pq.ParquetFile(file).iter_batches(columns=self.names):
                seconds = batch.column(self.names.index("seconds"))
                inside = pc.and_(pc.greater_equal(seconds, partition.low), pc.less(seconds, partition.high))
                kept = batch.filter(pc.fill_null(inside, False))
                if kept.num_rows:
                    yield kept
