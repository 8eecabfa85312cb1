"""Materialised views that follow inserts and deletes without being made anew.

A view is a table of sums by key, partitioned by one of its columns. A batch of changes is summed up by key, added to the rows of the
partitions that it touches, and only their files are written again. Each partition holds the number of the last batch in it, so a batch that
is applied again after a failure changes only what it hadn't reached.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.sources import files

#: +1 for an inserted row, -1 for a deleted one; a change of a row is both.
OP = "op"


class SumView:
    """count(*) as `n` and sums by `keys`, the first of which is the partition. Minima can't follow deletes and are left out.

    Keys may be null (the partition may not). Sums of decimals and integers are exact; those of doubles differ from a
    recompute by rounding only.
    """

    def __init__(self, spark: SparkSession, path: str, keys: list[str], sums: dict[str, str]):
        self.spark, self.path, self.keys, self.sums = spark, path, keys, sums
        self.part = keys[0]

    def _exists(self) -> bool:
        where = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return where.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(where)

    def _stored(self, delta: DataFrame | None = None) -> DataFrame:
        if self._exists():
            return self.spark.read.parquet(self.path)
        return delta.limit(0).withColumn("version", F.lit(0).cast("long"))

    def read(self) -> DataFrame:
        """The view: keys, n and sums, without groups that have lost all rows."""
        return self.spark.read.parquet(self.path).filter("n <> 0").select(*self.keys, "n", *self.sums)

    def versions(self) -> DataFrame:
        """(partition, version): the last batch in each partition."""
        return self.spark.read.parquet(self.path).groupBy(self.part).agg(F.max("version").alias("version"))

    def apply(self, changes: DataFrame, version: int) -> list:
        """Adds one batch of changes (columns of the base table and `op`); the partitions that were written.

        Batches are numbered upwards from 1. Only the touched partitions are read, and only those whose version is lower are written.
        """
        op = F.col(OP)
        added = [F.sum(op).cast("long").alias("n"), *(F.sum(op * F.expr(value)).alias(name) for name, value in self.sums.items())]
        delta = changes.groupBy(*self.keys).agg(*added).persist()
        try:
            touched = [r[0] for r in delta.select(self.part).distinct().collect()]  # partitions of one batch
            stored = self._stored(delta).filter(F.col(self.part).isin(touched))
            ahead = [r[0] for r in stored.filter(F.col("version") >= version).select(self.part).distinct().collect()]
            written = [t for t in touched if t not in ahead]
            if not written:
                return []
            rows = stored.drop("version").unionByName(delta).filter(F.col(self.part).isin(written))
            merged = rows.groupBy(*self.keys).agg(F.sum("n").alias("n"), *(F.sum(name).alias(name) for name in self.sums))
            # a partition that has lost everything keeps one row with its version
            left = merged.filter("n <> 0").unionByName(self._emptied(merged)).withColumn("version", F.lit(version).cast("long"))
            staged = files.scratch(self.spark)
            left.write.parquet(staged)
            ready = self.spark.read.parquet(staged).repartition(self.part)
            ready.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(self.part).parquet(self.path)
            files.remove(self.spark, staged)
            return sorted(written)
        finally:
            delta.unpersist()

    def _emptied(self, merged: DataFrame) -> DataFrame:
        whole = merged.groupBy(self.part).agg(F.count_if(F.col("n") != 0).alias("_left")).filter("_left = 0").select(self.part)
        kinds = {f.name: f.dataType for f in merged.schema}

        def other(name: str) -> Column:
            return F.col(name) if name == self.part else F.lit(0).cast(kinds[name]).alias(name) if name == "n" or name in self.sums else F.lit(None).cast(kinds[name]).alias(name)

        return whole.select(*(other(c) for c in merged.columns))
