"""Files: readers and writers by format, partitioned facts, upserts, retention, stages that resume."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

READERS: dict[str, dict[str, str]] = {
    "parquet": {},
    "json": {},
    "jsonl": {},
    "csv": {"header": "true"},
    "tsv": {"header": "true", "sep": "\t", "nullValue": "\\N"},
}


def scratch(spark: SparkSession) -> str:
    """A new folder in the shared folder of spark.checkpoint.dir; a local one only in local mode, where none is named."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="shared-"))
    return f"{sc.getCheckpointDir()}/files-{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder that this library has written."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def _format(kind: str) -> str:
    if kind not in READERS:
        raise ValueError(f"unknown format {kind}; there are {', '.join(READERS)}")
    return {"jsonl": "json", "tsv": "csv"}.get(kind, kind)


def read(spark: SparkSession, path: str, kind: str, schema: StructType | str | None = None, rows: int | None = None, malformed: str | None = None) -> DataFrame:
    """`malformed`: 'DROPMALFORMED' passes over broken lines, 'PERMISSIVE' keeps them in _corrupt_record if the schema has it."""
    reader = spark.read.format(_format(kind)).options(**READERS[kind])
    if schema is not None:
        reader = reader.schema(schema)
    if malformed:
        reader = reader.option("mode", malformed)
    found = reader.load(path)
    return found if rows is None else found.limit(rows)


def write(df: DataFrame, path: str, kind: str, mode: str = "overwrite", by: list[str] | None = None) -> None:
    options = {k: v for k, v in READERS[kind].items() if k != "nullValue"} if kind in READERS else {}
    if kind == "tsv":
        options["nullValue"] = "\\N"
    writer = df.write.format(_format(kind)).mode(mode).options(**options)
    (writer.partitionBy(*by) if by else writer).save(path)


def write_monthly(df: DataFrame, path: str, ts: str = "ts") -> None:
    """Facts partitioned by year and month; one file or so a month."""
    parted = df.withColumns({"year": F.year(ts), "month": F.month(ts)})
    write(parted.repartition("year", "month"), path, "parquet", by=["year", "month"])


def latest(df: DataFrame, keys: list[str], version: list[Column]) -> DataFrame:
    """The newest row of each key."""
    w = Window.partitionBy(*keys).orderBy(*version)
    return df.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def upsert(existing: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """Changes win over existing rows; of several changes to a key the last by `version` does."""
    both = existing.withColumn("_new", F.lit(0)).unionByName(changes.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    return latest(both, keys, [F.desc("_new"), F.desc_nulls_last("version")]).drop("_new")


def upsert_json(existing: DataFrame, payload: DataFrame, column: str, element: str, keys: list[str]) -> DataFrame:
    """Upserts the elements of JSON arrays."""
    changes = payload.select(F.explode(F.from_json(column, f"array<{element}>")).alias("e")).select("e.*")
    return upsert(existing, changes, keys)


def increment(counters: DataFrame, deltas: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Counters after adding all deltas; new keys begin at 0."""
    return counters.select(*keys, value).unionByName(deltas.select(*keys, value)).groupBy(*keys).agg(F.sum(value).alias(value))


def retained(df: DataFrame, days: int, ts: str = "ts") -> DataFrame:
    """Rows of the last `days` days before the newest one."""
    newest = df.agg(F.max(ts).alias("_max"))
    return df.join(F.broadcast(newest)).filter(F.col(ts) > F.col("_max") - F.expr(f"INTERVAL {days} DAYS")).drop("_max")


def stage(spark: SparkSession, path: str, make: Callable[[], DataFrame]) -> DataFrame:
    """The table at `path`, made and written first if it isn't complete there yet."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def generated(spark: SparkSession, rows: int, users: int = 100, items: int = 1000, seed: int = 42) -> DataFrame:
    """Made-up behaviour rows (event_id, user_id, item_id, action, seconds), the same for the same seed."""
    def pick(n: int, salt: int) -> Column:
        return F.pmod(F.xxhash64("id", F.lit(seed), F.lit(salt)), F.lit(n))

    actions = F.array(*(F.lit(a) for a in ("view", "click", "like", "buy")))
    return spark.range(rows).select(
        F.col("id").alias("event_id"), pick(users, 1).alias("user_id"), pick(items, 2).alias("item_id"), F.get(actions, pick(4, 3).cast("int")).alias("action"), (F.lit(1704067200) + pick(86400 * 30, 4)).alias("seconds")
    )


def shuffled_files(df: DataFrame, rank: int, world: int, seed: int = 42) -> DataFrame:
    """One of `world` shares of the rows, by hash, in a seeded order within each partition."""
    key = F.xxhash64(F.lit(seed), *df.columns)
    return df.filter(F.pmod(key, F.lit(world)) == rank).sortWithinPartitions(F.xxhash64(F.lit(seed + 1), *df.columns))


def load_counts(df: DataFrame, ok: Column) -> DataFrame:
    """One row (loaded, failed)."""
    good = F.coalesce(ok, F.lit(False))
    return df.agg(F.count_if(good).alias("loaded"), F.count_if(~good).alias("failed"))


def read_jdbc(spark: SparkSession, url: str, dbtable: str, ts: str | None = None, start: str | None = None, end: str | None = None, **options: str) -> DataFrame:
    """A table of a database, with the time bounds pushed down to it. Needs the database's driver on the class path."""
    found = spark.read.format("jdbc").options(url=url, dbtable=dbtable, **options).load()
    if ts and start:
        found = found.filter(F.col(ts) >= F.lit(start))
    if ts and end:
        found = found.filter(F.col(ts) < F.lit(end))
    return found
