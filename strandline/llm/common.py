"""Small helpers that the training-data operators share."""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

#: Arrow batches handed back to Spark hold about this many bytes at most.
OUT_BYTES = 4 << 20


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; a local one is set only where none is."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoints-"))
    return sc.getCheckpointDir()


def cut_lineage(df: DataFrame) -> DataFrame:
    """A reliable checkpoint in the shared folder: it outlives any executor."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def own_names(df: DataFrame, *names: str) -> list[str]:
    """Column names for an operator's own use that `df` doesn't have, whatever their case."""
    taken = {c.lower() for c in df.columns}
    mark = "_"
    while any(f"{mark}{n}".lower() in taken for n in names):
        mark += "_"
    return [f"{mark}{n}" for n in names]


def rows_by_python(
    df: DataFrame, columns: list[str], schema: str, rows: Callable[..., Iterator[tuple]], weigh: int | None = None
) -> DataFrame:
    """mapInArrow over `columns`; `rows(*values)` yields output tuples for one input row.

    Output batches are cut by the bytes of column `weigh` (or by row count), so a run of
    long documents never builds one huge batch.
    """
    parsed = _parse_datatype_string(schema)
    assert isinstance(parsed, StructType)
    arrow = to_arrow_schema(parsed)

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        held = 0

        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array(list(c), type=f.type) for c, f in zip(zip(*out), arrow)], schema=arrow
            )

        for batch in it:
            for values in zip(*(batch.column(c) for c in columns)):
                for row in rows(*(v.as_py() for v in values)):
                    out.append(row)
                    held += 64 if weigh is None else 64 + len(row[weigh] or b"")
                    if held >= OUT_BYTES:
                        yield flush()
                        out, held = [], 0
        if out:
            yield flush()

    return df.select(*columns).mapInArrow(batches, schema)
