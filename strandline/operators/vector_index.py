"""An inverted-file index over vectors: cells of near vectors as folders of Parquet, residuals as product-quantised codes.

A search reads the folders of the cells nearest to its queries only, scores their rows by the codes and the best of these again by
the vectors themselves.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.functions import vectors
from strandline.operators import codebooks
from strandline.operators.statistics import top_per

# The row counts at which the kind of index changes, and what asks for another of the same size.
FLAT_BELOW, IVF_BELOW, GRAPH_BELOW = 100_000, 10_000_000, 100_000_000
LOW_LATENCY_MS, HIGH_RECALL = 10, 0.98

#: Rows for each code that the codebooks are fitted on at most, chosen by hash.
FIT_ROWS = 256
#: Codes of a subspace; rows of a cell, and queries, that meet in one task.
CODES, BLOCK = 256, 8192


def recommended(rows: int, latency_ms: float = 50.0, recall: float = 0.95) -> str:
    """The kind of index for a number of rows."""
    if rows < FLAT_BELOW:
        return "FLAT"
    if rows < IVF_BELOW:
        return "IVF_SQ8" if latency_ms < LOW_LATENCY_MS else "IVF_FLAT"
    if rows < GRAPH_BELOW:
        return "HNSW_HIGH_RECALL" if recall > HIGH_RECALL else "HNSW"
    return "DISKANN"


def _units(df: DataFrame, id_: str, vector: str) -> DataFrame:
    """(id, unit) of rows with a vector that isn't zero."""
    return df.select(F.col(id_).alias("id"), vectors.normalised(F.col(vector)).alias("unit")).filter(F.exists("unit", lambda x: x != 0))


def _sample(rows: DataFrame, total: int, most: int) -> DataFrame:
    """About `most` rows by hash of the id, or all if there are fewer."""
    return rows if total <= most else rows.filter(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < F.lit(max(1, most * (1 << 20) // total)))


def build(df: DataFrame, path: str, id_: str = "vec_id", vector: str = "embedding", cells: int | None = None, subspaces: int = 8, rounds: int = 6) -> None:
    """Writes the index of all rows under `path`: lists/cell=… (id, unit, codes), cells (cell, n, centre) and books (part, code, centre).

    By default there are as many cells as the square root of the rows. Centres and codes are fitted on FIT_ROWS rows for each at most; every row
    is in a list. Rows without a vector, and zero vectors, are left out. A cell with many rows is written by several tasks.
    """
    rows = _units(df, id_, vector)
    total = rows.count()
    if not total:
        raise ValueError("there are no vectors to index")
    cells = cells or max(1, round(total**0.5))
    centres = codebooks.fit(_sample(rows, total, cells * FIT_ROWS), cells, "unit", rounds=rounds)[0]

    def left_over(x: np.ndarray) -> np.ndarray:
        return x - centres[codebooks.nearest(x, centres)[0]]

    # no more codes than half of the vectors fitted, or a small table would just be stored again
    k = int(min(CODES, max(1, total // 2)))
    if centres.shape[1] % subspaces:
        raise ValueError(f"{centres.shape[1]} dimensions can't be cut into {subspaces} equal subspaces")
    books = codebooks.fit(_sample(rows, total, k * FIT_ROWS), k, "unit", parts=subspaces, rounds=rounds, prepare=left_over)
    kind = rows.schema["id"].dataType.simpleString()

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            x = codebooks.matrix(b.column(1))
            cell, _ = codebooks.nearest(x, centres)
            rest = x - centres[cell]
            width = rest.shape[1] // subspaces
            codes = np.stack([codebooks.nearest(rest[:, p * width : (p + 1) * width], books[p])[0] for p in range(subspaces)], axis=1).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(cell.astype(np.int32))], names=["id", "unit", "codes", "cell"])

    placed = rows.mapInArrow(batches, f"id {kind}, unit array<double>, codes binary, cell int")
    placed.hint("rebalance", "cell").write.mode("overwrite").partitionBy("cell").parquet(f"{path}/lists")
    spark = df.sparkSession
    counted = spark.read.parquet(f"{path}/lists").groupBy("cell").agg(F.count(F.lit(1)).alias("n"))
    middle = spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centres)], "cell int, centre array<double>")
    middle.join(counted, "cell", "left").fillna(0, ["n"]).write.mode("overwrite").parquet(f"{path}/cells")
    listed = [(p, i, c.tolist()) for p in range(subspaces) for i, c in enumerate(books[p])]
    spark.createDataFrame(listed, "part int, code int, centre array<double>").write.mode("overwrite").parquet(f"{path}/books")


def _probes(queries: DataFrame, centres: np.ndarray, nprobe: int) -> DataFrame:
    """(query, unit, cell, near): each query with its nearest cells, the nearest being 0."""
    kind = queries.schema["id"].dataType.simpleString()

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            x = codebooks.matrix(b.column(1))
            size = max(1, BLOCK // len(centres))  # a batch carries each query's vector once for each of its cells
            for i in range(0, len(x), size):
                near = np.argsort(codebooks.squared_distances(x[i : i + size], centres), axis=1, kind="stable")[:, :nprobe]
                own = pa.array(np.repeat(np.arange(i, i + len(near)), near.shape[1]))
                yield pa.RecordBatch.from_arrays([b.column(0).take(own), b.column(1).take(own), pa.array(near.ravel().astype(np.int32)), pa.array(np.tile(np.arange(near.shape[1], dtype=np.int32), len(near)))], names=["query", "unit", "cell", "near"])

    return queries.mapInArrow(batches, f"query {kind}, unit array<double>, cell int, near int")


def probes_for(spark: SparkSession, path: str, sample: DataFrame, recall: float = 0.95, k: int = 10, id_: str = "vec_id", vector: str = "embedding") -> int:
    """The least `nprobe` with which the k nearest of the sample's vectors are found with at least this recall.

    The sample's exact neighbours are looked up in all cells; what counts is how near to the query their own cells are. How many
    cells that takes depends on the vectors: few where they lie in clusters, most of them where they don't.
    """
    cells = spark.read.parquet(f"{path}/cells").orderBy("cell").collect()
    centres = np.array([r.centre for r in cells])
    found = search(spark, path, sample, k, id_=id_, vector=vector)
    lists = spark.read.parquet(f"{path}/lists").select(F.col("id").alias(id_), "cell")
    at = found.select("query", id_).join(lists, id_)
    ranks = at.join(_probes(_units(sample, id_, vector), centres, len(cells)).select("query", "cell", "near"), ["query", "cell"])
    counts = {r.near: r["count"] for r in ranks.groupBy("near").count().collect()}  # no more than there are cells
    needed, total = 0, sum(counts.values())
    for near in sorted(counts):
        needed += counts[near]
        if needed >= recall * total:
            return near + 1
    return 1


def search(spark: SparkSession, path: str, queries: DataFrame, k: int, nprobe: int | None = None, refine: int | None = None, id_: str = "vec_id", vector: str = "embedding", digits: int = 6) -> DataFrame:
    """(query, id, similarity, rank): for each query the k most similar other rows in its `nprobe` nearest cells (all by default).

    With `refine`, the rows of a cell are scored by their codes first, and `refine` times k of them by their vectors; without, all are, so with
    all cells the result is exact. Similarity is the cosine rounded to `digits`; ties go to the smaller id. Only the folders of
    probed cells are read. Cells of many rows, and many queries, are cut into blocks that meet in separate tasks.
    """
    cells = spark.read.parquet(f"{path}/cells").orderBy("cell").collect()  # centres, the square root of the rows
    centres = np.array([r.centre for r in cells])
    books = None
    if refine:
        listed = spark.read.parquet(f"{path}/books").orderBy("part", "code").collect()  # at most CODES a subspace
        parts = listed[-1].part + 1
        books = np.array([r.centre for r in listed]).reshape(parts, -1, len(listed[0].centre))
    asked = _units(queries, id_, vector)
    probes = _probes(asked, centres, min(nprobe or len(cells), len(cells)))
    blocks = spark.createDataFrame([(r.cell, max(1, -(-r.n // BLOCK))) for r in cells], "cell int, blocks int")
    turns = max(1, -(-asked.count() // BLOCK))
    wanted = [r.cell for r in probes.select("cell").distinct().collect()]  # no more than there are cells
    lists = spark.read.parquet(f"{path}/lists").filter(F.col("cell").isin(wanted))
    left = probes.join(F.broadcast(blocks), "cell").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("turn", F.pmod(F.xxhash64("query"), F.lit(turns)).cast("int"))
    right = lists.join(F.broadcast(blocks), "cell").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")).withColumn("turn", F.explode(F.sequence(F.lit(0), F.lit(turns - 1))))
    keys = ["cell", "block", "turn"]
    kinds = asked.schema["id"].dataType.simpleString(), lists.schema["id"].dataType.simpleString()

    def met(key: tuple, a: pa.Table, c: pa.Table) -> pa.Table:
        out_q, out_i, out_s = [], [], []
        if a.num_rows and c.num_rows:
            x, y = codebooks.matrix(a["unit"].combine_chunks()), codebooks.matrix(c["unit"].combine_chunks())
            asked_ids, ids = (np.array(t.to_pylist()) for t in (a["query"], c["id"]))
            coded = np.frombuffer(b"".join(c["codes"].to_pylist()), np.uint8).reshape(len(ids), -1) if refine else None
            for n, point in enumerate(x):
                at = np.flatnonzero(ids != asked_ids[n])
                if coded is not None and len(at) > refine * k:
                    rest = (point - centres[key[0].as_py()]).reshape(len(books), 1, -1)
                    table = ((books - rest) ** 2).sum(axis=2)
                    rough = table[np.arange(len(books)), coded[at]].sum(axis=1)
                    at = at[np.argpartition(rough, refine * k)[: refine * k]]
                score = np.round(y[at] @ point, digits)
                best = np.lexsort((ids[at], -score))[:k]
                out_q.append(np.repeat(asked_ids[n], len(best)))
                out_i.append(ids[at[best]])
                out_s.append(score[best])
        if not out_q:
            return pa.table({"query": a["query"].slice(0, 0), id_: c["id"].slice(0, 0), "similarity": pa.array([], pa.float64())})
        return pa.table({"query": np.concatenate(out_q), id_: np.concatenate(out_i), "similarity": np.concatenate(out_s)})

    found = left.select(*keys, "query", "unit").groupBy(*keys).cogroup(right.select(*keys, "id", "unit", "codes").groupBy(*keys)).applyInArrow(met, f"query {kinds[0]}, {id_} {kinds[1]}, similarity double")
    return top_per(found, "query", [F.desc("similarity"), F.col(id_)], k)
