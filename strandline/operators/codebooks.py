"""Codebooks fitted to vectors: residual levels, or subspaces side by side.

Rounds of Lloyd's rule as Spark jobs: each task adds up its rows' vectors by nearest code, the sums are added up by code, and only they
reach the driver, k rows a codebook. Codes that nothing is nearest to are set anew on the vectors that are fitted worst.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Distances of rows to codes that are held at once, and badly fitted vectors that a task names for each codebook.
_HELD, _WORST = 1 << 20, 32

Prepare = Callable[[np.ndarray], np.ndarray]


def matrix(column: pa.Array) -> np.ndarray:
    """Vectors of one length as rows of doubles."""
    return np.asarray(column.flatten()).astype(np.float64).reshape(len(column), -1)


def squared_distances(x: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Squared distances of all rows to all codes."""
    return np.maximum((x * x).sum(axis=1)[:, None] - 2 * x @ codes.T + (codes * codes).sum(axis=1), 0)


def nearest(x: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest code of each row, the first of equals, and its squared distance."""
    at, far = np.zeros(len(x), np.int64), np.zeros(len(x))
    size = max(1, _HELD // len(codes))
    for i in range(0, len(x), size):
        d = squared_distances(x[i : i + size], codes)
        at[i : i + size] = d.argmin(axis=1)
        far[i : i + size] = d.min(axis=1)
    return at, far


def _sums(df: DataFrame, vector: str, codes: np.ndarray, prepare: Prepare | None) -> DataFrame:
    """(part, code, n, total, error) for each task, part and code, with code -1 for some of the worst fitted vectors."""
    parts, k, dims = codes.shape

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total, error = np.zeros((parts, k), np.int64), np.zeros((parts, k, dims)), np.zeros((parts, k))
        worst: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0), np.zeros((0, dims)))] * parts
        for b in it:
            x = matrix(b.column(0))
            x = x if prepare is None else prepare(x)
            for p in range(parts):
                own = x[:, p * dims : (p + 1) * dims]
                at, far = nearest(own, codes[p])
                n[p] += np.bincount(at, minlength=k)
                error[p] += np.bincount(at, far, minlength=k)
                total[p] += np.stack([np.bincount(at, column, minlength=k) for column in own.T], axis=1)
                # equal vectors are equally far, so the farthest different ones are among the first of each distance
                both, vectors = np.concatenate([worst[p][0], far]), np.concatenate([worst[p][1], own])
                _, first = np.unique(-both, return_index=True)
                worst[p] = both[first[:_WORST]], vectors[first[:_WORST]]
        for p in range(parts):
            far, vectors = worst[p]
            columns = [[p] * (k + len(far)), [*range(k), *[-1] * len(far)], [*n[p].tolist(), *[1] * len(far)], [*total[p].tolist(), *vectors.tolist()], [*error[p].tolist(), *far.tolist()]]
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.float64()), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=["part", "code", "n", "total", "error"])

    return df.select(vector).mapInArrow(batches, "part int, code int, n long, total array<double>, error double")


def fit(df: DataFrame, k: int, vector: str = "embedding", parts: int = 1, rounds: int = 8, prepare: Prepare | None = None) -> np.ndarray:
    """Codes (parts, k, dims): k codes for each of `parts` equal stretches of the vectors, all fitted in the same jobs.

    `prepare` changes blocks of vectors first (taking off what other codes stand for). Rounds go on, up to twice as many, while a code
    has no vectors; with fewer different vectors than codes some stay without. All vectors must have one length, and there must be one.
    """
    rows = df.select(vector).filter(F.col(vector).isNotNull())
    start = rows.orderBy(F.xxhash64(vector)).limit(k).collect()  # k rows
    if not start:
        raise ValueError("there are no vectors to fit codes to")
    x = np.array([r[0] for r in start], np.float64)
    x = x if prepare is None else prepare(x)
    x = np.concatenate([x, np.repeat(x[:1], k - len(x), axis=0)])
    codes = x.reshape(k, parts, -1).transpose(1, 0, 2).copy()
    for turn in range(2 * rounds):
        sums = _sums(rows, vector, codes, prepare).persist()
        added = sums.filter("code >= 0").groupBy("part", "code").agg(F.sum("n").alias("n"), Summarizer.sum(array_to_vector("total")).alias("total"))
        dead = [0] * parts
        for r in added.select("part", "code", "n", vector_to_array("total").alias("total")).collect():  # k rows a part
            if r.n:
                codes[r.part, r.code] = np.array(r.total) / r.n
            else:
                codes[r.part, r.code] = np.inf
                dead[r.part] += 1
        for p in range(parts):
            if dead[p]:
                far = sums.filter((F.col("code") == -1) & (F.col("part") == p) & (F.col("error") > 0)).groupBy("total").agg(F.max("error").alias("error"))
                fresh = [r.total for r in far.orderBy(F.desc("error"), "total").limit(dead[p]).collect()]
                empty = np.flatnonzero(np.isinf(codes[p, :, 0]))
                if fresh:
                    codes[p, empty[: len(fresh)]] = fresh
                codes[p, empty[len(fresh) :]] = codes[p, np.flatnonzero(np.isfinite(codes[p, :, 0]))[0]]
        sums.unpersist()
        if turn >= rounds - 1 and not any(dead):
            break
    return codes


def fit_levels(df: DataFrame, k: int, levels: int, vector: str = "embedding", rounds: int = 8) -> list[np.ndarray]:
    """Codebooks (k, dims) of several levels, each fitted to what the ones before leave over."""
    books: list[np.ndarray] = []
    for _ in range(levels):
        before = list(books)
        books.append(fit(df, k, vector, rounds=rounds, prepare=lambda x, before=before: residuals(x, before)[1])[0])
    return books


def residuals(x: np.ndarray, books: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(codes of all levels, what is left over)."""
    codes = np.zeros((len(x), len(books)), np.int64)
    for level, book in enumerate(books):
        codes[:, level], _ = nearest(x, book)
        x = x - book[codes[:, level]]
    return codes, x


def encode(df: DataFrame, books: list[np.ndarray], id_: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(id, codes, errors): the code of each level and the squared error left after it. Rows without a vector have none."""
    kind = df.schema[id_].dataType.simpleString()

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            x = matrix(b.column(1))
            codes, errors = [], []
            for book in books:
                at, far = nearest(x, book)
                x = x - book[at]
                codes.append(at)
                errors.append(far)
            columns = pa.array(np.stack(codes, axis=1).tolist(), pa.list_(pa.int32())), pa.array(np.stack(errors, axis=1).tolist(), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([b.column(0), *columns], names=[id_, "codes", "errors"])

    return df.select(id_, vector).filter(F.col(vector).isNotNull()).mapInArrow(batches, f"{id_} {kind}, codes array<int>, errors array<double>")


def level_report(df: DataFrame, books: list[np.ndarray], vector: str = "embedding") -> DataFrame:
    """(level, mse, utilisation): mean square error after each level and the share of its codes in use."""
    coded = encode(df.withColumn("_one", F.lit(1)), books, "_one", vector)
    each = coded.select(F.posexplode(F.arrays_zip("codes", "errors")).alias("level", "z")).select("level", "z.codes", "z.errors")
    used = each.groupBy("level", "codes").agg(F.sum("errors").alias("e"), F.count(F.lit(1)).alias("n"))
    dims = books[0].shape[1]
    return used.groupBy((F.col("level") + 1).alias("level")).agg((F.sum("e") / F.sum("n") / dims).alias("mse"), (F.count(F.lit(1)) / books[0].shape[0]).alias("utilisation"))
