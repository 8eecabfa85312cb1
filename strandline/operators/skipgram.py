"""Skip-gram vectors with negative sampling, trained in strata.

The words are dealt into P blocks, and so are the pairs: a pair of a word of block i and a context of block j belongs to stratum
(j - i) mod P. The P cells of one stratum share no row of either matrix, so they train side by side, each in a task that holds one
block of either matrix and streams its pairs through them; negatives are drawn within the cell's block of contexts. After P strata
every pair was seen once. Steps are scaled by the squares of the gradients so far, which are kept with each vector.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.sources import files

#: Words of a block, which bounds what a task holds of either matrix.
BLOCK_WORDS = 1 << 16
#: Pairs whose gradients are added up before a step; power of the counts by which negatives are drawn.
_STEP, POWER = 32, 0.75

_ROW = "side int, word string, block int, n long, vec array<double>, squares double, loss double"


def counted_pairs(pairs: DataFrame, center: str = "center", context: str = "context") -> DataFrame:
    """(center, context, n): equal pairs are trained together, with their number as weight. Nulls go."""
    kept = pairs.select(F.col(center).cast("string").alias("center"), F.col(context).cast("string").alias("context")).dropna()
    return kept.groupBy("center", "context").agg(F.count(F.lit(1)).alias("n"))


def _start(pairs: DataFrame, blocks: int, dims: int, seed: int) -> DataFrame:
    """The rows of both matrices: side 0 with small numbers drawn by hash, side 1 zeros."""
    sides = []
    for side, column in enumerate(("center", "context")):
        words = pairs.groupBy(F.col(column).alias("word")).agg(F.sum("n").alias("n"))
        draw = F.transform(F.sequence(F.lit(1), F.lit(dims)), lambda i: (F.pmod(F.xxhash64("word", F.lit(seed), i), F.lit(1 << 20)) / (1 << 20) - 0.5) / dims)
        vec = draw if side == 0 else F.array_repeat(F.lit(0.0), dims)
        block = F.pmod(F.xxhash64("word", F.lit(seed)), F.lit(blocks)).cast("int")
        sides.append(words.select(F.lit(side).alias("side"), "word", block.alias("block"), "n", vec.alias("vec"), F.lit(0.0).alias("squares"), F.lit(None).cast("double").alias("loss")))
    return sides[0].unionByName(sides[1])


class _Side:
    """One block of a matrix."""

    def __init__(self, parts: list[pa.RecordBatch]):
        table = pa.Table.from_batches(parts)
        self.words = table["word"].to_pylist()
        self.at = {w: i for i, w in enumerate(self.words)}
        self.n = np.array(table["n"].to_pylist(), np.float64)
        self.vec = np.array(table["vec"].to_pylist(), np.float64)
        self.squares = np.array(table["squares"].to_pylist(), np.float64)
        self.odds = np.cumsum(self.n**POWER)

    def drawn(self, shape: tuple[int, int], draw: np.random.Generator) -> np.ndarray:
        """Rows at random, by their counts to the power POWER."""
        return np.minimum(np.searchsorted(self.odds, draw.random(shape) * self.odds[-1], side="right"), len(self.odds) - 1)

    def step(self, at: np.ndarray, grads: np.ndarray, rate: float) -> None:
        """Moves the rows `at`, which may repeat, against their gradients."""
        rows, which = np.unique(at, return_inverse=True)
        total = np.zeros((len(rows), grads.shape[1]))
        np.add.at(total, which, grads)
        self.squares[rows] += (total * total).mean(axis=1)
        self.vec[rows] -= rate * total / np.sqrt(self.squares[rows] + 1e-12)[:, None]


def _trained(ins: _Side, outs: _Side, centers: np.ndarray, contexts: np.ndarray, n: np.ndarray, negatives: int, rate: float, draw: np.random.Generator) -> float:
    """One step over some pairs; the sum of their losses."""
    at = np.concatenate([contexts[:, None], outs.drawn((len(centers), negatives), draw)], axis=1)
    x, y = ins.vec[centers], outs.vec[at]
    margin = np.clip(np.einsum("bd,bkd->bk", x, y), -30, 30)
    wanted = np.zeros(margin.shape)
    wanted[:, 0] = 1
    loss = (np.logaddexp(0, np.where(wanted > 0, -margin, margin)).sum(axis=1) * n).sum()
    error = (1 / (1 + np.exp(-margin)) - wanted) * n[:, None]
    g_in, g_out = np.einsum("bk,bkd->bd", error, y), (error[:, :, None] * x[:, None, :]).reshape(-1, x.shape[1])
    ins.step(centers, g_in, rate)
    outs.step(at.ravel(), g_out, rate)
    return float(loss)


def _stratum(state: DataFrame, pairs: DataFrame, blocks: int, shift: int, turn: int, negatives: int, rate: float, seed: int) -> DataFrame:
    """The state after one stratum, with a row of side 2 and the loss for each cell."""
    cell = F.when(F.col("side") == 0, F.col("block")).otherwise(F.pmod(F.col("block") - shift, F.lit(blocks)))
    rows = state.filter("side < 2").withColumns({"cell": cell.cast("int"), "context": F.lit(None).cast("string"), "turn": F.xxhash64("word")})
    own = pairs.filter(F.pmod(F.col("j") - F.col("i"), F.lit(blocks)) == shift)
    own = own.select(
        F.lit(2).alias("side"), F.col("center").alias("word"), F.col("i").alias("block"), "n", F.lit(None).cast("array<double>").alias("vec"), F.lit(0.0).alias("squares"),
        F.lit(None).cast("double").alias("loss"), F.col("i").alias("cell"), "context", F.xxhash64("center", "context", F.lit(turn)).alias("turn"),
    )
    both = rows.unionByName(own).repartition(blocks, "cell").sortWithinPartitions("cell", "side", "turn", "word", "context")

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[pa.RecordBatch]] = {0: [], 1: []}
        now, ins, outs, loss, weight, draw = None, None, None, 0.0, 0, None

        def done() -> Iterator[pa.RecordBatch]:
            sides = (ins, outs) if ins is not None else tuple(_Side(held[s]) if held[s] else None for s in (0, 1))
            for side, own in enumerate(sides):
                if own is not None:
                    block = now if side == 0 else (now + shift) % blocks
                    k = len(own.words)
                    columns = [[side] * k, own.words, [block] * k, own.n.astype(int).tolist(), own.vec.tolist(), own.squares.tolist(), [None] * k]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=names)
            yield pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip([2, None, now, weight, None, 0.0, loss], kinds)], names=names)

        for b in it:
            cells, sides = np.asarray(b.column("cell")), np.asarray(b.column("side"))
            cuts = np.flatnonzero((np.diff(cells) != 0) | (np.diff(sides) != 0)) + 1
            for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), len(cells)]):
                if lo == hi:
                    continue
                if cells[lo] != now:
                    if now is not None:
                        yield from done()
                    now, held, ins, outs, loss, weight = int(cells[lo]), {0: [], 1: []}, None, None, 0.0, 0
                    draw = np.random.default_rng([seed, turn, now])
                part = b.slice(lo, hi - lo)
                if sides[lo] < 2:
                    held[int(sides[lo])].append(part.select(["word", "n", "vec", "squares"]))
                    continue
                if ins is None:
                    ins, outs = _Side(held[0]), _Side(held[1])
                for at in range(0, len(part), _STEP):
                    some = part.slice(at, _STEP)
                    centers = np.array([ins.at[w] for w in some.column("word").to_pylist()])
                    contexts = np.array([outs.at[w] for w in some.column("context").to_pylist()])
                    n = np.asarray(some.column("n")).astype(np.float64)
                    loss += _trained(ins, outs, centers, contexts, n, negatives, rate, draw)
                    weight += int(n.sum())
        if now is not None:
            yield from done()

    kinds = [pa.int32(), pa.string(), pa.int32(), pa.int64(), pa.list_(pa.float64()), pa.float64(), pa.float64()]
    names = [f.split()[0] for f in _ROW.split(", ")]
    return both.mapInArrow(batches, _ROW)


def train(pairs: DataFrame, dims: int = 128, rounds: int = 5, negatives: int = 5, rate: float = 0.2, blocks: int | None = None, seed: int = 42) -> tuple[DataFrame, list[float]]:
    """((word, vec), losses): a vector for each center of `counted_pairs`, and the mean loss of a pair in each round.

    Each stratum's state is written to the shared folder before the next begins, so a lost executor costs a stratum at most; the one before is
    removed then.
    The result is the same for the same pairs and blocks. Without pairs there are no vectors.
    """
    spark = pairs.sparkSession
    folder = files.scratch(spark)
    if blocks is None:
        blocks = max(1, -(-pairs.select("center").distinct().count() // BLOCK_WORDS))
    keyed = pairs.withColumns({x: F.pmod(F.xxhash64(c, F.lit(seed)), F.lit(blocks)).cast("int") for x, c in (("i", "center"), ("j", "context"))})
    keyed.write.parquet(f"{folder}/pairs")
    keyed = spark.read.parquet(f"{folder}/pairs")
    _start(keyed, blocks, dims, seed).write.parquet(f"{folder}/start")
    before, losses = f"{folder}/start", []
    state = spark.read.parquet(before)
    for r in range(rounds):
        loss = weight = 0.0
        for shift in range(blocks):
            path = f"{folder}/{r}-{shift}"
            _stratum(state, keyed, blocks, shift, r * blocks + shift, negatives, rate, seed).write.parquet(path)
            state = spark.read.schema(_ROW).parquet(path)
            files.remove(spark, before)
            before = path
            one = state.filter("side = 2").agg(F.sum("loss"), F.sum("n")).first()
            loss, weight = loss + (one[0] or 0.0), weight + (one[1] or 0)
        losses.append(loss / weight if weight else 0.0)
    files.remove(spark, f"{folder}/pairs")
    return state.filter("side = 0").select("word", "vec"), losses
