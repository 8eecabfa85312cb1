"""Nearest neighbours by robust-pruned directed graphs, one for each shard of the vectors.

The index: different vectors are dealt into shards of a bounded size by their digests, and each
shard's graph is built in one task. Greedy searches from an entry point propose neighbours for a batch of new
vectors; relaxed pruning keeps those that aren't much nearer to a neighbour kept before, so that edges point in different
directions; edges are made both ways. The search: every query walks each shard with a beam,
and the shards' findings are ranked together.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string
from pyspark.sql.window import Window

from strandline.llm.common import cut_lineage

#: Vectors of a shard on average, which bounds what a task holds; edges of a vector; how much longer a way round may be.
SHARD, EDGES, RELAX = 4096, 32, 1.2
#: Places of the beam when a graph is built and when it is searched.
BEAM, WIDE_BEAM = 64, 128
#: Vectors added or searched together, and places of the beam that are walked on from together.
_BATCH, _STEP = 256, 4
#: Parts into which the ids of one vector are first dealt when only the smallest are wanted.
_SALT = 16


# ---- in a task


def _squared(vectors: np.ndarray, points: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Squared distances of each point to the vectors at its row of places."""
    gaps = vectors[at] - points[:, None, :]
    return np.einsum("bcd,bcd->bc", gaps, gaps)


def walk(vectors: np.ndarray, edges: np.ndarray, points: np.ndarray, beam: int = BEAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(places, squared distances, walked) for each point: the beam's findings, nearest first, and all places walked on from.

    The walk begins at vector 0 and ends when every place of the beam has been walked on from. Rows are filled up with -1.
    """
    n, many = len(vectors), len(points)
    seen = np.zeros((many, n), bool)
    at, far = np.full((many, beam), -1), np.full((many, beam), np.inf)
    open_ = np.zeros((many, beam), bool)
    at[:, 0], far[:, 0], open_[:, 0], seen[:, 0] = 0, _squared(vectors, points, np.zeros((many, 1), int))[:, 0], True, True
    walked = []
    while True:
        rows = np.flatnonzero(open_.any(axis=1))
        if not len(rows):
            break
        # the beam is in order, so the first open places are the nearest
        nth = np.cumsum(open_[rows], axis=1)
        chosen = open_[rows] & (nth <= _STEP)
        open_[rows] &= ~chosen
        order = np.argsort(~chosen, axis=1, kind="stable")[:, :_STEP]
        nodes = np.where(np.take_along_axis(chosen, order, 1), np.take_along_axis(at[rows], order, 1), -1)
        step = np.full((many, _STEP), -1)
        step[rows] = nodes
        walked.append(step)
        near = np.where(nodes[:, :, None] >= 0, edges[nodes], -1).reshape(len(rows), -1)
        near.sort(axis=1)
        new = near >= 0
        new[:, 1:] &= near[:, 1:] != near[:, :-1]
        new &= ~seen[rows[:, None], near]
        seen[np.broadcast_to(rows[:, None], near.shape)[new], near[new]] = True
        gaps = np.full(near.shape, np.inf)
        r, c = np.nonzero(new)
        diff = vectors[near[r, c]] - points[rows[r]]
        gaps[r, c] = np.einsum("bd,bd->b", diff, diff)
        all_far = np.concatenate([far[rows], gaps], axis=1)
        best = np.argsort(all_far, axis=1, kind="stable")[:, :beam]
        far[rows] = np.take_along_axis(all_far, best, 1)
        at[rows] = np.take_along_axis(np.concatenate([at[rows], np.where(new, near, -1)], axis=1), best, 1)
        open_[rows] = np.take_along_axis(np.concatenate([open_[rows], new], axis=1), best, 1)
    return at, far, np.concatenate(walked, axis=1) if walked else np.zeros((many, 0), int)


def pruned(vectors: np.ndarray, own: np.ndarray, near: np.ndarray, edges: int = EDGES, relax: float = RELAX) -> np.ndarray:
    """Robust pruning: for each vector of `own` up to `edges` of the places `near` (-1: none).

    The nearest is kept and takes away all to which it is `relax` times nearer than the vector itself; then the next.
    """
    far = np.where((near >= 0) & (near != own[:, None]), _squared(vectors, vectors[own], near), np.inf)
    order = np.argsort(far, axis=1, kind="stable")
    near, far = np.take_along_axis(near, order, 1), np.take_along_axis(far, order, 1)
    points = vectors[near]
    norms = np.einsum("bcd,bcd->bc", points, points)
    between = norms[:, :, None] + norms[:, None, :] - 2 * points @ points.transpose(0, 2, 1)
    left = np.isfinite(far)
    left[:, 1:] &= near[:, 1:] != near[:, :-1]
    kept = np.full((len(own), edges), -1)
    rows = np.arange(len(own))
    for k in range(edges):
        some = left.any(axis=1)
        if not some.any():
            break
        first = left.argmax(axis=1)
        kept[some, k] = near[rows, first][some]
        left &= relax * relax * between[rows, first] > far
        left[rows, first] = False
    return kept


def _linked_back(vectors: np.ndarray, links: np.ndarray, new: np.ndarray) -> None:
    """Edges from the ends of the new vectors' edges back to them; where there are too many, they are pruned."""
    source, ends = np.repeat(new, links.shape[1]), links[new].ravel()
    source, ends = source[ends >= 0], ends[ends >= 0]
    order = np.argsort(ends, kind="stable")
    source, ends = source[order], ends[order]
    whom, first, count = np.unique(ends, return_index=True, return_counts=True)
    by_size = np.argsort(count, kind="stable")
    for part in np.split(by_size, range(64, len(by_size), 64)):
        most = int(count[part].max())
        added = np.full((len(part), most), -1)
        nth = np.arange(most)
        there = nth < count[part][:, None]
        added[there] = source[(first[part][:, None] + nth)[there]]
        near = np.concatenate([links[whom[part]], added], axis=1)
        near = np.where(near == whom[part][:, None], -1, near)
        near = -np.sort(-near, axis=1)
        near[:, 1:][near[:, 1:] == near[:, :-1]] = -1
        near = -np.sort(-near, axis=1)
        many = (near >= 0).sum(axis=1) > links.shape[1]
        links[whom[part][~many]] = near[~many, : links.shape[1]]
        if many.any():
            links[whom[part][many]] = pruned(vectors, whom[part][many], near[many], links.shape[1])


def _reached(links: np.ndarray) -> np.ndarray:
    """Which places can be walked to from place 0."""
    seen = np.zeros(len(links), bool)
    edge = np.zeros(1, int)
    seen[0] = True
    while len(edge):
        near = np.unique(links[edge])
        near = near[near >= 0]
        edge = near[~seen[near]]
        seen[edge] = True
    return seen


def graph(vectors: np.ndarray, edges: int = EDGES, beam: int = BEAM) -> np.ndarray:
    """Places of each vector's neighbours, filled up with -1. Every place can be reached from place 0."""
    n = len(vectors)
    links = np.full((n, min(edges, max(n - 1, 1))), -1)
    done, size = 1, 1
    while done < n:
        new = np.arange(done, min(n, done + size))
        _, _, walked = walk(vectors, links, vectors[new], beam)
        links[new] = pruned(vectors, new, walked, links.shape[1])
        _linked_back(vectors, links, new)
        done, size = done + len(new), min(2 * size, _BATCH)
    while not (seen := _reached(links)).all():
        # places that no edge leads to: one more edge from the nearest that can be reached, or from the one before with the same nearest
        lost = np.flatnonzero(~seen)[:_BATCH]
        near, _, _ = walk(vectors, links, vectors[lost], beam)
        order = np.argsort(near[:, 0], kind="stable")
        whom, lost = near[order, 0], lost[order]
        whom[1:] = np.where(whom[1:] == whom[:-1], lost[:-1], whom[1:])
        free = (links[whom] < 0).any(axis=1)
        if not free.all():
            links = np.concatenate([links, np.full((n, 1), -1)], axis=1)
        links[whom, (links[whom] < 0).argmax(axis=1)] = lost
    return links


# ---- over the whole table


def _usable(vector: Column) -> Column:
    """Not null, not empty, not zero, and without null or infinite components."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(fine & F.exists(vector, lambda x: x != 0), F.lit(False))


def vectors_of(df: DataFrame, id_: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(id, vec, h1, h2) of the rows that take part; equal vectors have equal digests h1 and h2, of 128 bits together."""
    rows = df.select(F.col(id_).alias("id"), F.col(vector).alias("vec")).filter(F.col("id").isNotNull() & _usable(F.col("vec")))
    return rows.withColumn("h1", F.xxhash64("vec")).withColumn("h2", F.xxhash64(F.lit(2), "vec"))


def _of_shards(rows: DataFrame, shards: int) -> Column:
    return F.pmod("h1", F.lit(shards)).cast("int")


def build(vectors: DataFrame, copies: int, shard: int = SHARD, edges: int = EDGES, beam: int = BEAM) -> DataFrame:
    """The index (dim, shard, node, h1, h2, vec, links, ids), a row for each different vector of `vectors_of`.

    `ids` are its smallest `copies` ids: a search for copies - 1 neighbours can return no other, so thousands of copies of one vector
    are one node and lose nothing. Shards are as many as the counted vectors need; vectors of different length are in different shards.
    """
    keys = ["h1", "h2"]
    rows = vectors.groupBy(*keys, "id").agg(F.count(F.lit(1)).alias("n")).withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(_SALT)))
    for by in ([*keys, "salt"], keys):
        rows = rows.withColumn("rn", F.row_number().over(Window.partitionBy(*by).orderBy("id"))).filter(F.col("rn") <= copies).drop("rn")
    heads = cut_lineage(rows.groupBy(*keys).agg(F.sort_array(F.collect_list("id")).alias("ids")))
    shards = max(1, -(-heads.count() // shard))
    # the vector itself comes from the row of the smallest id
    first = heads.select(*keys, F.col("ids")[0].alias("id"), "ids")
    placed = vectors.join(first, [*keys, "id"]).dropDuplicates([*keys, "id"])
    placed = placed.select(F.size("vec").alias("dim"), _of_shards(placed, shards).alias("shard"), *keys, "vec", "ids")
    kinds = {f.name: f.dataType.simpleString() for f in placed.schema}

    def linked(table: pa.Table) -> pa.Table:
        table = table.sort_by([("h1", "ascending"), ("h2", "ascending")])
        raw = _matrix(table.column("vec"))
        order = np.arange(len(raw))
        middle = int(np.argmin(((raw - raw.mean(axis=0)) ** 2).sum(axis=1)))
        order[[0, middle]] = middle, 0
        links = graph(raw[order] / _scale(raw), edges, beam)
        listed = pa.array([x[x >= 0].tolist() for x in links], pa.list_(pa.int32()))
        whole = table.take(pa.array(order)).append_column("node", pa.array(np.arange(len(order), dtype=np.int32))).append_column("links", listed)
        return whole.cast(arrow)

    schema = ", ".join(f"{n} {k}" for n, k in kinds.items()) + ", node int, links array<int>"
    arrow = to_arrow_schema(_parse_datatype_string(schema))
    # as many partitions as shards: each is much work on few bytes, which would be put together by size
    return placed.repartition(shards, "dim", "shard").groupBy("dim", "shard").applyInArrow(linked, schema)


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Vectors of one length as doubles."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = np.asarray(column.flatten()).astype(np.float64)
    return flat.reshape(len(column), -1)


def _scale(vectors: np.ndarray) -> float:
    """A power of two near the largest component; to divide by it changes no digit, and keeps squares of very large or small vectors finite."""
    return 2.0 ** np.frexp(np.abs(vectors).max())[1]


class _Shard:
    """What a task holds of one shard while its queries stream by."""

    def __init__(self) -> None:
        self.parts: list[pa.RecordBatch] = []
        self.ready = False

    def prepare(self) -> None:
        table = pa.Table.from_batches(self.parts).sort_by("node")
        self.vectors = _matrix(table.column("vec"))
        self.scale = _scale(self.vectors)
        self.vectors /= self.scale
        listed = table.column("links").combine_chunks()
        ends = np.asarray(listed.offsets)
        self.links = np.full((len(self.vectors), max(1, int(np.diff(ends).max()))), -1)
        self.links[np.arange(self.links.shape[1]) < np.diff(ends)[:, None]] = np.asarray(listed.flatten())
        self.ids = table.column("ids").to_pylist()
        self.parts, self.ready = [], True

    def nearest(self, points: np.ndarray, k: int, beam: int) -> Iterator[list[tuple[float, object]]]:
        """For each point its k nearest (distance, id) of this shard, by the original vectors."""
        points = points / self.scale
        at, _, _ = walk(self.vectors, self.links, points, max(beam, k))
        for point, found in zip(points, at):
            found = found[found >= 0]
            gaps = np.sqrt(((self.vectors[found] - point) ** 2).sum(axis=1)) * self.scale
            yield sorted((float(g), i) for f, g in zip(found, gaps) for i in self.ids[f])[:k]


def search(index: DataFrame, vectors: DataFrame, k: int, beam: int = WIDE_BEAM) -> DataFrame:
    """(h1, h2, hits): for each different vector of `vectors` its k nearest (score, id) in the index, nearest first, ties to smaller ids.

    Each shard's index rows come before the queries in one sorted partition, so a task holds one shard and streams all queries through it.
    """
    sizes = index.select("dim", "shard").distinct()
    asked = vectors.groupBy("h1", "h2").agg(F.min("id").alias("id"))
    asked = vectors.join(asked, ["h1", "h2", "id"]).dropDuplicates(["h1", "h2"]).select("h1", "h2", "vec", F.size("vec").alias("dim"))
    kinds = {f.name: f.dataType.simpleString() for f in index.schema}
    lists = sizes.groupBy("dim").agg(F.collect_list("shard").alias("shards"))  # a number for each shard, not for each vector
    asked = asked.join(lists, "dim").withColumn("shard", F.explode("shards"))
    empty = {n: F.lit(None).cast(kinds[n]).alias(n) for n in ("node", "links", "ids")}
    columns = ["dim", "shard", "h1", "h2", "vec", "node", "links", "ids"]
    both = index.select(*columns).union(asked.select(*(empty.get(c, F.col(c)) for c in columns)))
    both = both.repartition(max(1, sizes.count()), "dim", "shard").sortWithinPartitions("dim", "shard", F.col("node").isNull(), "h1", "h2")
    id_kind = kinds["ids"].removeprefix("array<").removesuffix(">")
    names = ["h1", "h2", "score", "id"]
    schema = f"h1 long, h2 long, score double, id {id_kind}"

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, shard = None, _Shard()
        for b in it:
            dims, numbers = np.asarray(b.column("dim")), np.asarray(b.column("shard"))
            is_query = np.asarray(b.column("node").is_null())
            turns = np.flatnonzero((np.diff(dims) != 0) | (np.diff(numbers) != 0) | (np.diff(is_query.astype(int)) != 0)) + 1
            for lo, hi in zip([0, *turns.tolist()], [*turns.tolist(), len(dims)]):
                if lo == hi:
                    continue
                part = b.slice(lo, hi - lo)
                if where != (dims[lo], numbers[lo]):
                    where, shard = (dims[lo], numbers[lo]), _Shard()
                if not is_query[lo]:
                    shard.parts.append(part)
                    continue
                if not shard.ready:
                    shard.prepare()
                for at in range(0, len(part), _BATCH):
                    some = part.slice(at, _BATCH)
                    found = list(shard.nearest(_matrix(some.column("vec")), k, beam))
                    times = np.array([len(f) for f in found])
                    own = pa.array(np.repeat(np.arange(len(found)), times))
                    flat = [x for f in found for x in f]
                    yield pa.RecordBatch.from_arrays(
                        [some.column("h1").take(own), some.column("h2").take(own), pa.array([x[0] for x in flat], pa.float64()), pa.array([x[1] for x in flat], b.schema.field("ids").type.value_type)],
                        names=names,
                    )

    found = both.mapInArrow(batches, schema)
    best = Window.partitionBy("h1", "h2").orderBy("score", "id")
    found = found.withColumn("rn", F.row_number().over(best)).filter(F.col("rn") <= k)
    return found.groupBy("h1", "h2").agg(F.sort_array(F.collect_list(F.struct("score", "id"))).alias("hits"))


def neighbours(df: DataFrame, k: int = 10, every: int = 100, id_: str = "vec_id", vector: str = "embedding", shard: int = SHARD, edges: int = EDGES, beam: int = WIDE_BEAM) -> DataFrame:
    """(query_id, rank, vec_id, score): for rows whose id is divisible by `every`, the k nearest other rows found, by Euclidean distance.

    Ranks count from 1; ties go to the smaller id. Rows with a null id and vectors that are null, empty, zero or hold null or non-finite
    components take no part, neither as queries nor as candidates. Rows equal in id and vector are one row; rows equal in id only are rows of
    their own, and each is a query if the id is one. Vectors of another length than the query's are no candidates. With fewer candidates than k,
    all are returned; without any, and for an empty table, there are no rows. Other columns are not read.
    """
    vectors = vectors_of(df, id_, vector)
    index = cut_lineage(build(vectors, k + 1, shard, edges))
    asked = vectors.filter(F.col("id") % every == 0)
    hits = search(index, asked, k + 1, beam)
    rows = asked.select("h1", "h2", F.col("id").alias("query_id")).distinct().join(hits, ["h1", "h2"])
    others = F.slice(F.filter("hits", lambda h: ~((h["id"] == F.col("query_id")) & (h["score"] == 0))), 1, k)
    rows = rows.select("query_id", F.posexplode(others).alias("at", "hit"))
    return rows.select("query_id", (F.col("at") + 1).alias("rank"), F.col("hit.id").alias("vec_id"), F.col("hit.score").alias("score"))
