"""Sharding on a consistent-hash ring with virtual nodes and bounded loads.

Every shard owns `virtual_nodes` points of a hash ring; a key belongs to the arc that
ends at the next point clockwise. Arcs are served in an order fixed by the ring alone.
An arc fills its own shard first; keys that find the shard full continue clockwise to
the next shard with room. Keys keep their place within an arc, so the plan needs only
the number of rows of each arc: shards x virtual nodes counts, whatever the input holds.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

RING_BITS = 32
CELL_BITS = 12
#: Leading bits of the hash that orders the rows of an arc, as far as blocks are cut from it.
ORDER_BITS = 31
#: Rows of an arc that one window partition ranks.
BLOCK_ROWS = 100_000
#: Copies of one row that one task writes out.
COPY_ROWS = 100_000


@dataclass(frozen=True)
class Ring:
    """Points of the ring in clockwise order and the shard of each."""

    points: tuple[int, ...]
    owners: tuple[int, ...]

    @classmethod
    def of(cls, shards: int, virtual_nodes: int) -> Ring:
        nodes = sorted(
            (int.from_bytes(hashlib.md5(f"{s}/{v}".encode()).digest()[:4], "big"), s)
            for s in range(shards)
            for v in range(virtual_nodes)
        )
        return cls(tuple(p for p, _ in nodes), tuple(s for _, s in nodes))

    def serving_order(self) -> list[int]:
        """Arcs in an order that mixes the shards: by a hash of the arc's point."""
        return sorted(range(len(self.points)), key=lambda a: hashlib.md5(f"arc {self.points[a]} {a}".encode()).digest())


def capacities(rows: int, shards: int, slack: float) -> list[int]:
    """Most rows of each shard. Without slack the shards take all rows and differ by one at most."""
    least, more = divmod(rows, shards)
    if slack <= 0:
        return [least + (s < more) for s in range(shards)]
    return [-(-int(rows * (1 + slack) * 1_000_000) // (shards * 1_000_000)) + 1] * shards


def plan(ring: Ring, counts: dict[int, int], room: list[int]) -> list[tuple[int, int, int, int]]:
    """Segments (arc, first rank in the arc, shard, first slot in the shard) of a bounded-load walk."""
    room, used, n = list(room), [0] * len(room), len(ring.points)
    segments: list[tuple[int, int, int, int]] = []
    onward = list(range(1, n + 1))  # the next arc worth a look, kept short as shards fill

    def with_room(a: int) -> int:
        seen = []
        while room[ring.owners[a]] == 0:
            seen.append(a)
            a = onward[a] % n
        for x in seen:
            onward[x] = a
        return a

    for arc in ring.serving_order():
        left, rank = counts.get(arc, 0), 0
        while left:
            shard = ring.owners[with_room(arc)]
            taken = min(left, room[shard])
            segments.append((arc, rank, shard, used[shard]))
            room[shard] -= taken
            used[shard] += taken
            rank += taken
            left -= taken
    return segments


def shard_rows(
    df: DataFrame, key: str, shards: int = 16, virtual_nodes: int = 128, slack: float = 0.0, order: list[str] | None = None
) -> DataFrame:
    """Puts every row into a shard; adds `shard` and `slot` (gapless from 0 in each shard).

    `key` places a row on the ring; `order` (default: the other columns) breaks ties within an arc.
    Rows equal in all columns of `df` are counted once before any shuffle and written out again
    at the end, so a row that is repeated without bound never meets in one task.
    With slack 0 the shards' row counts differ by one at most; slack c lets a shard hold up to
    (1 + c) times the mean. Null keys share one place on the ring. An empty table gives no rows.
    Columns named `shard` or `slot` are replaced; all others stay, whatever their names.

    With one shard more, slack 0 moves more keys than the new shard takes, since every shard's bound falls and
    what overflows walks on; slack 0.25 moves little more than those.
    """
    spark = df.sparkSession
    ring = Ring.of(shards, virtual_nodes)
    kept = [c for c in df.columns if c.lower() not in ("shard", "slot")]
    # names of its own, so that none can clash
    names = [f"c{i}" for i in range(len(kept))]
    own = dict(zip(kept, names))
    order = [own[c] for c in (order or [c for c in kept if c != key])]
    key = own[key]
    df = df.select(*(F.col(f"`{c}`").alias(n) for c, n in own.items()))
    distinct = with_arc(df, ring, key).groupBy("_arc", *names).agg(F.count(F.lit(1)).alias("_copies"))
    per_arc = distinct.groupBy("_arc").agg(F.sum("_copies").alias("n"), F.max("_copies").alias("most")).collect()
    counts = {r["_arc"]: r["n"] for r in per_arc}
    most, total = max((r["most"] for r in per_arc), default=0), sum(counts.values())
    segments = plan(ring, counts, capacities(total, shards, slack))

    # rank of each row in its arc: in blocks, after the rows of earlier blocks
    blocks = {a: -(-n // BLOCK_ROWS) for a, n in counts.items() if n > BLOCK_ROWS}
    blocks_of = F.create_map(*(F.lit(x) for kv in blocks.items() for x in kv))[F.col("_arc")] if blocks else F.lit(1)
    # rows are in the order of a hash of all their columns, whose leading bits make the blocks
    hashed = F.xxhash64(key, *order)
    leading = F.shiftrightunsigned(hashed, 64 - ORDER_BITS)
    blocked = distinct.withColumn("_block", F.shiftright(leading * F.coalesce(blocks_of, F.lit(1)), ORDER_BITS).cast("int"))
    before = Window.partitionBy("_arc").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    within = Window.partitionBy("_arc", "_block").orderBy(leading, hashed, key, *order).rowsBetween(Window.unboundedPreceding, -1)
    ranked = blocked.withColumn("_rank", F.coalesce(F.sum("_copies").over(within), F.lit(0)))
    if blocks:
        sizes = blocked.groupBy("_arc", "_block").agg(F.sum("_copies").alias("_n"))
        offsets = sizes.select("_arc", "_block", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
        ranked = ranked.join(offsets, ["_arc", "_block"]).withColumn("_rank", F.col("_rank") + F.col("_before"))
    copied = write_out_copies(ranked, most)

    # shards x virtual nodes + shards segments at most: a bounded table
    by_arc: dict[int, list[tuple[int, int, int]]] = {}
    for arc, rank, shard, slot in segments:
        by_arc.setdefault(arc, []).append((rank, shard, slot))
    schema = "_arc int, _segments array<struct<rank:long,shard:int,slot:long>>"
    table = spark.createDataFrame([(a, s) for a, s in by_arc.items()], schema)
    found = F.element_at(F.filter("_segments", lambda s: s["rank"] <= F.col("_rank")), -1)
    return (
        copied.join(F.broadcast(table), "_arc")
        .withColumn("_segment", found)
        .select(
            *(F.col(n).alias(c) for c, n in own.items()),
            F.col("_segment.shard").alias("shard"),
            (F.col("_segment.slot") + F.col("_rank") - F.col("_segment.rank")).alias("slot"),
        )
    )


def with_arc(df: DataFrame, ring: Ring, key: str) -> DataFrame:
    """Adds `_arc`: the first point at or after the key's place; past the last point it is the first one again.

    The ring is cut into 2^CELL_BITS equal cells, and a broadcast row for each holds its points and the next one.
    """
    width, n = 1 << (RING_BITS - CELL_BITS), len(ring.points)
    cells = []
    for cell in range(1 << CELL_BITS):
        first, after = bisect_left(ring.points, cell * width), bisect_left(ring.points, (cell + 1) * width)
        cells.append((cell, [(ring.points[i], i) for i in range(first, after)] + [(1 << RING_BITS, after % n)]))
    table = df.sparkSession.createDataFrame(cells, "_cell int, _points array<struct<point:long,arc:int>>")
    placed = df.withColumn("_place", F.shiftrightunsigned(F.xxhash64(key), 64 - RING_BITS)).withColumn(
        "_cell", F.shiftright("_place", RING_BITS - CELL_BITS).cast("int")
    )
    arc = F.element_at(F.filter("_points", lambda p: p["point"] >= F.col("_place")), 1)["arc"]
    return placed.join(F.broadcast(table), "_cell").withColumn("_arc", arc).drop("_cell", "_points", "_place")


def write_out_copies(ranked: DataFrame, most: int) -> DataFrame:
    """One row for each of `_copies`, with ranks that follow `_rank`; many copies are dealt out to many tasks."""
    few = ranked.filter(F.col("_copies") <= COPY_ROWS).withColumn("_first", F.lit(0).cast("long"))
    if most <= COPY_ROWS:
        return one_each(few)
    many = (
        ranked.filter(F.col("_copies") > COPY_ROWS)
        .withColumn("_first", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_copies") - 1, F.lit(COPY_ROWS).cast("long"))))
        .repartition("_rank", "_first")
    )
    return one_each(few.unionByName(many))


def one_each(chunks: DataFrame) -> DataFrame:
    last = F.least(F.col("_first") + COPY_ROWS, F.col("_copies")) - 1
    one = chunks.withColumn("_copy", F.explode(F.sequence(F.col("_first"), last)))
    return one.withColumn("_rank", F.col("_rank") + F.col("_copy")).drop("_first", "_copy", "_copies")
