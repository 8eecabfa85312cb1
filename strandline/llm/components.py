"""Connected components of a link table, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm.common import cut_lineage

#: Links (of 16 bytes) that one task takes. Rounds over so many or fewer run in one partition and shuffle nothing.
TASK_LINKS = 1 << 18


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _together(rows: DataFrame, few: bool) -> DataFrame:
    return rows.coalesce(1) if few else rows


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is tied to the least of the node and its neighbours."""
    ways = _both_ways(edges)
    least = ways.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
    return ways.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a != b").distinct()


def _small_star(edges: DataFrame, few: bool) -> DataFrame:
    """A node and its smaller neighbours are tied to the least of them."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    tied = _together(down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")), few)
    return tied.unionByName(least.select("a", F.col("m").alias("b"))).filter("a != b").distinct()


def component_roots(links: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root) for every node that has a link; the root is the least node of its component.

    Rounds end when a whole round changes nothing; links between a node and itself are left out.
    Each round is checkpointed, so its cost does not grow with the rounds before it. A round never has more links than
    twice those of the one before; once the counted links are few, they are put together, which changes where the rounds run and no root.
    """
    edges = cut_lineage(links.select(F.col(a).alias("a"), F.col(b).alias("b")).filter("a != b").distinct())
    before = None
    while True:
        # exact sums in decimals: equal tables have equal marks
        mark = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == before or mark[0] == 0:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
                edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
            )
        before = mark
        few = mark[0] <= TASK_LINKS
        edges = cut_lineage(_small_star(_together(_large_star(_together(edges, few)), few), few))
