"""Connected components of a link table, without the driver or one task ever holding links.

Alternating large-star and small-star steps (Kiveris et al., "Connected Components in MapReduce and Beyond", 2014).
Both steps aggregate a minimum before the join, so a node with many neighbours is combined map-side; each round is cut
with a checkpoint in the shared folder, so a lost executor repeats at most one round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

MAX_ROUNDS = 60


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """edges (a, b). Links the neighbours of every node (larger ones, or smaller ones and itself) to its least neighbour."""
    both = edges.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e")).select("e.*") if large else edges
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    joined = both.join(least, "a")
    if large:
        return joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
    moved = joined.select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("e")).select("e.*")
    return moved.where("a <> b").distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (two long columns a, b); root is the least node that it reaches.

    Loops and repeated links do no harm; an empty table gives an empty result.
    """
    edges = cut(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    state = None
    for _ in range(MAX_ROUNDS):
        small = _star(_star(edges, True), False)
        edges = cut(small)
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == state:
            break
        state = now
    else:
        raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
    rooted = edges.groupBy("a").agg(F.min("b").alias("root")).withColumnRenamed("a", "node")
    return rooted.unionByName(rooted.select("root").distinct().select(F.col("root").alias("node"), "root"))
