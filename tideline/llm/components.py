"""Connected components of a table of links, by alternating large and small stars.

Every step is a join and a minimum by node, so no component is gathered in one
task; a node of very many links is split by the skew join. Each round is written
to the shared folder and the one before it removed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def _mark(edges: DataFrame):
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.shiftright(F.xxhash64("a", "b"), 20))).first())


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """node and component (its smallest node), for every node of edges (a, b: long). Loops and repeats are allowed. More than so many rounds are an error, never an unfinished result."""
    now = common.materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    before = _mark(now)
    for _ in range(rounds):
        if not before[0]:
            break
        # Large star: what is greater than a node goes to the least node beside it.
        both = now.union(now.select("b", "a").toDF("a", "b"))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        # Small star: a node and what is less than it go to the least of these.
        down = large.where("a <> b").distinct()
        low = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select("a", F.col("m").alias("b")))
        after = common.materialize(small.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
        mark = _mark(after)
        common.discard(now)
        now = after
        if mark == before:
            break
        before = mark
    else:
        raise RuntimeError(f"components haven't settled after {rounds} rounds")
    nodes = now.groupBy("a").agg(F.min("b").alias("component")).select(F.col("a").alias("node"), "component")
    return nodes.union(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct().join(now.select(F.col("a").alias("node")), "node", "left_anti"))
