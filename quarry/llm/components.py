"""Connected components of an edge table by alternating large-star and small-star joins.

Each round only moves edges (node, neighbour) between hash partitions; nothing is collected.
A node with very many neighbours is reduced to its minimum by partial aggregation, and its
edges are then joined against that one row, so AQE may split them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import drop, scratch


def _star(edges: DataFrame, large: bool) -> DataFrame:
    both = edges.select(F.col("a").alias("n"), F.col("b").alias("m"))
    if large:
        both = both.unionByName(edges.select(F.col("b").alias("n"), F.col("a").alias("m")))
    else:  # each node with its smaller neighbours
        both = both.select(F.greatest("n", "m").alias("n"), F.least("n", "m").alias("m"))
    low = both.groupBy("n").agg(F.min("m").alias("low")).select("n", F.least("n", "low").alias("low"))
    moved = both.join(low, "n")
    if large:
        moved = moved.filter(F.col("m") > F.col("n")).select(F.col("m").alias("a"), F.col("low").alias("b"))
    else:
        moved = moved.select(F.col("m").alias("a"), F.col("low").alias("b")).unionByName(low.select(F.col("n").alias("a"), F.col("low").alias("b")))
    return moved.filter("a <> b").distinct()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(a, b) links of any orderable type -> (node, root), root the smallest node reachable.

    Nodes without a link don't appear. Null ends and self-links are ignored; an empty table
    gives an empty one. Stops when a round changes nothing; raises if that takes over ``rounds``
    (their number grows with the logarithm of the longest path).
    """
    now = scratch(edges.select("a", "b").filter("a is not null and b is not null and a <> b").distinct(), "edges")
    seen = None
    for _ in range(rounds):
        after = scratch(_star(_star(now, True), False), "edges")
        mark = after.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == seen or not mark[0]:
            break
        drop(now)
        seen, now = mark, after
    else:
        raise RuntimeError(f"components not settled after {rounds} rounds")
    roots = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
