"""Connected components of a link table, without collecting links anywhere.

Alternating large-star and small-star rounds: each is one aggregation and one
join by node, so a node with very many links is combined before the exchange
and its rows can be split in the join. Every round is written to the shared
folder, so a lost executor repeats one round at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import runtime


def _star(pairs: DataFrame) -> DataFrame:
    """``pairs`` (node, other): each node with the least of itself and its others."""
    return pairs.groupBy("node").agg(F.least(F.min("other"), F.col("node")).alias("least"))


def large_star(edges: DataFrame) -> DataFrame:
    """Link every larger neighbour of a node to the least of its neighbourhood."""
    both = edges.select(F.col("a").alias("node"), F.col("b").alias("other")).unionByName(edges.select(F.col("b").alias("node"), F.col("a").alias("other")))
    joined = both.join(_star(both), "node").filter("other > node")
    return joined.select(F.col("other").alias("a"), F.col("least").alias("b")).distinct()


def small_star(edges: DataFrame) -> DataFrame:
    """Link a node and its smaller neighbours to the least of them. Edges have a > b."""
    down = edges.select(F.col("a").alias("node"), F.col("b").alias("other"))
    joined = down.join(_star(down), "node")
    out = joined.select(F.col("other").alias("a"), F.col("least").alias("b")).unionByName(joined.select(F.col("node").alias("a"), F.col("least").alias("b")))
    return out.filter("a > b").distinct()


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node, component`` for every node of a link; the component is its least node.

    Loops and null ends are ignored, repeated links count once.
    """
    low, high = F.least(a, b).alias("b"), F.greatest(a, b).alias("a")
    edges = edges.filter(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).select(high, low).distinct()
    edges, before = runtime.write_table(edges, "links"), None
    while True:
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b") % F.lit(1 << 40))).first()
        if now == before or not now[0]:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
        before = now
        edges = runtime.write_table(small_star(large_star(edges)), "star")
