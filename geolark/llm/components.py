"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component): the smallest node that each node of `edges` (src, dst) reaches.

    Every step groups by node with map-side minima; a centre with very many neighbours is an ordinary
    join key that adaptive execution can split. Nodes without edges are not returned; an empty edge
    table gives an empty result; loops and repeated edges do no harm. The number of rounds grows with the logarithm of the
    number of nodes; more than `max_rounds` raise an error.
    """
    now = materialize(edges.where("src <> dst").select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst")).distinct(), "edges")
    mark = lambda rows: rows.agg(F.count("*").alias("n"), F.sum(F.xxhash64("src", "dst").cast("decimal(38,0)")).alias("h")).first()
    seen = mark(now)
    for _ in range(max_rounds if seen["n"] else 0):
        # large star: every larger neighbour of u moves to the smallest of u's neighbourhood
        both = now.union(now.select("dst", "src"))
        low = both.groupBy("src").agg(F.least(F.min("dst"), F.col("src")).alias("low"))
        large = both.where("dst > src").join(low, "src").select(F.col("dst").alias("src"), F.col("low").alias("dst")).distinct()
        # small star: u and its smaller neighbours move to the smallest of them
        least = large.groupBy("src").agg(F.min("dst").alias("low"))
        small = large.join(least, "src").where("dst <> low").select(F.col("dst").alias("src"), F.col("low").alias("dst"))
        now = materialize(small.union(least).where("src <> dst").distinct(), "edges", replaces=now)
        last, seen = seen, mark(now)
        if seen == last:
            break
    else:
        if seen["n"]:
            raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = now.select(F.col("dst").alias("node"), F.col("dst").alias("component")).distinct()
    return now.select(F.col("src").alias("node"), F.col("dst").alias("component")).union(roots)
