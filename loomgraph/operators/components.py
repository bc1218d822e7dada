"""Connected components by alternating large-star and small-star (Kiveris et al. 2014), as joins and aggregates.

Nothing is collected but a row count and a checksum per round, taken while the round's table is written; the table before it is
deleted.  A hot node's neighbours are combined before the shuffle for the minimum, and the join that spreads it back is an equi-join
adaptive execution can split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from loomgraph.sources.shared import materialize, release


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """edges (u, v) with v < u.  Large: every larger neighbour to the least of the closed neighbourhood; small: the smaller ones and u."""
    if large:
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        out = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        least = edges.groupBy("u").agg(F.min("v").alias("m"))
        moved = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        out = moved.union(least.select("u", F.col("m").alias("v")))
    return out.where("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(u, v) of any direction -> (node, component): each node with an edge and the least node it reaches.

    Null ends and self-loops are dropped; without edges the result is empty.  Rounds grow with the logarithm of the longest chain
    and end when a round changes nothing.
    """
    e = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u is not null and v is not null and u <> v")
    current = materialize(e.distinct(), "cc")
    seen, mark = None, ()
    while mark != seen:
        seen, watch = mark, Observation()
        after = materialize(_star(_star(current, True), False), "cc", watch, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v") % F.lit(1 << 40)).alias("s"))
        mark = (watch.get["n"], watch.get["s"])
        release(current)
        current = after
        if not mark[0]:
            break
    roots = current.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return current.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
