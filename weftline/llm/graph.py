"""Distributed connected components by alternating large-star and small-star steps.

Each step is a minimum per node (with partial aggregation) and an equi-join back, so a hub that
touches a third of all edges is split by Spark's skew join and never gathered into one task. (Minima are
written before the join: Spark splits a join only where both sides come straight from a shuffle.) The
number of rounds grows with the logarithm of the component size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import discard, materialize


def _digest(e: DataFrame) -> tuple:
    r = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return tuple(r)


def connected_components(edges: DataFrame, src: str, dst: str, max_rounds: int = 60) -> DataFrame:
    """(node, component): the smallest node that each node of an edge can reach.

    Nulls and loops are ignored; repeated edges count once. Nodes without an edge are not returned;
    no edges give no rows.
    """
    pairs = edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).where("a <> b")
    e = materialize(pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    seen = _digest(e)
    for _ in range(max_rounds):
        if not seen[0]:
            break
        both = e.union(e.select(F.col("b"), F.col("a")))
        low = materialize(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a > b").distinct()
        large = materialize(large)
        discard(low)
        least = materialize(large.groupBy("a").agg(F.min("b").alias("m")))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        nxt = materialize(small.union(least.select("a", "m")).distinct())
        discard(large)
        discard(least)
        now = _digest(nxt)
        discard(e)
        e, (seen, before) = nxt, (now, seen)
        if now == before:
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = e.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return roots.union(e.select(F.col("b"), F.col("b")).distinct())
