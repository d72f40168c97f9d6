"""Connected components by star contraction, rounds stored in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphbi.llm.common import discard, stored


def _state(edges: DataFrame):
    return tuple(edges.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).head())


def _star(pairs: DataFrame, large: bool) -> DataFrame:
    """Large star: hang larger neighbours on the smallest one; small star: the node and its smaller ones."""
    both = pairs if not large else pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m"))  # pre-aggregated: a hub is one row for each task
    near = both.join(least, "u")
    if large:
        out = near.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.least("u", "m").alias("v"))
    else:
        out = near.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return out.where(F.col("u") != F.col("v")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of bigint edges (a, b): each node that has an edge to another one, with the smallest node of its component.

    Ends when a round changes nothing; rounds grow with the logarithm of the
    nodes.  Self loops and repeated edges change nothing.
    """
    now = stored(edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "llm-edges")
    state = _state(now)
    while state[0]:
        after = stored(_star(_star(now, True), False), "llm-edges")
        last, state = state, _state(after)
        discard(now)
        now = after
        if state == last:
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
