"""Graph operators over edge DataFrames (k-hop rings, triangles, common
neighbours, connected components).  Edges are (src, dst) columns named by
the caller; undirected graphs are stored with both directions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphbi.operators.rounds import RoundStore


def bfs_levels(edges: DataFrame, seeds: DataFrame, max_hops: int, src: str = "src", dst: str = "dst") -> DataFrame:
    """(node, dist) for every node within ``max_hops`` of the seeds (BFS
    distance; seeds have dist 0).  Each level is a frontier join followed by
    an anti join against the levels before it, so no node is expanded twice;
    levels are stored in the shared folder, and an empty one ends the search."""
    spark = seeds.sparkSession
    e = edges.select(F.col(src).alias("node"), F.col(dst).alias("_to"))
    store = RoundStore(spark, "bfs")
    levels = [store.put(seeds.select(F.col(seeds.columns[0]).alias("node")).distinct().withColumn("dist", F.lit(0)))]
    for k in range(1, max_hops + 1):
        visited = reduce(DataFrame.union, levels)
        found = store.put_rows(levels[-1].select("node").join(e, "node").select(F.col("_to").alias("node")).distinct()
                               .join(visited.select("node"), "node", "left_anti").withColumn("dist", F.lit(k)))
        if found is None:
            break
        levels.append(found)
    return reduce(DataFrame.union, levels)


def hop_ring(edges: DataFrame, seeds: DataFrame, lo: int, hi: int, src: str = "src", dst: str = "dst") -> DataFrame:
    """Nodes whose BFS distance from the seeds is in [lo, hi] (column ``node``)."""
    levels = bfs_levels(edges, seeds, hi, src, dst)
    return levels.where(F.col("dist").between(lo, hi)).select("node")


def khop_neighbors(edges: DataFrame, seeds: DataFrame, k: int, src: str = "src", dst: str = "dst") -> DataFrame:
    """Distinct nodes within 1..k hops of the seeds (seeds only if re-reached)."""
    e = edges.select(F.col(src).alias("node"), F.col(dst).alias("_to"))
    start = seeds.select(F.col(seeds.columns[0]).alias("node")).distinct()
    levels = bfs_levels(edges, start, k, src, dst)
    # a seed counts if an edge leads back to it: from a node that is within k - 1 hops
    back = (levels.where(F.col("dist") < k).select("node").join(e, "node").select(F.col("_to").alias("node"))
            .join(start, "node", "left_semi").distinct())
    return levels.where(F.col("dist") > 0).select("node").unionByName(back)


def count_triangles(edges: DataFrame, a: str = "src", b: str = "dst") -> DataFrame:
    """Number of triangles of an undirected edge set (one row, column ``count``).

    Each edge leads from its end of smaller (degree, id) to the other, so that
    a hub, which most edges only enter, starts few wedges: none starts more
    than about the square root of the doubled number of edges.  Wedges are
    pairs of edges from one node, closed by a semi join; every triangle is
    counted once, at its least node.
    """
    pairs = (edges.select(F.least(a, b).alias("lo"), F.greatest(a, b).alias("hi"))
             .where(F.col("lo") < F.col("hi")).distinct())
    degree = (pairs.select(F.explode(F.array("lo", "hi")).alias("node")).groupBy("node")
              .agg(F.count(F.lit(1)).alias("deg")))
    ends = (pairs.join(degree.select(F.col("node").alias("lo"), F.struct("deg", F.col("node").alias("id")).alias("_l")), "lo")
            .join(degree.select(F.col("node").alias("hi"), F.struct("deg", F.col("node").alias("id")).alias("_h")), "hi"))
    out = ends.select(F.least("_l", "_h").alias("x"), F.greatest("_l", "_h").alias("y"))
    wedges = (out.select("x", F.col("y").alias("b")).join(out.select("x", F.col("y").alias("c")), "x")
              .where(F.col("b") < F.col("c")).select(F.col("b.id").alias("b"), F.col("c.id").alias("c")))
    closing = out.select(F.col("x.id").alias("b"), F.col("y.id").alias("c"))
    return wedges.join(closing, ["b", "c"], "left_semi").agg(F.count(F.lit(1)).alias("count"))


def common_neighbors(edges: DataFrame, nodes: DataFrame, exclude_adjacent: bool = True,
                     src: str = "src", dst: str = "dst") -> DataFrame:
    """(a, b, n): ordered pairs of distinct ``nodes`` with n common neighbours.

    Wedges a - f - b are formed by a self join on the neighbour f of the
    edges leaving ``nodes``; AQE splits a hot neighbour's partition (skew
    join) and the pair counts are partially aggregated before the shuffle.
    With ``exclude_adjacent`` pairs that are already connected are removed
    by an anti join."""
    n = nodes.select(F.col(nodes.columns[0]).alias("a"))
    e = edges.select(F.col(src).alias("a"), F.col(dst).alias("f")).join(n, "a", "left_semi")
    pairs = (e.join(e.select(F.col("a").alias("b"), "f"), "f").where(F.col("a") != F.col("b"))
             .groupBy("a", "b").agg(F.count(F.lit(1)).alias("n")))
    if exclude_adjacent:
        pairs = pairs.join(edges.select(F.col(dst).alias("a"), F.col(src).alias("b")), ["a", "b"], "left_anti")
    return pairs


def _hang(pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Each node's smallest partner, and the pairs with it (columns ``hi``, ``lo``, ``least``)."""
    least = pairs.groupBy("hi").agg(F.min("lo").alias("least"))  # combined on the map side: a hub is one row a task
    return least, pairs.join(least, "hi")


def _contract(links: DataFrame) -> DataFrame:
    """One round over links (hi, lo) with hi > lo, which keeps the components.

    First every node ties its larger partners to the smallest node it knows,
    itself included; then every node ties its smaller partners, and itself, to
    the smallest of them.
    """
    _, near = _hang(links.unionByName(links.select(F.col("lo").alias("hi"), F.col("hi").alias("lo"))))
    up = (near.where(F.col("lo") > F.col("hi")).select(F.col("lo").alias("hi"), F.least("hi", "least").alias("lo"))
          .distinct())
    least, near = _hang(up)
    down = (near.select(F.col("lo").alias("hi"), F.col("least").alias("lo"))
            .unionByName(least.select("hi", F.col("least").alias("lo"))))
    return down.where(F.col("hi") != F.col("lo")).distinct()


def connected_components(spark: SparkSession, edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(node, component) with component = smallest node id of the component.

    Star contraction: each round ties nodes to smaller ones until every
    component is a star around its smallest node, in about log(nodes) rounds
    whatever the diameter.  A round is one stored table that replaces the one
    before; a checksum of the links that no longer changes ends the loop."""
    store, n = RoundStore(spark, "components"), 0
    nodes = edges.select(F.explode(F.array(F.col(src), F.col(dst))).alias("node")).distinct()
    links = store.put(edges.where(F.col(src) != F.col(dst))
                      .select(F.greatest(src, dst).alias("hi"), F.least(src, dst).alias("lo")).distinct(), "links_0")

    def checksum(df: DataFrame):
        return df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first()

    state = checksum(links)
    while state[0]:
        n += 1
        links = store.put(_contract(links), f"links_{n}")
        before, state = state, checksum(links)
        store.drop(f"links_{n - 1}")
        if state == before:
            break
    labels = links.select(F.col("hi").alias("node"), F.col("lo").alias("component"))
    return nodes.join(labels, "node", "left").select("node", F.coalesce("component", "node").alias("component"))
