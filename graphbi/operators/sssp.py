"""Weighted shortest paths between node sets, as a DataFrame loop.

Edges are (src, dst, w) with w > 0, stored in both directions.  Labels are
corrected round by round (a distributed Bellman-Ford over the live frontier)
from both ends at once; a label is only expanded while it is at most half of
the best meeting found so far, which bounds the explored state to the two
balls around the endpoint sets.

* :func:`shortest_distance` - phase 1.  All sources share one label (a
  super-source), likewise all targets, so the state is one row per reached
  node and side.  Returns the global minimum D, or None when no path exists.
* :func:`shortest_pairs` - phase 2.  Labels per source (and per target),
  expanded only up to D/2.  A pair (f, t) is at distance D exactly when some
  node v has L(f, v) + R(t, v) = D; such v have L(f, v) = min_f L(., v) and
  R(t, v) = min_t R(., v), so the pairs come from joining the per-node
  minimal witnesses only, never all source x target combinations.

Only two scalars per round leave the cluster (best meeting, smallest live
label); each round's state is written to the shared folder.

A graph with long ways (roads, rings, chains) takes a round for each hop.
Phase 1 therefore goes on, after some rounds, on a smaller graph with the same
distances: :func:`contracted` replaces nodes with at most two neighbours by
edges between these, a third of a chain's nodes at once.
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphbi.operators.rounds import RoundStore

REL_TOL = 1e-9
#: Rounds of a search after which the graph is contracted.
_LONG_SEARCH = 12
#: Contraction goes on while a round leaves at most this part of the edges.
_WORTH = 0.9


def _tol(x: float) -> float:
    return REL_TOL * max(1.0, abs(x))


def _prepare_edges(edges: DataFrame) -> DataFrame:
    e = edges.select(F.col("src").alias("node"), F.col("dst").alias("_to"), F.col("w").cast("double").alias("_w"))
    # persisted as read: a hub's edges stay splittable by AQE's skew join
    e = e.persist(StorageLevel.MEMORY_AND_DISK)
    if not e.where(~(F.col("_w") >= 0)).isEmpty():  # with weights of 0 and more the rounds end by themselves
        e.unpersist()
        raise ValueError("edge weights must not be negative")
    return e


def _relax(state: DataFrame, edges: DataFrame, keys: list[str], bound: float | None) -> DataFrame:
    """One round: expand fresh labels (<= bound), keep the per-key minimum."""
    live = state.where(F.col("fresh"))
    if bound is not None:
        live = live.where(F.col("d") <= F.lit(bound))
    cand = (live.select(*keys, "d").join(edges, "node")
            .select(*[k for k in keys if k != "node"], F.col("_to").alias("node"), (F.col("d") + F.col("_w")).alias("d"))
            .groupBy(*keys).agg(F.min("d").alias("_c")))
    merged = state.select(*keys, "d").join(cand, keys, "full")
    return merged.select(*keys, F.least("d", "_c").alias("d"),
                         F.coalesce(F.col("_c") < F.coalesce(F.col("d"), F.lit(float("inf"))), F.lit(False))
                         .alias("fresh"))


def _seed(nodes: DataFrame, side: int, with_group: bool) -> DataFrame:
    n = nodes.select(F.col(nodes.columns[0]).alias("node")).distinct()
    cols = [F.lit(side).alias("side")]
    if with_group:
        cols.append(F.col("node").alias("g"))
    return n.select(*cols, "node", F.lit(0.0).alias("d"), F.lit(True).alias("fresh"))


def _seed_both(sources: DataFrame, targets: DataFrame) -> DataFrame:
    """One row per node with both sides' labels: (node, dl, dr, fl, fr)."""
    src = sources.select(F.col(sources.columns[0]).alias("node")).distinct().withColumn("dl", F.lit(0.0))
    dst = targets.select(F.col(targets.columns[0]).alias("node")).distinct().withColumn("dr", F.lit(0.0))
    both = src.join(dst, "node", "full")
    return both.select("node", "dl", "dr", F.col("dl").isNotNull().alias("fl"), F.col("dr").isNotNull().alias("fr"))


def _relax_both(state: DataFrame, edges: DataFrame, bound: float | None) -> DataFrame:
    """Expand the fresh labels of both sides at once; keep per-node minima."""
    def side(d: str, fresh: str) -> DataFrame:
        live = state.where(F.col(fresh))
        if bound is not None:
            live = live.where(F.col(d) <= F.lit(bound))
        return (live.select("node", F.col(d).alias("_d")).join(edges, "node")
                .select(F.col("_to").alias("node"), (F.col("_d") + F.col("_w")).alias("_c")))
    cand = (side("dl", "fl").withColumn("_s", F.lit(0)).unionByName(side("dr", "fr").withColumn("_s", F.lit(1)))
            .groupBy("node").agg(F.min(F.when(F.col("_s") == 0, F.col("_c"))).alias("cl"),
                                 F.min(F.when(F.col("_s") == 1, F.col("_c"))).alias("cr")))
    merged = state.select("node", "dl", "dr").join(cand, "node", "full")
    inf = F.lit(float("inf"))
    return merged.select(
        "node", F.least("dl", "cl").alias("dl"), F.least("dr", "cr").alias("dr"),
        F.coalesce(F.col("cl") < F.coalesce(F.col("dl"), inf), F.lit(False)).alias("fl"),
        F.coalesce(F.col("cr") < F.coalesce(F.col("dr"), inf), F.lit(False)).alias("fr"))


def shortest_distance(spark: SparkSession, edges: DataFrame, sources: DataFrame, targets: DataFrame) -> float | None:
    """Minimum path weight from any source to any target (None if unreachable)."""
    e = _prepare_edges(edges)
    try:
        return _distance(spark, e, sources, targets)
    finally:
        e.unpersist()


def _eliminated(e: DataFrame, chosen: DataFrame) -> DataFrame:
    """Edges (node, _to, _w) without the ``chosen`` nodes, no two of which are neighbours; ways through them become edges."""
    gone = chosen.select(F.col("node").alias("_to"))
    rest = e.join(chosen, "node", "left_anti").join(gone, "_to", "left_anti").select("node", "_to", "_w")
    into = e.join(gone, "_to").select(F.col("_to").alias("_by"), "node", F.col("_w").alias("_v"))
    out = e.join(chosen, "node").select(F.col("node").alias("_by"), "_to", "_w")
    through = into.join(out, "_by").where(F.col("node") != F.col("_to")).select("node", "_to", (F.col("_v") + F.col("_w")).alias("_w"))
    return rest.unionByName(through).groupBy("node", "_to").agg(F.min("_w").alias("_w"))


def _eliminable(e: DataFrame, keep: DataFrame, n: int) -> DataFrame:
    """Nodes with at most two neighbours, of neighbours only the one with the smaller hash; not those in ``keep``."""
    near = e.select("node", "_to").unionByName(e.select(F.col("_to").alias("node"), F.col("node").alias("_to"))).distinct()
    few = (near.groupBy("node").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") <= 2).join(keep, "node", "left_anti")
           .select("node", F.struct(F.xxhash64("node", F.lit(n)).alias("h"), F.col("node").alias("id")).alias("_h")))
    other = few.select(F.col("node").alias("_to"), F.col("_h").alias("_g"))
    later = near.join(few, "node").join(other, "_to").where(F.col("_g") < F.col("_h")).select("node").distinct()
    return few.select("node").join(later, "node", "left_anti")


def contracted(spark: SparkSession, edges: DataFrame, keep: DataFrame) -> DataFrame:
    """Fewer edges (node, _to, _w) with the same distances between the nodes in ``keep`` (node), stored.

    No round has more edges than the one before it; sums of weights are associated otherwise than along the way."""
    store = RoundStore(spark, "contracted")
    keep = store.put(keep.select("node").distinct())
    whole = edges.where((F.col("node") != F.col("_to")) & F.col("_w").isNotNull())
    e, n = store.put(whole.groupBy("node", "_to").agg(F.min("_w").alias("_w")), "e0"), 0
    count = e.count()
    while count:
        n += 1
        chosen = store.put(_eliminable(e, keep, n), f"c{n}")
        e, before = store.put(_eliminated(e, chosen), f"e{n}"), count
        count = e.count()
        store.drop(f"c{n}")
        store.drop(f"e{n - 1}")
        if count > _WORTH * before:
            break
    return e


def _distance(spark: SparkSession, e: DataFrame, sources: DataFrame, targets: DataFrame) -> float | None:
    """Phase 1 on prepared edges.

    The state has one row per reached node carrying both sides' labels, so a
    meeting is a per-row sum and the round's scalars (best meeting, smallest
    live label) come from one scan of the stored state.  A long search starts
    again on the contracted graph, with the best meeting found so far."""
    store = RoundStore(spark, "sssp1")
    state, n = store.put(_seed_both(sources, targets), "s0"), 0
    best = None
    while True:
        row = state.agg(F.min(F.col("dl") + F.col("dr")).alias("best"),
                        F.min(F.least(F.when(F.col("fl"), F.col("dl")),
                                      F.when(F.col("fr"), F.col("dr")))).alias("live")).first()
        if row["best"] is not None:
            best = row["best"] if best is None else min(best, row["best"])
        bound = None if best is None else best / 2 + _tol(best)
        if row["live"] is None or (bound is not None and row["live"] > bound):
            return best
        n += 1
        if n == _LONG_SEARCH:
            ends = state.where((F.col("dl") == 0) | (F.col("dr") == 0))  # sources and targets, and what lies at no distance from them
            e = contracted(spark, e, ends.select("node"))
            state = store.put(_seed_both(sources, targets), f"s{n}")
        else:
            state = store.put(_relax_both(state, e, bound), f"s{n}")
        store.drop(f"s{n - 1}")


def shortest_pairs(spark: SparkSession, edges: DataFrame, sources: DataFrame, targets: DataFrame,
                   distance: float | None = None) -> DataFrame:
    """All (f, t, w) with f a source, t a target and w the global minimum
    distance over all such pairs (ties kept).  Empty when unreachable.  Both
    phases use the edges prepared once."""
    e = _prepare_edges(edges)
    store = RoundStore(spark, "sssp2")
    keys = ["side", "g", "node"]
    try:
        distance = _distance(spark, e, sources, targets) if distance is None else distance
        if distance is None:
            return spark.createDataFrame([], "f bigint, t bigint, w double")
        D = float(distance)
        bound = D / 2 + _tol(D)
        state = store.put(_seed(sources, 0, True).unionByName(_seed(targets, 1, True)))
        while True:
            if state.where(F.col("fresh") & (F.col("d") <= F.lit(bound))).isEmpty():
                break
            state = store.put(_relax(state, e, keys, bound))
    finally:
        e.unpersist()
    near = state.where(F.col("d") <= F.lit(D + _tol(D)))
    per_node = near.groupBy("node").agg(
        F.min(F.when(F.col("side") == 0, F.col("d"))).alias("ml"),
        F.min(F.when(F.col("side") == 1, F.col("d"))).alias("mr"))
    meet = per_node.where(F.abs(F.col("ml") + F.col("mr") - F.lit(D)) <= F.lit(_tol(D)))
    left = (near.where(F.col("side") == 0).join(meet, "node")
            .where(F.col("d") <= F.col("ml") + F.lit(_tol(D))).select("node", F.col("g").alias("f")))
    right = (near.where(F.col("side") == 1).join(meet, "node")
             .where(F.col("d") <= F.col("mr") + F.lit(_tol(D))).select("node", F.col("g").alias("t")))
    pairs = left.join(right, "node").select("f", "t").distinct()
    return pairs.select(F.col("f").cast("bigint"), F.col("t").cast("bigint"), F.lit(D).alias("w"))


def reachable(spark: SparkSession, edges: DataFrame, sources: DataFrame, targets: DataFrame) -> bool:
    """Whether any target can be reached from any source (unit weights)."""
    unit = edges.select("src", "dst", F.lit(1.0).alias("w"))
    return shortest_distance(spark, unit, sources, targets) is not None
