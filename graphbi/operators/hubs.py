"""Pairs with most common neighbours where single neighbours (hubs) are adjacent to a large part of the nodes.

A neighbour of d nodes makes about d * d / 2 pairs.  Up to ``hub_degree`` they
are formed by a join; beyond it the nodes are cut into blocks and a tile of two
blocks sums, for all its pairs at once, the hubs they share as a product of
0/1 matrices.  Of a tile only its first k pairs leave the task.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphbi.operators.graph import common_neighbors
from graphbi.operators.rounds import RoundStore

HUB_DEGREE = 4096  # a lighter neighbour makes at most this many pairs for each of its edges
TILE = 1024  # nodes of a block, about: the sums of a tile take 4 MB
ROSTER, SHARED, COUNTED, LEFT_OUT = range(4)  # rows of a tile, in the order in which they are read
_ROW = "i long, j long, kind int, hub long, side int, x long, y long, n long"


def _first(df: DataFrame, k: int) -> DataFrame:
    return df.orderBy(F.desc("n"), "a", "b").limit(k)


class _Tile:
    """Sums of one tile: rows of ``_ROW`` are added in their order, ``pairs`` gives the first k."""

    def __init__(self, i: int, j: int):
        self.same, self.sides, self.total, self.open = i == j, ([], []), None, None

    def add(self, rows: pd.DataFrame) -> None:
        kind = rows["kind"].to_numpy()
        roster = rows[kind == ROSTER]
        if len(roster):
            for side in (0, 1):
                self.sides[side].append(roster.loc[roster["side"] == side, "x"].to_numpy())
        if len(roster) == len(rows):
            return
        if self.total is None:
            self.sides = tuple(np.unique(np.concatenate(s)) for s in self.sides)
            self.total = np.zeros([len(s) for s in self.sides], np.float64)
        shared = rows.loc[kind == SHARED, ["hub", "side", "x"]]
        if len(shared):
            shared = shared if self.open is None else pd.concat([self.open, shared])
            last = shared["hub"].to_numpy() == shared["hub"].iloc[-1]  # its rows may go on in the next batch
            self.open = shared[last]
            self._multiply(shared[~last])
        for kinds, value in ((COUNTED, rows["n"]), (LEFT_OUT, None)):
            some = rows[kind == kinds]
            at = tuple(np.searchsorted(s, some[c].to_numpy()) for s, c in zip(self.sides, ("x", "y")))
            if value is None:
                self.total[at] = -np.inf
            else:
                self.total[at] += some["n"].to_numpy()

    def _multiply(self, shared: pd.DataFrame) -> None:
        hubs, column = np.unique(shared["hub"].to_numpy(), return_inverse=True)
        side, x = shared["side"].to_numpy(), shared["x"].to_numpy()
        ones = []
        for s, listed in enumerate(self.sides):
            m = np.zeros((len(listed), len(hubs)), np.float32)
            m[np.searchsorted(listed, x[side == s]), column[side == s]] = 1
            ones.append(m)
        self.total += ones[0] @ ones[1].T

    def pairs(self, k: int) -> pd.DataFrame:
        if self.open is not None:
            self._multiply(self.open)
        a, b = self.sides
        total = self.total
        if self.same:
            total[a[:, None] >= b[None, :]] = -np.inf  # each pair once, no node with itself
        some = total[total > 0]
        least = np.partition(some, -k)[-k] if len(some) > k else 1
        r, c = np.nonzero(total >= least)
        lo, hi, n = np.minimum(a[r], b[c]), np.maximum(a[r], b[c]), total[r, c].astype(np.int64)
        order = np.lexsort((hi, lo, -n))[:k]
        return pd.DataFrame({"a": lo[order], "b": hi[order], "n": n[order]})


def _tile_pairs(batches: Iterator[pd.DataFrame], k: int) -> Iterator[pd.DataFrame]:
    tile, key = None, None
    for rows in batches:
        ij = rows[["i", "j"]].to_numpy()
        cuts = [0, *(np.flatnonzero((ij[1:] != ij[:-1]).any(axis=1)) + 1), len(rows)]
        for start, end in zip(cuts[:-1], cuts[1:]):
            if start == end:
                continue
            if key != tuple(ij[start]):
                if tile is not None and tile.total is not None:
                    yield tile.pairs(k)
                key = tuple(ij[start])
                tile = _Tile(*key)
            tile.add(rows.iloc[start:end])
    if tile is not None and tile.total is not None:
        yield tile.pairs(k)


def top_common_neighbors(edges: DataFrame, nodes: DataFrame, k: int, src: str = "src", dst: str = "dst",
                         hub_degree: int = HUB_DEGREE, tile: int = TILE) -> DataFrame:
    """(a, b, n): the first ``k`` ordered pairs of distinct, not adjacent ``nodes`` by number of common neighbours, then by ids.

    ``edges`` hold every edge once in both directions (integer ids).  Fewer
    rows if there are fewer pairs with a common neighbour; none without edges.

    Only if some neighbour has more than ``hub_degree`` of the nodes are there
    tiles.  Blocks hold nodes of about as many hubs (to a power of two), so a
    bound of a tile is known before it is filled: the fewer hubs of its two
    blocks plus its largest count by other neighbours.  Tiles whose bound is
    under the k-th largest count by other neighbours alone are left out, which
    loses no pair of the first k.  A node's hubs are rows, not a list.
    """
    spark, whole = edges.sparkSession, edges.select(F.col(src).alias("a"), F.col(dst).alias("f"))
    keep = nodes.select(F.col(nodes.columns[0]).alias("a")).distinct()
    e = whole.join(keep, "a", "left_semi")
    store = RoundStore(spark, "hubs")
    hubs = store.put_rows(e.groupBy("f").agg(F.count(F.lit(1)).alias("d")).where(F.col("d") > hub_degree).select("f"))
    if hubs is None:
        return _first(common_neighbors(edges, nodes, True, src, dst), k)

    adjacent = whole.where(F.col("a") < F.col("f")).withColumnRenamed("f", "b")
    light = e.join(hubs, "f", "left_anti")
    counted = store.put(light.join(light.withColumnRenamed("a", "b"), "f").where(F.col("a") < F.col("b")).groupBy("a", "b")
                        .agg(F.count(F.lit(1)).alias("n")).join(adjacent, ["a", "b"], "left_anti"))
    shared = store.put(e.join(hubs, "f", "left_semi").withColumnRenamed("a", "x"))
    per = shared.groupBy("x").agg(F.count(F.lit(1)).alias("hubs")).withColumn("level", F.floor(F.log2("hubs")).cast("int"))
    levels = per.groupBy("level").agg(F.count(F.lit(1)).alias("m"), F.max("hubs").alias("most")).orderBy("level").collect()  # at most 64
    parts = {r["level"]: -(-r["m"] // tile) for r in levels}
    first = dict(zip(parts, np.cumsum([0, *parts.values()]).tolist()))
    of_level = [F.create_map(*[F.lit(v) for pair in d.items() for v in pair])[F.col("level")] for d in (first, parts)]
    blocks = store.put(per.select("x", (of_level[0] + F.pmod(F.xxhash64("x"), of_level[1])).cast("long").alias("block")))

    # pairs of nodes as places in tiles: the block of smaller number is side x
    def placed(pairs: DataFrame) -> DataFrame:
        at = (pairs.join(blocks.select(F.col("x").alias("a"), F.col("block").alias("p")), "a")
              .join(blocks.select(F.col("x").alias("b"), F.col("block").alias("q")), "b"))
        turned = F.col("p") > F.col("q")
        return at.select(F.least("p", "q").alias("i"), F.greatest("p", "q").alias("j"), F.when(turned, F.col("b")).otherwise(F.col("a")).alias("x"),
                         F.when(turned, F.col("a")).otherwise(F.col("b")).alias("y"), *[c for c in pairs.columns if c == "n"])

    inside = store.put(placed(counted))
    known = counted.orderBy(F.desc("n")).limit(k).agg(F.when(F.count(F.lit(1)) == k, F.min("n")).otherwise(1).alias("n")).first()["n"]
    ranges = spark.createDataFrame([(first[r["level"]], parts[r["level"]], r["most"]) for r in levels], "lo long, m long, most long")
    most = ranges.select(F.explode(F.sequence("lo", F.col("lo") + F.col("m") - 1)).alias("i"), "most")
    tiles = store.put(most.withColumn("j", F.explode(F.sequence("i", F.lit(sum(parts.values()) - 1).cast("long"))))
                      .join(most.select(F.col("i").alias("j"), F.col("most").alias("other")), "j")
                      .join(inside.groupBy("i", "j").agg(F.max("n").alias("n")), ["i", "j"], "left")
                      .where(F.least("most", "other") + F.coalesce("n", F.lit(0)) >= known).select("i", "j"))

    def rows(df: DataFrame, kind: int, side: int = 0) -> DataFrame:
        df = df.withColumns({"kind": F.lit(kind), "side": F.lit(side)})
        fields = [c.split() for c in _ROW.split(", ")]
        return df.select(*[(F.col(c) if c in df.columns else F.lit(0)).cast(t).alias(c) for c, t in fields])

    members = shared.withColumnRenamed("f", "hub").join(blocks, "x")
    stream = [rows(df.withColumnRenamed("block", name).join(tiles, name), kind, side)
              for side, name in enumerate("ij") for df, kind in ((blocks, ROSTER), (members, SHARED))]
    stream += [rows(inside.join(tiles, ["i", "j"], "left_semi"), COUNTED),
               rows(placed(adjacent).join(tiles, ["i", "j"], "left_semi"), LEFT_OUT)]
    heavy = (reduce(DataFrame.unionByName, stream).repartition("i", "j").sortWithinPartitions("i", "j", "kind", "hub")
             .mapInPandas(lambda batches: _tile_pairs(batches, k), "a long, b long, n long"))
    # pairs without a hub on both sides
    plain = (counted.join(blocks.select(F.col("x").alias("a"), F.lit(1).alias("p")), "a", "left")
             .join(blocks.select(F.col("x").alias("b"), F.lit(1).alias("q")), "b", "left")
             .where(F.col("p").isNull() | F.col("q").isNull()).select("a", "b", "n"))
    both = _first(heavy.unionByName(plain), k)
    return _first(both.unionByName(both.select(F.col("b").alias("a"), F.col("a").alias("b"), "n")), k)
