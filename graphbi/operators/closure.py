"""Transitive closures along parent links (reply threads, sub-thread deletes).

:func:`thread_roots` doubles ancestor pointers: after k rounds a row points
2^k links up, so a chain of d replies is resolved in about log2(d) rounds.
:func:`descendants` walks one tree level per round from the seeds; the
children are persisted once, AQE broadcasts a small frontier and otherwise
splits a hot parent's partition (skew join).  Rounds are written to shared
storage.

A row that lies near its parent (in the same files) needs no shuffle to get
past it: :func:`shortened` follows such links inside each task, in bounded
chunks of rows, before the first round.  How near rows lie only decides how
many rounds are left, never the result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphbi.operators.rounds import RoundStore
from graphbi.sources.parquet import path_exists

#: Rounds after which a chain is compared with the number of rows, to find cycles.
_CYCLE_ROUND = 6
#: Rows among which a task follows links at a time (about 100 bytes of memory for each).
_NEAR_ROWS = 1 << 21


def _follow(ids: np.ndarray, ups: np.ndarray, passable: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row the first ancestor that isn't a passable row among these, and how many links up it is.

    The ids of passable rows are unique.  A row that leads into a cycle keeps its own link."""
    n = len(ids)
    row = np.flatnonzero(passable)
    row = row[np.argsort(ids[row], kind="stable")]
    if not len(row):
        return ups, np.ones(n, np.int64)
    at = np.minimum(np.searchsorted(ids[row], ups), len(row) - 1)
    nxt = np.append(np.where(ids[row][at] == ups, row[at], n), n)  # n: the parent isn't among these rows
    last, hops = np.arange(n + 1), np.append(np.ones(n, np.int64), 0)  # the row whose link is taken, and links up to its parent
    for _ in range(n.bit_length() + 1):
        if (nxt == n).all():
            break
        inner = nxt != n
        hops[inner] += hops[nxt[inner]]
        last[inner] = last[nxt[inner]]
        nxt = np.where(inner, nxt[nxt], n)
    cyclic = nxt[:n] != n
    return np.where(cyclic, ups, ups[last[:n]]), np.where(cyclic, 1, hops[:n])


def shortened(kids: DataFrame, fixed: DataFrame | None) -> DataFrame:
    """``kids`` (_id, _up) as (_id, _up, _hops), their links led past parents that the same task reads.

    Rows without an id or link are left out.  The ids of ``kids`` are unique but for those in ``fixed`` (_id), which no link is led past."""
    rows = kids.where(F.col("_id").isNotNull() & F.col("_up").isNotNull()).select(F.col("_id").cast("bigint"), F.col("_up").cast("bigint"))
    if fixed is None:
        rows = rows.withColumn("_pass", F.lit(True))
    else:
        rows = (rows.join(fixed.select("_id", F.lit(True).alias("_fixed")), "_id", "left")
                .select("_id", "_up", F.col("_fixed").isNull().alias("_pass")))

    def lead(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count = [], 0

        def chunk() -> pa.RecordBatch:
            ids, ups, passable = (pa.chunked_array([b.column(i) for b in held]).to_numpy() for i in range(3))
            ups, hops = _follow(ids, ups, passable)
            return pa.RecordBatch.from_arrays([pa.array(ids), pa.array(ups), pa.array(hops)], ["_id", "_up", "_hops"])

        for b in batches:
            held.append(b)
            count += b.num_rows
            if count >= _NEAR_ROWS:
                yield chunk()
                held, count = [], 0
        if count:
            yield chunk()

    return rows.mapInArrow(lead, "_id bigint, _up bigint, _hops bigint")


def thread_roots(spark: SparkSession, roots: DataFrame, children: DataFrame, *,
                 id_col: str, parent_col: str, inherit: list[str], near: bool = False) -> DataFrame:
    """Children rows extended with the ``inherit`` columns of their root.

    ``roots`` holds ``id_col`` and ``inherit``; ``children`` holds ``id_col``
    (unique), ``parent_col`` (which references a root or another child) and any
    other attributes.  A child whose chain does not reach a root is dropped, as
    in an inner-join recursion, and so is one that leads into a cycle or is its
    own root.  The result has a ``depth`` column (1 = direct child of a root).

    ``near``: follow links inside the tasks that read the children first, which pays for many rows that lie near their
    parents (ids that are whole numbers).  Ids that repeat or are a root's too are found before, and no link is led past them.

    The loop's state is slim: each child's pointer, how many links up it
    reaches, and the root's columns once the pointer meets a resolved row.
    Resolved rows leave the loop; the open ones are joined with the children on
    the pointer, an inner join whose hot keys AQE can split.
    """
    store = RoundStore(spark, "closure")
    kids = children.select(F.col(id_col).alias("_id"), F.col(parent_col).alias("_up"), F.lit(1).cast("bigint").alias("_hops"))
    if near:
        own = children.select(F.col(id_col).alias("_id"), F.lit(1).alias("_own")).unionByName(roots.select(F.col(id_col).alias("_id"), F.lit(0).alias("_own")))
        fixed = own.groupBy("_id").agg(F.count(F.lit(1)).alias("_n"), F.max("_own").alias("_own")).where((F.col("_n") > 1) & (F.col("_own") == 1))
        kids = shortened(kids, store.put_rows(fixed.where(F.col("_id").isNotNull()).select("_id")))
    tops = roots.select(F.col(id_col).alias("_up"), F.col(id_col).alias("_root"), *inherit)
    state, paths = kids.join(tops, "_up", "left").withColumn("_done", F.col("_root").isNotNull()), []
    state_cols = ["_id", "_up", "_hops", "_root", *inherit]
    schema, limit = state.select(*state_cols).schema, None

    def read(parts: list[str]) -> DataFrame:
        parts = [p for p in parts if path_exists(spark, p)]
        return spark.read.schema(schema).parquet(*parts) if parts else spark.createDataFrame([], schema)

    while True:
        path = store.put_parts(state.select(*state_cols, "_done"), ["_done"])
        paths.append(f"{path}/_done=true")
        open_path = f"{path}/_done=false"
        if not path_exists(spark, open_path):
            break
        if len(paths) >= _CYCLE_ROUND:
            limit = limit if limit is not None else kids.count()
            if 2 ** (len(paths) - 1) >= limit:  # no chain is longer than the number of rows: the rest are cycles
                break
        waiting = read([open_path])
        ahead = read([*paths, open_path]).select(F.col("_id").alias("_up"), F.col("_up").alias("_next"), F.col("_hops").alias("_more"), "_root", *inherit)
        state = (waiting.select("_id", "_up", "_hops").join(ahead, "_up")
                 .select("_id", F.col("_next").alias("_up"), (F.col("_hops") + F.col("_more")).alias("_hops"), "_root", *inherit,
                         F.col("_root").isNotNull().alias("_done")))
    found = read(paths).where(F.col("_id") != F.col("_root")).select("_id", F.col("_hops").cast("int").alias("depth"), *inherit)
    return children.join(found, children[id_col] == found["_id"]).select(*[children[c] for c in children.columns], *inherit, "depth")


def _below(ids: np.ndarray, ups: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """Which rows a chain of links among these rows leads to a seed; of rows with the same id links go through one."""
    if not len(seeds):
        return np.zeros(len(ids), bool)
    stop = np.isin(ids, seeds)
    up, _ = _follow(ids, ups, ~stop & _first(ids))
    return np.isin(up, seeds)


def _first(ids: np.ndarray) -> np.ndarray:
    out = np.zeros(len(ids), bool)
    out[np.unique(ids, return_index=True)[1]] = True
    return out


def near_descendants(seeds: DataFrame, links: DataFrame, *, id_col: str, parent_col: str, tree_col: str) -> DataFrame:
    """Ids of rows of ``links`` that lie below the ``seeds`` ids by links that one task reads: some of the descendants, never others.

    Only trees that hold a seed are read further, dealt by ``tree_col``, with their seeds beside them; a tree of very many rows is cut."""
    own = links.select(F.col(id_col).cast("bigint").alias("_id"), F.col(parent_col).cast("bigint").alias("_up"), F.col(tree_col).alias("_tree"))
    marked = seeds.select(F.col(id_col).cast("bigint").alias("_id"))
    trees = own.join(marked, "_id", "left_semi").select("_tree").distinct()
    rows = (own.join(trees, "_tree", "left_semi").join(marked.distinct().withColumn("_seed", F.lit(True)), "_id", "left")
            .select("_id", "_up", "_tree", F.col("_seed").isNotNull().alias("_seed")).where(F.col("_id").isNotNull())
            .hint("rebalance", "_tree").select("_id", F.coalesce("_up", F.col("_id")).alias("_up"), "_seed", F.col("_up").isNotNull().alias("_link")))

    def lead(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count = [], 0

        def chunk() -> pa.RecordBatch:
            ids, ups, seed, link = (pa.chunked_array([b.column(i) for b in held]).to_numpy() for i in range(4))
            below = np.zeros(len(ids), bool)
            below[link] = _below(ids[link], ups[link], np.unique(ids[seed]))
            return pa.RecordBatch.from_arrays([pa.array(np.unique(ids[below]))], ["_id"])

        for b in batches:
            held.append(b)
            count += b.num_rows
            if count >= _NEAR_ROWS:
                yield chunk()
                held, count = [], 0
        if count:
            yield chunk()

    return rows.mapInArrow(lead, "_id bigint").distinct().select(F.col("_id").cast(links.schema[id_col].dataType).alias(id_col))


def descendants(spark: SparkSession, seeds: DataFrame, links: DataFrame, *,
                id_col: str, parent_col: str, tree_col: str | None = None) -> DataFrame:
    """Ids of all rows of ``links`` below the ``seeds`` ids (seeds excluded).

    ``links`` is (id_col, parent_col).  Ids of earlier rounds are left out,
    so each is visited once and a cycle ends; used by cascading sub-thread
    deletes.

    ``tree_col``: a column of ``links`` (which then has the roots as well, without a parent) that the rows of a tree share; what lies
    below the seeds within a task is then found before the first round, which goes on from there.  Rows that
    share it by mistake, or don't, only change the number of rounds.
    """
    store = RoundStore(spark, "descendants")
    edges = links.where(F.col(parent_col).isNotNull()).select(id_col, parent_col).persist(StorageLevel.MEMORY_AND_DISK)
    frontier = seeds.select(F.col(id_col).alias("_pid")).distinct()
    levels: list[DataFrame] = []
    if tree_col:
        near = store.put_rows(near_descendants(seeds, links, id_col=id_col, parent_col=parent_col, tree_col=tree_col))
        if near is not None:
            levels.append(near)
            frontier = frontier.unionByName(near.select(F.col(id_col).alias("_pid"))).distinct()
    try:
        while True:
            level = (edges.join(frontier, edges[parent_col] == frontier["_pid"])
                     .select(id_col).distinct())
            if levels:
                level = level.join(reduce(DataFrame.union, levels), id_col, "left_anti")
            found = store.put_rows(level)
            if found is None:
                break
            levels.append(found)
            frontier = found.select(F.col(id_col).alias("_pid"))
    finally:
        edges.unpersist()
    return reduce(DataFrame.union, levels) if levels else seeds.select(id_col).limit(0)
