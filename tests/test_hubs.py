"""First pairs by common neighbours against counting all pairs, with hubs of a third of the nodes."""

import random
from itertools import combinations

import pytest

from graphbi.operators import hubs as H


def _frame(spark, links):
    both = sorted({p for a, b in links for p in ((a, b), (b, a))})
    return spark.createDataFrame(both, "src bigint, dst bigint")


def _plain(links, nodes, k):
    near = {}
    for a, b in links:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    found = []
    for a, b in combinations(sorted(set(nodes)), 2):
        n = len(near.get(a, set()) & near.get(b, set()))
        if n and b not in near.get(a, set()):
            found += [(a, b, n), (b, a, n)]
    return sorted(found, key=lambda r: (-r[2], r[0], r[1]))[:k]


def _graph(seed, size, hubs, extra):
    rnd = random.Random(seed)
    links = {(h, v) for h in range(hubs) for v in range(hubs, size) if rnd.random() < 1 / 3}
    links |= {tuple(sorted(rnd.sample(range(size), 2))) for _ in range(extra)}
    return {(a, b) for a, b in links if a != b}


@pytest.mark.parametrize("seed,hubs,extra,k", [(1, 1, 60, 20), (2, 6, 150, 20), (3, 12, 300, 7), (4, 3, 0, 500), (5, 5, 40, 100000)])
def test_first_pairs_with_hubs(spark, seed, hubs, extra, k):
    links = _graph(seed, 90, hubs, extra)
    nodes = range(0, 90) if seed % 2 else range(0, 90, 2)
    got = H.top_common_neighbors(_frame(spark, links), spark.createDataFrame([(v,) for v in nodes], "node bigint"), k,
                                 hub_degree=8, tile=10).collect()
    assert [tuple(r) for r in got] == _plain(links, nodes, k)


def test_no_hub_no_pair_no_edge(spark):
    links = _graph(6, 40, 2, 30)
    nodes = spark.createDataFrame([(v,) for v in range(40)], "node bigint")
    got = H.top_common_neighbors(_frame(spark, links), nodes, 15).collect()
    assert [tuple(r) for r in got] == _plain(links, range(40), 15)
    assert H.top_common_neighbors(_frame(spark, set()), nodes, 15).count() == 0
    # everyone is adjacent to the hub alone; the hub itself has no partner
    star = {(0, v) for v in range(1, 30)}
    got = H.top_common_neighbors(_frame(spark, star), nodes, 3, hub_degree=8, tile=7).collect()
    assert [tuple(r) for r in got] == [(1, 2, 1), (1, 3, 1), (1, 4, 1)]


def test_rows_of_a_tile_split_over_batches():
    import numpy as np
    import pandas as pd
    rnd = np.random.default_rng(7)
    ones = rnd.random((30, 9)) < 0.4
    rows = [(0, 0, H.ROSTER, 0, s, v, 0, 0) for s in (0, 1) for v in range(30)]
    rows += [(0, 0, H.SHARED, h, s, v, 0, 0) for h in range(9) for s in (0, 1) for v in range(30) if ones[v, h]]
    rows += [(0, 0, H.COUNTED, 0, 0, 3, 8, 50), (0, 0, H.LEFT_OUT, 0, 0, 1, 2, 0)]
    frame = pd.DataFrame(rows, columns=["i", "j", "kind", "hub", "side", "x", "y", "n"])
    want = ones.astype(int) @ ones.astype(int).T
    want[3, 8] += 50
    want[1, 2] = 0
    pairs = sorted(((a, b, want[a, b]) for a in range(30) for b in range(a + 1, 30) if want[a, b]), key=lambda r: (-r[2], r[0], r[1]))
    for size in (1, 7, 64, 10000):
        pieces = (frame.iloc[at:at + size] for at in range(0, len(frame), size))
        got = pd.concat(H._tile_pairs(pieces, 25))
        assert [tuple(r) for r in got.to_numpy()] == pairs[:25]
