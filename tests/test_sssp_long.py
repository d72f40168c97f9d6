"""Shortest distances over long ways: the graph is contracted, the distances stay."""

import heapq
import random

from graphbi.operators import sssp
from graphbi.operators.rounds import RoundStore


def _plain(edges, sources, targets):
    out, heap, best = {}, [(0.0, s) for s in sources], {}
    for a, b, w in edges:
        if a is not None and b is not None:
            out.setdefault(a, []).append((b, w))
    while heap:
        d, v = heapq.heappop(heap)
        if v in best:
            continue
        best[v] = d
        for x, w in out.get(v, ()):
            heapq.heappush(heap, (d + w, x))
    return min((best[t] for t in targets if t in best), default=None)


def _found(spark, edges, sources, targets):
    nodes = lambda ids: spark.createDataFrame([(i,) for i in ids], "node bigint")
    return sssp.shortest_distance(spark, spark.createDataFrame(edges, "src bigint, dst bigint, w double").coalesce(2), nodes(sources), nodes(targets))


def test_a_long_chain_takes_few_rounds(spark, monkeypatch):
    rounds, put = [], RoundStore.put
    monkeypatch.setattr(RoundStore, "put", lambda self, *a: (rounds.append(1), put(self, *a))[1])
    edges = [e for i in range(300) for e in ((i, i + 1, 1.0 + i % 3), (i + 1, i, 1.0 + i % 3))]
    assert _found(spark, edges, [0], [300]) == _plain(edges, [0], [300])
    assert len(rounds) < 70  # 150 rounds from both ends before


def test_distances_stay_with_repeats_loops_and_parts(spark, monkeypatch):
    monkeypatch.setattr(sssp, "_LONG_SEARCH", 2)
    rnd = random.Random(1)
    edges = [(i, i + 1, float(rnd.randrange(0, 9))) for i in range(60)]
    edges += [(rnd.randrange(60), rnd.randrange(60), float(rnd.randrange(20, 90))) for _ in range(12)]  # short cuts
    edges += [(70 + i, 70 + (i + 1) % 7, 1.0) for i in range(7)] + [(5, 5, 0.0), (None, 4, 1.0), (7, 8, 2.0), (7, 8, 1.0)]
    edges += [(b, a, w) for a, b, w in edges]  # both directions
    for sources, targets in (([0], [55]), ([3, 20], [58, 41]), ([0], [75]), ([9], [9, 30])):
        assert _found(spark, edges, sources, targets) == _plain(edges, sources, targets), (sources, targets)
