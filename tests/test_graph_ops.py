"""Iterative graph operators on tiny hand-made graphs with known answers."""

import pytest

from graphbi.operators import graph as G
from graphbi.operators import sssp
from graphbi.operators.closure import descendants, thread_roots


def edges(spark, triples, both=True):
    rows = list(triples)
    if both:
        rows += [(b, a, w) for a, b, w in triples]
    return spark.createDataFrame(rows, "src bigint, dst bigint, w double")


def nodes(spark, ids):
    return spark.createDataFrame([(i,) for i in ids], "node bigint")


def test_shortest_distance_path_and_unreachable(spark):
    e = edges(spark, [(0, 1, 1.0), (1, 2, 2.0), (0, 2, 5.0), (5, 6, 1.0)])
    assert sssp.shortest_distance(spark, e, nodes(spark, [0]), nodes(spark, [2])) == pytest.approx(3.0)
    assert sssp.shortest_distance(spark, e, nodes(spark, [0]), nodes(spark, [6])) is None
    assert sssp.shortest_distance(spark, e, nodes(spark, [2]), nodes(spark, [2])) == 0.0


def test_shortest_distance_is_symmetric(spark):
    e = edges(spark, [(0, 1, 3.0), (1, 2, 1.0), (2, 3, 4.0), (0, 3, 9.0), (1, 3, 7.0)])
    for a, b in [(0, 3), (1, 3), (0, 2)]:
        d1 = sssp.shortest_distance(spark, e, nodes(spark, [a]), nodes(spark, [b]))
        d2 = sssp.shortest_distance(spark, e, nodes(spark, [b]), nodes(spark, [a]))
        assert d1 == pytest.approx(d2)


def test_shortest_pairs_keeps_ties(spark):
    # 0-2 and 1-3 both at distance 2, 0-3 at 3
    e = edges(spark, [(0, 10, 1.0), (10, 2, 1.0), (1, 11, 1.0), (11, 3, 1.0), (0, 3, 3.0)])
    got = {tuple(r) for r in sssp.shortest_pairs(spark, e, nodes(spark, [0, 1]), nodes(spark, [2, 3])).collect()}
    assert got == {(0, 2, 2.0), (1, 3, 2.0)}


def test_hop_ring_disjoint_from_inner_hops(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(6)] + [(i + 1, i) for i in range(6)], "src bigint, dst bigint")
    ring = {r[0] for r in G.hop_ring(chain, nodes(spark, [0]), 3, 4).collect()}
    inner = {r[0] for r in G.hop_ring(chain, nodes(spark, [0]), 0, 2).collect()}
    assert ring == {3, 4} and not ring & inner


def test_triangles_invariant_under_relabelling(spark):
    tri = [(1, 2), (2, 3), (1, 3), (3, 4), (2, 4), (4, 5)]
    df = spark.createDataFrame(tri, "src bigint, dst bigint")
    relabel = spark.createDataFrame([(100 - a, 100 - b) for a, b in tri], "src bigint, dst bigint")
    assert G.count_triangles(df).first()[0] == 2
    assert G.count_triangles(relabel).first()[0] == 2


def test_connected_components(spark):
    df = spark.createDataFrame([(1, 2), (2, 3), (7, 8)], "src bigint, dst bigint")
    got = {tuple(r) for r in G.connected_components(spark, df).collect()}
    assert got == {(1, 1), (2, 1), (3, 1), (7, 7), (8, 7)}


def test_thread_roots_and_descendants(spark):
    roots = spark.createDataFrame([(1, "a")], "id bigint, tag string")
    kids = spark.createDataFrame([(2, 1), (3, 2), (4, 3), (9, 99)], "id bigint, parent bigint")
    out = {(r["id"], r["tag"], r["depth"]) for r in
           thread_roots(spark, roots, kids, id_col="id", parent_col="parent", inherit=["tag"]).collect()}
    assert out == {(2, "a", 1), (3, "a", 2), (4, "a", 3)}
    below = {r[0] for r in descendants(spark, spark.createDataFrame([(2,)], "id bigint"), kids,
                                       id_col="id", parent_col="parent").collect()}
    assert below == {3, 4}


def test_common_neighbors_excludes_friends(spark):
    k = [(1, 3), (2, 3), (1, 4), (2, 4), (1, 2)]
    df = spark.createDataFrame(k + [(b, a) for a, b in k], "src bigint, dst bigint")
    got = G.common_neighbors(df, nodes(spark, [1, 2, 3]), True).collect()
    assert {(r["a"], r["b"], r["n"]) for r in got} == set()
    got = G.common_neighbors(df, nodes(spark, [3, 4]), True).collect()
    assert {(r["a"], r["b"], r["n"]) for r in got} == {(3, 4, 2), (4, 3, 2)}


def test_bfs_levels_end_at_the_bound_or_when_nothing_is_left(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(9)] + [(i + 1, i) for i in range(9)], "src bigint, dst bigint")
    for hops, last in ((0, 0), (2, 2), (6, 6), (20, 9)):
        assert {tuple(r) for r in G.bfs_levels(chain, nodes(spark, [0]), hops).collect()} == {(i, i) for i in range(last + 1)}


def test_khop_counts_a_seed_only_if_reached_again(spark):
    line = spark.createDataFrame([(0, 1), (1, 2), (2, 3), (2, 1)], "src bigint, dst bigint")
    for seeds, k, want in (([0], 2, {1, 2}), ([1], 1, {2}), ([1], 2, {1, 2, 3}), ([0, 1], 1, {1, 2})):
        got = [r[0] for r in G.khop_neighbors(line, nodes(spark, seeds), k).collect()]
        assert sorted(got) == sorted(want)


def test_thread_roots_of_a_chain_takes_few_rounds(spark, monkeypatch):
    """10,000 replies below each other, orphans and a cycle beside them."""
    from graphbi.operators.rounds import RoundStore

    n, rounds = 10000, []
    put = RoundStore.put_parts
    monkeypatch.setattr(RoundStore, "put_parts", lambda self, *a: rounds.append(1) or put(self, *a))
    roots = spark.createDataFrame([(0, "a")], "id bigint, tag string")
    kids = spark.range(1, n + 1).selectExpr("id", "id - 1 as parent").unionByName(
        spark.createDataFrame([(n + 10, n + 11), (n + 12, n + 10), (n + 20, n + 21), (n + 21, n + 20), (n + 30, n)], "id bigint, parent bigint"))
    out = thread_roots(spark, roots, kids, id_col="id", parent_col="parent", inherit=["tag"])
    got = {(r["id"], r["depth"]) for r in out.collect()}
    assert got == {(i, i) for i in range(1, n + 1)} | {(n + 30, n + 1)}
    assert len(rounds) <= 15  # log2 of 10,000 and one


def test_closures_end_on_cycles(spark):
    roots = spark.createDataFrame([(1, "a")], "id bigint, tag string")
    ring = spark.createDataFrame([(2, 1), (3, 2), (1, 3), (8, 7), (7, 8)], "id bigint, parent bigint")
    out = thread_roots(spark, roots, ring, id_col="id", parent_col="parent", inherit=["tag"])
    assert out.columns == ["id", "parent", "tag", "depth"]
    assert {(r["id"], r["depth"]) for r in out.collect()} == {(2, 1), (3, 2)}
    below = descendants(spark, spark.createDataFrame([(2,)], "id bigint"), ring, id_col="id", parent_col="parent")
    assert sorted(r[0] for r in below.collect()) == [1, 2, 3]


def test_negative_weights_are_refused(spark):
    with pytest.raises(ValueError):
        sssp.shortest_distance(spark, edges(spark, [(0, 1, -1.0)]), nodes(spark, [0]), nodes(spark, [1]))


def test_long_conversations_keep_their_turns_apart(spark, tmp_path):
    from graphbi.plans.operator_queries import thread_roots_q

    rows = [(c, t, "user" if t % 2 == 0 else "bot") for c in (1, 2) for t in range(12)] + [(1, t, "user") for t in range(100, 103)]
    spark.createDataFrame(rows, "conv_id bigint, turn int, role string").write.parquet(f"{tmp_path}/conversations.parquet")
    out = thread_roots_q(spark, str(tmp_path)).collect()
    assert len(out) == 22 and len({r["id"] for r in out}) == 22  # turns 100 to 102 have no predecessor
    assert {r["root_id"] >> 32 for r in out if r["id"] >> 32 == 2} == {2}


def test_components_of_a_long_path_loops_and_single_nodes(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(7, 7), (300, 200), (200, 300), (250, 200)]
    df = spark.createDataFrame(edges, "src bigint, dst bigint")
    got = {tuple(r) for r in G.connected_components(spark, df).collect()}
    assert got == {(i, 100) for i in range(100, 161)} | {(7, 7), (200, 200), (250, 200), (300, 200)}
    assert G.connected_components(spark, df.limit(0)).count() == 0


def test_shortest_pairs_of_random_graphs(spark):
    """Against Floyd-Warshall: weights of 0, ties, several components."""
    import random

    for seed in range(2):
        rng, n = random.Random(seed), 24
        triples = [(a, b, float(rng.choice([0, 1, 1, 2, 3, 7]))) for a, b in ((rng.randrange(n), rng.randrange(n)) for _ in range(34)) if a != b]
        dist = {(a, b): 0.0 if a == b else float("inf") for a in range(n) for b in range(n)}
        for a, b, w in triples:
            dist[a, b] = dist[b, a] = min(dist[a, b], w)
        for k in range(n):
            for a in range(n):
                for b in range(n):
                    dist[a, b] = min(dist[a, b], dist[a, k] + dist[k, b])
        src, dst = rng.sample(range(n), 4), rng.sample(range(n), 4)
        best = min(dist[a, b] for a in src for b in dst)
        want = {(a, b, best) for a in src for b in dst if dist[a, b] == best < float("inf")}
        got = {tuple(r) for r in sssp.shortest_pairs(spark, edges(spark, triples), nodes(spark, src), nodes(spark, dst)).collect()}
        assert got == want
        one = sssp.shortest_distance(spark, edges(spark, triples), nodes(spark, src), nodes(spark, dst))
        assert one == (None if best == float("inf") else best)
