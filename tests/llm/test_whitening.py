"""Whitening against exact integers and numpy's eigenvectors."""

import math
from fractions import Fraction

import numpy as np
import pytest

from graphbi.llm import whitening as W

DDL = "vec_id bigint, embedding array<double>, n string, component int"
NAMES = ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def plain(rows, components=16):
    """{vec_id: [(component, n, deviation, whitened, explained)]} of rows with one length, in exact fractions up to the eigenvectors."""
    usable = [(i, tuple(math.floor(64 * c) + 1_000_000 for c in v)) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    fit = sorted({x for _, x in usable})
    n, d = len(fit), len(fit[0])
    sums = [sum(x[j] for x in fit) for j in range(d)]
    # entries times n are whole numbers, so the covariance is exact until the last division
    centred = [[n * x[j] - sums[j] for j in range(d)] for x in fit]
    v = np.array([[float(Fraction(sum(r[a] * r[b] for r in centred), n ** 3)) for b in range(d)] for a in range(d)])
    values, vectors = np.linalg.eigh(v)
    values, vectors = values[::-1], vectors[:, ::-1]
    k = min(components, int((values > d * 2.3e-16 * values[0]).sum()) if values[0] > 0 else 0)
    out = []
    for i, x in usable:
        off = [n * a - s for a, s in zip(x, sums, strict=True)]
        y = np.array([float(Fraction(o, n)) for o in off])
        out += [(i, c + 1, n, sum(o * o for o in off), float(y @ vectors[:, c] / math.sqrt(values[c])), values[c] / values.sum()) for c in range(k)]
    return out


def same(got, want):
    key = lambda r: (r[0] is None, r[0] or 0, r[1], abs(r[4]))
    got, want = sorted((tuple(r) for r in got), key=key), sorted(want, key=key)
    assert len(got) == len(want)
    signs = {}
    for g, w in zip(got, want, strict=True):
        assert g[:3] == w[:3] and g[3] == (w[3] if w[3] < 1 << 63 else None)
        assert abs(abs(g[4]) - abs(w[4])) < 1e-7 * (1 + abs(w[4])) and abs(g[5] / w[5] - 1) < 1e-9 and g[6] < 1e-9
        if abs(w[4]) > 1e-3:
            signs.setdefault(g[1], set()).add(g[4] * w[4] > 0)
    assert all(len(s) == 1 for s in signs.values())


def vectors(n, d, seed=1):
    rng = np.random.default_rng(seed)
    mixed = rng.normal(size=(n, d)) * np.linspace(1, 3, d) @ rng.normal(size=(d, d))
    return [[float(c) for c in row] for row in mixed]


def frame(spark, rows):
    return spark.createDataFrame([(i, v, "x", 7) for i, v in rows], DDL).repartition(3)


def test_awkward_rows(spark):
    good = vectors(60, 5)
    rows = list(enumerate(good)) + [(None, good[3]), (7, good[7]), (7, good[7]), (8, good[0])]
    odd = [(100, None), (101, []), (102, [1.0, None, 2.0, 3.0, 4.0]), (103, [math.nan] * 5), (104, [1.0, math.inf, 0.0, 0.0, 0.0]), (105, [1.0, 2.0]), (106, [1.0])]
    out = W.whiten(frame(spark, rows + odd))
    assert out.columns == NAMES
    same(out.collect(), plain(rows))


def test_hot_vector_counts_once(spark):
    good = vectors(40, 3)
    rows = list(enumerate(good)) + [(1000 + i, good[5]) for i in range(400)]
    same(W.whiten(frame(spark, rows)).collect(), plain(rows))


def test_rank_and_size(spark):
    base = vectors(50, 2)
    flat = [(i, [a, a, b, 0.5, b]) for i, (a, b) in enumerate(base)]  # rank 2, a constant and equal dimensions
    got = W.whiten(frame(spark, flat)).collect()
    assert {r.component for r in got} == {1, 2}
    same(got, plain(flat))
    big = [(i, [c * 1e6 for c in v]) for i, v in enumerate(vectors(30, 4, 3))]
    same(W.whiten(frame(spark, big)).collect(), plain(big))
    huge = [(i, [c * 1e30 for c in v]) for i, v in enumerate(vectors(12, 2, 5))]
    assert all(r.deviation is None for r in W.whiten(frame(spark, huge)).collect())
    assert W.whiten(frame(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])).count() == 0
    none = frame(spark, flat).limit(0)
    assert W.whiten(none).count() == 0 and W.whiten(none).columns == NAMES


def test_factors():
    rng = np.random.default_rng(3)
    for d, rank in ((1, 1), (5, 5), (24, 24), (24, 7), (33, 33)):
        a = rng.normal(size=(d, rank)) * np.logspace(0, -5, rank)
        v = a @ a.T
        factor = W.pivoted_cholesky(v)
        assert factor.shape == (d, rank) and np.allclose(factor @ factor.T, v, atol=1e-14 * v.max())
        values, unit = W.one_sided_jacobi(factor)
        assert np.allclose(unit.T @ unit, np.eye(rank), atol=1e-13)
        assert np.allclose(unit * values @ unit.T, v, atol=1e-13 * v.max()) and (np.diff(values) <= 0).all()
    assert W.pivoted_cholesky(np.zeros((3, 3))).shape == (3, 0)


def test_packed_vectors():
    m = np.array([[1, -128], [127, 0], [128, 0], [-32769, 5], [1 << 40, -1], [1, -128]])
    keys = [k for block in W.pack(m) for k in block.to_pylist()]
    assert len(set(keys)) == 5 and sorted(map(tuple, W.unpack(__import__("pyarrow").array(keys)).tolist())) == sorted(map(tuple, m.tolist()))


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    got = W.op12_whitening(spark, sf).collect()
    assert len({r.identity_error for r in got}) == 1 and got[0].identity_error < 1e-10
    same(got, plain(rows))
