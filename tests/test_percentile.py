"""Exact percentiles against sorted lists."""

import datetime as dt
import math
import random

import pytest

from graphbi.operators.percentile import exact_percentiles

P = [0.0, 0.1, 0.5, 0.99, 1.0]


def plain(rows, fractions):
    groups, out = {}, []
    for k, v in rows:
        if v is not None:
            groups.setdefault(k, []).append(v)
    for k, values in groups.items():
        values.sort(key=lambda v: (isinstance(v, float) and math.isnan(v), v if v == v else 0))
        out += [(k, p, values[max(math.ceil(p * len(values)), 1) - 1]) for p in fractions]
    return sorted(out, key=repr)


RNG = random.Random(3)
CASES = {
    "bigint": [("a" if RNG.random() < 0.6 else RNG.choice("bcd"), RNG.choice([RNG.getrandbits(62) - 2 ** 61, 2 ** 62 + RNG.randrange(900), RNG.randrange(9)]))
               for _ in range(4000)] + [("one", 5), (None, 7), (None, 9), ("null", None)],
    "double": [("a", RNG.choice([1.5, RNG.lognormvariate(0, 40), -RNG.random(), float("inf"), float("-inf"), float("nan"), 1e308, -1e308])) for _ in range(3000)],
    "date": [(RNG.choice("ab"), dt.date(2000, 1, 1) + dt.timedelta(RNG.randrange(5000))) for _ in range(2000)],
    "timestamp_ntz": [(RNG.choice("ab"), dt.datetime(2000, 1, 1) + dt.timedelta(microseconds=RNG.randrange(10 ** 15))) for _ in range(2000)],
}


@pytest.mark.parametrize("kind", CASES)
def test_percentiles(spark, kind):
    rows = CASES[kind]
    df = spark.createDataFrame(rows, f"k string, v {kind}")
    out = exact_percentiles(df, "v", P, ["k"], bins=64, few=20)
    assert [repr(x) for x in sorted(map(tuple, out.collect()), key=repr)] == [repr(x) for x in plain(rows, P)]  # NaN differs from itself


def test_without_groups_and_empty(spark):
    df = spark.range(100_000).selectExpr("id * id as v")
    assert [(r.fraction, r.value) for r in exact_percentiles(df, "v", [0.5]).collect()] == [(0.5, 49_999 ** 2)]
    assert exact_percentiles(df.limit(0), "v", [0.5]).count() == 0
