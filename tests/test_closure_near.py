"""Links inside a task are followed before the first round: fewer rounds, same rows."""

import random

import numpy as np
import pytest

from graphbi.operators import closure
from graphbi.operators.rounds import RoundStore


def _resolved(spark, roots, kids, near):
    r = spark.createDataFrame(roots, "id bigint, lang string")
    k = spark.createDataFrame(kids, "id bigint, up bigint, text string").repartition(3)
    got = closure.thread_roots(spark, r.withColumnRenamed("lang", "RootLang"), k, id_col="id", parent_col="up", inherit=["RootLang"], near=near)
    return sorted(map(str, got.collect()))


def test_a_thread_that_one_task_reads_takes_one_round(spark, monkeypatch):
    rounds, put = [], RoundStore.put_parts
    monkeypatch.setattr(RoundStore, "put_parts", lambda self, df, by: (by == ["_done"] and rounds.append(by), put(self, df, by))[1])
    r = spark.createDataFrame([(0, "en")], "id bigint, lang string")
    kids = spark.range(1, 100, 1, 1).selectExpr("id", "id - 1 AS up")
    got = closure.thread_roots(spark, r, kids, id_col="id", parent_col="up", inherit=["lang"], near=True)
    assert sorted((x["id"], x["lang"], x["depth"]) for x in got.collect()) == [(i, "en", i) for i in range(1, 100)]
    assert len(rounds) == 1


@pytest.mark.parametrize("chunk", [4, 1 << 21])
def test_same_rows_with_repeats_nulls_cycles_and_ids_of_roots(spark, monkeypatch, chunk):
    monkeypatch.setattr(closure, "_NEAR_ROWS", chunk)
    rnd = random.Random(5)
    roots = [(i, f"l{i}") for i in range(5)] + [(2, "again"), (None, "none"), (50, "inner")]
    kids = [(i, rnd.randrange(max(0, i - 9), i), f"t{i}") for i in range(5, 90)]
    kids += [(20, 19, "copy"), (20, 3, "other"), (None, 4, "no id"), (95, None, "no parent"), (96, 1000, "lost"), (3, 1, "root"), (2, 2, "own")]
    kids += [(100, 101, "a"), (101, 102, "b"), (102, 100, "c"), (103, 100, "d"), (104, 104, "e"), (None, None, "f")]
    assert _resolved(spark, roots, kids, True) == _resolved(spark, roots, kids, False) != []


def test_follow_stops_at_rows_that_must_not_be_passed():
    ids, ups = np.array([1, 2, 3, 4, 5]), np.array([0, 1, 2, 3, 4])
    up, hops = closure._follow(ids, ups, np.array([True, True, False, True, True]))
    assert up.tolist() == [0, 0, 0, 3, 3] and hops.tolist() == [1, 2, 3, 1, 2]
    up, hops = closure._follow(np.array([7, 8]), np.array([8, 7]), np.array([True, True]))
    assert up.tolist() == [8, 7] and hops.tolist() == [1, 1]
