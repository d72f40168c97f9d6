"""Refresh properties, compared on full rows: replays, restarts and failures change nothing."""

import pytest
from pyspark.sql import functions as F

from graphbi.plans import live_store
from graphbi.plans import refresh as R
from graphbi.plans.refresh_queries import batch_deletes, fixture_deletes
from graphbi.session import scratch_path
from graphbi.sources.store import load_graph
from graphbi.streaming.refresh_stream import SnapshotChain, publish_batch, run_available

SF = "/root/testdata/sf0.001"
BATCHES = ["2001-01", "2001-02"]


def _rows(tables, names=None):
    return {n: sorted(map(str, tables[n].select(sorted(tables[n].columns)).collect())) for n in names or [*R.STORED, *R.PRECOMPUTED]}


@pytest.fixture(scope="module")
def graph(spark):
    g = load_graph(spark, SF)
    batched = R.store(spark, R.with_batches(g))
    initial = R.derive(spark, R.snapshot_before(batched, BATCHES[0]))
    static = {t: g[t] for t in R.STATIC}
    return batched, R.store(spark, initial), static


def _chain(spark, graph, root):
    batched, initial, static = graph
    return SnapshotChain(spark, root, {**initial, **static}, {t: df.schema for t, df in batched.items()})


@pytest.fixture(scope="module")
def clean(spark, graph):
    """Rows after each batch, applied one after the other without a restart."""
    root, out = scratch_path(spark, "t-clean"), []
    chain = _chain(spark, graph, root)
    for b in BATCHES:
        publish_batch(spark, root, graph[0], b, batch_deletes(graph[0], b))
        out.append(_rows(run_available(spark, root, chain).current))
    assert out[0]["message"] != out[1]["message"]
    return out


def test_reapplying_inserts_is_a_noop(spark):
    initial, batch = R.initial_and_batch(spark, load_graph(spark, SF))
    once = R.store(spark, R.apply_inserts(spark, initial, batch))
    twice = R.store(spark, R.apply_inserts(spark, once, batch))
    assert _rows(once, R.STORED) == _rows(twice, R.STORED)


def test_deletes_are_idempotent(spark):
    initial, batch = R.initial_and_batch(spark, load_graph(spark, SF))
    ins = R.store(spark, R.apply_inserts(spark, initial, batch))
    deletes = fixture_deletes(ins)
    once = R.store(spark, R.apply_deletes(spark, ins, deletes))
    twice = R.store(spark, R.apply_deletes(spark, once, deletes))
    assert _rows(once, R.STORED) == _rows(twice, R.STORED)
    assert _rows(once, R.STORED) != _rows(ins, R.STORED)


def test_restarted_and_replayed_stream_keeps_earlier_batches(spark, graph, clean):
    root = scratch_path(spark, "t-restart")
    for b, want in zip(BATCHES, clean, strict=True):
        for _ in range(2):  # announced again: its inserts are there twice, the batch is skipped
            publish_batch(spark, root, graph[0], b, batch_deletes(graph[0], b))
            assert _rows(run_available(spark, root, _chain(spark, graph, root)).current) == want
    assert sorted(r[0] for r in spark.read.parquet(f"{root}/applied").select("batch_id").collect()) == BATCHES


def test_in_place_batch_survives_a_failure_after_each_write(spark, graph, clean):
    batched, _, static = graph
    failed = set()

    class Failing(live_store.LiveStore):
        def append(self, t, df):
            super().append(t, df)
            self.fail("append", t)

        def replace(self, t, df):
            super().replace(t, df)
            self.fail("replace", t)

        def fail(self, step, t):
            if (self.batch, step, t) not in failed:
                failed.add((self.batch, step, t))
                raise InterruptedError(f"{step} {t}")

    first = live_store.LiveStore.create(spark, scratch_path(spark, "t-live"), batched, BATCHES[0], static)
    for b, want in zip(BATCHES, clean, strict=True):
        deletes = R.store(spark, batch_deletes(batched, b))
        for _ in range(100):
            store = Failing(spark, first.root, static, first.schemas)  # a new process
            store.batch = b
            try:
                out = live_store.apply_batch_in_place(spark, store, b, R.batch_rows(batched, b), deletes)
                break
            except InterruptedError:
                pass
        assert _rows(out) == want
    assert len(failed) > len(BATCHES) * len(live_store.STORED)
    again = live_store.apply_batch_in_place(spark, first, BATCHES[1], R.batch_rows(batched, BATCHES[1]), deletes)
    assert _rows(again) == clean[1]


def test_deletes_are_read_from_the_batch_partition(spark, graph, clean):
    """A batch without delete files only inserts."""
    root = scratch_path(spark, "t-nodeletes")
    publish_batch(spark, root, graph[0], BATCHES[0], {})
    out = run_available(spark, root, _chain(spark, graph, root)).current
    assert out["person"].count() == graph[0]["person"].where(F.col("batch_id") <= BATCHES[0]).count()
