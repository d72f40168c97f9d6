"""What a refresh writes: unions have no files of their own, tables and published files are compressed."""

import os

import pytest

from graphbi.plans import live_store as L
from graphbi.plans import refresh as R
from graphbi.plans import workload_queries as WQ
from graphbi.session import scratch_path
from graphbi.sources import workload as W


def test_unions_of_stored_tables_have_no_files(spark):
    assert {"message_hastag", "knows"} <= {*R.STORED} - {*R.FILES} and not {"message_hastag", "knows"} & {*L.STORED}
    tags = lambda rows: spark.createDataFrame(rows, "MessageId bigint, TagId bigint")
    t = R.with_unions({"post_hastag": tags([(1, 2), (1, 2)]), "comment_hastag": tags([(3, None)]),
                       "person_knows_person": spark.createDataFrame([(None, 1, 2)], "creationDate timestamp_ntz, Person1Id bigint, Person2Id bigint")})
    assert sorted(map(str, t["message_hastag"].collect())) == sorted(map(str, tags([(1, 2), (1, 2), (3, None)]).collect()))
    assert sorted((r.Person1Id, r.Person2Id) for r in t["knows"].collect()) == [(1, 2), (2, 1)]


def test_stored_tables_are_compressed(spark):
    root = scratch_path(spark, "t-zstd")
    R.store(spark, {"a": spark.range(9)}, root)
    assert [f for f in os.listdir(f"{root}/a") if f.endswith(".parquet")] == [f for f in os.listdir(f"{root}/a") if f.endswith(".zstd.parquet")] != []


@pytest.fixture
def person(spark):
    return spark.createDataFrame([(1, "2000-12"), (2, "2001-01"), (3, "2001-02"), (4, None)], "id bigint, batch_id string")


def test_published_inserts_are_compressed_and_read_back(spark, person, monkeypatch):
    entity = W.Entity("id bigint", "person", {"id": "id"})
    monkeypatch.setattr(W, "DYNAMIC_ENTITIES", {"Person": entity})
    monkeypatch.setattr(W, "ENTITIES", {"Person": entity})
    monkeypatch.setattr(W, "DELETES", {})
    monkeypatch.setattr(WQ, "_messages", lambda batched: {})
    monkeypatch.setattr(WQ, "batch_deletes", lambda batched, b: {})
    root = scratch_path(spark, "t-gz")
    WQ.publish_batches(spark, root, {"person": person}, ["2001-03"])
    folder = f"{root}/inserts/dynamic/Person/batch_id=2001-03"
    assert [f for f in os.listdir(folder) if f.endswith(".csv")] == [] != [f for f in os.listdir(folder) if f.endswith(".csv.gz")]
    assert sorted(r[0] for r in W.read_files(spark, [folder], entity.schema).collect()) == [2, 3]


def test_tables_that_are_laid_out_are_not_dealt_again(spark, person, monkeypatch):
    dealt, deal = [], L._by_batch
    monkeypatch.setattr(L, "_by_batch", lambda df: (dealt.append(1), deal(df))[1])
    monkeypatch.setattr(L.views, "message_union", lambda spark, post, comment: spark.createDataFrame([(None,)], "creationDate timestamp_ntz"))
    monkeypatch.setattr(L, "Precomputed", lambda spark, root: type("P", (), {"start": lambda self, t: None})())
    monkeypatch.setattr(L.LiveStore, "tables", lambda self: {})
    for laid_out, times in ((True, 1), (False, 4)):
        dealt.clear()
        store = L.LiveStore.create(spark, scratch_path(spark, "t-laid"), {t: person for t in ("person", "post", "comment")}, "2001-02", {}, laid_out)
        assert len(dealt) == times and sorted(map(tuple, store.raw("person").collect())) == [(1, "2000-12"), (2, "2001-01")]
