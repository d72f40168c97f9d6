"""A chain of batches: few rounds below removed messages, batches published at once, waiting comments kept, batches recorded in order."""

import random

import pytest

from graphbi.operators import closure
from graphbi.operators.rounds import RoundStore
from graphbi.plans import refresh as R
from graphbi.plans.refresh_queries import DELETE_RULES, all_deletes, batch_deletes
from graphbi.session import scratch_path
from graphbi.streaming import refresh_stream as S

MESSAGE = "creationDate timestamp_ntz, MessageId bigint, RootPostId bigint, RootPostLanguage string, content string, length int, CreatorPersonId bigint, ContainerForumId bigint, ParentMessageId bigint"
COMMENT = "id bigint, creationDate timestamp_ntz, CreatorPersonId bigint, ParentPostId bigint, ParentCommentId bigint, length int, content string"
POST = "id bigint, creationDate timestamp_ntz, CreatorPersonId bigint, ContainerForumId bigint, language string, content string, length int"


def _below(spark, seeds, links, **tree):
    got = closure.descendants(spark, spark.createDataFrame([(s,) for s in seeds], "id bigint"),
                              spark.createDataFrame(links, "id bigint, up bigint, tree bigint").repartition(3), id_col="id", parent_col="up", **tree)
    return sorted(r[0] for r in got.collect())


def test_a_long_thread_below_a_removed_message_takes_few_rounds(spark, monkeypatch):
    rounds, put = [], RoundStore.put_rows
    monkeypatch.setattr(RoundStore, "put_rows", lambda self, df: (rounds.append(1), put(self, df))[1])
    links = [(0, None, 0)] + [(i, i - 1, 0) for i in range(1, 200)]
    assert _below(spark, [3], links, tree_col="tree") == list(range(4, 200))
    assert len(rounds) <= 3


@pytest.mark.parametrize("chunk", [4, 1 << 21])
def test_same_ids_below_with_repeats_nulls_cycles_and_wrong_trees(spark, monkeypatch, chunk):
    monkeypatch.setattr(closure, "_NEAR_ROWS", chunk)
    rnd = random.Random(3)
    links = [(i, None, i) for i in range(4)] + [(i, rnd.randrange(max(0, i - 6), i), rnd.choice([i % 4, i % 4, None, 9])) for i in range(4, 80)]
    links += [(20, 2, 2), (20, 2, 2), (None, 5, 1), (90, 91, 1), (91, 92, 1), (92, 90, 1), (93, 93, 1), (None, None, None)]
    for seeds in ([6, 7, 7, 30, 12], [90, 1], [93], [500], [None, 8], []):
        assert _below(spark, seeds, links, tree_col="tree") == _below(spark, seeds, [x for x in links if x[1] is not None])


def test_batches_published_at_once_are_those_published_one_by_one(spark):
    when = "2001-01-05"
    named = {"person": ["id"], "forum": ["id"], "post": ["id"], "comment": ["id"], "person_likes_message": ["PersonId", "MessageId"],
             "forum_hasmember": ["ForumId", "PersonId"], "person_knows_person": ["Person1Id", "Person2Id"]}
    months = ["2000-12", "2001-01", "2001-02", "2001-03", None]
    batched = {}
    for i, (t, names) in enumerate(named.items()):
        rows = [(*[k * DELETE_RULES.get(t, 1) if len(names) == 1 else k for _ in names], when, months[(k + i) % 5]) for k in range(120)]
        batched[t] = spark.createDataFrame(rows, ", ".join([*[f"{c} bigint" for c in names], "at string", "batch_id string"]))
    ids, one, all_ = R.batch_ids(batched), scratch_path(spark, "t-one"), scratch_path(spark, "t-all")
    assert ids == months[1:4]
    for b in ids:
        S.publish_batch(spark, one, batched, b, batch_deletes(batched, b))
    S.publish_batches(spark, all_, batched, ids, all_deletes(batched, ids))
    read = lambda root, p: sorted(map(str, spark.read.parquet(f"{root}/{p}").collect()))
    parts = ["manifest", *[f"inserts/{t}" for t in batched], *[f"deletes/{kind}" for kind in R.DELETE_SCHEMAS]]
    assert {p: read(one, p) for p in parts} == {p: read(all_, p) for p in parts}


def test_comments_that_wait_are_kept_from_batch_to_batch(spark):
    def tables(posts, comments):
        out = R.Tables({t: spark.createDataFrame([], ", ".join(f"{c} bigint" for c in keys)) for t, keys in R.KEYS.items()})
        out["post"] = spark.createDataFrame([(i, None, 1, 1, "en", "p", 1) for i in posts], POST)
        out["comment"] = spark.createDataFrame([(i, None, 1, p, c, 1, "c") for i, p, c in comments], COMMENT)
        return out

    def start():
        t = tables([1], [(10, 1, None), (11, None, 99)])  # 11 waits for 99
        t["message"] = spark.createDataFrame([(None, 1, 1, "en", "p", 1, 1, 1, None), (None, 10, 1, "en", "c", 1, 1, 1, 1)], MESSAGE)
        t["message_hastag"] = spark.createDataFrame([], "MessageId bigint, TagId bigint")
        return t

    batches = [tables([], [(98, 2, None), (12, None, 11), (13, None, 10)]), tables([2], [(99, None, 98), (14, None, 77)]), tables([], [(15, None, 99)])]
    plain, kept, seen = start(), R.with_waiting(spark, start()), []
    for ins in batches:
        plain, kept = R.apply_inserts(spark, plain, ins), R.apply_inserts(spark, kept, ins, together=True)
        assert sorted(map(str, kept["message"].collect())) == sorted(map(str, plain["message"].collect()))
        seen.append(sorted(r["id"] for r in kept[R.WAITING].collect()))
    assert seen == [[11, 12, 98], [14], [14]]
    gone = R.delete_messages(spark, kept, spark.createDataFrame([(14,), (98,)], "id bigint"))
    assert gone[R.WAITING].count() == 0 and sorted(r["MessageId"] for r in gone["message"].collect()) == [1, 2, 10, 13]


def test_a_batch_is_recorded_when_its_precomputations_are_stored_and_in_order(spark, monkeypatch):
    root, done = scratch_path(spark, "t-order"), []
    chain = S.SnapshotChain(spark, root, {"n": 0}, {})
    monkeypatch.setattr(R, "refresh_tables", lambda spark, tables, ins, deletes, snap: (done.append(f"tables {ins}"), {"n": tables["n"] + 1})[1])

    def precomputed(spark, tables, snap):
        if tables["n"] == 3 and "lost" not in done:
            done.append("lost")
            raise InterruptedError("lost")
        return {"p": tables["n"]}
    monkeypatch.setattr(R, "refresh_precomputed", precomputed)
    recorded = lambda: sorted(r["batch_id"] for r in S._applied(spark, root).collect())
    with pytest.raises(InterruptedError), chain.chained():
        for b in ("a", "b", "c"):
            chain.apply_batch(b, b, {})
    assert recorded() == ["a", "b"]
    with chain.chained():
        chain.apply_batch("c", "c", {})
    assert recorded() == ["a", "b", "c"] and chain.current["p"] == chain.current["n"]
