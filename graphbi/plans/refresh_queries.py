"""Registered runs of the refresh operators: batch 2001-01 applied to the
snapshot of everything created before it."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphbi.plans import refresh as R
from graphbi.session import configure, scratch_path
from graphbi.sources.store import load_graph

DELETION_DATE = "2001-02-01"
NODES = ["person", "forum", "post", "comment"]
EDGES = ["person_knows_person", "forum_hasmember", "person_hasinterest", "person_studyat", "person_workat"]
MERGED = ["post_hastag", "comment_hastag", "message_hastag", "person_likes_message"]
ALL = NODES + EDGES + MERGED + ["message", "knows"]


# Delete-candidate rules of the refresh fixture (FIXTURES.md); an entity goes if its id, an edge if the
# sum of its two ends, is a multiple.
DELETE_RULES = {"person": 97, "forum": 41, "post": 530, "comment": 59, "likes": 31, "membership": 37, "knows": 43}
_DELETE_ENDS = {"likes": ("person_likes_message", "PersonId", "MessageId"), "membership": ("forum_hasmember", "ForumId", "PersonId"),
                "knows": ("person_knows_person", "Person1Id", "Person2Id")}


def fixture_deletes(tables: Mapping[str, DataFrame], deletion_date: str = DELETION_DATE, keep: list[str] | None = None) -> R.Tables:
    """Delete candidates of the refresh fixture, by kind; ``keep``: further columns of the tables."""
    when, out = F.to_timestamp(F.lit(deletion_date)).alias("deletionDate"), R.Tables()
    for kind, n in DELETE_RULES.items():
        table, *ends = _DELETE_ENDS.get(kind, (kind, "id"))
        named = [F.col(c).alias(a) for c, a in zip(ends, ("src", "trg") if len(ends) == 2 else ("id",), strict=True)]
        named += keep or []
        out.later(kind, lambda table=table, ends=ends, n=n, named=named: tables[table].where(sum(map(F.col, ends)) % n == 0).select(when, *named))
    return out


def batch_deletes(batched: Mapping[str, DataFrame], batch_id: str) -> R.Tables:
    """The fixture's candidates of one batch: among all rows that arrived until then."""
    return fixture_deletes(R.Tables(batched).each(lambda t, df: df.where(F.col("batch_id") <= batch_id)))


def _inserted(spark: SparkSession, sf_dir: str):
    configure(spark)
    g = load_graph(spark, sf_dir)
    initial, batch = R.initial_and_batch(spark, g)
    return R.apply_inserts(spark, initial, batch)


def refresh_insert_nodes(spark, sf_dir):
    return R.table_counts(_inserted(spark, sf_dir), NODES)


def refresh_insert_edges(spark, sf_dir):
    return R.table_counts(_inserted(spark, sf_dir), EDGES)


def refresh_insert_merged(spark, sf_dir):
    return R.table_counts(_inserted(spark, sf_dir), MERGED)


def refresh_threads_incremental(spark, sf_dir):
    return _inserted(spark, sf_dir)["message"]


def _after(spark, sf_dir, step) -> dict[str, DataFrame]:
    t = _inserted(spark, sf_dir)
    return step(t, fixture_deletes(t))


def delete_person_q(spark, sf_dir):
    out = _after(spark, sf_dir, lambda t, c: R.delete_person(t, c["person"])[0])
    counts = R.table_counts(out, ["person", "person_likes_message", "person_workat", "person_studyat",
                                  "person_knows_person", "person_hasinterest", "forum_hasmember"])
    no_mod = out["forum"].where(F.col("ModeratorPersonId").isNull()).select(
        F.lit("forum_without_moderator").alias("table_name"), F.count(F.lit(1)).alias("row_count"))
    return counts.unionByName(no_mod)


def _delete_likes_of(spark, sf_dir, posts: bool) -> DataFrame:
    """Like candidates of posts or of comments only, removed; a comment whose parent hasn't arrived counts as well."""
    def step(t, c):
        own = t["post" if posts else "comment"].select(F.col("id").alias("trg"))
        return R.delete_likes(t, c["likes"].join(own, "trg", "left_semi"))
    return R.table_counts(_after(spark, sf_dir, step), ["person_likes_message"])


def delete_post_like_q(spark, sf_dir):
    return _delete_likes_of(spark, sf_dir, posts=True)


def delete_comment_like_q(spark, sf_dir):
    return _delete_likes_of(spark, sf_dir, posts=False)


def delete_forum_q(spark, sf_dir):
    t = _inserted(spark, sf_dir)
    out, posts = R.delete_forum(t, fixture_deletes(t)["forum"])
    out["cascaded_posts"] = posts
    return R.table_counts(out, ["forum", "forum_hasmember", "cascaded_posts"])


def delete_membership_q(spark, sf_dir):
    return R.table_counts(_after(spark, sf_dir, lambda t, c: R.delete_membership(t, c["membership"])),
                          ["forum_hasmember"])


def delete_post_thread_q(spark, sf_dir):
    return R.table_counts(_after(spark, sf_dir, lambda t, c: R.delete_messages(spark, t, c["post"])),
                          ["message", "post", "comment", "person_likes_message", "message_hastag"])


def delete_comment_subthread_q(spark, sf_dir):
    return R.table_counts(_after(spark, sf_dir, lambda t, c: R.delete_messages(spark, t, c["comment"])),
                          ["message", "comment", "person_likes_message", "message_hastag"])


def delete_friendship_q(spark, sf_dir):
    return R.table_counts(_after(spark, sf_dir, lambda t, c: R.delete_friendship(t, c["knows"])),
                          ["person_knows_person"])


def refresh_batch_q(spark, sf_dir):
    configure(spark)
    g = load_graph(spark, sf_dir)
    batched = R.stored_batches(spark, g)
    initial, batch = R.initial_and_batch(spark, g, batched=batched)
    out = R.refresh_batch(spark, initial, batch, batch_deletes(batched, R.FIRST_BATCH), scratch_path(spark, "refresh"))
    return R.table_rows(out)


QUERIES = {
    "refresh_insert_nodes": refresh_insert_nodes,
    "refresh_insert_edges": refresh_insert_edges,
    "refresh_insert_merged": refresh_insert_merged,
    "refresh_threads_incremental": refresh_threads_incremental,
    "delete_person": delete_person_q,
    "delete_post_like": delete_post_like_q,
    "delete_comment_like": delete_comment_like_q,
    "delete_forum": delete_forum_q,
    "delete_membership": delete_membership_q,
    "delete_post_thread": delete_post_thread_q,
    "delete_comment_subthread": delete_comment_subthread_q,
    "delete_friendship": delete_friendship_q,
    "refresh_batch": refresh_batch_q,
}


def _stored_batches(spark, sf_dir):
    """The graph's dynamic tables with their batch ids, stored once for all batches, and the static tables."""
    configure(spark)
    g = load_graph(spark, sf_dir).prepare([*R.KEYS, *R.STATIC])
    return R.store(spark, R.with_batches(g), by_batch=True), {t: g[t] for t in R.STATIC}


def all_deletes(batched: Mapping[str, DataFrame], batch_ids: list[str]) -> R.Tables:
    """``batch_deletes`` of all the batches, with the batch in ``batch_id``: a candidate comes with the batch that its row arrives in and every later one."""
    batches = F.filter(F.array(*map(F.lit, batch_ids)).cast("array<string>"), lambda b: b >= F.col("_arrived"))
    candidates = fixture_deletes(R.Tables(batched).each(lambda t, df: df.withColumnRenamed("batch_id", "_arrived")), keep=["_arrived"])
    return candidates.each(lambda kind, df: df.withColumn("batch_id", F.explode(batches)).drop("_arrived"))


def _publish_all(spark, root, batched) -> None:
    from graphbi.streaming.refresh_stream import publish_batches
    ids = R.batch_ids(batched)
    publish_batches(spark, root, batched, ids, all_deletes(batched, ids))


def refresh_batch_streaming_q(spark, sf_dir):
    """Every batch after the initial snapshot, applied in order by the Structured Streaming job."""
    from graphbi.streaming.refresh_stream import SnapshotChain, run_available
    batched, static = _stored_batches(spark, sf_dir)
    initial = R.derive(spark, R.snapshot_before(batched, R.FIRST_BATCH))
    root = scratch_path(spark, "stream")
    _publish_all(spark, root, batched)
    chain = run_available(spark, root, SnapshotChain(spark, root, {**initial, **static}, {t: df.schema for t, df in batched.items()}))
    return R.table_rows(chain.current)


QUERIES["refresh_batch_streaming"] = refresh_batch_streaming_q


def refresh_batch_in_place_q(spark, sf_dir):
    """The first batch applied in place to tables partitioned by batch_id
    (appends plus rewrites of the touched partitions only)."""
    from graphbi.plans.live_store import LiveStore, apply_batch_in_place
    batched, static = _stored_batches(spark, sf_dir)
    store = LiveStore.create(spark, scratch_path(spark, "live"), batched, R.FIRST_BATCH, static, laid_out=True)
    out = apply_batch_in_place(spark, store, R.FIRST_BATCH, R.batch_rows(batched, R.FIRST_BATCH),
                               batch_deletes(batched, R.FIRST_BATCH))
    return R.table_rows(out)


QUERIES["refresh_batch_in_place"] = refresh_batch_in_place_q


def refresh_batch_streaming_in_place_q(spark, sf_dir):
    """Every batch, applied in order by the streaming job to the in-place (partitioned) store."""
    from graphbi.plans.live_store import LiveStore
    from graphbi.streaming.refresh_stream import SnapshotChain, run_available
    batched, static = _stored_batches(spark, sf_dir)
    live = LiveStore.create(spark, scratch_path(spark, "live"), batched, R.FIRST_BATCH, static, laid_out=True)
    root = scratch_path(spark, "stream")
    _publish_all(spark, root, batched)
    chain = run_available(spark, root, SnapshotChain(spark, root, None, {t: df.schema for t, df in batched.items()}, live=live))
    return R.table_rows(chain.current)


QUERIES["refresh_batch_streaming_in_place"] = refresh_batch_streaming_in_place_q
