"""Daily refresh: batch inserts and cascading deletes, as DataFrame jobs.

Every dynamic row carries a ``batch_id`` (the month it arrives in).  A batch
is applied to a table set in the workload's order: inserts (deduplicated on
key, so re-applying a batch is a no-op), thread resolution of the new
comments against all existing messages, cascading deletes, and finally the
precomputed tables are rebuilt.  Deletes are left-anti joins that produce a
new snapshot (parquet below the shared folder); nothing is updated in place.

Cascade (one closure, every edge table): deleting a person removes its likes,
employments, studies, friendships, interests and memberships, clears the
moderator of its ``Group`` forums, and deletes its ``Album``/``Wall`` forums,
its posts and its comments.  Deleting a forum deletes its memberships and
posts; deleting a post or comment deletes the whole sub-thread below it, with
the likes and tags of every deleted message.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Mapping, MutableMapping
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphbi.operators.closure import descendants
from graphbi.operators.rounds import RoundStore
from graphbi.plans import views
from graphbi.session import scratch_path
from graphbi.sources.parquet import path_exists, scan_batch_partition

# table -> key columns (dedupe on insert, alignment of deletes)
KEYS = {
    "person": ["id"], "forum": ["id"], "post": ["id"], "comment": ["id"],
    "person_knows_person": ["Person1Id", "Person2Id"], "post_hastag": ["MessageId", "TagId"],
    "comment_hastag": ["MessageId", "TagId"], "person_likes_message": ["PersonId", "MessageId"],
    "forum_hasmember": ["ForumId", "PersonId"], "person_hasinterest": ["PersonId", "TagId"],
    "person_studyat": ["PersonId", "UniversityId"], "person_workat": ["PersonId", "CompanyId"],
}
STATIC = ["country", "city", "company", "tag", "tagclass", "timings"]
#: Tables of a snapshot: the inserted ones and what is derived from them.
STORED = [*KEYS, "message", "message_hastag", "knows"]
#: Comments that aren't messages yet; a table set may have them, then a batch doesn't look for them among all comments.
WAITING = "waiting_comment"
#: Tables that have files; the others of ``STORED`` are unions of these, row by row (``with_unions``).
FILES = [*KEYS, "message", WAITING]
PRECOMPUTED = ["top_forums_q04", "popularity_q06", "path_q19", "path_q20"]

_NODE_DELETES = "deletionDate timestamp, id bigint, batch_id string"
_EDGE_DELETES = "deletionDate timestamp, src bigint, trg bigint, batch_id string"
#: Delete candidates of a batch, by kind: nodes by id, edges by their two ends.
DELETE_SCHEMAS = {"person": _NODE_DELETES, "forum": _NODE_DELETES, "post": _NODE_DELETES, "comment": _NODE_DELETES,
                  "likes": _EDGE_DELETES, "membership": _EDGE_DELETES, "knows": _EDGE_DELETES}
FIRST_BATCH = "2001-01"
#: Tables whose rows have a date of their own.
_DATED = ("person", "forum", "post", "comment", "person_knows_person")
#: Jobs that write independent tables at the same time.
_WRITES = 8


class Tables(MutableMapping):
    """Tables by name; one that is given as a function is computed when it is read first, also for copies of the set."""

    def __init__(self, tables: Mapping = ()):
        self._tables = {}
        for t in tables:
            self._tables[t] = tables._tables[t] if isinstance(tables, Tables) else tables[t]

    def later(self, name: str, compute: Callable[[], DataFrame]) -> None:
        self._tables[name] = functools.cache(compute)

    def each(self, change: Callable[[str, DataFrame], DataFrame]) -> Tables:
        """Every table changed, when it is read."""
        out = Tables()
        for t in self:
            out.later(t, lambda t=t: change(t, self[t]))
        return out

    def __getitem__(self, name: str) -> DataFrame:
        found = self._tables[name]
        return found() if callable(found) else found

    def __setitem__(self, name: str, table: DataFrame) -> None:
        self._tables[name] = table

    def __delitem__(self, name: str) -> None:
        del self._tables[name]

    def __iter__(self):
        return iter(self._tables)

    def __len__(self):
        return len(self._tables)


def _month(c: Column) -> Column:
    return F.date_format(c, "yyyy-MM")


def with_batches(g: Mapping[str, DataFrame]) -> Tables:
    """Dynamic tables with a ``batch_id``: the month of the row's creation;
    edges without a date arrive with their later endpoint."""
    def months(t: str, key: str, month: str) -> DataFrame:
        return g[t].select(F.col("id").alias(key), _month("creationDate").alias(month))

    def of_persons(t: str) -> DataFrame:
        return g[t].join(months("person", "_p", "_pm"), F.col("PersonId") == F.col("_p"))

    def of_messages(rows: DataFrame) -> DataFrame:
        return rows.join(months("post", "_m", "_mm").unionByName(months("comment", "_m", "_mm")), F.col("MessageId") == F.col("_m"))

    out = Tables()
    for t in _DATED:
        out.later(t, lambda t=t: g[t].withColumn("batch_id", _month("creationDate")))
    for t in ("post_hastag", "comment_hastag"):
        out.later(t, lambda t=t: of_messages(g[t]).select(*g[t].columns, F.col("_mm").alias("batch_id")))
    out.later("person_likes_message", lambda: of_messages(of_persons("person_likes_message"))
              .select("PersonId", "MessageId", F.greatest("_pm", "_mm").alias("batch_id")))
    out.later("forum_hasmember", lambda: of_persons("forum_hasmember").join(months("forum", "_f", "_fm"), F.col("ForumId") == F.col("_f"))
              .select("ForumId", "PersonId", F.greatest("_pm", "_fm").alias("batch_id")))
    for t in ("person_hasinterest", "person_studyat", "person_workat"):
        out.later(t, lambda t=t: of_persons(t).select(*g[t].columns, F.col("_pm").alias("batch_id")))
    return out


def snapshot_before(batched: Mapping[str, DataFrame], batch_id: str) -> Tables:
    return Tables(batched).each(lambda t, df: df.where(F.col("batch_id") < batch_id).drop("batch_id"))


def batch_rows(batched: Mapping[str, DataFrame], batch_id: str) -> Tables:
    """One batch's inserts (partition pruning when ``batched`` is stored by batch_id)."""
    return Tables(batched).each(lambda t, df: df.where(F.col("batch_id") == batch_id).drop("batch_id"))


def derive(spark: SparkSession, base: Mapping[str, DataFrame]) -> Tables:
    """Message (thread closure; stored, as a batch reads it several times), undirected knows and the tag union of a base table set."""
    out = Tables(base)
    out.later("message", lambda: RoundStore(spark, "derived").put(views.message_union(spark, base["post"], base["comment"])))
    out.later("knows", lambda: views.knows_undirected(base["person_knows_person"]))
    out.later("message_hastag", lambda: views.tags_union(base["post_hastag"], base["comment_hastag"]))
    return out


# --- inserts -------------------------------------------------------------------

def new_rows(ins: DataFrame, table: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``ins`` whose key isn't in ``table``, one for each key.

    The table is cut to the batch's keys first: beside a small batch it is scanned, and not dealt out."""
    known = table.select(*keys).join(ins.select(*keys), keys, "left_semi")
    return ins.join(known, keys, "left_anti").dropDuplicates(keys)


def with_waiting(spark: SparkSession, tables: Mapping[str, DataFrame]) -> Tables:
    """``tables`` with their waiting comments, which are looked for once and stored."""
    out = Tables(tables)
    if WAITING not in out:
        def waiting() -> DataFrame:
            rounds, comment = RoundStore(spark, "waiting"), out["comment"]
            return rounds.put(comment.join(rounds.put(waiting_comments(out["message"], comment)), "id", "left_semi"))
        out.later(WAITING, waiting)
    return out


def waiting_comments(message: DataFrame, comment: DataFrame) -> DataFrame:
    """Ids of comments that aren't messages yet, as their parent had not arrived; only ids are compared."""
    return comment.select("id").join(message.select(F.col("MessageId").alias("id")), "id", "left_anti").distinct()


def attach_comments(spark: SparkSession, message: DataFrame, new_posts: DataFrame, comment: DataFrame, new_comment: DataFrame) -> DataFrame:
    """New comments, and earlier ones whose parent had not arrived yet, as messages below stored or new ones."""
    rounds = RoundStore(spark, "arriving")
    waiting = rounds.put(waiting_comments(message, comment))
    return attach_below(spark, rounds, message.unionByName(new_posts), new_comment.unionByName(comment.join(waiting, "id", "left_semi")))[0]


def attach_new(spark: SparkSession, message: DataFrame, new_post: DataFrame, new_comment: DataFrame, waiting: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(New posts, new comments and those that waited as messages, comments that still wait), both stored."""
    rounds, new_posts = RoundStore(spark, "new-message"), views.message_from_posts(new_post)
    resolved, arriving = attach_below(spark, rounds, message.unionByName(new_posts), new_comment.unionByName(waiting))
    attached = rounds.put(new_posts.unionByName(resolved))
    ids = message.join(new_comment.select("id"), F.col("MessageId") == F.col("id"), "left_semi").select("MessageId").unionByName(attached.select("MessageId"))
    return attached, rounds.put(arriving.join(ids, F.col("id") == F.col("MessageId"), "left_anti"))


def attach_below(spark: SparkSession, rounds: RoundStore, message: DataFrame, comments: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(``comments`` as messages below ``message``, all of ``comments`` stored); only messages that one of them hangs below take part in the closure."""
    # in as few files as their size allows, so that the tasks that read them find most parents beside the comments
    arriving = rounds.put(comments.hint("rebalance"))
    above = views.comments_as_children(arriving).select(F.col("ParentMessageId").alias("MessageId"))
    parents = rounds.put(message.select("MessageId", *views.THREAD_ATTRS).join(above, "MessageId", "left_semi"))
    return views.resolve_comments(spark, parents, arriving, near=True), arriving


def apply_inserts(spark: SparkSession, tables: Mapping[str, DataFrame], ins: Mapping[str, DataFrame], together: bool = False) -> Tables:
    """Append new rows (rows whose key already exists are skipped) and attach
    the new comments below existing or new messages.

    The new rows are stored, the others stay where they are: a table is the union of both.  A table's new rows are
    computed and stored when it is read first, or with ``together`` those of all tables at the same time."""
    new = Tables()
    for t, keys in KEYS.items():
        new.later(t, lambda t=t, keys=keys: new_rows(ins[t], tables[t], keys))
    new = Tables(store(spark, new)) if together else new.each(lambda t, df: store(spark, {t: df})[t])

    def message() -> DataFrame:
        if WAITING in tables:
            return below()[0]
        new_posts = views.message_from_posts(new["post"])
        new_comments = attach_comments(spark, tables["message"], new_posts, tables["comment"], new["comment"])
        return tables["message"].unionByName(RoundStore(spark, "new-message").put(new_posts.unionByName(new_comments)))

    @functools.cache
    def below() -> tuple[DataFrame, DataFrame]:
        attached, waiting = attach_new(spark, tables["message"], new["post"], new["comment"], tables[WAITING])
        return tables["message"].unionByName(attached), waiting

    out = Tables(tables)
    if WAITING in tables:
        out.later(WAITING, lambda: below()[1])
    for t in KEYS:
        out.later(t, lambda t=t: tables[t].unionByName(new[t]))
    out.later("message", message)
    friends = Tables(out)
    out.later("knows", lambda: views.knows_undirected(friends["person_knows_person"]))
    out.later("message_hastag", lambda: tables["message_hastag"].unionByName(views.tags_union(new["post_hastag"], new["comment_hastag"])))
    return out


# --- deletes -------------------------------------------------------------------

def read_deletes(spark: SparkSession, root: str, batch_id: str) -> dict[str, DataFrame]:
    """One batch's delete candidates from ``<root>/<kind>/batch_id=..`` (a missing partition reads as empty)."""
    return {kind: scan_batch_partition(spark, f"{root}/{kind}", T.StructType.fromDDL(ddl), batch_id)
            for kind, ddl in DELETE_SCHEMAS.items()}


def _ids(df: DataFrame, col: str = "id", name: str = "_id") -> DataFrame:
    return df.select(F.col(col).alias(name)).distinct()


def delete_person(tables: Mapping[str, DataFrame], persons: DataFrame) -> tuple[Tables, Tables]:
    """DEL1 on the person-owned tables; returns (tables, cascaded candidates)."""
    p = _ids(persons)
    out = Tables(tables)
    out["person"] = tables["person"].join(p, F.col("id") == F.col("_id"), "left_anti")
    for t in ("person_likes_message", "person_workat", "person_studyat", "person_hasinterest", "forum_hasmember"):
        out[t] = tables[t].join(p, F.col("PersonId") == F.col("_id"), "left_anti")
    out["person_knows_person"] = (tables["person_knows_person"]
                                  .join(p, F.col("Person1Id") == F.col("_id"), "left_anti")
                                  .join(p, F.col("Person2Id") == F.col("_id"), "left_anti"))
    forum = tables["forum"]
    moderated = forum.join(p, F.col("ModeratorPersonId") == F.col("_id"), "left_semi")
    out["forum"] = (forum.join(p.withColumn("_mod_deleted", F.lit(True)), F.col("ModeratorPersonId") == F.col("_id"), "left")
                    .withColumn("ModeratorPersonId",
                                F.when(F.col("_mod_deleted") & F.col("title").startswith("Group "), F.lit(None))
                                .otherwise(F.col("ModeratorPersonId")))
                    .select(*forum.columns))
    cascade = Tables({"forum": moderated.where(F.col("title").startswith("Album ") | F.col("title").startswith("Wall ")).select("id")})
    cascade.later("message", lambda: tables["message"].join(p, F.col("CreatorPersonId") == F.col("_id"), "left_semi")
                  .select(F.col("MessageId").alias("id")))
    return out, cascade


def delete_likes(tables, likes: DataFrame) -> dict[str, DataFrame]:
    """DEL2/DEL3: remove like edges by (person, message)."""
    out = Tables(tables)
    out["person_likes_message"] = tables["person_likes_message"].join(
        likes.select(F.col("src").alias("PersonId"), F.col("trg").alias("MessageId")), ["PersonId", "MessageId"], "left_anti")
    return out


def delete_forum(tables, forums: DataFrame) -> tuple[Tables, DataFrame]:
    """DEL4: remove forums and memberships; returns their posts as cascade."""
    f = _ids(forums)
    out = Tables(tables)
    out["forum"] = tables["forum"].join(f, F.col("id") == F.col("_id"), "left_anti")
    out["forum_hasmember"] = tables["forum_hasmember"].join(f, F.col("ForumId") == F.col("_id"), "left_anti")
    posts = (views.view_posts(tables["message"]).join(f, F.col("ContainerForumId") == F.col("_id"), "left_semi")
             .select(F.col("MessageId").alias("id")))
    return out, posts


def delete_membership(tables, memberships: DataFrame) -> dict[str, DataFrame]:
    """DEL5: remove (forum, person) memberships."""
    out = Tables(tables)
    out["forum_hasmember"] = tables["forum_hasmember"].join(
        memberships.select(F.col("src").alias("ForumId"), F.col("trg").alias("PersonId")), ["ForumId", "PersonId"],
        "left_anti")
    return out


def delete_friendship(tables, pairs: DataFrame) -> dict[str, DataFrame]:
    """DEL8: remove a friendship given in either direction."""
    out = Tables(tables)
    p = pairs.select(F.least("src", "trg").alias("Person1Id"), F.greatest("src", "trg").alias("Person2Id"))
    out["person_knows_person"] = tables["person_knows_person"].join(p, ["Person1Id", "Person2Id"], "left_anti")
    return out


def delete_messages(spark: SparkSession, tables, roots: DataFrame) -> dict[str, DataFrame]:
    """DEL6/DEL7: remove messages, every reply below them, and their likes and tags."""
    m = tables["message"]
    links = m.select("MessageId", "ParentMessageId", "RootPostId")
    rounds = RoundStore(spark, "gone")
    seeds = rounds.put(roots.select(F.col("id").alias("MessageId")).distinct())
    gone = seeds.unionByName(descendants(spark, seeds, links, id_col="MessageId", parent_col="ParentMessageId", tree_col="RootPostId")).distinct()
    gone = rounds.put(gone.select(F.col("MessageId").alias("_id")))  # seven tables are joined with it
    out = Tables(tables)
    out["message"] = m.join(gone, F.col("MessageId") == F.col("_id"), "left_anti")
    out["post"] = tables["post"].join(gone, F.col("id") == F.col("_id"), "left_anti")
    for t in ("comment", WAITING):
        if t in tables:
            out[t] = tables[t].join(gone, F.col("id") == F.col("_id"), "left_anti")
    for t in ("person_likes_message", "post_hastag", "comment_hastag", "message_hastag"):
        out[t] = tables[t].join(gone, F.col("MessageId") == F.col("_id"), "left_anti")
    return out


def apply_deletes(spark: SparkSession, tables: Mapping[str, DataFrame], cands: Mapping[str, DataFrame]) -> dict[str, DataFrame]:
    out, cascade = delete_person(tables, cands["person"])
    out = delete_likes(out, cands["likes"])
    forums = cands["forum"].select("id").unionByName(cascade["forum"])
    out, forum_posts = delete_forum(out, forums)
    out = delete_membership(out, cands["membership"])
    roots = (cands["post"].select("id").unionByName(cands["comment"].select("id"))
             .unionByName(cascade["message"]).unionByName(forum_posts))
    out = delete_messages(spark, out, roots)
    out = delete_friendship(out, cands["knows"])
    out["knows"] = views.knows_undirected(out["person_knows_person"])
    return out


# --- one batch end to end ------------------------------------------------------

def store(spark: SparkSession, tables: Mapping[str, DataFrame], root: str | None = None, by_batch: bool = False) -> dict[str, DataFrame]:
    """Write a table set as a new snapshot and return DataFrames reading it; independent writes are submitted together.

    ``by_batch``: in a folder for each ``batch_id``, so that a batch's rows are found without the others."""
    root = root or scratch_path(spark, "refresh")
    tables = {t: tables[t] for t in tables}

    def write(t: str) -> None:
        if by_batch:
            w = tables[t].hint("rebalance", "batch_id").write.partitionBy("batch_id")
        else:
            w = tables[t].write
        w.mode("overwrite").option("compression", "zstd").parquet(f"{root}/{t}")

    with ThreadPoolExecutor(_WRITES) as pool:
        list(pool.map(write, tables))
    return {t: spark.read.schema(df.schema).parquet(f"{root}/{t}") for t, df in tables.items()}


def with_unions(tables: Mapping[str, DataFrame]) -> dict[str, DataFrame]:
    """The tables of ``FILES`` with those of ``STORED`` that are unions of them."""
    return {**tables, "message_hastag": views.tags_union(tables["post_hastag"], tables["comment_hastag"]),
            "knows": views.knows_undirected(tables["person_knows_person"])}


def refresh_tables(spark: SparkSession, tables: Mapping[str, DataFrame], ins: Mapping[str, DataFrame],
                   deletes: Mapping[str, DataFrame], root: str) -> dict[str, DataFrame]:
    """Inserts, then deletes (candidates by kind, see ``DELETE_SCHEMAS``); stored as a new snapshot, yet without precomputations."""
    final = apply_deletes(spark, apply_inserts(spark, with_waiting(spark, tables), ins, together=True), deletes)
    deleted = with_unions(store(spark, {t: final[t] for t in FILES}, f"{root}/final"))
    deleted.update({t: tables[t] for t in STATIC if t in tables})
    return deleted


def refresh_precomputed(spark: SparkSession, tables: Mapping[str, DataFrame], root: str) -> dict[str, DataFrame]:
    """The precomputations of a stored snapshot, stored beside it."""
    return store(spark, views.precomputed(tables), f"{root}/precomp")


def refresh_batch(spark: SparkSession, tables: Mapping[str, DataFrame], ins: Mapping[str, DataFrame],
                  deletes: Mapping[str, DataFrame], root: str | None = None) -> dict[str, DataFrame]:
    """Inserts, then deletes (candidates by kind, see ``DELETE_SCHEMAS``), then
    precomputations; stored as a new snapshot."""
    root = root or scratch_path(spark, "refresh")
    deleted = refresh_tables(spark, tables, ins, deletes, root)
    return {**deleted, **refresh_precomputed(spark, deleted, root)}


def read_snapshot(spark: SparkSession, root: str, static: Mapping[str, DataFrame]) -> dict[str, DataFrame]:
    """The table set that ``refresh_batch`` stored below ``root``."""
    out = with_unions({t: spark.read.parquet(f"{root}/final/{t}") for t in FILES if t != WAITING or path_exists(spark, f"{root}/final/{t}")})
    out.update({t: static[t] for t in STATIC if t in static})
    out.update({t: spark.read.parquet(f"{root}/precomp/{t}") for t in PRECOMPUTED})
    return out


def stored_batches(spark: SparkSession, g: Mapping[str, DataFrame]) -> Tables:
    """``with_batches`` of the stored graph; tables whose ``batch_id`` comes from joins are stored when they are read
    first, as each is read several times."""
    return with_batches(g).each(lambda t, df: df if t in _DATED else store(spark, {t: df})[t])


def initial_and_batch(spark: SparkSession, g: Mapping[str, DataFrame], batch_id: str = FIRST_BATCH,
                      batched: Mapping[str, DataFrame] | None = None):
    """Split the stored graph into the initial snapshot (before ``batch_id``)
    and that batch's inserts."""
    batched = stored_batches(spark, g) if batched is None else batched
    initial = derive(spark, snapshot_before(batched, batch_id))
    for t in STATIC:
        initial.later(t, lambda t=t: g[t])
    return initial, batch_rows(batched, batch_id)


def batch_ids(batched: Mapping[str, DataFrame], first: str = FIRST_BATCH) -> list[str]:
    """The batches from ``first`` on that any table has rows of, in order (one short string per batch)."""
    found = None
    for df in batched.values():
        ids = df.where(F.col("batch_id") >= first).select("batch_id").distinct()
        found = ids if found is None else found.unionByName(ids)
    return sorted(r["batch_id"] for r in found.distinct().collect())


#: Columns of a table that make up a row, for comparisons of full rows; "~" stands for null.
ROW_COLUMNS = {
    "person": ["id", "firstName", "lastName", "LocationCityId", "creationDate"],
    "forum": ["id", "title", "ModeratorPersonId", "creationDate"],
    "post": ["id", "creationDate", "CreatorPersonId", "ContainerForumId", "language", "content", "length"],
    "comment": ["id", "creationDate", "CreatorPersonId", "ParentPostId", "ParentCommentId", "length", "content"],
    "person_knows_person": ["Person1Id", "Person2Id", "creationDate"],
    "forum_hasmember": ["ForumId", "PersonId"],
    "person_hasinterest": ["PersonId", "TagId"],
    "person_studyat": ["PersonId", "UniversityId", "classYear"],
    "person_workat": ["PersonId", "CompanyId"],
    "post_hastag": ["MessageId", "TagId"],
    "comment_hastag": ["MessageId", "TagId"],
    "message_hastag": ["MessageId", "TagId"],
    "person_likes_message": ["PersonId", "MessageId"],
    "message": ["MessageId", "creationDate", "RootPostId", "RootPostLanguage", "content", "length", "CreatorPersonId", "ContainerForumId", "ParentMessageId"],
    "knows": ["Person1Id", "Person2Id", "creationDate"],
    "path_q19": ["src", "dst", "w"],
    "path_q20": ["src", "dst", "w"],
    "popularity_q06": ["person2id", "popularityScore"],
    "top_forums_q04": ["id", "creationDate", "maxNumberOfMembers"],
}


def table_rows(tables: Mapping[str, DataFrame], names: list[str] | None = None) -> DataFrame:
    """(table_name, row) of every row of the named tables, a row as text."""
    out = None
    for n in names or ROW_COLUMNS:
        cells = [F.coalesce(F.col(c).cast("string"), F.lit("~")) for c in ROW_COLUMNS[n]]
        rows = tables[n].select(F.lit(n).alias("table_name"), F.concat_ws("|", *cells).alias("row"))
        out = rows if out is None else out.unionByName(rows)
    return out


def table_counts(tables: Mapping[str, DataFrame], names: list[str]) -> DataFrame:
    parts = [tables[n].select(F.lit(n).alias("table_name"), F.count(F.lit(1)).alias("row_count")) for n in names]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
