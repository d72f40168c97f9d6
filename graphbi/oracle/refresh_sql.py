"""DuckDB oracle texts for the refresh operators (batch 2001-01 applied to
everything created before it, deletion candidates by the fixture rules)."""

from __future__ import annotations

from graphbi.oracle.chain_sql import MONTHS, chain_sql
from graphbi.oracle.fixture_sql import with_fixture

B = "'2001-01'"

INS = [
    ("pm", "select id p, strftime(creationDate, '%Y-%m') m from person"),
    ("msgm", "select id mid, strftime(creationDate, '%Y-%m') m from post union all "
             "select id, strftime(creationDate, '%Y-%m') from comment_t"),
    ("fm", "select id f, strftime(creationDate, '%Y-%m') m from forum"),
    ("person_i", f"select * from person where strftime(creationDate, '%Y-%m') <= {B}"),
    ("forum_i", f"select * from forum where strftime(creationDate, '%Y-%m') <= {B}"),
    ("post_i", f"select * from post where strftime(creationDate, '%Y-%m') <= {B}"),
    ("comment_i", f"select * from comment_t where strftime(creationDate, '%Y-%m') <= {B}"),
    ("pkp_i", f"select * from person_knows_person where strftime(creationDate, '%Y-%m') <= {B}"),
    ("post_hastag_i", f"select o_orderkey*10 MessageId, 1+o_orderkey%25 TagId from orders join msgm "
                      f"on mid = o_orderkey*10 where m <= {B}"),
    ("comment_hastag_i", f"select c.id MessageId, cast(substring(p_brand,7) as bigint) TagId from comment_t c "
                         f"join part on p_partkey = c.pk join msgm on mid = c.id where m <= {B}"),
    ("mht_i", "select * from post_hastag_i union all select * from comment_hastag_i"),
    ("likes_i", f"select l.* from person_likes_message l join pm on pm.p = l.PersonId join msgm on mid = l.MessageId "
                f"where greatest(pm.m, msgm.m) <= {B}"),
    ("member_i", f"select x.* from forum_hasmember x join pm on pm.p = x.PersonId join fm on fm.f = x.ForumId "
                 f"where greatest(pm.m, fm.m) <= {B}"),
    ("interest_i", f"select x.* from person_hasinterest x join pm on pm.p = x.PersonId where pm.m <= {B}"),
    ("studyat_i", f"select x.* from person_studyat x join pm on pm.p = x.PersonId where pm.m <= {B}"),
    ("workat_i", f"select x.* from person_workat x join pm on pm.p = x.PersonId where pm.m <= {B}"),
    ("mpost_i", "select creationDate, id MessageId, id RootPostId, language RootPostLanguage, content, length, "
                "CreatorPersonId, ContainerForumId, cast(null as bigint) ParentMessageId from post_i"),
    ("thread_i", "select MessageId, RootPostId, RootPostLanguage, ContainerForumId from mpost_i "
                 "union all select c.id, t.RootPostId, t.RootPostLanguage, t.ContainerForumId from comment_i c "
                 "join thread_i t on coalesce(c.ParentPostId, c.ParentCommentId) = t.MessageId"),
    ("message_i", "select * from mpost_i union all select c.creationDate, c.id, t.RootPostId, t.RootPostLanguage, "
                  "c.content, c.length, c.CreatorPersonId, t.ContainerForumId, coalesce(c.ParentPostId, "
                  "c.ParentCommentId) from comment_i c join thread_i t on t.MessageId = c.id"),
    # delete candidates
    ("pdel", "select id from person_i where id % 97 = 0"),
    ("fcand", "select id from forum_i where id % 41 = 0"),
    ("fdel", "select id from fcand union select id from forum_i where ModeratorPersonId in (select id from pdel) "
             "and (title like 'Album %' or title like 'Wall %')"),
    ("likes_c", "select PersonId, MessageId from likes_i where (PersonId + MessageId) % 31 = 0"),
    ("member_c", "select ForumId, PersonId from member_i where (ForumId + PersonId) % 37 = 0"),
    ("knows_c", "select Person1Id, Person2Id from pkp_i where (Person1Id + Person2Id) % 43 = 0"),
    ("post_c", "select id from post_i where id % 530 = 0"),
    ("comment_c", "select id from comment_i where id % 59 = 0"),
]


def _closure(name: str, roots: str) -> tuple[str, str]:
    return (name, f"select id from ({roots}) r union select m.MessageId from message_i m join {name} d "
                  f"on m.ParentMessageId = d.id")


def _counts(pairs: list[tuple[str, str]]) -> str:
    return " union all ".join(f"select '{n}' table_name, count(*) row_count from {src}" for n, src in pairs)


REFRESH_SQL: dict[str, str] = {}

REFRESH_SQL["refresh_insert_nodes"] = with_fixture(*INS, select=_counts(
    [("person", "person_i"), ("forum", "forum_i"), ("post", "post_i"), ("comment", "comment_i")]))
REFRESH_SQL["refresh_insert_edges"] = with_fixture(*INS, select=_counts(
    [("person_knows_person", "pkp_i"), ("forum_hasmember", "member_i"), ("person_hasinterest", "interest_i"),
     ("person_studyat", "studyat_i"), ("person_workat", "workat_i")]))
REFRESH_SQL["refresh_insert_merged"] = with_fixture(*INS, select=_counts(
    [("post_hastag", "post_hastag_i"), ("comment_hastag", "comment_hastag_i"), ("message_hastag", "mht_i"),
     ("person_likes_message", "likes_i")]))
REFRESH_SQL["refresh_threads_incremental"] = with_fixture(*INS, select="select * from message_i")

REFRESH_SQL["delete_person"] = with_fixture(*INS, select=_counts([
    ("person", "(select * from person_i where id not in (select id from pdel))"),
    ("person_likes_message", "(select * from likes_i where PersonId not in (select id from pdel))"),
    ("person_workat", "(select * from workat_i where PersonId not in (select id from pdel))"),
    ("person_studyat", "(select * from studyat_i where PersonId not in (select id from pdel))"),
    ("person_knows_person", "(select * from pkp_i where Person1Id not in (select id from pdel) "
                            "and Person2Id not in (select id from pdel))"),
    ("person_hasinterest", "(select * from interest_i where PersonId not in (select id from pdel))"),
    ("forum_hasmember", "(select * from member_i where PersonId not in (select id from pdel))"),
    ("forum_without_moderator", "(select * from forum_i where ModeratorPersonId is null or "
                                "(ModeratorPersonId in (select id from pdel) and title like 'Group %'))"),
]))
REFRESH_SQL["delete_post_like"] = with_fixture(*INS, select=_counts([
    ("person_likes_message", "(select * from likes_i where MessageId % 10 <> 0 or (PersonId, MessageId) not in (select * from likes_c))")]))
REFRESH_SQL["delete_comment_like"] = with_fixture(*INS, select=_counts([
    ("person_likes_message", "(select * from likes_i where MessageId % 10 = 0 or (PersonId, MessageId) not in (select * from likes_c))")]))
REFRESH_SQL["delete_forum"] = with_fixture(*INS, select=_counts([
    ("forum", "(select * from forum_i where id not in (select id from fcand))"),
    ("forum_hasmember", "(select * from member_i where ForumId not in (select id from fcand))"),
    ("cascaded_posts", "(select distinct MessageId from message_i where ParentMessageId is null "
                       "and ContainerForumId in (select id from fcand))")]))
REFRESH_SQL["delete_membership"] = with_fixture(*INS, select=_counts([
    ("forum_hasmember", "(select * from member_i where (ForumId, PersonId) not in (select * from member_c))")]))


def _msg_delete(roots: str, names: list[str]) -> str:
    src = {
        "message": "(select * from message_i where MessageId not in (select id from gone))",
        "post": "(select * from post_i where id not in (select id from gone))",
        "comment": "(select * from comment_i where id not in (select id from gone))",
        "person_likes_message": "(select * from likes_i where MessageId not in (select id from gone))",
        "message_hastag": "(select * from mht_i where MessageId not in (select id from gone))",
    }
    return with_fixture(*INS, _closure("gone", roots), select=_counts([(n, src[n]) for n in names]))


REFRESH_SQL["delete_post_thread"] = _msg_delete("select id from post_c",
                                                ["message", "post", "comment", "person_likes_message", "message_hastag"])
REFRESH_SQL["delete_comment_subthread"] = _msg_delete("select id from comment_c",
                                                      ["message", "comment", "person_likes_message", "message_hastag"])
REFRESH_SQL["delete_friendship"] = with_fixture(*INS, select=_counts([
    ("person_knows_person", "(select * from pkp_i where (Person1Id, Person2Id) not in (select * from knows_c))")]))

# full rows of every dynamic and precomputed table: after the first batch, and after all of them
for _key in ("refresh_batch", "refresh_batch_in_place"):
    REFRESH_SQL[_key] = chain_sql(MONTHS[:1])
for _key in ("refresh_batch_streaming", "refresh_batch_streaming_in_place"):
    REFRESH_SQL[_key] = chain_sql(MONTHS)
