"""DuckDB text of a chain of refresh batches: the table set after each batch is derived from the one before.

A step has CTEs named ``<table>_<k>``.  Step 0 takes everything before the
first batch and deletes nothing.  Delete candidates follow the fixture's rules
(FIXTURES.md): among all that has arrived until the batch, ids or sums of ends
that are multiples.
"""

from __future__ import annotations

from graphbi.oracle.fixture_sql import FIXTURE_CTES
from graphbi.plans.refresh import ROW_COLUMNS

#: Months of the fixture after the initial snapshot (fixed values).
MONTHS = [f"2001-{m:02d}" for m in range(1, 12)]

_TABLES = {"person": "person", "forum": "forum", "post": "post", "comment": "comment_t", "person_knows_person": "person_knows_person"}
_EDGES = {"forum_hasmember": "ForumId, PersonId", "person_hasinterest": "PersonId, TagId", "person_studyat": "PersonId, UniversityId, classYear",
          "person_workat": "PersonId, CompanyId", "person_likes_message": "PersonId, MessageId",
          "post_hastag": "MessageId, TagId", "comment_hastag": "MessageId, TagId"}
_MESSAGE = "creationDate, MessageId, RootPostId, RootPostLanguage, content, length, CreatorPersonId, ContainerForumId, ParentMessageId"


def _columns(t: str) -> str:
    return _EDGES.get(t) or ", ".join(ROW_COLUMNS[t])


def _arrivals() -> list[tuple[str, str]]:
    """Every dynamic table with the month ``m`` in which a row arrives: its own, or that of its later end."""
    out = [(f"b_{t}", f"select *, strftime(creationDate, '%Y-%m') m from {src}") for t, src in _TABLES.items()]
    out.append(("b_message_m", "select id, m from b_post union all select id, m from b_comment"))
    person = "join b_person p on p.id = x.PersonId"
    out += [
        ("b_forum_hasmember", f"select x.*, greatest(p.m, f.m) m from forum_hasmember x {person} join b_forum f on f.id = x.ForumId"),
        ("b_person_likes_message", f"select x.*, greatest(p.m, g.m) m from person_likes_message x {person} join b_message_m g on g.id = x.MessageId"),
        ("b_post_hastag", "select id MessageId, 1 + (id // 10) % 25 TagId, m from b_post"),
        ("b_comment_hastag", "select c.id MessageId, cast(substring(p_brand, 7) as bigint) TagId, c.m from b_comment c join part on p_partkey = c.pk"),
    ]
    out += [(f"b_{t}", f"select x.*, p.m from {t} x {person}") for t in ("person_hasinterest", "person_studyat", "person_workat")]
    return out


def _step(k: int, batch: str | None, first: str, last: str | None) -> list[tuple[str, str, bool]]:
    """(name, sql, is recursive) of one step; ``batch`` None is the initial snapshot, ``last`` the batch before."""
    since = f"m > '{last}'" if last else f"m >= '{first}'"
    arrived = f"m < '{first}'" if batch is None else f"{since} and m <= '{batch}'"
    out = []
    for t in [*_TABLES, *_EDGES]:
        new = f"select {_columns(t)} from b_{t} where {arrived}"
        out.append((f"{t}_in{k}", new if k == 0 else f"select {_columns(t)} from {t}_{k - 1} union all {new}", False))
    earlier = f"select {_MESSAGE} from message_{k - 1} union all " if k else ""
    out.append((f"tops_{k}", f"{earlier}select creationDate, id, id, language, content, length, CreatorPersonId, ContainerForumId, null from b_post where {arrived}"
                if k else f"select creationDate, id MessageId, id RootPostId, language RootPostLanguage, content, length, CreatorPersonId, "
                          f"ContainerForumId, cast(null as bigint) ParentMessageId from b_post where {arrived}", False))
    known = f" where id not in (select MessageId from message_{k - 1})" if k else ""
    out.append((f"open_{k}", f"select *, coalesce(ParentPostId, ParentCommentId) up from comment_in{k}{known}", False))
    out.append((f"reach_{k}", f"select MessageId, RootPostId, RootPostLanguage, ContainerForumId, false below from tops_{k} union all "
                              f"select o.id, r.RootPostId, r.RootPostLanguage, r.ContainerForumId, true from open_{k} o join reach_{k} r on o.up = r.MessageId", True))
    out.append((f"message_in{k}", f"select {_MESSAGE} from tops_{k} union all select o.creationDate, o.id, r.RootPostId, r.RootPostLanguage, o.content, "
                                  f"o.length, o.CreatorPersonId, r.ContainerForumId, o.up from open_{k} o join reach_{k} r on r.MessageId = o.id and r.below", False))
    if batch is None:
        return out + [(f"{t}_{k}", f"select {_MESSAGE if t == 'message' else _columns(t)} from {t}_in{k}", False) for t in [*_TABLES, *_EDGES, "message"]]
    until = f"m <= '{batch}'"
    out += [
        (f"dead_p{k}", f"select id from b_person where {until} and id % 97 = 0", False),
        (f"dead_f{k}", f"select id from b_forum where {until} and id % 41 = 0 union select f.id from forum_in{k} f where f.ModeratorPersonId in "
                       f"(select id from dead_p{k}) and regexp_matches(f.title, '^(Album|Wall) ')", False),
        (f"dead_m{k}", f"select id from (select id from b_post where {until} and id % 530 = 0 union select id from b_comment where {until} and id % 59 = 0 "
                       f"union select MessageId from message_in{k} where CreatorPersonId in (select id from dead_p{k}) union select MessageId from "
                       f"message_in{k} where ParentMessageId is null and ContainerForumId in (select id from dead_f{k})) s "
                       f"union select x.MessageId from message_in{k} x join dead_m{k} d on x.ParentMessageId = d.id", True),
    ]
    p, f, m = (f"(select id from dead_{c}{k})" for c in "pfm")
    keep = {
        "person": f"id not in {p}", "forum": f"id not in {f}", "post": f"id not in {m}", "comment": f"id not in {m}", "message": f"MessageId not in {m}",
        "person_knows_person": f"Person1Id not in {p} and Person2Id not in {p} and (Person1Id + Person2Id) % 43 <> 0",
        "forum_hasmember": f"PersonId not in {p} and ForumId not in {f} and (ForumId + PersonId) % 37 <> 0",
        "person_likes_message": f"PersonId not in {p} and MessageId not in {m} and (PersonId + MessageId) % 31 <> 0",
        "post_hastag": f"MessageId not in {m}", "comment_hastag": f"MessageId not in {m}",
        **{t: f"PersonId not in {p}" for t in ("person_hasinterest", "person_studyat", "person_workat")},
    }
    for t, condition in keep.items():
        columns = _MESSAGE if t == "message" else _columns(t)
        if t == "forum":
            columns = columns.replace("ModeratorPersonId", f"case when ModeratorPersonId in {p} and starts_with(title, 'Group ') then null "
                                                           "else ModeratorPersonId end ModeratorPersonId")
        out.append((f"{t}_{k}", f"select {columns} from {t}_in{k} where {condition}", False))
    return out


def _derived(k: int) -> dict[str, str]:
    """Sources of the derived and precomputed tables after step ``k``."""
    return {
        "message_hastag": f"select * from post_hastag_{k} union all select * from comment_hastag_{k}",
        "knows": f"select Person1Id, Person2Id, creationDate from person_knows_person_{k} union all "
                 f"select Person2Id, Person1Id, creationDate from person_knows_person_{k}",
        "popularity_q06": f"select CreatorPersonId person2id, count(*) popularityScore from message_{k} join person_likes_message_{k} using (MessageId) group by all",
        "top_forums_q04": f"select f.id, f.creationDate, max(n) maxNumberOfMembers from (select ForumId, PartOfCountryId, count(*) n from forum_hasmember_{k} x "
                          f"join person_{k} p on p.id = x.PersonId join city c on c.id = p.LocationCityId group by all) "
                          f"join forum_{k} f on f.id = ForumId group by all",
        "path_q19": f"select unnest([a, b]) src, unnest([b, a]) dst, greatest(round(40 - sqrt(n)), 1)::double w from (select least(r.CreatorPersonId, "
                    f"u.CreatorPersonId) a, greatest(r.CreatorPersonId, u.CreatorPersonId) b, count(*) n from message_{k} r join message_{k} u "
                    f"on u.MessageId = r.ParentMessageId where r.CreatorPersonId <> u.CreatorPersonId group by all) x "
                    f"semi join person_knows_person_{k} y on y.Person1Id = a and y.Person2Id = b",
        "path_q20": f"select unnest([Person1Id, Person2Id]) src, unnest([Person2Id, Person1Id]) dst, w from (select Person1Id, Person2Id, "
                    f"1 + min(abs(s.classYear - t.classYear)) w from person_knows_person_{k} join person_studyat_{k} s on s.PersonId = Person1Id "
                    f"join person_studyat_{k} t on t.PersonId = Person2Id and t.UniversityId = s.UniversityId group by all)",
    }


def chain_sql(batches: list[str], names: list[str] | None = None, first: str = MONTHS[0]) -> str:
    """(table_name, row) of all named tables after the batches, as ``refresh.table_rows`` gives them."""
    base = [(n, s, n in ("thread",)) for n, s in FIXTURE_CTES[: [n for n, _ in FIXTURE_CTES].index("timings")]]
    steps = [(n, s, False) for n, s in _arrivals()]
    for k, batch in enumerate([None, *batches]):
        steps += _step(k, batch, first, batches[k - 2] if k > 1 else None)
    last = len(batches)
    derived, parts = _derived(last), []
    for n in names or ROW_COLUMNS:
        cells = ", ".join(f"coalesce(cast({c} as varchar), '~')" for c in ROW_COLUMNS[n])
        source = f"({derived[n]}) z" if n in derived else f"{n}_{last}"
        parts.append(f"select '{n}' table_name, concat_ws('|', {cells}) \"row\" from {source}")
    body = ",\n".join(f"{n} as {'' if recursive else 'materialized '}({s})" for n, s, recursive in [*base, *steps])
    return f"with recursive {body}\n" + " union all ".join(parts)
