"""DuckDB oracle texts for the BI read queries (default parameters).

Written independently of the Spark plans where possible: scalar subqueries
and EXISTS filters instead of pre-aggregated joins, a recursive BFS distance
for the hop ring, a keyed recursive Bellman-Ford for the path queries.
"""

from __future__ import annotations

from graphbi.oracle.fixture_sql import with_fixture


def _ts(d: str) -> str:
    return f"TIMESTAMP '{d} 00:00:00'"


def _in_country(alias: str, country: str) -> str:
    return (f"{alias}.LocationCityId in (select ci.id from city ci join country co on co.id = ci.PartOfCountryId "
            f"where co.name = '{country}')")


def _tag(name: str) -> str:
    return f"(select id from tag where name = '{name}')"


BI_SQL: dict[str, str] = {}

BI_SQL["bi_01_posting_summary"] = with_fixture(
    ("g", "select cast(year(creationDate) as integer) yr, ParentMessageId is not null isComment, "
          "case when length < 40 then 0 when length < 80 then 1 when length < 160 then 2 else 3 end lengthCategory, "
          "count(*) filter (where content is not null) n, avg(length) filter (where content is not null) a, "
          "sum(length::bigint) filter (where content is not null) s, sum(count(*)) over () total "
          f"from message where creationDate < {_ts('2000-01-01')} group by all"),
    select="select yr as year, isComment, lengthCategory, n messageCount, a averageMessageLength, "
           "cast(s as bigint) sumMessageLength, n / total percentageOfMessages from g where n > 0")

BI_SQL["bi_02_tag_evolution"] = with_fixture(
    ("w", "select t.id, t.name, count(m.MessageId) filter (where m.creationDate < "
          f"{_ts('1997-01-01')} + INTERVAL 100 DAY) w1, count(m.MessageId) filter (where m.creationDate >= "
          f"{_ts('1997-01-01')} + INTERVAL 100 DAY) w2 from tag t join tagclass c on c.id = t.TypeTagClassId "
          "left join message_hastag mt on mt.TagId = t.id left join message m on m.MessageId = mt.MessageId "
          f"and m.creationDate >= {_ts('1997-01-01')} and m.creationDate < {_ts('1997-01-01')} + INTERVAL 200 DAY "
          "where c.name = 'LARGE' group by t.id, t.name"),
    select="select name tag_name, w1 countWindow1, w2 countWindow2, abs(w1 - w2) diff from w "
           "order by diff desc, tag_name limit 100")

BI_SQL["bi_03_popular_topics"] = with_fixture(
    ("cls", "select t.id from tag t join tagclass c on c.id = t.TypeTagClassId where c.name = 'LARGE'"),
    select="select f.id forum_id, f.title forum_title, f.creationDate forum_creationDate, f.ModeratorPersonId "
           "person_id, count(*) messageCount from forum f join message m on m.ContainerForumId = f.id "
           f"where f.ModeratorPersonId in (select p.id from person p where {_in_country('p', 'NATION_2')}) "
           "and m.MessageId in (select MessageId from message_hastag where TagId in (select id from cls)) "
           "group by all order by messageCount desc, forum_id limit 20")

BI_SQL["bi_04_top_creators"] = with_fixture(
    ("best", f"select id from top_forums_q04 where creationDate > {_ts('1996-01-01')} "
             "order by maxNumberOfMembers desc, id limit 100"),
    select="select p.id person_id, p.firstName person_firstName, p.lastName person_lastName, p.creationDate "
           "person_creationDate, (select count(*) from message m where m.CreatorPersonId = p.id and "
           "m.ContainerForumId in (select id from best)) messageCount from person p "
           "where p.id in (select PersonId from forum_hasmember where ForumId in (select id from best)) "
           "order by messageCount desc, person_id limit 100")

BI_SQL["bi_05_active_posters"] = with_fixture(
    ("pm", "select m.MessageId, m.CreatorPersonId, (select count(*) from message r where r.ParentMessageId = "
           "m.MessageId) replies, (select count(*) from person_likes_message l where l.MessageId = m.MessageId) likes "
           f"from message m join message_hastag mt on mt.MessageId = m.MessageId where mt.TagId = {_tag('Brand#3')}"),
    select="select CreatorPersonId person_id, cast(sum(replies) as bigint) replyCount, cast(sum(likes) as bigint) "
           "likeCount, count(*) messageCount, cast(count(*) + 2 * sum(replies) + 10 * sum(likes) as bigint) score "
           "from pm group by CreatorPersonId order by score desc, person_id limit 100")

BI_SQL["bi_06_authoritative_users"] = with_fixture(
    ("tm", f"select m.MessageId, m.CreatorPersonId from message m where m.MessageId in (select MessageId from "
           f"message_hastag where TagId = {_tag('Brand#3')})"),
    ("likers", "select distinct tm.CreatorPersonId p1, l.PersonId p2 from tm join person_likes_message l "
               "on l.MessageId = tm.MessageId"),
    select="select p1 person1_id, cast(coalesce((select sum(s.popularityScore) from likers x join popularity_q06 s "
           "on s.person2id = x.p2 where x.p1 = c.p1), 0) as bigint) authorityScore from (select distinct "
           "CreatorPersonId p1 from tm) c order by authorityScore desc, person1_id limit 100")

BI_SQL["bi_07_related_topics"] = with_fixture(
    ("tm", f"select MessageId from message_hastag where TagId = {_tag('Brand#3')}"),
    select="select t.name relatedTag_name, count(*) count from message c join message_hastag mt "
           "on mt.MessageId = c.MessageId join tag t on t.id = mt.TagId where c.ParentMessageId in "
           "(select MessageId from tm) and c.MessageId not in (select MessageId from tm) "
           "group by t.name order by count desc, relatedTag_name limit 100")

BI_SQL["bi_08_central_person"] = with_fixture(
    ("fans", f"select distinct PersonId pid from person_hasinterest where TagId = {_tag('Brand#3')} "
             "and PersonId in (select id from person)"),
    ("writers", "select m.CreatorPersonId pid, count(*) n from message m where m.MessageId in (select MessageId "
                f"from message_hastag where TagId = {_tag('Brand#3')}) and m.creationDate > {_ts('1997-01-01')} "
                f"and m.creationDate < {_ts('1999-01-01')} and m.CreatorPersonId in (select id from person) group by 1"),
    ("sc", "select coalesce(f.pid, w.pid) pid, (case when f.pid is null then 0 else 100 end) + coalesce(w.n, 0) "
           "score from fans f full outer join writers w on w.pid = f.pid"),
    ("withf", "select s.pid, s.score, cast(coalesce((select sum(o.score) from knows k join sc o "
              "on o.pid = k.Person2Id where k.Person1Id = s.pid), 0) as bigint) fs from sc s"),
    select="select pid person_id, score, fs friendsScore from withf order by score + fs desc, pid limit 100")

BI_SQL["bi_09_thread_initiators"] = with_fixture(
    ("win", f"select * from message where creationDate between {_ts('1996-01-01')} and {_ts('1998-01-01')}"),
    ("per_root", "select RootPostId, count(*) n from win group by RootPostId"),
    select="select p.id person_id, p.firstName person_firstName, p.lastName person_lastName, count(*) threadCount, "
           "cast(sum(r.n) as bigint) messageCount from win t join per_root r on r.RootPostId = t.MessageId "
           "join person p on p.id = t.CreatorPersonId where t.ParentMessageId is null group by 1, 2, 3 "
           "order by messageCount desc, person_id limit 100")

BI_SQL["bi_10_experts"] = with_fixture(
    ("walk", "select 0::bigint node, 0 d union select k.Person2Id, w.d + 1 from walk w join knows k "
             "on k.Person1Id = w.node where w.d < 4"),
    ("ring", "select node from walk group by node having min(d) between 3 and 4"),
    ("experts", f"select r.node pid from ring r join person p on p.id = r.node where {_in_country('p', 'NATION_2')}"),
    ("cmsg", "select m.MessageId, m.CreatorPersonId pid from message m where m.CreatorPersonId in "
             "(select pid from experts) and exists (select 1 from message_hastag mt join tag t on t.id = mt.TagId "
             "join tagclass c on c.id = t.TypeTagClassId where mt.MessageId = m.MessageId and c.name = 'LARGE')"),
    select="select c.pid expertCandidatePerson_id, t.name tag_name, count(*) messageCount from cmsg c "
           "join message_hastag mt on mt.MessageId = c.MessageId join tag t on t.id = mt.TagId group by all "
           "order by messageCount desc, tag_name, expertCandidatePerson_id limit 100")

BI_SQL["bi_11_triangles"] = with_fixture(
    ("loc", f"select p.id from person p where {_in_country('p', 'NATION_2')}"),
    ("e", f"select Person1Id a, Person2Id b from person_knows_person where creationDate between {_ts('1995-01-01')} "
          f"and {_ts('2001-12-31')} and Person1Id in (select id from loc) and Person2Id in (select id from loc)"),
    select="select count(*) as count from e x join e y on y.a = x.b join e z on z.a = x.a and z.b = y.b")

BI_SQL["bi_12_message_distribution"] = with_fixture(
    ("n", "select CreatorPersonId pid, count(*) c from message where content is not null and length < 100 "
          f"and creationDate > {_ts('1998-01-01')} and RootPostLanguage in ('fr', 'de') group by 1"),
    select="select coalesce(n.c, 0) messageCount, count(*) personCount from person p left join n on n.pid = p.id "
           "group by 1 order by personCount desc, messageCount desc")

BI_SQL["bi_13_zombies"] = with_fixture(
    ("cand", f"select p.id, p.creationDate from person p where {_in_country('p', 'NATION_2')} "
             f"and p.creationDate < {_ts('2001-01-01')}"),
    ("zombies", "select c.id from cand c where (select count(*) from message m where m.CreatorPersonId = c.id "
                f"and m.creationDate >= c.creationDate and m.creationDate <= {_ts('2001-01-01')}) < "
                "(2001 * 12 + 1) - (year(c.creationDate) * 12 + month(c.creationDate)) + 1"),
    ("lk", "select m.CreatorPersonId zid, l.PersonId liker from person_likes_message l join message m "
           "on m.MessageId = l.MessageId join person p on p.id = l.PersonId where p.creationDate < "
           f"{_ts('2001-01-01')} and m.CreatorPersonId in (select id from zombies)"),
    ("agg", "select lk.zid, count(*) total, count(z.id) zl from lk left join zombies z on z.id = lk.liker "
            "group by lk.zid"),
    select="select z.id zombie_id, coalesce(a.zl, 0) zombieLikeCount, coalesce(a.total, 0) totalLikeCount, "
           "case when a.total > 0 then a.zl::double / a.total else 0.0 end zombieScore from zombies z "
           "left join agg a on a.zid = z.id order by zombieScore desc, zombie_id limit 100")

BI_SQL["bi_14_international_dialog"] = with_fixture(
    ("c1", "select p.id, ci.id cityId, ci.name cityName from person p join city ci on ci.id = p.LocationCityId "
           "join country co on co.id = ci.PartOfCountryId where co.name = 'NATION_16'"),
    ("pairs", "select c1.id p1, k.Person2Id p2, c1.cityId, c1.cityName from c1 join knows k on k.Person1Id = c1.id "
              f"join person q on q.id = k.Person2Id where {_in_country('q', 'NATION_24')}"),
    ("rep", "select distinct r.CreatorPersonId a, m.CreatorPersonId b from message r join message m "
            "on m.MessageId = r.ParentMessageId"),
    ("lik", "select distinct l.PersonId a, m.CreatorPersonId b from person_likes_message l join message m "
            "on m.MessageId = l.MessageId"),
    ("scored", "select p.*, (case when exists (select 1 from rep where a = p.p1 and b = p.p2) then 4 else 0 end) "
               "+ (case when exists (select 1 from rep where a = p.p2 and b = p.p1) then 1 else 0 end) "
               "+ (case when exists (select 1 from lik where a = p.p1 and b = p.p2) then 10 else 0 end) "
               "+ (case when exists (select 1 from lik where a = p.p2 and b = p.p1) then 1 else 0 end) score from pairs p"),
    ("ranked", "select *, row_number() over (partition by cityId order by score desc, p1, p2) rn from scored"),
    select="select p1 person1_id, p2 person2_id, cityName city1_name, cast(score as integer) score from ranked "
           "where rn = 1 order by score desc, person1_id, person2_id limit 100")

BI_SQL["bi_16_fake_news"] = with_fixture(
    ("spec", "select * from (values ('A', 'Brand#1', DATE '1995-01-04'), ('B', 'Brand#4', DATE '1996-10-16')) "
             "v(side, tagname, d)"),
    ("hits", "select distinct s.side, m.CreatorPersonId pid, m.MessageId from spec s join tag t on t.name = s.tagname "
             "join message_hastag mt on mt.TagId = t.id join message m on m.MessageId = mt.MessageId "
             "and cast(m.creationDate as date) = s.d where m.CreatorPersonId in (select id from person)"),
    ("per", "select h.side, h.pid, count(distinct h.MessageId) cm, (select count(distinct k.Person2Id) from knows k "
            "where k.Person1Id = h.pid and k.Person2Id in (select x.pid from hits x where x.side = h.side)) nf "
            "from hits h group by h.side, h.pid"),
    select="select a.pid person_id, a.cm messageCountA, b.cm messageCountB from per a join per b on b.pid = a.pid "
           "where a.side = 'A' and b.side = 'B' and a.nf <= 5 and b.nf <= 5 "
           "order by a.cm + b.cm desc, person_id limit 20")

BI_SQL["bi_17_information_propagation"] = with_fixture(
    ("tm", "select * from message where MessageId in (select MessageId from message_hastag where TagId = "
           f"{_tag('Brand#3')})"),
    ("chain", "select x.MessageId m2, x.creationDate cd2, x.CreatorPersonId p3, x.ContainerForumId f2, "
              "y.CreatorPersonId p2 from tm x join tm y on y.ParentMessageId = x.MessageId "
              "where y.CreatorPersonId <> x.CreatorPersonId"),
    select="select o.CreatorPersonId person1_id, count(distinct c.m2) messageCount from tm o join chain c "
           "on o.creationDate + INTERVAL 4 HOUR < c.cd2 and o.ContainerForumId <> c.f2 "
           "where exists (select 1 from forum_hasmember a where a.ForumId = o.ContainerForumId and a.PersonId = c.p2) "
           "and exists (select 1 from forum_hasmember b where b.ForumId = o.ContainerForumId and b.PersonId = c.p3) "
           "and not exists (select 1 from forum_hasmember z where z.ForumId = c.f2 and z.PersonId = o.CreatorPersonId) "
           "group by o.CreatorPersonId order by messageCount desc, person1_id limit 10")

BI_SQL["bi_18_friend_recommendation"] = with_fixture(
    ("adj", "select k.Person1Id a, k.Person2Id f from knows k where k.Person1Id in (select PersonId from "
            f"person_hasinterest where TagId = {_tag('Brand#3')})"),
    select="select x.a person1_id, y.a person2_id, count(*) mutualFriendCount from adj x join adj y on y.f = x.f "
           "where x.a <> y.a and not exists (select 1 from knows k where k.Person1Id = y.a and k.Person2Id = x.a) "
           "group by 1, 2 order by mutualFriendCount desc, person1_id, person2_id limit 20")


def _sssp_sql(edges: str, seeds: str) -> str:
    """Per-source Bellman-Ford with DuckDB's keyed recursion (oracle only)."""
    return ("select g, node, d from (with recursive s(g, node, d) using key (g, node) as ("
            f"select id as g, id as node, 0.0::double as d from ({seeds}) seeds union ("
            "select c.g, c.node, c.d from (select s.g, e.dst node, min(s.d + e.w) d from s join "
            f"({edges}) e on e.src = s.node group by s.g, e.dst) c left join recurring.s r on r.g = c.g "
            "and r.node = c.node where r.d is null or c.d < r.d)) select * from s)")


# friend pairs with their reply score inside the forums created in the window
MM_CTES = [
    ("win_forums", f"select id from forum where creationDate between {_ts('1996-01-01')} and {_ts('1999-01-01')}"),
    ("scored_replies", "select least(r.CreatorPersonId, m.CreatorPersonId) a, greatest(r.CreatorPersonId, "
                       "m.CreatorPersonId) b, case when m.ParentMessageId is null then 10 else 5 end s from message r "
                       "join message m on m.MessageId = r.ParentMessageId where r.ContainerForumId in (select id from "
                       "win_forums) and m.ContainerForumId in (select id from win_forums)"),
    ("mm", "select a src, b dst, sum(s) w from scored_replies where exists (select 1 from person_knows_person k "
           "where k.Person1Id = a and k.Person2Id = b) group by a, b"),
]
_TRUSTED = ("select k.Person1Id src, k.Person2Id dst, 10::double / (coalesce(mm.w, 0) + 10) w from knows k "
            "left join mm on mm.src = least(k.Person1Id, k.Person2Id) and mm.dst = greatest(k.Person1Id, k.Person2Id)")

BI_SQL["bi_15_trusted_path"] = with_fixture(
    *MM_CTES,
    ("paths", _sssp_sql(_TRUSTED, "select 0::bigint id")),
    select="select round(coalesce((select min(d) from paths where node = 700), -1.0), 6) as weight")

_Q19 = with_fixture(
    ("paths", _sssp_sql("select * from path_q19", "select id from person where LocationCityId = 1008")),
    ("res", "select g f, node t, d w from paths where node in (select id from person where LocationCityId = 1021)"),
    select="select f person1_id, t person2_id, round(w, 6) totalWeight from res "
           "where round(w, 6) = (select round(min(w), 6) from res) order by f, t")
BI_SQL["bi_19_city_path"] = _Q19
BI_SQL["bi_19_city_path_full"] = _Q19

_Q20 = with_fixture(
    ("paths", _sssp_sql("select src, dst, cast(w as double) w from path_q20", "select 7::bigint id")),
    ("res", "select node t, d w from paths where node in (select pw.PersonId from person_workat pw, company c "
            "where pw.CompanyId = c.id and c.name = 'Supplier#000000033')"),
    select="select t person1_id, cast(w as bigint) totalWeight from res where w = (select min(w) from res) "
           "order by t limit 20")
BI_SQL["bi_20_recruitment"] = _Q20
BI_SQL["bi_20_recruitment_full"] = _Q20
