"""DuckDB oracle texts for the derived-table and graph operator runs."""

from __future__ import annotations

from graphbi.oracle.bi_sql import _TRUSTED, MM_CTES, _sssp_sql, _ts
from graphbi.oracle.fixture_sql import with_fixture

OP_SQL: dict[str, str] = {}

OP_SQL["split_places"] = with_fixture(
    select="select 'Country' kind, id, name, PartOfContinentId parent from country "
           "union all select 'City', id, name, PartOfCountryId from city")
OP_SQL["split_organisations"] = with_fixture(
    select="select 'Company' kind, id, name from company union all select distinct 'University', UniversityId, "
           "concat('University_', cast(UniversityId as varchar)) from person_studyat")
OP_SQL["message_from_posts"] = with_fixture(select="select * from message_post")
OP_SQL["thread_root_closure"] = with_fixture(select="select * from message where ParentMessageId is not null")
OP_SQL["message_union"] = with_fixture(select="select * from message")
OP_SQL["likes_union"] = with_fixture(
    select="select PersonId, MessageId from person_likes_message where MessageId in (select MessageId from message)")
OP_SQL["tags_union"] = with_fixture(select="select * from message_hastag")
OP_SQL["knows_undirected"] = with_fixture(select="select * from knows")
OP_SQL["view_posts"] = with_fixture(select="select * from message where ParentMessageId is null")
OP_SQL["view_comments"] = with_fixture(select="select * from message where ParentMessageId is not null")
OP_SQL["precomp_forum_popularity"] = with_fixture(select="select * from top_forums_q04")
OP_SQL["precomp_popularity_score"] = with_fixture(select="select * from popularity_q06")
OP_SQL["precomp_interaction_edges"] = with_fixture(select="select * from path_q19")
OP_SQL["precomp_university_edges"] = with_fixture(select="select * from path_q20")
OP_SQL["trusted_edges"] = with_fixture(*MM_CTES, select=_TRUSTED)

_WALK = ("walk", "select 0::bigint node, 0 d union select k.Person2Id, w.d + 1 from walk w join knows k "
                 "on k.Person1Id = w.node where w.d < 4")
# nodes reachable by a walk of 1 or 2 steps (the seed too, when it has a friend)
OP_SQL["khop_neighbors"] = with_fixture(_WALK, select="select distinct node from walk where d between 1 and 2")
OP_SQL["hop_ring"] = with_fixture(_WALK, select="select node from walk group by node having min(d) between 3 and 4")
OP_SQL["count_triangles"] = with_fixture(
    select="select count(*) as count from person_knows_person e1 join person_knows_person e2 on e1.Person2Id = e2.Person1Id "
           "join person_knows_person e3 on e3.Person1Id = e1.Person1Id and e3.Person2Id = e2.Person2Id")
OP_SQL["common_neighbors"] = with_fixture(
    ("adj", "select k.Person1Id a, k.Person2Id f from knows k where k.Person1Id in (select PersonId from "
            "person_hasinterest where TagId = (select id from tag where name = 'Brand#3'))"),
    select="select x.a, y.a b, count(*) n from adj x join adj y on y.f = x.f where x.a <> y.a and not exists "
           "(select 1 from knows k where k.Person1Id = y.a and k.Person2Id = x.a) group by x.a, y.a")
OP_SQL["common_neighbors_top"] = with_fixture(
    select="select a, b, count(*) n from (select x.Person2Id a, y.Person2Id b from knows x join knows y using (Person1Id)) w "
           "anti join knows k on k.Person1Id = a and k.Person2Id = b where a <> b group by a, b order by n desc, a, b limit 100")
OP_SQL["thread_roots"] = (
    "with recursive t(id, parent, role, root_id, root_role, depth) as (select conv_id::bigint*4294967296+turn, cast(null as bigint), "
    "role, conv_id::bigint*4294967296+turn, role, 0 from conversations where turn = 0 union all select c.conv_id::bigint*4294967296+c.turn, "
    "c.conv_id::bigint*4294967296+c.turn-1, c.role, t.root_id, t.root_role, t.depth + 1 from conversations c join t "
    "on c.conv_id::bigint*4294967296+c.turn-1 = t.id and c.turn > 0) select id, parent, role, root_id, root_role, "
    "cast(depth as integer) depth from t where depth > 0")
OP_SQL["descendants"] = with_fixture(
    ("d", "select MessageId from message where ParentMessageId in (select MessageId from message where "
          f"ParentMessageId is null and creationDate between {_ts('1996-01-01')} and {_ts('1996-01-31')}) "
          "union select m.MessageId from message m join d on m.ParentMessageId = d.MessageId"),
    select="select MessageId from d")
_EMP = ("select pw.PersonId from person_workat pw, company c where pw.CompanyId = c.id "
        "and c.name = 'Supplier#000000033'")
OP_SQL["reachable"] = with_fixture(
    ("r", "select 7::bigint node union select p.dst from r join path_q20 p on p.src = r.node"),
    select=f"select exists (select 1 from r where node in ({_EMP})) as reachable")
OP_SQL["sssp_pair"] = with_fixture(
    ("paths", _sssp_sql("select * from path_q19", "select 0::bigint id")),
    select="select round(coalesce((select min(d) from paths where node = 700), -1.0), 6) as weight")
OP_SQL["sssp_multi"] = with_fixture(
    ("paths", _sssp_sql("select src, dst, cast(w as double) w from path_q20",
                        "select id from person where LocationCityId = 1008")),
    ("res", "select g f, node t, d w from paths where node in (select id from person where LocationCityId = 1021)"),
    select="select f person1_id, t person2_id, cast(w as bigint) w from res where w = (select min(w) from res)")
OP_SQL["sssp_one_to_many"] = with_fixture(
    ("paths", _sssp_sql("select * from path_q19", "select 0::bigint id")),
    ("res", "select node t, d w from paths where node in (select id from person where LocationCityId = 1021)"),
    select="select t person_id, round(w, 6) w from res where round(w, 6) = (select round(min(w), 6) from res) "
           "order by t limit 20")
OP_SQL["connected_components"] = with_fixture(
    ("nodes", "select src node from path_q20 union select dst from path_q20"),
    ("ue", "select src a, dst b from path_q20 union select dst, src from path_q20"),
    ("cc", "select node, component from (with recursive l(node, component) using key (node) as ("
           "select node, node from nodes union (select c.node, c.component from (select ue.b node, min(l.component) "
           "component from l join ue on ue.a = l.node group by ue.b) c join recurring.l r on r.node = c.node "
           "where c.component < r.component)) select * from l)"),
    select="select node, component from cc")

OP_SQL["exact_percentile"] = (
    "with r as (select l_returnflag, l_extendedprice, l_shipdate, count(*) over (partition by l_returnflag) n, "
    "row_number() over (partition by l_returnflag order by l_extendedprice) i, "
    "row_number() over (partition by l_returnflag order by l_shipdate) j from lineitem), "
    "p as (select unnest([0.05::double, 0.5::double, 0.95::double]) fraction) "
    "select l_returnflag, fraction, max(case when i = greatest(ceil(fraction * n), 1) then l_extendedprice end) price, "
    "max(case when j = greatest(ceil(fraction * n), 1) then l_shipdate end) shipped from r cross join p group by 1, 2")
