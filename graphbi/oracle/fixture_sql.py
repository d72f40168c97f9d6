"""DuckDB text of the fixture projection and derived tables (oracle side).

Each oracle query is ``WITH RECURSIVE <these CTEs>, <query CTEs> <select>``
over the pre-registered parquet views.  The definitions are the ones of
FIXTURES.md section B; the thread closure is a recursive CTE.
"""

from __future__ import annotations

# Projection rules of FIXTURES.md section B (must match the Spark side).
FIXTURE_CTES = [
    ("fx_n", "select (select count(*) from customer) as n_person, (select count(*) from supplier) as n_forum, "
             "(select count(*) from orders) as n_orders"),
    ("country", "select cast(n_nationkey as bigint) id, n_name as name, cast(n_regionkey as bigint) PartOfContinentId from nation"),
    ("city", "select cast(1000+n_nationkey*4+k as bigint) id, concat(n_name,'_C',cast(k as varchar(4))) as name, "
             "cast(n_nationkey as bigint) PartOfCountryId from nation cross join (values (0),(1),(2),(3)) t(k)"),
    ("company", "select cast(s_suppkey as bigint) id, s_name as name from supplier"),
    ("person", "select c_custkey id, c_name firstName, c_mktsegment lastName, "
               "cast(1000+c_nationkey*4+c_custkey%4 as bigint) LocationCityId, min(o_orderdate) creationDate "
               "from customer join orders on o_custkey=c_custkey group by c_custkey,c_name,c_mktsegment,c_nationkey"),
    ("knows_pairs", "select distinct least(a,b) Person1Id, greatest(a,b) Person2Id from ("
                    "select c_custkey a,(c_custkey+1)%n_person b from customer cross join fx_n "
                    "union all select c_custkey,(c_custkey*7+5)%n_person from customer cross join fx_n "
                    "union all select c_custkey, lead(c_custkey,1) over (partition by c_nationkey order by c_custkey) from customer "
                    "union all select c_custkey, lead(c_custkey,2) over (partition by c_nationkey order by c_custkey) from customer"
                    ") e where b is not null and a<>b"),
    ("person_knows_person", "select greatest(p1.creationDate,p2.creationDate) creationDate, Person1Id, Person2Id "
                            "from knows_pairs join person p1 on p1.id=Person1Id join person p2 on p2.id=Person2Id"),
    ("knows", "select creationDate, Person1Id, Person2Id from person_knows_person "
              "union all select creationDate, Person2Id, Person1Id from person_knows_person"),
    ("forum", "select cast(s_suppkey as bigint) id, concat(case s_suppkey%3 when 0 then 'Group ' when 1 then 'Album ' "
              "else 'Wall ' end, s_name) title, (s_suppkey*7+3)%n_person ModeratorPersonId, o_orderdate creationDate "
              "from supplier cross join fx_n join orders on o_orderkey=(s_suppkey*13+7)%(n_person*10)"),
    ("post", "select o_orderdate creationDate, o_orderkey*10 id, o_custkey CreatorPersonId, o_orderkey%n_forum ContainerForumId, "
             "case o_orderkey%4 when 0 then 'en' when 1 then 'fr' when 2 then 'de' else 'es' end as language, "
             "case when o_orderkey%10=0 then null else o_orderpriority end content, cast(o_orderkey%200 as int) length "
             "from orders cross join fx_n"),
    ("comment_dedup", "select l_orderkey ok, l_linenumber ln, min(l_shipdate) creationDate, min(l_partkey) pk, "
                      "cast(min(l_quantity) as int)*4 length from lineitem group by l_orderkey,l_linenumber"),
    ("comment_lag", "select ok, ln, creationDate, pk, length, lag(ln) over (partition by ok order by ln) pln from comment_dedup"),
    ("comment_t", "select c.creationDate, ok*10+ln id, case when pk%3<2 then (o_custkey+ln)%n_person else pk%n_person end "
                  "CreatorPersonId, case when pln is null then ok*10 end ParentPostId, case when pln is not null then "
                  "ok*10+pln end ParentCommentId, length, concat('c',cast(pk as varchar(20))) content, pk "
                  "from comment_lag c join orders on o_orderkey=ok cross join fx_n"),
    ("tag", "select distinct cast(substring(p_brand,7) as bigint) id, p_brand as name, "
            "cast(substring(p_brand,7) as bigint)%6 TypeTagClassId from part"),
    ("tagclass", "select row_number() over(order by p_type)-1 id, p_type as name from (select distinct p_type from part) t"),
    ("message_hastag", "select o_orderkey*10 MessageId, 1+o_orderkey%25 TagId from orders union all "
                       "select c.id, cast(substring(p_brand,7) as bigint) from comment_t c join part on p_partkey=c.pk"),
    ("liking", "select user_id p, event_id, event_id*7%(select count(*) from orders)*10 post from events "
               "where event_type in ('view','purchase')"),
    ("person_likes_message", "select p PersonId, post MessageId from liking union select p, post + 1 from liking "
                             "where event_id % 3 = 0 and post + 1 in (select id from comment_t)"),
    ("forum_hasmember", "select distinct f ForumId,p PersonId from (select c_custkey%n_forum f,c_custkey p from customer "
                        "cross join fx_n union all select (c_custkey*3+1)%n_forum,c_custkey from customer cross join fx_n "
                        "union all select o_orderkey%n_forum,o_custkey from orders cross join fx_n where o_orderkey%3=0) x"),
    ("person_hasinterest", "select distinct p PersonId,t TagId from (select c_custkey p,1+c_custkey%25 t from customer "
                           "union all select c_custkey,1+c_custkey*7%25 from customer) x"),
    ("person_studyat", "select c_custkey PersonId, cast(floor(c_custkey/50.0) as bigint) UniversityId, "
                       "cast(1990+c_custkey%17 as int) classYear from customer union all select c_custkey, "
                       "1000+c_custkey%7, cast(1990+c_custkey*3%17 as int) from customer"),
    ("person_workat", "select c_custkey PersonId, c_custkey%n_forum CompanyId from customer cross join fx_n"),
    ("timings", "select 'x' tool, cast(1 as double) sf, cast(cast(ts as date) as varchar(10)) as day, case when "
                "event_id%5=0 then 'power' else 'throughput' end batch_type, case when event_id%5=0 then "
                "cast(1+cast(floor(event_id/5.0) as bigint)%20 as varchar(3)) when event_id%2=0 then 'reads' else "
                "'writes' end q, abs(value)+0.001 as time from events"),
    # derived tables
    ("message_post", "select creationDate, id MessageId, id RootPostId, language RootPostLanguage, content, length, "
                     "CreatorPersonId, ContainerForumId, cast(null as bigint) ParentMessageId from post"),
    ("thread", "select MessageId, RootPostId, RootPostLanguage, ContainerForumId from message_post "
               "union all select c.id, t.RootPostId, t.RootPostLanguage, t.ContainerForumId from comment_t c "
               "join thread t on coalesce(c.ParentPostId, c.ParentCommentId) = t.MessageId"),
    ("message", "select * from message_post union all select c.creationDate, c.id, t.RootPostId, t.RootPostLanguage, "
                "c.content, c.length, c.CreatorPersonId, t.ContainerForumId, coalesce(c.ParentPostId, c.ParentCommentId) "
                "from comment_t c join thread t on t.MessageId = c.id"),
    ("member_country", "select fm.ForumId, ci.PartOfCountryId country, count(*) n from forum_hasmember fm "
                       "join person p on p.id = fm.PersonId join city ci on ci.id = p.LocationCityId group by 1, 2"),
    ("top_forums_q04", "select f.id, f.creationDate, max(mc.n) maxNumberOfMembers from forum f join member_country mc "
                       "on mc.ForumId = f.id group by f.id, f.creationDate"),
    ("popularity_q06", "select m.CreatorPersonId person2id, count(*) popularityScore from person_likes_message l "
                       "join message m on m.MessageId = l.MessageId group by 1"),
    ("reply_pairs", "select least(r.CreatorPersonId, m.CreatorPersonId) a, greatest(r.CreatorPersonId, m.CreatorPersonId) b "
                    "from message r join message m on m.MessageId = r.ParentMessageId "
                    "where r.CreatorPersonId <> m.CreatorPersonId"),
    ("q19_weights", "select a src, b dst, cast(greatest(round(40 - sqrt(count(*))), 1) as double) w from reply_pairs "
                    "where exists (select 1 from person_knows_person k where k.Person1Id = a and k.Person2Id = b) "
                    "group by a, b"),
    ("path_q19", "select src, dst, w from q19_weights union all select dst, src, w from q19_weights"),
    ("path_q20", "select k.Person1Id src, k.Person2Id dst, cast(1 + min(abs(s.classYear - t.classYear)) as int) w "
                 "from knows k join person_studyat s on s.PersonId = k.Person1Id join person_studyat t "
                 "on t.PersonId = k.Person2Id and t.UniversityId = s.UniversityId group by k.Person1Id, k.Person2Id"),
]


def with_fixture(*query_ctes: tuple[str, str], select: str) -> str:
    ctes = FIXTURE_CTES + list(query_ctes)
    body = ",\n".join(f"{name} AS ({sql})" for name, sql in ctes)
    return f"WITH RECURSIVE {body}\n{select}"
