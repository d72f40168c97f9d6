"""DuckDB oracle texts for the factor tables and the parameter curation."""

from __future__ import annotations

from graphbi.oracle.bi_sql import _sssp_sql
from graphbi.oracle.fixture_sql import with_fixture

_DEL = "case when {0} % 10 = 0 then DATE '2000-06-01' else DATE '2030-01-01' end"


def _nearest(table: str, p: float, cols: str, order: str, k: int, population: str | None = None) -> str:
    """Top-k rows of ``table`` by distance of ``frequency`` to the discrete p-quantile of the population."""
    return (f"select {cols} from (select *, abs(frequency - (select quantile_disc(frequency, {p}) from {population or table})) "
            f"as dist from {table}) order by dist, {order} limit {k}")


# Salted windows of the curation jobs, in days from their anchor (first and last day).
WINDOW_02 = (-9, 200)  # the first of 20 starts, one day apart, and the length of each
WINDOWS_08 = [(n - 10, n + n * 37 % 5) for n in range(1, 21)]
WINDOWS_09 = sorted({(n * 37 % 10 - 5, 80 + n * 31 % 20 + more) for n in range(1, 21) for more in (0, 1)})
_STARTS_11 = [n * 37 % 30 - 15 for n in range(1, 21)]
WINDOWS_11 = {"China": [(d, d + 92) for d in _STARTS_11], "India": [(d, d + 92 + 47 % 18 + 1) for d in _STARTS_11]}
DAYS_13 = sorted({(n * 47 % 20 - 5, 0) for n in range(456789, 456810)})


def _offsets(pairs: list[tuple[int, int]]) -> str:
    """A relation ``o(lo, hi)`` of the given days."""
    return f"(values {', '.join(map(str, pairs))}) o(lo, hi)"


def _running(name: str, factor: str, days: int) -> list[tuple[str, str]]:
    """``<name>_run(name, day, total)``: messages of each name up to each of ``days`` days from 12 before the anchor on."""
    return [(f"{name}_day", f"select name, creationDay - a15 as day, sum(frequency) n from {factor}, day_anchor group by all"),
            (f"{name}_run", f"select name, day, sum(coalesce(n, 0)) over (partition by name order by day) total from (select distinct name from {name}_day) "
                            f"cross join (select unnest(range(-12, {days - 12})) as day) left join {name}_day using (name, day)")]


FACTOR_CTES = [
    ("pgeo", "select p.id, p.LocationCityId, ci.name cityName, co.id countryId, co.name countryName from person p "
             "join city ci on ci.id = p.LocationCityId join country co on co.id = ci.PartOfCountryId"),
    ("mtags", "select m.MessageId, cast(m.creationDate as date) creationDay, t.id TagId, t.name tagName, "
              "t.TypeTagClassId from message m join message_hastag mt on mt.MessageId = m.MessageId "
              "join tag t on t.id = mt.TagId"),
    ("cityNumPersons", "select LocationCityId id, cityName name, count(*) frequency from pgeo group by 1, 2"),
    ("countryNumPersons", "select countryId id, countryName name, count(*) frequency from pgeo group by 1, 2"),
    ("cityPairsNumFriends", "select a.LocationCityId city1Id, b.LocationCityId city2Id, a.cityName city1Name, "
                            "b.cityName city2Name, a.countryId country1Id, b.countryId country2Id, a.countryName "
                            "country1Name, b.countryName country2Name, count(*) frequency from knows k join pgeo a "
                            "on a.id = k.Person1Id join pgeo b on b.id = k.Person2Id group by all"),
    ("countryPairsNumFriends", "select country1Id, country2Id, country1Name, country2Name, cast(sum(frequency) as bigint) "
                               "frequency from cityPairsNumFriends group by all"),
    ("companyNumEmployees", "select c.id, c.name, count(*) frequency from person_workat w join company c "
                            "on c.id = w.CompanyId group by c.id, c.name"),
    ("countryNumMessages", "select g.countryId id, g.countryName name, count(*) frequency from message m join pgeo g "
                           "on g.id = m.CreatorPersonId group by 1, 2"),
    ("creationDayNumMessages", "select cast(creationDate as date) creationDay, count(*) frequency from message group by 1"),
    ("creationDayAndLengthCategoryNumMessages", "select cast(creationDate as date) creationDay, case when length < 40 "
                                                "then 0 when length < 80 then 1 when length < 160 then 2 else 3 end "
                                                "lengthCategory, count(*) frequency from message group by 1, 2"),
    ("creationDayAndTagNumMessages", "select creationDay, TagId tagId, tagName name, count(*) frequency from mtags "
                                     "group by 1, 2, 3"),
    ("creationDayAndTagClassNumMessages", "select creationDay, TypeTagClassId tagClassId, tc.name, count(*) frequency "
                                          "from mtags join tagclass tc on tc.id = mtags.TypeTagClassId group by 1, 2, 3"),
    ("languageNumPosts", "select language, count(*) frequency from post where language is not null group by 1"),
    ("lengthNumMessages", "select length, count(*) frequency from message group by 1"),
    ("personNumFriends", "select p.id, cast(p.creationDate as date) personCreationDate, "
                         f"{_DEL.format('p.id')} personDeletionDate, coalesce(d.frequency, 0) frequency from person p "
                         "left join (select Person1Id id, count(*) frequency from knows group by 1) d on d.id = p.id"),
    ("tagClassNumMessages", "select tc.id, tc.name, count(*) frequency from mtags join tagclass tc "
                            "on tc.id = mtags.TypeTagClassId group by 1, 2"),
    ("tagClassNumTags", "select tc.id, tc.name, count(*) frequency from tag join tagclass tc "
                        "on tc.id = tag.TypeTagClassId group by 1, 2"),
    ("tagNumMessages", "select TagId tagId, tagName, count(*) frequency from mtags group by 1, 2"),
    ("tagNumPersons", "select t.id tagId, t.name, count(*) frequency from person_hasinterest pi join tag t "
                      "on t.id = pi.TagId group by 1, 2"),
    ("personDays", f"select id, cast(creationDate as date) creationDay, {_DEL.format('id')} deletionDay from person"),
    ("personKnowsPersonDays", "select Person1Id, Person2Id, cast(creationDate as date) creationDay, "
                              f"{_DEL.format('(Person1Id + Person2Id)')} deletionDay from person_knows_person"),
    ("personStudyAtUniversityDays", "select s.PersonId, s.UniversityId, d.creationDay, d.deletionDay from person_studyat s "
                                    "join personDays d on d.id = s.PersonId"),
    ("personWorkAtCompanyDays", "select w.PersonId, w.CompanyId, d.creationDay, d.deletionDay from person_workat w "
                                "join personDays d on d.id = w.PersonId"),
    ("personDays_window", "select * exclude (creationDay, deletionDay) from personDays "
                          "where creationDay < DATE '2000-01-01' and deletionDay > DATE '2000-12-31'"),
    ("pkp_window", "select * exclude (creationDay, deletionDay) from personKnowsPersonDays "
                   "where creationDay < DATE '2000-01-01' and deletionDay > DATE '2000-12-31'"),
    ("personKnowsPersonDays_window", "select Person1Id, Person2Id from pkp_window union all "
                                     "select Person2Id, Person1Id from pkp_window"),
    ("personStudyAtUniversityDays_window", "select * exclude (creationDay, deletionDay) from personStudyAtUniversityDays "
                                           "where creationDay < DATE '2000-01-01' and deletionDay > DATE '2000-12-31'"),
    ("personWorkAtCompanyDays_window", "select * exclude (creationDay, deletionDay) from personWorkAtCompanyDays "
                                       "where creationDay < DATE '2000-01-01' and deletionDay > DATE '2000-12-31'"),
    ("alive_friends", "select n.* from personNumFriends n semi join personDays_window d on d.id = n.id"),
    ("hop_seeds", _nearest("alive_friends", 0.55, "id", "id", 50, "personNumFriends")),
    ("unit_knows", "select Person1Id src, Person2Id dst, 1.0::double w from knows"),
    ("hop_dist", _sssp_sql("select * from unit_knows", "select id from hop_seeds")),
    ("people2Hops", "select h.g person1Id, h.node person2Id, cast(p1.creationDate as date) person1CreationDate, "
                    f"{_DEL.format('h.g')} person1DeletionDate, cast(p2.creationDate as date) person2CreationDate, "
                    f"{_DEL.format('h.node')} person2DeletionDate from hop_dist h join person p1 on p1.id = h.g "
                    "join person p2 on p2.id = h.node where h.d = 2"),
    ("people4Hops", "select h.g person1Id, h.node person2Id, cast(p1.creationDate as date) person1CreationDate, "
                    f"{_DEL.format('h.g')} person1DeletionDate, cast(p2.creationDate as date) person2CreationDate, "
                    f"{_DEL.format('h.node')} person2DeletionDate from hop_dist h join person p1 on p1.id = h.g "
                    "join person p2 on p2.id = h.node where h.d = 4"),
    # one row per shared university (a pair studying together twice appears twice)
    ("q20_sameUniversityKnows", "select k.Person1Id person1Id, k.Person2Id person2Id from personKnowsPersonDays_window k "
                                "join personStudyAtUniversityDays_window a on a.PersonId = k.Person1Id "
                                "join personStudyAtUniversityDays_window b on b.PersonId = k.Person2Id "
                                "and b.UniversityId = a.UniversityId"),
    ("suk_nodes", "select person1Id node from q20_sameUniversityKnows union select person2Id from q20_sameUniversityKnows"),
    ("suk_cc", "select node, component from (with recursive l(node, component) using key (node) as ("
               "select node, node from suk_nodes union (select c.node, c.component from (select e.person2Id node, "
               "min(l.component) component from l join q20_sameUniversityKnows e on e.person1Id = l.node "
               "group by e.person2Id) c join recurring.l r on r.node = c.node where c.component < r.component)) "
               "select * from l)"),
    ("sameUniversityConnected", "select d.id PersonId, coalesce(c.component, d.id) Component from personDays_window d "
                                "left join suk_cc c on c.node = d.id"),
    ("day_anchor", "select quantile_disc(creationDay, 0.15) a15, quantile_disc(creationDay, 0.79) a79, "
                   "quantile_disc(creationDay, 0.89) a89, quantile_disc(creationDay, 0.92) a92, "
                   "quantile_disc(creationDay, 0.94) a94, quantile_disc(creationDay, 0.95) a95, "
                   "quantile_disc(creationDay, 0.10) a10 from creationDayNumMessages"),
    # windows are differences of running sums over a calendar of days around the anchor
    *_running("classes", "creationDayAndTagClassNumMessages", 230),
    ("q2_windows", "select (a15 + (b.day + 1)::integer)::date date, b.name tagClassName, (e.total - b.total)::bigint frequency from day_anchor, "
                   f"classes_run b join classes_run e on e.name = b.name and e.day = b.day + {WINDOW_02[1]} "
                   f"where b.day between {WINDOW_02[0]} - 1 and {WINDOW_02[0]} + 18 and e.total > b.total"),
    *_running("tags", "creationDayAndTagNumMessages", 40),
    ("q8_windows", f"select (a15 + lo)::date startDate, (a15 + hi)::date endDate, b.name tagName, (e.total - b.total)::bigint frequency from day_anchor, "
                   f"{_offsets(WINDOWS_08)} join tags_run b on b.day = lo - 1 join tags_run e on e.name = b.name and e.day = hi where e.total > b.total"),
    ("k4_sample", "select person1Id, person2Id from people4Hops order by person1Id, person2Id limit 80"),
    ("q15a_core", "select distinct s.person1Id, s.person2Id, b.Person2Id middleCandidate from k4_sample s "
                  "join personKnowsPersonDays_window a on a.Person1Id = s.person1Id "
                  "join personKnowsPersonDays_window b on b.Person1Id = a.Person2Id"),
    # four employees of each company, by the order of their ids' digests
    ("emp_four", "select CompanyId companyId, unnest(arg_min(PersonId, md5(PersonId::varchar), 4)) person1Id "
                 "from personWorkAtCompanyDays_window group by CompanyId"),
    ("emp_size", "select f.person1Id, f.companyId, c.name companyName, c.frequency from emp_four f "
                 "join companyNumEmployees c on c.id = f.companyId"),
    ("q20b_comp", _nearest("emp_size", 0.47, "person1Id, companyId, companyName",
                           "md5(person1Id::varchar), md5(companyId::varchar)", 200, "companyNumEmployees")),
    ("q20b_twohop", "select c.companyId, c.companyName, h2.person2Id from q20b_comp c join q20_sameUniversityKnows h1 "
                    "on h1.person1Id = c.person1Id join q20_sameUniversityKnows h2 on h2.person1Id = h1.person2Id "
                    "where h2.person2Id <> h1.person1Id"),
]


def _q(select: str, *extra) -> str:
    return with_fixture(*FACTOR_CTES, *extra, select=select)


CUR_SQL: dict[str, str] = {}

CUR_SQL["pg_01"] = _q(
    "select strftime(d + to_hours(trunc(e / 37 % 24)::bigint) + to_minutes(trunc(e / 37 % 60)::bigint) + to_seconds(e / 31 % 60), "
    "'%Y-%m-%dT%H:%M:%S.%g+00:00') datetime from (select creationDay::timestamp d, epoch(creationDay::timestamp) e from ("
    + _nearest("creationDayNumMessages", 0.15, "creationDay", "creationDay", 80) + "))")
CUR_SQL["pg_02_windows"] = _q("select * from q2_windows")
for key, p in (("pg_02a", 0.92), ("pg_02b", 0.62)):
    CUR_SQL[key] = _q("select date, tagClassName tagClass from (" +
                      _nearest("q2_windows", p, "date, tagClassName", "date, tagClassName", 400) + ")")
CUR_SQL["pg_03"] = _q("select name tagClass, case when id % 2 = 0 then 'China' else 'India' end country from (" +
                      _nearest("tagClassNumMessages", 0.82, "id, name", "name", 80) + ")")
CUR_SQL["pg_04"] = _q("select creationDay date from (select creationDay from creationDayNumMessages "
                      "order by creationDay limit 40)")
for key, p, k in (("pg_05", 0.85, 400), ("pg_06", 0.88, 400), ("pg_07", 0.98, 200)):
    CUR_SQL[key] = _q("select tagName tag from (" + _nearest("tagNumMessages", p, "tagName", "tagName", k) + ")")
CUR_SQL["pg_08_windows"] = _q("select * from q8_windows")
for key, p in (("pg_08a", 0.98), ("pg_08b", 0.31)):
    CUR_SQL[key] = _q("select tagName tag, startDate, endDate from (" +
                      _nearest("q8_windows", p, "tagName, startDate, endDate", "tagName, startDate", 100) + ")")
CUR_SQL["pg_09"] = _q(f"select (a89 + lo)::date startDate, (a89 + hi)::date endDate from day_anchor, {_offsets(WINDOWS_09)}")


def _pg10(countries: str, persons: str, classes: str) -> str:
    return _q("select pe.id personId, c.countryName country, tc.tagClassName tagClass, 3 minPathDistance, "
              "4 maxPathDistance from pe join c on true join tc on true "
              "order by md5(pe.id::varchar || c.countryName || tc.tagClassName) limit 400",
              ("c", countries), ("pe", persons), ("tc", classes))


CUR_SQL["pg_10a"] = _pg10(
    "select name countryName from (" + _nearest("countryNumPersons", 0.55, "name", "name", 20) + ")",
    "select id from hop_seeds",
    "select name tagClassName from (" + _nearest("tagClassNumTags", 0.55, "name", "name", 15) + ")")
CUR_SQL["pg_10b"] = _pg10(
    "select name countryName from (" + _nearest("countryNumPersons", 0.35, "name", "name", 20) + ")",
    "select id from alive_friends where frequency = 1 order by id limit 50",
    "select name tagClassName from (" + _nearest("tagClassNumTags", 0.25, "name", "name", 15) + ")")
CUR_SQL["pg_11"] = _q(" union all ".join(
    f"select '{country}' country, (a92 + lo)::date startDate, (a92 + hi)::date endDate from day_anchor, {_offsets(pairs)}"
    for country, pairs in WINDOWS_11.items()))
# four orders of the languages by digest, the first three of each; every salt shifts the day and the length alike
CUR_SQL["pg_12"] = _q(
    "select (a79 + i * 3)::date startDate, (150 - 5 * i)::integer lengthThreshold, languages from day_anchor, "
    "(select unnest(generate_series(1, 20))::integer i), (select array_to_string(list_slice(list(language order by "
    "md5(concat(language, o))), 1, 3), ';') languages from langs, (select unnest([1, 2, 3, 4]) o) group by o)",
    ("langs", _nearest("languageNumPosts", 0.98, "language", "language", 10)))
CUR_SQL["pg_13"] = _q(f"select country, (a94 + lo)::date endDate from day_anchor, {_offsets(DAYS_13)}, (values ('China'), ('India')) c(country)")
for key, p in (("pg_14a", 0.98), ("pg_14b", 0.03)):
    CUR_SQL[key] = _q("select country1Name country1, country2Name country2 from (" +
                      _nearest("countryPairsNumFriends", p, "country1Name, country2Name", "country1Name, country2Name", 50)
                      + ")")
CUR_SQL["pg_15a_core"] = _q("select * from q15a_core")
CUR_SQL["pg_15a"] = _q(
    "select distinct q.person1Id, q.person2Id, (x.a95 - (q.person1Id % 7)::integer)::date startDate, "
    "(x.a95 + (q.person2Id % 7)::integer)::date endDate from q15a_core q, day_anchor x where exists (select 1 from "
    "personKnowsPersonDays_window a join personKnowsPersonDays_window b on b.Person1Id = a.Person2Id "
    "where a.Person1Id = q.person2Id and b.Person2Id = q.middleCandidate)")
CUR_SQL["pg_15b"] = _q(
    "select * from (select distinct h.person1Id, h.person2Id, (x.a10 + (h.person1Id % 9 - 11)::integer)::date startDate, "
    "(x.a10 + (h.person1Id % 9 + 11)::integer)::date endDate from people2Hops h, day_anchor x where exists (select 1 from "
    "personKnowsPersonDays_window a join personKnowsPersonDays_window b on b.Person1Id = a.Person2Id "
    "where a.Person1Id = h.person1Id and b.Person2Id = h.person2Id)) "
    "order by md5((131 * person1Id + 241 * person2Id)::varchar), md5(person1Id::varchar) limit 400")


def _pg16(pa: float, pb: float) -> str:
    """Tags with their last (A) and first (B) day of a frequency, each nearest to its percentile; pairs of unequal tags."""
    last = _nearest("tag_days", pa, "name, last_day", "md5(name), frequency", 100, "creationDayAndTagNumMessages")
    first = _nearest("tag_days", pb, "name, first_day", "md5(name), frequency", 100, "creationDayAndTagNumMessages")
    return _q("select a.name tagA, last_day dateA, b.name tagB, first_day dateB, (3 + (dayofyear(last_day) + "
              "dayofyear(first_day)) % 4)::integer maxKnowsLimit from picked_a a, picked_b b where a.name <> b.name "
              "order by md5(concat(a.name, b.name)), last_day, first_day limit 400",
              ("tag_days", "select name, frequency, max(creationDay) last_day, min(creationDay) first_day "
                           "from creationDayAndTagNumMessages group by name, frequency"),
              ("picked_a", last), ("picked_b", first))


CUR_SQL["pg_16a"] = _pg16(1.00, 0.995)
CUR_SQL["pg_16b"] = _pg16(0.45, 0.37)
CUR_SQL["pg_17"] = _q(
    "select tagName tag, cast(8 + list_sum(list_transform(string_split(tagName, ''), lambda ch: unicode(ch))) % 9 "
    "as integer) delta from (" + _nearest("tagNumMessages", 0.27, "tagName", "tagName", 400) + ")")
CUR_SQL["pg_18"] = _q("select name tag from (" + _nearest("tagNumPersons", 0.99, "name", "name", 400) + ")")
for key, cond in (("pg_19a", "<>"), ("pg_19b", "=")):
    CUR_SQL[key] = _q(f"select city1Id, city2Id from cityPairsNumFriends where country1Id {cond} country2Id order by "
                      "md5((city1Id * 3532569367 + city2Id * 342663089)::varchar) limit 400")
CUR_SQL["pg_20_same_university_knows"] = _q("select * from q20_sameUniversityKnows")
# a company and a person fit if no employee is in the person's component
CUR_SQL["pg_20a"] = _q(
    "select c.name company, p.id person2Id from picked_c c, picked_p p where not list_contains(c.comps, p.Component) "
    "order by md5(concat(p.id, c.id)), md5(p.id::varchar), md5(c.id::varchar) limit 400",
    ("staff_comps", "select CompanyId, list(distinct Component) comps from personWorkAtCompanyDays_window "
                    "join sameUniversityConnected using (PersonId) group by CompanyId"),
    ("picked_c", "select n.id, n.name, coalesce(comps, []) comps from (" +
     _nearest("companyNumEmployees", 0.9, "id, name", "name, id", 50) + ") n left join staff_comps on CompanyId = n.id"),
    ("picked_p", "select n.id, Component from (" +
     _nearest("alive_friends", 0.55, "id", "md5(id::varchar)", 50, "personNumFriends") +
     ") n join sameUniversityConnected on PersonId = n.id"))
CUR_SQL["pg_20b_comp"] = _q("select * from q20b_comp")
CUR_SQL["pg_20b_twohop"] = _q("select * from q20b_twohop")
CUR_SQL["pg_20b"] = _q(
    "select company, person2Id from (select distinct t.companyName company, t.companyId, t.person2Id from q20b_twohop t "
    "left join personWorkAtCompanyDays_window w on w.CompanyId = t.companyId and w.PersonId = t.person2Id "
    "where w.PersonId is null) order by md5(person2Id::varchar), md5(companyId::varchar) limit 400")
CUR_SQL["pg_knows_window"] = _q("select * from personKnowsPersonDays_window")

# factor tables themselves
FACTOR_KEYS = {
    "f_city_num_persons": "cityNumPersons", "f_country_num_persons": "countryNumPersons",
    "f_city_pairs_num_friends": "cityPairsNumFriends", "f_country_pairs_num_friends": "countryPairsNumFriends",
    "f_company_num_employees": "companyNumEmployees", "f_country_num_messages": "countryNumMessages",
    "f_creation_day_num_messages": "creationDayNumMessages",
    "f_creation_day_length_category_num_messages": "creationDayAndLengthCategoryNumMessages",
    "f_creation_day_tag_num_messages": "creationDayAndTagNumMessages",
    "f_creation_day_tagclass_num_messages": "creationDayAndTagClassNumMessages",
    "f_language_num_posts": "languageNumPosts", "f_length_num_messages": "lengthNumMessages",
    "f_people_2_hops": "people2Hops", "f_people_4_hops": "people4Hops", "f_person_num_friends": "personNumFriends",
    "f_tagclass_num_messages": "tagClassNumMessages", "f_tagclass_num_tags": "tagClassNumTags",
    "f_tag_num_messages": "tagNumMessages", "f_tag_num_persons": "tagNumPersons",
    "f_same_university_connected": "sameUniversityConnected", "f_person_days": "personDays",
    "f_person_knows_person_days": "personKnowsPersonDays",
    "f_person_study_at_university_days": "personStudyAtUniversityDays",
    "f_person_work_at_company_days": "personWorkAtCompanyDays",
    "scan_parquet_temporal_window": "personWorkAtCompanyDays_window",
}
for key, table in FACTOR_KEYS.items():
    CUR_SQL[key] = _q(f"select * from {table}")

# uniform (naive) samples
CUR_SQL["naive_pg_01"] = _q("select strftime(creationDay::timestamp, '%Y-%m-%dT%H:%M:%S.%g+00:00') datetime "
                            "from creationDayNumMessages order by md5(creationDay::varchar), creationDay limit 400")
CUR_SQL["naive_pg_02m"] = _q("select date, tagClassName name, frequency from q2_windows")
CUR_SQL["naive_pg_02a"] = _q("select date, tagClassName tagClass from q2_windows "
                             "order by md5(concat(date, tagClassName)), date, tagClassName limit 400")
CUR_SQL["naive_pg_04"] = _q("select creationDay date from creationDayNumMessages")
for _k, _s in (("naive_pg_05", "a"), ("naive_pg_06", "b"), ("naive_pg_07", "c"), ("naive_pg_18", "e")):
    CUR_SQL[_k] = _q(f"select tagName tag from tagNumMessages order by md5(tagName || '{_s}'), tagName limit 400")
CUR_SQL["naive_pg_08m"] = _q("select startDate, endDate, tagName name, frequency from q8_windows")
CUR_SQL["naive_pg_08a"] = _q("select tagName tag, startDate, endDate from q8_windows "
                             "order by md5(concat(tagName, startDate)), tagName, startDate limit 400")
CUR_SQL["naive_pg_14a"] = _q("select country1Name country1, country2Name country2 from countryPairsNumFriends "
                             "order by md5(concat(country1Name, country2Name)), country1Name, country2Name limit 400")
CUR_SQL["naive_pg_17"] = _q("select tagName tag, cast(8 + (select sum(x) from (select unicode(unnest(string_split("
                            "tagName, ''))) x)) % 9 as integer) delta from tagNumMessages order by md5(tagName || 'e'), tagName limit 400")
CUR_SQL["naive_pg_19a"] = _q("select city1Id, city2Id from cityPairsNumFriends order by "
                             "md5((3532569367::bigint*city1Id + 342663089::bigint*city2Id)::varchar), city1Id, city2Id "
                             "limit 400")
for _v in ("02", "08", "14", "19"):
    CUR_SQL[f"naive_pg_{_v}b"] = CUR_SQL[f"naive_pg_{_v}a"]
CUR_SQL["naive_pg_09"] = _q("select creationDay + ((i * 37) % 10 - 5) startDate, creationDay + (80 + (i * 31) % 20) endDate "
                            "from creationDayNumMessages join (select range::integer i from range(1, 21)) on true")
CUR_SQL["naive_pg_12"] = _q(
    "select (hd.lo + i * 3)::date startDate, (150 - 5 * i)::integer lengthThreshold, languages from hashed_days hd, "
    "(select unnest(generate_series(1, 20))::integer i), (select array_to_string(list_slice(list(language order by "
    "md5(concat(language, o))), 1, 3), ';') languages from langs, (select unnest([1, 2, 3, 4]) o) group by o)",
    ("langs", "select language from languageNumPosts order by md5(language), language limit 10"),
    ("hashed_days", "select arg_min(creationDay, md5(creationDay::varchar)) lo from creationDayNumMessages"))
CUR_SQL["naive_pg_15a"] = CUR_SQL["naive_pg_15b"] = _q(
    "select x.id person1Id, y.id person2Id, hd.lo - (x.id % 7)::integer startDate, hd.hi + (y.id % 7)::integer endDate "
    "from ranked x join ranked y on x.up <= 20 and y.down <= 20 join hashed_days hd on true",
    ("ranked", "select id, row_number() over (order by md5(id::varchar)) up, row_number() over (order by md5(id::varchar) desc) "
               "down from personNumFriends"),
    ("hashed_days", "select arg_min(creationDay, md5(creationDay::varchar)) lo, arg_max(creationDay, md5(creationDay::varchar)) hi "
                    "from creationDayNumMessages"))
CUR_SQL["naive_pg_16a"] = CUR_SQL["naive_pg_16b"] = _q(
    "select x.name tagA, x.creationDay dateA, y.name tagB, y.creationDay dateB, (3 + (dayofyear(x.creationDay) + "
    "dayofyear(y.creationDay)) % 4)::integer maxKnowsLimit from ranked x join ranked y on x.up <= 100 and y.down <= 100 "
    "and x.name <> y.name order by md5(x.name || y.name), dateA, dateB limit 400",
    ("ranked", "select creationDay, name, row_number() over (order by md5(creationDay::varchar || name)) up, row_number() "
               "over (order by md5(creationDay::varchar || name) desc) down from creationDayAndTagNumMessages"))

# products of a factor with places or sampled persons: each kept row has fewer than the limit before it in the hash order
_HASHED_PERSONS = ("hashed_persons", "select id, row_number() over (order by md5(id::varchar)) place from personNumFriends "
                                     "qualify place <= 100")
_FIRST_400 = "qualify row_number() over (order by h) <= 400"
CUR_SQL["naive_pg_03"] = _q("select t.name tagClass, c.name country from tagClassNumMessages t join countryNumPersons c on true")
CUR_SQL["naive_pg_10a"] = CUR_SQL["naive_pg_10b"] = _q(
    "select personId, country, tagClass, 3::integer minPathDistance, 4::integer maxPathDistance from triples " + _FIRST_400,
    _HASHED_PERSONS,
    ("triples", "select p.id personId, c.name country, t.name tagClass, md5(p.id::varchar || c.name || t.name) h "
                "from hashed_persons p join countryNumPersons c on true join tagClassNumTags t on true"))
CUR_SQL["naive_pg_11"] = _q(
    "select c.name country, d.creationDay + o.lo startDate, d.creationDay + o.hi endDate from creationDayNumMessages d "
    "join countryNumPersons c on true join " + _offsets([(n * 37 % 30 - 15, n * 37 % 30 + 77 + n * 47 % 18) for n in (1, 2, 3)])
    + " on true")
CUR_SQL["naive_pg_13"] = _q("select country, endDate from pairs " + _FIRST_400,
                            ("pairs", "select c.name country, d.creationDay endDate, md5(c.name || d.creationDay::varchar) h "
                                      "from creationDayNumMessages d join countryNumPersons c on true"))
CUR_SQL["naive_pg_20a"] = CUR_SQL["naive_pg_20b"] = _q(
    "select company, person2Id from pairs " + _FIRST_400, _HASHED_PERSONS,
    ("pairs", "select c.name company, p.id person2Id, md5((211::bigint * p.id + c.id * 3532569367::bigint)::varchar) h "
              "from hashed_persons p join companyNumEmployees c on true"))
CUR_SQL["f_person_disjoint_employer_pairs"] = _q(
    "select p.id person2Id, c.name companyName, c.id companyId, cast(p.creationDate as date) person2CreationDate, "
    + _DEL.format("p.id") + " person2DeletionDate from person p semi join hop_seeds using (id) join company c on not exists "
    "(select 1 from person_workat w where w.PersonId = p.id and w.CompanyId = c.id)")
