"""Parameter curation: choose query parameters from the factor tables.

The common step is :func:`curate_by_percentile`: rows whose frequency is
nearest to the discrete p-percentile, ties broken by key, top k.  Date
anchors are discrete percentiles of the creation days.  Products of curated
lists (each capped by its own top-k, so of fixed size) are built by exploding
arrays gathered with scalar subqueries - no Cartesian join of data-sized
inputs.  Unordered LIMITs and string aggregates of the original jobs get a
deterministic tie-break.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphbi.plans import factors as FT


# Percentile p and row limit k of every curation job (they must
# equal the workload's so that the same parameters are chosen).
P = {
    "pg_01": (0.15, 80), "pg_02a": (0.92, 400), "pg_02b": (0.62, 400), "pg_03": (0.82, 80), "pg_04": (None, 40),
    "pg_05": (0.85, 400), "pg_06": (0.88, 400), "pg_07": (0.98, 200), "pg_08a": (0.98, 100), "pg_08b": (0.31, 100),
    "pg_10a_country": (0.55, 20), "pg_10a_person": (0.55, 50), "pg_10a_tagclass": (0.55, 15),
    "pg_10b_country": (0.35, 20), "pg_10b_person": (None, 50), "pg_10b_tagclass": (0.25, 15),
    "pg_12_language": (0.98, 10), "pg_14a": (0.98, 50), "pg_14b": (0.03, 50), "pg_15a_sample": (None, 80),
    "pg_15b": (None, 400), "pg_16a_a": (1.00, 100), "pg_16a_b": (0.995, 100), "pg_16b_a": (0.45, 100),
    "pg_16b_b": (0.37, 100), "pg_16": (None, 400), "pg_17": (0.27, 400), "pg_18": (0.99, 400), "pg_19": (None, 400),
    "pg_20a_company": (0.9, 50), "pg_20a_person": (0.55, 50), "pg_20a": (None, 400), "pg_20b_comp": (0.47, 200),
    "pg_20b": (None, 400), "pg_10": (None, 400), "naive": (None, 400),
    "naive_pg_10_person": (None, 100), "naive_pg_20_person": (None, 100),
    "naive_pg_12_language": (None, 10), "naive_pg_15_person": (None, 20), "naive_pg_16_side": (None, 100),
}
# Discrete percentiles of the creation days used as date anchors.
ANCHOR = {"pg_02": 0.15, "pg_08": 0.15, "pg_09": 0.89, "pg_11": 0.92, "pg_12": 0.79, "pg_13": 0.94, "pg_15a": 0.95,
          "pg_15b": 0.10}


class Factors:
    """Lazily built factor and temporal tables of one graph snapshot."""

    def __init__(self, spark: SparkSession, g):
        self.spark, self.g = spark, g

    @cached_property
    def creationDayNumMessages(self):
        return FT.creation_day_num_messages(self.g)

    @cached_property
    def creationDayAndTagClassNumMessages(self):
        return FT.creation_day_tagclass_num_messages(self.g)

    @cached_property
    def creationDayAndTagNumMessages(self):
        return FT.creation_day_tag_num_messages(self.g)

    @cached_property
    def tagClassNumMessages(self):
        return FT.tagclass_num_messages(self.g)

    @cached_property
    def tagClassNumTags(self):
        return FT.tagclass_num_tags(self.g)

    @cached_property
    def tagNumMessages(self):
        return FT.tag_num_messages(self.g)

    @cached_property
    def tagNumPersons(self):
        return FT.tag_num_persons(self.g)

    @cached_property
    def countryNumPersons(self):
        return FT.country_num_persons(self.g)

    @cached_property
    def personNumFriends(self):
        return FT.person_num_friends(self.g)

    @cached_property
    def languageNumPosts(self):
        return FT.language_num_posts(self.g)

    @cached_property
    def countryPairsNumFriends(self):
        return FT.country_pairs_num_friends(self.g)

    @cached_property
    def cityPairsNumFriends(self):
        return FT.city_pairs_num_friends(self.g)

    @cached_property
    def companyNumEmployees(self):
        return FT.company_num_employees(self.g)

    @cached_property
    def people2Hops(self):
        return FT.people_2_hops(self.g, hop_seeds(self))

    @cached_property
    def people4Hops(self):
        return FT.people_4_hops(self.g, hop_seeds(self))

    @cached_property
    def personDisjointEmployerPairs(self):
        return FT.person_disjoint_employer_pairs(self.g, hop_seeds(self))

    @cached_property
    def personDays_window(self):
        return FT.alive_window(FT.person_days(self.g))

    @cached_property
    def personKnowsPersonDays_window(self):
        return FT.knows_window(self.g)

    @cached_property
    def personWorkAtCompanyDays_window(self):
        return FT.alive_window(FT.person_work_at_company_days(self.g))

    @cached_property
    def sameUniversityKnows(self):
        return FT.same_university_knows(self.g)

    @cached_property
    def sameUniversityConnected(self):
        return FT.same_university_connected(self.spark, self.g)


# --- building blocks -------------------------------------------------------

def percentile_disc(df: DataFrame, col: str, p: float) -> Column:
    """Discrete percentile of a column as a scalar subquery."""
    return df.select(F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY {col})")).scalar()


def percentile_day(df: DataFrame, col: str, p: float) -> Column:
    """Discrete percentile of a DATE column (ranked as days since epoch)."""
    days = df.select(F.unix_date(F.col(col)).alias("_d"))
    return F.date_from_unix_date(percentile_disc(days, "_d", p))


def curate_by_percentile(df: DataFrame, p: float, keys: list, k: int, value: str = "frequency",
                         population: DataFrame | None = None) -> DataFrame:
    """Top-k rows nearest to the discrete p-percentile of ``value`` in ``population`` (by default in ``df``)."""
    target = percentile_disc(df if population is None else population, value, p)
    return df.withColumn("diff", F.abs(F.col(value) - target)).orderBy("diff", *keys).limit(k)


def _md5(*cols) -> Column:
    return F.md5(F.concat(*[F.col(c).cast("string") if isinstance(c, str) else c.cast("string") for c in cols]))


def _one(spark: SparkSession, **scalars: Column) -> DataFrame:
    return spark.range(1).select(*[v.alias(k) for k, v in scalars.items()])


def _array_of(df: DataFrame, *cols: str) -> Column:
    """A bounded (top-k) DataFrame gathered into one array scalar."""
    return df.select(F.collect_list(F.struct(*cols))).scalar()


def _add_days(d: Column, n) -> Column:
    return F.date_add(d, (n if isinstance(n, Column) else F.lit(n)).cast("int"))


# --- curation jobs -----------------------------------------------------------

def pg_01(f: Factors) -> DataFrame:
    top = curate_by_percentile(f.creationDayNumMessages, P["pg_01"][0], ["creationDay"], P["pg_01"][1])
    h, m = F.expr("(x div 37) % 24"), F.expr("(x div 37) % 60")
    # hours and minutes count whole, seconds with their fraction
    sec = F.expr("cast(cast(x as double) / 31 % 60 * 1000000 as bigint)")
    shifted = (top.withColumn("x", F.unix_timestamp(F.col("creationDay").cast("timestamp")))
               .withColumn("_ts", F.timestamp_micros((F.col("x") + h * 3600 + m * 60) * 1000000 + sec)))
    return (shifted.select(F.date_format("_ts", "yyyy-MM-dd'T'HH:mm:ss.SSS'+00:00'").alias("datetime"), "creationDay")
            .orderBy(_md5("creationDay")).select("datetime"))


def pg_02_windows(f: Factors) -> DataFrame:
    anchor = percentile_day(f.creationDayNumMessages, "creationDay", ANCHOR["pg_02"])
    rows = f.creationDayAndTagClassNumMessages.withColumn("_off", F.datediff("creationDay", anchor))
    lo, hi = F.greatest(F.lit(1), F.col("_off") - 189), F.least(F.lit(20), F.col("_off") + 10)
    salted = rows.where(lo <= hi).withColumn("salt", F.explode(F.sequence(lo, hi)))
    return (salted.groupBy(F.col("name").alias("tagClassName"), "salt").agg(F.sum("frequency").alias("frequency"))
            .select(_add_days(anchor, F.col("salt") - 10).alias("date"), "tagClassName", "frequency"))


def _pg_02(f: Factors, key: str) -> DataFrame:
    p, k = P[key]
    top = curate_by_percentile(pg_02_windows(f), p, ["date", "tagClassName"], k)
    return top.orderBy(_md5("tagClassName", "date")).select("date", F.col("tagClassName").alias("tagClass"))


def pg_02a(f):
    return _pg_02(f, "pg_02a")


def pg_02b(f):
    return _pg_02(f, "pg_02b")


def pg_03(f: Factors) -> DataFrame:
    top = curate_by_percentile(f.tagClassNumMessages, P["pg_03"][0], ["name"], P["pg_03"][1])
    return top.select(F.col("name").alias("tagClass"),
                      F.when(F.col("id") % 2 == 0, "China").otherwise("India").alias("country"))


def pg_04(f: Factors) -> DataFrame:
    first = f.creationDayNumMessages.select("creationDay").orderBy("creationDay").limit(P["pg_04"][1])
    return first.orderBy(_md5("creationDay")).select(F.col("creationDay").alias("date"))


def _tag_curation(f: Factors, key: str) -> DataFrame:
    p, k = P[key]
    top = curate_by_percentile(f.tagNumMessages, p, ["tagName"], k)
    return top.orderBy(_md5("tagName")).select(F.col("tagName").alias("tag"))


def pg_05(f):
    return _tag_curation(f, "pg_05")


def pg_06(f):
    return _tag_curation(f, "pg_06")


def pg_07(f):
    return _tag_curation(f, "pg_07")


def pg_08_windows(f: Factors) -> DataFrame:
    anchor = percentile_day(f.creationDayNumMessages, "creationDay", ANCHOR["pg_08"])
    salt = F.col("salt")
    start = _add_days(anchor, salt - 10)
    end = _add_days(anchor, salt + salt * 37 % 5)
    # every row meets at most 20 salts: a bounded expansion, then the range test
    salted = (f.creationDayAndTagNumMessages.withColumn("salt", F.explode(F.sequence(F.lit(1), F.lit(20))))
              .where(F.col("creationDay").between(start, end)))
    return (salted.groupBy(F.col("name").alias("tagName"), "salt").agg(F.sum("frequency").alias("frequency"))
            .select(start.alias("startDate"), end.alias("endDate"), "tagName", "frequency"))


def _pg_08(f: Factors, key: str) -> DataFrame:
    p, k = P[key]
    top = curate_by_percentile(pg_08_windows(f), p, ["tagName", "startDate"], k)
    return top.orderBy(_md5("tagName", "startDate")).select(F.col("tagName").alias("tag"), "startDate", "endDate")


def pg_08a(f):
    return _pg_08(f, "pg_08a")


def pg_08b(f):
    return _pg_08(f, "pg_08b")


def pg_09(f: Factors) -> DataFrame:
    anchor = percentile_day(f.creationDayNumMessages, "creationDay", ANCHOR["pg_09"])
    base = (_one(f.spark, anchor=anchor).withColumn("salt1", F.explode(F.sequence(F.lit(1), F.lit(20))))
            .withColumn("salt2", F.explode(F.sequence(F.lit(0), F.lit(1)))))
    s1, s2 = F.col("salt1"), F.col("salt2")
    out = base.select(_add_days(F.col("anchor"), s1 * 37 % 10 - 5).alias("startDate"),
                      _add_days(F.col("anchor"), s1 * 31 % 20 + s2 + 80).alias("endDate")).distinct()
    return out.orderBy(_md5("startDate", "endDate"))


def _pg_10(f: Factors, countries: DataFrame, persons: DataFrame, classes: DataFrame) -> DataFrame:
    lists = _one(f.spark, c=_array_of(countries, "countryName"), p=_array_of(persons, "id"),
                 t=_array_of(classes, "tagClassName"))
    prod = (lists.select(F.explode("c").alias("c"), "p", "t").select("c", F.explode("p").alias("p"), "t")
            .select("c", "p", F.explode("t").alias("t"))
            .select(F.col("p.id").alias("id"), F.col("c.countryName").alias("countryName"),
                    F.col("t.tagClassName").alias("tagClassName")))
    return (prod.orderBy(_md5("id", "countryName", "tagClassName")).limit(P["pg_10"][1])
            .select(F.col("id").alias("personId"), F.col("countryName").alias("country"),
                    F.col("tagClassName").alias("tagClass"), F.lit(3).alias("minPathDistance"),
                    F.lit(4).alias("maxPathDistance")))


def _alive_friends(f: Factors) -> DataFrame:
    return f.personNumFriends.join(f.personDays_window, "id", "left_semi")


def _alive_persons(f: Factors, key: str, order: list) -> DataFrame:
    """Alive persons nearest to the percentile of all persons' numbers of friends."""
    p, k = P[key]
    return curate_by_percentile(_alive_friends(f), p, order, k, population=f.personNumFriends).select("id")


def hop_seeds(f: Factors) -> DataFrame:
    """The persons that curation picks for Q10, from whom hop pairs are found."""
    return _alive_persons(f, "pg_10a_person", ["id"])


def pg_10a(f: Factors) -> DataFrame:
    c = curate_by_percentile(f.countryNumPersons, P["pg_10a_country"][0], ["name"], P["pg_10a_country"][1])
    p = _alive_persons(f, "pg_10a_person", ["id"])
    t = curate_by_percentile(f.tagClassNumTags, P["pg_10a_tagclass"][0], ["name"], P["pg_10a_tagclass"][1])
    c = c.select(F.col("name").alias("countryName"))
    t = t.select(F.col("name").alias("tagClassName"))
    return _pg_10(f, c, p, t)


def pg_10b(f: Factors) -> DataFrame:
    c = curate_by_percentile(f.countryNumPersons, P["pg_10b_country"][0], ["name"], P["pg_10b_country"][1])
    p = _alive_friends(f).where(F.col("frequency") == 1).orderBy("id").limit(P["pg_10b_person"][1]).select("id")
    t = curate_by_percentile(f.tagClassNumTags, P["pg_10b_tagclass"][0], ["name"], P["pg_10b_tagclass"][1])
    c = c.select(F.col("name").alias("countryName"))
    t = t.select(F.col("name").alias("tagClassName"))
    return _pg_10(f, c, p, t)


def pg_11(f: Factors) -> DataFrame:
    anchor = percentile_day(f.creationDayNumMessages, "creationDay", ANCHOR["pg_11"])
    base = (_one(f.spark, anchor=anchor).withColumn("salt1", F.explode(F.sequence(F.lit(1), F.lit(20))))
            .withColumn("salt2", F.explode(F.sequence(F.lit(0), F.lit(1)))))
    s1, s2 = F.col("salt1"), F.col("salt2")
    out = base.select(F.when(s2 % 2 == 0, "China").otherwise("India").alias("country"),
                      _add_days(F.col("anchor"), s1 * 37 % 30 - 15).alias("startDate"),
                      _add_days(F.col("anchor"), s1 * 37 % 30 - 15 + 92 + s2 * 47 % 18 + s2).alias("endDate"))
    return out.orderBy(_md5("startDate", "endDate"))


def pg_12(f: Factors) -> DataFrame:
    anchor = percentile_day(f.creationDayNumMessages, "creationDay", ANCHOR["pg_12"])
    langs = curate_by_percentile(f.languageNumPosts, P["pg_12_language"][0], ["language"],
                                 P["pg_12_language"][1]).select("language")
    return _length_and_languages(f, anchor, langs)


def _length_and_languages(f: Factors, anchor: Column, langs: DataFrame) -> DataFrame:
    rows = (_one(f.spark, anchor=anchor, langs=_array_of(langs, "language"))
            .withColumn("lang_perm", F.explode(F.sequence(F.lit(1), F.lit(4))))
            .withColumn("salt", F.explode(F.sequence(F.lit(1), F.lit(20)))))
    # the languages in an order of their own for each permutation: three of them
    shuffled = F.array_sort(F.transform("langs", lambda x: F.struct(F.md5(F.concat(x["language"], F.col("lang_perm").cast("string"))), x["language"].alias("lng"))))
    return (rows.select("salt", "lang_perm", _add_days(F.col("anchor"), F.col("salt") * 3).alias("startDate"),
                        F.array_join(F.slice(shuffled, 1, 3)["lng"], ";").alias("languages"))
            .orderBy(_md5("startDate"), "lang_perm")
            .select("startDate", (150 - F.col("salt") * 5).alias("lengthThreshold"), "languages"))


def pg_13(f: Factors) -> DataFrame:
    anchor = percentile_day(f.creationDayNumMessages, "creationDay", ANCHOR["pg_13"])
    days = (_one(f.spark, anchor=anchor).withColumn("salt1", F.explode(F.sequence(F.lit(456789), F.lit(456789 + 20))))
            .select(_add_days(F.col("anchor"), F.col("salt1") * 47 % 20 - 5).alias("endDate")).distinct())
    out = days.withColumn("salt2", F.explode(F.sequence(F.lit(0), F.lit(1))))
    return (out.orderBy(_md5("endDate", "salt2"))
            .select(F.when(F.col("salt2") % 2 == 0, "India").otherwise("China").alias("country"), "endDate"))


def _pg_14(f: Factors, key: str) -> DataFrame:
    p, k = P[key]
    top = curate_by_percentile(f.countryPairsNumFriends, p, ["country1Name", "country2Name"], k)
    return (top.orderBy(_md5("country1Name", "country2Name"))
            .select(F.col("country1Name").alias("country1"), F.col("country2Name").alias("country2")))


def pg_14a(f):
    return _pg_14(f, "pg_14a")


def pg_14b(f):
    return _pg_14(f, "pg_14b")


def pg_15a_core(f: Factors) -> DataFrame:
    sample = f.people4Hops.orderBy("person1Id", "person2Id").limit(P["pg_15a_sample"][1]).select("person1Id", "person2Id")
    k = f.personKnowsPersonDays_window
    k1 = k.select(F.col("Person1Id").alias("person1Id"), F.col("Person2Id").alias("_m1"))
    k2 = k.select(F.col("Person1Id").alias("_m1"), F.col("Person2Id").alias("middleCandidate"))
    return sample.join(k1, "person1Id").join(k2, "_m1").select("person1Id", "person2Id", "middleCandidate").distinct()


def pg_15a(f: Factors) -> DataFrame:
    anchor = percentile_day(f.creationDayNumMessages, "creationDay", ANCHOR["pg_15a"])
    k = f.personKnowsPersonDays_window
    k4 = k.select(F.col("Person1Id").alias("person2Id"), F.col("Person2Id").alias("_m4"))
    k3 = k.select(F.col("Person1Id").alias("_m4"), F.col("Person2Id").alias("middleCandidate"))
    met = pg_15a_core(f).join(k4, "person2Id").join(k3, ["_m4", "middleCandidate"])
    out = met.select("person1Id", "person2Id",
                     _add_days(anchor, -(F.col("person1Id") % 7)).alias("startDate"),
                     _add_days(anchor, F.col("person2Id") % 7).alias("endDate")).distinct()
    return out.orderBy(F.md5((131 * F.col("person1Id") + 241 * F.col("person2Id")).cast("string")), _md5("person1Id"))


def pg_15b(f: Factors) -> DataFrame:
    anchor = percentile_day(f.creationDayNumMessages, "creationDay", ANCHOR["pg_15b"])
    k = f.personKnowsPersonDays_window
    k1 = k.select(F.col("Person1Id").alias("person1Id"), F.col("Person2Id").alias("_m"))
    k2 = k.select(F.col("Person1Id").alias("_m"), F.col("Person2Id").alias("person2Id"))
    verified = f.people2Hops.select("person1Id", "person2Id").join(k1, "person1Id").join(k2, ["_m", "person2Id"])
    out = verified.select("person1Id", "person2Id",
                          _add_days(anchor, F.col("person1Id") % 9 - 11).alias("startDate"),
                          _add_days(anchor, F.col("person1Id") % 9 + 11).alias("endDate")).distinct()
    return (out.orderBy(F.md5((131 * F.col("person1Id") + 241 * F.col("person2Id")).cast("string")), _md5("person1Id"))
            .limit(P["pg_15b"][1]))


def _tag_dates(f: Factors, key: str, pick) -> DataFrame:
    p, k = P[key]
    ft = f.creationDayAndTagNumMessages
    target = percentile_disc(ft, "frequency", p)
    rows = (ft.withColumn("diff", F.abs(F.col("frequency") - target))
            .groupBy(F.col("name").alias("tagName"), F.col("frequency").alias("freq"), "diff")
            .agg(pick("creationDay").alias("creationDay")))
    return rows.orderBy("diff", _md5("tagName"), "freq").limit(k)


def _pg_16(f: Factors, key: str) -> DataFrame:
    a = _tag_dates(f, f"{key}_a", F.max).select(F.col("tagName").alias("tagA"), F.col("creationDay").alias("dateA"))
    b = _tag_dates(f, f"{key}_b", F.min).select(F.col("tagName").alias("tagB"), F.col("creationDay").alias("dateB"))
    return _tag_date_pairs(f, a, b)


def _tag_date_pairs(f: Factors, a: DataFrame, b: DataFrame) -> DataFrame:
    """Pairs of unequal tags with their days; both sides are top-k results."""
    lists = _one(f.spark, a=_array_of(a, "tagA", "dateA"), b=_array_of(b, "tagB", "dateB"))
    prod = (lists.select(F.explode("a").alias("a"), "b").select("a", F.explode("b").alias("b"))
            .select("a.tagA", "a.dateA", "b.tagB", "b.dateB").where(F.col("tagA") != F.col("tagB")))
    return (prod.orderBy(_md5("tagA", "tagB"), "dateA", "dateB").limit(P["pg_16"][1])
            .select("tagA", "dateA", "tagB", "dateB",
                    (3 + (F.dayofyear("dateA") + F.dayofyear("dateB")) % 4).alias("maxKnowsLimit")))


def pg_16a(f):
    return _pg_16(f, "pg_16a")


def pg_16b(f):
    return _pg_16(f, "pg_16b")


def pg_17(f: Factors) -> DataFrame:
    top = curate_by_percentile(f.tagNumMessages, P["pg_17"][0], ["tagName"], P["pg_17"][1])
    code_sum = F.aggregate(F.transform(F.split("tagName", ""), lambda ch: F.ascii(ch)), F.lit(0), lambda acc, x: acc + x)
    return top.orderBy(_md5("tagName")).select(F.col("tagName").alias("tag"), (8 + code_sum % 9).alias("delta"))


def pg_18(f: Factors) -> DataFrame:
    top = curate_by_percentile(f.tagNumPersons, P["pg_18"][0], ["name"], P["pg_18"][1])
    return top.select(F.col("name").alias("tag"))


def _pg_19(f: Factors, same_country: bool) -> DataFrame:
    cp = f.cityPairsNumFriends
    rows = cp.where((F.col("country1Id") == F.col("country2Id")) if same_country
                    else (F.col("country1Id") != F.col("country2Id")))
    key = F.md5((F.lit(3532569367) * F.col("city1Id") + F.lit(342663089) * F.col("city2Id")).cast("string"))
    return rows.orderBy(key).limit(P["pg_19"][1]).select("city1Id", "city2Id")


def pg_19a(f):
    return _pg_19(f, False)


def pg_19b(f):
    return _pg_19(f, True)


def pg_20_same_university_knows(f: Factors) -> DataFrame:
    return f.sameUniversityKnows.select(F.col("Person1Id").alias("person1Id"), F.col("Person2Id").alias("person2Id"))


def pg_20a(f: Factors) -> DataFrame:
    s1 = (curate_by_percentile(f.companyNumEmployees, P["pg_20a_company"][0], ["name", "id"], P["pg_20a_company"][1])
          .select(F.col("id").alias("companyId"), F.col("name").alias("companyName")))
    s2 = _alive_persons(f, "pg_20a_person", [_md5("id")]).withColumnRenamed("id", "personId")
    lists = _one(f.spark, c=_array_of(s1, "companyId", "companyName"), p=_array_of(s2, "personId"))
    pairs = (lists.select(F.explode("c").alias("c"), "p").select("c", F.explode("p").alias("p"))
             .select("c.companyId", "c.companyName", "p.personId"))
    suc = f.sameUniversityConnected
    with_comp = pairs.join(suc.select(F.col("PersonId").alias("personId"), "Component"), "personId")
    employer_comps = (f.personWorkAtCompanyDays_window.select(F.col("CompanyId").alias("companyId"), "PersonId")
                      .join(suc, "PersonId").select("companyId", "Component").distinct())
    ok = with_comp.join(employer_comps, ["companyId", "Component"], "left_anti")
    return (ok.orderBy(_md5("personId", "companyId"), _md5("personId"), _md5("companyId")).limit(P["pg_20a"][1])
            .select(F.col("companyName").alias("company"), F.col("personId").alias("person2Id")))


def pg_20b_comp(f: Factors) -> DataFrame:
    target = percentile_disc(f.companyNumEmployees, "frequency", P["pg_20b_comp"][0])
    w = f.personWorkAtCompanyDays_window.select(F.col("PersonId").alias("person1Id"), F.col("CompanyId").alias("id"))
    rows = (f.companyNumEmployees.join(w, "id")
            .select("person1Id", F.col("id").alias("companyId"), F.col("name").alias("companyName"),
                    F.abs(F.col("frequency") - target).alias("diff"),
                    F.row_number().over(Window.partitionBy("id").orderBy(_md5("person1Id"))).alias("rnum")))
    return (rows.where(F.col("rnum") < 5).orderBy("diff", _md5("person1Id"), _md5("companyId")).limit(P["pg_20b_comp"][1])
            .select("person1Id", "companyId", "companyName"))


def pg_20b_twohop(f: Factors) -> DataFrame:
    suk = pg_20_same_university_knows(f)
    k1 = suk.select(F.col("person1Id"), F.col("person2Id").alias("_m"))
    k2 = suk.select(F.col("person1Id").alias("_m"), "person2Id")
    return (pg_20b_comp(f).join(k1, "person1Id").join(k2, "_m").where(F.col("person2Id") != F.col("person1Id"))
            .select("companyId", "companyName", "person2Id"))


def pg_20b(f: Factors) -> DataFrame:
    work = f.personWorkAtCompanyDays_window.select(F.col("CompanyId").alias("companyId"),
                                                   F.col("PersonId").alias("person2Id"))
    cand = pg_20b_twohop(f).join(work, ["companyId", "person2Id"], "left_anti").distinct()
    return (cand.orderBy(_md5("person2Id"), _md5("companyId")).limit(P["pg_20b"][1])
            .select(F.col("companyName").alias("company"), "person2Id"))


def pg_knows_window(f: Factors) -> DataFrame:
    return f.personKnowsPersonDays_window


def sample_parameters(df: DataFrame, cols: list[str], n: int, salt: str = "") -> DataFrame:
    """Uniform, reproducible sample of parameter rows: ``n`` rows by md5 order."""
    key = F.md5(F.concat(*[F.col(c).cast("string") for c in cols], F.lit(salt)))
    return df.orderBy(key, *cols).limit(n).select(*cols)


JOBS = {
    "pg_01": pg_01, "pg_02_windows": pg_02_windows, "pg_02a": pg_02a, "pg_02b": pg_02b, "pg_03": pg_03,
    "pg_04": pg_04, "pg_05": pg_05, "pg_06": pg_06, "pg_07": pg_07, "pg_08_windows": pg_08_windows,
    "pg_08a": pg_08a, "pg_08b": pg_08b, "pg_09": pg_09, "pg_10a": pg_10a, "pg_10b": pg_10b, "pg_11": pg_11,
    "pg_12": pg_12, "pg_13": pg_13, "pg_14a": pg_14a, "pg_14b": pg_14b, "pg_15a_core": pg_15a_core,
    "pg_15a": pg_15a, "pg_15b": pg_15b, "pg_16a": pg_16a, "pg_16b": pg_16b, "pg_17": pg_17, "pg_18": pg_18,
    "pg_19a": pg_19a, "pg_19b": pg_19b, "pg_20_same_university_knows": pg_20_same_university_knows,
    "pg_20a": pg_20a, "pg_20b_comp": pg_20b_comp, "pg_20b_twohop": pg_20b_twohop, "pg_20b": pg_20b,
    "pg_knows_window": pg_knows_window,
}



# --- uniform (naive) parameter samples ---------------------------------------

def _naive(df: DataFrame, key: Column, n: int | None, out: list[Column], tie: list[str]) -> DataFrame:
    ordered = df.orderBy(key, *tie)
    if n is not None:
        ordered = ordered.limit(n)
    return ordered.select(*out)


def naive_pg_01(f):
    d = f.creationDayNumMessages
    return _naive(d, _md5("creationDay"), P["naive"][1],
                  [F.date_format(F.col("creationDay").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSS'+00:00'")
                   .alias("datetime")], ["creationDay"])


def naive_pg_02m(f):
    return pg_02_windows(f).withColumnRenamed("tagClassName", "name")


def naive_pg_02a(f):
    w = naive_pg_02m(f)
    return _naive(w, _md5("date", "name"), P["naive"][1], [F.col("date"), F.col("name").alias("tagClass")], ["date", "name"])


def naive_pg_04(f):
    return _naive(f.creationDayNumMessages, _md5("creationDay"), None, [F.col("creationDay").alias("date")],
                  ["creationDay"])


def _naive_tag(f, salt: str, with_delta: bool = False):
    t = f.tagNumMessages
    cols = [F.col("tagName").alias("tag")]
    if with_delta:
        code_sum = F.aggregate(F.transform(F.split("tagName", ""), lambda ch: F.ascii(ch)), F.lit(0),
                               lambda acc, x: acc + x)
        cols.append((8 + code_sum % 9).alias("delta"))
    return _naive(t, F.md5(F.concat(F.col("tagName"), F.lit(salt))), P["naive"][1], cols, ["tagName"])


def naive_pg_05(f):
    return _naive_tag(f, "a")


def naive_pg_06(f):
    return _naive_tag(f, "b")


def naive_pg_07(f):
    return _naive_tag(f, "c")


def naive_pg_08m(f):
    return pg_08_windows(f).withColumnRenamed("tagName", "name")


def naive_pg_08a(f):
    w = naive_pg_08m(f)
    return _naive(w, _md5("name", "startDate"), P["naive"][1], [F.col("name").alias("tag"), "startDate", "endDate"],
                  ["name", "startDate"])


def naive_pg_14a(f):
    c = f.countryPairsNumFriends
    return _naive(c, _md5("country1Name", "country2Name"), P["naive"][1],
                  [F.col("country1Name").alias("country1"), F.col("country2Name").alias("country2")],
                  ["country1Name", "country2Name"])


def naive_pg_17(f):
    return _naive_tag(f, "e", with_delta=True)


def naive_pg_18(f):
    return _naive_tag(f, "e")


def naive_pg_19a(f):
    c = f.cityPairsNumFriends
    key = F.md5((F.lit(3532569367) * F.col("city1Id") + F.lit(342663089) * F.col("city2Id")).cast("string"))
    return _naive(c, key, P["naive"][1], [F.col("city1Id"), F.col("city2Id")], ["city1Id", "city2Id"])


def naive_pg_09(f):
    salted = f.creationDayNumMessages.select("creationDay", F.explode(F.sequence(F.lit(1), F.lit(20))).alias("salt"))
    return salted.select(_add_days(F.col("creationDay"), F.col("salt") * 37 % 10 - 5).alias("startDate"),
                         _add_days(F.col("creationDay"), F.col("salt") * 31 % 20 + 80).alias("endDate"))


def _naive_day(f, last: bool = False) -> Column:
    key = _md5("creationDay")
    return f.creationDayNumMessages.orderBy(key.desc() if last else key).limit(1).select("creationDay").scalar()


def naive_pg_12(f):
    langs = f.languageNumPosts.orderBy(_md5("language"), "language").limit(P["naive_pg_12_language"][1]).select("language")
    return _length_and_languages(f, _naive_day(f), langs)


def naive_pg_15(f):
    ids, k = f.personNumFriends, P["naive_pg_15_person"][1]
    lists = _one(f.spark, a=_array_of(ids.orderBy(_md5("id"), "id").limit(k), "id"),
                 b=_array_of(ids.orderBy(_md5("id").desc(), "id").limit(k), "id"), lo=_naive_day(f), hi=_naive_day(f, last=True))
    pairs = (lists.select(F.explode("a").alias("a"), "b", "lo", "hi").select("a", F.explode("b").alias("b"), "lo", "hi")
             .select(F.col("a.id").alias("person1Id"), F.col("b.id").alias("person2Id"), "lo", "hi"))
    key = F.md5((131 * F.col("person1Id") + 241 * F.col("person2Id")).cast("string"))
    return _naive(pairs, key, P["naive"][1],
                  [F.col("person1Id"), F.col("person2Id"), _add_days(F.col("lo"), -(F.col("person1Id") % 7)).alias("startDate"),
                   _add_days(F.col("hi"), F.col("person2Id") % 7).alias("endDate")], ["person1Id", "person2Id"])


def naive_pg_16(f):
    days, k, key = f.creationDayAndTagNumMessages, P["naive_pg_16_side"][1], _md5("creationDay", "name")
    a = days.orderBy(key, "name").limit(k).select(F.col("name").alias("tagA"), F.col("creationDay").alias("dateA"))
    b = days.orderBy(key.desc(), "name").limit(k).select(F.col("name").alias("tagB"), F.col("creationDay").alias("dateB"))
    return _tag_date_pairs(f, a, b)


def _with_each(df: DataFrame, **lists: DataFrame) -> DataFrame:
    """Every row of ``df`` with every row of each list, a one-column DataFrame of proven size.

    A list is a place or a sample (countries, the first persons by hash), gathered into an array that is exploded beside the
    rows: pairs stream through the task that reads the row, and a top-k behind them keeps only its k rows a task."""
    for name, values in lists.items():
        gathered = values.select(F.collect_list(values.columns[0])).scalar()
        df = df.select("*", F.explode(gathered).alias(name))
    return df


def _countries(f) -> DataFrame:
    return f.countryNumPersons.select("name")


def _hashed_persons(f, key: str) -> DataFrame:
    return f.personNumFriends.orderBy(_md5("id"), "id").limit(P[key][1]).select("id")


def naive_pg_03(f):
    pairs = _with_each(f.tagClassNumMessages.select(F.col("name").alias("tagClass")), country=_countries(f))
    return _naive(pairs, _md5("tagClass", "country"), None, ["tagClass", "country"], ["tagClass", "country"])


def naive_pg_10(f):
    triples = _with_each(f.tagClassNumTags.select(F.col("name").alias("tagClass")), country=_countries(f),
                         personId=_hashed_persons(f, "naive_pg_10_person"))
    names = ["personId", "country", "tagClass"]
    return _naive(triples, _md5(*names), P["naive"][1],
                  [*names, F.lit(3).alias("minPathDistance"), F.lit(4).alias("maxPathDistance")], names)


def naive_pg_11(f):
    salted = f.creationDayNumMessages.select("creationDay", F.explode(F.sequence(F.lit(1), F.lit(3))).alias("salt"))
    start = F.col("salt") * 37 % 30 - 15
    return _naive(_with_each(salted, country=_countries(f)), _md5("creationDay", "country", "salt"), None,
                  ["country", _add_days(F.col("creationDay"), start).alias("startDate"),
                   _add_days(F.col("creationDay"), start + 92 + F.col("salt") * 47 % 18).alias("endDate")],
                  ["creationDay", "country", "salt"])


def naive_pg_13(f):
    pairs = _with_each(f.creationDayNumMessages.select(F.col("creationDay").alias("endDate")), country=_countries(f))
    return _naive(pairs, _md5("country", "endDate"), P["naive"][1], ["country", "endDate"], ["country", "endDate"])


def naive_pg_20(f):
    pairs = _with_each(f.companyNumEmployees.select("id", F.col("name").alias("company")),
                       person2Id=_hashed_persons(f, "naive_pg_20_person"))
    key = F.md5((F.lit(3532569367) * F.col("id") + F.lit(211) * F.col("person2Id")).cast("string"))
    return _naive(pairs, key, P["naive"][1], ["company", "person2Id"], ["id", "person2Id"])


JOBS.update({
    "naive_pg_01": naive_pg_01, "naive_pg_02m": naive_pg_02m, "naive_pg_02a": naive_pg_02a,
    "naive_pg_04": naive_pg_04, "naive_pg_05": naive_pg_05, "naive_pg_06": naive_pg_06, "naive_pg_07": naive_pg_07,
    "naive_pg_08m": naive_pg_08m, "naive_pg_08a": naive_pg_08a, "naive_pg_14a": naive_pg_14a,
    "naive_pg_17": naive_pg_17, "naive_pg_18": naive_pg_18, "naive_pg_19a": naive_pg_19a,
    # the b-variants take the same samples
    "naive_pg_02b": naive_pg_02a, "naive_pg_08b": naive_pg_08a, "naive_pg_14b": naive_pg_14a, "naive_pg_19b": naive_pg_19a,
    "naive_pg_09": naive_pg_09, "naive_pg_12": naive_pg_12, "naive_pg_15a": naive_pg_15, "naive_pg_15b": naive_pg_15,
    "naive_pg_16a": naive_pg_16, "naive_pg_16b": naive_pg_16, "naive_pg_03": naive_pg_03, "naive_pg_10a": naive_pg_10,
    "naive_pg_10b": naive_pg_10, "naive_pg_11": naive_pg_11, "naive_pg_13": naive_pg_13, "naive_pg_20a": naive_pg_20,
    "naive_pg_20b": naive_pg_20,
})
