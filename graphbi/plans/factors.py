"""Factor tables: frequency statistics over the graph that parameter curation
reads (names follow the workload's factor tables).

All are group-by counts over the stored graph; the temporal tables carry a
creation and deletion day per entity or edge.  Lifetimes of the test graph:
ids ending in 0 are deleted on 2000-06-01, all others live until 2030-01-01.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphbi.operators import graph as G
from graphbi.operators.relational import count_all, static_dim
from graphbi.operators.rounds import RoundStore

# Lifetime rule of the test graph and the default alive window.
DELETED_DAY = _dt.date(2000, 6, 1)
ALIVE_DAY = _dt.date(2030, 1, 1)
WINDOW_START = _dt.date(2000, 1, 1)
WINDOW_END = _dt.date(2000, 12, 31)


def deletion_day(id_col: Column) -> Column:
    return F.when(id_col % 10 == 0, F.lit(DELETED_DAY)).otherwise(F.lit(ALIVE_DAY))


def _person_geo(g) -> DataFrame:
    city = static_dim(g["city"].select(F.col("id").alias("LocationCityId"), F.col("name").alias("cityName"),
                                       F.col("PartOfCountryId").alias("countryId")))
    country = static_dim(g["country"].select(F.col("id").alias("countryId"), F.col("name").alias("countryName")))
    return (g["person"].select("id", "LocationCityId", "creationDate").join(city, "LocationCityId")
            .join(country, "countryId"))


def _msg_tags(g) -> DataFrame:
    tag = static_dim(g["tag"].select(F.col("id").alias("TagId"), F.col("name").alias("tagName"), "TypeTagClassId"))
    return (g["message"].select("MessageId", F.to_date("creationDate").alias("creationDay"))
            .join(g["message_hastag"], "MessageId").join(tag, "TagId"))


def city_num_persons(g) -> DataFrame:
    return (_person_geo(g).groupBy(F.col("LocationCityId").alias("id"), F.col("cityName").alias("name"))
            .agg(count_all().alias("frequency")))


def country_num_persons(g) -> DataFrame:
    return (_person_geo(g).groupBy(F.col("countryId").alias("id"), F.col("countryName").alias("name"))
            .agg(count_all().alias("frequency")))


def city_pairs_num_friends(g) -> DataFrame:
    geo = _person_geo(g)
    a = geo.select(F.col("id").alias("Person1Id"), F.col("LocationCityId").alias("city1Id"),
                   F.col("cityName").alias("city1Name"), F.col("countryId").alias("country1Id"),
                   F.col("countryName").alias("country1Name"))
    b = geo.select(F.col("id").alias("Person2Id"), F.col("LocationCityId").alias("city2Id"),
                   F.col("cityName").alias("city2Name"), F.col("countryId").alias("country2Id"),
                   F.col("countryName").alias("country2Name"))
    return (g["knows"].select("Person1Id", "Person2Id").join(a, "Person1Id").join(b, "Person2Id")
            .groupBy("city1Id", "city2Id", "city1Name", "city2Name", "country1Id", "country2Id", "country1Name",
                     "country2Name").agg(count_all().alias("frequency")))


def country_pairs_num_friends(g) -> DataFrame:
    return (city_pairs_num_friends(g).groupBy("country1Id", "country2Id", "country1Name", "country2Name")
            .agg(F.sum("frequency").alias("frequency")))


def company_num_employees(g) -> DataFrame:
    per = g["person_workat"].groupBy(F.col("CompanyId").alias("id")).agg(count_all().alias("frequency"))
    return g["company"].join(per, "id").select("id", "name", "frequency")


def country_num_messages(g) -> DataFrame:
    per_creator = g["message"].groupBy(F.col("CreatorPersonId").alias("id")).agg(count_all().alias("_n"))
    return (per_creator.join(_person_geo(g), "id")
            .groupBy(F.col("countryId").alias("id"), F.col("countryName").alias("name"))
            .agg(F.sum("_n").alias("frequency")))


def creation_day_num_messages(g) -> DataFrame:
    return (g["message"].groupBy(F.to_date("creationDate").alias("creationDay"))
            .agg(count_all().alias("frequency")))


def creation_day_length_category_num_messages(g) -> DataFrame:
    ln = F.col("length")
    cat = F.when(ln < 40, 0).when(ln < 80, 1).when(ln < 160, 2).otherwise(3)
    return (g["message"].groupBy(F.to_date("creationDate").alias("creationDay"), cat.alias("lengthCategory"))
            .agg(count_all().alias("frequency")))


def creation_day_tag_num_messages(g) -> DataFrame:
    return (_msg_tags(g).groupBy("creationDay", F.col("TagId").alias("tagId"), F.col("tagName").alias("name"))
            .agg(count_all().alias("frequency")))


def creation_day_tagclass_num_messages(g) -> DataFrame:
    tc = static_dim(g["tagclass"].select(F.col("id").alias("TypeTagClassId"), F.col("name").alias("name")))
    per_day_tag = _msg_tags(g).groupBy("creationDay", "TypeTagClassId").agg(count_all().alias("frequency"))
    return per_day_tag.join(tc, "TypeTagClassId").select(
        "creationDay", F.col("TypeTagClassId").alias("tagClassId"), "name", "frequency")


def language_num_posts(g) -> DataFrame:
    return (g["post"].where(F.col("language").isNotNull()).groupBy("language").agg(count_all().alias("frequency")))


def length_num_messages(g) -> DataFrame:
    return g["message"].groupBy("length").agg(count_all().alias("frequency"))


def person_num_friends(g) -> DataFrame:
    deg = g["knows"].groupBy(F.col("Person1Id").alias("id")).agg(count_all().alias("frequency"))
    return (g["person"].select("id", F.to_date("creationDate").alias("personCreationDate"))
            .join(deg, "id", "left")
            .select("id", "personCreationDate", deletion_day(F.col("id")).alias("personDeletionDate"),
                    F.coalesce("frequency", F.lit(0)).alias("frequency")))


def tagclass_num_messages(g) -> DataFrame:
    tc = static_dim(g["tagclass"].select(F.col("id").alias("TypeTagClassId"), "name"))
    return (_msg_tags(g).groupBy("TypeTagClassId").agg(count_all().alias("frequency")).join(tc, "TypeTagClassId")
            .select(F.col("TypeTagClassId").alias("id"), "name", "frequency"))


def tagclass_num_tags(g) -> DataFrame:
    per = g["tag"].groupBy(F.col("TypeTagClassId").alias("id")).agg(count_all().alias("frequency"))
    return g["tagclass"].join(per, "id").select("id", "name", "frequency")


def tag_num_messages(g) -> DataFrame:
    return (_msg_tags(g).groupBy(F.col("TagId").alias("tagId"), "tagName").agg(count_all().alias("frequency")))


def tag_num_persons(g) -> DataFrame:
    per = g["person_hasinterest"].groupBy(F.col("TagId").alias("tagId")).agg(count_all().alias("frequency"))
    return g["tag"].select(F.col("id").alias("tagId"), "name").join(per, "tagId")


def _hop_pairs(g, hops: int, seeds: DataFrame) -> DataFrame:
    """Pairs (seed, person) at BFS distance exactly ``hops`` from the caller's seeds (column ``id``)."""
    seeds = seeds.select("id").distinct()
    life = g["person"].select("id", F.to_date("creationDate").alias("cd"))
    # one BFS per seed, all seeds expanded together: (seed, node) frontiers, each level stored
    e = g["knows"].select(F.col("Person1Id").alias("node"), F.col("Person2Id").alias("_to"))
    spark = seeds.sparkSession
    store = RoundStore(spark, "hops")
    frontier = store.put(seeds.select(F.col("id").alias("person1Id"), F.col("id").alias("node")), "level_0")
    for k in range(1, hops + 1):
        visited = spark.read.schema(frontier.schema).parquet(*[store.path(f"level_{j}") for j in range(k)])
        frontier = store.put(frontier.join(e, "node").select("person1Id", F.col("_to").alias("node")).distinct()
                             .join(visited, ["person1Id", "node"], "left_anti"), f"level_{k}")
    p1 = life.select(F.col("id").alias("person1Id"), F.col("cd").alias("person1CreationDate"))
    p2 = life.select(F.col("id").alias("node"), F.col("cd").alias("person2CreationDate"))
    return (frontier.join(p1, "person1Id").join(p2, "node")
            .select("person1Id", F.col("node").alias("person2Id"), "person1CreationDate",
                    deletion_day(F.col("person1Id")).alias("person1DeletionDate"), "person2CreationDate",
                    deletion_day(F.col("node")).alias("person2DeletionDate")))


def people_2_hops(g, seeds: DataFrame) -> DataFrame:
    return _hop_pairs(g, 2, seeds)


def people_4_hops(g, seeds: DataFrame) -> DataFrame:
    return _hop_pairs(g, 4, seeds)


def person_disjoint_employer_pairs(g, seeds: DataFrame) -> DataFrame:
    """(person2Id, companyName, companyId, dates of the person): companies at which a person of the caller's seeds (column
    ``id``, a list of proven size) never worked.

    The complement of a sparse relation: each company meets the gathered list, then the employments are taken away."""
    life = seeds.select("id").distinct().join(g["person"].select("id", F.to_date("creationDate").alias("day")), "id")
    listed = life.select(F.collect_list(F.struct("id", "day"))).scalar()
    pairs = (g["company"].select(F.col("id").alias("companyId"), F.col("name").alias("companyName"), F.explode(listed).alias("p"))
             .select(F.col("p.id").alias("person2Id"), "companyName", "companyId", F.col("p.day").alias("person2CreationDate")))
    jobs = g["person_workat"].select(F.col("PersonId").alias("person2Id"), F.col("CompanyId").alias("companyId"))
    return (pairs.join(jobs, ["person2Id", "companyId"], "left_anti")
            .withColumn("person2DeletionDate", deletion_day(F.col("person2Id"))))


# --- temporal tables -------------------------------------------------------

def person_days(g) -> DataFrame:
    return g["person"].select("id", F.to_date("creationDate").alias("creationDay"),
                              deletion_day(F.col("id")).alias("deletionDay"))


def person_knows_person_days(g) -> DataFrame:
    return g["person_knows_person"].select("Person1Id", "Person2Id", F.to_date("creationDate").alias("creationDay"),
                                           deletion_day(F.col("Person1Id") + F.col("Person2Id")).alias("deletionDay"))


def person_study_at_university_days(g) -> DataFrame:
    return (g["person_studyat"].join(person_days(g).withColumnRenamed("id", "PersonId"), "PersonId")
            .select("PersonId", "UniversityId", "creationDay", "deletionDay"))


def person_work_at_company_days(g) -> DataFrame:
    return (g["person_workat"].join(person_days(g).withColumnRenamed("id", "PersonId"), "PersonId")
            .select("PersonId", "CompanyId", "creationDay", "deletionDay"))


def alive_window(df: DataFrame, start=WINDOW_START, end=WINDOW_END) -> DataFrame:
    """Entities alive through the window; the lifetime columns are dropped
    (the filter reaches the parquet scan when ``df`` is stored)."""
    return (df.where((F.col("creationDay") < F.lit(start)) & (F.col("deletionDay") > F.lit(end)))
            .drop("creationDay", "deletionDay"))


def knows_window(g) -> DataFrame:
    """Alive friendships in both directions (curation's knows window)."""
    k = alive_window(person_knows_person_days(g))
    return k.unionByName(k.select(F.col("Person2Id").alias("Person1Id"), F.col("Person1Id").alias("Person2Id")))


def same_university_knows(g) -> DataFrame:
    k = knows_window(g)
    s = alive_window(person_study_at_university_days(g))
    s1 = s.select(F.col("PersonId").alias("Person1Id"), "UniversityId")
    s2 = s.select(F.col("PersonId").alias("Person2Id"), "UniversityId")
    return k.join(s1, "Person1Id").join(s2, ["Person2Id", "UniversityId"]).select("Person1Id", "Person2Id")


def same_university_connected(spark, g) -> DataFrame:
    """(PersonId, Component) over the same-university friendship graph; persons
    without such an edge form their own component."""
    cc = G.connected_components(spark, same_university_knows(g), "Person1Id", "Person2Id")
    persons = alive_window(person_days(g)).select(F.col("id").alias("node"))
    return (persons.join(cc, "node", "left")
            .select(F.col("node").alias("PersonId"), F.coalesce("component", "node").alias("Component")))
