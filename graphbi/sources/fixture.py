"""Projection of the TPC-H-shaped test tables into the social-network graph.

Every table of the BI workload (persons, forums, posts, comments, tags and the
edges between them) is derived deterministically from the parquet tables
under ``sf_dir``; the rules are the ones in FIXTURES.md section B.  Counts
that parameterise the rules (number of persons, forums, orders) enter the
plans as scalar subqueries, so nothing is collected on the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SOURCE_TABLES = ("nation", "customer", "supplier", "part", "orders", "lineitem", "events")


def read_sources(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in SOURCE_TABLES}


def _count(df: DataFrame) -> Column:
    return df.select(F.count(F.lit(1))).scalar()


def _lng(c: Column) -> Column:
    return c.cast("bigint")


def _comments(lineitem: DataFrame, orders: DataFrame, n_person: Column) -> DataFrame:
    """De-duplicated line items as chains of comments below their order's post.

    Dealt by order once: de-duplication, predecessors and the join with the orders all take that partitioning."""
    items = (lineitem.select(F.col("l_orderkey").alias("ok"), F.col("l_linenumber").alias("ln"), "l_shipdate", "l_partkey", "l_quantity")
             .repartition("ok"))
    dedup = items.groupBy("ok", "ln").agg(F.min("l_shipdate").alias("creationDate"), F.min("l_partkey").alias("pk"),
                                          (F.min("l_quantity").cast("int") * 4).alias("length"))
    with_prev = dedup.withColumn("pln", F.lag("ln").over(Window.partitionBy("ok").orderBy("ln")))
    pk, ln = F.col("pk"), F.col("ln")
    return (with_prev.join(orders.select("o_orderkey", "o_custkey"), F.col("ok") == F.col("o_orderkey"))
            .select("creationDate", (F.col("ok") * 10 + ln).alias("id"),
                    F.when(pk % 3 < 2, (F.col("o_custkey") + ln) % n_person)
                     .otherwise(pk % n_person).alias("CreatorPersonId"),
                    F.when(F.col("pln").isNull(), F.col("ok") * 10).alias("ParentPostId"),
                    F.when(F.col("pln").isNotNull(), F.col("ok") * 10 + F.col("pln")).alias("ParentCommentId"),
                    "length", F.concat(F.lit("c"), pk.cast("string")).alias("content"), "pk"))


def project(spark: SparkSession, sf_dir: str, comment: DataFrame | None = None) -> dict[str, DataFrame]:
    """Lazy DataFrames of the base graph tables (no derived closure yet).

    ``comment``: the stored comments, if they are there already; tags and likes of comments then start from them."""
    s = read_sources(spark, sf_dir)
    nation, customer, supplier = s["nation"], s["customer"], s["supplier"]
    part, orders, lineitem, events = s["part"], s["orders"], s["lineitem"], s["events"]

    n_person = _count(customer)
    n_forum = _count(supplier)
    n_orders = _count(orders)

    country = nation.select(_lng(F.col("n_nationkey")).alias("id"), F.col("n_name").alias("name"),
                            _lng(F.col("n_regionkey")).alias("PartOfContinentId"))
    city = (nation.select("n_nationkey", "n_name", F.explode(F.array(*[F.lit(k) for k in range(4)])).alias("k"))
            .select(_lng(1000 + F.col("n_nationkey") * 4 + F.col("k")).alias("id"),
                    F.concat(F.col("n_name"), F.lit("_C"), F.col("k").cast("string")).alias("name"),
                    _lng(F.col("n_nationkey")).alias("PartOfCountryId")))
    company = supplier.select(_lng(F.col("s_suppkey")).alias("id"), F.col("s_name").alias("name"))

    first_order = orders.groupBy("o_custkey").agg(F.min("o_orderdate").alias("creationDate"))
    person = (customer.join(first_order, customer.c_custkey == first_order.o_custkey)
              .select(F.col("c_custkey").alias("id"), F.col("c_name").alias("firstName"),
                      F.col("c_mktsegment").alias("lastName"),
                      _lng(1000 + F.col("c_nationkey") * 4 + F.col("c_custkey") % 4).alias("LocationCityId"),
                      "creationDate"))

    c = F.col("c_custkey")
    by_nation = Window.partitionBy("c_nationkey").orderBy("c_custkey")
    raw_pairs = (customer.select(c.alias("a"), ((c + 1) % n_person).alias("b"))
                 .unionByName(customer.select(c.alias("a"), ((c * 7 + 5) % n_person).alias("b")))
                 .unionByName(customer.select(c.alias("a"), F.lead(c, 1).over(by_nation).alias("b")))
                 .unionByName(customer.select(c.alias("a"), F.lead(c, 2).over(by_nation).alias("b"))))
    knows_pairs = (raw_pairs.where(F.col("b").isNotNull() & (F.col("a") != F.col("b")))
                   .select(F.least("a", "b").alias("Person1Id"), F.greatest("a", "b").alias("Person2Id"))
                   .distinct())
    p1 = person.select(F.col("id").alias("_p1"), F.col("creationDate").alias("_d1"))
    p2 = person.select(F.col("id").alias("_p2"), F.col("creationDate").alias("_d2"))
    person_knows_person = (knows_pairs.join(p1, knows_pairs.Person1Id == p1._p1)
                           .join(p2, knows_pairs.Person2Id == p2._p2)
                           .select(F.greatest("_d1", "_d2").alias("creationDate"), "Person1Id", "Person2Id"))

    sk = F.col("s_suppkey")
    forum = (supplier.select(sk, "s_name", ((sk * 13 + 7) % (n_person * 10)).alias("_ok"))
             .join(orders.select("o_orderkey", "o_orderdate"), F.col("_ok") == F.col("o_orderkey"))
             .select(_lng(sk).alias("id"),
                     F.concat(F.when(sk % 3 == 0, F.lit("Group ")).when(sk % 3 == 1, F.lit("Album "))
                              .otherwise(F.lit("Wall ")), F.col("s_name")).alias("title"),
                     ((sk * 7 + 3) % n_person).alias("ModeratorPersonId"),
                     F.col("o_orderdate").alias("creationDate")))

    ok = F.col("o_orderkey")
    post = orders.select(
        F.col("o_orderdate").alias("creationDate"), (ok * 10).alias("id"), F.col("o_custkey").alias("CreatorPersonId"),
        (ok % n_forum).alias("ContainerForumId"),
        F.when(ok % 4 == 0, "en").when(ok % 4 == 1, "fr").when(ok % 4 == 2, "de").otherwise("es").alias("language"),
        F.when(ok % 10 == 0, F.lit(None).cast("string")).otherwise(F.col("o_orderpriority")).alias("content"),
        (ok % 200).cast("int").alias("length"))

    if comment is None:
        comment = _comments(lineitem, orders, n_person)
    pk = F.col("pk")

    brand_no = _lng(F.substring("p_brand", 7, 1 << 20))
    tag = part.select(brand_no.alias("id"), F.col("p_brand").alias("name"),
                      (brand_no % 6).alias("TypeTagClassId")).distinct()
    tagclass = (part.select(F.col("p_type").alias("name")).distinct()
                .select((F.row_number().over(Window.orderBy("name")) - 1).cast("bigint").alias("id"), "name"))

    post_hastag = orders.select((ok * 10).alias("MessageId"), (1 + ok % 25).alias("TagId"))
    comment_hastag = (comment.select("id", "pk").join(part.select("p_partkey", brand_no.alias("TagId")), pk == F.col("p_partkey"))
                      .select(F.col("id").alias("MessageId"), "TagId"))

    liking = events.where(F.col("event_type").isin("view", "purchase")).select(
        F.col("user_id").alias("PersonId"), ((F.col("event_id") * 7 % n_orders) * 10).alias("_post"), "event_id")
    # every third one likes the first comment below the post too, where there is one
    comment_likes = (liking.where(F.col("event_id") % 3 == 0).select("PersonId", (F.col("_post") + 1).alias("MessageId"))
                     .join(comment.select(F.col("id").alias("MessageId")), "MessageId", "left_semi"))
    person_likes_message = (liking.select("PersonId", F.col("_post").alias("MessageId"))
                            .unionByName(comment_likes).distinct())

    forum_hasmember = (customer.select((c % n_forum).alias("ForumId"), c.alias("PersonId"))
                       .unionByName(customer.select(((c * 3 + 1) % n_forum).alias("ForumId"), c.alias("PersonId")))
                       .unionByName(orders.where(ok % 3 == 0)
                                    .select((ok % n_forum).alias("ForumId"), F.col("o_custkey").alias("PersonId")))
                       .distinct())
    person_hasinterest = (customer.select(c.alias("PersonId"), (1 + c % 25).alias("TagId"))
                          .unionByName(customer.select(c.alias("PersonId"), (1 + c * 7 % 25).alias("TagId")))
                          .distinct())
    person_studyat = (customer.select(c.alias("PersonId"), _lng(F.floor(c / 50.0)).alias("UniversityId"),
                                      (1990 + c % 17).cast("int").alias("classYear"))
                      .unionByName(customer.select(c.alias("PersonId"), (1000 + c % 7).alias("UniversityId"),
                                                   (1990 + c * 3 % 17).cast("int").alias("classYear"))))
    person_workat = customer.select(c.alias("PersonId"), (c % n_forum).alias("CompanyId"))

    e = F.col("event_id")
    timings = events.select(
        F.lit("x").alias("tool"), F.lit(1.0).alias("sf"), F.col("ts").cast("date").cast("string").alias("day"),
        F.when(e % 5 == 0, "power").otherwise("throughput").alias("batch_type"),
        F.when(e % 5 == 0, (1 + _lng(F.floor(e / 5.0)) % 20).cast("string"))
         .when(e % 2 == 0, "reads").otherwise("writes").alias("q"),
        (F.abs("value") + 0.001).alias("time"))

    return {
        "country": country, "city": city, "company": company, "person": person,
        "person_knows_person": person_knows_person, "forum": forum, "post": post, "comment": comment,
        "tag": tag, "tagclass": tagclass, "post_hastag": post_hastag, "comment_hastag": comment_hastag,
        "person_likes_message": person_likes_message, "forum_hasmember": forum_hasmember,
        "person_hasinterest": person_hasinterest, "person_studyat": person_studyat,
        "person_workat": person_workat, "timings": timings,
    }
