"""The twenty BI read queries as DataFrame plans.

Every function takes the stored graph (a mapping name -> DataFrame, see
``graphbi.sources.store``) and the query parameters, and returns a lazy
DataFrame whose column names follow the result schema of the workload with
``.`` replaced by ``_``.  Filters are written next to the scans so they reach
the parquet reader; pre-aggregation happens before joins where the query
allows it; only static dimensions are broadcast explicitly (AQE decides the
rest from runtime sizes).
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphbi.operators import graph as G
from graphbi.operators import hubs, sssp
from graphbi.operators.relational import count_all, first_per_key, lit_ts, static_dim, ts
from graphbi.plans import views

# Q1 length-category bounds; Q5 score weights (message, reply, like);
# Q8 interest score; Q14 pair weights (reply 1->2, reply 2->1, like 1->2, like 2->1).
LENGTH_BOUNDS = (40, 80, 160)
Q5_WEIGHTS = (1, 2, 10)
Q8_INTEREST = 100
Q14_WEIGHTS = (4, 1, 10, 1)

DEFAULTS = {
    "bi_01_posting_summary": {"datetime": "2000-01-01"},
    "bi_02_tag_evolution": {"date": "1997-01-01", "tagClass": "LARGE"},
    "bi_03_popular_topics": {"tagClass": "LARGE", "country": "NATION_2"},
    "bi_04_top_creators": {"date": "1996-01-01"},
    "bi_05_active_posters": {"tag": "Brand#3"},
    "bi_06_authoritative_users": {"tag": "Brand#3"},
    "bi_07_related_topics": {"tag": "Brand#3"},
    "bi_08_central_person": {"tag": "Brand#3", "startDate": "1997-01-01", "endDate": "1999-01-01"},
    "bi_09_thread_initiators": {"startDate": "1996-01-01", "endDate": "1998-01-01"},
    "bi_10_experts": {"personId": 0, "country": "NATION_2", "tagClass": "LARGE", "minPathDistance": 3,
                      "maxPathDistance": 4},
    "bi_11_triangles": {"country": "NATION_2", "startDate": "1995-01-01", "endDate": "2001-12-31"},
    "bi_12_message_distribution": {"startDate": "1998-01-01", "lengthThreshold": 100, "languages": ["fr", "de"]},
    "bi_13_zombies": {"country": "NATION_2", "endDate": "2001-01-01"},
    "bi_14_international_dialog": {"country1": "NATION_16", "country2": "NATION_24"},
    "bi_15_trusted_path": {"person1Id": 0, "person2Id": 700, "startDate": "1996-01-01", "endDate": "1999-01-01"},
    "bi_16_fake_news": {"tagA": "Brand#1", "dateA": "1995-01-04", "tagB": "Brand#4", "dateB": "1996-10-16",
                        "maxKnowsLimit": 5},
    "bi_17_information_propagation": {"tag": "Brand#3", "delta": 4},
    "bi_18_friend_recommendation": {"tag": "Brand#3"},
    "bi_19_city_path": {"city1Id": 1008, "city2Id": 1021},
    "bi_19_city_path_full": {"city1Id": 1008, "city2Id": 1021},
    "bi_20_recruitment": {"person2Id": 7, "company": "Supplier#000000033"},
    "bi_20_recruitment_full": {"person2Id": 7, "company": "Supplier#000000033"},
}


def _tag_ids(g, name: str) -> DataFrame:
    return static_dim(g["tag"].where(F.col("name") == name).select(F.col("id").alias("TagId")))


def _class_tags(g, tag_class: str) -> DataFrame:
    tc = g["tagclass"].where(F.col("name") == tag_class).select(F.col("id").alias("TypeTagClassId"))
    return static_dim(g["tag"].join(static_dim(tc), "TypeTagClassId")
                      .select(F.col("id").alias("TagId"), F.col("name").alias("tagName")))


def _country_cities(g, country: str) -> DataFrame:
    c = g["country"].where(F.col("name") == country).select(F.col("id").alias("PartOfCountryId"))
    return static_dim(g["city"].join(static_dim(c), "PartOfCountryId")
                      .select(F.col("id").alias("LocationCityId"), F.col("name").alias("cityName")))


def _persons_in(g, country: str) -> DataFrame:
    return g["person"].join(_country_cities(g, country), "LocationCityId")


def _tagged_messages(g, tag: str) -> DataFrame:
    """MessageIds carrying the tag (one row per message and tag)."""
    return g["message_hastag"].join(_tag_ids(g, tag), "TagId").select("MessageId")


# --- Q1 -------------------------------------------------------------------

def bi_01_posting_summary(g, datetime="2000-01-01") -> DataFrame:
    """Message statistics by year, comment flag and length category.

    One scan: groups are formed with a content-present flag, so the share's
    denominator (all messages, also those without content) is the sum over
    the few grouped rows."""
    m = views.messages_between(g, hi=ts(datetime)).where(F.col("creationDate") < lit_ts(datetime))
    length = F.col("length")
    b1, b2, b3 = LENGTH_BOUNDS
    cat = F.when(length < b1, 0).when(length < b2, 1).when(length < b3, 2).otherwise(3)
    grouped = m.groupBy(F.year("creationDate").alias("year"),
                        F.col("ParentMessageId").isNotNull().alias("isComment"),
                        cat.alias("lengthCategory"), F.col("content").isNotNull().alias("_has")) \
        .agg(count_all().alias("messageCount"), F.avg("length").alias("averageMessageLength"),
             F.sum(length.cast("bigint")).alias("sumMessageLength"))
    # grouped holds at most (#years x 16) rows: the total is a window over them
    total = F.sum("messageCount").over(_whole())
    return (grouped.withColumn("_total", total).where("_has")
            .select("year", "isComment", "lengthCategory", "messageCount", "averageMessageLength",
                    "sumMessageLength", (F.col("messageCount") / F.col("_total")).alias("percentageOfMessages"))
            .orderBy(F.desc("year"), "isComment", "lengthCategory"))


def _whole():
    from pyspark.sql import Window
    return Window.partitionBy(F.lit(0))


# --- Q2 -------------------------------------------------------------------

def bi_02_tag_evolution(g, date="1997-01-01", tagClass="LARGE") -> DataFrame:
    d0 = ts(date)
    d1, d2 = d0 + _dt.timedelta(days=100), d0 + _dt.timedelta(days=200)
    tags = _class_tags(g, tagClass)
    msgs = views.messages_between(g, d0, d2).where(F.col("creationDate") < F.lit(d2)) \
        .select("MessageId", "creationDate")
    detail = (g["message_hastag"].join(tags.select("TagId"), "TagId").join(msgs, "MessageId")
              .groupBy("TagId")
              .agg(F.count(F.when(F.col("creationDate") < F.lit(d1), F.col("MessageId"))).alias("c1"),
                   F.count(F.when(F.col("creationDate") >= F.lit(d1), F.col("MessageId"))).alias("c2")))
    out = tags.join(detail, "TagId", "left").select(
        F.col("tagName").alias("tag_name"), F.coalesce("c1", F.lit(0)).alias("countWindow1"),
        F.coalesce("c2", F.lit(0)).alias("countWindow2"))
    out = out.withColumn("diff", F.abs(F.col("countWindow1") - F.col("countWindow2")))
    return out.orderBy(F.desc("diff"), "tag_name").limit(100)


# --- Q3 -------------------------------------------------------------------

def bi_03_popular_topics(g, tagClass="LARGE", country="NATION_2") -> DataFrame:
    mods = _persons_in(g, country).select(F.col("id").alias("ModeratorPersonId"))
    forums = g["forum"].join(mods, "ModeratorPersonId").select(
        F.col("id").alias("ContainerForumId"), "title", "creationDate", "ModeratorPersonId")
    tagged = g["message_hastag"].join(_class_tags(g, tagClass).select("TagId"), "TagId", "left_semi")
    msgs = (g["message"].select("MessageId", "ContainerForumId").join(forums.select("ContainerForumId"),
                                                                       "ContainerForumId", "left_semi")
            .join(tagged, "MessageId", "left_semi"))
    counts = msgs.groupBy("ContainerForumId").agg(F.count("MessageId").alias("messageCount"))
    return (forums.join(counts, "ContainerForumId")
            .select(F.col("ContainerForumId").alias("forum_id"), F.col("title").alias("forum_title"),
                    F.col("creationDate").alias("forum_creationDate"), F.col("ModeratorPersonId").alias("person_id"),
                    "messageCount")
            .orderBy(F.desc("messageCount"), "forum_id").limit(20))


# --- Q4 -------------------------------------------------------------------

def bi_04_top_creators(g, date="1996-01-01", top_forums: DataFrame | None = None) -> DataFrame:
    top = top_forums if top_forums is not None else g["top_forums_q04"]
    # at most 100 rows by construction: safe to broadcast
    top100 = F.broadcast(top.where(F.col("creationDate") > lit_ts(date))
                         .orderBy(F.desc("maxNumberOfMembers"), "id").limit(100).select(F.col("id").alias("ForumId")))
    members = g["forum_hasmember"].join(top100, "ForumId", "left_semi").select("PersonId").distinct()
    counts = (g["message"].join(top100.withColumnRenamed("ForumId", "ContainerForumId"), "ContainerForumId", "left_semi")
              .groupBy(F.col("CreatorPersonId").alias("PersonId")).agg(F.count("MessageId").alias("_c")))
    persons = g["person"].withColumnRenamed("id", "PersonId").join(members, "PersonId", "left_semi")
    return (persons.join(counts, "PersonId", "left")
            .select(F.col("PersonId").alias("person_id"), F.col("firstName").alias("person_firstName"),
                    F.col("lastName").alias("person_lastName"), F.col("creationDate").alias("person_creationDate"),
                    F.coalesce("_c", F.lit(0)).alias("messageCount"))
            .orderBy(F.desc("messageCount"), "person_id").limit(100))


# --- Q5 -------------------------------------------------------------------

def bi_05_active_posters(g, tag="Brand#3") -> DataFrame:
    tagged = _tagged_messages(g, tag)
    msgs = g["message"].select("MessageId", "CreatorPersonId").join(tagged, "MessageId")
    ids = tagged.distinct()
    replies = (g["message"].where(F.col("ParentMessageId").isNotNull())
               .select(F.col("ParentMessageId").alias("MessageId"))
               .join(ids, "MessageId", "left_semi").groupBy("MessageId").agg(count_all().alias("_r")))
    likes = (g["person_likes_message"].select("MessageId").join(ids, "MessageId", "left_semi")
             .groupBy("MessageId").agg(count_all().alias("_l")))
    detail = (msgs.join(replies, "MessageId", "left").join(likes, "MessageId", "left")
              .groupBy("CreatorPersonId")
              .agg(F.sum(F.coalesce("_r", F.lit(0))).alias("replyCount"),
                   F.sum(F.coalesce("_l", F.lit(0))).alias("likeCount"),
                   F.count("MessageId").alias("messageCount")))
    return (detail.select(F.col("CreatorPersonId").alias("person_id"), "replyCount", "likeCount", "messageCount",
                          (Q5_WEIGHTS[0] * F.col("messageCount") + Q5_WEIGHTS[1] * F.col("replyCount")
                           + Q5_WEIGHTS[2] * F.col("likeCount")).alias("score"))
            .orderBy(F.desc("score"), "person_id").limit(100))


# --- Q6 -------------------------------------------------------------------

def bi_06_authoritative_users(g, tag="Brand#3", popularity: DataFrame | None = None) -> DataFrame:
    pop = popularity if popularity is not None else g["popularity_q06"]
    msgs = g["message"].select("MessageId", F.col("CreatorPersonId").alias("person1id")).join(_tagged_messages(g, tag),
                                                                                               "MessageId")
    # distinct (poster, liker) pairs by an inner join (a hot message stays
    # splittable); posters whose messages have no likes keep score 0
    pairs = (msgs.join(g["person_likes_message"].select("MessageId", F.col("PersonId").alias("person2id")), "MessageId")
             .select("person1id", "person2id").distinct())
    scores = (pairs.join(pop, "person2id", "left").groupBy("person1id")
              .agg(F.sum(F.coalesce("popularityScore", F.lit(0))).alias("_s")))
    posters = msgs.select("person1id").distinct()
    return (posters.join(scores, "person1id", "left")
            .select(F.col("person1id").alias("person1_id"), F.coalesce("_s", F.lit(0)).alias("authorityScore"))
            .orderBy(F.desc("authorityScore"), "person1_id").limit(100))


# --- Q7 -------------------------------------------------------------------

def bi_07_related_topics(g, tag="Brand#3") -> DataFrame:
    mine = _tagged_messages(g, tag)
    comments = (g["message"].where(F.col("ParentMessageId").isNotNull()).select("MessageId", "ParentMessageId")
                .join(mine.withColumnRenamed("MessageId", "ParentMessageId"), "ParentMessageId")
                .join(mine, "MessageId", "left_anti"))
    tags = static_dim(g["tag"].select(F.col("id").alias("TagId"), F.col("name").alias("relatedTag_name")))
    return (comments.join(g["message_hastag"], "MessageId").join(tags, "TagId")
            .groupBy("relatedTag_name").agg(count_all().alias("count"))
            .orderBy(F.desc("count"), "relatedTag_name").limit(100))


# --- Q8 -------------------------------------------------------------------

def bi_08_central_person(g, tag="Brand#3", startDate="1997-01-01", endDate="1999-01-01") -> DataFrame:
    tid = _tag_ids(g, tag)
    persons = g["person"].select(F.col("id").alias("PersonId"))
    interested = (g["person_hasinterest"].join(tid, "TagId", "left_semi").select("PersonId")
                  .join(persons, "PersonId", "left_semi").withColumn("_i", F.lit(Q8_INTEREST)))
    msgs = (views.messages_between(g, ts(startDate), ts(endDate))
            .where((F.col("creationDate") > lit_ts(startDate)) & (F.col("creationDate") < lit_ts(endDate))))
    pms = (msgs.select("MessageId", F.col("CreatorPersonId").alias("PersonId"))
           .join(g["message_hastag"].join(tid, "TagId").select("MessageId"), "MessageId")
           .join(persons, "PersonId", "left_semi")
           .groupBy("PersonId").agg(count_all().alias("_m")))
    score = (interested.join(pms, "PersonId", "full")
             .select("PersonId", (F.coalesce("_i", F.lit(0)) + F.coalesce("_m", F.lit(0))).alias("score")))
    friends = g["knows"].select(F.col("Person1Id").alias("PersonId"), F.col("Person2Id").alias("FriendId"))
    fscore = score.select(F.col("PersonId").alias("FriendId"), F.col("score").alias("_fs"))
    # inner joins + per-person sum (splittable for hub persons); friends without
    # a score add nothing, persons without scored friends get 0 below
    contrib = (friends.join(fscore, "FriendId").join(score.select("PersonId"), "PersonId", "left_semi")
               .groupBy("PersonId").agg(F.sum("_fs").alias("_f")))
    out = score.join(contrib, "PersonId", "left").select(
        "PersonId", "score", F.coalesce("_f", F.lit(0)).alias("friendsScore"))
    return (out.select(F.col("PersonId").alias("person_id"), "score", "friendsScore")
            .orderBy(F.desc(F.col("score") + F.col("friendsScore")), "person_id").limit(100))


# --- Q9 -------------------------------------------------------------------

def bi_09_thread_initiators(g, startDate="1996-01-01", endDate="1998-01-01") -> DataFrame:
    in_range = views.messages_between(g, ts(startDate), ts(endDate))
    mpp = in_range.groupBy("RootPostId").agg(count_all().alias("_mc"))
    posts = in_range.where(F.col("ParentMessageId").isNull()).select(
        F.col("MessageId").alias("RootPostId"), F.col("CreatorPersonId").alias("id"))
    per_person = (posts.join(mpp, "RootPostId").groupBy("id")
                  .agg(F.count("RootPostId").alias("threadCount"), F.sum("_mc").alias("messageCount")))
    return (g["person"].join(per_person, "id")
            .select(F.col("id").alias("person_id"), F.col("firstName").alias("person_firstName"),
                    F.col("lastName").alias("person_lastName"), "threadCount", "messageCount")
            .orderBy(F.desc("messageCount"), "person_id").limit(100))


# --- Q10 ------------------------------------------------------------------

def bi_10_experts(g, personId=0, country="NATION_2", tagClass="LARGE", minPathDistance=3,
                  maxPathDistance=4) -> DataFrame:
    seed = g["person"].where(F.col("id") == F.lit(personId)).select("id")
    ring = G.hop_ring(g["knows"], seed, minPathDistance, maxPathDistance, src="Person1Id", dst="Person2Id")
    experts = (ring.withColumnRenamed("node", "id").join(_persons_in(g, country), "id", "left_semi")
               .select(F.col("id").alias("friendId")))
    class_msgs = (g["message"].select("MessageId", F.col("CreatorPersonId").alias("friendId"))
                  .join(experts, "friendId")
                  .join(g["message_hastag"].join(_class_tags(g, tagClass).select("TagId"), "TagId", "left_semi"),
                        "MessageId", "left_semi"))
    tags = static_dim(g["tag"].select(F.col("id").alias("TagId"), F.col("name").alias("tag_name")))
    return (class_msgs.join(g["message_hastag"], "MessageId").join(tags, "TagId")
            .groupBy("friendId", "tag_name").agg(count_all().alias("messageCount"))
            .select(F.col("friendId").alias("expertCandidatePerson_id"), "tag_name", "messageCount")
            .orderBy(F.desc("messageCount"), "tag_name", "expertCandidatePerson_id").limit(100))


# --- Q11 ------------------------------------------------------------------

def bi_11_triangles(g, country="NATION_2", startDate="1995-01-01", endDate="2001-12-31") -> DataFrame:
    local = _persons_in(g, country).select(F.col("id").alias("Person1Id"))
    edges = (g["person_knows_person"]
             .where(F.col("creationDate").between(lit_ts(startDate), lit_ts(endDate)))
             .join(local, "Person1Id", "left_semi")
             .join(local.withColumnRenamed("Person1Id", "Person2Id"), "Person2Id", "left_semi"))
    return G.count_triangles(edges, "Person1Id", "Person2Id")


# --- Q12 ------------------------------------------------------------------

def bi_12_message_distribution(g, startDate="1998-01-01", lengthThreshold=100, languages=("fr", "de")) -> DataFrame:
    m = views.messages_between(g, lo=ts(startDate)).where(
        F.col("content").isNotNull() & (F.col("length") < F.lit(int(lengthThreshold)))
        & (F.col("creationDate") > lit_ts(startDate)) & F.col("RootPostLanguage").isin(list(languages)))
    per_creator = m.groupBy(F.col("CreatorPersonId").alias("id")).agg(count_all().alias("_c"))
    per_person = g["person"].select("id").join(per_creator, "id", "left").select(
        F.coalesce("_c", F.lit(0)).alias("messageCount"))
    return (per_person.groupBy("messageCount").agg(count_all().alias("personCount"))
            .orderBy(F.desc("personCount"), F.desc("messageCount")))


# --- Q13 ------------------------------------------------------------------

def bi_13_zombies(g, country="NATION_2", endDate="2001-01-01") -> DataFrame:
    end = ts(endDate)
    cand = _persons_in(g, country).where(F.col("creationDate") < F.lit(end)).select(
        F.col("id").alias("zid"), F.col("creationDate").alias("pcd"))
    msgs = views.messages_between(g, hi=end).select(
        F.col("CreatorPersonId").alias("zid"), "MessageId", "creationDate")
    months = 12 * end.year + end.month - (12 * F.year("pcd") + F.month("pcd")) + 1
    # inner join + per-person count (splittable when one creator is hot), then
    # a left join of the counts keeps persons without messages at 0
    counts = (msgs.join(cand, "zid").where(F.col("creationDate") >= F.col("pcd"))
              .groupBy("zid").agg(F.count("MessageId").alias("_n")))
    zombies = (cand.join(counts, "zid", "left").withColumn("_n", F.coalesce("_n", F.lit(0)))
               .where(F.col("_n") < months).select("zid"))
    likers = g["person"].where(F.col("creationDate") < F.lit(end)).select(F.col("id").alias("PersonId"))
    z_msgs = g["message"].select("MessageId", F.col("CreatorPersonId").alias("zid")).join(zombies, "zid", "left_semi")
    likes = (g["person_likes_message"].join(likers, "PersonId", "left_semi").join(z_msgs, "MessageId")
             .join(zombies.select(F.col("zid").alias("PersonId"), F.lit(1).alias("_liker_is_zombie")), "PersonId", "left"))
    t = likes.groupBy("zid").agg(count_all().alias("_t"), F.sum(F.coalesce("_liker_is_zombie", F.lit(0))).alias("_z"))
    out = zombies.join(t, "zid", "left").select(
        F.col("zid").alias("zombie_id"), F.coalesce("_z", F.lit(0)).cast("bigint").alias("zombieLikeCount"),
        F.coalesce("_t", F.lit(0)).alias("totalLikeCount"),
        F.when(F.col("_t") > 0, F.col("_z").cast("double") / F.col("_t")).otherwise(F.lit(0.0)).alias("zombieScore"))
    return out.orderBy(F.desc("zombieScore"), "zombie_id").limit(100)


# --- Q14 ------------------------------------------------------------------

def _reply_pairs(g, persons: DataFrame) -> DataFrame:
    """Distinct (replier, author) pairs of direct replies, both in ``persons``."""
    reply = (g["message"].where(F.col("ParentMessageId").isNotNull())
             .select(F.col("ParentMessageId").alias("_m"), F.col("CreatorPersonId").alias("a"))
             .join(persons.select(F.col("id").alias("a")), "a", "left_semi"))
    parent = (g["message"].select(F.col("MessageId").alias("_m"), F.col("CreatorPersonId").alias("b"))
              .join(persons.select(F.col("id").alias("b")), "b", "left_semi"))
    return reply.join(parent, "_m").select("a", "b").distinct()


def _like_pairs(g, persons: DataFrame) -> DataFrame:
    """Distinct (liker, author) pairs, both in ``persons``."""
    likes = (g["person_likes_message"].select(F.col("PersonId").alias("a"), "MessageId")
             .join(persons.select(F.col("id").alias("a")), "a", "left_semi"))
    authored = (g["message"].select("MessageId", F.col("CreatorPersonId").alias("b"))
                .join(persons.select(F.col("id").alias("b")), "b", "left_semi"))
    return likes.join(authored, "MessageId").select("a", "b").distinct()


def bi_14_international_dialog(g, country1="NATION_16", country2="NATION_24") -> DataFrame:
    p1 = _persons_in(g, country1).select(F.col("id").alias("p1"), F.col("LocationCityId").alias("cityId"), "cityName")
    p2 = _persons_in(g, country2).select(F.col("id").alias("p2"))
    cand = (g["knows"].select(F.col("Person1Id").alias("p1"), F.col("Person2Id").alias("p2"))
            .join(p1, "p1").join(p2, "p2"))
    persons = cand.select(F.col("p1").alias("id")).unionByName(cand.select(F.col("p2").alias("id"))).distinct()
    replies = _reply_pairs(g, persons)
    likes = _like_pairs(g, persons)

    def flag(pairs, a, b, weight, name):
        return pairs.select(F.col("a").alias(a), F.col("b").alias(b), F.lit(weight).alias(name))

    w_r12, w_r21, w_l12, w_l21 = Q14_WEIGHTS
    scored = (cand.join(flag(replies, "p1", "p2", w_r12, "_r12"), ["p1", "p2"], "left")
              .join(flag(replies, "p2", "p1", w_r21, "_r21"), ["p1", "p2"], "left")
              .join(flag(likes, "p1", "p2", w_l12, "_l12"), ["p1", "p2"], "left")
              .join(flag(likes, "p2", "p1", w_l21, "_l21"), ["p1", "p2"], "left")
              .withColumn("score", sum(F.coalesce(F.col(c), F.lit(0)) for c in ["_r12", "_r21", "_l12", "_l21"])))
    best = first_per_key(scored, "cityId", [-F.col("score"), F.col("p1"), F.col("p2")],
                         ["p1", "p2", "cityName", "score"])
    return (best.select(F.col("p1").alias("person1_id"), F.col("p2").alias("person2_id"),
                        F.col("cityName").alias("city1_name"), F.col("score").cast("int").alias("score"))
            .orderBy(F.desc("score"), "person1_id", "person2_id").limit(100))


# --- Q15 ------------------------------------------------------------------

def bi_15_trusted_path(g, person1Id=0, person2Id=700, startDate="1996-01-01", endDate="1999-01-01",
                       spark: SparkSession | None = None) -> DataFrame:
    spark = spark or g["person"].sparkSession
    edges = views.trusted_edges(g["message"], g["knows"], g["forum"], ts(startDate), ts(endDate))
    src = spark.range(1).select(F.lit(int(person1Id)).cast("bigint").alias("node"))
    dst = spark.range(1).select(F.lit(int(person2Id)).cast("bigint").alias("node"))
    d = sssp.shortest_distance(spark, edges, src, dst)
    return spark.range(1).select(F.lit(-1.0 if d is None else round(float(d), 6)).alias("weight"))


# --- Q16 ------------------------------------------------------------------

def _fake_news_side(g, tag: str, date, limit: int) -> DataFrame:
    start = ts(date)
    # same day as a half-open range: pushed to the parquet reader (row-group skipping)
    after = start + _dt.timedelta(days=1)
    sub = (views.messages_between(g, start, after).where(F.col("creationDate") < F.lit(after))
           .select("MessageId", F.col("CreatorPersonId").alias("PersonId"))
           .join(_tagged_messages(g, tag), "MessageId")
           .join(g["person"].select(F.col("id").alias("PersonId")), "PersonId", "left_semi")
           .distinct())
    people = sub.select("PersonId").distinct()
    friends = (g["knows"].select(F.col("Person1Id").alias("PersonId"), F.col("Person2Id").alias("_f"))
               .join(people, "PersonId", "left_semi")
               .join(people.withColumnRenamed("PersonId", "_f"), "_f", "left_semi")
               .groupBy("PersonId").agg(F.countDistinct("_f").alias("_cp2")))
    cm = sub.groupBy("PersonId").agg(F.countDistinct("MessageId").alias("cm"))
    return (cm.join(friends, "PersonId", "left")
            .where(F.coalesce("_cp2", F.lit(0)) <= F.lit(int(limit))).select("PersonId", "cm"))


def bi_16_fake_news(g, tagA="Brand#1", dateA="1995-01-04", tagB="Brand#4", dateB="1996-10-16",
                    maxKnowsLimit=5) -> DataFrame:
    a = _fake_news_side(g, tagA, dateA, maxKnowsLimit).withColumnRenamed("cm", "messageCountA")
    b = _fake_news_side(g, tagB, dateB, maxKnowsLimit).withColumnRenamed("cm", "messageCountB")
    return (a.join(b, "PersonId").select(F.col("PersonId").alias("person_id"), "messageCountA", "messageCountB")
            .orderBy(F.desc(F.col("messageCountA") + F.col("messageCountB")), "person_id").limit(20))


# --- Q17 ------------------------------------------------------------------

def bi_17_information_propagation(g, tag="Brand#3", delta=4) -> DataFrame:
    mine = g["message"].join(_tagged_messages(g, tag).distinct(), "MessageId", "left_semi").select(
        "MessageId", "creationDate", "CreatorPersonId", "ContainerForumId", "ParentMessageId")
    m2 = mine.select(F.col("MessageId").alias("m2"), F.col("creationDate").alias("cd2"),
                     F.col("CreatorPersonId").alias("p3"), F.col("ContainerForumId").alias("f2"))
    comment = mine.where(F.col("ParentMessageId").isNotNull()).select(
        F.col("ParentMessageId").alias("m2"), F.col("CreatorPersonId").alias("p2"))
    chain = m2.join(comment, "m2").where(F.col("p2") != F.col("p3"))
    fm = g["forum_hasmember"]
    # forum1 candidates: forums having both the replier and the m2 author as members (equi joins); once a message,
    # however many repliers it has there
    with_forum = (chain.join(fm.select(F.col("PersonId").alias("p2"), F.col("ForumId").alias("f1")), "p2")
                  .join(fm.select(F.col("PersonId").alias("p3"), F.col("ForumId").alias("f1")), ["p3", "f1"], "left_semi")
                  .where(F.col("f1") != F.col("f2")).select("m2", "f1", "f2", "cd2").distinct())
    # some message of person1 in forum1 is early enough if the first one is: one row a person and forum, so that a hot
    # forum gives no pairs of times
    m1 = (mine.groupBy(F.col("ContainerForumId").alias("f1"), F.col("CreatorPersonId").alias("p1"))
          .agg(F.min("creationDate").alias("cd1")))
    hit = (with_forum.join(m1, "f1")
           .where((F.col("cd1") + F.make_dt_interval(hours=F.lit(int(delta)))) < F.col("cd2")))
    hit = hit.join(fm.select(F.col("ForumId").alias("f2"), F.col("PersonId").alias("p1")), ["f2", "p1"], "left_anti")
    return (hit.groupBy("p1").agg(F.countDistinct("m2").alias("messageCount"))
            .select(F.col("p1").alias("person1_id"), "messageCount")
            .orderBy(F.desc("messageCount"), "person1_id").limit(10))


# --- Q18 ------------------------------------------------------------------

def bi_18_friend_recommendation(g, tag="Brand#3") -> DataFrame:
    interested = g["person_hasinterest"].join(_tag_ids(g, tag), "TagId", "left_semi").select("PersonId")
    pairs = hubs.top_common_neighbors(g["knows"], interested, 20, src="Person1Id", dst="Person2Id")
    return (pairs.select(F.col("a").alias("person1_id"), F.col("b").alias("person2_id"),
                         F.col("n").alias("mutualFriendCount"))
            .orderBy(F.desc("mutualFriendCount"), "person1_id", "person2_id"))


# --- Q19 ------------------------------------------------------------------

def _city_persons(g, city_id) -> DataFrame:
    return g["person"].where(F.col("LocationCityId") == F.lit(int(city_id))).select(F.col("id").alias("node"))


def bi_19_city_path(g, city1Id=1008, city2Id=1021, edges: DataFrame | None = None,
                    spark: SparkSession | None = None) -> DataFrame:
    spark = spark or g["person"].sparkSession
    e = edges if edges is not None else g["path_q19"]
    pairs = sssp.shortest_pairs(spark, e, _city_persons(g, city1Id), _city_persons(g, city2Id))
    return (pairs.select(F.col("f").alias("person1_id"), F.col("t").alias("person2_id"),
                         F.round("w", 6).alias("totalWeight"))
            .orderBy("person1_id", "person2_id"))


def bi_19_city_path_full(g, city1Id=1008, city2Id=1021, spark: SparkSession | None = None) -> DataFrame:
    edges = views.precomp_interaction_edges(g["message"], g["person_knows_person"])
    return bi_19_city_path(g, city1Id, city2Id, edges=edges, spark=spark)


# --- Q20 ------------------------------------------------------------------

def bi_20_recruitment(g, person2Id=7, company="Supplier#000000033", edges: DataFrame | None = None,
                      spark: SparkSession | None = None) -> DataFrame:
    spark = spark or g["person"].sparkSession
    e = edges if edges is not None else g["path_q20"]
    src = spark.range(1).select(F.lit(int(person2Id)).cast("bigint").alias("node"))
    comp = g["company"].where(F.col("name") == company).select(F.col("id").alias("CompanyId"))
    dst = g["person_workat"].join(comp, "CompanyId", "left_semi").select(F.col("PersonId").alias("node"))
    pairs = sssp.shortest_pairs(spark, e, src, dst)
    return (pairs.select(F.col("t").alias("person1_id"), F.col("w").cast("bigint").alias("totalWeight"))
            .orderBy("person1_id").limit(20))


def bi_20_recruitment_full(g, person2Id=7, company="Supplier#000000033", spark: SparkSession | None = None) -> DataFrame:
    edges = views.precomp_university_edges(g["knows"], g["person_studyat"])
    return bi_20_recruitment(g, person2Id, company, edges=edges, spark=spark)


QUERIES = {
    "bi_01_posting_summary": bi_01_posting_summary,
    "bi_02_tag_evolution": bi_02_tag_evolution,
    "bi_03_popular_topics": bi_03_popular_topics,
    "bi_04_top_creators": bi_04_top_creators,
    "bi_05_active_posters": bi_05_active_posters,
    "bi_06_authoritative_users": bi_06_authoritative_users,
    "bi_07_related_topics": bi_07_related_topics,
    "bi_08_central_person": bi_08_central_person,
    "bi_09_thread_initiators": bi_09_thread_initiators,
    "bi_10_experts": bi_10_experts,
    "bi_11_triangles": bi_11_triangles,
    "bi_12_message_distribution": bi_12_message_distribution,
    "bi_13_zombies": bi_13_zombies,
    "bi_14_international_dialog": bi_14_international_dialog,
    "bi_15_trusted_path": bi_15_trusted_path,
    "bi_16_fake_news": bi_16_fake_news,
    "bi_17_information_propagation": bi_17_information_propagation,
    "bi_18_friend_recommendation": bi_18_friend_recommendation,
    "bi_19_city_path": bi_19_city_path,
    "bi_19_city_path_full": bi_19_city_path_full,
    "bi_20_recruitment": bi_20_recruitment,
    "bi_20_recruitment_full": bi_20_recruitment_full,
}
