"""Derived tables (the reference's materialised views and precomputations)."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphbi.operators.closure import thread_roots

MESSAGE_COLUMNS = ["creationDate", "MessageId", "RootPostId", "RootPostLanguage", "content", "length",
                   "CreatorPersonId", "ContainerForumId", "ParentMessageId"]
THREAD_ATTRS = ["RootPostId", "RootPostLanguage", "ContainerForumId"]

# Interaction weight w = max(round(INTERACTION_BASE - sqrt(replies)), 1);
# trust weight w = TRUST_SCALE / (s + TRUST_SCALE), s adding TRUST_POST_REPLY per reply
# to a post and TRUST_COMMENT_REPLY per reply to a comment.
INTERACTION_BASE = 40
TRUST_SCALE = 10.0
TRUST_POST_REPLY = 10
TRUST_COMMENT_REPLY = 5


def message_from_posts(post: DataFrame) -> DataFrame:
    """Posts as messages: their own root, no parent."""
    return post.select("creationDate", F.col("id").alias("MessageId"), F.col("id").alias("RootPostId"),
                       F.col("language").alias("RootPostLanguage"), "content", "length", "CreatorPersonId",
                       "ContainerForumId", F.lit(None).cast("bigint").alias("ParentMessageId"))


def comments_as_children(comment: DataFrame) -> DataFrame:
    return comment.select("creationDate", F.col("id").alias("MessageId"), "content", "length", "CreatorPersonId",
                          F.coalesce("ParentPostId", "ParentCommentId").alias("ParentMessageId"))


def resolve_comments(spark: SparkSession, parents: DataFrame, comment: DataFrame, near: bool = False) -> DataFrame:
    """Comments as messages, inheriting root post, language and forum from the thread.

    ``parents`` are messages the comments may hang below (all posts on the
    initial load; all existing messages for an incremental batch).  ``near``:
    see :func:`graphbi.operators.closure.thread_roots`.
    """
    resolved = thread_roots(spark, parents.select("MessageId", *THREAD_ATTRS), comments_as_children(comment),
                            id_col="MessageId", parent_col="ParentMessageId", inherit=THREAD_ATTRS, near=near)
    return resolved.select(*MESSAGE_COLUMNS)


def message_union(spark: SparkSession, post: DataFrame, comment: DataFrame) -> DataFrame:
    posts = message_from_posts(post)
    return posts.unionByName(resolve_comments(spark, posts, comment, near=True))


MONTH = "creationMonth"


def month_of(time) -> Column:
    """A month as one number: 199607."""
    return F.year(time) * 100 + F.month(time)


def messages_between(g, lo=None, hi=None) -> DataFrame:
    """Messages created from ``lo`` to ``hi`` (timestamps, both included, None: open).

    Where messages are stored by month, files of other months are not read."""
    m = getattr(g, "stored", g.__getitem__)("message")
    for bound, holds in ((lo, Column.__ge__), (hi, Column.__le__)):
        if bound is not None:
            m = m.where(holds(F.col("creationDate"), F.lit(bound)))
            if MONTH in m.columns:
                m = m.where(holds(F.col(MONTH), F.lit(bound.year * 100 + bound.month)))
    return m.drop(MONTH)


def tags_union(post_hastag: DataFrame, comment_hastag: DataFrame) -> DataFrame:
    return post_hastag.select("MessageId", "TagId").unionByName(comment_hastag.select("MessageId", "TagId"))


def likes_union(post_likes: DataFrame, comment_likes: DataFrame) -> DataFrame:
    return post_likes.select("PersonId", "MessageId").unionByName(comment_likes.select("PersonId", "MessageId"))


def knows_undirected(person_knows_person: DataFrame) -> DataFrame:
    """Both directions of every friendship (avoids OR-joins on either end)."""
    k = person_knows_person.select("creationDate", "Person1Id", "Person2Id")
    return k.unionByName(k.select("creationDate", F.col("Person2Id").alias("Person1Id"),
                                  F.col("Person1Id").alias("Person2Id")))


def view_posts(message: DataFrame) -> DataFrame:
    return message.where(F.col("ParentMessageId").isNull())


def view_comments(message: DataFrame) -> DataFrame:
    return message.where(F.col("ParentMessageId").isNotNull())


def split_places(place: DataFrame) -> tuple[DataFrame, DataFrame]:
    country = place.where(F.col("type") == "Country").select("id", "name", F.col("PartOfPlaceId").alias("PartOfContinentId"))
    city = place.where(F.col("type") == "City").select("id", "name", F.col("PartOfPlaceId").alias("PartOfCountryId"))
    return country, city


def split_organisations(organisation: DataFrame) -> tuple[DataFrame, DataFrame]:
    company = organisation.where(F.col("type") == "Company").select("id", "name", F.col("LocationPlaceId").alias("LocatedInCountryId"))
    university = organisation.where(F.col("type") == "University").select("id", "name", F.col("LocationPlaceId").alias("LocatedInCityId"))
    return company, university


# --- precomputations -------------------------------------------------------

def precomp_forum_popularity(forum: DataFrame, forum_hasmember: DataFrame, person: DataFrame,
                             city: DataFrame) -> DataFrame:
    """Per forum: the largest number of members from any one country."""
    member_country = (forum_hasmember.join(person.select(F.col("id").alias("PersonId"), "LocationCityId"), "PersonId")
                      .join(city.select(F.col("id").alias("LocationCityId"), "PartOfCountryId"), "LocationCityId"))
    per_country = member_country.groupBy("ForumId", "PartOfCountryId").agg(F.count(F.lit(1)).alias("numberOfMembers"))
    per_forum = per_country.groupBy("ForumId").agg(F.max("numberOfMembers").alias("maxNumberOfMembers"))
    return (per_forum.join(forum.select(F.col("id").alias("ForumId"), "creationDate"), "ForumId")
            .select(F.col("ForumId").alias("id"), "creationDate", "maxNumberOfMembers"))


def precomp_popularity_score(message: DataFrame, person_likes_message: DataFrame) -> DataFrame:
    """Likes received per message creator (pre-aggregated per message first)."""
    likes_per_msg = person_likes_message.groupBy("MessageId").agg(F.count(F.lit(1)).alias("c"))
    return (likes_per_msg.join(message.select("MessageId", "CreatorPersonId"), "MessageId")
            .groupBy(F.col("CreatorPersonId").alias("person2id"))
            .agg(F.sum("c").alias("popularityScore")))


def direct_replies(message: DataFrame) -> DataFrame:
    """(reply creator, parent creator, parent is a post) for every reply edge."""
    reply = message.where(F.col("ParentMessageId").isNotNull()).select(
        F.col("ParentMessageId").alias("_parent"), F.col("CreatorPersonId").alias("replier"),
        F.col("ContainerForumId").alias("reply_forum"))
    parent = message.select(F.col("MessageId").alias("_parent"), F.col("CreatorPersonId").alias("author"),
                            F.col("ParentMessageId").isNull().alias("parent_is_post"),
                            F.col("ContainerForumId").alias("parent_forum"))
    return reply.join(parent, "_parent").drop("_parent")


def precomp_interaction_edges(message: DataFrame, person_knows_person: DataFrame) -> DataFrame:
    """Q19 weights: friends with >= 1 direct reply between them,
    w = greatest(round(40 - sqrt(#replies)), 1), both directions."""
    r = direct_replies(message).where(F.col("replier") != F.col("author"))
    counts = (r.select(F.least("replier", "author").alias("src"), F.greatest("replier", "author").alias("dst"))
              .groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n")))
    return interaction_weights(counts, person_knows_person)


def interaction_weights(counts: DataFrame, person_knows_person: DataFrame) -> DataFrame:
    """Q19 weights of friends from the replies ``n`` of each unordered pair (src < dst), both directions."""
    friends = person_knows_person.select(F.col("Person1Id").alias("src"), F.col("Person2Id").alias("dst"))
    weights = (counts.join(friends, ["src", "dst"], "left_semi")
               .select("src", "dst", F.greatest(F.round(INTERACTION_BASE - F.sqrt("n")).cast("bigint"), F.lit(1))
                       .cast("double").alias("w")))
    return weights.unionByName(weights.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w"))


def precomp_university_edges(knows: DataFrame, person_studyat: DataFrame) -> DataFrame:
    """Q20 weights: friends who studied at the same university,
    w = min |classYear1 - classYear2| + 1 (directed rows both ways)."""
    s1 = person_studyat.select(F.col("PersonId").alias("src"), "UniversityId", F.col("classYear").alias("y1"))
    s2 = person_studyat.select(F.col("PersonId").alias("dst"), "UniversityId", F.col("classYear").alias("y2"))
    pairs = knows.select(F.col("Person1Id").alias("src"), F.col("Person2Id").alias("dst"))
    return (pairs.join(s1, "src").join(s2, ["dst", "UniversityId"])
            .groupBy("src", "dst").agg((F.min(F.abs(F.col("y1") - F.col("y2"))) + 1).cast("int").alias("w")))


#: Precomputed tables by name: what each computes from a table set, of which it takes only the tables it reads.
PRECOMPUTED = {
    "top_forums_q04": lambda t: precomp_forum_popularity(t["forum"], t["forum_hasmember"], t["person"], t["city"]),
    "popularity_q06": lambda t: precomp_popularity_score(t["message"], t["person_likes_message"]),
    "path_q19": lambda t: precomp_interaction_edges(t["message"], t["person_knows_person"]),
    "path_q20": lambda t: precomp_university_edges(t["knows"], t["person_studyat"]),
}


def precomputed(t: Mapping[str, DataFrame]) -> dict[str, DataFrame]:
    """The four precomputed tables of a table set."""
    return {name: of(t) for name, of in PRECOMPUTED.items()}


def trusted_edges(message: DataFrame, knows: DataFrame, forum: DataFrame, start, end) -> DataFrame:
    """Q15 weights for every friendship: 10 / (s + 10), where s sums 10 per
    reply to a post and 5 per reply to a comment, both messages in forums
    created in [start, end]."""
    my_forums = forum.where(F.col("creationDate").between(F.lit(start), F.lit(end))).select(F.col("id").alias("_f"))
    r = (direct_replies(message)
         .join(my_forums.withColumnRenamed("_f", "reply_forum"), "reply_forum", "left_semi")
         .join(my_forums.withColumnRenamed("_f", "parent_forum"), "parent_forum", "left_semi"))
    # the friendship test is a semi join on the (ordered) pair
    scored = (r.select(F.least("replier", "author").alias("src"), F.greatest("replier", "author").alias("dst"),
                       F.when(F.col("parent_is_post"), TRUST_POST_REPLY).otherwise(TRUST_COMMENT_REPLY).alias("s"))
              .groupBy("src", "dst").agg(F.sum("s").alias("s")))
    undirected_pairs = knows.where(F.col("Person1Id") < F.col("Person2Id")).select(
        F.col("Person1Id").alias("src"), F.col("Person2Id").alias("dst"))
    scored = scored.join(undirected_pairs, ["src", "dst"], "left_semi")
    k = knows.select(F.col("Person1Id").alias("src"), F.col("Person2Id").alias("dst"),
                     F.least("Person1Id", "Person2Id").alias("_a"), F.greatest("Person1Id", "Person2Id").alias("_b"))
    s = scored.select(F.col("src").alias("_a"), F.col("dst").alias("_b"), "s")
    return (k.join(s, ["_a", "_b"], "left")
            .select("src", "dst", (F.lit(TRUST_SCALE) / (F.coalesce(F.col("s"), F.lit(0)) + TRUST_SCALE)).alias("w")))
