"""Registered runs of the derived-table and graph operators on the test graph.

Each function takes (spark, sf_dir), builds its input from the stored graph
(or the raw test tables) and returns the operator's output DataFrame.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphbi.operators import graph as G
from graphbi.operators import hubs, sssp
from graphbi.operators.closure import descendants, thread_roots
from graphbi.operators.percentile import exact_percentiles
from graphbi.operators.relational import ts
from graphbi.plans import views
from graphbi.session import configure
from graphbi.sources.store import load_graph


def _g(spark: SparkSession, sf_dir: str):
    configure(spark)
    return load_graph(spark, sf_dir)


def _single(spark: SparkSession, column: str, value) -> DataFrame:
    return spark.range(1).select(F.lit(value).alias(column))


# --- derived tables --------------------------------------------------------

def split_places_q(spark, sf_dir):
    g = _g(spark, sf_dir)
    place = (g["country"].select("id", "name", F.lit("Country").alias("type"),
                                 F.col("PartOfContinentId").alias("PartOfPlaceId"))
             .unionByName(g["city"].select("id", "name", F.lit("City").alias("type"),
                                           F.col("PartOfCountryId").alias("PartOfPlaceId"))))
    country, city = views.split_places(place)
    return (country.select(F.lit("Country").alias("kind"), "id", "name", F.col("PartOfContinentId").alias("parent"))
            .unionByName(city.select(F.lit("City").alias("kind"), "id", "name", F.col("PartOfCountryId").alias("parent"))))


def split_organisations_q(spark, sf_dir):
    g = _g(spark, sf_dir)
    uni = g["person_studyat"].select(F.col("UniversityId").alias("id")).distinct()
    org = (g["company"].select("id", F.lit("Company").alias("type"), "name",
                               F.lit(None).cast("bigint").alias("LocationPlaceId"))
           .unionByName(uni.select("id", F.lit("University").alias("type"),
                                   F.concat(F.lit("University_"), F.col("id").cast("string")).alias("name"),
                                   F.lit(None).cast("bigint").alias("LocationPlaceId"))))
    company, university = views.split_organisations(org)
    return (company.select(F.lit("Company").alias("kind"), "id", "name")
            .unionByName(university.select(F.lit("University").alias("kind"), "id", "name")))


def message_from_posts_q(spark, sf_dir):
    return views.message_from_posts(_g(spark, sf_dir)["post"])


def thread_root_closure_q(spark, sf_dir):
    g = _g(spark, sf_dir)
    return views.resolve_comments(spark, views.message_from_posts(g["post"]), g["comment"])


def message_union_q(spark, sf_dir):
    g = _g(spark, sf_dir)
    return views.message_union(spark, g["post"], g["comment"])


def likes_union_q(spark, sf_dir):
    g = _g(spark, sf_dir)
    m = g["message"]
    likes = g["person_likes_message"]
    on_posts = likes.join(views.view_posts(m).select("MessageId"), "MessageId", "left_semi")
    on_comments = likes.join(views.view_comments(m).select("MessageId"), "MessageId", "left_semi")
    return views.likes_union(on_posts, on_comments)


def tags_union_q(spark, sf_dir):
    g = _g(spark, sf_dir)
    return views.tags_union(g["post_hastag"], g["comment_hastag"])


def knows_undirected_q(spark, sf_dir):
    return views.knows_undirected(_g(spark, sf_dir)["person_knows_person"])


def view_posts_q(spark, sf_dir):
    return views.view_posts(_g(spark, sf_dir)["message"])


def view_comments_q(spark, sf_dir):
    return views.view_comments(_g(spark, sf_dir)["message"])


def precomp_forum_popularity_q(spark, sf_dir):
    g = _g(spark, sf_dir)
    return views.precomp_forum_popularity(g["forum"], g["forum_hasmember"], g["person"], g["city"])


def precomp_popularity_score_q(spark, sf_dir):
    g = _g(spark, sf_dir)
    return views.precomp_popularity_score(g["message"], g["person_likes_message"])


def precomp_interaction_edges_q(spark, sf_dir):
    g = _g(spark, sf_dir)
    return views.precomp_interaction_edges(g["message"], g["person_knows_person"])


def precomp_university_edges_q(spark, sf_dir):
    g = _g(spark, sf_dir)
    return views.precomp_university_edges(g["knows"], g["person_studyat"])


def trusted_edges_q(spark, sf_dir):
    g = _g(spark, sf_dir)
    return views.trusted_edges(g["message"], g["knows"], g["forum"], ts("1996-01-01"), ts("1999-01-01"))


# --- graph operators -------------------------------------------------------

def _person(spark, pid: int) -> DataFrame:
    return spark.range(1).select(F.lit(pid).cast("bigint").alias("node"))


def khop_neighbors_q(spark, sf_dir):
    g = _g(spark, sf_dir)
    return G.khop_neighbors(g["knows"], _person(spark, 0), 2, "Person1Id", "Person2Id")


def hop_ring_q(spark, sf_dir):
    g = _g(spark, sf_dir)
    return G.hop_ring(g["knows"], _person(spark, 0), 3, 4, "Person1Id", "Person2Id")


def count_triangles_q(spark, sf_dir):
    g = _g(spark, sf_dir)
    return G.count_triangles(g["person_knows_person"], "Person1Id", "Person2Id")


def common_neighbors_q(spark, sf_dir):
    g = _g(spark, sf_dir)
    tag = g["tag"].where(F.col("name") == "Brand#3").select(F.col("id").alias("TagId"))
    nodes = g["person_hasinterest"].join(tag, "TagId", "left_semi").select("PersonId")
    return G.common_neighbors(g["knows"], nodes, True, "Person1Id", "Person2Id")


def common_neighbors_top_q(spark, sf_dir):
    """The 100 pairs of persons with most common friends; here every friend of more than 16 persons counts as a hub."""
    g = _g(spark, sf_dir)
    return hubs.top_common_neighbors(g["knows"], g["person"].select("id"), 100, "Person1Id", "Person2Id", hub_degree=16)


def thread_roots_q(spark, sf_dir):
    """Conversation turns inherit the first turn's id and role (turn n replies to n-1)."""
    configure(spark)
    conv = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    # conversation in the upper half, turn (an int) in the lower: no two turns share an id
    node_id = F.shiftleft(F.col("conv_id").cast("bigint"), 32) + F.col("turn")
    roots = conv.where(F.col("turn") == 0).select(node_id.alias("id"), node_id.alias("root_id"),
                                                  F.col("role").alias("root_role"))
    children = conv.where(F.col("turn") > 0).select(node_id.alias("id"), (node_id - 1).alias("parent"), "role")
    out = thread_roots(spark, roots, children, id_col="id", parent_col="parent", inherit=["root_id", "root_role"])
    return out.select("id", "parent", "role", "root_id", "root_role", "depth")


def descendants_q(spark, sf_dir):
    g = _g(spark, sf_dir)
    m = g["message"]
    seeds = (m.where(F.col("ParentMessageId").isNull()
                     & F.col("creationDate").between(ts("1996-01-01"), ts("1996-01-31")))
             .select("MessageId"))
    links = m.where(F.col("ParentMessageId").isNotNull()).select("MessageId", "ParentMessageId")
    return descendants(spark, seeds, links, id_col="MessageId", parent_col="ParentMessageId")


def _employees(g, company: str) -> DataFrame:
    comp = g["company"].where(F.col("name") == company).select(F.col("id").alias("CompanyId"))
    return g["person_workat"].join(comp, "CompanyId", "left_semi").select(F.col("PersonId").alias("node"))


def reachable_q(spark, sf_dir):
    g = _g(spark, sf_dir)
    ok = sssp.reachable(spark, g["path_q20"], _person(spark, 7), _employees(g, "Supplier#000000033"))
    return _single(spark, "reachable", ok)


def sssp_pair_q(spark, sf_dir):
    g = _g(spark, sf_dir)
    d = sssp.shortest_distance(spark, g["path_q19"], _person(spark, 0), _person(spark, 700))
    return _single(spark, "weight", -1.0 if d is None else round(float(d), 6))


def _city(g, city_id: int) -> DataFrame:
    return g["person"].where(F.col("LocationCityId") == city_id).select(F.col("id").alias("node"))


def sssp_multi_q(spark, sf_dir):
    g = _g(spark, sf_dir)
    p = sssp.shortest_pairs(spark, g["path_q20"], _city(g, 1008), _city(g, 1021))
    return p.select(F.col("f").alias("person1_id"), F.col("t").alias("person2_id"), F.col("w").cast("bigint").alias("w"))


def sssp_one_to_many_q(spark, sf_dir):
    g = _g(spark, sf_dir)
    p = sssp.shortest_pairs(spark, g["path_q19"], _person(spark, 0), _city(g, 1021))
    return p.select(F.col("t").alias("person_id"), F.round("w", 6).alias("w")).orderBy("person_id").limit(20)


def connected_components_q(spark, sf_dir):
    g = _g(spark, sf_dir)
    return G.connected_components(spark, g["path_q20"], "src", "dst")


def exact_percentile_q(spark, sf_dir):
    """Prices and commit dates of all line items, by return flag."""
    configure(spark)
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    prices = exact_percentiles(items, "l_extendedprice", [0.05, 0.5, 0.95], ["l_returnflag"])
    days = exact_percentiles(items, "l_shipdate", [0.05, 0.5, 0.95], ["l_returnflag"])
    return prices.withColumnRenamed("value", "price").join(days.withColumnRenamed("value", "shipped"), ["l_returnflag", "fraction"])


QUERIES = {
    "exact_percentile": exact_percentile_q,
    "split_places": split_places_q,
    "split_organisations": split_organisations_q,
    "message_from_posts": message_from_posts_q,
    "thread_root_closure": thread_root_closure_q,
    "message_union": message_union_q,
    "likes_union": likes_union_q,
    "tags_union": tags_union_q,
    "knows_undirected": knows_undirected_q,
    "view_posts": view_posts_q,
    "view_comments": view_comments_q,
    "precomp_forum_popularity": precomp_forum_popularity_q,
    "precomp_popularity_score": precomp_popularity_score_q,
    "precomp_interaction_edges": precomp_interaction_edges_q,
    "precomp_university_edges": precomp_university_edges_q,
    "trusted_edges": trusted_edges_q,
    "khop_neighbors": khop_neighbors_q,
    "hop_ring": hop_ring_q,
    "count_triangles": count_triangles_q,
    "common_neighbors": common_neighbors_q,
    "common_neighbors_top": common_neighbors_top_q,
    "thread_roots": thread_roots_q,
    "descendants": descendants_q,
    "reachable": reachable_q,
    "sssp_pair": sssp_pair_q,
    "sssp_multi": sssp_multi_q,
    "sssp_one_to_many": sssp_one_to_many_q,
    "connected_components": connected_components_q,
}
