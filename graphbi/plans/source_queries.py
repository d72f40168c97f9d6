"""Registered round trips of the sources and sinks: write a graph table in
the workload's file layout, read it back through the source under test."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphbi.plans import bi, curation, factors, refresh
from graphbi.session import configure, scratch_path
from graphbi.sources import csv as C
from graphbi.sources.parquet import scan_batch_partition, scan_parquet_factors
from graphbi.sources.store import load_graph

PERSON_SCHEMA = "id bigint, firstName string, lastName string, LocationCityId bigint, creationDate timestamp_ntz"
COMMENT_SCHEMA = ("creationDate timestamp_ntz, id bigint, CreatorPersonId bigint, ParentPostId bigint, "
                  "ParentCommentId bigint, length int, content string, pk bigint")
POST_SCHEMA = ("creationDate timestamp_ntz, id bigint, CreatorPersonId bigint, ContainerForumId bigint, language string, "
               "content string, length int")
PARAM_TYPES_08 = {"tag": "STRING", "startDate": "DATE", "endDate": "DATE"}


def _g(spark, sf_dir):
    configure(spark)
    return load_graph(spark, sf_dir)


def scan_csv_entity_q(spark, sf_dir):
    path = scratch_path(spark, "csv-person")
    C.write_entity_csv(_g(spark, sf_dir)["person"], path)
    return C.scan_csv_entity(spark, path, PERSON_SCHEMA)


def scan_csv_gz_multi_q(spark, sf_dir):
    path = scratch_path(spark, "csv-comment")
    C.write_entity_csv(_g(spark, sf_dir)["comment"].repartition(4), path, compression="gzip")
    return C.scan_csv_gz_multi(spark, path, COMMENT_SCHEMA)


def scan_csv_projected_q(spark, sf_dir):
    path = scratch_path(spark, "csv-post")
    C.write_entity_csv(_g(spark, sf_dir)["post"], path)
    c = F.col
    return C.scan_csv_projected(spark, path, POST_SCHEMA, {
        "creationDate": c("creationDate"), "MessageId": c("id"), "RootPostId": c("id"),
        "RootPostLanguage": c("language"), "content": c("content"), "length": c("length"),
        "CreatorPersonId": c("CreatorPersonId"), "ContainerForumId": c("ContainerForumId"),
        "ParentMessageId": F.lit(None).cast("bigint")})


def scan_parquet_factors_q(spark, sf_dir):
    path = scratch_path(spark, "factor")
    factors.tag_num_messages(_g(spark, sf_dir)).write.parquet(path)
    return scan_parquet_factors(spark, path)


def scan_batch_partition_q(spark, sf_dir):
    """Inserts stored partitioned by batch_id; one batch read by partition pruning."""
    path = scratch_path(spark, "inserts")
    posts = refresh.with_batches(_g(spark, sf_dir))["post"]
    posts.write.partitionBy("batch_id").parquet(path)
    return scan_batch_partition(spark, path, posts.schema, refresh.FIRST_BATCH)


def _params_file(spark, sf_dir) -> str:
    path = scratch_path(spark, "params")
    f = curation.Factors(spark, _g(spark, sf_dir))
    C.sink_parameters(curation.pg_08a(f), path, PARAM_TYPES_08)
    return path


def scan_parameters_q(spark, sf_dir):
    return C.scan_parameters(spark, _params_file(spark, sf_dir))


def sink_parameters_q(spark, sf_dir):
    """The written file as text columns (header names carry the type tags)."""
    return spark.read.option("sep", "|").option("header", True).csv(_params_file(spark, sf_dir))


def sink_results_q(spark, sf_dir):
    g = _g(spark, sf_dir)
    path = scratch_path(spark, "results")
    params = bi.DEFAULTS["bi_02_tag_evolution"]
    res = bi.bi_02_tag_evolution(g, **params)
    C.sink_results(res, path, "2", "2a", params, [-F.col("diff"), F.col("tag_name")])
    back = C.scan_results(spark, path)
    rows = F.from_json("result", "array<struct<tag_name:string,countWindow1:bigint,countWindow2:bigint,diff:bigint>>")
    return back.select("query", "variant", F.explode(rows).alias("r")).select("query", "variant", "r.*")


def sink_table_q(spark, sf_dir):
    """Bulk insert of Message into a catalog table partitioned by month."""
    g = _g(spark, sf_dir)
    name = "graphbi_message_" + scratch_path(spark, "t").rsplit("-", 1)[-1]
    path = scratch_path(spark, "table")
    (g["message"].withColumn("creationMonth", F.date_format("creationDate", "yyyy-MM"))
     .write.partitionBy("creationMonth").option("path", path).saveAsTable(name))
    return spark.table(name).drop("creationMonth")


QUERIES = {
    "scan_csv_entity": scan_csv_entity_q,
    "scan_csv_gz_multi": scan_csv_gz_multi_q,
    "scan_csv_projected": scan_csv_projected_q,
    "scan_parquet_factors": scan_parquet_factors_q,
    "scan_batch_partition": scan_batch_partition_q,
    "scan_parameters": scan_parameters_q,
    "sink_parameters": sink_parameters_q,
    "sink_results": sink_results_q,
    "sink_table": sink_table_q,
}

