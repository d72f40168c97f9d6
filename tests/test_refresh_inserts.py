"""Inserting a batch: old rows stay where they are, and no table is broadcast because its files compress well."""

from pyspark.sql import functions as F

from graphbi.plans import refresh as R
from graphbi.plans import refresh_queries as Q
from graphbi.session import configure

SF = "/root/testdata/sf0.001"


def test_old_rows_are_not_written_again(spark):
    after = Q._inserted(spark, SF)
    for t in ("post", "comment"):
        assert any(f"/snapshot-{t}-" in f for f in after[t].inputFiles()), t


def test_new_rows_by_key(spark):
    table = spark.createDataFrame([(1, "a"), (2, "b"), (2, "c"), (None, "d")], "id bigint, x string")
    ins = spark.createDataFrame([(1, "e"), (3, "f"), (3, "f"), (None, "g")], "id bigint, x string")
    assert sorted(map(tuple, R.new_rows(ins, table, ["id"]).collect()), key=str) == [(3, "f"), (None, "g")]


def test_waiting_comments_are_attached_when_the_parent_comes(spark):
    when = F.to_timestamp(F.lit("2001-01-01"))
    comment = "id bigint, ParentPostId bigint, ParentCommentId bigint, length int, content string, CreatorPersonId bigint"
    stored = spark.createDataFrame([(11, 10, None, 1, "a", 1), (13, None, 12, 2, "b", 2), (14, None, 99, 3, "c", 3)], comment).withColumn("creationDate", when)
    message = spark.createDataFrame([(10, 10, "en", 5, None), (11, 10, "en", 5, 10)],
                                    "MessageId bigint, RootPostId bigint, RootPostLanguage string, ContainerForumId bigint, ParentMessageId bigint")
    message = message.select(when.alias("creationDate"), "MessageId", "RootPostId", "RootPostLanguage", F.lit("x").alias("content"), F.lit(1).alias("length"),
                             F.lit(1).cast("bigint").alias("CreatorPersonId"), "ContainerForumId", "ParentMessageId")
    new = spark.createDataFrame([(12, None, 11, 4, "d", 4), (15, 77, None, 5, "e", 5)], comment).withColumn("creationDate", when)
    got = R.attach_comments(spark, message, message.limit(0), stored, new)
    assert sorted((r.MessageId, r.RootPostId, r.ParentMessageId, r.content) for r in got.collect()) == [(12, 10, 11, "d"), (13, 10, 12, "b")]


def test_files_that_compress_well_are_not_broadcast(spark, tmp_path):
    configure(spark)
    spark.range(800_000).write.option("compression", "zstd").parquet(f"{tmp_path}/ids")
    ids = spark.read.parquet(f"{tmp_path}/ids")
    plan = ids.join(ids.withColumnRenamed("id", "x"), F.col("id") == F.col("x"), "left_anti")._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastExchange" not in plan
