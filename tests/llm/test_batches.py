"""Whole texts come to Python in small batches, whatever the session's limit was; a smaller limit stays."""

import pyarrow as pa
import pytest

from graphbi.llm import common, simhash, suffix_dedup

_NAME = "spark.sql.execution.arrow.maxBytesPerBatch"


def _largest_batch(df):
    def run(batches):
        for b in batches:
            yield pa.record_batch({"rows": pa.array([b.num_rows], pa.int64()), "n": pa.array([b.nbytes], pa.int64())})
    return max(r["n"] for r in df.mapInArrow(run, "rows long, n long").collect())


@pytest.fixture
def limit(spark):
    before = spark.conf.get(_NAME)
    spark.conf.set(_NAME, "64m")
    yield
    spark.conf.set(_NAME, before)


def test_operators_on_whole_texts_take_small_batches(spark, limit):
    docs = spark.range(600, numPartitions=1).selectExpr("id as doc_id", "concat(id, repeat(' word', 4000)) as text")
    assert _largest_batch(docs) > 2 * common._BATCH_BYTES
    for operator in (simhash.drop_near_duplicates, suffix_dedup.drop_repeats):
        spark.conf.set(_NAME, "64m")
        assert operator(docs).count() >= 0
        assert _largest_batch(docs) < 2 * common._BATCH_BYTES


def test_a_smaller_limit_stays(spark, limit):
    spark.conf.set(_NAME, "1m")
    common.small_batches(spark.range(1))
    assert spark.conf.get(_NAME) == "1m"
