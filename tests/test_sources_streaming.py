"""Source/sink round trips."""

import datetime as dt
import json

from pyspark.sql import functions as F

from graphbi.plans.scoring import validate_results
from graphbi.session import scratch_path
from graphbi.sources import csv as C
from graphbi.sources.parquet import scan_batch_partition


def test_parameter_file_round_trip_with_arrays(spark):
    df = spark.createDataFrame([(dt.date(2001, 1, 2), 140, ["fr", "de", "en"]), (dt.date(2001, 1, 5), 135, ["es"])],
                               "startDate date, lengthThreshold int, languages array<string>")
    path = scratch_path(spark, "t-params")
    C.sink_parameters(df, path, {"startDate": "DATE", "lengthThreshold": "INT", "languages": "STRING[]"})
    header = spark.read.text(path).first()[0]
    assert header == "startDate:DATE|lengthThreshold:INT|languages:STRING[]"
    back = C.scan_parameters(spark, path)
    assert dict(back.dtypes) == {"startDate": "date", "lengthThreshold": "int", "languages": "array<string>"}
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, df.collect()))


def test_missing_batch_partition_reads_empty(spark):
    schema = spark.createDataFrame([], "id bigint, batch_id string").schema
    df = scan_batch_partition(spark, scratch_path(spark, "t-none"), schema, "2001-01")
    assert df.count() == 0 and df.columns == ["id"]


def test_result_lines_keep_types_and_are_validated(spark):
    kinds = "id bigint, at timestamp_ntz, name string, x double"
    at = dt.datetime(2011, 3, 4, 5, 6, 7, 89000)

    def lines(rows_by_id):
        path = scratch_path(spark, "t-results")
        for pid, rows in rows_by_id.items():
            C.sink_results(spark.createDataFrame(rows, kinds), path, "4", "4a", {"personId": pid, "on": dt.date(2011, 1, 2)}, [F.col("id")])
        return C.scan_results(spark, path)

    base = {1: [(7, at, "a|b", 0.5), (8, at, None, None)], 2: [(9, at, "c", 1.0)], 3: [], 4: [], 5: [(1, at, "e", 1.0)], 6: [(2, at, "f", 2.0)]}
    first = lines(base)
    got = {json.loads(r.params)["personId"]: r for r in first.collect()}
    assert json.loads(got[1].params) == {"personId": 1, "on": "2011-01-02"} and got[3].result == "[]"
    assert json.loads(got[1].result)[0] == {"id": 7, "at": "2011-03-04T05:06:07.089+00:00", "name": "a|b", "x": 0.5}
    # within the tolerance, beyond it, both empty, empty against a row, another text, absent; and one more
    other = {1: [(7, at, "a|b", 0.500001), (8, at, None, None)], 2: [(9, at, "c", 1.01)], 3: [], 4: [(1, at, "d", 1.0)], 5: [(1, at, "E", 1.0)], 7: []}
    out = validate_results(C.result_fields(first), C.result_fields(lines(other))).collect()
    assert [r.asDict() for r in out] == [{"variant": "4a", "instances": 7, "skipped": 1, "misaligned": 2, "failed": 3, "passed": False}]
