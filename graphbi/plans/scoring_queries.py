"""Registered runs of the validation and scoring jobs on the test graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphbi.plans import scoring as S
from graphbi.session import configure
from graphbi.sources.store import load_graph

# Fixed value: load time of the scored run (seconds), a parameter of the throughput score.
LOAD_SECONDS = 600.0


def _timings(spark: SparkSession, sf_dir: str) -> DataFrame:
    configure(spark)
    return load_graph(spark, sf_dir)["timings"]


def _long(df: DataFrame, fields: list[str]) -> DataFrame:
    """(creationDay, fields...) -> long result form keyed by year and day of year."""
    base = df.select(F.lit("creationDay").alias("variant"), F.year("creationDay").cast("string").alias("params"),
                     F.dayofyear("creationDay").alias("row_no"), *fields)
    parts = [base.select("variant", "params", "row_no", F.lit(f).alias("field"), F.col(f).cast("double").alias("num"),
                         F.lit(None).cast("string").alias("str")) for f in fields]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def validate_results_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cross-validate two computations of the per-day message statistics:
    directly from the messages, and re-assembled from the per-day length
    category breakdown."""
    configure(spark)
    g = load_graph(spark, sf_dir)
    m = g["message"].withColumn("creationDay", F.to_date("creationDate"))
    direct = m.groupBy("creationDay").agg(F.count(F.lit(1)).alias("frequency"), F.avg("length").alias("avgLength"))
    ln = F.col("length")
    cat = F.when(ln < 40, 0).when(ln < 80, 1).when(ln < 160, 2).otherwise(3)
    by_cat = (m.groupBy("creationDay", cat.alias("lengthCategory"))
              .agg(F.count(F.lit(1)).alias("n"), F.sum("length").alias("s")))
    rebuilt = by_cat.groupBy("creationDay").agg(F.sum("n").alias("frequency"),
                                                (F.sum("s") / F.sum("n")).alias("avgLength"))
    return S.validate_results(_long(direct, ["frequency", "avgLength"]), _long(rebuilt, ["frequency", "avgLength"]))


QUERIES = {
    "validate_results": validate_results_q,
    "score_power_stats": lambda spark, sf_dir: S.score_power_stats(_timings(spark, sf_dir)),
    "score_throughput_batches": lambda spark, sf_dir: S.score_throughput_batches(_timings(spark, sf_dir)),
    "score_power": lambda spark, sf_dir: S.score_power(_timings(spark, sf_dir)),
    "score_throughput": lambda spark, sf_dir: S.score_throughput(_timings(spark, sf_dir), LOAD_SECONDS),
}

