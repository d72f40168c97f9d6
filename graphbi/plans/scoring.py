"""Benchmark scoring and result validation as Spark jobs.

Timing logs have the columns (tool, sf, day, batch_type, q, time); every
statistic is computed per run (``tool``), so the logs of many runs are
scored in one pass.  Floating outputs are rounded to 6 decimals.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# The query variants counted by the power score, and the
# minimum throughput time (seconds) of a valid run.
POWER_VARIANTS = ["writes", "1", "2a", "2b", "3", "4", "5", "6", "7", "8a", "8b", "9", "10a", "10b", "11", "12", "13",
                  "14a", "14b", "15a", "15b", "16a", "16b", "17", "18", "19a", "19b", "20a", "20b"]
THROUGHPUT_MIN_TIME = 3600.0
RESULT_TOLERANCE = 0.00001


def _r(c):
    return F.round(c, 6)


def score_power_stats(timings: DataFrame) -> DataFrame:
    """Per run and query: count, min, max, avg, total and discrete p50..p99."""
    power = timings.where(F.col("batch_type") == "power").withColumn(
        "qid", F.regexp_replace(F.concat(F.lit("0"), F.col("q")), "[^0-9]", "").cast("int"))
    pct = {f"p{int(p * 100)}_time": F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY time)")
           for p in (0.50, 0.90, 0.95, 0.99)}
    return power.groupBy("tool", "qid", "q").agg(
        F.count("time").alias("count"), F.min("time").alias("min_time"), F.max("time").alias("max_time"),
        _r(F.avg("time")).alias("avg_time"), _r(F.sum("time")).alias("total_time"),
        *[v.alias(k) for k, v in pct.items()])


def score_throughput_batches(timings: DataFrame, min_time: float = THROUGHPUT_MIN_TIME) -> DataFrame:
    """Per run: batches up to the first day whose running total reaches
    ``min_time``; n_batches counts read+write pairs."""
    tp = timings.where((F.col("batch_type") == "throughput") & F.col("q").isin("reads", "writes"))
    per_day = tp.groupBy("tool", "day").agg(F.sum("time").alias("_t"), F.count("day").alias("_n"))
    running = per_day.withColumn("_run", F.sum("_t").over(Window.partitionBy("tool").orderBy("day")))
    cutoff = running.where(F.col("_run") >= min_time).groupBy("tool").agg(F.min("day").alias("_cut"))
    kept = per_day.join(cutoff, "tool", "left").where(F.col("day") <= F.col("_cut"))
    tools = timings.select("tool").distinct()
    agg = kept.groupBy("tool").agg(F.sum("_n").alias("_n"), F.sum("_t").alias("_t"))
    return (tools.join(agg, "tool", "left")
            .select("tool", F.expr("coalesce(_n, 0) div 2").alias("n_batches"), _r(F.col("_t")).alias("t_batches")))


def score_power(timings: DataFrame) -> DataFrame:
    """Per run: 3600 / geometric mean of the total times, and power x SF."""
    stats = score_power_stats(timings).where(F.col("q").isin(POWER_VARIANTS))
    sf = timings.groupBy("tool").agg(F.first("sf").alias("sf"))
    power = stats.groupBy("tool").agg((F.lit(3600.0) / F.exp(F.avg(F.log("total_time")))).alias("power"))
    return power.join(sf, "tool").select("tool", _r(F.col("power")).alias("power"),
                                         _r(F.col("power") * F.col("sf")).alias("power_at_sf"))


def score_throughput(timings: DataFrame, load_seconds: float, min_time: float = THROUGHPUT_MIN_TIME) -> DataFrame:
    """Per run: (24 - load hours) * batches / batch hours (null without batches)."""
    b = score_throughput_batches(timings, min_time)
    sf = timings.groupBy("tool").agg(F.first("sf").alias("sf"))
    tput = F.when(F.col("n_batches") == 0, F.lit(None).cast("double")).otherwise(
        (24 - load_seconds / 3600.0) * (F.col("n_batches") / (F.col("t_batches") / 3600.0)))
    return (b.join(sf, "tool").select("tool", _r(tput).alias("throughput"),
                                      _r(tput * F.col("sf")).alias("throughput_at_sf")))


def validate_results(expected: DataFrame, actual: DataFrame, tol: float = RESULT_TOLERANCE) -> DataFrame:
    """Compare two result sets in long form.

    Both inputs have (variant, params, row_no, field, num, str): one row per
    result field.  Rows are aligned by a full outer join on (variant, params,
    row_no, field); numbers may differ by ``tol``.  Per variant: parameter
    instances, those that are expected only (skipped), those on one side only
    (misaligned, with the skipped ones), and failed ones.  Instances on one
    side only are not compared, so they don't fail.
    """
    keys = ["variant", "params", "row_no", "field"]
    e = expected.select(*keys, F.col("num").alias("e_num"), F.col("str").alias("e_str"), F.lit(True).alias("_e"))
    a = actual.select(*keys, F.col("num").alias("a_num"), F.col("str").alias("a_str"), F.lit(True).alias("_a"))
    j = e.join(a, keys, "full")
    num_ok = F.coalesce(F.abs(F.col("e_num") - F.col("a_num")) <= tol, F.col("e_num").eqNullSafe(F.col("a_num")))
    str_ok = F.col("e_str").eqNullSafe(F.col("a_str"))
    bad = F.col("_e").isNull() | F.col("_a").isNull() | ~num_ok | ~str_ok
    per_instance = j.groupBy("variant", "params").agg(
        F.coalesce(F.max("_e"), F.lit(False)).alias("_e"), F.coalesce(F.max("_a"), F.lit(False)).alias("_a"),
        F.max(bad).alias("_bad"))
    both = F.col("_e") & F.col("_a")
    return (per_instance.groupBy("variant").agg(
        F.count(F.lit(1)).alias("instances"),
        F.count_if(~F.col("_a")).alias("skipped"), F.count_if(~both).alias("misaligned"),
        F.count_if(both & F.col("_bad")).alias("failed"))
        .withColumn("passed", F.col("failed") == 0))
