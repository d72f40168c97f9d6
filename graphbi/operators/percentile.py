"""Exact discrete percentiles of any number of distinct values, by histogram passes.

Spark's ``percentile_disc`` keeps every distinct value of a group in one
buffer.  Here a pass counts a group's values in ``BINS`` bins between their
least and greatest one, combined on the map side, and goes on with the one bin
that holds the wanted rank, until its values are all equal or few enough to
rank by a window.  Two passes do for most data; each splits off at least the
least and the greatest value, so the loop ends for any.  No pass shuffles
rows, only counts: at most ``BINS`` + 4 rows a group and fraction.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphbi.operators.rounds import RoundStore

BINS = 4096
#: Values that a window may rank.
FEW = 10_000


def _number(c: Column, kind: str) -> Column:
    """A double that never falls when the value rises."""
    if kind == "date":
        c = F.unix_date(c)
    elif kind == "timestamp_ntz":
        c = F.unix_micros(c.cast("timestamp"))
    elif kind == "timestamp":
        c = F.unix_micros(c)
    return c.cast("double")


def _bin(v: Column, lo: Column, hi: Column, kind: str, bins: int) -> Column:
    """Bin of a value between lo and hi, rising with it; lo and hi never share one unless they are equal."""
    x, a, b = (_number(c, kind) for c in (v, lo, hi))
    # halves, as the difference of two doubles may overflow
    share = (x / 2 - a / 2) / (b / 2 - a / 2)
    # three bins where numbers don't tell values apart: infinities, NaN, long integers that round to one double
    plain = F.when(v == lo, -1).when(v == hi, bins + 1).otherwise(F.lit(0))
    finite = (F.abs(a) < float("inf")) & (F.abs(b) < float("inf")) & (a < b)
    return F.when(finite, F.least(F.floor(share * bins), F.lit(bins - 1))).otherwise(plain).cast("int")


def exact_percentiles(df: DataFrame, value: str, fractions: list[float], by: list[str] | None = None,
                      bins: int = BINS, few: int = FEW) -> DataFrame:
    """(by..., fraction, value) with the least value whose share of rows up to it reaches the fraction.

    Null values don't count; a group of nulls only has no row, as an empty
    table.  Null keys are a group.  NaN is the greatest value.  The value keeps
    its type: numbers, dates and timestamps.
    """
    keys = by or []
    spark, kind = df.sparkSession, dict(df.dtypes)[value]
    names = [f"_k{i}" for i in range(len(keys))]
    rows = df.select(*[F.col(k).alias(n) for k, n in zip(keys, names, strict=True)], F.col(value).alias("_v")).where("_v is not null")
    store = RoundStore(spark, "percentile")
    stats = rows.groupBy(*names).agg(F.min("_v").alias("lo"), F.max("_v").alias("hi"), F.count(F.lit(1)).alias("n")).where("n > 0")
    at = F.explode(F.array(*[F.lit(float(p)) for p in fractions]))
    want = F.greatest(F.ceil(F.col("fraction") * F.col("n")), F.lit(1)).cast("bigint")
    state = store.put(stats.withColumn("fraction", at).withColumn("want", want))
    done: DataFrame | None = None

    def inside(ranges: DataFrame) -> DataFrame:
        """Rows within their group's ranges; the ranges are at most one row a group and fraction."""
        r = ranges.select(*[F.col(n).alias(f"r{n}") for n in names], "fraction", "want", "lo", "hi")
        same = F.col("_v").between(F.col("lo"), F.col("hi"))
        for n in names:
            same = same & F.col(n).eqNullSafe(F.col(f"r{n}"))
        return rows.join(r, same)

    while True:
        settled = state.where("lo = hi").select(*names, "fraction", F.col("lo").alias("_v"))
        done = settled if done is None else done.unionByName(settled)
        near = state.where((F.col("lo") != F.col("hi")) & (F.col("n") <= few))
        ranked = F.row_number().over(Window.partitionBy(*names, "fraction").orderBy("_v"))
        done = done.unionByName(inside(near).withColumn("_r", ranked).where("_r = want").select(*names, "fraction", "_v"))
        wide = state.where((F.col("lo") != F.col("hi")) & (F.col("n") > few))
        if wide.isEmpty():
            break
        counts = (inside(wide).groupBy(*names, "fraction", "want", _bin(F.col("_v"), F.col("lo"), F.col("hi"), kind, bins).alias("bin"))
                  .agg(F.min("_v").alias("lo"), F.max("_v").alias("hi"), F.count(F.lit(1)).alias("n")))
        before = Window.partitionBy(*names, "fraction").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
        # a window over a group's bins, not its rows
        counts = counts.withColumn("_b", F.coalesce(F.sum("n").over(before), F.lit(0)))
        state = store.put(counts.where((F.col("_b") < F.col("want")) & (F.col("_b") + F.col("n") >= F.col("want")))
                          .select(*names, "lo", "hi", "n", "fraction", (F.col("want") - F.col("_b")).alias("want")))
    return done.select(*[F.col(n).alias(k) for n, k in zip(names, keys, strict=True)], "fraction", F.col("_v").alias("value"))
