"""Small relational building blocks shared by the queries."""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def static_dim(df: DataFrame) -> DataFrame:
    """A static dimension (tag, tag class, place) as a join side.

    No broadcast is forced: Spark broadcasts the table when its size allows
    and shuffles it otherwise.
    """
    return df


def first_per_key(df: DataFrame, key: str | list[str], order: list[Column], cols: list[str]) -> DataFrame:
    """``DISTINCT ON (key) ... ORDER BY key, order`` as a hash aggregate.

    ``order`` are ascending sort expressions (negate numeric columns for
    descending); ``cols`` are carried along.  ``min(struct(order..., cols...))``
    is partially aggregated on the map side, so a hot key never needs one task
    to sort all of its rows.
    """
    keys = [key] if isinstance(key, str) else list(key)
    packed = F.struct(*[o.alias(f"_o{i}") for i, o in enumerate(order)], *[F.col(c) for c in cols])
    best = df.groupBy(*keys).agg(F.min(packed).alias("_best"))
    return best.select(*keys, *[F.col(f"_best.{c}").alias(c) for c in cols])


def ts(value) -> _dt.datetime:
    """Parameter -> timestamp (dates mean midnight UTC)."""
    if isinstance(value, _dt.datetime):
        return value
    if isinstance(value, _dt.date):
        return _dt.datetime(value.year, value.month, value.day)
    s = str(value).replace("T", " ")
    if len(s) == 10:
        return _dt.datetime.strptime(s, "%Y-%m-%d")
    return _dt.datetime.fromisoformat(s[:19])


def day(value) -> _dt.date:
    t = ts(value)
    return _dt.date(t.year, t.month, t.day)


def lit_ts(value) -> Column:
    return F.lit(ts(value))


def count_all() -> Column:
    return F.count(F.lit(1))
