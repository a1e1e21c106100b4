"""Joins whose keys may be hot."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key is hot if it has more than one row in so many, and more rows than the least; so at most ONE_IN keys are hot.
ONE_IN, LEAST_HOT = 10_000, 64


def hot_keys(rows: DataFrame, key: str, total: int | None = None) -> DataFrame:
    """The keys (distinct, at most ONE_IN) that hold more than one in ONE_IN of `rows`; nulls are none."""
    total = rows.count() if total is None else total
    return rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("_n")).where(F.col("_n") > max(LEAST_HOT, total // ONE_IN)).select(key)


def spread_join(left: DataFrame, right: DataFrame, key: str, how: str = "left", total: int | None = None) -> DataFrame:
    """left joined with right, unique by `key`, without sending all rows of a hot key to one task.

    The hot keys (at most ONE_IN) are looked up first. Without any this is an
    ordinary join; else their right rows are broadcast, and the rest is an ordinary
    join. Left rows with a null key stay where `how` is left, without a shuffle.
    Both sides are read several times, so pass tables that are stored.
    """
    known = left.where(F.col(key).isNotNull())
    blank = left.where(F.col(key).isNull())
    found = hot_keys(left, key, total).collect()
    if found:
        hot = F.broadcast(left.sparkSession.createDataFrame(found, left.select(key).schema))
        first = known.join(hot, key, "left_semi").join(F.broadcast(right.join(hot, key, "left_semi")), key, how)
        joined = first.unionByName(known.join(hot, key, "left_anti").join(right, key, how))
    else:
        joined = known.join(right, key, how)
    return joined.unionByName(blank, allowMissingColumns=True) if how == "left" else joined
