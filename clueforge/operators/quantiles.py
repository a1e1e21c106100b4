"""Exact quantiles of groups by rounds of histograms: no group's values are held in one place."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from clueforge.operators.skew import spread_join
from clueforge.session import materialise

#: Bins of a histogram, and groups that may be broadcast (some 100 bytes for each quantile).
BINS, BROADCAST_GROUPS = 4_096, 50_000


def exact_quantiles(df: DataFrame, key: str, value: str, shares: tuple[float, ...], bins: int = BINS) -> DataFrame:
    """key, share, quantile: the least value with at least that share of the group's values at or below it (nearest rank).

    In a round each group's values between two bounds are counted in `bins` bins of
    like width, map-side first; the bin that holds the rank gives the next bounds,
    its own least and greatest value. Bounds of different values fall in different
    bins, so rounds end, mostly after three or four. Null and NaN values don't
    count; a group without others gives no rows, one with a null key is a group.
    """
    rows = materialise(df.select(F.struct(key).alias("k"), F.col(value).cast("double").alias("v")).where("v is not null and not isnan(v)"), "quantile-values")
    sized = rows.groupBy("k").agg(F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high"))
    ranks = F.array(*[F.struct(F.lit(float(s)).alias("share"), F.greatest(F.lit(1), F.ceil(F.col("n") * F.lit(float(s)))).cast("long").alias("rank")) for s in shares])
    state = materialise(sized.select("k", F.explode(ranks).alias("r"), "low", "high").select("k", "r.share", "r.rank", "low", "high"), "quantile-state")
    while state.where("low < high").limit(1).count():
        open_ = state.where("low < high")
        wanted = materialise(open_.groupBy("k").agg(F.collect_list(F.struct("share", "low", "high")).alias("asked")), "quantile-asked")  # one row a group, one entry a share
        joined = rows.join(F.broadcast(wanted), "k") if wanted.count() <= BROADCAST_GROUPS else spread_join(rows, wanted, "k", "inner")
        near = joined.select("k", "v", F.explode("asked").alias("a")).where("v between a.low and a.high")
        # Halves, as the span of the largest doubles has no double.
        place = (F.col("v") / 2 - F.col("a.low") / 2) / (F.col("a.high") / 2 - F.col("a.low") / 2)
        bin_ = F.when(F.col("v") == F.col("a.high"), bins - 1).when(F.col("v") == F.col("a.low"), 0).otherwise(F.greatest(F.lit(0), F.least(F.floor(place * bins), F.lit(bins - 1)))).cast("int")
        counts = near.groupBy("k", F.col("a.share").alias("share"), bin_.alias("bin")).agg(F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high"))
        upto = Window.partitionBy("k", "share").orderBy("bin")  # at most `bins` rows
        summed = counts.withColumn("upto", F.sum("n").over(upto))
        found = summed.join(open_.select("k", "share", "rank"), ["k", "share"]).where((F.col("upto") >= F.col("rank")) & (F.col("upto") - F.col("n") < F.col("rank")))
        state = materialise(found.select("k", "share", (F.col("rank") - F.col("upto") + F.col("n")).alias("rank"), "low", "high").unionByName(state.where("low >= high")), "quantile-state")
    return state.select(F.col(f"k.{key}").alias(key), "share", F.col("low").alias("quantile"))
