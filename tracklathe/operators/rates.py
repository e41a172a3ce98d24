"""Rate statistics of streams: intervals, histograms, votes on clocks, sample-and-hold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def histogram_percentile(rows: DataFrame, keys: list[str], value: Column, width: float, q: float, last_bin: int, name: str) -> DataFrame:
    """The upper edge of the bin in which the q-th part of the values ends; the greatest value where that is the overflow bin.

    Counts are taken by bin first; at most ``last_bin`` + 1 rows a key meet in a task.
    """
    x = rows.select(*keys, value.alias("_x")).where("_x is not null")
    bins = x.groupBy(*keys, F.least(F.floor(F.col("_x") / width), F.lit(last_bin)).alias("_b")).agg(F.count(F.lit(1)).alias("_c"), F.max("_x").alias("_m"))
    upto = F.sum("_c").over(Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, 0))
    whole = Window.partitionBy(*keys)
    bins = bins.withColumn("_upto", upto).withColumn("_target", F.greatest(F.floor(F.lit(q) * F.sum("_c").over(whole)), F.lit(1))).withColumn("_top", F.max("_m").over(whole))
    hit = bins.where(F.col("_upto") >= F.col("_target")).groupBy(*keys).agg(F.min("_b").alias("_b"), F.first("_top").alias("_top"))
    return hit.select(*keys, F.when(F.col("_b") >= last_bin, F.col("_top")).otherwise((F.col("_b") + 1) * width).alias(name))


def sample_hold(grid: DataFrame, samples: DataFrame, key: str, tick: str, t: str, channel: str, value: str, channels: list[str]) -> DataFrame:
    """For each tick of a fixed grid the latest value of each channel at or before it; no row before a channel's first."""
    a = grid.select(key, F.col(tick).alias("_t"), F.lit(1).alias("_tick"))
    b = samples.select(key, F.col(t).alias("_t"), F.lit(0).alias("_tick"), F.col(channel).alias("_c"), F.col(value).alias("_v"))
    w = Window.partitionBy(key).orderBy("_t", "_tick").rowsBetween(Window.unboundedPreceding, 0)
    both = a.unionByName(b, allowMissingColumns=True)
    held = both.select(key, "_t", "_tick", *[F.last(F.when(F.col("_c") == c, F.col("_v")), ignorenulls=True).over(w).alias(c) for c in channels])
    return held.where("_tick = 1").select(key, F.col("_t").alias(tick), *channels)
