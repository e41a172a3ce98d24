"""Windows as data: exhaustive tilings, sweeps over lengths, epoch grids, sliding windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def tiling(lengths: DataFrame, n: Column, window: Column, warmup: int) -> DataFrame:
    """Non-overlapping windows [start, start + window) after the warm-up, as many as fit; none where the record is too short."""
    fits = n >= F.lit(warmup) + window
    starts = F.when(fits, F.sequence(F.lit(warmup).cast("bigint"), (n - window).cast("bigint"), window.cast("bigint")))
    return lengths.withColumn("start_idx", F.explode(starts)).withColumn("end_idx", F.col("start_idx") + window)


def sweep(counts: DataFrame, windows: list[int], warmup: int) -> DataFrame:
    """The tilings of every record for every length of a fixed list."""
    each = counts.withColumn("length", F.explode(F.array(*[F.lit(w).cast("bigint") for w in windows])))
    return tiling(each, F.col("n"), F.col("length"), warmup)


def sliding(index: Column, size: int, stride: int) -> Column:
    """The numbers of the windows that an index stands in, window k being [k * stride, k * stride + size)."""
    lowest = F.greatest(F.lit(0).cast("bigint"), F.ceil((index - size + 1) / F.lit(stride)))
    return F.sequence(lowest, F.floor(index / F.lit(stride)))
