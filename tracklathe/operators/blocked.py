"""Ordered operators over keys of any size.

A window over a bare key puts the whole key into one task. The helpers here cut a key's rows into blocks of the
order column, work inside a block, and pass between blocks only what the next one needs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def previous(df: DataFrame, keys: list[str], order: list[str], block: Column, value: Column, name: str, when: Column | None = None) -> DataFrame:
    """Adds ``name``: ``value`` of the nearest earlier row of the same key for which ``when`` holds, null if there is none.

    ``block`` must not decrease along ``order``. Rows of one (key, block) share a task; blocks exchange one row each.
    Nulls in a key count as one key. Ties in ``order`` are taken in an arbitrary but single order.
    """
    held = F.when(F.lit(True) if when is None else when, F.struct(value.alias("v")))
    rows = df.withColumn("_block", block).withColumn("_held", held)
    inside = Window.partitionBy(*keys, "_block").orderBy(*order)
    rows = rows.withColumn("_near", F.last("_held", ignorenulls=True).over(inside.rowsBetween(Window.unboundedPreceding, -1)))
    marks = rows.groupBy(*keys, "_block").agg(F.max_by("_held", F.when(F.col("_held").isNotNull(), F.struct(*order))).alias("_end"))
    across = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    carried = marks.withColumn("_carry", F.last("_end", ignorenulls=True).over(across)).where("_carry is not null")
    carried = carried.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_block").alias("_b"), "_carry")
    same = F.col("_block").eqNullSafe(F.col("_b"))
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    joined = rows.join(carried, same, "left")
    return joined.withColumn(name, F.coalesce("_near", "_carry")["v"]).drop("_block", "_held", "_near", "_b", "_carry", *[f"_k{i}" for i in range(len(keys))])


def ranked(df: DataFrame, bucket: Column, order: list[Column], name: str) -> DataFrame:
    """Adds ``name``: the place of each row in one total order, from 1, without bringing all rows to one task.

    ``bucket`` must not decrease along ``order``. Only the buckets' counts meet in one task; choose it coarse enough for
    them to be few and fine enough for a bucket to fit a task.
    """
    rows = df.withColumn("_bucket", bucket)
    counts = rows.groupBy("_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = counts.select(F.col("_bucket").alias("_b"), (F.sum("_n").over(Window.orderBy("_bucket")) - F.col("_n")).alias("_before"), F.sum("_n").over(Window.partitionBy()).alias("_all"))
    place = F.row_number().over(Window.partitionBy("_bucket").orderBy(*order))
    return rows.join(before, F.col("_bucket").eqNullSafe(F.col("_b"))).withColumn(name, F.col("_before") + place).drop("_bucket", "_b", "_before")


def indexed(df: DataFrame, keys: list[str], block: Column, order: list[str], name: str, least: Column | None = None) -> DataFrame:
    """Adds ``name``: the place of each row among its key's, from 0, without a key's rows in one task; ``_least``: the least ``least`` of the key.

    ``block`` must not decrease along ``order``; blocks exchange their counts alone.
    """
    rows = df.withColumn("_block", block)
    counts = rows.groupBy(*keys, "_block").agg(F.count(F.lit(1)).alias("_n"), F.min(F.lit(0) if least is None else least).alias("_m"))
    along, whole = Window.partitionBy(*keys).orderBy("_block"), Window.partitionBy(*keys)
    counts = counts.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_block").alias("_b"), (F.sum("_n").over(along) - F.col("_n")).alias("_before"), F.min("_m").over(whole).alias("_least"))
    same = F.col("_block").eqNullSafe(F.col("_b"))
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    place = F.row_number().over(Window.partitionBy(*keys, "_block").orderBy(*order)) - 1
    return rows.join(counts, same).withColumn(name, (F.col("_before") + place).cast("bigint")).drop("_block", "_b", "_before", *[f"_k{i}" for i in range(len(keys))])


def tile(place: Column, rows: Column, tiles: int) -> Column:
    """The tile of a place among equal-count tiles; the first ones take the rows left over."""
    small, over = F.floor(rows / tiles), rows % tiles
    head = over * (small + 1)
    return F.when(place <= head, F.ceil(place / (small + 1))).otherwise(over + F.ceil((place - head) / F.greatest(small, F.lit(1)))).cast("bigint")
