"""As-of joins, gaps and islands, and clock repairs over ordered series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracklathe.operators.blocked import previous


def _tagged(left: DataFrame, right: DataFrame, by: list[str], on: str, tie: str, width: float) -> DataFrame:
    """Left and right rows in one frame: side 0 is right, its payload in ``_r``, left's in ``_l``."""
    keep = [F.col(k) for k in by]
    a = left.select(*keep, F.col(on).alias("_t"), F.lit(1).alias("_side"), F.lit(0).cast("bigint").alias("_tie"), F.struct(*left.columns).alias("_l"))
    b = right.where(F.col(on).isNotNull()).select(*keep, F.col(on).alias("_t"), F.lit(0).alias("_side"), F.col(tie).cast("bigint").alias("_tie"), F.struct(*right.columns).alias("_r"))
    return a.unionByName(b, allowMissingColumns=True)


def asof_join(
    left: DataFrame, right: DataFrame, by: list[str], on: str, tie: str, direction: str = "backward",
    tolerance: float | None = None, width: float = 86_400.0, prefix: str = "r_",
) -> DataFrame:
    """Left rows with the right row of the same key at or before (``backward``), or nearest to (``nearest``), their time.

    ``nearest`` prefers the earlier row of two equally near. ``tie`` orders right rows of one time: backward takes the
    greatest, as does the earlier side of nearest; the later side takes the smallest. Left rows without a partner, with
    one beyond the tolerance, or with a null time or key keep nulls. Right columns come out as prefix + name. Keys are worked through in
    blocks of ``width`` of the time, so a key of any size is split.
    """
    rows = _tagged(left, right, by, on, tie, width).withColumn("_rt", F.struct(F.col("_t").alias("t"), F.col("_r").alias("r")))
    is_right = F.col("_side") == 0
    rows = rows.where(F.col("_t").isNotNull())
    rows = previous(rows, by, ["_t", "_side", "_tie"], F.floor(F.col("_t") / width), F.col("_rt"), "_before", is_right)
    hit = F.col("_before")
    if direction == "nearest":
        rows = rows.withColumn("_neg", -F.col("_t")).withColumn("_negtie", -F.col("_tie"))
        rows = previous(rows, by, ["_neg", "_side", "_negtie"], F.floor(F.col("_neg") / width), F.col("_rt"), "_after", is_right)
        before, after = F.col("_t") - F.col("_before.t"), F.col("_after.t") - F.col("_t")
        hit = F.when(F.col("_before").isNull(), F.col("_after")).when(F.col("_after").isNull() | (before <= after), F.col("_before")).otherwise(F.col("_after"))
    rows = rows.where("_side = 1").withColumn("_hit", hit)
    if tolerance is not None:
        rows = rows.withColumn("_hit", F.when(F.abs(F.col("_hit.t") - F.col("_t")) <= tolerance, F.col("_hit")))
    lost = left.where(F.col(on).isNull()).select(*left.columns, *[F.lit(None).cast(right.schema[c].dataType).alias(prefix + c) for c in right.columns])
    return rows.select(*[F.col("_l")[c].alias(c) for c in left.columns], *[F.col("_hit.r")[c].alias(prefix + c) for c in right.columns]).unionByName(lost)


def islands(df: DataFrame, keys: list[str], order: str, holds: Column) -> DataFrame:
    """Runs of rows for which ``holds`` is true: keys, ``start`` and ``stop`` (half open, of ``order``), ``n``."""
    w = Window.partitionBy(*keys).orderBy(order)
    rows = df.select(*keys, order, F.coalesce(holds, F.lit(False)).alias("_h"))
    rows = rows.withColumn("_edge", (F.col("_h") & ~F.coalesce(F.lag("_h").over(w), F.lit(False))).cast("int"))
    rows = rows.withColumn("_run", F.sum("_edge").over(w)).where("_h")
    return rows.groupBy(*keys, "_run").agg(F.min(order).alias("start"), (F.max(order) + 1).alias("stop"), F.count(F.lit(1)).alias("n")).drop("_run")


def unwrapped(x: Column, w, period: float = 86_400.0) -> Column:
    """A clock that starts over, made to go on: adds the period at every drop of more than half of it."""
    return x + period * F.sum(F.when(x - F.lag(x).over(w) < -period / 2, 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0))
