"""Trajectory scores: per-epoch errors, per-window metrics, robust summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WINDOW = ["seq", "length", "start_idx"]


def signed_error(dn: Column, de: Column, en: Column, ee: Column) -> Column:
    """The estimate's error along the true step; where the truth stands still, the length of the estimated step."""
    step = F.sqrt(dn * dn + de * de)
    return F.when(step > 1e-9, ((en - dn) * dn + (ee - de) * de) / step).otherwise(F.sqrt(en * en + ee * ee))


def window_steps(samples: DataFrame, windows: DataFrame, methods: dict[str, tuple[str, str]]) -> DataFrame:
    """True and estimated displacements of every epoch of every window, one row a method.

    ``samples`` has ``seq, sample_idx, north, east`` and the columns of each method's position. A window's epochs are the
    samples after its start up to and with its end. The join is on (seq, sample_idx), windows being spelt out.
    """
    spelt = windows.withColumn("sample_idx", F.explode(F.sequence("start_idx", "end_idx")))
    rows = spelt.join(samples, ["seq", "sample_idx"])
    w = Window.partitionBy(*WINDOW).orderBy("sample_idx")
    step = lambda c: (F.col(c) - F.lag(c).over(w))
    each = F.array(*[F.struct(F.lit(m).alias("method"), step(n).alias("en"), step(e).alias("ee")) for m, (n, e) in methods.items()])
    rows = rows.select(*WINDOW, "sample_idx", step("north").alias("dn"), step("east").alias("de"), each.alias("m")).where("dn is not null")
    return rows.select(*WINDOW, "sample_idx", "dn", "de", F.explode("m").alias("m")).select(*WINDOW, "sample_idx", "m.method", "dn", "de", "m.en", "m.ee")


def window_metrics(steps: DataFrame) -> DataFrame:
    """Signed and absolute error sums, their quadratic forms, path and drift of each window; drift null without path."""
    rows = steps.withColumn("err", signed_error(F.col("dn"), F.col("de"), F.col("en"), F.col("ee")))
    path = F.sum(F.sqrt(F.col("dn") * F.col("dn") + F.col("de") * F.col("de")))
    off = F.sqrt(F.pow(F.sum("en") - F.sum("dn"), 2) + F.pow(F.sum("ee") - F.sum("de"), 2))
    return rows.groupBy(*WINDOW, "method").agg(
        F.count(F.lit(1)).alias("n_epochs"), F.count("err").alias("n_scored"), F.sum("err").alias("cte"), F.sum(F.abs("err")).alias("crse"), F.sqrt(F.sum(F.col("err") * F.col("err"))).alias("root_sum"),
        F.sqrt(F.avg(F.col("err") * F.col("err"))).alias("rms"), path.alias("path"), F.when(path > 0, 100 * off / path).alias("drift"),
    )


def summary(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """Count, median, linear 95th percentile, maximum, mean and share below 10 of a value."""
    v = F.col(value)
    return rows.groupBy(*by).agg(
        F.count(v).alias("n"), F.round(F.median(v), 6).alias("median"), F.round(F.percentile(v, 0.95), 6).alias("p95"), F.round(F.max(v), 6).alias("max"),
        F.round(F.avg(v), 6).alias("mean"), F.round(F.avg((v < 10).cast("double")), 6).alias("below_10"),
    )
