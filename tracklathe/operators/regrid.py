"""Irregular readings onto a regular grid: monotone cubic interpolation in time shards with halo readings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SUPER = 4096  # shards per block of the second level


def _slope(h0: Column, h1: Column, s0: Column, s1: Column) -> Column:
    """Steffen's slope at a knot between secants s0 and s1 over widths h0 and h1: never steeper than keeps the curve monotone, zero at an extremum."""
    parabola = (s0 * h1 + s1 * h0) / (h0 + h1)
    return (F.signum(s0) + F.signum(s1)) * F.least(F.abs(s0), F.abs(s1), 0.5 * F.abs(parabola))


def _between_shards(edges: DataFrame, key: str, block: str) -> tuple[DataFrame, DataFrame]:
    """Consecutive edge pairs (left, right) inside each block of edges, and the blocks' own edges for the next level."""
    w = Window.partitionBy(key, block).orderBy("first")
    pairs = edges.withColumn("right", F.lead("first").over(w)).where("right is not null").select(key, F.col("last").alias("left"), "right")
    return pairs, edges.groupBy(key, block).agg(F.min("first").alias("first"), F.max("last").alias("last"))


def regular_grid(
    df: DataFrame, key: str, t_ms: str, required: list[str], values: list[str],
    period_ms: int = 1000, max_gap_ms: int = 3000, shard_periods: int = 600,
) -> DataFrame:
    """One row for each period of each source, from its first to its last period with a usable reading.

    A reading is usable if its stamp and all ``required`` columns hold a number; readings of one stamp are averaged, so
    repeated rows change nothing. ``status`` is ``observed`` (a usable reading in the period), ``filled`` (none, but
    between readings at most ``max_gap_ms`` apart) or ``gap`` (none, longer gap; values null). Values stand for the
    middle of the period: shape-preserving cubic between the readings around it, the nearest reading of the period where
    the middle lies outside its segment. Null values of a column that isn't required give null or the shape of what is
    left. Sources without usable readings, null sources and empty tables give no rows; other columns are ignored.

    Rows travel once, by (source, time shard); readings within two gaps of a shard's edge go to the neighbour too, so no
    source is bound to one task. Gaps between shards come from the shards' first and last stamps, in two levels.
    """
    if max_gap_ms < period_ms:
        raise ValueError("max_gap_ms must be at least period_ms")
    shard_ms, halo = period_ms * shard_periods, 2 * max_gap_ms
    t = F.col(t_ms).cast("double")
    columns = list(dict.fromkeys([*required, *values]))
    usable = df.select(
        F.col(key).alias("_key"), F.nanvl(t, F.lit(None)).alias("_t"),
        *[F.nanvl(F.col(c).cast("double"), F.lit(None)).alias(f"_v{i}") for i, c in enumerate(columns)],
    ).where("_key is not null and _t is not null")
    for c in required:
        usable = usable.where(F.col(f"_v{columns.index(c)}").isNotNull())
    shard = F.floor(F.col("_t") / shard_ms)
    usable = usable.withColumn("_own", shard)
    start = F.col("_own") * shard_ms
    near = F.array_compact(F.array(
        F.col("_own"),
        F.when(F.col("_t") - start <= halo, F.col("_own") - 1),
        F.when(start + shard_ms - F.col("_t") <= halo, F.col("_own") + 1),
    ))
    kept = [f"_v{columns.index(c)}" for c in values]
    knots = (
        usable.select("_key", "_t", "_own", *kept, F.explode(near).alias("_shard"))
        .repartition("_key", "_shard")
        .groupBy("_key", "_shard", "_t", "_own").agg(*[F.avg(c).alias(c) for c in kept], F.count(F.lit(1)).alias("_n"))
    )
    w = Window.partitionBy("_key", "_shard").orderBy("_t")
    point = F.struct("_t", *kept)
    rows = knots.select(
        "_key", "_shard", "_own", point.alias("p1"), F.lag(point).over(w).alias("p0"),
        F.lead(point).over(w).alias("p2"), F.lead(point, 2).over(w).alias("p3"), F.lead("_own").over(w).alias("_own2"),
    )
    t0, t1, t2, t3 = (F.col(f"p{i}")["_t"] for i in range(4))
    whole = lambda x: F.floor(x / period_ms)
    middle = lambda k: (k + 0.5) * period_ms
    first_middle = lambda x: F.ceil(x / period_ms - 0.5)
    joined = t2.isNotNull() & (t2 - t1 <= max_gap_ms)
    lo = F.when(joined, first_middle(t1)).otherwise(whole(t1) + 1)
    hi = F.when(joined, first_middle(t2) - 1).when((F.col("_own") == F.col("_own2")) & (F.col("_own") == F.col("_shard")), whole(t2) - 1)
    here = F.col("_shard") * shard_periods
    known = hi.isNotNull()
    lo, hi = F.greatest(lo, here), F.least(hi, here + shard_periods - 1)
    span = F.when(known & (lo <= hi), F.transform(F.sequence(lo, hi), lambda k: F.struct(k.alias("k"), F.when(joined, 0).otherwise(2).alias("how"))))
    tail = F.when(~F.coalesce(joined, F.lit(False)) & (middle(whole(t1)) >= t1), F.array(F.struct(whole(t1).alias("k"), F.lit(1).alias("how"))))
    head = F.when((t0.isNull() | (t1 - t0 > max_gap_ms)) & (middle(whole(t1)) < t1), F.array(F.struct(whole(t1).alias("k"), F.lit(1).alias("how"))))
    none = F.array().cast("array<struct<k:bigint,how:int>>")
    emitted = rows.withColumn("e", F.explode(F.concat(*[F.coalesce(x, none) for x in (span, tail, head)]))).where(F.floor(F.col("e.k") / shard_periods) == F.col("_shard"))
    k, how = F.col("e.k"), F.col("e.how")
    seen = (how == 1) | ((how == 0) & ((k == whole(t1)) | (k == whole(t2))))
    ids = [c[2:] for c in kept]
    # one step a projection, else the repeated parts of the formula multiply out in generated code
    steps = emitted.select(
        "_key", k.alias("k"), how.alias("how"), F.when(seen, "observed").when(how == 0, "filled").otherwise("gap").alias("status"),
        F.when(t1 - t0 <= max_gap_ms, t1 - t0).alias("h0"), (t2 - t1).alias("h1"), F.when(t3 - t2 <= max_gap_ms, t3 - t2).alias("h2"),
        ((middle(k) - t1) / (t2 - t1)).alias("u"), *[F.col(f"p{j}")[f"_v{i}"].alias(f"v{j}_{i}") for i in ids for j in range(4)],
    )
    h0, h1, h2, u = (F.col(x) for x in ("h0", "h1", "h2", "u"))
    steps = steps.select(
        "_key", "k", "status", "how", "h0", "h1", "h2", "u", *[f"v{j}_{i}" for i in ids for j in (1, 2)],
        *[((F.col(f"v{j + 1}_{i}") - F.col(f"v{j}_{i}")) / h).alias(f"s{j}_{i}") for i in ids for j, h in enumerate((h0, h1, h2))],
    )
    s = lambda j, i: F.col(f"s{j}_{i}")
    steps = steps.select(
        "_key", "k", "status", "how", "h1", "u", *[f"v{j}_{i}" for i in ids for j in (1, 2)],
        *[_slope(F.coalesce(h0, h1), h1, F.coalesce(s(0, i), s(1, i)), s(1, i)).alias(f"d1_{i}") for i in ids],
        *[_slope(h1, F.coalesce(h2, h1), s(1, i), F.coalesce(s(2, i), s(1, i))).alias(f"d2_{i}") for i in ids],
    )

    def value(i: str) -> Column:
        v1, v2, d1, d2 = (F.col(f"{x}_{i}") for x in ("v1", "v2", "d1", "d2"))
        cubic = v1 * (1 + 2 * u) * (1 - u) * (1 - u) + h1 * d1 * u * (1 - u) * (1 - u) + v2 * u * u * (3 - 2 * u) + h1 * d2 * u * u * (u - 1)
        return F.when(F.col("how") == 0, cubic).when(F.col("how") == 1, v1).alias(columns[int(i)])

    inside = steps.select(F.col("_key").alias(key), F.col("k").alias("period"), "status", *[value(i) for i in ids])
    edges = usable.groupBy(F.col("_key").alias(key), F.col("_own").alias("shard")).agg(F.min("_t").alias("first"), F.max("_t").alias("last"))
    edges = edges.withColumn("block", F.floor(F.col("shard") / SUPER))
    pairs, blocks = _between_shards(edges, key, "block")
    wide, _ = _between_shards(blocks.withColumn("top", F.lit(0)), key, "top")
    gaps = pairs.unionByName(wide).where((F.col("right") - F.col("left") > max_gap_ms) & (whole(F.col("right")) - whole(F.col("left")) > 1))
    # a gap is spelt out shard by shard, so that one stamp far off makes no array longer than a shard
    first, last = whole(F.col("left")) + 1, whole(F.col("right")) - 1
    wide = lambda x: F.floor(x / (shard_periods * SUPER))
    spread = gaps.select(key, first.alias("lo"), last.alias("hi"), F.explode(F.sequence(wide(first), wide(last))).alias("w")).repartition(key, "w")
    shards = F.sequence(F.greatest(F.floor(F.col("lo") / shard_periods), F.col("w") * SUPER), F.least(F.floor(F.col("hi") / shard_periods), F.col("w") * SUPER + SUPER - 1))
    spread = spread.select(key, "lo", "hi", F.explode(shards).alias("s"))
    outside = spread.select(
        key, F.explode(F.sequence(F.greatest(F.col("lo"), F.col("s") * shard_periods), F.least(F.col("hi"), F.col("s") * shard_periods + shard_periods - 1))).alias("period"), F.lit("gap").alias("status"),
        *[F.lit(None).cast("double").alias(c) for c in values],
    )
    return inside.unionByName(outside)
