"""Stream statistics, clocks, satellites, sample-and-hold rows and row formats."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracklathe.functions import text
from tracklathe.operators.blocked import previous
from tracklathe.operators.rates import histogram_percentile, sample_hold
from tracklathe.plans.base import events, r6, registry
from tracklathe.plans.ordered import by_seq
from tracklathe.session import table

QUERIES, SQL, query = registry()

_RAW = "r as (select distinct raw_id, sequence, stream, event_ns, arrival_ns, accuracy, v0, v1, v2 from raw_imu), d as (select *, (event_ns - lag(event_ns) over (partition by sequence, stream order by arrival_ns, raw_id)) / 1e6 as dt, (arrival_ns - lag(arrival_ns) over (partition by sequence, stream order by arrival_ns, raw_id)) / 1e6 as da from r)"


def _raw(spark: SparkSession, sf: str) -> DataFrame:
    r = table(spark, sf, "raw_imu").select("raw_id", "sequence", "stream", "event_ns", "arrival_ns", "accuracy", "v0", "v1", "v2").distinct()
    r = previous(r, ["sequence", "stream"], ["arrival_ns", "raw_id"], F.floor(F.col("arrival_ns") / 60_000_000_000), F.struct("event_ns", "arrival_ns"), "p")
    return r.withColumn("dt", (F.col("event_ns") - F.col("p.event_ns")) / 1e6).withColumn("da", (F.col("arrival_ns") - F.col("p.arrival_ns")) / 1e6)


@query(f"""with {_RAW}, m as (select sequence, stream, median(dt) as md from d where dt > 0 group by all)
select d.sequence, d.stream, count(dt) as n, round(avg(dt) filter (where dt > 0), 5) as mean_ms, round(stddev_samp(dt) filter (where dt > 0), 4) as std_ms, round(min(dt), 5) as min_ms, round(max(dt), 5) as max_ms,
count(*) filter (where dt <= 0) as n_backwards, count(*) filter (where dt > 3 * md) as n_gaps, count(*) filter (where da < 0.5) as n_batched from d join m using (sequence, stream) group by d.sequence, d.stream""")
def rate_stats(spark: SparkSession, sf: str) -> DataFrame:
    """Interval mean, deviation and extremes, steps back, gaps and batched arrivals of each stream."""
    d = _raw(spark, sf)
    m = d.where("dt > 0").groupBy("sequence", "stream").agg(F.median("dt").alias("md"))
    ok = F.when(F.col("dt") > 0, F.col("dt"))
    return d.join(m, ["sequence", "stream"]).groupBy("sequence", "stream").agg(
        F.count("dt").alias("n"), F.round(F.avg(ok), 5).alias("mean_ms"), F.round(F.stddev_samp(ok), 4).alias("std_ms"), F.round(F.min("dt"), 5).alias("min_ms"), F.round(F.max("dt"), 5).alias("max_ms"),
        F.count_if(F.col("dt") <= 0).alias("n_backwards"), F.count_if(F.col("dt") > 3 * F.col("md")).alias("n_gaps"), F.count_if(F.col("da") < 0.5).alias("n_batched"),
    )


@query(f"""with {_RAW}, b as (select sequence, stream, least(cast(floor(dt / 0.1) as bigint), 20000) as b, count(*) as c, max(dt) as m from d where dt > 0 group by all),
u as (select *, sum(c) over (partition by sequence, stream order by b rows unbounded preceding) as upto, greatest(floor(0.95 * sum(c) over (partition by sequence, stream)), 1) as target, max(m) over (partition by sequence, stream) as top from b)
select sequence, stream, round(case when min(b) >= 20000 then max(top) else (min(b) + 1) * 0.1 end, 5) as p95_ms from u where upto >= target group by sequence, stream""")
def hist_percentile(spark: SparkSession, sf: str) -> DataFrame:
    """The 95th percentile of the intervals as the upper edge of its 100 us bin."""
    h = histogram_percentile(_raw(spark, sf).where("dt > 0"), ["sequence", "stream"], F.col("dt"), 0.1, 0.95, 20_000, "p95_ms")
    return h.withColumn("p95_ms", F.round("p95_ms", 5))


@query("""with r as (select distinct raw_id, sequence, event_ns, arrival_ns from raw_imu), k as (select *, arrival_ns - event_ns as off, row_number() over (partition by sequence order by arrival_ns, raw_id) as k from r),
f as (select * from k where k <= 4096), s as (select *, row_number() over (partition by sequence order by off, raw_id) - 1 as p, count(*) over (partition by sequence) as n from f)
select sequence, max(off) filter (where p = n // 2) as upper_median_ns, round(avg(cast(abs(off) < 10000000 as double)), 6) as vote, avg(cast(abs(off) < 10000000 as double)) > 0.9 as same_clock from s group by sequence""")
def timebase_vote(spark: SparkSession, sf: str) -> DataFrame:
    """The upper median offset of a recording's first 4096 rows, and the vote on whether both stamps share a clock."""
    r = table(spark, sf, "raw_imu").select("raw_id", "sequence", "event_ns", "arrival_ns").distinct().withColumn("off", F.col("arrival_ns") - F.col("event_ns"))
    f = r.withColumn("k", F.row_number().over(Window.partitionBy("sequence").orderBy("arrival_ns", "raw_id"))).where("k <= 4096")
    s = f.withColumn("p", F.row_number().over(Window.partitionBy("sequence").orderBy("off", "raw_id")) - 1).withColumn("n", F.count("*").over(Window.partitionBy("sequence")))
    vote = F.avg((F.abs("off") < 10_000_000).cast("double"))
    return s.groupBy("sequence").agg(F.max(F.when(F.col("p") == F.floor(F.col("n") / 2), F.col("off"))).alias("upper_median_ns"), r6(vote).alias("vote"), (vote > 0.9).alias("same_clock"))


@query("""with s as (select l_orderkey, list(l_quantity order by l_quantity desc) as q, count(*) as in_view, count(*) filter (where l_discount > 0.05) as used, max(l_quantity) as top from lineitem where l_quantity > 0 group by l_orderkey)
select l_orderkey, in_view, used, round(list_avg(q[1:4]), 6) as mean_top4, round(top, 6) as top from s""")
def sat_summary(spark: SparkSession, sf: str) -> DataFrame:
    """Count, used, greatest and the mean of the best four signals of each epoch, an epoch having a bounded number of them."""
    q = F.slice(F.sort_array(F.collect_list("l_quantity"), asc=False), 1, 4)
    s = table(spark, sf, "lineitem").where("l_quantity > 0").groupBy("l_orderkey").agg(q.alias("q"), F.count(F.lit(1)).alias("in_view"), F.count_if(F.col("l_discount") > 0.05).alias("used"), r6(F.max("l_quantity")).alias("top"))
    return s.select("l_orderkey", "in_view", "used", r6(F.aggregate("q", F.lit(0.0), lambda a, x: a + x) / F.size("q")).alias("mean_top4"), "top")


_KINDS = ["click", "error", "purchase", "signup", "view"]


@query("select seq, " + ", ".join(f"count(*) filter (where kind = '{k}') as {k}" for k in _KINDS[:3]) + ", count(*) filter (where kind not in ('click', 'error', 'purchase')) as other from ev group by seq")
def constellation_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Counts by kind as a map, the named ones as columns and the rest summed."""
    c = events(spark, sf).groupBy("seq", "kind").agg(F.count(F.lit(1)).alias("n"))
    m = c.groupBy("seq").agg(F.map_from_entries(F.collect_list(F.struct("kind", "n"))).alias("m"))
    named = _KINDS[:3]
    rest = F.aggregate(F.map_values(F.map_filter("m", lambda k, _: ~k.isin(named))), F.lit(0).cast("bigint"), lambda a, x: a + x)
    return m.select("seq", *[F.coalesce(F.col("m")[k], F.lit(0).cast("bigint")).alias(k) for k in named], rest.alias("other"))


@query("""with g as (select seq, unnest(range(0, cast(floor(max(t_s) / 50000) as bigint) + 1)) * 50000.0 as tick from ev group by seq),
a as (select g.seq, g.tick, e.v from g asof left join (select seq, t_s, v from ev where kind = 'view') e on g.seq = e.seq and g.tick >= e.t_s),
b as (select g.seq, g.tick, e.v from g asof left join (select seq, t_s, v from ev where kind = 'click') e on g.seq = e.seq and g.tick >= e.t_s)
select a.seq, cast(a.tick as double) as tick, a.v as view, b.v as click from a join b on a.seq = b.seq and a.tick = b.tick where a.v is not null""")
def sample_hold_grid(spark: SparkSession, sf: str) -> DataFrame:
    """A fixed grid of ticks with the latest value of two channels, from the first channel's first event on."""
    e = events(spark, sf)
    g = e.groupBy("seq").agg(F.floor(F.max("t_s") / 50_000).alias("n")).select("seq", F.explode(F.sequence(F.lit(0).cast("bigint"), "n")).alias("i")).select("seq", (F.col("i") * 50_000.0).alias("tick"))
    return sample_hold(g, e.where(F.col("kind").isin("view", "click")), "seq", "tick", "t_s", "kind", "v", ["view", "click"]).where("view is not null")


@query("""select distinct raw_id, concat_ws(',', stream, event_ns, arrival_ns, accuracy, case when v0 is null then '' else printf('%.6f', v0) end, case when v1 is null then '' else printf('%.6f', v1) end, case when v2 is null then '' else printf('%.6f', v2) end) as line from raw_imu""")
def row_format(spark: SparkSession, sf: str) -> DataFrame:
    """Sidecar lines: whole stamps, six decimals, nothing for a missing value."""
    six = lambda c: F.when(F.col(c).isNull(), "").otherwise(F.format_string("%.6f", c))
    return table(spark, sf, "raw_imu").select("raw_id", F.concat_ws(",", "stream", "event_ns", "arrival_ns", "accuracy", six("v0"), six("v1"), six("v2")).alias("line")).distinct()


@query("select event_id, cast(printf('%.5e', v * 1.23456789) as double) as six from ev")
def six_digits(spark: SparkSession, sf: str) -> DataFrame:
    """Numbers to six significant digits."""
    return events(spark, sf).select("event_id", text.six_digits(F.col("v") * 1.23456789).alias("six"))


@query(f"""with w as (select seq, count(*) as n, count(*) * 1e5 / nullif(max(t_s), 0) as rate, count(*) filter (where v < 10) as low from ev group by seq)
select seq, list_filter([case when n > 60 and rate < 3.5 then 'slow' end, case when rate > 4.5 then 'capped' end, case when low > 1 then 'low' end], lambda x: x is not null) as warnings from w""")
def live_warnings(spark: SparkSession, sf: str) -> DataFrame:
    """The warnings that hold for a stream."""
    w = events(spark, sf).groupBy("seq").agg(F.count(F.lit(1)).alias("n"), F.try_divide(F.count(F.lit(1)) * 1e5, F.max("t_s")).alias("rate"), F.count_if(F.col("v") < 10).alias("low"))
    rules = [((F.col("n") > 60) & (F.col("rate") < 3.5), "slow"), (F.col("rate") > 4.5, "capped"), (F.col("low") > 1, "low")]
    return w.select("seq", F.array_compact(F.array(*[F.when(c, F.lit(x)) for c, x in rules])).alias("warnings"))


@query("""with c as (select seq, us // 1000 as ms, v, first_value(v) over (partition by seq order by us // 1000 range between 40000000 preceding and current row) as f, lag(v) over (partition by seq order by us // 1000, event_id) as p, event_id from ev)
select event_id, v - f >= 250 as rise, p > 400 and v < 100 as darkened from c""")
def ring_rise(spark: SparkSession, sf: str) -> DataFrame:
    """A rise against the first reading of a sliding time range, and a fall between two consecutive readings."""
    ms = F.floor(F.col("us") / 1000)
    e = events(spark, sf).withColumn("ms", ms)
    first = F.first("v").over(Window.partitionBy("seq").orderBy("ms").rangeBetween(-40_000_000, 0))
    before = F.lag("v").over(Window.partitionBy("seq").orderBy("ms", "event_id"))
    return e.select("event_id", (F.col("v") - first >= 250).alias("rise"), ((before > 400) & (F.col("v") < 100)).alias("darkened"))


@query("""with e as (select seq, sample_idx, t_s, coalesce(sqrt(pow((lat - lag(lat) over w) * 111320.0, 2) + pow((lon - lag(lon) over w) * 111320.0 * cos(radians(52.4)), 2)), 0) as d from ev window w as (partition by seq order by sample_idx))
select seq, sample_idx, round(sum(d) over (partition by seq order by sample_idx rows between current row and unbounded following) - d, 3) as remaining_m from e""")
def remaining_length(spark: SparkSession, sf: str) -> DataFrame:
    """What is left of each track after each of its points: a running sum from the end."""
    import math

    n = (F.col("lat") - F.lag("lat").over(by_seq())) * 111320.0
    x = (F.col("lon") - F.lag("lon").over(by_seq())) * 111320.0 * math.cos(math.radians(52.4))
    e = events(spark, sf).withColumn("d", F.coalesce(F.sqrt(n * n + x * x), F.lit(0.0)))
    left = F.sum("d").over(by_seq().rowsBetween(0, Window.unboundedFollowing)) - F.col("d")
    return e.select("seq", "sample_idx", F.round(left, 3).alias("remaining_m"))


@query("select event_id, 1700000000000 + us // 1000 as wall_ms, strftime(make_timestamp(us), '%Y-%m-%d %H:%M:%S') as day_clock, us % 1000000 // 1000 as millis from ev")
def wall_clock(spark: SparkSession, sf: str) -> DataFrame:
    """A boot-anchored wall clock by whole division, and its text."""
    us = F.col("us")
    return events(spark, sf).select("event_id", (F.lit(1_700_000_000_000) + F.floor(us / 1000)).alias("wall_ms"), F.date_format(F.timestamp_micros(us), "yyyy-MM-dd HH:mm:ss").alias("day_clock"), F.floor(us % 1_000_000 / 1000).alias("millis"))


@query("select seq, round(min(lat), 6) as south, round(max(lat), 6) as north, round(min(lon), 6) as west, round(max(lon), 6) as east, round(max(greatest(abs(v), abs(k))), 6) as scale from ev group by seq")
def extents(spark: SparkSession, sf: str) -> DataFrame:
    """Bounding box and scale of each track."""
    return events(spark, sf).groupBy("seq").agg(r6(F.min("lat")).alias("south"), r6(F.max("lat")).alias("north"), r6(F.min("lon")).alias("west"), r6(F.max("lon")).alias("east"), r6(F.max(F.greatest(F.abs("v"), F.abs("k").cast("double")))).alias("scale"))


@query("select kind, time_bucket(interval 6 hour, ts) as at, count(*) as n, round(avg(v), 6) as mean_v from (select event_type as kind, ts, value as v from events) group by all")
def tumbling_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Tumbling event-time windows, the batch twin of the streaming aggregate."""
    e = table(spark, sf, "events").withColumn("w", F.window(F.col("ts"), "6 hours"))
    return e.groupBy(F.col("event_type").alias("kind"), F.col("w.start").alias("at")).agg(F.count(F.lit(1)).alias("n"), r6(F.avg("value")).alias("mean_v"))
