"""Windows, epochs, scores, summaries and calibration over the event stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracklathe.functions import geo
from tracklathe.operators.blocked import previous, ranked, tile
from tracklathe.operators.outages import sliding, sweep
from tracklathe.operators.scoring import summary, window_metrics, window_steps
from tracklathe.plans.base import LENGTHS, WARMUP, events, r6, registry
from tracklathe.plans.ordered import by_seq, is_fix
from tracklathe.session import table

QUERIES, SQL, query = registry()

_N = "n as (select seq, count(*) as n from ev group by seq)"
_SWEEP = f"{_N}, l as (select unnest([{', '.join(map(str, LENGTHS))}])::bigint as length), sw as (select seq, length, n, unnest(range({WARMUP}, n - length + 1, length)) as start_idx from n, l where n >= {WARMUP} + length)"


def _counts(spark: SparkSession, sf: str) -> DataFrame:
    return events(spark, sf).groupBy("seq").agg(F.count(F.lit(1)).alias("n"))


@query(f"with {_SWEEP} select seq, start_idx, start_idx + length as end_idx from sw where length = 10")
def outage_tiling(spark: SparkSession, sf: str) -> DataFrame:
    """Every non-overlapping window of one length after the warm-up."""
    return sweep(_counts(spark, sf), [10], WARMUP).select("seq", "start_idx", "end_idx")


@query(f"with {_SWEEP} select seq, length, start_idx, start_idx + length as end_idx from sw")
def outage_sweep(spark: SparkSession, sf: str) -> DataFrame:
    """The tilings of every length."""
    return sweep(_counts(spark, sf), LENGTHS, WARMUP).select("seq", "length", "start_idx", "end_idx")


@query(f"with {_SWEEP}, p as (select length, start_idx < lag(start_idx + length) over (partition by seq, length order by start_idx) as bad from sw) select length, count(*) as n_windows, count(*) filter (where bad) as n_overlaps from p group by length")
def non_overlap(spark: SparkSession, sf: str) -> DataFrame:
    """The check that windows of one record and length never overlap."""
    w = Window.partitionBy("seq", "length").orderBy("start_idx")
    p = sweep(_counts(spark, sf), LENGTHS, WARMUP).withColumn("bad", F.col("start_idx") < F.lag("end_idx").over(w))
    return p.groupBy("length").agg(F.count(F.lit(1)).alias("n_windows"), F.count_if("bad").alias("n_overlaps"))


@query(f"with {_SWEEP} select seq, start_idx, unnest(range(0, length + 1, 5)) + start_idx as boundary from sw where length = 20")
def epoch_grid(spark: SparkSession, sf: str) -> DataFrame:
    """The boundaries of each window's epochs, the last included."""
    w = sweep(_counts(spark, sf), [20], WARMUP)
    return w.select("seq", "start_idx", F.explode(F.sequence("start_idx", "end_idx", F.lit(5).cast("bigint"))).alias("boundary"))


@query("""with w as (select seq, unnest(range(cast(greatest(0, ceil((sample_idx - 19) / 10.0)) as bigint), cast(floor(sample_idx / 10.0) as bigint) + 1)) as win, v, t_s from ev)
select seq, win, count(*) as n, round(avg(v), 6) as mean_v, round(max(t_s) - min(t_s), 6) as span_s from w group by seq, win having count(*) = 20""")
def sliding_windows(spark: SparkSession, sf: str) -> DataFrame:
    """Full windows of 20 samples at a stride of 10."""
    e = events(spark, sf).select("seq", F.explode(sliding(F.col("sample_idx"), 20, 10)).alias("win"), "v", "t_s")
    g = e.groupBy("seq", "win").agg(F.count(F.lit(1)).alias("n"), r6(F.avg("v")).alias("mean_v"), r6(F.max("t_s") - F.min("t_s")).alias("span_s"))
    return g.where("n = 20")


@query("""with b as (select seq, sample_idx // 10 as epoch, count(*) as n, sum(v) as dist, arg_max(t_s, sample_idx) as t from ev group by 1, 2),
l as (select seq, epoch, n, dist, lag(dist) over w as before, lag(epoch) over w as e0, lag(n) over w as n0 from b window w as (partition by seq order by epoch))
select seq, epoch, round(dist, 6) as distance, round(dist - before, 6) as d_distance from l where n = 10 and n0 = 10 and e0 = epoch - 1""")
def epoch_windows(spark: SparkSession, sf: str) -> DataFrame:
    """Tumbling epochs of ten samples with their target and its change; two full ones in a row are needed."""
    b = events(spark, sf).groupBy("seq", F.floor(F.col("sample_idx") / 10).alias("epoch")).agg(F.count(F.lit(1)).alias("n"), F.sum("v").alias("dist"))
    w = Window.partitionBy("seq").orderBy("epoch")
    b = b.withColumn("before", F.lag("dist").over(w)).withColumn("e0", F.lag("epoch").over(w)).withColumn("n0", F.lag("n").over(w))
    return b.where("n = 10 and n0 = 10 and e0 = epoch - 1").select("seq", "epoch", r6("dist").alias("distance"), r6(F.col("dist") - F.col("before")).alias("d_distance"))


def _samples(spark: SparkSession, sf: str) -> DataFrame:
    e = events(spark, sf)
    first = Window.partitionBy("seq").orderBy("sample_idx").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    north, east = geo.ned(F.col("lat"), F.col("lon"), F.first("lat").over(first), F.first("lon").over(first))
    e = e.withColumn("north", north).withColumn("east", east)
    upto = by_seq().rowsBetween(Window.unboundedPreceding, 0)
    held = lambda c: F.last(F.when(is_fix(), F.col(c)), ignorenulls=True).over(upto)
    return e.select("seq", "sample_idx", "t_s", "north", "east", held("north").alias("held_north"), held("east").alias("held_east"), F.lit(0.0).alias("still"))


def _steps(spark: SparkSession, sf: str) -> DataFrame:
    """Windows end inside the record, so that their last epoch has a sample."""
    windows = sweep(_counts(spark, sf), LENGTHS, WARMUP).where("end_idx < n")
    return window_steps(_samples(spark, sf), windows, {"hold": ("held_north", "held_east"), "still": ("still", "still")})


_STEPS = f"""{_SWEEP}, f as (select *, first_value(lat) over w as lat0, first_value(lon) over w as lon0 from ev window w as (partition by seq order by sample_idx)),
p as (select seq, sample_idx, t_s, kind, (lat - lat0) * (111132.92 - 559.82 * cos(2 * radians(lat0)) + 1.175 * cos(4 * radians(lat0)) - 0.0023 * cos(6 * radians(lat0))) as north,
 (lon - lon0) * (111412.84 * cos(radians(lat0)) - 93.5 * cos(3 * radians(lat0)) + 0.118 * cos(5 * radians(lat0))) as east from f),
h as (select *, last_value(case when kind in ('view', 'click') then north end ignore nulls) over w as hn, last_value(case when kind in ('view', 'click') then east end ignore nulls) over w as he from p
 window w as (partition by seq order by sample_idx rows between unbounded preceding and current row)),
x as (select sw.seq, sw.length, sw.start_idx, h.sample_idx, h.north - lag(h.north) over w as dn, h.east - lag(h.east) over w as de, h.hn - lag(h.hn) over w as hn, h.he - lag(h.he) over w as he
 from sw join h on h.seq = sw.seq and h.sample_idx between sw.start_idx and sw.start_idx + sw.length where sw.start_idx + sw.length < n window w as (partition by sw.seq, sw.length, sw.start_idx order by h.sample_idx)),
st as (select seq, length, start_idx, sample_idx, 'hold' as method, dn, de, hn as en, he as ee from x where dn is not null union all select seq, length, start_idx, sample_idx, 'still', dn, de, 0.0, 0.0 from x where dn is not null),
er as (select *, case when sqrt(dn * dn + de * de) > 1e-9 then ((en - dn) * dn + (ee - de) * de) / sqrt(dn * dn + de * de) else sqrt(en * en + ee * ee) end as err from st),
me as (select seq, length, start_idx, method, count(*) as n_epochs, count(err) as n_scored, sum(err) as cte, sum(abs(err)) as crse, sqrt(sum(err * err)) as root_sum, sqrt(avg(err * err)) as rms, sum(sqrt(dn * dn + de * de)) as path,
 case when sum(sqrt(dn * dn + de * de)) > 0 then 100 * sqrt(pow(sum(en) - sum(dn), 2) + pow(sum(ee) - sum(de), 2)) / sum(sqrt(dn * dn + de * de)) end as drift from er group by 1, 2, 3, 4)"""


@query(f"with {_STEPS} select seq, start_idx, sample_idx, method, round(err, 6) as err from er where length = 5")
def signed_error(spark: SparkSession, sf: str) -> DataFrame:
    """The error of each epoch along the true step."""
    from tracklathe.operators.scoring import signed_error as along

    s = _steps(spark, sf).where("length = 5")
    return s.select("seq", "start_idx", "sample_idx", "method", r6(along(F.col("dn"), F.col("de"), F.col("en"), F.col("ee"))).alias("err"))


@query(f"with {_STEPS} select seq, length, start_idx, method, n_epochs, round(cte, 6) as cte, round(crse, 6) as crse, round(root_sum, 6) as root_sum, round(rms, 6) as rms, round(path, 6) as path, round(drift, 6) as drift from me")
def cte_crse(spark: SparkSession, sf: str) -> DataFrame:
    """The full metric row of every window and method."""
    m = window_metrics(_steps(spark, sf))
    return m.select("seq", "length", "start_idx", "method", "n_epochs", *[r6(c).alias(c) for c in ("cte", "crse", "root_sum", "rms", "path", "drift")])


_SUM = "count({v}) as n, round(median({v}), 6) as median, round(quantile_cont({v}, 0.95), 6) as p95, round(max({v}), 6) as max, round(avg({v}), 6) as mean, round(avg(cast({v} < 10 as double)), 6) as below_10"


@query(f"with {_STEPS} select method, length, {_SUM.format(v='drift')} from me where n_scored = n_epochs group by method, length")
def drift_summary(spark: SparkSession, sf: str) -> DataFrame:
    """Median, 95th percentile and maximum drift by method and outage length."""
    return summary(window_metrics(_steps(spark, sf)).where("n_scored = n_epochs"), ["method", "length"], "drift")


@query(f"with {_STEPS} select method, length, {_SUM.format(v='crse')} from me where n_scored = n_epochs group by method, length")
def summary_by_method(spark: SparkSession, sf: str) -> DataFrame:
    """The same summary of the accumulated absolute error."""
    return summary(window_metrics(_steps(spark, sf)).where("n_scored = n_epochs"), ["method", "length"], "crse")


@query(f"""with {_STEPS}, c as (select *, case when seq % 2 = 0 then 'quiet' else 'vibrating' end as cls from me where n_scored = n_epochs and length = 10)
select coalesce(cls, 'pooled') as cls, count(*) filter (where method = 'hold') as n_windows, round(median(drift) filter (where method = 'still') / nullif(median(drift) filter (where method = 'hold'), 0), 6) as ratio from c group by rollup (cls)""")
def ratio_by_class(spark: SparkSession, sf: str) -> DataFrame:
    """The ratio of the methods' median drifts, by class and pooled, in one rollup."""
    m = window_metrics(_steps(spark, sf)).where("n_scored = n_epochs and length = 10")
    m = m.withColumn("cls", F.when(F.col("seq") % 2 == 0, "quiet").otherwise("vibrating"))
    med = lambda k: F.median(F.when(F.col("method") == k, F.col("drift")))
    g = m.rollup("cls").agg(F.count_if(F.col("method") == "hold").alias("n_windows"), r6(F.try_divide(med("still"), med("hold"))).alias("ratio"))
    return g.withColumn("cls", F.coalesce("cls", F.lit("pooled")))


@query(f"""with {_STEPS}, d as (select *, case when n_scored < n_epochs then 'no_fix_before' when drift is null then 'zero_distance' end as kind from me) select kind, method, count(*) as n from d where kind is not null group by 1, 2""")
def dropped_by_kind(spark: SparkSession, sf: str) -> DataFrame:
    """Windows that can't be scored, by the reason."""
    kind = F.when(F.col("n_scored") < F.col("n_epochs"), "no_fix_before").when(F.col("drift").isNull(), "zero_distance")
    return window_metrics(_steps(spark, sf)).withColumn("kind", kind).where("kind is not null").groupBy("kind", "method").agg(F.count(F.lit(1)).alias("n"))


@query(f"""with {_STEPS}, k as (select seq, length, start_idx, row_number() over (partition by seq, length order by start_idx) as r from (select distinct seq, length, start_idx from me where n_scored = n_epochs and method = 'hold'))
select seq, length, start_idx from k where r = 1""")
def first_replay_window(spark: SparkSession, sf: str) -> DataFrame:
    """The first window of each record and length that was scored."""
    m = window_metrics(_steps(spark, sf)).where("n_scored = n_epochs and method = 'hold'")
    return m.groupBy("seq", "length").agg(F.min("start_idx").alias("start_idx"))


_YAW = """y as (select *, k / 50.0 * pi() as est, v / 250.0 * pi() as tru from ev), w as (select *, (est - tru) - 2 * pi() * ceil(((est - tru) - pi()) / (2 * pi())) as d from y)"""


@query(f"with {_YAW} select seq, round(sqrt(avg(d * d)), 6) as yaw_rmse, round(max(abs(d)), 6) as yaw_max from w group by seq")
def yaw_error(spark: SparkSession, sf: str) -> DataFrame:
    """Root mean square and greatest of a wrapped angle's error."""
    import math

    d = geo.wrap(F.col("k") / 50.0 * math.pi - F.col("v") / 250.0 * math.pi)
    e = events(spark, sf).withColumn("d", d)
    return e.groupBy("seq").agg(r6(F.sqrt(F.avg(F.col("d") * F.col("d")))).alias("yaw_rmse"), r6(F.max(F.abs("d"))).alias("yaw_max"))


@query("""with d as (select *, (lat - lag(lat) over w) * 111320.0 as dn, (lon - lag(lon) over w) * 111320.0 * cos(radians(52.4)) as de from ev window w as (partition by seq order by sample_idx)),
c as (select *, case when sqrt(dn * dn + de * de) >= 300 then atan2(de, dn) end as course from d)
select event_id, round(coalesce(last_value(course ignore nulls) over (partition by seq order by sample_idx rows between unbounded preceding and current row), 0.0), 6) as course from c""")
def course_hold(spark: SparkSession, sf: str) -> DataFrame:
    """Course over ground, held while the step is too short to have one."""
    import math

    dn = (F.col("lat") - F.lag("lat").over(by_seq())) * 111320.0
    de = (F.col("lon") - F.lag("lon").over(by_seq())) * 111320.0 * math.cos(math.radians(52.4))
    e = events(spark, sf).withColumn("dn", dn).withColumn("de", de)
    e = e.withColumn("course", F.when(F.sqrt(F.col("dn") * F.col("dn") + F.col("de") * F.col("de")) >= 300, F.atan2("de", "dn")))
    held = F.last("course", ignorenulls=True).over(by_seq().rowsBetween(Window.unboundedPreceding, 0))
    return e.select("event_id", r6(F.coalesce(held, F.lit(0.0))).alias("course"))


@query("""with f as (select distinct fix_id, sequence, time_since_start_ms / 1000 as t from gnss_fixes where time_since_start_ms is not null and gps_lat is not null),
g as (select *, t - lag(t) over (partition by sequence order by t, fix_id) as gap from f)
select sequence, count(*) as n_fixes, round(max(t) - min(t), 6) as span_s, round(median(gap), 6) as median_gap_s, round(max(gap), 6) as max_gap_s, coalesce(median(gap) <= 1.5, false) as meets_1hz from g group by sequence""")
def cadence(spark: SparkSession, sf: str) -> DataFrame:
    """Fix count, span, median and greatest gap, and whether the cadence is 1 Hz."""
    f = table(spark, sf, "gnss_fixes").where("time_since_start_ms is not null and gps_lat is not null").select("fix_id", "sequence", (F.col("time_since_start_ms") / 1000).alias("t")).distinct()
    f = previous(f, ["sequence"], ["t", "fix_id"], F.floor(F.col("t") / 3600), F.col("t"), "p").withColumn("gap", F.col("t") - F.col("p"))
    m = F.median("gap")
    return f.groupBy("sequence").agg(
        F.count(F.lit(1)).alias("n_fixes"), r6(F.max("t") - F.min("t")).alias("span_s"), r6(m).alias("median_gap_s"), r6(F.max("gap")).alias("max_gap_s"), F.coalesce(m <= 1.5, F.lit(False)).alias("meets_1hz")
    )


@query("""with f as (select distinct fix_id, sequence, time_since_start_ms / 1000 as t from gnss_fixes where time_since_start_ms is not null and gps_lat is not null),
g as (select *, t - lag(t) over (partition by sequence order by t, fix_id) as gap from f), c as (select sequence, median(gap) as m, max(gap) as x from g group by sequence)
select count(*) as n_sequences, round(median(m), 6) as median_of_medians, round(max(x), 6) as worst_gap_s, count(*) filter (where m <= 1.5) as n_meet from c""")
def cadence_rollup(spark: SparkSession, sf: str) -> DataFrame:
    """The cadences of all recordings in one row."""
    return cadence(spark, sf).agg(F.count(F.lit(1)).alias("n_sequences"), r6(F.median("median_gap_s")).alias("median_of_medians"), F.max("max_gap_s").alias("worst_gap_s"), F.count_if("meets_1hz").alias("n_meet"))


_CAL = "m as (select kind as mk, avg(v) as mu, stddev_samp(v) * (1 + 0.1 * length(kind)) as sg from ev group by kind), c as (select ev.event_id, ev.kind, ev.v - m.mu as err, m.sg as sg from ev join m on ev.kind = m.mk)"


def _calibrated(spark: SparkSession, sf: str) -> DataFrame:
    e = events(spark, sf)
    m = e.groupBy("kind").agg(F.avg("v").alias("mu"), (F.stddev_samp("v") * (1 + 0.1 * F.length("kind"))).alias("sg"))
    return e.join(m, "kind").select("event_id", "kind", (F.col("v") - F.col("mu")).alias("err"), "sg")


@query(f"""with {_CAL} select coalesce(kind, 'all') as kind, count(*) as n, round(avg(cast(abs(err) <= sg as double)), 6) as within_1, round(avg(cast(abs(err) <= 2 * sg as double)), 6) as within_2, round(avg(cast(abs(err) <= 3 * sg as double)), 6) as within_3,
round(sqrt(avg(err * err)), 6) as rmse, round(avg(abs(err)), 6) as mae, round(avg(sg), 6) as mean_sigma from c group by rollup (kind)""")
def calibration(spark: SparkSession, sf: str) -> DataFrame:
    """Coverage at one, two and three sigma, by stem and over all."""
    within = lambda k: r6(F.avg((F.abs("err") <= k * F.col("sg")).cast("double")))
    g = _calibrated(spark, sf).rollup("kind").agg(
        F.count(F.lit(1)).alias("n"), within(1).alias("within_1"), within(2).alias("within_2"), within(3).alias("within_3"),
        r6(F.sqrt(F.avg(F.col("err") * F.col("err")))).alias("rmse"), r6(F.avg(F.abs("err"))).alias("mae"), r6(F.avg("sg")).alias("mean_sigma"),
    )
    return g.withColumn("kind", F.coalesce("kind", F.lit("all")))


@query("with b as (select v, ntile(10) over (order by v, event_id) as bin from ev) select cast(bin as bigint) as bin, count(*) as n, round(min(v), 6) as low, round(max(v), 6) as high, round(avg(v), 6) as mean from b group by bin")
def reliability_bins(spark: SparkSession, sf: str) -> DataFrame:
    """Ten bins of equal count in one total order, ranked in two levels."""
    rows = ranked(events(spark, sf).select("v", "event_id"), F.floor(F.col("v") / 4), [F.col("v"), F.col("event_id")], "place")
    b = rows.withColumn("bin", tile(F.col("place"), F.col("_all"), 10))
    return b.groupBy("bin").agg(F.count(F.lit(1)).alias("n"), r6(F.min("v")).alias("low"), r6(F.max("v")).alias("high"), r6(F.avg("v")).alias("mean"))


@query(f"with {_CAL} select kind, round(avg(0.5 * (ln(sg * sg) + err * err / (sg * sg))), 6) as nll from c group by kind")
def gaussian_nll(spark: SparkSession, sf: str) -> DataFrame:
    """The mean Gaussian negative log likelihood."""
    var = F.col("sg") * F.col("sg")
    return _calibrated(spark, sf).groupBy("kind").agg(r6(F.avg(0.5 * (F.log(var) + F.col("err") * F.col("err") / var))).alias("nll"))


@query("""with f as (select min(v) as lo, max(v) as hi, min(k) as klo, max(k) as khi from ev where seq % 5 <> 0)
select event_id, round((v - lo) / case when hi = lo then 1 else hi - lo end, 6) as v01, round((k - klo) / cast(case when khi = klo then 1 else khi - klo end as double), 6) as k01 from ev, f""")
def minmax_scale(spark: SparkSession, sf: str) -> DataFrame:
    """A scaler fitted on the training records and applied to all; a column without span is divided by 1."""
    e = events(spark, sf)
    fit = e.where("seq % 5 <> 0").agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.min("k").alias("klo"), F.max("k").alias("khi"))
    e = e.withColumn("f", fit.select(F.struct("*")).scalar())
    f = lambda c: F.col("f")[c]
    span = lambda lo, hi: F.when(f(hi) == f(lo), 1.0).otherwise(f(hi) - f(lo))
    return e.select("event_id", r6((F.col("v") - f("lo")) / span("lo", "hi")).alias("v01"), r6((F.col("k") - f("klo")) / span("klo", "khi")).alias("k01"))


@query("""with e as (select seq, sample_idx, (us % 86400000000) / 1e6 - t_s as off, case when t_s <= lag(t_s) over (partition by seq order by sample_idx) then sample_idx end as stop from ev),
p as (select seq, min(stop) as stop from e group by seq) select e.seq, round(median(off), 6) as offset_s, count(*) as n from e join p using (seq) where p.stop is null or e.sample_idx < p.stop group by e.seq""")
def clock_offset(spark: SparkSession, sf: str) -> DataFrame:
    """The median offset of two clocks over the prefix in which time goes on."""
    e = events(spark, sf).withColumn("off", (F.col("us") % 86_400_000_000) / 1e6 - F.col("t_s"))
    e = e.withColumn("stop", F.when(F.col("t_s") <= F.lag("t_s").over(by_seq()), F.col("sample_idx")))
    e = e.withColumn("stop", F.min("stop").over(Window.partitionBy("seq")))
    return e.where("stop is null or sample_idx < stop").groupBy("seq").agg(r6(F.median("off")).alias("offset_s"), F.count(F.lit(1)).alias("n"))


_FAM = r"regexp_replace(regexp_replace(lower(trim(name)), '^[sv][-_]', ''), '\.csv$', '')"


@query(f"""with s as (select distinct window_id, {_FAM} as stem from stem_windows), f as (select regexp_replace(stem, '^(.+)[a-z]$', '\\1') as family, count(*) as n from s group by 1),
r as (select *, sum(n) over (order by n, family) - n as before, sum(n) over () as total from f) select family, n, before < 0.15 * total as held from r""")
def validation_families(spark: SparkSession, sf: str) -> DataFrame:
    """Families held out, smallest first, until 15 % of the windows are; the order's running sum is taken in two levels."""
    stem = F.regexp_replace(F.regexp_replace(F.lower(F.trim("name")), "^[sv][-_]", ""), r"\.csv$", "")
    s = table(spark, sf, "stem_windows").select("window_id", stem.alias("stem")).distinct()
    f = s.groupBy(F.regexp_replace("stem", r"^(.+)[a-z]$", "$1").alias("family")).agg(F.count(F.lit(1)).alias("n"))
    sums = f.groupBy("n").agg(F.sum("n").alias("w"))  # one row a size
    sums = sums.select("n", (F.sum("w").over(Window.orderBy("n")) - F.col("w")).alias("base"), F.sum("w").over(Window.partitionBy()).alias("total"))
    inside = Window.partitionBy("n").orderBy("family").rowsBetween(Window.unboundedPreceding, -1)
    f = f.join(sums, "n").withColumn("before", F.col("base") + F.coalesce(F.sum("n").over(inside), F.lit(0)))
    return f.select("family", "n", (F.col("before") < 0.15 * F.col("total")).alias("held"))


@query("select seq_id, name, case when lower(trim(split)) in ('train', 'val', 'test') then lower(trim(split)) else 'unassigned' end as split from (select distinct seq_id, name, split from sequences)")
def split_of(spark: SparkSession, sf: str) -> DataFrame:
    """Each recording's split as listed, or unassigned."""
    s = F.lower(F.trim("split"))
    return table(spark, sf, "sequences").select("seq_id", "name", F.when(s.isin("train", "val", "test"), s).otherwise("unassigned").alias("split")).distinct()


@query("""with s as (select distinct regexp_replace(regexp_replace(regexp_replace(lower(trim(name)), '^[sv][-_]', ''), '\\.csv$', ''), '^(.+)[a-z]$', '\\1') as family, lower(trim(split)) as split from sequences)
select family from s where split = 'train' intersect select family from s where split = 'test'""")
def straddling_families(spark: SparkSession, sf: str) -> DataFrame:
    """Families with recordings in train and in test."""
    stem = F.regexp_replace(F.regexp_replace(F.lower(F.trim("name")), "^[sv][-_]", ""), r"\.csv$", "")
    s = table(spark, sf, "sequences").select(F.regexp_replace(stem, r"^(.+)[a-z]$", "$1").alias("family"), F.lower(F.trim("split")).alias("split"))
    return s.where("split = 'train'").select("family").intersect(s.where("split = 'test'").select("family"))
