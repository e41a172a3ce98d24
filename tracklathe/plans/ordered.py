"""Ordering, clocks, as-of and interval joins over the event stream and the recordings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracklathe.operators.blocked import previous
from tracklathe.operators.outages import sweep
from tracklathe.operators.temporal import asof_join, unwrapped
from tracklathe.plans.base import LENGTHS, WARMUP, events, r6, registry
from tracklathe.session import table

QUERIES, SQL, query = registry()
_FIX, _EPOCH = "kind in ('view', 'click')", "kind = 'purchase'"


def by_seq():
    return Window.partitionBy("seq").orderBy("sample_idx")


def block(index: str, rows: int = 4096):
    """The block of a sample index, for operators that split a recording."""
    return F.floor(F.col(index) / rows)


def is_fix():
    return F.col("kind").isin("view", "click")


def is_epoch():
    return F.col("kind") == "purchase"


@query("select event_id, seq, sample_idx from ev")
def sample_index(spark: SparkSession, sf: str) -> DataFrame:
    return events(spark, sf).select("event_id", "seq", "sample_idx")


@query("""with f as (select distinct fix_id, sequence, sample_idx, gps_lat, gps_lon from gnss_fixes where gps_lat is not null and gps_lon is not null),
p as (select *, lag(gps_lat) over w as la, lag(gps_lon) over w as lo from f window w as (partition by sequence order by sample_idx, fix_id))
select fix_id, sequence, sample_idx from p where la is null or gps_lat <> la or gps_lon <> lo""")
def distinct_fixes(spark: SparkSession, sf: str) -> DataFrame:
    """Fixes whose position changed against the previous positioned one; the first is kept."""
    f = table(spark, sf, "gnss_fixes").where("gps_lat is not null and gps_lon is not null").select("fix_id", "sequence", "sample_idx", "gps_lat", "gps_lon").distinct()
    f = previous(f, ["sequence"], ["sample_idx", "fix_id"], block("sample_idx"), F.struct("gps_lat", "gps_lon"), "p")
    return f.where("p is null or gps_lat <> p.gps_lat or gps_lon <> p.gps_lon").select("fix_id", "sequence", "sample_idx")


@query("""with r as (select distinct truth_id, sequence, t_s from vehicle_track where t_s is not null),
d as (select sequence, t_s - lag(t_s) over (partition by sequence order by t_s, truth_id) as dt from r)
select sequence, count(*) as n, round(min(dt), 6) as min_dt, round(max(abs(dt - 0.1)), 6) as max_off, coalesce(min(dt) > 0 and max(abs(dt - 0.1)) <= 0.05, false) as uniform from d group by sequence""")
def dt_grid_check(spark: SparkSession, sf: str) -> DataFrame:
    """Whether each track lies on a 10 Hz grid."""
    d = table(spark, sf, "vehicle_track").where("t_s is not null").select("truth_id", "sequence", "t_s").distinct()
    d = previous(d, ["sequence"], ["t_s", "truth_id"], F.floor(F.col("t_s") / 600), F.col("t_s"), "p").withColumn("dt", F.col("t_s") - F.col("p"))
    off = F.max(F.abs(F.col("dt") - 0.1))
    return d.groupBy("sequence").agg(F.count(F.lit(1)).alias("n"), r6(F.min("dt")).alias("min_dt"), r6(off).alias("max_off"), F.coalesce((F.min("dt") > 0) & (off <= 0.05), F.lit(False)).alias("uniform"))


@query("""with d as (select event_id, seq, sample_idx, (us % 86400000000) / 1e6 as tod from ev),
j as (select *, case when tod - lag(tod) over (partition by seq order by sample_idx) < -43200 then 1 else 0 end as up from d)
select event_id, round(tod + 86400.0 * sum(up) over (partition by seq order by sample_idx rows unbounded preceding), 6) as tod from j""")
def midnight_unwrap(spark: SparkSession, sf: str) -> DataFrame:
    """Seconds of the day made to go on over midnight."""
    d = events(spark, sf).withColumn("tod", (F.col("us") % 86_400_000_000) / 1e6)
    return d.select("event_id", r6(unwrapped(F.col("tod"), by_seq())).alias("tod"))


@query("""with f as (select distinct fix_id, sequence, sample_idx, time_since_start_ms as t from gnss_fixes where time_since_start_ms is not null),
d as (select *, lag(t) over (partition by sequence order by sample_idx, fix_id) as p from f) select fix_id from d where p is null or t > p""")
def monotonic_keep(spark: SparkSession, sf: str) -> DataFrame:
    """Fixes later than their immediate predecessor."""
    f = table(spark, sf, "gnss_fixes").where("time_since_start_ms is not null").select("fix_id", "sequence", "sample_idx", "time_since_start_ms").distinct()
    f = previous(f, ["sequence"], ["sample_idx", "fix_id"], block("sample_idx"), F.col("time_since_start_ms"), "p")
    return f.where("p is null or time_since_start_ms > p").select("fix_id")


@query("""with s as (select distinct sequence, sample_idx, time_since_start_ms as t from imu_samples where sequence is not null and time_since_start_ms is not null),
r as (select *, row_number() over (partition by sequence order by sample_idx) - 1 as i, t - lag(t) over (partition by sequence order by sample_idx) as dt from s)
select sequence, cast(coalesce(min(i) filter (where dt <= 0), count(*)) as bigint) as n_prefix, count(*) as n from r group by sequence""")
def monotonic_prefix(spark: SparkSession, sf: str) -> DataFrame:
    """The number of readings before a recording's clock first stands or goes back."""
    w = Window.partitionBy("sequence").orderBy("sample_idx")
    s = table(spark, sf, "imu_samples").where("sequence is not null and time_since_start_ms is not null").select("sequence", "sample_idx", F.col("time_since_start_ms").alias("t")).distinct()
    s = s.select("sequence", (F.row_number().over(w) - 1).cast("bigint").alias("i"), (F.col("t") - F.lag("t").over(w)).alias("dt"))
    return s.groupBy("sequence").agg(F.coalesce(F.min(F.when(F.col("dt") <= 0, F.col("i"))), F.count(F.lit(1))).alias("n_prefix"), F.count(F.lit(1)).alias("n"))


@query(f"""with e as (select event_id, seq, t_s from ev where {_EPOCH}), f as (select seq, t_s, v, event_id as fid from ev where {_FIX})
select e.event_id, f.v as held_v, f.fid as fix_id from e asof left join f on e.seq = f.seq and e.t_s >= f.t_s""")
def asof_backward(spark: SparkSession, sf: str) -> DataFrame:
    """Zero-order hold: the last fix at or before each epoch."""
    e = events(spark, sf)
    out = asof_join(e.where(is_epoch()).select("event_id", "seq", "t_s"), e.where(is_fix()).select("seq", "t_s", "v", F.col("event_id").alias("fid")), ["seq"], "t_s", "fid", width=2_000_000.0)
    return out.select("event_id", F.col("r_v").alias("held_v"), F.col("r_fid").alias("fix_id"))


_NEAR = f"""with e as (select event_id, seq, t_s from ev where {_EPOCH}), f as (select seq, t_s, v, event_id as fid from ev where {_FIX}),
b as (select e.event_id, e.t_s, f.t_s as bt, f.v as bv from e asof left join f on e.seq = f.seq and e.t_s >= f.t_s),
a as (select e.event_id, f.t_s as xt, f.v as av from e asof left join f on e.seq = f.seq and e.t_s <= f.t_s),
n as (select event_id, case when bt is null then xt when xt is null then bt when t_s - bt <= xt - t_s then bt else xt end as nt,
  case when bt is null then av when xt is null then bv when t_s - bt <= xt - t_s then bv else av end as v, t_s from b join a using (event_id))"""


@query(_NEAR + " select event_id, v as near_v, round(abs(nt - t_s), 6) as off_s from n")
def asof_nearest(spark: SparkSession, sf: str) -> DataFrame:
    """The fix nearest to each epoch, the earlier of two equally near."""
    return _nearest(spark, sf, None)


@query(_NEAR + " select event_id, case when abs(nt - t_s) <= 20000 then v end as near_v, case when abs(nt - t_s) <= 20000 then round(abs(nt - t_s), 6) end as off_s from n")
def asof_nearest_tol(spark: SparkSession, sf: str) -> DataFrame:
    """The nearest fix within a tolerance; epochs without one stay, with nulls, for the dead letters."""
    return _nearest(spark, sf, 20_000.0)


def _nearest(spark: SparkSession, sf: str, tolerance: float | None) -> DataFrame:
    e = events(spark, sf)
    out = asof_join(e.where(is_epoch()).select("event_id", "seq", "t_s"), e.where(is_fix()).select("seq", "t_s", "v", F.col("event_id").alias("fid")), ["seq"], "t_s", "fid", "nearest", tolerance, 2_000_000.0)
    return out.select("event_id", F.col("r_v").alias("near_v"), r6(F.abs(F.col("r_t_s") - F.col("t_s"))).alias("off_s"))


@query(_NEAR + " select case when nt is null then 'no_fix' when abs(nt - t_s) > 20000 then 'truth_gap' else 'paired' end as outcome, count(*) as n from n group by 1")
def truth_gap_letters(spark: SparkSession, sf: str) -> DataFrame:
    """Epochs by outcome of the pairing: the domain of the dead letters."""
    off = F.col("off_s")
    return _nearest(spark, sf, None).groupBy(F.when(off.isNull(), "no_fix").when(off > 20_000, "truth_gap").otherwise("paired").alias("outcome")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""with f as (select *, sum(case when {_FIX} then 1 else 0 end) over (partition by seq order by sample_idx rows unbounded preceding) as g from ev),
x as (select seq, g, min(t_s) as t0, min(v) filter (where {_FIX}) as v0 from f where g > 0 group by seq, g),
y as (select *, lead(t0) over (partition by seq order by g) as t1, lead(v0) over (partition by seq order by g) as v1 from x)
select f.event_id, round((y.v1 - y.v0) / (y.t1 - y.t0), 9) as slope from f join y on f.seq = y.seq and f.g = y.g where y.t1 > y.t0""")
def interval_hold(spark: SparkSession, sf: str) -> DataFrame:
    """The rate of change over each fix interval, held on the samples of the interval."""
    f = events(spark, sf).withColumn("g", F.sum(is_fix().cast("int")).over(by_seq())).where("g > 0")
    x = f.groupBy("seq", "g").agg(F.min("t_s").alias("t0"), F.min(F.when(is_fix(), F.col("v"))).alias("v0"))
    w = Window.partitionBy("seq").orderBy("g")
    y = x.withColumn("t1", F.lead("t0").over(w)).withColumn("v1", F.lead("v0").over(w)).where("t1 > t0")
    return f.join(y, ["seq", "g"]).select("event_id", F.round((F.col("v1") - F.col("v0")) / (F.col("t1") - F.col("t0")), 9).alias("slope"))


@query(f"""with f as (select *, sum(case when {_FIX} then 1 else 0 end) over (partition by seq order by sample_idx rows unbounded preceding) as g from ev)
select seq, cast(g as bigint) as fix_no, round(avg(v), 6) as mean_v, count(*) as n from f where g > 0 group by seq, g""")
def interval_mean(spark: SparkSession, sf: str) -> DataFrame:
    """The mean over the samples from each fix up to the next."""
    f = events(spark, sf).withColumn("g", F.sum(is_fix().cast("int")).over(by_seq())).where("g > 0")
    return f.groupBy("seq", F.col("g").cast("bigint").alias("fix_no")).agg(r6(F.avg("v")).alias("mean_v"), F.count(F.lit(1)).alias("n"))


@query(f"""with n as (select seq, count(*) as n from ev group by seq), w as (select seq, unnest(range({WARMUP}, n - 20 + 1, 20)) as s from n where n >= {WARMUP} + 20)
select event_id from ev where not exists (select 1 from w where w.seq = ev.seq and ev.sample_idx >= w.s and ev.sample_idx < w.s + 20)""")
def gnss_mask(spark: SparkSession, sf: str) -> DataFrame:
    """Samples outside every outage; the containing window is found by arithmetic, so the anti join is an equi join."""
    e = events(spark, sf)
    w = sweep(e.groupBy("seq").agg(F.count(F.lit(1)).alias("n")), [20], WARMUP).select("seq", F.col("start_idx").alias("s"))
    at = F.floor((F.col("sample_idx") - WARMUP) / 20) * 20 + WARMUP
    return e.withColumn("s", at).join(w, ["seq", "s"], "left_anti").select("event_id")


@query("""with r as (select distinct raw_id, sequence, stream, event_ns // 10000000 as slot from raw_imu where v0 is not null and v1 is not null and v2 is not null),
a as (select sequence, slot, min(raw_id) as id from r where stream = 'accelerometer_uncalibrated' group by all), g as (select sequence, slot, min(raw_id) as id from r where stream = 'gyroscope_uncalibrated' group by all),
n as (select sequence, count(*) as n from (select sequence from a union all select sequence from g) group by sequence), p as (select a.sequence, count(*) as p from a join g using (sequence, slot) group by 1)
select n.sequence, coalesce(p, 0) as n_paired, n - 2 * coalesce(p, 0) as n_unpaired from n left join p using (sequence)""")
def equi_pair_unpaired(spark: SparkSession, sf: str) -> DataFrame:
    """Readings of two streams paired on one integer stamp, and the number left over."""
    r = table(spark, sf, "raw_imu").where("v0 is not null and v1 is not null and v2 is not null").select("raw_id", "sequence", "stream", F.expr("event_ns div 10000000").alias("slot"))
    side = lambda s: r.where(F.col("stream") == s).groupBy("sequence", "slot").agg(F.min("raw_id").alias("id"))
    a, g = side("accelerometer_uncalibrated"), side("gyroscope_uncalibrated")
    n = a.select("sequence").unionAll(g.select("sequence")).groupBy("sequence").agg(F.count(F.lit(1)).alias("n"))
    p = a.join(g.drop("id"), ["sequence", "slot"]).groupBy("sequence").agg(F.count(F.lit(1)).alias("p"))
    p0 = F.coalesce("p", F.lit(0).cast("bigint"))
    return n.join(p, "sequence", "left").select("sequence", p0.alias("n_paired"), (F.col("n") - 2 * p0).alias("n_unpaired"))


_STEM = "regexp_replace(regexp_replace(lower(trim(filename)), '^[sv]-', ''), '\\.csv$', '')"


@query(f"select distinct {_STEM} as stem from tree_categorised where stream = 'S-' and {_STEM} in (select {_STEM} from tree_categorised where stream = 'V-')")
def paired_stems(spark: SparkSession, sf: str) -> DataFrame:
    """Stems with both a phone and a vehicle file."""
    stem = F.regexp_replace(F.regexp_replace(F.lower(F.trim("filename")), "^[sv]-", ""), r"\.csv$", "")
    t = table(spark, sf, "tree_categorised").select("stream", stem.alias("stem"))
    return t.where("stream = 'S-'").join(t.where("stream = 'V-'"), "stem", "left_semi").select("stem").distinct()


@query("select distinct stream, lower(trim(filename)) as file_key from tree_categorised where (stream, lower(trim(filename))) not in (select stream, lower(trim(filename)) from tree_uncategorised)")
def missing_anti(spark: SparkSession, sf: str) -> DataFrame:
    """Files of one copy that the other lacks, all at once."""
    key = lambda t: table(spark, sf, t).select("stream", F.lower(F.trim("filename")).alias("file_key")).distinct()
    return key("tree_categorised").join(key("tree_uncategorised"), ["stream", "file_key"], "left_anti")


@query("""with u as (select stream, lower(trim(filename)) as file_key, 0 as un, lower(trim(sha256)) as sha, listed_at from tree_categorised union all select stream, lower(trim(filename)), 1, lower(trim(sha256)), listed_at from tree_uncategorised),
c as (select stream, file_key, arg_max(sha, listed_at) filter (where un = 0) as categorised_sha, arg_max(sha, listed_at) filter (where un = 1) as uncategorised_sha from u group by 1, 2)
select * from c where categorised_sha <> uncategorised_sha""")
def divergent_copies(spark: SparkSession, sf: str) -> DataFrame:
    """Files whose two copies have different checksums."""
    side = lambda t, n: table(spark, sf, t).select("stream", F.lower(F.trim("filename")).alias("file_key"), F.lower(F.trim("sha256")).alias("sha"), "listed_at", F.lit(n).alias("un"))
    latest = lambda n: F.max_by(F.when(F.col("un") == n, F.col("sha")), F.when(F.col("un") == n, F.col("listed_at")))
    c = side("tree_categorised", 0).unionByName(side("tree_uncategorised", 1)).groupBy("stream", "file_key").agg(latest(0).alias("categorised_sha"), latest(1).alias("uncategorised_sha"))
    return c.where("categorised_sha <> uncategorised_sha")


@query(f"""with l as (select unnest(range(-10, 11)) * 1000.0 as lag_s), e as (select seq, l.lag_s, event_id, v, t_s + l.lag_s as t from ev, l where {_EPOCH}), f as (select seq, t_s, v from ev where {_FIX}),
b as (select e.event_id, e.lag_s, e.t, e.v, f.t_s as bt, f.v as bv from e asof left join f on e.seq = f.seq and e.t >= f.t_s),
a as (select e.event_id, e.lag_s, f.t_s as xt, f.v as av from e asof left join f on e.seq = f.seq and e.t <= f.t_s),
r as (select lag_s, abs(v - case when bt is null then av when xt is null then bv when t - bt <= xt - t then bv else av end) as d from b join a using (event_id, lag_s))
select cast(lag_s as double) as lag_s, round(median(d), 6) as median_off from r group by lag_s""")
def lag_search(spark: SparkSession, sf: str) -> DataFrame:
    """The median residual against the nearest fix for each lag of a fixed grid."""
    e = events(spark, sf)
    lags = F.explode(F.array(*[F.lit(1000.0 * i) for i in range(-10, 11)]))
    left = e.where(is_epoch()).select("seq", "event_id", "v", "t_s", lags.alias("lag_s")).withColumn("t", F.col("t_s") + F.col("lag_s")).drop("t_s")
    out = asof_join(left, e.where(is_fix()).select("seq", F.col("t_s").alias("t"), "v", F.col("event_id").alias("fid")), ["seq"], "t", "fid", "nearest", None, 2_000_000.0)
    return out.groupBy("lag_s").agg(r6(F.median(F.abs(F.col("v") - F.col("r_v")))).alias("median_off"))


@query("select seq, min_by(event_id, (t_s, event_id)) as first_id, round(min_by(v, (t_s, event_id)), 6) as first_v, max_by(event_id, (t_s, event_id)) as last_id from ev group by seq".replace("min_by", "arg_min").replace("max_by", "arg_max"))
def first_and_latest(spark: SparkSession, sf: str) -> DataFrame:
    """Each recording's first sample and its latest one."""
    at = F.struct("t_s", "event_id")
    return events(spark, sf).groupBy("seq").agg(F.min_by("event_id", at).alias("first_id"), r6(F.min_by("v", at)).alias("first_v"), F.max_by("event_id", at).alias("last_id"))


@query("select seq, kind, arg_max(v, (us, event_id)) as latest_v from ev group by seq, kind")
def latest_per_channel(spark: SparkSession, sf: str) -> DataFrame:
    """The latest value of each channel of a recording."""
    return events(spark, sf).groupBy("seq", "kind").agg(F.max_by("v", F.struct("us", "event_id")).alias("latest_v"))


@query("""with r as (select *, row_number() over (partition by sequence, event_ns order by arrival_ns, raw_id) as k from (select distinct raw_id, sequence, stream, event_ns, arrival_ns from raw_imu where stream = 'magnetometer'))
select raw_id, sequence, event_ns from r where k = 1""")
def first_of_stamp(spark: SparkSession, sf: str) -> DataFrame:
    """One row a stamp, the one that arrived first."""
    r = table(spark, sf, "raw_imu").where("stream = 'magnetometer'").select("raw_id", "sequence", "event_ns", "arrival_ns").distinct()
    w = Window.partitionBy("sequence", "event_ns").orderBy("arrival_ns", "raw_id")
    return r.withColumn("k", F.row_number().over(w)).where("k = 1").select("raw_id", "sequence", "event_ns")


_FLAT = "sqrt(pow((la - lat) * 111320.0, 2) + pow((lo - lon) * 111320.0 * cos(radians((lat + la) / 2)), 2))"
_HAV = "2 * 6371000.0 * asin(sqrt(least(1.0, pow(sin(radians(la - lat) / 2), 2) + cos(radians(lat)) * cos(radians(la)) * pow(sin(radians(lo - lon) / 2), 2))))"


@query(f"""with l as (select unnest(range(-5, 6)) * 2000.0 as lag_s), e as (select seq, l.lag_s, event_id, lat, lon, t_s + l.lag_s as t from ev, l where {_EPOCH}), f as (select seq, t_s, lat, lon from ev where {_FIX}),
b as (select e.event_id, e.seq, e.lag_s, e.t, e.lat, e.lon, f.t_s as bt, f.lat as bla, f.lon as blo from e asof left join f on e.seq = f.seq and e.t >= f.t_s),
a as (select e.event_id, e.lag_s, f.t_s as xt, f.lat as xla, f.lon as xlo from e asof left join f on e.seq = f.seq and e.t <= f.t_s),
n as (select seq, lag_s, lat, lon, case when bt is null then xla when xt is null then bla when t - bt <= xt - t then bla else xla end as la, case when bt is null then xlo when xt is null then blo when t - bt <= xt - t then blo else xlo end as lo from b join a using (event_id, lag_s)),
m as (select seq, lag_s, median({_FLAT}) as m from n group by seq, lag_s), best as (select seq, cast(arg_min(lag_s, (round(m, 6), lag_s)) as double) as best_lag_s from m group by seq),
z as (select seq, count(la) as n_matched, round(median({_HAV}), 4) as median_m, round(quantile_cont({_HAV}, 0.95), 4) as p95_m, round(max({_HAV}), 4) as max_m from n where lag_s = 0 group by seq)
select z.*, best_lag_s, n_matched >= 2 and median_m <= 400 and abs(best_lag_s) <= 4000 as usable from z join best using (seq)""")
def alignment_report(spark: SparkSession, sf: str) -> DataFrame:
    """How each track lies against its fixes: matches, residuals, the best lag, and whether it can be used.

    The grid of lags is searched on a plane; only the reported residuals at no lag are great-circle distances.
    """
    from tracklathe.functions import geo

    e = events(spark, sf)
    lags = F.explode(F.array(*[F.lit(2000.0 * i) for i in range(-5, 6)]))
    left = e.where(is_epoch()).select("seq", "event_id", "lat", "lon", "t_s", lags.alias("lag_s")).withColumn("t", F.col("t_s") + F.col("lag_s")).drop("t_s")
    out = asof_join(left, e.where(is_fix()).select("seq", F.col("t_s").alias("t"), "lat", "lon", F.col("event_id").alias("fid")), ["seq"], "t", "fid", "nearest", None, 2_000_000.0)
    place = (F.col("lat"), F.col("lon"), F.col("r_lat"), F.col("r_lon"))
    far = F.when(F.col("lag_s") == 0, geo.haversine(*place))
    m = out.groupBy("seq", "lag_s").agg(
        F.median(geo.flat(*place)).alias("m"), F.count("r_lat").alias("n"), F.round(F.median(far), 4).alias("median_m"), F.round(F.percentile(far, 0.95), 4).alias("p95_m"), F.round(F.max(far), 4).alias("max_m"),
    )
    at_none = lambda c: F.max(F.when(F.col("lag_s") == 0, F.col(c)))
    r = m.groupBy("seq").agg(at_none("n").alias("n_matched"), at_none("median_m").alias("median_m"), at_none("p95_m").alias("p95_m"), at_none("max_m").alias("max_m"), F.min_by("lag_s", F.struct(F.round("m", 6), "lag_s")).alias("best_lag_s"))
    return r.withColumn("usable", (F.col("n_matched") >= 2) & (F.col("median_m") <= 400) & (F.abs("best_lag_s") <= 4000))
