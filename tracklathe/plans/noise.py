"""Stationary segments, rolling statistics, cluster-time noise, regressions and alignment statistics."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracklathe.operators.temporal import islands
from tracklathe.plans.base import events, r6, registry
from tracklathe.plans.ordered import by_seq
from tracklathe.session import table

QUERIES, SQL, query = registry()

_SEQW = "partition by seq order by sample_idx"


@query(f"""with r as (select seq, sample_idx, count(*) over w as n, avg(v) over w as m, var_pop(v) over w as s from ev window w as ({_SEQW} rows between current row and 9 following))
select seq, sample_idx, round(m, 6) as mean_v, round(s, 4) as var_v from r where n = 10""")
def rolling_var(spark: SparkSession, sf: str) -> DataFrame:
    """Mean and population variance of every full window of ten samples, by its first one."""
    w = by_seq().rowsBetween(0, 9)
    r = events(spark, sf).select("seq", "sample_idx", F.count("*").over(w).alias("n"), F.avg("v").over(w).alias("m"), F.var_pop("v").over(w).alias("s"))
    return r.where("n = 10").select("seq", "sample_idx", r6("m").alias("mean_v"), F.round("s", 4).alias("var_v"))


@query(f"""with f as (select seq, sample_idx, v < 60 as h, coalesce(lag(v < 60) over ({_SEQW}), false) as p from ev), r as (select *, sum(case when h and not p then 1 else 0 end) over ({_SEQW}) as g from f)
select seq, min(sample_idx) as start, max(sample_idx) + 1 as stop, count(*) as n from r where h group by seq, g""")
def runs_of_true(spark: SparkSession, sf: str) -> DataFrame:
    """Gaps and islands: the half-open runs of samples below a level."""
    return islands(events(spark, sf), ["seq"], "sample_idx", F.col("v") < 60)


_STILL = f"""with r as (select seq, sample_idx, t_s, count(*) over w as n, stddev_pop(v) over w as s from ev window w as ({_SEQW} rows between current row and 3 following)),
f as (select *, (n = 4 and s < 40) as h, coalesce(lag(n = 4 and s < 40) over ({_SEQW}), false) as p from r), g as (select *, sum(case when h and not p then 1 else 0 end) over ({_SEQW}) as g from f),
i as (select seq, min(sample_idx) as a, max(sample_idx) + 4 as b, count(*) as k from g where h group by seq, g),
e as (select ev.seq, i.a, i.b, ev.sample_idx, ev.t_s, ev.v, ev.t_s - lag(ev.t_s) over (partition by ev.seq, i.a order by ev.sample_idx) as dt from i join ev on ev.seq = i.seq and ev.sample_idx >= i.a and ev.sample_idx < i.b)"""


@query(_STILL + """ select seq, a as start_idx, b as stop_idx, count(*) as n_samples, round(max(t_s) - min(t_s), 6) as duration_s, round(max(dt), 6) as max_gap_s, round(avg(cast(dt <= 0 as double)), 6) as duplicate_dt_fraction,
round(var_pop(v), 4) as var_mean, round(avg(v), 6) as norm_mean from e group by seq, a, b having count(*) >= 5""")
def stationary_segments(spark: SparkSession, sf: str) -> DataFrame:
    """Islands of quiet windows, widened to the samples of their windows, with duration, gap and duplicate figures."""
    w = by_seq().rowsBetween(0, 3)
    e = events(spark, sf)
    r = e.withColumn("h", (F.count("*").over(w) == 4) & (F.stddev_pop("v").over(w) < 40))
    i = islands(r, ["seq"], "sample_idx", F.col("h")).select("seq", F.col("start").alias("a"), (F.col("stop") + 3).alias("b"))
    spelt = i.withColumn("sample_idx", F.explode(F.sequence(F.col("a"), F.col("b") - 1)))
    x = spelt.join(e.select("seq", "sample_idx", "t_s", "v"), ["seq", "sample_idx"])
    x = x.withColumn("dt", F.col("t_s") - F.lag("t_s").over(Window.partitionBy("seq", "a").orderBy("sample_idx")))
    g = x.groupBy("seq", F.col("a").alias("start_idx"), F.col("b").alias("stop_idx")).agg(
        F.count(F.lit(1)).alias("n_samples"), r6(F.max("t_s") - F.min("t_s")).alias("duration_s"), r6(F.max("dt")).alias("max_gap_s"), r6(F.avg((F.col("dt") <= 0).cast("double"))).alias("duplicate_dt_fraction"),
        F.round(F.var_pop("v"), 4).alias("var_mean"), r6(F.avg("v")).alias("norm_mean"),
    )
    return g.where("n_samples >= 5")


@query(f"select event_id, round(avg(v) over ({_SEQW} rows between 4 preceding and 4 following), 6) as smooth from ev")
def centred_mean(spark: SparkSession, sf: str) -> DataFrame:
    """A centred moving average over nine samples that shrinks at the edges."""
    return events(spark, sf).select("event_id", r6(F.avg("v").over(by_seq().rowsBetween(-4, 4))).alias("smooth"))


@query(f"with r as (select seq, v - avg(v) over ({_SEQW} rows between 2 preceding and 2 following) as d from ev) select seq, round(sqrt(var_pop(d) / 0.8), 6) as white_level from r group by seq")
def white_level(spark: SparkSession, sf: str) -> DataFrame:
    """The white noise level: the residual from a five-sample centred mean, put right for the mean's own share."""
    d = F.col("v") - F.avg("v").over(by_seq().rowsBetween(-2, 2))
    return events(spark, sf).select("seq", d.alias("d")).groupBy("seq").agg(r6(F.sqrt(F.var_pop("d") / 0.8)).alias("white_level"))


@query(f"""with w as (select seq, greatest(7.5, max(abs(v))) as level, median(dt) as dt from (select *, t_s - lag(t_s) over ({_SEQW}) as dt from ev) group by seq) select seq, round(level * sqrt(dt), 6) as raised from w""")
def raised_noise(spark: SparkSession, sf: str) -> DataFrame:
    """A noise parameter raised to the measured level, never below its default."""
    e = events(spark, sf).withColumn("dt", F.col("t_s") - F.lag("t_s").over(by_seq()))
    w = e.groupBy("seq").agg(F.greatest(F.lit(7.5), F.max(F.abs("v"))).alias("level"), F.median("dt").alias("dt"))
    return w.select("seq", r6(F.col("level") * F.sqrt("dt")).alias("raised"))


_THETA = f"th as (select seq, 0 as i, 0.0::double as theta from ev group by seq union all select seq, sample_idx + 1, sum(v) over ({_SEQW} rows unbounded preceding) * 0.1 from ev)"


@query(f"""with {_THETA}, m as (select unnest([1, 2, 4, 8])::bigint as m), d as (select a.seq, m.m, c.theta - 2 * b.theta + a.theta as d from th a cross join m join th b on b.seq = a.seq and b.i = a.i + m.m join th c on c.seq = a.seq and c.i = a.i + 2 * m.m)
select seq, cast(m * 0.1 as double) as tau_s, count(*) as n, round(sqrt(sum(d * d) / (2 * pow(m * 0.1, 2) * count(*))), 6) as adev from d group by seq, m""")
def allan_fixed_m(spark: SparkSession, sf: str) -> DataFrame:
    """Overlapping Allan deviation at fixed cluster sizes by second differences of the running integral."""
    return _allan(spark, sf, [1, 2, 4, 8]).select("seq", "tau_s", "n", r6("adev").alias("adev"))


def _theta(spark: SparkSession, sf: str) -> DataFrame:
    e = events(spark, sf)
    run = F.sum("v").over(by_seq().rowsBetween(Window.unboundedPreceding, 0)) * 0.1
    zero = e.select("seq").distinct().select("seq", F.lit(0).cast("bigint").alias("i"), F.lit(0.0).alias("theta"))
    return zero.unionByName(e.select("seq", (F.col("sample_idx") + 1).alias("i"), run.alias("theta")))


def _allan(spark: SparkSession, sf: str, sizes: list[int]) -> DataFrame:
    w = Window.partitionBy("seq").orderBy("i")
    each = F.array(*[F.struct(F.lit(m).alias("m"), (F.lead("theta", 2 * m).over(w) - 2 * F.lead("theta", m).over(w) + F.col("theta")).alias("d")) for m in sizes])
    d = _theta(spark, sf).select("seq", each.alias("all")).select("seq", F.explode("all").alias("x")).select("seq", (F.col("x.m") * 0.1).alias("tau_s"), "x.d").where("d is not null")
    return d.groupBy("seq", "tau_s").agg(F.count(F.lit(1)).alias("n"), F.sqrt(F.sum(F.col("d") * F.col("d")) / (2 * F.first("tau_s") * F.first("tau_s") * F.count(F.lit(1)))).alias("adev"))


_ADEV = f"""with {_THETA}, m as (select unnest([1, 2, 4, 8])::bigint as m), d as (select a.seq, m.m, c.theta - 2 * b.theta + a.theta as d from th a cross join m join th b on b.seq = a.seq and b.i = a.i + m.m join th c on c.seq = a.seq and c.i = a.i + 2 * m.m),
c as (select seq, m * 0.1 as tau, sqrt(sum(d * d) / (2 * pow(m * 0.1, 2) * count(*))) as adev from d group by seq, m)"""


@query(_ADEV + " select seq, round(exp(avg(ln(adev * sqrt(tau)))), 6) as walk, round(regr_slope(ln(adev), ln(tau)), 6) as slope, abs(regr_slope(ln(adev), ln(tau)) + 0.5) <= 0.15 as is_white from c where adev > 0 group by seq")
def rw_coefficient(spark: SparkSession, sf: str) -> DataFrame:
    """The random-walk coefficient as a log mean, the log-log slope, and whether it is white."""
    c = _allan(spark, sf, [1, 2, 4, 8]).where("adev > 0")
    slope = F.regr_slope(F.log("adev"), F.log("tau_s"))
    return c.groupBy("seq").agg(r6(F.exp(F.avg(F.log(F.col("adev") * F.sqrt("tau_s"))))).alias("walk"), r6(slope).alias("slope"), (F.abs(slope + 0.5) <= 0.15).alias("is_white"))


@query(_ADEV + " select seq, round(min(adev) / 0.6643, 6) as instability, cast(round(arg_min(tau, (adev, tau)), 6) as double) as tau_s, arg_min(tau, (adev, tau)) = max(tau) as at_edge from c group by seq")
def bias_instability(spark: SparkSession, sf: str) -> DataFrame:
    """The least deviation over 0.6643 with its cluster time, and whether that is the last one measured."""
    at = F.min_by("tau_s", F.struct("adev", "tau_s"))
    return _allan(spark, sf, [1, 2, 4, 8]).groupBy("seq").agg(r6(F.min("adev") / 0.6643).alias("instability"), r6(at).alias("tau_s"), (at == F.max("tau_s")).alias("at_edge"))


@query(_ADEV + f""", b as (select *, lead(tau) over w as t1, lead(adev) over w as a1 from c window w as (partition by seq order by tau))
select seq, round(exp(ln(adev) + (ln(a1) - ln(adev)) * (ln(0.3) - ln(tau)) / (ln(t1) - ln(tau))), 6) as adev_at from b where tau <= 0.3 and t1 > 0.3""")
def allan_at(spark: SparkSession, sf: str) -> DataFrame:
    """The curve at a cluster time between two measured ones, log-log interpolated."""
    w = Window.partitionBy("seq").orderBy("tau_s")
    b = _allan(spark, sf, [1, 2, 4, 8]).withColumn("t1", F.lead("tau_s").over(w)).withColumn("a1", F.lead("adev").over(w)).where("tau_s <= 0.3 and t1 > 0.3")
    part = (math.log(0.3) - F.log("tau_s")) / (F.log("t1") - F.log("tau_s"))
    return b.select("seq", r6(F.exp(F.log("adev") + (F.log("a1") - F.log("adev")) * part)).alias("adev_at"))


@query("with g as (select unnest(range(0, 31)) as i) select distinct cast(greatest(1, round_even(pow(10, i / 10.0), 0)) as bigint) as m from g where pow(10, i / 10.0) <= 500")
def cluster_sizes(spark: SparkSession, sf: str) -> DataFrame:
    """Log-spaced whole cluster sizes, each once."""
    g = spark.range(0, 31).select(F.pow(F.lit(10.0), F.col("id") / 10).alias("x")).where("x <= 500")
    return g.select(F.greatest(F.lit(1).cast("bigint"), F.rint("x").cast("bigint")).alias("m")).distinct()


_AX = "d as (select seq, v as y, k as a, k * k / 100.0 as b, sample_idx % 7 as c from ev)"


@query(f"""with {_AX}, l as (select seq, y, 'a' as col, a::double as x from d union all select seq, y, 'b', b from d union all select seq, y, 'c', c::double from d)
select seq, col, round(regr_slope(y, x), 6) as slope, round(regr_r2(y, x), 6) as r2, round(corr(y, x), 6) as corr from l group by seq, col""")
def regr_axes(spark: SparkSession, sf: str) -> DataFrame:
    """Slope, explained share and correlation of a target on each candidate column."""
    return _axes(spark, sf).select("seq", "col", r6("slope").alias("slope"), r6("r2").alias("r2"), r6("corr").alias("corr"))


def _axes(spark: SparkSession, sf: str) -> DataFrame:
    e = events(spark, sf)
    cols = {"a": F.col("k").cast("double"), "b": F.col("k") * F.col("k") / 100.0, "c": (F.col("sample_idx") % 7).cast("double")}
    l = e.select("seq", F.col("v").alias("y"), F.explode(F.array(*[F.struct(F.lit(n).alias("col"), x.alias("x")) for n, x in cols.items()])).alias("s")).select("seq", "y", "s.*")
    return l.groupBy("seq", "col").agg(F.regr_slope("y", "x").alias("slope"), F.regr_r2("y", "x").alias("r2"), F.corr("y", "x").alias("corr"))


@query(f"""with {_AX}, l as (select seq, y, 'a' as col, a::double as x from d union all select seq, y, 'b', b from d union all select seq, y, 'c', c::double from d), r as (select seq, col, regr_r2(y, x) as r2 from l group by seq, col),
b as (select seq, arg_max(col, (round(r2, 9), col)) as best from r group by seq) select best, count(*) as votes from b group by best""")
def best_column_votes(spark: SparkSession, sf: str) -> DataFrame:
    """How many recordings name each column as the best."""
    b = _axes(spark, sf).groupBy("seq").agg(F.max_by("col", F.struct(F.round("r2", 9), "col")).alias("best"))
    return b.groupBy("best").agg(F.count(F.lit(1)).alias("votes"))


_AR = f"""with c as (select seq, sample_idx, v - avg(v) over (partition by seq) as x from ev), p as (select *, lag(x) over ({_SEQW}) as b from c),
a as (select seq, count(*) as n, sum(x * b) / sum(x * x) as rho, avg(x) as m, stddev_samp(x + 1) as s from p group by seq)"""


@query(_AR + " select seq, n, round(rho, 6) as rho, round(n * (1 - rho) / (1 + rho), 6) as n_eff from a")
def ar1_neff(spark: SparkSession, sf: str) -> DataFrame:
    """The effective sample size of a first-order autoregression."""
    return _ar(spark, sf).select("seq", "n", r6("rho").alias("rho"), r6(F.col("n") * (1 - F.col("rho")) / (1 + F.col("rho"))).alias("n_eff"))


def _ar(spark: SparkSession, sf: str) -> DataFrame:
    c = events(spark, sf).withColumn("x", F.col("v") - F.avg("v").over(Window.partitionBy("seq")))
    p = c.withColumn("b", F.lag("x").over(by_seq()))
    return p.groupBy("seq").agg(F.count(F.lit(1)).alias("n"), (F.sum(F.col("x") * F.col("b")) / F.sum(F.col("x") * F.col("x"))).alias("rho"), F.avg("v").alias("mean"), F.stddev_samp("v").alias("sd"))


@query(_AR + ", v as (select seq, avg(v) as mean, stddev_samp(v) as sd from ev group by seq) select seq, round(v.mean / (v.sd / sqrt(n * (1 - rho) / (1 + rho))), 5) as t from a join v using (seq)")
def t_stat(spark: SparkSession, sf: str) -> DataFrame:
    """The t statistic of a mean over the effective sample size."""
    n = F.col("n") * (1 - F.col("rho")) / (1 + F.col("rho"))
    return _ar(spark, sf).select("seq", F.round(F.col("mean") / (F.col("sd") / F.sqrt(n)), 5).alias("t"))


@query("""with c as (select seq, count(*) as n, var_samp(v) as vv, var_samp(k) as kk, covar_samp(v, k) as vk from ev group by seq),
e as (select *, (vv + kk) / 2 as m, sqrt(pow((vv - kk) / 2, 2) + vk * vk) as h from c)
select seq, round(0.5 * atan2(2 * vk, vv - kk), 6) as angle, round(m + h, 5) as major, round(m - h, 5) as minor, round(sqrt((m + h) * (m - h) / n) / (2 * h), 6) as std_error from e""")
def covariance_pca(spark: SparkSession, sf: str) -> DataFrame:
    """The principal direction of two columns in closed form, with its standard error."""
    c = events(spark, sf).groupBy("seq").agg(F.count(F.lit(1)).alias("n"), F.var_samp("v").alias("vv"), F.var_samp("k").alias("kk"), F.covar_samp("v", F.col("k").cast("double")).alias("vk"))
    m, h = (F.col("vv") + F.col("kk")) / 2, F.sqrt(F.pow((F.col("vv") - F.col("kk")) / 2, 2) + F.col("vk") * F.col("vk"))
    return c.select("seq", r6(0.5 * F.atan2(2 * F.col("vk"), F.col("vv") - F.col("kk"))).alias("angle"), F.round(m + h, 5).alias("major"), F.round(m - h, 5).alias("minor"), r6(F.sqrt((m + h) * (m - h) / F.col("n")) / (2 * h)).alias("std_error"))


@query(f"with d as (select seq, sample_idx, abs(v - lag(v) over ({_SEQW})) as j from ev) select seq, round(max(j), 6) as max_jump, max(j) > 450 as disturbed from d group by seq")
def mount_disturbance(spark: SparkSession, sf: str) -> DataFrame:
    """Whether any first difference of a recording exceeds a limit."""
    d = events(spark, sf).select("seq", F.abs(F.col("v") - F.lag("v").over(by_seq())).alias("j"))
    return d.groupBy("seq").agg(r6(F.max("j")).alias("max_jump"), (F.max("j") > 450).alias("disturbed"))


@query("""with s as (select distinct sequence, sample_idx, gyro_yaw as a, gyro_pitch as b, gyro_roll as c, accel_x as x, accel_y as y, accel_z as z from imu_samples where sequence is not null and gyro_yaw is not null and gyro_pitch is not null and gyro_roll is not null and accel_x is not null and accel_y is not null and accel_z is not null),
w as (select sequence, sample_idx, count(*) over r as n, (var_pop(x) over r + var_pop(y) over r + var_pop(z) over r) / 3 as va, sqrt(pow(avg(a) over r, 2) + pow(avg(b) over r, 2) + pow(avg(c) over r, 2)) as g from s window r as (partition by sequence order by sample_idx rows between 19 preceding and current row))
select sequence, count(*) as n_windows, count(*) filter (where va < 0.02 and g < 0.01) as n_stopped from w where n = 20 group by sequence""")
def stop_windows(spark: SparkSession, sf: str) -> DataFrame:
    """How many full trailing windows of 20 readings say that the vehicle stands."""
    cols = ["gyro_yaw", "gyro_pitch", "gyro_roll", "accel_x", "accel_y", "accel_z"]
    s = table(spark, sf, "imu_samples").dropna(subset=["sequence", *cols]).select("sequence", "sample_idx", *cols).distinct()
    r = Window.partitionBy("sequence").orderBy("sample_idx").rowsBetween(-19, 0)
    va = sum((F.var_pop(c).over(r) for c in cols[3:]), F.lit(0.0)) / 3
    g = F.sqrt(sum((F.pow(F.avg(c).over(r), 2) for c in cols[:3]), F.lit(0.0)))
    w = s.select("sequence", F.count("*").over(r).alias("n"), va.alias("va"), g.alias("g")).where("n = 20")
    return w.groupBy("sequence").agg(F.count(F.lit(1)).alias("n_windows"), F.count_if((F.col("va") < 0.02) & (F.col("g") < 0.01)).alias("n_stopped"))


@query(f"with w as (select seq, sample_idx, count(*) over r as n, stddev_samp(v) over r as s from ev window r as ({_SEQW} rows between 19 preceding and current row)) select seq, sample_idx, round(greatest(s, 120), 6) as std_floored from w where n = 20")
def stop_std(spark: SparkSession, sf: str) -> DataFrame:
    """The sample deviation of each full trailing window, not below a floor."""
    r = by_seq().rowsBetween(-19, 0)
    w = events(spark, sf).select("seq", "sample_idx", F.count("*").over(r).alias("n"), F.stddev_samp("v").over(r).alias("s")).where("n = 20")
    return w.select("seq", "sample_idx", r6(F.greatest("s", F.lit(120.0))).alias("std_floored"))


@query("""with r as (select distinct raw_id, sequence, stream, event_ns, v3, v4, v5 from raw_imu where event_ns is not null),
d as (select *, event_ns - lag(event_ns) over w as dt, v3 is distinct from lag(v3) over w or v4 is distinct from lag(v4) over w or v5 is distinct from lag(v5) over w as ch, row_number() over w as k from r window w as (partition by sequence, stream order by event_ns, raw_id))
select sequence, stream, count(*) as n, round(1e9 / median(dt), 6) as rate_hz, count(*) filter (where ch and k > 1) as n_changes from d group by sequence, stream""")
def rate_and_bias_changes(spark: SparkSession, sf: str) -> DataFrame:
    """The effective rate of each stream by the median step, and how often its reported bias changed."""
    w = Window.partitionBy("sequence", "stream").orderBy("event_ns", "raw_id")
    r = table(spark, sf, "raw_imu").where("event_ns is not null").select("raw_id", "sequence", "stream", "event_ns", "v3", "v4", "v5").distinct()
    other = ~F.col("v3").eqNullSafe(F.lag("v3").over(w)) | ~F.col("v4").eqNullSafe(F.lag("v4").over(w)) | ~F.col("v5").eqNullSafe(F.lag("v5").over(w))
    d = r.withColumn("dt", F.col("event_ns") - F.lag("event_ns").over(w)).withColumn("ch", other).withColumn("k", F.row_number().over(w))
    return d.groupBy("sequence", "stream").agg(F.count(F.lit(1)).alias("n"), r6(1e9 / F.median("dt")).alias("rate_hz"), F.count_if(F.col("ch") & (F.col("k") > 1)).alias("n_changes"))


@query(f"""with d as (select seq, sample_idx, t_s, k / 100.0 * 6.283185307179586 as c, v, t_s - lag(t_s) over ({_SEQW}) as dt from ev),
u as (select *, c - lag(c) over ({_SEQW}) as dc from d)
select seq, sample_idx, round(c - 6.283185307179586 * sum(coalesce(round_even(dc / 6.283185307179586, 0), 0)) over ({_SEQW} rows unbounded preceding), 6) as course, round(sum(coalesce(v * dt, 0)) over ({_SEQW} rows unbounded preceding), 3) as integral from u""")
def unwrapped_course(spark: SparkSession, sf: str) -> DataFrame:
    """An angle without its jumps of a turn, and the running integral of a rate."""
    turn = 6.283185307179586
    d = events(spark, sf).select("seq", "sample_idx", (F.col("k") / 100.0 * turn).alias("c"), "v", (F.col("t_s") - F.lag("t_s").over(by_seq())).alias("dt"))
    run = by_seq().rowsBetween(Window.unboundedPreceding, 0)
    d = d.withColumn("dc", F.col("c") - F.lag("c").over(by_seq()))
    return d.select("seq", "sample_idx", r6(F.col("c") - turn * F.sum(F.coalesce(F.rint(F.col("dc") / turn), F.lit(0.0))).over(run)).alias("course"), F.round(F.sum(F.coalesce(F.col("v") * F.col("dt"), F.lit(0.0))).over(run), 3).alias("integral"))


@query(f"with d as (select seq, sample_idx, v, lead(v, 5) over ({_SEQW}) as b from ev where true), e as (select * from d where sample_idx % 5 = 0 and b is not null) select seq, count(*) as n, round(avg(b - v), 6) as mean_block, round(stddev_samp(b - v), 6) as sd_block from e group by seq")
def block_differences(spark: SparkSession, sf: str) -> DataFrame:
    """Differences over blocks of five samples."""
    d = events(spark, sf).select("seq", "sample_idx", "v", F.lead("v", 5).over(by_seq()).alias("b")).where("sample_idx % 5 = 0 and b is not null")
    return d.groupBy("seq").agg(F.count(F.lit(1)).alias("n"), r6(F.avg(F.col("b") - F.col("v"))).alias("mean_block"), r6(F.stddev_samp(F.col("b") - F.col("v"))).alias("sd_block"))


@query(f"""with c as (select seq, sample_idx, t_s, v, v is distinct from lag(v) over ({_SEQW}) as ch from ev), g as (select *, t_s - lag(t_s) over ({_SEQW}) as gap from c where ch)
select e.seq, round((arg_max(e.v, e.sample_idx) - arg_min(e.v, e.sample_idx)) / nullif(max(e.t_s) - min(e.t_s), 0), 9) as mean_slope, round(max(g.gap), 6) as staleness_s from c e left join g on e.seq = g.seq and e.sample_idx = g.sample_idx group by e.seq""")
def mean_slope_staleness(spark: SparkSession, sf: str) -> DataFrame:
    """The mean change from first to last value, and the longest time a value stood."""
    c = events(spark, sf).select("seq", "sample_idx", "t_s", "v", (~F.col("v").eqNullSafe(F.lag("v").over(by_seq()))).alias("ch"))
    last_change = F.last(F.when(F.col("ch"), F.col("t_s")), ignorenulls=True).over(by_seq().rowsBetween(Window.unboundedPreceding, -1))
    c = c.withColumn("gap", F.when(F.col("ch"), F.col("t_s") - last_change))
    return c.groupBy("seq").agg(
        F.round(F.try_divide(F.max_by("v", "sample_idx") - F.min_by("v", "sample_idx"), F.max("t_s") - F.min("t_s")), 9).alias("mean_slope"), r6(F.max("gap")).alias("staleness_s")
    )
