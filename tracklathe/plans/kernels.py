"""Sequential and vector kernels over the recordings."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracklathe.functions import geo
from tracklathe.kernels import inertial
from tracklathe.plans.base import registry
from tracklathe.session import table
from tracklathe.operators.blocked import previous
from tracklathe.operators.scoring import summary, window_metrics
from tracklathe.session import cut

QUERIES, SQL, query = registry()

#: Lengths of the outages in seconds, the warm-up before the first one, the grid that every outage starts on, and the blocks
#: that windows of every length tile, so that a block's windows need no other block's readings.
LENGTHS, WARMUP, GRID, BLOCK = [10, 30, 60, 120, 180], 30, 10, 360
#: Fixes further apart than this many seconds say nothing of the way between them.
TRUE_GAP = 5
#: The shared recordings' accelerations do not follow their fixes' speeds, so at the kernels' own bar no mount would ever be
#: trusted and every filter would stand still. The queries take every fitted mount, so that the whole filter runs.
TRUST = inertial.Noise(correlation=0.0, effective=2.0)
GYRO, ACCEL = ["gyro_yaw", "gyro_pitch", "gyro_roll"], ["accel_x", "accel_y", "accel_z"]


def samples(spark: SparkSession, sf: str) -> DataFrame:
    """Complete readings with their recording's clock in seconds; repeated rows once."""
    s = table(spark, sf, "imu_samples").dropna(subset=["sequence", "sample_idx", "time_since_start_ms", *GYRO, *ACCEL]).select("sequence", "sample_idx", "time_since_start_ms", *GYRO, *ACCEL).distinct()
    return s.select("sequence", F.col("sample_idx").alias("idx"), (F.col("time_since_start_ms") / 1000).alias("t"), F.array(*GYRO).alias("gyro"), F.array(*ACCEL).alias("accel"))


def fixes(spark: SparkSession, sf: str) -> DataFrame:
    """Fixes as local metres from each recording's first one, by sample index, with course (radians) and speed."""
    f = table(spark, sf, "gnss_fixes").where("gps_lat between -90 and 90 and gps_lon between -180 and 180 and sequence is not null").groupBy("sequence", F.col("sample_idx").alias("idx")).agg(
        F.min_by(F.struct("gps_lat", "gps_lon", "gps_altitude_m", "gps_accuracy_m", "gps_orientation_deg", "gps_speed_mps", "time_since_start_ms"), "fix_id").alias("f")).select("sequence", "idx", "f.*")
    first = f.groupBy(F.col("sequence").alias("_s")).agg(
        F.min_by(F.struct("gps_lat", "gps_lon"), "idx").alias("o"), F.min_by(F.when(F.col("gps_altitude_m").isNotNull(), F.col("gps_altitude_m")), F.when(F.col("gps_altitude_m").isNotNull(), F.col("idx"))).alias("alt0"),
        F.min("time_since_start_ms").alias("ms0"),
    )
    f = f.join(first, F.col("sequence") == F.col("_s"))
    n, e = geo.ned(F.col("gps_lat"), F.col("gps_lon"), F.col("o.gps_lat"), F.col("o.gps_lon"))
    speed = F.when(F.col("gps_speed_mps").between(0, 150), F.col("gps_speed_mps"))
    return f.select(
        "sequence", "idx", n.alias("north"), e.alias("east"), F.coalesce(F.col("alt0") - F.col("gps_altitude_m"), F.lit(0.0)).alias("down"), F.col("gps_accuracy_m").alias("sigma"),
        geo.wrap(F.radians("gps_orientation_deg")).alias("course"), speed.alias("speed"), (F.col("time_since_start_ms") / 1000).alias("fix_t"), F.floor(F.col("ms0") / 1000).alias("t0"),
    )


def aided_events(spark: SparkSession, sf: str) -> DataFrame:
    """Readings and fixes of each recording with readings, one row a block of ``BLOCK`` seconds with its events in order.

    ``t`` counts from the end of the warm-up after the recording's first fix (first reading where it has none). A row without a usable reading stays
    for its fix or stamp. An event without a stamp goes with the block of the last one before it.
    """
    rows = samples(spark, sf)
    stamps = table(spark, sf, "imu_samples").dropna(subset=["sequence", "sample_idx", "time_since_start_ms"]).groupBy("sequence", F.col("sample_idx").alias("idx")).agg((F.min("time_since_start_ms") / 1000).alias("stamp"))
    both = stamps.join(rows, ["sequence", "idx"], "left").join(fixes(spark, sf), ["sequence", "idx"], "full")
    both = both.withColumn("at", F.coalesce("t", "stamp", "fix_t"))
    # the recording's origin in whole seconds: a small table, one row a recording
    zero = both.groupBy("sequence").agg(F.coalesce(F.max("t0"), F.floor(F.min("at"))).alias("zero"), F.count("t").alias("reads")).where("reads > 0").drop("reads")
    both = both.drop("t0").join(zero, "sequence").withColumn("at", F.col("at") - F.col("zero") - WARMUP)
    both = both.withColumn("block", F.floor(F.coalesce("at", F.lit(0.0)) / BLOCK))
    event = F.struct("idx", F.col("at").alias("t"), *[F.col("gyro")[i].alias(n) for i, n in enumerate(("gx", "gy", "gz"))], *[F.col("accel")[i].alias(n) for i, n in enumerate(("ax", "ay", "az"))],
                     "north", "east", "down", "sigma", "course", "speed")
    return both.groupBy("sequence", "block").agg(F.array_sort(F.collect_list(event)).alias("e"), F.first("zero").alias("zero"))


def _matrix(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The events of packed blocks as one matrix, and where each block's begin."""
    at = column.offsets.to_numpy()
    flat = column.values.slice(at[0], at[-1] - at[0])
    return np.column_stack([flat.field(n).to_numpy(zero_copy_only=False).astype(float) for n in inertial.EVENT]) if len(flat) else np.zeros((0, 14)), at - at[0]


PASS = "sequence string, idx bigint, north double, east double, down double, speed double, yaw double, sigma double, how string, fixes bigint"
SNAPSHOT = "sequence string, block bigint, windows array<bigint>, states array<double>"


def _aided(events: DataFrame, every: int = 50, snapshots: bool = False) -> DataFrame:
    """The aided pass: each recording's blocks in order, the same block of many recordings side by side.

    Rows are hashed by recording and sorted by block inside a partition; only the recordings' states stay between batches.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fleet, slot = inertial.Fleet(16, TRUST), {}
        for b in batches:
            blocks, names = b.column("block").to_numpy(), b.column("sequence").to_pylist()
            edges = np.flatnonzero(np.concatenate([[True], blocks[1:] != blocks[:-1], [True]])) if len(b) else []
            for lo, hi in zip(edges[:-1], edges[1:]):
                for s in names[lo:hi]:
                    slot.setdefault(s, len(slot))
                if len(slot) > fleet.size:
                    fleet.grow(2 * len(slot))
                events, at = _matrix(b.column("e").slice(lo, hi - lo))
                slots = np.array([slot[s] for s in names[lo:hi]])
                rows, snaps = inertial.aided(fleet, slots, events, at, every, GRID if snapshots else None)
                if snapshots and snaps:
                    on, w = (np.concatenate([s[i] for s in snaps]) for i in (0, 1))
                    states, order = np.concatenate([s[2] for s in snaps]), np.argsort(on, kind="stable")
                    n = np.bincount(on, minlength=hi - lo)
                    has = np.flatnonzero(n)
                    cuts = np.concatenate([[0], np.cumsum(n[has])])
                    yield pa.RecordBatch.from_arrays([
                        pa.array([names[lo + i] for i in has], pa.string()), pa.array(np.full(len(has), blocks[lo])), pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(w[order])),
                        pa.ListArray.from_arrays(pa.array(cuts * states.shape[1], pa.int32()), pa.array(states[order].ravel())),
                    ], ["sequence", "block", "windows", "states"])
                if not snapshots and rows:
                    c = [np.concatenate([r[i] for r in rows]) for i in range(10)]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([names[lo + i] for i in c[0]], pa.string()), pa.array(c[1].astype(np.int64)), *[pa.array(x) for x in c[2:8]], pa.array([inertial.HOW[h] for h in c[8]]), pa.array(c[9])],
                        [x.split()[0] for x in PASS.split(", ")],
                    )

    return events.select("sequence", "block", "e").repartition("sequence").sortWithinPartitions("block", "sequence").mapInArrow(run, SNAPSHOT if snapshots else PASS)


@query()
def filter_pass(spark: SparkSession, sf: str) -> DataFrame:
    """The aided filter over every recording, a row every 50 readings and where it is lost."""
    return _aided(aided_events(spark, sf))


# Outages --------------------------------------------------------------------------------------------------------------
def _way(spark: SparkSession, sf: str) -> DataFrame:
    """Where each recording was at every whole second after its warm-up: between fixes at most ``TRUE_GAP`` seconds apart, and at the last fix."""
    f = table(spark, sf, "gnss_fixes").where("gps_lat between -90 and 90 and gps_lon between -180 and 180 and sequence is not null and time_since_start_ms is not null")
    f = f.groupBy("sequence", (F.col("time_since_start_ms") / 1000).alias("t")).agg(F.min_by(F.struct("gps_lat", "gps_lon"), "fix_id").alias("p"))
    zero = f.groupBy("sequence").agg(F.floor(F.min("t")).alias("zero"), F.min_by("p", "t").alias("o"))
    f = f.join(zero, "sequence")
    north, east = geo.ned(F.col("p.gps_lat"), F.col("p.gps_lon"), F.col("o.gps_lat"), F.col("o.gps_lon"))
    f = f.select("sequence", (F.col("t") - F.col("zero") - WARMUP).alias("t"), north.alias("n"), east.alias("e"))
    f = previous(f, ["sequence"], ["t"], F.floor(F.col("t") / BLOCK), F.struct("t", "n", "e"), "b").where(F.col("t") - F.col("b.t") <= TRUE_GAP)
    f = f.withColumn("s", F.explode(F.sequence(F.ceil("b.t"), F.floor("t")))).where((F.col("s") >= 0) & (F.col("s") >= F.col("b.t")) & (F.col("s") < F.col("t")))
    at = (F.col("s") - F.col("b.t")) / (F.col("t") - F.col("b.t"))
    return f.select("sequence", "s", (F.col("b.n") + (F.col("n") - F.col("b.n")) * at).alias("north"), (F.col("b.e") + (F.col("e") - F.col("b.e")) * at).alias("east"), F.col("b.n").alias("held_n"), F.col("b.e").alias("held_e"))


def _windows(way: DataFrame, estimates: list[str]) -> DataFrame:
    """Steps of every whole window of every length: the rows of ``way`` (``sequence, s``) cut into windows, no join needed.

    ``estimates`` are the columns ``<method>_n, <method>_e``; a window whose truth has a hole is left out.
    """
    w = Window.partitionBy("sequence", "length", "start_idx").orderBy("s")
    each = way.withColumn("length", F.explode(F.array(*[F.lit(n).cast("bigint") for n in LENGTHS])))
    own = F.floor(F.col("s") / F.col("length")) * F.col("length")
    # the second on a border ends one window and opens the next
    each = each.withColumn("start_idx", F.explode(F.array_compact(F.array(own, F.when((F.col("s") == own) & (own > 0), own - F.col("length"))))))
    step = lambda c: F.col(c) - F.lag(c).over(w)
    methods = F.array(*[F.struct(F.lit(m).alias("method"), step(f"{m}_n").alias("en"), step(f"{m}_e").alias("ee")) for m in estimates])
    rows = each.select(F.col("sequence").alias("seq"), "length", "start_idx", "s", F.lag("s").over(w).alias("s0"), step("north").alias("dn"), step("east").alias("de"), methods.alias("m")).where("s0 = s - 1")
    whole = rows.withColumn("steps", F.count(F.lit(1)).over(Window.partitionBy("seq", "length", "start_idx"))).where("steps = length")
    return whole.select("seq", "length", "start_idx", "s", "dn", "de", F.explode("m").alias("m")).select("seq", "length", "start_idx", "s", "dn", "de", "m.*")


_NED_N = "(lat - lat0) * (111132.92 - 559.82 * cos(2 * radians(lat0)) + 1.175 * cos(4 * radians(lat0)) - 0.0023 * cos(6 * radians(lat0)))"
_NED_E = "(lon - lon0) * (111412.84 * cos(radians(lat0)) - 93.5 * cos(3 * radians(lat0)) + 0.118 * cos(5 * radians(lat0)))"
_WAY = f"""f as (select sequence, time_since_start_ms / 1000 as t, arg_min(gps_lat, fix_id) as lat, arg_min(gps_lon, fix_id) as lon from gnss_fixes
  where gps_lat between -90 and 90 and gps_lon between -180 and 180 and sequence is not null and time_since_start_ms is not null group by 1, 2),
z as (select sequence, floor(min(t)) as zero, arg_min(lat, t) as lat0, arg_min(lon, t) as lon0 from f group by 1),
m as (select sequence, t - zero - {WARMUP} as t, {_NED_N} as n, {_NED_E} as e from f join z using (sequence)),
l as (select *, lag(t) over w as t0, lag(n) over w as n0, lag(e) over w as e0 from m window w as (partition by sequence order by t)),
x as (select *, unnest(range(cast(ceil(t0) as bigint), cast(floor(t) as bigint) + 1)) as s from l where t - t0 <= {TRUE_GAP}),
way as (select sequence, s, n0 + (n - n0) * ((s - t0) / (t - t0)) as north, e0 + (e - e0) * ((s - t0) / (t - t0)) as east, n0 as hold_n, e0 as hold_e from x where s >= 0 and s < t),
s0 as (select w.sequence, w.s as s, coalesce(b.north - w.north, 0) as vn, coalesce(b.east - w.east, 0) as ve from way w left join way b on b.sequence = w.sequence and b.s = w.s + 1),
ln as (select unnest([{', '.join(map(str, LENGTHS))}])::bigint as length),
ww as (select sequence, length, s // length * length as start_idx, s, north, east, hold_n, hold_e from way, ln union all select sequence, length, s - length, s, north, east, hold_n, hold_e from way, ln where s % length = 0 and s > 0),
d as (select *, lag(s) over w as sb, north - lag(north) over w as dn, east - lag(east) over w as de, hold_n - lag(hold_n) over w as hn, hold_e - lag(hold_e) over w as he from ww window w as (partition by sequence, length, start_idx order by s)),
c as (select *, count(*) over (partition by sequence, length, start_idx) as steps from d where sb = s - 1),
st as (select c.*, vn, ve from c join s0 on s0.sequence = c.sequence and s0.s = c.start_idx where steps = length),
me0 as (select sequence, length, start_idx, 'gnss' as method, dn, de, hn as en, he as ee from st union all select sequence, length, start_idx, 'straight', dn, de, vn, ve from st),
er as (select *, case when sqrt(dn * dn + de * de) > 1e-9 then ((en - dn) * dn + (ee - de) * de) / sqrt(dn * dn + de * de) else sqrt(en * en + ee * ee) end as err from me0),
me as (select sequence, length, start_idx, method, count(*) as n_epochs, sum(err) as cte, sum(abs(err)) as crse, sum(sqrt(dn * dn + de * de)) as path,
 case when sum(sqrt(dn * dn + de * de)) > 0 then 100 * sqrt(pow(sum(en) - sum(dn), 2) + pow(sum(ee) - sum(de), 2)) / sum(sqrt(dn * dn + de * de)) end as drift from er group by 1, 2, 3, 4)"""


def _plain_steps(spark: SparkSession, sf: str) -> DataFrame:
    """Steps of the two references without inertial data: the fixes going on, and straight on at the window's first velocity."""
    s = _windows(_way(spark, sf).withColumnsRenamed({"held_n": "gnss_n", "held_e": "gnss_e"}), ["gnss"])
    first = lambda c: F.min_by(c, "s").over(Window.partitionBy("seq", "length", "start_idx"))
    straight = s.withColumn("method", F.lit("straight")).withColumn("en", first("dn")).withColumn("ee", first("de"))
    return s.unionByName(straight)


@query(f"with {_WAY} select sequence, length, start_idx, method, n_epochs, round(cte, 4) as cte, round(crse, 4) as crse, round(path, 4) as path, round(drift, 4) as drift from me")
def reference_scores(spark: SparkSession, sf: str) -> DataFrame:
    """Scores of every outage window for fixes that go on and for driving straight on from the window's start."""
    m = window_metrics(_plain_steps(spark, sf))
    return m.select(F.col("seq").alias("sequence"), "length", "start_idx", "method", "n_epochs", *[F.round(c, 4).alias(c) for c in ("cte", "crse", "path", "drift")])


REPLAYED = "sequence string, s bigint, start_idx bigint, epochs bigint, aligned boolean, filter_n double, filter_e double, strapdown_n double, strapdown_e double"


def _replays(spark: SparkSession, sf: str) -> DataFrame:
    """Dead-reckoned positions at every second of the longest window that starts at each snapshot, by filter and by strapdown.

    The aided pass leaves a snapshot at each start; blocks are then replayed in parallel, all windows of a block and of
    its neighbours in the batch side by side. Shorter windows of the same start are its first seconds.
    """
    events = cut(aided_events(spark, sf))
    # strapdown is handed the true course and velocity of a window's first second
    way = _way(spark, sf).select("sequence", "s", "north", "east")
    after = way.select("sequence", (F.col("s") - 1).alias("s"), F.col("north").alias("n1"), F.col("east").alias("e1"))
    begin = way.where(F.col("s") % GRID == 0).join(after, ["sequence", "s"]).select("sequence", F.floor(F.col("s") / BLOCK).alias("block"), F.struct(F.floor(F.col("s") / GRID).alias("w"), (F.col("n1") - F.col("north")).alias("vn"), (F.col("e1") - F.col("east")).alias("ve")).alias("v"))
    begin = begin.groupBy("sequence", "block").agg(F.collect_list("v").alias("starts"))
    snaps = _aided(events, snapshots=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            matrix, at = _matrix(b.column("e"))
            names, windows, starts = b.column("sequence").to_pylist(), b.column("windows").to_pylist(), b.column("starts").to_pylist()
            width = len(b.column("states")[0]) // len(windows[0]) if len(b) else 0
            states = b.column("states").flatten().to_numpy().reshape(-1, width) if len(b) else None
            who, begins, lasts, v0, parts, kept, k = [], [], [], [], [], [], 0
            for i, ws in enumerate(windows):
                known, rows = {x["w"]: (x["vn"], x["ve"]) for x in starts[i]}, matrix[at[i]:at[i + 1]]
                for w in ws:
                    begin = w * GRID
                    if w in known:
                        last = max(n for n in LENGTHS if begin % n == 0)
                        who.append(names[i])
                        begins.append(begin)
                        lasts.append(last)
                        v0.append(known[w])
                        kept.append(k)
                        parts.append(rows[(rows[:, 1] >= begin) & (rows[:, 1] <= begin + last)])
                    k += 1
            if not who:
                continue
            begins, lasts, v0 = np.array(begins, float), np.array(lasts), np.array(v0, float)
            cuts, flat = np.concatenate([[0], np.cumsum([len(p) for p in parts])]), np.concatenate(parts)
            fleet = inertial.Fleet.unpack(states[kept], TRUST)
            aligned, p0 = fleet.aligned.copy(), fleet.p[:, :2].copy()
            free = inertial.Fleet.unpack(states[kept])
            with np.errstate(invalid="ignore"):
                up = np.array([np.nanmean(a, axis=0) if not np.isnan(a).all() else [0.0, 0.0, -1.0] for a in free.a])
                up /= np.maximum(np.linalg.norm(up, axis=1, keepdims=True), 1e-9)
            free.rot = inertial.about_down(np.arctan2(v0[:, 1], v0[:, 0])) @ inertial.level(up)
            free.v, free.p, free.aligned[:] = np.column_stack([v0, np.zeros(len(v0))]), np.zeros((len(v0), 3)), True
            free.t = begins.copy()
            one = inertial.dead_reckoned(fleet, begins, lasts, flat, cuts, True) - p0[:, None]
            two = inertial.dead_reckoned(free, begins, lasts, flat, cuts, False)
            row = np.repeat(np.arange(len(who)), lasts + 1)
            j = np.arange(len(row)) - np.repeat(np.cumsum(lasts + 1) - lasts - 1, lasts + 1)
            base = begins[row].astype(np.int64)
            columns = [pa.array(who, pa.string()).take(pa.array(row)), base + j, base, lasts[row].astype(np.int64), aligned[row], one[row, j, 0], one[row, j, 1], two[row, j, 0], two[row, j, 1]]
            yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in columns], [x.split()[0] for x in REPLAYED.split(", ")])

    return events.join(snaps, ["sequence", "block"]).join(begin, ["sequence", "block"]).mapInArrow(run, REPLAYED)


@query()
def window_replay(spark: SparkSession, sf: str) -> DataFrame:
    """Where filter and strapdown say each outage ends, from the window's start: the longest window of every start."""
    return _replays(spark, sf).where("s = start_idx + epochs").select("sequence", "start_idx", F.col("epochs").alias("length"), "aligned", "filter_n", "filter_e", "strapdown_n", "strapdown_e")


def _scored(spark: SparkSession, sf: str) -> DataFrame:
    """Metric rows of every window and method: filter, strapdown, and the references."""
    r = _replays(spark, sf).withColumn("length", F.explode(F.array(*[F.lit(n).cast("bigint") for n in LENGTHS]))).where("start_idx % length = 0 and length <= epochs and s <= start_idx + length")
    way = _way(spark, sf).select("sequence", "s", "north", "east")
    w = Window.partitionBy("sequence", "length", "start_idx").orderBy("s")
    step = lambda c: F.col(c) - F.lag(c).over(w)
    each = F.array(*[F.struct(F.lit(m).alias("method"), step(f"{m}_n").alias("en"), step(f"{m}_e").alias("ee")) for m in ("filter", "strapdown")])
    rows = r.join(way, ["sequence", "s"]).select(F.col("sequence").alias("seq"), "length", "start_idx", "s", "aligned", F.lag("s").over(w).alias("s0"), step("north").alias("dn"), step("east").alias("de"), each.alias("m")).where("s0 = s - 1")
    rows = rows.withColumn("steps", F.count(F.lit(1)).over(Window.partitionBy("seq", "length", "start_idx"))).where("steps = length")
    own = rows.select("seq", "length", "start_idx", "s", "aligned", "dn", "de", F.explode("m").alias("m")).select("seq", "length", "start_idx", "s", "aligned", "dn", "de", "m.*")
    own = own.withColumn("method", F.when((F.col("method") == "filter") & ~F.col("aligned"), "unaligned").otherwise(F.col("method"))).drop("aligned")
    return window_metrics(own).unionByName(window_metrics(_plain_steps(spark, sf)))


@query()
def window_scores(spark: SparkSession, sf: str) -> DataFrame:
    """Every window's scores by filter (``unaligned`` where it stood at its last fix), strapdown, fixes going on, and straight on."""
    return _scored(spark, sf).select(F.col("seq").alias("sequence"), "length", "start_idx", "method", "n_epochs", "cte", "crse", "path", "drift")


@query()
def drift_by_method(spark: SparkSession, sf: str) -> DataFrame:
    """Median, 95th percentile and greatest drift by method and outage length."""
    return summary(_scored(spark, sf).where("path > 0"), ["method", "length"], "drift")


@query()
def filter_ratio_by_class(spark: SparkSession, sf: str) -> DataFrame:
    """How many times strapdown drifts further than the filter at the median, 60 s windows, by the recordings' vibration and pooled.

    A recording vibrates if its stationary segments' median accelerometer variance is above that of half the recordings.
    """
    s = table(spark, sf, "stationary_segments").where("accel_var_mean > 0").groupBy("sequence").agg(F.percentile_approx("accel_var_mean", 0.5).alias("v"))
    cls = s.select(F.col("sequence").alias("seq"), F.when(F.col("v") > s.agg(F.percentile_approx("v", 0.5)).scalar(), "vibrating").otherwise("quiet").alias("cls"))
    m = _scored(spark, sf).where("length = 60 and path > 0 and method in ('filter', 'unaligned', 'strapdown')").join(cls, "seq", "left").withColumn("cls", F.coalesce("cls", F.lit("unknown")))
    med = lambda k: F.percentile_approx(F.when(k, F.col("drift")), 0.5, 10_000)
    g = m.rollup("cls").agg(F.count_if(F.col("method") != "strapdown").alias("n_windows"), F.try_divide(med(F.col("method") == "strapdown"), med(F.col("method") != "strapdown")).alias("ratio"))
    return g.withColumn("cls", F.coalesce("cls", F.lit("pooled")))


@query()
def strapdown(spark: SparkSession, sf: str) -> DataFrame:
    """Unaided integration over every outage from the true course and velocity at its start: positions a second apart."""
    return _replays(spark, sf).select("sequence", "start_idx", "s", F.col("strapdown_n").alias("north"), F.col("strapdown_e").alias("east"))


@query()
def allan_full(spark: SparkSession, sf: str) -> DataFrame:
    """The Allan curve of each gyroscope axis over shards of at most 4096 readings, log-spaced cluster sizes."""
    shards = samples(spark, sf).withColumn("shard", F.floor(F.col("idx") / 4096))
    sizes = sorted({max(1, round(10 ** (i / 10))) for i in range(31)})

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("idx")
        dt = float(np.median(np.diff(pdf.t))) if len(pdf) > 1 else 0.0
        x = np.array(pdf.gyro.tolist())
        rows = [(key[0], key[1], axis, *r) for k, axis in enumerate("xyz") for r in (inertial.allan(x[:, k], dt, sizes) if dt > 0 else [])]
        return pd.DataFrame(rows, columns=["sequence", "shard", "axis", "tau_s", "n", "adev"])

    return shards.groupBy("sequence", "shard").applyInPandas(run, "sequence string, shard bigint, axis string, tau_s double, n bigint, adev double")


MOUNTS = "sequence string, block bigint, n bigint, yaw double, correlation double, spread double, resolved boolean, level_sigma double"


@query()
def mount_dynamics(spark: SparkSession, sf: str) -> DataFrame:
    """The mount's turn about the vertical by block: planar acceleration against the change of the fixes' speed and speed times turn rate."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            events, at = _matrix(b.column("e"))
            rows = []
            for i in range(len(b)):
                e = events[at[i]:at[i + 1]]
                speed = pd.Series(e[:, 13]).ffill().to_numpy()
                ok = ~np.isnan(e[:, 2]) & ~np.isnan(e[:, 1])
                m = inertial.mount_fit(e[ok, 1], e[ok, 5:8], e[ok, 2:5], speed[ok])
                if m is not None:
                    rows.append((b.column("sequence")[i].as_py(), b.column("block")[i].as_py(), int(ok.sum()), m.yaw, m.correlation, m.spread, m.resolved, m.level_sigma))
            if rows:
                yield pa.RecordBatch.from_pylist([dict(zip([x.split()[0] for x in MOUNTS.split(", ")], r)) for r in rows])

    return aided_events(spark, sf).select("sequence", "block", "e").mapInArrow(run, MOUNTS)


@query()
def model_inference(spark: SparkSession, sf: str) -> DataFrame:
    """Batch inference: a small fixed linear head over each window's tensor, by Arrow batches."""
    weights = np.linspace(-0.5, 0.5, 60).reshape(10, 6)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            x = np.array([np.stack(v) if v is not None and len(v) == 10 else np.full((10, 6), np.nan) for v in b.x], float)
            yield pd.DataFrame({"window_id": b.window_id, "predicted": np.clip((x * weights).sum(axis=(1, 2)), 0, None)})

    return table(spark, sf, "stem_windows").select("window_id", "x").dropDuplicates(["window_id"]).mapInPandas(run, "window_id bigint, predicted double")
