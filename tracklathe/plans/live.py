"""State machines and recursive estimators over the event stream, replayed in batch and run as streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracklathe.plans.base import events, micros, r6, registry
from tracklathe.streaming import machines
from tracklathe.streaming.runner import drained, replay, stream

QUERIES, SQL, query = registry()

TRANSITIONS = "seq bigint, ms bigint, source string, target string, trigger string"


def ride(spark: SparkSession, sf: str) -> DataFrame:
    """The event stream told as evidence of a ride: a tenth of the clock, kinds by event type."""
    return as_ride(events(spark, sf))


def as_ride(e: DataFrame) -> DataFrame:
    kind, v, k = F.col("kind"), F.col("v"), F.col("k")
    told = F.when(kind == "view", "fix").when(kind == "click", "status").when(kind == "error", "light").when(kind == "purchase", "portal").otherwise("map")
    x = F.when(kind == "click", v / 12).when(kind == "error", v * 8).when(kind == "purchase", F.when(k > 20, v - 60)).when(kind == "signup", F.when(k > 70, 1.0).otherwise(0.0))
    verdict = F.when(k % 4 == 0, "rejected").when(k % 17 == 0, "forced").otherwise("accepted")
    return e.select("seq", "event_id", F.floor(F.col("t_s") / 10).alias("ms"), told.alias("kind"), x.alias("x"), (k % 12).alias("n"), verdict.alias("verdict"))


@query()
def fsm_replay(spark: SparkSession, sf: str) -> DataFrame:
    """Every transition of the tunnel machine."""
    return replay(ride(spark, sf), "seq", ["ms", "event_id"], machines.tunnel(), TRANSITIONS)


@query()
def fsm_stream(spark: SparkSession, sf: str) -> DataFrame:
    """The same transitions from a streaming run of the machine."""
    at = f"{sf}/events.parquet"
    raw = spark.read.parquet(at)
    path = spark._jvm.org.apache.hadoop.fs.Path(at)
    reader = spark.readStream.schema(raw.schema)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path).isDirectory():
        reader = reader.option("pathGlobFilter", path.getName())
        at = path.getParent().toString()
    start = raw.groupBy("user_id").agg(F.min("ts").alias("t0"))
    live = reader.parquet(at).join(start, "user_id")
    e = live.select(F.col("user_id").alias("seq"), "event_id", F.col("event_type").alias("kind"), F.col("value").alias("v"), F.get_json_object("props", "$.k").cast("int").alias("k"), ((micros("ts") - micros("t0")) / 1e6).alias("t_s"))
    return drained(spark, stream(as_ride(e), "seq", ["ms", "event_id"], machines.tunnel(), TRANSITIONS), TRANSITIONS, "fsm")


@query("""with recursive w as (select seq, sample_idx, event_id, k / 10.0 as x, floor(t_s / 10) / 1000.0 as t from ev), s as (
select seq, sample_idx, event_id, t, 8.33::double as pace from w where sample_idx = 0 union all
select w.seq, w.sample_idx, w.event_id, w.t, case when w.x >= 1 and w.t > s.t then greatest(s.pace + (1 - exp(-(w.t - s.t) / 45.0)) * (w.x - s.pace), 1.0) else s.pace end from s join w on w.seq = s.seq and w.sample_idx = s.sample_idx + 1)
select event_id as id, round(pace, 6) as pace from s""")
def eta_pace(spark: SparkSession, sf: str) -> DataFrame:
    """The pace after each event."""
    e = events(spark, sf).select("seq", F.col("event_id").alias("id"), "sample_idx", F.floor(F.col("t_s") / 10).alias("ms"), (F.col("k") / 10.0).alias("x"))
    return replay(e, "seq", ["sample_idx"], machines.pace(), "seq bigint, id bigint, pace double").select("id", r6("pace").alias("pace"))


@query("""with recursive w as (select seq, sample_idx, event_id, kind = 'view' as jump, v * 0.0987654321::double - 20 as dn, (k - 50) * 1.0123456789::double as de, floor(t_s / 100) / 1000.0 as t from ev), d as (select *, 0.0::double as n, 0.0::double as e from w where sample_idx = 0), s as (
select seq, sample_idx, event_id, t, case when jump then greatest(least(0 - dn, 75), -75)::double else 0.0::double end as n, case when jump then greatest(least(0 - de, 75), -75)::double else 0.0::double end as e from d union all
select seq, sample_idx, event_id, t, case when jump then greatest(least((case when z then 0 else pn end) - dn, 75), -75) else (case when z then 0 else pn end) end, case when jump then greatest(least((case when z then 0 else pe end) - de, 75), -75) else (case when z then 0 else pe end) end from (
select w.*, s.n * (1 - greatest(least((w.t - s.t) / 0.7, 1.0), 0.0)) as pn, s.e * (1 - greatest(least((w.t - s.t) / 0.7, 1.0), 0.0)) as pe, abs(s.n * (1 - greatest(least((w.t - s.t) / 0.7, 1.0), 0.0))) < 0.05 and abs(s.e * (1 - greatest(least((w.t - s.t) / 0.7, 1.0), 0.0))) < 0.05 as z
from s join w on w.seq = s.seq and w.sample_idx = s.sample_idx + 1))
select event_id as id, round(n, 4) as north, round(e, 4) as east from s""")
def reacquisition_slew(spark: SparkSession, sf: str) -> DataFrame:
    """The shown offset after each event."""
    e = events(spark, sf).select("seq", F.col("event_id").alias("id"), "sample_idx", F.floor(F.col("t_s") / 100).alias("ms"), (F.col("kind") == "view").alias("jump"), (F.col("v") * 0.0987654321 - 20).alias("dn"), ((F.col("k") - 50) * 1.0123456789).alias("de"))
    out = replay(e, "seq", ["sample_idx"], machines.slew(), "seq bigint, id bigint, north double, east double")
    return out.select("id", F.round("north", 4).alias("north"), F.round("east", 4).alias("east"))


@query("""with x as (select seq, sample_idx, event_id, v / 20 as d2 from ev where kind = 'view'), o as (select *, row_number() over (partition by seq order by sample_idx) as i from x),
g as (select *, i - row_number() over (partition by seq, d2 > 9.21 order by i) as g from o), r as (select *, row_number() over (partition by seq, d2 > 9.21, g order by i) as k from g)
select event_id as id, case when d2 <= 9.21 then 'accepted' when k % 5 = 0 then 'forced' else 'rejected' end as verdict from r""")
def fix_gate(spark: SparkSession, sf: str) -> DataFrame:
    """The verdict on each fix."""
    e = events(spark, sf).where("kind = 'view'").select("seq", F.col("event_id").alias("id"), "sample_idx", (F.col("v") / 20).alias("x"))
    return replay(e, "seq", ["sample_idx"], machines.gate(), "seq bigint, id bigint, verdict string").select("id", "verdict")


@query()
def motion_modes(spark: SparkSession, sf: str) -> DataFrame:
    """Rest, mode and steps after each acceleration."""
    kind = F.col("kind")
    told = F.when(kind == "purchase", "gyro").when(kind == "signup", "speed").otherwise("accel")
    x = F.when(kind == "purchase", F.col("k") / 500.0).when(kind == "signup", F.col("k") / 40.0).otherwise(9.80665 + (F.col("k") - 50) / 25.0)
    e = events(spark, sf).select("seq", F.col("event_id").alias("id"), "sample_idx", (F.col("sample_idx") * 120).alias("ms"), told.alias("kind"), x.alias("x"))
    schema = "seq bigint, id bigint, mode string, still boolean, dynamic double, steps bigint, stride double, cadence double"
    return replay(e, "seq", ["sample_idx"], machines.motion(), schema)


@query()
def course_track(spark: SparkSession, sf: str) -> DataFrame:
    """Course and bias after each turn rate or course fix."""
    kind = F.col("kind")
    told = F.when(kind == "purchase", "course").when(kind == "error", "rest").otherwise("gyro")
    x = F.when(kind == "purchase", (F.col("k") - 50) / 20.0).when(kind == "error", F.col("k") / 1000.0).otherwise((F.col("k") - 50) / 15.0)
    e = events(spark, sf).select("seq", F.col("event_id").alias("id"), "sample_idx", (F.col("sample_idx") * 100).alias("ms"), told.alias("kind"), x.alias("x"))
    return replay(e, "seq", ["sample_idx"], machines.course(), "seq bigint, id bigint, course double, bias double")


@query()
def route_progress(spark: SparkSession, sf: str) -> DataFrame:
    """Progress of each position along one route."""
    points = [(52.395, -1.5025), (52.398, -1.501), (52.4, -1.5), (52.403, -1.4985), (52.405, -1.4975)]
    handler = machines.route(points, points[1:], 1200.0)
    e = events(spark, sf).select("seq", F.col("event_id").alias("id"), "sample_idx", "lat", "lon", (F.col("k") / 5.0).alias("x"))
    return replay(e, "seq", ["sample_idx"], handler, "seq bigint, id bigint, step bigint, left_m double, eta_s bigint, off_route boolean, arrived boolean")


@query()
def live_pose(spark: SparkSession, sf: str) -> DataFrame:
    """The shown position after each event, with verdicts on fixes and the summary of each suppressed stretch."""
    kind, v, k = F.col("kind"), F.col("v"), F.col("k")
    told = F.when(kind == "view", "fix").when(kind == "signup", "tunnel").otherwise("move")
    x = F.when(kind == "view", k / 10.0).when(kind == "signup", F.when(k > 40, 1.0).otherwise(0.0)).otherwise(v / 30)
    e = events(spark, sf).select("seq", F.col("event_id").alias("id"), "sample_idx", F.floor(F.col("t_s") / 100).alias("ms"), told.alias("kind"), x.alias("x"), (k / 20.0).alias("c"), (v * 2).alias("north"), (k * 10.0).alias("east"))
    return replay(e, "seq", ["sample_idx"], machines.live(), "seq bigint, id bigint, north double, east double, sigma double, fresh boolean, verdict string, outage_s double, outage_m double, first_m double, n_forced bigint")
