"""Search pipelines, intake filters, debounce and throttle, outlines, candidate axes, outage summaries."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracklathe.functions import geo
from tracklathe.plans.base import events, r6, registry
from tracklathe.plans.ordered import by_seq
from tracklathe.session import table
from tracklathe.sources import documents
from tracklathe.streaming.runner import closed, Handler, drained, replay

QUERIES, SQL, query = registry()


@query("""with e as (select event_id, user_id, event_type, ts, case when ts - lag(ts) over (partition by user_id order by ts, event_id) < interval 20 hour then 0 else 1 end as fresh from events),
s as (select *, sum(fresh) over (partition by user_id order by ts, event_id rows unbounded preceding) as s from e)
select user_id, arg_max(event_id, (ts, event_id)) as last_id, count(*) as n from s group by user_id, s""")
def debounced(spark: SparkSession, sf: str) -> DataFrame:
    """The last event of each burst: sessions closed by a gap."""
    e = table(spark, sf, "events").withColumn("at", F.col("ts").cast("timestamp"))
    return e.groupBy("user_id", F.session_window("at", "20 hours")).agg(F.max_by("event_id", F.struct("at", "event_id")).alias("last_id"), F.count(F.lit(1)).alias("n")).drop("session_window")


@query("select user_id, time_bucket(interval 12 hour, ts) as at, arg_max(event_id, (ts, event_id)) as shown_id from events group by 1, 2")
def throttled(spark: SparkSession, sf: str) -> DataFrame:
    """At most one publication a period: the last event of each tumbling window."""
    e = table(spark, sf, "events").withColumn("w", F.window("ts", "12 hours"))
    return e.groupBy("user_id", F.col("w.start").alias("at")).agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("shown_id"))


@query("""with f as (select *, last_value(case when kind = 'view' then t_s end ignore nulls) over (partition by seq order by sample_idx rows between unbounded preceding and 1 preceding) as gps from ev)
select event_id, case when kind = 'click' and t_s - gps <= 30000 then 'network_after_gps' when k > 90 then 'inaccurate' else 'kept' end as verdict from f where kind in ('view', 'click')""")
def fix_intake(spark: SparkSession, sf: str) -> DataFrame:
    """Fixes let in: network ones not soon after a satellite one, none of poor accuracy."""
    gps = F.last(F.when(F.col("kind") == "view", F.col("t_s")), ignorenulls=True).over(by_seq().rowsBetween(Window.unboundedPreceding, -1))
    e = events(spark, sf).withColumn("gps", gps).where(F.col("kind").isin("view", "click"))
    return e.select("event_id", F.when((F.col("kind") == "click") & (F.col("t_s") - F.col("gps") <= 30_000), "network_after_gps").when(F.col("k") > 90, "inaccurate").otherwise("kept").alias("verdict"))


@query("""with f as (select *, kind = 'error' as out, coalesce(lag(kind = 'error') over (partition by seq order by sample_idx), false) as before from ev), g as (select *, sum(case when out and not before then 1 else 0 end) over (partition by seq order by sample_idx rows unbounded preceding) as g from f)
select seq, min(sample_idx) as start_idx, count(*) as n_samples, round(max(t_s) - min(t_s), 6) as elapsed_s, round(sum(v), 6) as distance, round(arg_min(v, sample_idx), 6) as first_residual, count(*) filter (where v <= 50) as n_accepted, count(*) filter (where v > 50) as n_rejected from g where out group by seq, g""")
def outage_exit(spark: SparkSession, sf: str) -> DataFrame:
    """What each outage was like when it ended: distance, time, first residual, fixes accepted and rejected."""
    out = F.col("kind") == "error"
    e = events(spark, sf).withColumn("start", (out & ~F.coalesce(F.lag(out).over(by_seq()), F.lit(False))).cast("int")).withColumn("g", F.sum("start").over(by_seq())).where(out)
    return e.groupBy("seq", "g").agg(
        F.min("sample_idx").alias("start_idx"), F.count(F.lit(1)).alias("n_samples"), r6(F.max("t_s") - F.min("t_s")).alias("elapsed_s"), r6(F.sum("v")).alias("distance"),
        r6(F.min_by("v", "sample_idx")).alias("first_residual"), F.count_if(F.col("v") <= 50).alias("n_accepted"), F.count_if(F.col("v") > 50).alias("n_rejected"),
    ).drop("g")


@query("""with c as (select seq, sqrt(var_samp(v)) as a, sqrt(var_samp(k)) as b from ev group by seq), i as (select unnest(range(0, 48)) as i) select seq, i, round(a * cos(2 * pi() * i / 48), 5) as x, round(b * sin(2 * pi() * i / 48), 5) as y from c, i""")
def ellipse_outline(spark: SparkSession, sf: str) -> DataFrame:
    """Forty-eight vertices around each recording's ellipse."""
    c = events(spark, sf).groupBy("seq").agg(F.sqrt(F.var_samp("v")).alias("a"), F.sqrt(F.var_samp("k")).alias("b"))
    at = F.transform(F.sequence(F.lit(0), F.lit(47)), lambda i: F.struct(i.cast("bigint").alias("i"), F.round(F.col("a") * F.cos(2 * math.pi * i / 48), 5).alias("x"), F.round(F.col("b") * F.sin(2 * math.pi * i / 48), 5).alias("y")))
    return c.select("seq", F.explode(at).alias("p")).select("seq", "p.*")


@query("""with e as (select seq, arg_min(lat, sample_idx) as lat1, arg_min(lon, sample_idx) as lon1, arg_max(lat, sample_idx) as lat2, arg_max(lon, sample_idx) as lon2 from ev group by seq), i as (select unnest(range(0, 17)) as i)
select seq, i as place, round(lat1 + (lat2 - lat1) * i / 16, 10) as lat, round(lon1 + (lon2 - lon1) * i / 16, 10) as lon from e, i""")
def straight_route(spark: SparkSession, sf: str) -> DataFrame:
    """The fallback route between a recording's first and last position."""
    e = events(spark, sf)
    ends = e.groupBy("seq").agg(*[f(c, "sample_idx").alias(f"{c}{n}") for n, f in ((1, F.min_by), (2, F.max_by)) for c in ("lat", "lon")])
    p = documents.fallback_route(ends).select("seq", F.posexplode("points").alias("place", "p"))
    return p.select("seq", F.col("place").cast("bigint").alias("place"), F.round("p.lat", 10).alias("lat"), F.round("p.lon", 10).alias("lon"))


CANDIDATES = [("yrp", (0, 2, 1), (1, -1, 1)), ("ypr", (0, 1, 2), (1, 1, 1)), ("ryp", (2, 0, 1), (1, 1, -1)), ("pyr", (1, 0, 2), (-1, 1, 1))]
_CAND = " union all ".join(f"select '{n}' as cand, sequence, " + ", ".join(f"{s} * {('gyro_yaw', 'gyro_pitch', 'gyro_roll')[i]} as {a}" for a, i, s in zip("xyz", p, sg)) + " from s" for n, p, sg in CANDIDATES)


@query(f"""with s as (select distinct sequence, sample_idx, gyro_yaw, gyro_pitch, gyro_roll from imu_samples where sequence is not null and gyro_yaw is not null and gyro_pitch is not null and gyro_roll is not null), c as ({_CAND})
select cand, sequence, count(*) as n, round(avg(x), 6) as mean_x, round(avg(y), 6) as mean_y, round(stddev_samp(z), 6) as sd_z from c group by cand, sequence""")
def axis_candidates(spark: SparkSession, sf: str) -> DataFrame:
    """The turn rates under each candidate mapping of axes and signs: a fixed list, spelt out in the row."""
    g = ["gyro_yaw", "gyro_pitch", "gyro_roll"]
    s = table(spark, sf, "imu_samples").dropna(subset=["sequence", *g]).select("sequence", "sample_idx", *g).distinct()
    each = F.array(*[F.struct(F.lit(n).alias("cand"), *[(sg[j] * F.col(g[p[j]])).alias(a) for j, a in enumerate("xyz")]) for n, p, sg in CANDIDATES])
    c = s.select("sequence", F.explode(each).alias("c")).select("sequence", "c.*")
    return c.groupBy("cand", "sequence").agg(F.count(F.lit(1)).alias("n"), r6(F.avg("x")).alias("mean_x"), r6(F.avg("y")).alias("mean_y"), r6(F.stddev_samp("z")).alias("sd_z"))


@query("""select event_id, round(atan2(0.5, greatest(v, 1e-6)), 6) as course_sigma, round(v * cos(k / 50.0), 6) as vn, round(v * sin(k / 50.0), 6) as ve,
round(pow(cos(k / 50.0) * 0.5, 2) + pow(v * sin(k / 50.0) * atan2(0.5, greatest(v, 1e-6)), 2), 6) as var_n, cast(round(case when k <= 10 then 3.0 else k end, 4) as double) as sigma_m from ev""")
def velocity_measurement(spark: SparkSession, sf: str) -> DataFrame:
    """Course and speed as a velocity with its variance; a missing or idle accuracy counts as three metres."""
    c, s = F.col("k") / 50.0, F.atan2(F.lit(0.5), F.greatest("v", F.lit(1e-6)))
    return events(spark, sf).select(
        "event_id", r6(s).alias("course_sigma"), r6(F.col("v") * F.cos(c)).alias("vn"), r6(F.col("v") * F.sin(c)).alias("ve"),
        r6(F.pow(F.cos(c) * 0.5, 2) + F.pow(F.col("v") * F.sin(c) * s, 2)).alias("var_n"), F.round(F.when(F.col("k") <= 10, 3.0).otherwise(F.col("k")), 4).alias("sigma_m"),
    )


@query("select event_id, round(0.01 * sqrt(2.0 / (k + 1)), 9) as driving_noise, abs(v * k / 1000) <= 0.6 and v >= 1 and abs(v - 250) / 60 <= 4 as nhc_valid, k >= 25 and v <= 400 and abs(k - 50) <= 40 as usable from ev")
def predicates(spark: SparkSession, sf: str) -> DataFrame:
    """Gauss-Markov driving noise, the validity of the sideways constraint, and usability of a track."""
    v, k = F.col("v"), F.col("k")
    return events(spark, sf).select("event_id", F.round(0.01 * F.sqrt(2.0 / (k + 1)), 9).alias("driving_noise"), ((F.abs(v * k / 1000) <= 0.6) & (v >= 1) & (F.abs(v - 250) / 60 <= 4)).alias("nhc_valid"), ((k >= 25) & (v <= 400) & (F.abs(k - 50) <= 40)).alias("usable"))


def admitted(cell: float = 0.0003) -> Handler:
    """Hits in order: one is let in if its coordinate cell or its title is new. Order decides, so it is a fold."""

    def on(s: dict, e: dict) -> list[dict]:
        at = f"{math.floor(e['lat'] / cell)},{math.floor(e['lon'] / cell)}"
        title = e["title"].lower()
        new = at not in s["cells"] or title not in s["titles"]
        s["cells"][at] = s["titles"][title] = 1
        return [{"id": e["id"]}] if new else []

    return lambda: {"cells": {}, "titles": {}}, on


@query()
def merged_hits(spark: SparkSession, sf: str) -> DataFrame:
    """Search hits of each query merged in order, the first of a place or name kept."""
    e = events(spark, sf).select("seq", F.col("event_id").alias("id"), "sample_idx", "lat", "lon", F.col("kind").alias("title"))
    return replay(e, "seq", ["sample_idx"], admitted(), "seq bigint, id bigint")


def bounded_track(apart_m: float = 0.5, most: int = 500) -> Handler:
    """A track that takes a point only some way and time from the last one; past its bound the oldest point goes."""

    def on(s: dict, e: dict) -> list[dict]:
        if s["at"] is not None:
            north, east = (e["lat"] - s["at"][0]) * 111_320.0, (e["lon"] - s["at"][1]) * 111_320.0 * math.cos(math.radians(e["lat"]))
            if math.hypot(north, east) < apart_m or e["ms"] - s["at"][2] < 100:
                return []
        s["at"], s["ids"] = [e["lat"], e["lon"], e["ms"]], [*s["ids"], e["id"]]
        gone = s["ids"].pop(0) if len(s["ids"]) > most else None
        return [{"id": e["id"], "held": len(s["ids"]), "evicted": gone}]

    return lambda: {"at": None, "ids": []}, on


@query()
def track_points(spark: SparkSession, sf: str) -> DataFrame:
    """The points that a shown track takes."""
    e = events(spark, sf).select("seq", F.col("event_id").alias("id"), "sample_idx", "lat", "lon", F.floor(F.col("t_s") * 1000).alias("ms"))
    return replay(e, "seq", ["sample_idx"], bounded_track(), "seq bigint, id bigint, held bigint, evicted bigint")


@query("""with h as (select n_name as title, 'a' as src from nation where n_name like '%1%' union all select c_name, 'b' from customer where c_name like '%zzz%'), f as (select count(*) filter (where src = 'b') as nb from h)
select title, src from h union all select s_name, 'c' from supplier, f where f.nb = 0 and s_suppkey < 5""")
def search_pipeline(spark: SparkSession, sf: str) -> DataFrame:
    """Presets and the first service's hits; the second service only where the first has none."""
    hits = table(spark, sf, "customer").where(F.col("c_name").contains("zzz")).select(F.col("c_name").alias("title"), F.lit("b").alias("src"))
    presets = table(spark, sf, "nation").where(F.col("n_name").contains("1")).select(F.col("n_name").alias("title"), F.lit("a").alias("src"))
    none = hits.agg((F.count(F.lit(1)) == 0).alias("none")).scalar()
    second = table(spark, sf, "supplier").where(F.col("s_suppkey") < 5).where(none).select(F.col("s_name").alias("title"), F.lit("c").alias("src"))
    return presets.unionByName(hits).unionByName(second)


@query()
def geocode_parse(spark: SparkSession, sf: str) -> DataFrame:
    """Service answers made of the supplier table, parsed back: blank names and impossible places left out."""
    s = table(spark, sf, "supplier")
    name = F.when(F.col("s_suppkey") % 7 == 0, F.lit(" ")).otherwise(F.col("s_name"))
    lat = F.when(F.col("s_suppkey") % 5 == 0, F.lit(99.0)).otherwise(50 + F.col("s_nationkey") / 10)
    feature = F.struct(F.struct(F.array(F.col("s_acctbal") / 1000, lat).alias("coordinates")).alias("geometry"), F.struct(F.col("s_suppkey").alias("osm_id"), name.alias("name"), F.lit("Ring").alias("street"), F.lit("in").alias("countrycode")).alias("properties"))
    return documents.photon(s.select(F.to_json(F.struct(F.array(feature).alias("features"))).alias("value")))


@query("select kind, time_bucket(interval 6 hour, ts) as start, count(*) as n, round(avg(v), 6) as mean_v from (select event_type as kind, ts, value as v from events) group by all")
def window_stream(spark: SparkSession, sf: str) -> DataFrame:
    """Tumbling event-time counts from a stream under a watermark, each window once it is closed.

    A table's files stand in any order, so nothing in it is late; a closing row far ahead then closes every window.
    """
    at = f"{sf}/events.parquet"
    schema, path = spark.read.parquet(at).schema, spark._jvm.org.apache.hadoop.fs.Path(at)
    reader = spark.readStream.schema(schema)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path).isDirectory():
        reader, at = reader.option("pathGlobFilter", path.getName()), path.getParent().toString()
    e, close = closed(reader.parquet(at).select(F.col("ts").cast("timestamp").alias("at"), "event_type", "value"), "at")
    g = e.groupBy(F.window("at", "6 hours"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean_v"))
    out = g.select(F.col("event_type").alias("kind"), F.col("window.start").alias("start"), "n", r6("mean_v").alias("mean_v"))
    found = drained(spark, out, "kind string, start timestamp, n bigint, mean_v double", "windows", close)
    return found.where("kind is not null").withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("select l_returnflag, round(sum(l_extendedprice * (1 - l_discount)), 2) as worth, count(distinct l_orderkey) as n_orders, round(try_cast(sum(l_tax) filter (where l_discount > 0.05) as double) / nullif(count(*) filter (where l_discount > 0.05), 0), 6) as mean_tax from lineitem group by l_returnflag")
def offered_means(spark: SparkSession, sf: str) -> DataFrame:
    """Sums, distinct counts, and a mean over what was offered, null where nothing was."""
    offered = F.col("l_discount") > 0.05
    return table(spark, sf, "lineitem").groupBy("l_returnflag").agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("worth"), F.count_distinct("l_orderkey").alias("n_orders"), r6(F.try_divide(F.sum(F.when(offered, F.col("l_tax"))), F.count_if(offered))).alias("mean_tax"))


@query("""with p as (select *, round((lat - first_value(lat) over w) * 111320.0, 4) as north, round((lon - first_value(lon) over w) * 111320.0 * cos(radians(52.4)), 4) as east from ev window w as (partition by seq order by sample_idx)),
d as (select *, abs(v - 250) / 100 as est_n, k / 10.0 as est_e from p), x as (select seq, sample_idx, sample_idx // 256 as part, north, east, round(sqrt(pow(est_n - north / 1e3, 2) + pow(est_e - east / 1e3, 2)), 4) as drift from d)
select seq, part, count(*) as n, min(sample_idx) as first_idx, round(sum(drift), 3) as drift_sum, max(drift) as drift_max, arg_max(north, sample_idx) as last_north, coalesce(max(north) filter (where sample_idx = part * 256 + 8), 0.0) as ninth_north from x group by 1, 2""")
def replay_record(spark: SparkSession, sf: str) -> DataFrame:
    """Nested records of each recording's epochs, a part for every 256, with their drift series; epochs are looked up by place, zero where there is none."""
    first = events(spark, sf).groupBy(F.col("seq").alias("_s")).agg(F.min_by(F.struct("lat", "lon"), "sample_idx").alias("o"))
    e = events(spark, sf).join(first, F.col("seq") == F.col("_s"))
    north, east = F.round((F.col("lat") - F.col("o.lat")) * 111320.0, 4), F.round((F.col("lon") - F.col("o.lon")) * 111320.0 * math.cos(math.radians(52.4)), 4)
    e = e.select("seq", "sample_idx", F.floor(F.col("sample_idx") / 256).alias("part"), north.alias("north"), east.alias("east"), (F.abs(F.col("v") - 250) / 100).alias("en"), (F.col("k") / 10.0).alias("ee"))
    drift = F.round(F.sqrt(F.pow(F.col("en") - F.col("north") / 1e3, F.lit(2)) + F.pow(F.col("ee") - F.col("east") / 1e3, F.lit(2))), 4)
    r = e.groupBy("seq", "part").agg(F.array_sort(F.collect_list(F.struct("sample_idx", "north", "east", drift.alias("drift")))).alias("epochs"))
    series = F.col("epochs.drift")
    return r.select(
        "seq", "part", F.size("epochs").cast("bigint").alias("n"), F.col("epochs")[0]["sample_idx"].alias("first_idx"), F.round(F.aggregate(series, F.lit(0.0), lambda s, x: s + x), 3).alias("drift_sum"), F.array_max(series).alias("drift_max"),
        F.element_at("epochs", -1)["north"].alias("last_north"), F.coalesce(F.try_element_at("epochs", F.lit(9))["north"], F.lit(0.0)).alias("ninth_north"),
    )


@query("select vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: x::double * x::double))), 5) as norm, label from embeddings")
def tensor_norms(spark: SparkSession, sf: str) -> DataFrame:
    """The length of each window's vector."""
    size = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    return table(spark, sf, "embeddings").select("vec_id", F.round(size, 5).alias("norm"), "label")


@query("""with f as (select distinct fix_id, sequence, sample_idx, gps_lat, gps_lon, gps_accuracy_m, gps_altitude_m from gnss_fixes), g as (select *, first_value(gps_altitude_m ignore nulls) over (partition by sequence order by sample_idx, fix_id rows between unbounded preceding and unbounded following) as alt0 from f)
select fix_id, round(-(gps_altitude_m - alt0), 4) as down_m, round(case when coalesce(gps_accuracy_m, 0) <= 0 then 3.0 else gps_accuracy_m end, 4) as sigma_m from g""")
def fix_arrays(spark: SparkSession, sf: str) -> DataFrame:
    """Fixes' depth below the recording's first altitude and their deviation, three metres where none is given."""
    w = Window.partitionBy("sequence").orderBy("sample_idx", "fix_id").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    f = table(spark, sf, "gnss_fixes").select("fix_id", "sequence", "sample_idx", "gps_lat", "gps_lon", "gps_accuracy_m", "gps_altitude_m").distinct()
    down = -(F.col("gps_altitude_m") - F.first("gps_altitude_m", ignorenulls=True).over(w))
    return f.select("fix_id", F.round(down, 4).alias("down_m"), F.round(F.when(F.coalesce("gps_accuracy_m", F.lit(0.0)) <= 0, 3.0).otherwise(F.col("gps_accuracy_m")), 4).alias("sigma_m"))


@query("""with f as (select distinct fix_id, sequence, gps_accuracy_m, time_since_start_ms / 1000 as t from gnss_fixes), g as (select *, t - lag(t) over (partition by sequence order by t, fix_id) as dt from f)
select sequence, count(*) as n_fixes, round(sum(gps_accuracy_m) / count(*), 6) as mean_accuracy_m, round(avg(dt), 6) as mean_interval_s, round(max(t), 6) as last_s from g group by sequence""")
def gnss_summary(spark: SparkSession, sf: str) -> DataFrame:
    """Fix count, intervals, latest fix, and the mean accuracy over all fixes, those without accuracy included."""
    f = table(spark, sf, "gnss_fixes").select("fix_id", "sequence", "gps_accuracy_m", (F.col("time_since_start_ms") / 1000).alias("t")).distinct()
    f = f.withColumn("dt", F.col("t") - F.lag("t").over(Window.partitionBy("sequence").orderBy("t", "fix_id")))
    return f.groupBy("sequence").agg(F.count(F.lit(1)).alias("n_fixes"), r6(F.sum("gps_accuracy_m") / F.count(F.lit(1))).alias("mean_accuracy_m"), r6(F.avg("dt")).alias("mean_interval_s"), r6(F.max("t")).alias("last_s"))
