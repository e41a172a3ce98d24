"""Geodesy, projections, ranked search, labels, clocks and set operations."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracklathe.functions import geo, text
from tracklathe.plans.base import events, r6, registry
from tracklathe.plans.ordered import by_seq
from tracklathe.session import table

QUERIES, SQL, query = registry()

_LAG = "l as (select *, lag(lat) over (partition by seq order by sample_idx) as la, lag(lon) over (partition by seq order by sample_idx) as lo from ev)"


def _lagged(spark: SparkSession, sf: str) -> DataFrame:
    return events(spark, sf).withColumn("la", F.lag("lat").over(by_seq())).withColumn("lo", F.lag("lon").over(by_seq()))


@query("""with f as (select *, first_value(lat) over w as lat0, first_value(lon) over w as lon0 from ev window w as (partition by seq order by sample_idx))
select event_id, round((lat - lat0) * (111132.92 - 559.82 * cos(2 * radians(lat0)) + 1.175 * cos(4 * radians(lat0)) - 0.0023 * cos(6 * radians(lat0))), 5) as north,
round((lon - lon0) * (111412.84 * cos(radians(lat0)) - 93.5 * cos(3 * radians(lat0)) + 0.118 * cos(5 * radians(lat0))), 5) as east from f""")
def ned(spark: SparkSession, sf: str) -> DataFrame:
    """North and east metres from each recording's first position."""
    n, e = geo.ned(F.col("lat"), F.col("lon"), F.first("lat").over(by_seq()), F.first("lon").over(by_seq()))
    return events(spark, sf).select("event_id", F.round(n, 5).alias("north"), F.round(e, 5).alias("east"))


@query("select event_id, round(x - 2 * pi() * ceil((x - pi()) / (2 * pi())), 6) as wrapped, round(x - 2 * pi() * floor((x + pi()) / (2 * pi())), 6) as half_open from (select event_id, v / 37.0 - k / 9.0 as x from ev)")
def wrap_pi(spark: SparkSession, sf: str) -> DataFrame:
    """Angles in (-pi, pi] and in [-pi, pi)."""
    x = F.col("v") / 37.0 - F.col("k") / 9.0
    return events(spark, sf).select("event_id", r6(geo.wrap(x)).alias("wrapped"), r6(geo.wrap_half_open(x)).alias("half_open"))


@query(f"""with {_LAG} select event_id, round(2 * 6371000.0 * asin(sqrt(least(1.0, pow(sin(radians(lat - la) / 2), 2) + cos(radians(la)) * cos(radians(lat)) * pow(sin(radians(lon - lo) / 2), 2)))), 4) as sphere_m,
round(sqrt(pow((lat - la) * 111320.0, 2) + pow((lon - lo) * 111320.0 * cos(radians((la + lat) / 2)), 2)), 4) as flat_m from l where la is not null""")
def haversine_and_flat(spark: SparkSession, sf: str) -> DataFrame:
    """Step lengths on the sphere and on a plane."""
    a = (F.col("la"), F.col("lo"), F.col("lat"), F.col("lon"))
    return _lagged(spark, sf).where("la is not null").select("event_id", F.round(geo.haversine(*a), 4).alias("sphere_m"), F.round(geo.flat(*a), 4).alias("flat_m"))


@query()
def vincenty_steps(spark: SparkSession, sf: str) -> DataFrame:
    """Geodesic step lengths on the ellipsoid."""
    d = geo.vincenty(F.col("la"), F.col("lo"), F.col("lat"), F.col("lon"))
    return _lagged(spark, sf).where("la is not null").select("event_id", F.round(d, 4).alias("metres"))


@query()
def path_length(spark: SparkSession, sf: str) -> DataFrame:
    """The geodesic path of each recording; a single position gives 0."""
    d = geo.vincenty(F.col("la"), F.col("lo"), F.col("lat"), F.col("lon"))
    return _lagged(spark, sf).groupBy("seq").agg(F.round(F.coalesce(F.sum(d), F.lit(0.0)), 3).alias("path_m"), F.count(F.lit(1)).alias("n"))


# Three short polylines around the stream's positions, standing for tunnels.
TUNNELS = [(1, [(52.396, -1.5025), (52.398, -1.501), (52.4, -1.5)]), (2, [(52.401, -1.4995), (52.404, -1.4985)]), (3, [(52.395, -1.4985), (52.3965, -1.498), (52.3985, -1.4979)])]
SEGMENTS = [(t, i, *p[i], *p[i + 1]) for t, p in TUNNELS for i in range(len(p) - 1)]
_SEG = "sg(tunnel, part, lat1, lon1, lat2, lon2) as (values " + ", ".join(f"({t}, {i}, {a}::double, {b}::double, {c}::double, {d}::double)" for t, i, a, b, c, d in SEGMENTS) + ")"
_K = 111320.0 * math.cos(math.radians(52.4))
_PRO = f"""{_SEG}, pr as (select event_id, tunnel, part, (lon - lon1) * {_K} as x, (lat - lat1) * 111320.0 as y, (lon2 - lon1) * {_K} as dx, (lat2 - lat1) * 111320.0 as dy from ev cross join sg),
sz as (select *, sqrt(dx * dx + dy * dy) as size, (x * dx + y * dy) / sqrt(dx * dx + dy * dy) as along, (x * dy - y * dx) / sqrt(dx * dx + dy * dy) as side from pr),
di as (select *, sqrt(pow(along - greatest(0.0, least(size, along)), 2) + side * side) as dist from sz)"""


def _projected(spark: SparkSession, sf: str) -> DataFrame:
    """Each position against a fixed list of segments, unrolled in the row: no join at all."""
    def one(t, i, a, b, c, d):
        along, lateral, dist = geo.to_segment((F.col("lon") - b) * _K, (F.col("lat") - a) * 111320.0, F.lit(0.0), F.lit(0.0), F.lit((d - b) * _K), F.lit((c - a) * 111320.0))
        size = math.hypot((d - b) * _K, (c - a) * 111320.0)
        return F.struct(F.lit(t).alias("tunnel"), F.lit(i).alias("part"), F.lit(size).alias("size"), along.alias("along"), lateral.alias("lateral"), dist.alias("dist"))

    return events(spark, sf).select("event_id", F.array(*[one(*s) for s in SEGMENTS]).alias("s"))


@query(f"with {_PRO}, r as (select *, row_number() over (partition by event_id order by round(dist, 6), tunnel, part) as k from di) select event_id, tunnel, part, round(along, 5) as along, round(side, 5) as lateral, round(dist, 5) as dist from r where k = 1")
def segment_projection(spark: SparkSession, sf: str) -> DataFrame:
    """The nearest segment of each position, with the distance along and beside it."""
    best = F.array_min(F.transform("s", lambda x: F.struct(F.round(x["dist"], 6).alias("d"), x["tunnel"].alias("tunnel"), x["part"].alias("part"), x["along"].alias("along"), x["lateral"].alias("lateral"), x["dist"].alias("dist"))))
    p = _projected(spark, sf).select("event_id", best.alias("b"))
    return p.select("event_id", "b.tunnel", "b.part", F.round("b.along", 5).alias("along"), F.round("b.lateral", 5).alias("lateral"), F.round("b.dist", 5).alias("dist"))


@query(f"""with {_PRO}, q as (select *, dist <= 60 and along >= 0 and along <= size as inside, sqrt(x * x + y * y) as entry from di),
r as (select *, row_number() over (partition by event_id order by not inside, case when inside then round(abs(side), 6) end, round(entry, 6), tunnel, part) as k from q)
select event_id, tunnel, inside, round(case when inside then size - along when entry <= 500 then entry end, 5) as portal_m from r where k = 1""")
def tunnel_locate(spark: SparkSession, sf: str) -> DataFrame:
    """The tunnel a position is in, else the one with the nearest entry; the way to the portal, none beyond 500 m."""
    def fit(x):
        inside = (x["dist"] <= 60) & (x["along"] >= 0) & (x["along"] <= x["size"])
        entry = F.sqrt(x["along"] * x["along"] + x["lateral"] * x["lateral"])
        return F.struct((~inside).alias("o"), F.when(inside, F.round(F.abs(x["lateral"]), 6)).alias("l"), F.round(entry, 6).alias("e"), x["tunnel"].alias("tunnel"), x["part"].alias("part"), inside.alias("inside"), F.when(inside, x["size"] - x["along"]).when(entry <= 500, entry).alias("portal"))

    p = _projected(spark, sf).select("event_id", F.array_min(F.transform("s", fit)).alias("b"))
    return p.select("event_id", "b.tunnel", "b.inside", F.round("b.portal", 5).alias("portal_m"))


@query("""with c as (select seq, var_samp(v) as nn, covar_samp(v, k) as ne, var_samp(k) as ee from ev group by seq), h as (select *, (nn + ee) / 2 as m, sqrt(pow((nn - ee) / 2, 2) + ne * ne) as h from c)
select seq, round(sqrt(greatest(m + h, 0)), 5) as major, round(sqrt(greatest(m - h, 0)), 5) as minor, round(0.5 * atan2(2 * ne, nn - ee), 6) as angle from h""")
def error_ellipse(spark: SparkSession, sf: str) -> DataFrame:
    """The error ellipse of each recording's two-column covariance."""
    c = events(spark, sf).groupBy("seq").agg(F.var_samp("v").alias("nn"), F.covar_samp("v", F.col("k").cast("double")).alias("ne"), F.var_samp("k").alias("ee"))
    a, b, t = geo.ellipse(F.col("nn"), F.col("ne"), F.col("ee"))
    return c.select("seq", F.round(a, 5).alias("major"), F.round(b, 5).alias("minor"), r6(t).alias("angle"))


@query("""with c as (select seq, avg(v) as mv, avg(k) as mk, var_samp(v) as nn, covar_samp(v, k) as ne, var_samp(k) as ee from ev group by seq), m as (select event_id, (ee * pow(v - mv, 2) - 2 * ne * (v - mv) * (k - mk) + nn * pow(k - mk, 2)) / (nn * ee - ne * ne) as d2 from ev join c using (seq))
select event_id, round(d2, 5) as d2, d2 <= 9.21 as accepted from m""")
def mahalanobis_gate(spark: SparkSession, sf: str) -> DataFrame:
    """The squared distance of each sample under its recording's covariance, and the gate on it."""
    e = events(spark, sf)
    c = e.groupBy("seq").agg(F.avg("v").alias("mv"), F.avg("k").alias("mk"), F.var_samp("v").alias("nn"), F.covar_samp("v", F.col("k").cast("double")).alias("ne"), F.var_samp("k").alias("ee"))
    d2 = geo.mahalanobis_squared(F.col("v") - F.col("mv"), F.col("k") - F.col("mk"), F.col("nn"), F.col("ne"), F.col("ee"))
    return e.join(c, "seq").select("event_id", F.round(d2, 5).alias("d2"), (d2 <= 9.21).alias("accepted"))


@query("""with s as (select p_partkey, p_name, case when p_name like 're%' then 3 when p_name like '% re%' then 2 when contains(p_name, 're') then 1 else 0 end as score, abs(p_retailprice - 1000) as dist from part)
select p_partkey, p_name, score, round(dist, 4) as dist from s order by score desc, dist, p_partkey limit 10""")
def ranked_search(spark: SparkSession, sf: str) -> DataFrame:
    """The ten best hits: prefix before word prefix before substring, then the nearer."""
    n = F.col("p_name")
    score = F.when(n.startswith("re"), 3).when(n.contains(" re"), 2).when(n.contains("re"), 1).otherwise(0)
    s = table(spark, sf, "part").select("p_partkey", "p_name", score.alias("score"), F.abs(F.col("p_retailprice") - 1000).alias("dist"))
    return s.orderBy(F.desc("score"), "dist", "p_partkey").limit(10).withColumn("dist", F.round("dist", 4))


@query("""with r as (select user_id, event_type, max(ts) as ts, max(event_id) as event_id from events group by all), k as (select *, row_number() over (partition by user_id order by ts desc, event_type) as r from r) select user_id, event_type, cast(r as bigint) as place from k where r <= 3""")
def recents_topk(spark: SparkSession, sf: str) -> DataFrame:
    """Each user's three most recent kinds, each kind once, moved to the front by its latest use."""
    r = table(spark, sf, "events").groupBy("user_id", "event_type").agg(F.max("ts").alias("ts"))
    k = r.withColumn("place", F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("ts"), "event_type")).cast("bigint"))
    return k.where("place <= 3").select("user_id", "event_type", "place")


@query(r"""with x as (select distinct fix_id, date_text, regexp_extract(date_text, '(\d{1,2})[-:](\d{2})[-:](\d{2})(?:[._:](\d{1,3}))?"?\s*$', 1) as h, regexp_extract(date_text, '(\d{1,2})[-:](\d{2})[-:](\d{2})(?:[._:](\d{1,3}))?"?\s*$', 2) as m,
regexp_extract(date_text, '(\d{1,2})[-:](\d{2})[-:](\d{2})(?:[._:](\d{1,3}))?"?\s*$', 3) as s, regexp_extract(date_text, '(\d{1,2})[-:](\d{2})[-:](\d{2})(?:[._:](\d{1,3}))?"?\s*$', 4) as f, regexp_extract(date_text, '\d{4}-\d{2}-\d{2}') as d from gnss_fixes)
select fix_id, nullif(d, '') as day, case when h <> '' then round(h::double * 3600 + m::double * 60 + s::double + case when f <> '' then rpad(f, 3, '0')::double / 1000 else 0 end, 3) end as tod_s from x""")
def parse_clock(spark: SparkSession, sf: str) -> DataFrame:
    """The day and the seconds of the day of every spelling of a stamp."""
    g = table(spark, sf, "gnss_fixes").select("fix_id", "date_text").distinct()
    day = F.regexp_extract("date_text", r"\d{4}-\d{2}-\d{2}", 0)
    return g.select("fix_id", F.when(day != "", day).alias("day"), F.round(text.clock_seconds(F.col("date_text")), 3).alias("tod_s"))


@query("select o_orderkey, epoch_us(timezone('Europe/London', o_orderdate + interval 30 minute)) as utc_us from orders")
def uk_to_utc(spark: SparkSession, sf: str) -> DataFrame:
    """Local United Kingdom stamps as UTC."""
    local = F.col("o_orderdate").cast("timestamp") + F.expr("interval 30 minutes")
    return table(spark, sf, "orders").select("o_orderkey", F.unix_micros(F.to_utc_timestamp(local, "Europe/London")).alias("utc_us"))


@query(r"select distinct name, regexp_replace(regexp_replace(regexp_replace(lower(trim(name)), '^[sv][-_]', ''), '\.csv$', ''), '^(.+)[a-z]$', '\1') as family from sequences")
def stem_family(spark: SparkSession, sf: str) -> DataFrame:
    """The family of each recording's stem."""
    stem = F.regexp_replace(F.regexp_replace(F.lower(F.trim("name")), "^[sv][-_]", ""), r"\.csv$", "")
    return table(spark, sf, "sequences").select("name", F.regexp_replace(stem, r"^(.+)[a-z]$", "$1").alias("family")).distinct()


@query("select event_id, ['N','NE','E','SE','S','SW','W','NW'][cast(floor(((k * 3.6) % 360 + 22.5) / 45) as int) % 8 + 1] as label from ev")
def compass_octant(spark: SparkSession, sf: str) -> DataFrame:
    """The compass label of a course."""
    return events(spark, sf).select("event_id", text.octant(F.col("k") * 3.6).alias("label"))


@query("select event_id, cast(json_extract_string(props, '$.k') as bigint) as k, json_extract_string(props, '$.missing') as missing from events")
def json_extract(spark: SparkSession, sf: str) -> DataFrame:
    """A document's fields by schema; absent ones are null."""
    p = F.from_json("props", "k bigint, missing string")
    return table(spark, sf, "events").select("event_id", p["k"].alias("k"), p["missing"].alias("missing"))


@query("select channels.field_name, regexp_replace(regexp_replace(regexp_replace(lower(trim(regexp_replace(sample_label, '\\s+', ' ', 'g'))), '\\([^)]*\\)|\\[[^\\]]*\\]', ' ', 'g'), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') as header from channels")
def header_normalise(spark: SparkSession, sf: str) -> DataFrame:
    """Shipped column titles as plain names."""
    return table(spark, sf, "channels").select("field_name", text.header(F.col("sample_label")).alias("header"))


_ALLOWED = "', '".join(text.ALLOWED)


@query(f"select field_name, regexp_matches(field_name, '{text.BANNED}') as banned, field_name in ('{_ALLOWED}') as allowed from (select field_name from channels union all select unnest(['wheel_speed_fl', 'steering_angle', 'engine_rpm', 'brake_psi']))")
def leakage_violations(spark: SparkSession, sf: str) -> DataFrame:
    """Which columns the guard lets through, and which name the vehicle bus."""
    bus = spark.createDataFrame([(x,) for x in ("wheel_speed_fl", "steering_angle", "engine_rpm", "brake_psi")], "field_name string")
    c = table(spark, sf, "channels").select("field_name").unionByName(bus)
    return c.select("field_name", F.col("field_name").rlike(text.BANNED).alias("banned"), F.col("field_name").isin(text.ALLOWED).alias("allowed"))


@query("""with a as (select distinct c_nationkey as k from customer), b as (select distinct s_nationkey as k from supplier) select 'both' as part, k from (select * from a intersect select * from b)
union all select 'left' , k from (select * from a except select * from b) union all select 'right', k from (select * from b except select * from a) union all select 'any', k from (select * from a union select * from b)""")
def set_ops(spark: SparkSession, sf: str) -> DataFrame:
    """Intersection, differences and union of two key sets."""
    a = table(spark, sf, "customer").select(F.col("c_nationkey").alias("k")).distinct()
    b = table(spark, sf, "supplier").select(F.col("s_nationkey").alias("k")).distinct()
    tag = lambda df, t: df.select(F.lit(t).alias("part"), "k")
    return tag(a.intersect(b), "both").unionByName(tag(a.subtract(b), "left")).unionByName(tag(b.subtract(a), "right")).unionByName(tag(a.union(b).distinct(), "any"))


@query("""select event_id, greatest(cast(floor(v * 40 / case when k <= 0 then 8.33 else k end) as bigint), 10) as eta_s, printf('%02d:%02d:%02d', cast(floor(v * 40) as bigint) // 3600, cast(floor(v * 40) as bigint) % 3600 // 60, cast(floor(v * 40) as bigint) % 60) as hms,
case when v * 10 < 1000 then printf('%d m', cast(floor(v * 10) as bigint)) else printf('%.1f km', round(v * 10 / 1000, 1)) end as distance, cast(round(k * 3.6, 4) as double) as kmh, k * 3.6 > 120 as over_limit, round(least(greatest(k * 3.6 / 160, 0), 1), 6) as gauge from ev""")
def ride_labels(spark: SparkSession, sf: str) -> DataFrame:
    """Arrival time, elapsed time, distance and speed as a rider sees them."""
    v, k = F.col("v"), F.col("k")
    speed = F.when(k <= 0, 8.33).otherwise(k)
    return events(spark, sf).select(
        "event_id", F.greatest(F.floor(v * 40 / speed), F.lit(10).cast("bigint")).alias("eta_s"), text.hms(v * 40).alias("hms"), text.distance_label(v * 10).alias("distance"),
        F.round(k * 3.6, 4).alias("kmh"), (k * 3.6 > 120).alias("over_limit"), r6(F.least(F.greatest(k * 3.6 / 160, F.lit(0.0)), F.lit(1.0))).alias("gauge"),
    )


@query("""select event_id, list_filter([case when k < 10 then 'few' end, case when v > 400 then 'high' end, case when kind = 'error' then 'fault' end, case when v < 5 then 'low' end], lambda x: x is not null) as chips from ev""")
def hazard_chips(spark: SparkSession, sf: str) -> DataFrame:
    """The labels whose condition holds, in order."""
    chips = [(F.col("k") < 10, "few"), (F.col("v") > 400, "high"), (F.col("kind") == "error", "fault"), (F.col("v") < 5, "low")]
    return events(spark, sf).select("event_id", F.array_compact(F.array(*[F.when(c, F.lit(x)) for c, x in chips])).alias("chips"))


@query("select p_partkey, split_part(p_name, ' ', 1) as title, nullif(array_to_string(list_filter([split_part(p_name, ' ', 2), p_brand, p_type], lambda x: trim(x) <> ''), ' · '), '') as subtitle, case when p_type in ('ECONOMY', 'PROMO') then 'cheap' when p_type = 'STANDARD' then 'plain' else 'other' end as category from part")
def search_labels(spark: SparkSession, sf: str) -> DataFrame:
    """Title, joined subtitle and category of a search item."""
    parts = F.split("p_name", " ")
    sub = F.concat_ws(" · ", F.filter(F.array(F.coalesce(F.get(parts, F.lit(1)), F.lit("")), "p_brand", "p_type"), lambda x: F.trim(x) != ""))
    kind = F.when(F.col("p_type").isin("ECONOMY", "PROMO"), "cheap").when(F.col("p_type") == "STANDARD", "plain").otherwise("other")
    return table(spark, sf, "part").select("p_partkey", F.get(parts, F.lit(0)).alias("title"), F.when(sub != "", sub).alias("subtitle"), kind.alias("category"))


@query("""with i as (select c_custkey, c_name, c_acctbal, 0 as src from customer where c_acctbal > 9000 union all select c_custkey, c_name, c_acctbal, 1 from customer where c_acctbal > 8000),
r as (select *, row_number() over (partition by c_custkey order by src) as k from i) select c_custkey, cast(src as bigint) as src from r where k = 1""")
def merged_suggestions(spark: SparkSession, sf: str) -> DataFrame:
    """Recents before search hits, each item once, the first kept."""
    c = table(spark, sf, "customer")
    i = c.where("c_acctbal > 9000").select("c_custkey", F.lit(0).cast("bigint").alias("src")).unionByName(c.where("c_acctbal > 8000").select("c_custkey", F.lit(1).cast("bigint").alias("src")))
    return i.groupBy("c_custkey").agg(F.min("src").alias("src"))


@query("select c_mktsegment, list(c_custkey order by c_custkey)[1:5] as first_keys, count(*) as n from customer group by c_mktsegment")
def sections(spark: SparkSession, sf: str) -> DataFrame:
    """Items by section with the first five keys; the five come from ranks, so no section is gathered whole."""
    c = table(spark, sf, "customer")
    n = c.groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n"))
    part = c.withColumn("r", F.row_number().over(Window.partitionBy("c_mktsegment", F.pmod("c_custkey", F.lit(64))).orderBy("c_custkey"))).where("r <= 5")
    k = part.withColumn("r", F.row_number().over(Window.partitionBy("c_mktsegment").orderBy("c_custkey"))).where("r <= 5")
    return k.groupBy("c_mktsegment").agg(F.sort_array(F.collect_list("c_custkey")).alias("first_keys")).join(n, "c_mktsegment")


@query("select p_partkey, round(6371.0 * 2 * asin(sqrt(pow(sin(radians(p_size - 25) / 20), 2))), 4) as km from part where 6371.0 * 2 * asin(sqrt(pow(sin(radians(p_size - 25) / 20), 2))) <= 50 order by km, p_partkey limit 10")
def nearby(spark: SparkSession, sf: str) -> DataFrame:
    """The ten nearest items within a radius."""
    km = 6371.0 * 2 * F.asin(F.sqrt(F.pow(F.sin(F.radians(F.col("p_size") - 25) / 20), 2)))
    return table(spark, sf, "part").select("p_partkey", km.alias("km")).where("km <= 50").orderBy(F.round("km", 4), "p_partkey").limit(10).withColumn("km", F.round("km", 4))
