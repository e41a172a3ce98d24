"""Versioned JSON documents and the answers of search and routing services, parsed by fixed schemas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TRAJECTORY_SCHEMA = "schema string, sequence string, length_s double, start_idx bigint, epochs array<struct<t_s:double,est:array<double>,truth:array<double>,sigma:double>>"
TUNNEL_SCHEMA = "schema string, tunnels array<struct<id:string,name:string,points:array<struct<lat:double,lon:double>>>>"
GEOJSON = "features array<struct<geometry:struct<coordinates:array<double>>,properties:struct<osm_id:bigint,name:string,street:string,city:string,state:string,countrycode:string,osm_key:string,osm_value:string>>>"
PLACES = "array<struct<place_id:bigint,display_name:string,lat:string,lon:string,type:string>>"
ROUTES = "code string, routes array<struct<distance:double,duration:double,geometry:struct<coordinates:array<array<double>>>,legs:array<struct<steps:array<struct<distance:double,maneuver:struct<type:string,modifier:string,location:array<double>>,name:string>>>>>>"


def _known(doc: Column, schema: str) -> Column:
    """The document, or an error if it is of another schema."""
    return F.when(doc["schema"].eqNullSafe(F.lit(schema)), doc).otherwise(F.raise_error(F.concat(F.lit("unknown schema: "), F.coalesce(doc["schema"], F.lit("none")))).cast("void"))


def trajectories(texts: DataFrame, schema: str, column: str = "value") -> DataFrame:
    """Trajectory records of the named schema version, one row an epoch; any other version is refused."""
    d = texts.select(_known(F.from_json(column, TRAJECTORY_SCHEMA), schema).alias("d"))
    return d.select("d.sequence", "d.length_s", "d.start_idx", F.posexplode("d.epochs").alias("epoch", "e")).select("sequence", "length_s", "start_idx", "epoch", "e.*")


def tunnels(texts: DataFrame, schema: str, column: str = "value") -> DataFrame:
    """Tunnel centrelines of the named schema version: vertices that aren't numbers left out, tunnels of fewer than two points too, with their length."""
    d = texts.select(F.explode(_known(F.from_json(column, TUNNEL_SCHEMA), schema)["tunnels"]).alias("t"))
    ok = lambda p: p["lat"].isNotNull() & p["lon"].isNotNull() & ~F.isnan(p["lat"]) & ~F.isnan(p["lon"])
    d = d.select("t.id", "t.name", F.filter("t.points", ok).alias("points")).where(F.size("points") >= 2)

    def step(a: Column, b: Column) -> Column:
        east = (b["lon"] - a["lon"]) * F.cos(F.radians((a["lat"] + b["lat"]) / 2))
        return F.sqrt(F.pow(b["lat"] - a["lat"], 2) + east * east) * 111320.0

    pairs = F.zip_with(F.slice("points", F.lit(1), F.size("points") - 1), F.slice("points", F.lit(2), F.size("points") - 1), step)
    return d.withColumn("length_m", F.aggregate(pairs, F.lit(0.0), lambda a, x: a + x))


def _inside(lat: Column, lon: Column) -> Column:
    return lat.between(-90, 90) & lon.between(-180, 180)


def photon(answers: DataFrame, column: str = "value", country: str | None = None) -> DataFrame:
    """Search hits of a GeoJSON answer, coordinates being (lon, lat): blank names, bad coordinates and other countries left out."""
    f = answers.select(F.explode(F.from_json(column, GEOJSON)["features"]).alias("f"))
    p, c = F.col("f.properties"), F.col("f.geometry.coordinates")
    rows = f.select(p["osm_id"].cast("string").alias("id"), F.trim(p["name"]).alias("title"), F.concat_ws(" · ", *[F.when(F.trim(p[x]) != "", p[x]) for x in ("street", "city", "state")]).alias("subtitle"),
                    F.get(c, F.lit(1)).alias("lat"), F.get(c, F.lit(0)).alias("lon"), p["osm_value"].alias("kind"), F.upper(p["countrycode"]).alias("country"))
    rows = rows.where((F.col("title") != "") & _inside(F.col("lat"), F.col("lon")))
    return rows.where(F.col("country") == country) if country else rows


def nominatim(answers: DataFrame, column: str = "value") -> DataFrame:
    """Search hits of a place list: the display name's first part is the title, the next three the subtitle."""
    f = answers.select(F.explode(F.from_json(column, PLACES)).alias("f"))
    parts = F.transform(F.split("f.display_name", ","), lambda x: F.trim(x))
    rows = f.select(F.col("f.place_id").cast("string").alias("id"), F.get(parts, F.lit(0)).alias("title"), F.array_join(F.slice(parts, 2, 3), ", ").alias("subtitle"), F.col("f.lat").try_cast("double").alias("lat"), F.col("f.lon").try_cast("double").alias("lon"), F.col("f.type").alias("kind"))
    return rows.where((F.col("title") != "") & _inside(F.col("lat"), F.col("lon")))


def routes(answers: DataFrame, column: str = "value") -> DataFrame:
    """The first route of an answer with its polyline and manoeuvres; null where the service had none, for the fallback."""
    r = F.get(F.from_json(column, ROUTES)["routes"], F.lit(0))
    a = answers.select("*", r.alias("_r"))
    steps = F.flatten(F.transform(F.col("_r.legs"), lambda leg: leg["steps"]))
    return a.select(
        *answers.columns, F.col("_r.distance").alias("distance_m"), F.col("_r.duration").alias("duration_s"),
        F.transform("_r.geometry.coordinates", lambda c: F.struct(c[1].alias("lat"), c[0].alias("lon"))).alias("points"),
        F.transform(steps, lambda s: F.struct(instruction(s).alias("instruction"), s["distance"].alias("distance_m"), s["maneuver"]["location"][1].alias("lat"), s["maneuver"]["location"][0].alias("lon"))).alias("steps"),
    )


def instruction(step: Column) -> Column:
    """A manoeuvre in words."""
    kind, way, road = step["maneuver"]["type"], step["maneuver"]["modifier"], step["name"]
    onto = F.when(F.trim(road) != "", F.concat(F.lit(" onto "), road)).otherwise("")
    return F.when(kind == "depart", F.concat(F.lit("Head out"), onto)).when(kind == "arrive", F.lit("You have arrived")).when(kind.contains("roundabout"), F.concat(F.lit("Take the roundabout"), onto)).when(way.isNotNull(), F.concat(F.lit("Turn "), way, onto)).otherwise(F.concat(F.lit("Continue"), onto))


def fallback_route(ends: DataFrame, points: int = 17) -> DataFrame:
    """A straight line where no service answered: ``lat1, lon1, lat2, lon2`` to a polyline of evenly spaced points."""
    at = lambda i: F.struct((F.col("lat1") + (F.col("lat2") - F.col("lat1")) * i / (points - 1)).alias("lat"), (F.col("lon1") + (F.col("lon2") - F.col("lon1")) * i / (points - 1)).alias("lon"))
    return ends.withColumn("points", F.transform(F.sequence(F.lit(0), F.lit(points - 1)), at))


def lines(spark: SparkSession, path: str) -> DataFrame:
    """Whole documents, one row a file, in ``value``."""
    return spark.read.text(path, wholetext=True)
