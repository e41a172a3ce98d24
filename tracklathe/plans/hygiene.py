"""Queries p2 to p5: regular grids, drifting schemas, implausible values, differing copies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracklathe.operators.regrid import regular_grid
from tracklathe.session import fixed_list, table

QUERIES, SQL = {}, {}

ACCEL = ["accel_x", "accel_y", "accel_z"]
READINGS = [*ACCEL, "gyro_yaw", "gyro_pitch", "gyro_roll", "gravity_x", "gravity_y", "gravity_z", "magnetic_x", "magnetic_y", "magnetic_z"]


def query(f):
    QUERIES[f.__name__] = f
    return f


@query
def p2_grid(spark: SparkSession, sf: str) -> DataFrame:
    """Every recording's readings at one row a second, missing seconds marked."""
    grid = regular_grid(table(spark, sf, "imu_samples"), "sequence", "time_since_start_ms", ACCEL, READINGS)
    return grid.withColumnRenamed("period", "period_s")


@query
def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    """The seconds without a usable reading between a recording's first and last one with it."""
    return p2_grid(spark, sf).where("status <> 'observed'").select("sequence", "period_s")


SQL["p2_found"] = """
with s as (select distinct sequence, cast(floor(time_since_start_ms / 1000) as bigint) k from imu_samples
  where sequence is not null and time_since_start_ms is not null and accel_x is not null and accel_y is not null and accel_z is not null),
g as (select sequence, k, lead(k) over (partition by sequence order by k) n from s)
select sequence, unnest(range(k + 1, n)) as period_s from g where n > k + 1"""


from tracklathe.operators import drifting_schema as drift  # noqa: E402


def _records(spark: SparkSession, sf: str) -> DataFrame:
    return drift.read_records(table(spark, sf, "logger_files"), drift.known_labels(table(spark, sf, "channels")))


def _fields(spark: SparkSession, sf: str, kind: str) -> list[tuple[str, str]]:
    rows = fixed_list(table(spark, sf, "channels").where(F.col("record_kind") == kind).select("field_name", "usual_kind"))
    return [(r.field_name, r.usual_kind) for r in rows]


@query
def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    """Every change of layout within a feed."""
    return drift.changes(_records(spark, sf)).select("file_id", "field_name", "change_kind")


@query
def p3_readings(spark: SparkSession, sf: str) -> DataFrame:
    """All readings of delimited files as one typed table."""
    return drift.typed(_records(spark, sf), "imu", _fields(spark, sf, "imu"))


@query
def p3_axis_reports(spark: SparkSession, sf: str) -> DataFrame:
    """All axis reports as one typed table."""
    return drift.typed(_records(spark, sf), "axis", _fields(spark, sf, "axis"))


@query
def p3_failed_casts(spark: SparkSession, sf: str) -> DataFrame:
    """Values that their field's usual kind can't hold, by file and field."""
    fields = dict([*_fields(spark, sf, "imu"), *_fields(spark, sf, "axis")])
    return drift.failed_casts(_records(spark, sf), fields)


from tracklathe.operators.copies import copy_differences, current  # noqa: E402
from tracklathe.operators.implausible import implausible  # noqa: E402

#: No vehicle is above or below these heights, in metres.
ALTITUDE = (-500.0, 9000.0)


def _implausible(spark: SparkSession, sf: str) -> DataFrame:
    long = lambda df, fields: df.select(
        "table_name", "row_id", "source", "at", "block",
        F.explode(F.array(*[F.struct(F.lit(f).alias("field_name"), F.col(f).cast("double").alias("value")) for f in fields])).alias("f"),
    ).select("table_name", "row_id", "source", "at", "block", "f.*")
    devices = table(spark, sf, "sequences").groupBy(F.col("name").alias("sequence")).agg(F.max("device").alias("device"))
    segments = table(spark, sf, "stationary_segments").dropDuplicates(["segment_id"]).join(devices, "sequence", "left")
    segments = segments.select(
        F.lit("stationary_segments").alias("table_name"), F.col("segment_id").alias("row_id"), F.coalesce("device", F.concat(F.lit("?"), "sequence")).alias("source"),
        F.col("segment_id").cast("double").alias("at"), F.floor(F.col("segment_id") / 8192).alias("block"), "accel_var_mean", "gyro_norm_mean",
    )
    fixes = table(spark, sf, "gnss_fixes").dropDuplicates(["fix_id"]).select(
        F.lit("gnss_fixes").alias("table_name"), F.col("fix_id").alias("row_id"), F.col("sequence").alias("source"), F.col("time_since_start_ms").alias("at"),
        F.coalesce(F.floor(F.col("time_since_start_ms") / 3_600_000), F.lit(0)).alias("block"), "gps_lat", "gps_lon", "gps_altitude_m", "gps_speed_mps",
    )
    series = long(segments, ["accel_var_mean", "gyro_norm_mean"]).unionByName(long(fixes, ["gps_lat", "gps_lon", "gps_altitude_m", "gps_speed_mps"]))
    v = F.col("value")
    possible = (
        F.when(F.col("field_name").isin("accel_var_mean", "gyro_norm_mean"), v > 0).when(F.col("field_name") == "gps_lat", F.abs(v) <= 90)
        .when(F.col("field_name") == "gps_lon", F.abs(v) <= 180).when(F.col("field_name") == "gps_altitude_m", v.between(*ALTITUDE)).otherwise(v >= 0)
    )
    return implausible(series, possible, ["accel_var_mean", "gyro_norm_mean", "gps_altitude_m", "gps_speed_mps"])


@query
def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    """Bad values of segments against the device and of fixes against the recording."""
    return _implausible(spark, sf).select("table_name", "row_id", "field_name")


@query
def p4_reasons(spark: SparkSession, sf: str) -> DataFrame:
    """The bad values by reason and field."""
    return _implausible(spark, sf).groupBy("table_name", "field_name", "reason").agg(F.count(F.lit(1)).alias("n"))


TREE = {"sha256": "text", "bytes": "number", "n_rows": "exact", "duration_s": "number", "header_style": "text", "modified_at": "exact"}


def _copies(spark: SparkSession, sf: str) -> DataFrame:
    key = [F.col("stream"), F.lower(F.trim("filename"))]
    sides = [current(table(spark, sf, t), key, ["stream", "file_key"], "listed_at", list(TREE)) for t in ("tree_categorised", "tree_uncategorised")]
    return copy_differences(*sides, ["stream", "file_key"], TREE, {"duration_s": 0.0005}, "only_categorised", "only_uncategorised")


@query
def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    """Files that one copy lacks, and each field whose current value differs."""
    return _copies(spark, sf).select("stream", "file_key", "field_name")


@query
def p5_differences(spark: SparkSession, sf: str) -> DataFrame:
    """The differences with both values and the difference in bytes."""
    return _copies(spark, sf).withColumn("delta_bytes", F.when(F.col("field_name") == "bytes", F.col("delta").cast("bigint"))).drop("delta")


SQL["p5_found"] = """
with a as (select * from (select *, lower(trim(filename)) k, row_number() over (partition by stream, lower(trim(filename)) order by listed_at desc) r from tree_categorised) where r = 1),
b as (select * from (select *, lower(trim(filename)) k, row_number() over (partition by stream, lower(trim(filename)) order by listed_at desc) r from tree_uncategorised) where r = 1),
j as (select coalesce(a.stream, b.stream) stream, coalesce(a.k, b.k) file_key, a.k is null as no_a, b.k is null as no_b,
  lower(trim(a.sha256)) is distinct from lower(trim(b.sha256)) d1, a.bytes is distinct from b.bytes d2, a.n_rows is distinct from b.n_rows d3,
  ((a.duration_s is null) <> (b.duration_s is null)) or coalesce(abs(a.duration_s - b.duration_s) > 0.0005, false) d4,
  lower(trim(a.header_style)) is distinct from lower(trim(b.header_style)) d5, a.modified_at is distinct from b.modified_at d6
  from a full join b on a.stream = b.stream and a.k = b.k)
select stream, file_key, 'only_categorised' as field_name from j where no_b union all select stream, file_key, 'only_uncategorised' from j where no_a
union all select stream, file_key, 'sha256' from j where not no_a and not no_b and d1 union all select stream, file_key, 'bytes' from j where not no_a and not no_b and d2
union all select stream, file_key, 'n_rows' from j where not no_a and not no_b and d3 union all select stream, file_key, 'duration_s' from j where not no_a and not no_b and d4
union all select stream, file_key, 'header_style' from j where not no_a and not no_b and d5 union all select stream, file_key, 'modified_at' from j where not no_a and not no_b and d6"""
