"""Guarded scans of recordings, tracks, sidecars and their manifest.

Headers are read first, mapped to plain names and held against an allowlist; only then are rows read, with an explicit
schema and malformed rows failing the read. A sample's index is its place in the unfiltered file.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracklathe.functions.labels import resolve
from tracklathe.functions.text import ALLOWED, BANNED, TRUTH, guard

#: Fixed value: the header of the raw sidecar.
SIDECAR = ["stream", "event_ns", "arrival_ns", "accuracy", "v0", "v1", "v2", "v3", "v4", "v5"]
TEXT_FIELDS, WHOLE_FIELDS = {"date"}, {"gps_sats"}


def first_line(spark: SparkSession, path: str) -> str:
    """A file's first line, without a byte-order mark; empty for an empty file."""
    rows = spark.read.option("encoding", "ISO-8859-1").csv(path, sep="\u0001", header=False, quote="").limit(1).collect()
    return (rows[0][0] or "").removeprefix("ï»¿").rstrip("\r") if rows else ""


def is_sidecar(spark: SparkSession, path: str) -> bool:
    """Whether a file is a raw sidecar, by its first line, not its name."""
    return [x.strip() for x in first_line(spark, path).split(",")] == SIDECAR


def _indexed(df: DataFrame) -> DataFrame:
    """Adds file and place: rows of a file in the order of its blocks and of the rows inside a block."""
    df = df.select("*", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_block")).withColumn("_at", F.monotonically_increasing_id())
    return df.withColumn("sample_idx", (F.row_number().over(Window.partitionBy("file").orderBy("_block", "_at")) - 1).cast("bigint")).drop("_block", "_at", "_metadata")


def _kind(name: str) -> T.DataType:
    return T.StringType() if name in TEXT_FIELDS else T.LongType() if name in WHOLE_FIELDS else T.DoubleType()


def recording(spark: SparkSession, path: str, allowed: list[str] = ALLOWED) -> DataFrame:
    """One phone recording under canonical names, with ``sample_idx``; a column that isn't allowed fails the whole file."""
    labels = [x.strip().strip('"') for x in first_line(spark, path).split(",")]
    # a vehicle-bus column keeps its own name, so that the lenient words of labels can't let it pass as another
    names = [x.lower() if re.search(BANNED, x, re.I) else resolve(x, "imu", frozenset()) or x.lower() for x in labels]
    guard(names, allowed, path)
    schema = T.StructType([T.StructField(n, _kind(n)) for n in names])
    rows = spark.read.schema(schema).options(header=True, encoding="ISO-8859-1", mode="FAILFAST", enforceSchema=True, ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True).csv(path)
    return _indexed(rows)


def distinct_fixes(rows: DataFrame) -> DataFrame:
    """The rows at which a recording's position changed; rows without position are left out first."""
    w = Window.partitionBy("file").orderBy("sample_idx")
    p = rows.where("gps_lat is not null and gps_lon is not null").withColumn("_a", F.lag("gps_lat").over(w)).withColumn("_b", F.lag("gps_lon").over(w))
    return p.where("_a is null or gps_lat <> _a or gps_lon <> _b").drop("_a", "_b")


def track(spark: SparkSession, path: str) -> DataFrame:
    """A reference track: time of day and position only, increasing against the row before; other columns are never read.

    A track that still goes back somewhere is refused.
    """
    labels = [x.strip() for x in first_line(spark, path).split(",")]
    want = {"time since start of day (seconds)": "time_of_day_s", "gps latitude (degrees)": "gps_lat", "gps longitude (degrees)": "gps_lon"}
    names = [want.get(" ".join(x.lower().split()), f"_banned{i}") for i, x in enumerate(labels)]
    missing = set(TRUTH) - set(names)
    if missing:
        raise ValueError(f"{path}: no {', '.join(sorted(missing))}")
    schema = T.StructType([T.StructField(n, T.DoubleType() if n in TRUTH else T.StringType()) for n in names])
    rows = _indexed(spark.read.schema(schema).options(header=True, encoding="ISO-8859-1", mode="FAILFAST", ignoreLeadingWhiteSpace=True).csv(path).select(*TRUTH, "_metadata"))
    guard([c for c in rows.columns if c not in ("file", "sample_idx")], TRUTH, path)
    w = Window.partitionBy("file").orderBy("sample_idx")
    rows = rows.dropna(subset=TRUTH).withColumn("_p", F.lag("time_of_day_s").over(w)).where("_p is null or time_of_day_s > _p").drop("_p")
    back = F.coalesce(F.col("time_of_day_s") <= F.lag("time_of_day_s").over(w), F.lit(False))
    return rows.withColumn("time_of_day_s", F.when(back, F.raise_error(F.lit("the track goes back in time")).cast("double")).otherwise(F.col("time_of_day_s")))


def sidecar(spark: SparkSession, path: str) -> DataFrame:
    """A raw sidecar; any other header is refused. Stamps stay whole nanoseconds."""
    if not is_sidecar(spark, path):
        raise ValueError(f"{path}: not a raw sidecar")
    kinds = {"stream": T.StringType(), "event_ns": T.LongType(), "arrival_ns": T.LongType(), "accuracy": T.LongType()}
    schema = T.StructType([T.StructField(n, kinds.get(n, T.DoubleType())) for n in SIDECAR])
    return _indexed(spark.read.schema(schema).options(header=True, mode="FAILFAST").csv(path))


def manifest_pick(manifest: DataFrame, stem: Column | str, stream: str) -> DataFrame:
    """The path of a stem's file in a stream, by name in any case; among copies a categorised one, then the first path."""
    base = F.lower(F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.csv$", ""))
    want = F.lower(F.concat(F.lit(stream), F.lit(stem) if isinstance(stem, str) else stem))
    hit = manifest.where((F.col("stream") == stream) & (base == want) & F.col("path").contains("Synchronised"))
    apart = F.col("path").contains("Uncategorised")
    return hit.groupBy(base.alias("file_key")).agg(F.min_by("path", F.struct(apart, "path")).alias("path"), F.count_distinct("sha256").alias("n_checksums"))


def missing(manifest: DataFrame, wanted: DataFrame) -> DataFrame:
    """Every wanted stem (``stem``) without a file, all at once."""
    base = F.lower(F.regexp_replace(F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.csv$", ""), "(?i)^[sv]-", ""))
    return wanted.join(manifest.select(base.alias("_s")).distinct(), F.lower("stem") == F.col("_s"), "left_anti")


def checksums(spark: SparkSession, path: str) -> DataFrame:
    """Path, size and SHA-256 of files."""
    return spark.read.format("binaryFile").load(path).select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))
