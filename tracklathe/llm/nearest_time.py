"""Matching records by nearest time: a stateful streaming join with buffers, horizons and eviction by entity."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tracklathe.session import scratch

DAY = 86_400_000_000_000
#: Width of a time bucket; an entity's rows are joined bucket by bucket, with the right side's rows near an edge in both.
BUCKET = 600_000_000_000
#: Anchors of up to this many bytes are broadcast; beyond it they are joined by salted key.
ANCHOR_BYTES = 16 << 20
SALTS = 16

OUT = "pair_kind string, entity string, left_id bigint, right_id bigint, distance_ns bigint"
STATE = "left binary, right binary, seen bigint"
ROW = "pair_kind string, entity string, is_left boolean, id bigint, t bigint, bucket bigint, at timestamp"
#: The stream's clock: rows carry its opening day, buckets time out a day later, the closing row lies beyond that.
OPEN, TIMEOUT, CLOSE = ("1970-01-11", 11 * 86_400_000, "1970-01-31")


def nearest(left: np.ndarray, right: np.ndarray, tolerance: int) -> tuple[np.ndarray, np.ndarray]:
    """For each left (id, t) the nearest right id and the distance, -1 where none is within the tolerance. Ties: the earlier, then the smaller id."""
    if not len(right) or not len(left):
        return np.zeros(len(left), np.int64), np.full(len(left), -1)
    right = right[np.lexsort((right[:, 0], right[:, 1]))]
    t, first = np.unique(right[:, 1], return_index=True)
    at = np.searchsorted(t, left[:, 1], side="right")
    lo, hi = np.clip(at - 1, 0, len(t) - 1), np.clip(at, 0, len(t) - 1)
    below, above = np.abs(left[:, 1] - t[lo]), np.abs(t[hi] - left[:, 1])
    pick = np.where(below <= above, lo, hi)
    far = np.minimum(below, above)
    return np.where(far <= tolerance, right[first[pick], 0], 0), np.where(far <= tolerance, far, -1)


def _join(tolerances: dict[str, int], lateness: int | None):
    def once(rows: np.ndarray) -> np.ndarray:
        return rows[np.unique(rows[:, 0], return_index=True)[1]] if len(rows) else rows

    def step(key: tuple, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        kind, entity, _ = key
        if kind not in tolerances:  # the closing row
            return
        tolerance, ends = tolerances[kind], state.hasTimedOut
        left = right = np.zeros((0, 2), np.int64)
        seen = -(1 << 62)
        if state.exists:
            a, b, seen = state.get
            left, right = (np.frombuffer(x, np.int64).reshape(-1, 2) for x in (a, b))
        if not ends:
            for pdf in pdfs:
                rows = pdf[["id", "t"]].to_numpy(np.int64)
                is_left = pdf["is_left"].to_numpy(bool)
                left, right = np.vstack([left, rows[is_left]]), np.vstack([right, rows[~is_left]])
                seen = max(seen, int(rows[:, 1].max()) if len(rows) else seen)
        left, right = once(left), once(right)
        # the bucket's own watermark; a left row is emitted once it has passed the row's horizon
        mark = (1 << 62) if ends else -(1 << 62) if lateness is None else seen - lateness
        due = left[:, 1] < mark - tolerance
        if due.any():
            ids, far = nearest(left[due], right, tolerance)
            yield pd.DataFrame({"pair_kind": kind, "entity": entity, "left_id": left[due][:, 0], "right_id": ids, "distance_ns": far})
        if ends:
            state.remove()
            return
        left, right = left[~due], right[right[:, 1] >= mark - 2 * tolerance]
        state.update((left.tobytes(), right.tobytes(), seen))
        state.setTimeoutTimestamp(TIMEOUT)

    return step


def _buckets(t: Column, tolerance: Column, is_left: Column, wrap: Column) -> Column:
    """The (bucket, t) pairs of a row: its own, and for a right row near an edge also the neighbour; around midnight with the day added or taken."""
    own, per_day = F.floor(t / BUCKET), DAY // BUCKET
    into = t - own * BUCKET
    pair = lambda b, x: F.struct(b.alias("bucket"), x.alias("t"))
    under = F.when(wrap & (own == 0), pair(F.lit(per_day - 1), t + DAY)).otherwise(pair(own - 1, t))
    over = F.when(wrap & (own == per_day - 1), pair(F.lit(0), t - DAY)).otherwise(pair(own + 1, t))
    return F.array_compact(F.array(pair(own, t), F.when(~is_left & (into <= tolerance), under), F.when(~is_left & (BUCKET - into <= tolerance), over)))


def _stream(spark: SparkSession, path: str, columns: list[str], a_batch: dict[str, str]) -> DataFrame:
    """The table as a stream of its files; a table may be one file or a folder of part files."""
    schema = spark.read.parquet(path).select(*columns).schema
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    reader = spark.readStream.schema(schema).options(**a_batch)
    if at.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(at).isDirectory():
        return reader.parquet(path)
    return reader.option("pathGlobFilter", at.getName()).parquet(at.getParent().toString())


def pairs(
    spark: SparkSession, raw_path: str, track_path: str, anchors: DataFrame,
    truth_tolerance: int = 50_000_000, gyro_tolerance: int = 4_000_000, lateness: int | None = None, a_batch: dict[str, str] | None = None,
) -> DataFrame:
    """Every left row with the nearest right row of its recording, or null: (pair_kind, entity, left_id, right_id, distance_ns).

    ``truth_accel``: a track row and an accelerometer row, by time of day on the recording's anchor, around midnight.
    ``accel_gyro``: an accelerometer row and a gyroscope row by device clock. Rows with a null id, recording or time, and
    raw rows with a null among v0, v1, v2, take no part; repeated rows count once. A recording without anchor has no
    truth pairs. Ties go to the earlier row.

    The tables are read as streams to their end, in micro-batches of ``a_batch`` (file source options, 64 GB a side by
    default). State is kept by (kind, recording, time bucket) in RocksDB, so a recording of any length is split: both sides
    are buffered, a left row is emitted when its bucket's watermark has passed its horizon, and right rows behind every open
    horizon are evicted. The watermark is the greatest time seen in the bucket less ``lateness``. By default nothing is ever
    late, as a table's files stand in any order: horizons then pass when the stream ends, whatever batches its rows came in.
    With a ``lateness`` state stays small, right rows later than that find no partner, and a left row that comes again
    after its pair was emitted counts by its nearest.

    Ends: the query is started once more with a closing row whose time lies beyond every bucket's timeout. The result is a
    table in the shared folder.
    """
    a_batch = {"maxBytesPerTrigger": str(64 << 30)} if a_batch is None else a_batch
    raw = _stream(spark, raw_path, ["raw_id", "sequence", "stream", "event_ns", "v0", "v1", "v2"], a_batch).where("v0 is not null and v1 is not null and v2 is not null and raw_id is not null and event_ns is not null")
    track = _stream(spark, track_path, ["truth_id", "sequence", "t_s"], a_batch).where("truth_id is not null and t_s is not null and not isnan(t_s)")
    accel, gyro = F.col("stream") == "accelerometer_uncalibrated", F.col("stream") == "gyroscope_uncalibrated"
    anchors = anchors.groupBy("sequence").agg(F.max("anchor_event_ns").alias("anchor_event_ns"), F.max("anchor_tod_s").alias("anchor_tod_s")).where("anchor_event_ns is not null and anchor_tod_s is not null")
    size = anchors.agg(F.coalesce(F.sum(F.octet_length("sequence") + 64), F.lit(0))).first()[0]
    salted = anchors.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))

    def anchored(df: DataFrame, at: Column) -> DataFrame:
        if size <= ANCHOR_BYTES:
            return df.join(F.broadcast(anchors), "sequence")
        return df.withColumn("salt", F.pmod(F.floor(at / BUCKET), F.lit(SALTS)).cast("int")).join(salted, ["sequence", "salt"])

    of_day = lambda ns: F.pmod(ns, F.lit(DAY))
    truth = anchored(track, F.col("t_s") * 1e9).select(
        F.lit("truth_accel").alias("pair_kind"), F.col("sequence").alias("entity"), F.lit(True).alias("is_left"), F.col("truth_id").alias("id"), of_day(F.round(F.col("t_s") * 1e9).cast("bigint")).alias("t"),
    )
    right = anchored(raw.where(accel), F.col("event_ns")).select(
        F.lit("truth_accel").alias("pair_kind"), F.col("sequence").alias("entity"), F.lit(False).alias("is_left"), F.col("raw_id").alias("id"),
        of_day(F.round(F.col("anchor_tod_s") * 1e9).cast("bigint") + F.col("event_ns") - F.col("anchor_event_ns")).alias("t"),
    )
    inertial = raw.where((accel | gyro) & F.col("sequence").isNotNull()).select(
        F.lit("accel_gyro").alias("pair_kind"), F.col("sequence").alias("entity"), accel.alias("is_left"), F.col("raw_id").alias("id"), F.col("event_ns").alias("t"),
    )
    rows = truth.unionByName(right).unionByName(inertial)
    truly = F.col("pair_kind") == "truth_accel"
    tolerance = F.when(truly, F.lit(truth_tolerance)).otherwise(F.lit(gyro_tolerance)).cast("bigint")
    rows = rows.select("pair_kind", "entity", "is_left", "id", F.explode(_buckets(F.col("t"), tolerance, F.col("is_left"), truly)).alias("b"))
    rows = rows.select("pair_kind", "entity", "is_left", "id", "b.t", "b.bucket", F.to_timestamp(F.lit(OPEN)).alias("at"))
    place = scratch(spark, "nearest-time")
    closing = spark.createDataFrame([("", "", True, 0, 0, 0)], ROW.removesuffix(", at timestamp")).withColumn("at", F.to_timestamp(F.lit(CLOSE)))
    closing.where("false").write.parquet(f"{place}/end")
    rows = rows.unionByName(spark.readStream.schema(ROW).parquet(f"{place}/end")).withWatermark("at", "2 days")
    step = _join({"truth_accel": truth_tolerance, "accel_gyro": gyro_tolerance}, lateness)
    joined = rows.groupBy("pair_kind", "entity", "bucket").applyInPandasWithState(step, OUT, STATE, "append", GroupStateTimeout.EventTimeTimeout)

    def drain() -> None:
        """Runs the stream to its present end; its plan and settings are fixed when it starts."""
        name, store = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
        before = spark.conf.get(name, None)
        spark.conf.set(name, store)
        try:
            stream = joined.writeStream.format("parquet").option("path", f"{place}/out").option("checkpointLocation", f"{place}/state").outputMode("append").trigger(availableNow=True).start()
        finally:
            spark.conf.set(name, before) if before else spark.conf.unset(name)
        stream.awaitTermination()

    drain()
    closing.write.mode("append").parquet(f"{place}/end")
    drain()
    found, near = spark.read.schema(OUT).parquet(f"{place}/out"), F.col("distance_ns") >= 0
    found = found.select("pair_kind", "entity", "left_id", F.when(near, F.struct("distance_ns", "right_id")).alias("p"))
    if lateness is not None:
        found = found.groupBy("pair_kind", "entity", "left_id").agg(F.min("p").alias("p"))
    return found.select("pair_kind", "entity", "left_id", "p.right_id", "p.distance_ns")
