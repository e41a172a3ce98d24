"""The event stream as recordings, shared by the plans, in both engines."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracklathe.operators.blocked import indexed
from tracklathe.session import table

#: Samples of warm-up and the window lengths of the sweep, in samples.
WARMUP, LENGTHS = 10, [5, 10, 20]


def with_events(statement: str) -> str:
    """The statement with the event stream's definition in front where it speaks of it."""
    if not re.search(r"\bev\b", statement):
        return statement
    if statement.startswith("with recursive "):
        return "with recursive " + EV + ", " + statement[15:]
    return "with " + EV + (", " + statement[5:] if statement.startswith("with ") else " " + statement)


def registry():
    queries, sql = {}, {}

    def query(statement: str | None = None):
        def add(f):
            queries[f.__name__] = f
            if statement:
                sql[f.__name__] = with_events(statement.strip())
            return f

        return add

    return queries, sql, query


def micros(column: str) -> Column:
    """Microseconds since 1970 of a stamp without zone, whatever the session's zone."""
    return F.expr(f"timestampdiff(microsecond, timestamp_ntz '1970-01-01 00:00:00', cast({column} as timestamp_ntz))")


def events(spark: SparkSession, sf: str) -> DataFrame:
    """One row an event: its user as ``seq``, seconds since the user's first event, sample index, value, position. Users are ranked by days."""
    us = micros("ts")
    e = indexed(table(spark, sf, "events"), ["user_id"], F.to_date("ts"), ["ts", "event_id"], "sample_idx", us)
    k = F.get_json_object("props", "$.k").cast("int")
    return e.select(
        "event_id", F.col("user_id").alias("seq"), F.col("event_type").alias("kind"), F.col("value").alias("v"), k.alias("k"), us.alias("us"),
        ((us - F.col("_least")) / 1e6).alias("t_s"), "sample_idx",
        (52.4 + (k - 50) * 1e-4).alias("lat"), (-1.5 + (F.col("value") - 250) * 1e-5).alias("lon"),
    )


EV = """ev as (select event_id, user_id as seq, event_type as kind, value as v, cast(json_extract_string(props, '$.k') as int) as k, epoch_us(ts) as us,
  (epoch_us(ts) - min(epoch_us(ts)) over (partition by user_id)) / 1e6 as t_s, row_number() over (partition by user_id order by ts, event_id) - 1 as sample_idx,
  52.4 + (cast(json_extract_string(props, '$.k') as int) - 50) * cast(1e-4 as double) as lat, cast(-1.5 as double) + (value - 250) * cast(1e-5 as double) as lon from events)"""


def r6(c) -> Column:
    return F.round(c, 6)
