"""One handler, two ways to run it: over a stream with kept state, and over a table in order.

A handler is a pair of functions: ``begin()`` gives a fresh state (a dict of plain values), ``on(state, event)`` changes
it and returns zero or more output rows for one event (a dict). Time is always the event's, never the machine's.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tracklathe.session import scratch

Handler = tuple[Callable[[], dict], Callable[[dict, dict], list[dict]]]


def _rows(out: list[dict], names: list[str]) -> pd.DataFrame:
    return pd.DataFrame({n: pd.array([r[n] for r in out], dtype=object) for n in names})


def _events(pdf: pd.DataFrame) -> list[dict]:
    return pdf.astype(object).where(pdf.notna(), None).to_dict("records")


def replay(events: DataFrame, key: str, order: list[str], handler: Handler, schema: str) -> DataFrame:
    """The handler over each key's events in order, as a batch.

    Rows are hashed by key and sorted inside the partition, then pass through in Arrow batches with only the state kept,
    so a key of any length needs no more memory than a batch. ``order`` must be a total order within a key.
    """
    begin, on = handler
    names = [f.split()[0] for f in schema.split(",")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, state = object(), {}
        for batch in batches:
            out = []
            for event in _events(batch):
                if event[key] != now:
                    now, state = event[key], begin()
                out += [{key: now} | r for r in on(state, event)]
            if out:
                yield _rows(out, names)

    return events.repartition(key).sortWithinPartitions(key, *order).mapInPandas(run, schema)


def stream(events: DataFrame, key: str, order: list[str], handler: Handler, schema: str) -> DataFrame:
    """The same handler over a streaming frame; the state of a key outlives its micro-batches as JSON.

    Events of one micro-batch are put in order; an event earlier than one of an older batch comes late and is handled
    when it comes.
    """
    begin, on = handler
    names = [f.split()[0] for f in schema.split(",")]

    def step(k: tuple, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        kept = json.loads(state.get[0]) if state.exists else begin()
        pdf = pd.concat(list(pdfs)).sort_values(order)
        out = [{key: k[0]} | r for event in _events(pdf) for r in on(kept, event)]
        state.update((json.dumps(kept),))
        if out:
            yield _rows(out, names)

    return events.groupBy(key).applyInPandasWithState(step, schema, "state string", "append", GroupStateTimeout.NoTimeout)


def closed(events: DataFrame, clock: str) -> tuple[DataFrame, Callable[[], None]]:
    """The stream under a watermark behind which nothing is late, and a call that sends the row which lets every window close.

    The row has nulls but for a time far ahead; it takes part in the result's last window, where its nulls tell it.
    """
    spark = events.sparkSession
    place = scratch(spark, "closing")
    row = spark.createDataFrame([(None,) * len(events.columns)], events.schema).withColumn(clock, F.to_timestamp(F.lit("3000-01-01")))
    row.where("false").write.parquet(place)
    both = events.unionByName(spark.readStream.schema(events.schema).parquet(place))
    return both.withWatermark(clock, "36500 days"), lambda: row.write.mode("append").parquet(place)


def drained(spark: SparkSession, out: DataFrame, schema: str, label: str, close: Callable[[], None] | None = None) -> DataFrame:
    """Runs a stream to the end of what its sources hold now, into a table in the shared folder; with ``close`` once more after it."""
    place = scratch(spark, label)
    for after in (None,) if close is None else (None, close):
        if after:
            after()
        q = out.writeStream.format("parquet").option("path", f"{place}/out").option("checkpointLocation", f"{place}/state").outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination()
    return spark.read.schema(schema).parquet(f"{place}/out")
