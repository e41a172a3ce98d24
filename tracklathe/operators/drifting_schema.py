"""Schemas that drift between files: records as path-value cells, layouts by file, changes and typed tables."""

from __future__ import annotations

import csv
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracklathe.functions.labels import plain, resolve
from tracklathe.operators.blocked import previous
from tracklathe.session import cut, fixed_list

SEPARATORS = ",;\t|"
CELLS = "array<struct<label:string,field:string,kind:string,value:string>>"
RECORDS = f"file_id long, feed string, record_kind string, sequence string, written_at timestamp_ntz, row_no int, cells {CELLS}"
SPARK_TYPES = {"whole": "bigint", "decimal": "double", "flag": "boolean", "text": "string", "list": "array<double>"}


def kind_of_text(value: str) -> str | None:
    """The kind of a delimited value; null for an empty one."""
    v = value.strip()
    if not v or v.lower() in ("null", "none", "nan"):
        return None
    if re.fullmatch(r"[-+]?\d+", v):
        return "whole"
    if re.fullmatch(r"[-+]?(\d+\.\d*|\.\d+|\d+(?=[eE]))([eE][-+]?\d+)?", v):
        return "decimal"
    if v.lower() in ("true", "false"):
        return "flag"
    return "list" if v[0] == "[" and v[-1] == "]" else "text"


def kind_of_json(value: object) -> str | None:
    """The kind of a JSON value; null for null and for an empty text."""
    if value is None or isinstance(value, str) and not value.strip() or isinstance(value, float) and value != value:
        return None
    return {bool: "flag", int: "whole", float: "decimal", str: "text", list: "list"}.get(type(value), "text")


def delimited(payload: str) -> tuple[list[str], list[list[tuple[str | None, str | None]]]]:
    """Labels and records of delimited text: any of four separators, line ends, quotation marks, byte-order mark."""
    lines = [x for x in re.split(r"\r\n|\n|\r", payload.lstrip("﻿")) if x.strip()]
    if not lines:
        return [], []
    bare = re.sub(r'"[^"]*"', "", lines[0])
    sep = max(SEPARATORS, key=lambda s: (bare.count(s), -SEPARATORS.index(s)))
    rows = list(csv.reader(lines, delimiter=sep))
    records = []
    for row in rows[1:]:
        row = [*row, *[""] * (len(rows[0]) - len(row))]
        records.append([(k, v.strip() if k else None) for v in row for k in [kind_of_text(v)]])
    return rows[0], records


def _flat(value: dict, prefix: str = "") -> Iterator[tuple[str, object]]:
    for name, v in value.items():
        if isinstance(v, dict):
            yield from _flat(v, f"{prefix}{name}.")
        else:
            yield prefix + name, v


def objects(payload: str) -> tuple[list[str], list[list[tuple[str | None, str | None]]], int]:
    """Labels, records and unreadable lines of JSON lines; nested objects give paths joined by dots."""
    rows, bad = [], 0
    for line in re.split(r"\r\n|\n|\r", payload.lstrip("﻿")):
        if line.strip():
            try:
                row = json.loads(line)
                rows.append(dict(_flat(row))) if isinstance(row, dict) else None
                bad += not isinstance(row, dict)
            except ValueError:
                bad += 1
    labels = list(dict.fromkeys(x for row in rows for x in row))
    cell = lambda v: (k, (v if isinstance(v, str) else json.dumps(v)) if k else None) if (k := kind_of_json(v)) else (None, None)
    return labels, [[cell(row.get(x)) for x in labels] for row in rows], bad


def read_records(files: DataFrame, known: frozenset[tuple[str, str, str]]) -> DataFrame:
    """Every record of every payload as its cells; row -1 of a file holds its layout (label and field, no value).

    ``known`` holds (record kind, spelling, field) of the field list. A payload delivered twice is read once; null and
    empty payloads have an empty layout; lines that can't be read come out as row -2 with the count as value.
    """
    kinds = {k: frozenset((s, f) for r, s, f in known if r == k) for k in {r for r, _, _ in known}}
    cell = pa.struct([(x, pa.string()) for x in ("label", "field", "kind", "value")])
    schema = pa.schema([("file_id", pa.int64()), ("feed", pa.string()), ("record_kind", pa.string()), ("sequence", pa.string()), ("written_at", pa.timestamp("us")), ("row_no", pa.int32()), ("cells", pa.list_(cell))])

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for f in batch.to_pylist():
                kind, payload = (f["record_kind"] or "").strip().lower(), f.pop("payload") or ""
                labels, records, bad = objects(payload) if kind == "axis" or kind != "imu" and payload.lstrip("﻿ \r\n").startswith("{") else (*delimited(payload), 0)
                fields, taken = [], set()
                for x in labels:
                    field = resolve(x, kind, kinds.get(kind, frozenset()))
                    fields.append(None if field in taken else field)
                    taken.add(field)
                name = [x.replace("﻿", "") for x in labels]
                out.append(f | {"row_no": -1, "cells": [{"label": a, "field": b, "kind": None, "value": None} for a, b in zip(name, fields)]})
                if bad:
                    out.append(f | {"row_no": -2, "cells": [{"label": None, "field": None, "kind": None, "value": str(bad)}]})
                for i, r in enumerate(records):
                    out.append(f | {"row_no": i, "cells": [{"label": a, "field": b, "kind": k, "value": v} for a, b, (k, v) in zip(name, fields, r)]})
                if len(out) > 2000:
                    yield pa.RecordBatch.from_pylist(out, schema=schema)
                    out = []
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=schema)

    once = files.select("file_id", "feed", "record_kind", "sequence", F.col("written_at").cast("timestamp_ntz").alias("written_at"), "payload").dropDuplicates()
    return once.mapInArrow(parse, RECORDS)


def known_labels(channels: DataFrame) -> frozenset[tuple[str, str, str]]:
    """The fixed field list (some dozens of rows) as a lookup."""
    rows = channels.select("record_kind", "field_name", "sample_label").distinct()
    return frozenset((r.record_kind, plain(x), r.field_name) for r in fixed_list(rows) for x in (r.field_name, r.sample_label) if x)


def layouts(records: DataFrame) -> DataFrame:
    """One row for each file and field: its label, the kind of its values in the file (null without values), counts by kind.

    A file also has a row with a null field if it has a record, or a layout, without known fields.
    """
    cells = records.where("row_no >= -1").select("file_id", "feed", "record_kind", "written_at", F.explode_outer(F.filter("cells", lambda c: c["field"].isNotNull())).alias("c"))
    has = lambda k: F.count_if(F.col("c.kind") == k)
    stats = cells.groupBy("file_id", "feed", "record_kind", "written_at", F.col("c.field").alias("field")).agg(
        F.min("c.label").alias("label"), *[has(k).alias(f"n_{k}") for k in SPARK_TYPES]
    )
    number = (F.col("n_whole") > 0) | (F.col("n_decimal") > 0)
    mixed = number.cast("int") + sum((F.col(f"n_{k}") > 0).cast("int") for k in ("flag", "text", "list"))
    kind = F.when(mixed > 1, "text").when(F.col("n_decimal") > 0, "decimal")
    for k in ("whole", "flag", "text", "list"):
        kind = kind.when(F.col(f"n_{k}") > 0, k)
    return stats.withColumn("kind", kind)


def _day(name: str, days: int) -> Column:
    return F.floor(F.unix_date(F.col(name).cast("date")) / days)


def changes(records: DataFrame, block_days: int = 8) -> DataFrame:
    """Each file against the one written before it in its feed: fields added, removed, renamed, retyped.

    A feed's first file has none. A label that differs only in case and white space is the same; a field without values
    keeps the kind it had; a field that comes back is only added. Files of one stamp go by ``file_id``. Files with a null
    feed form one feed; files without id take no part. Feeds are worked through in blocks of ``block_days``, so a feed of any size is split.
    """
    order = ["written_at", "file_id"]
    each = cut(layouts(records))  # payloads are parsed once
    fields = each.where("field is not null").withColumn("plain", F.lower(F.regexp_replace("label", r"\s+", "")))
    fields = previous(fields, ["feed", "record_kind", "field"], order, _day("written_at", block_days), F.col("kind"), "had", F.col("kind").isNotNull())
    files = each.select("file_id", "feed", "record_kind", "written_at").distinct()
    files = previous(files, ["feed", "record_kind"], order, _day("written_at", block_days), F.col("file_id"), "before")
    files = files.where("before is not null").select("file_id", "before")
    now = files.join(fields.select("file_id", "field", "plain", "kind", "had"), "file_id")
    then = files.join(fields.select(F.col("file_id").alias("before"), "field", F.col("plain").alias("plain_before"), "label", "kind"), "before")
    then = then.select("file_id", "field", "plain_before", F.col("label").alias("label_before"))
    both = now.join(then, ["file_id", "field"], "full")
    change = F.array_compact(F.array(
        F.when(F.col("plain_before").isNull(), F.lit("added")),
        F.when(F.col("plain").isNull(), F.lit("removed")),
        F.when(F.col("plain") != F.col("plain_before"), F.lit("renamed")),
        F.when(F.col("plain").isNotNull() & F.col("plain_before").isNotNull() & (F.col("kind") != F.col("had")), F.lit("retyped")),
    ))
    return both.select("file_id", F.col("field").alias("field_name"), F.explode(change).alias("change_kind"), F.col("label_before"), F.col("had").alias("kind_before"), "kind")


def typed(records: DataFrame, record_kind: str, fields: list[tuple[str, str]]) -> DataFrame:
    """The records of a kind as one table: (field, kind) columns cast to the kind's type, failed casts null.

    Values with a unit after the number lose the unit. Fields that a file lacks are null.
    """
    rows = records.where((F.col("record_kind") == record_kind) & (F.col("row_no") >= 0))
    pairs = F.map_from_entries(F.transform(F.filter("cells", lambda c: c["field"].isNotNull() & c["value"].isNotNull()), lambda c: F.struct(c["field"], c["value"])))
    rows = rows.select("file_id", "feed", "sequence", "written_at", "row_no", pairs.alias("m"))
    return rows.select("file_id", "feed", "sequence", "written_at", "row_no", *[_cast(F.col("m")[f], k).alias(f) for f, k in fields])


def _cast(raw: Column, kind: str) -> Column:
    if kind == "list":
        return F.when(raw.startswith("["), F.from_json(raw, "array<double>")).otherwise(F.when(raw.try_cast("double").isNotNull(), F.array(raw.try_cast("double"))))
    if kind in ("whole", "decimal"):
        number = F.coalesce(raw.try_cast("double"), F.nullif(F.regexp_extract(raw, r"^\s*([-+]?\d+(?:\.\d+)?)\s+\D", 1), F.lit("")).try_cast("double"))
        return number.try_cast(SPARK_TYPES[kind]) if kind == "decimal" else F.round(number).try_cast("bigint")
    if kind == "flag":
        return F.coalesce(raw.try_cast("boolean"), F.when(F.lower(raw) == "plugged", True).when(F.lower(raw) == "not plugged", False))
    return raw


def failed_casts(records: DataFrame, fields: dict[str, str]) -> DataFrame:
    """For each file and field, the values that the field's kind can't hold, with one of them as an example."""
    cells = records.where("row_no >= 0").select("file_id", "feed", "record_kind", F.explode("cells").alias("c")).where("c.field is not null and c.value is not null")
    want = F.create_map(*[F.lit(x) for pair in fields.items() for x in pair])[F.col("c.field")]
    ok = F.when(want == "text", True).otherwise(False)
    for k in ("whole", "decimal", "flag", "list"):
        ok = F.when(want == k, _cast(F.col("c.value"), k).isNotNull()).otherwise(ok)
    return cells.where(~ok).groupBy("file_id", "feed", "record_kind", F.col("c.field").alias("field_name")).agg(F.count(F.lit(1)).alias("n_failed"), F.min("c.value").alias("example"))
