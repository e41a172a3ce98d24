"""Grids, drifting schemas, implausible values and differing copies on small fixtures, against brute force."""

import random
from datetime import datetime, timedelta

import brute
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tracklathe.functions.labels import plain, resolve
from tracklathe.operators import drifting_schema as drift
from tracklathe.operators.copies import copy_differences, current
from tracklathe.operators.implausible import implausible
from tracklathe.operators.regrid import regular_grid

READING = "sequence string, t double, x double, extra string, _key string, period long"


def _grid(spark, rows, **more):
    df = spark.createDataFrame([(s, t, x, "e", "k", 1) for s, t, x in rows], READING)
    return {(r.sequence, r.period): (r.status, r.x) for r in regular_grid(df, "sequence", "t", ["x"], ["x"], **more).collect()}


@pytest.mark.parametrize("seed", range(3))
def test_grid_is_the_brute_one(spark, seed):
    rng, rows, want = random.Random(seed), [], {}
    for s in ("a", "b"):
        t, own = rng.uniform(-5000, 5000), []
        for _ in range(120):
            t += rng.choice([37.0, 100.0, 900.0, 1700.0, 2900.0, 3000.5, 4200.0, 45_000.0])
            own.append((s, t, rng.uniform(-3, 3)))
        rows += own
        want |= {(s, k): v for k, v in brute.grid([r[1] for r in own], [r[2] for r in own], 1000.0, 3000.0).items()}
    rows += rng.sample(rows, 20)
    rng.shuffle(rows)
    got = _grid(spark, rows, shard_periods=30)
    assert got.keys() == want.keys()
    for k, (status, value) in want.items():
        assert got[k][0] == status and (value is None and got[k][1] is None or got[k][1] == pytest.approx(value, abs=1e-9)), k


def test_grid_of_odd_rows(spark):
    assert _grid(spark, []) == {}
    assert _grid(spark, [("a", None, 1.0), (None, 5.0, 1.0), ("a", 5.0, None), ("a", float("nan"), 2.0)]) == {}
    # one stamp twice with two values: the mean; a lone reading holds for its second
    assert _grid(spark, [("a", 1200.0, 1.0), ("a", 1200.0, 3.0)]) == {("a", 1): ("observed", 2.0)}
    assert _grid(spark, [("a", 999.0, 1.0), ("a", 9000.0, 5.0)]) == {("a", 0): ("observed", 1.0), **{("a", k): ("gap", None) for k in range(1, 9)}, ("a", 9): ("observed", 5.0)}
    with pytest.raises(ValueError):
        _grid(spark, [("a", 1.0, 1.0)], max_gap_ms=500)


FILES = "file_id long, feed string, record_kind string, sequence string, written_at timestamp_ntz, received_at timestamp_ntz, payload string, field string"
KNOWN = frozenset({("imu", plain("accel_x"), "accel_x"), ("imu", plain("light_lux"), "light_lux"), ("axis", "stem", "stem"), ("axis", "corr", "corr")})
T0 = datetime(2031, 1, 1)


def _changes(spark, payloads, kind="imu", block_days=64):
    rows = [(i + 1, "f", kind, "s", T0 + timedelta(days=40 * i), T0, p, "clash") for i, p in enumerate(payloads)]
    records = drift.read_records(spark.createDataFrame(rows + rows[:1], FILES), KNOWN)
    return {(r.file_id, r.field_name, r.change_kind) for r in drift.changes(records, block_days).collect()}


@pytest.mark.parametrize("block_days", [1, 1000])
def test_layout_changes(spark, block_days):
    got = _changes(spark, [
        "accel_x,Light (lx)\n1.5,3\n", "﻿ ACCEL_X ;\"LIGHT  (LX)\"\r\n2.5;\r\n", "Accelerometer X,light (lx)\r1,4.5\r", "light (lx)\n\"true\"\n", "accel_x,light (lx)\n\"9\",\n", "accel_x,light (lx)\n9,2\n",
    ], block_days=block_days)
    assert got == {(3, "accel_x", "renamed"), (3, "accel_x", "retyped"), (3, "light_lux", "retyped"), (4, "accel_x", "removed"), (4, "light_lux", "retyped"), (5, "accel_x", "added"), (6, "light_lux", "retyped")}


def test_json_layouts_and_odd_payloads(spark):
    got = _changes(spark, ['{"stem": "a", "corr": [0.1, 2]}\n{"stem": null, "corr": null}', '{"Stem ": "b", "corr_by": 3}\nnot json', None, "", '{"stem": {"deep": true}}'], "axis")
    assert (2, "corr", "renamed") in got and (2, "corr", "retyped") in got and (3, "stem", "removed") in got and (5, "stem", "added") in got
    empty = drift.read_records(spark.createDataFrame([], FILES), KNOWN)
    assert drift.changes(empty).count() == 0 and drift.typed(empty, "imu", [("accel_x", "decimal")]).count() == 0


def test_typed_table_and_failed_casts(spark):
    rows = [(1, "f", "imu", "s", T0, T0, "accel_x,charging,Unknown thing\n1.5 m/s2,plugged,x\nabc,not plugged,y\n", "c")]
    records = drift.read_records(spark.createDataFrame(rows, FILES), KNOWN)
    out = [(r.accel_x, r.charging) for r in drift.typed(records, "imu", [("accel_x", "decimal"), ("charging", "flag")]).orderBy("row_no").collect()]
    assert out == [(1.5, True), (None, False)]
    failed = drift.failed_casts(records, {"accel_x": "decimal", "charging": "flag"}).collect()
    assert [(r.field_name, r.n_failed, r.example) for r in failed] == [("accel_x", 1, "abc")]


def test_labels():
    cases = {"GYROSCOPE Y (rad/s)": "gyro_pitch", "timeSinceStart_ms": "time_since_start_ms", "Orientation (Azimuth) (deg)": "orientation_yaw", "gps.course": "gps_orientation_deg", "Sat count": "gps_sats", "Barometer [hPa]": "pressure_hpa", "nonsense": None}
    assert {k: resolve(k, "imu", frozenset()) for k in cases} == cases
    assert resolve("residualShippedRms", "axis", frozenset()) == "residual_shipped_rms"


SERIES = "table_name string, row_id long, source string, field_name string, at double, value double, block long, centre double, out string"


@pytest.mark.parametrize("width", [3, 50, 10_000])
def test_implausible_values(spark, width):
    rng, rows, series, row = random.Random(5), [], {}, 0
    for source in ("a", "b", "c"):
        x = 0.0
        for i in range(400):
            row += 1
            x = 0.7 * x + rng.gauss(0, 1)
            v = 20 + x
            if rng.random() < 0.01:
                v += rng.choice([-1, 1]) * rng.uniform(40, 4000)
            if 100 <= i < 107 or 300 <= i < 304:
                v = 21.5
            if rng.random() < 0.01:
                v = -5.0
            rows.append(("t", row, source, "gps_speed_mps", float(i), v, i // width, 1.0, "x"))
            series.setdefault(("t", source, "gps_speed_mps"), []).append((float(i), row, v))
    df = spark.createDataFrame(rows + rows[::7] + [("t", 9999, "a", "gps_speed_mps", 1.0, None, 0, 1.0, "x"), ("t", 9998, None, "gps_speed_mps", None, float("nan"), 0, 1.0, "x")], SERIES)
    got = {(r.table_name, r.row_id, r.field_name) for r in implausible(df, F.col("value") >= 0, ["gps_speed_mps"]).collect()}
    assert got == brute.spikes(series, lambda f, v: v >= 0)


@pytest.mark.parametrize("phi, length", [(0.9, 6), (0.9, 20), (0.98, 20)])
def test_implausible_runs_are_found_whole(spark, phi, length):
    rng, x, values = random.Random(11), 0.0, []
    for _ in range(3000):
        x = phi * x + rng.gauss(0, 1)
        values.append(x)
    level = sum(values) / len(values)
    spread = (sum((v - level) ** 2 for v in values) / len(values)) ** 0.5
    shifted = set(range(1500, 1500 + length))
    rows = [("t", i, "a", "gps_lat", float(i), level + 11.3 * spread + 0.3 * (v - level) if i in shifted else v, i // 700, 1.0, "x") for i, v in enumerate(values)]
    got = implausible(spark.createDataFrame(rows, SERIES), F.lit(True), [])
    assert {r.row_id for r in got.collect()} == shifted


def test_implausible_goes_by_the_autoregression(spark):
    """A slow climb is no case, however far a trimmed spread would put it; a jump of the same height and the way it is left are told apart."""
    rng, x, v = random.Random(3), 0.0, []
    for i in range(6000):
        x = 0.9 * x + rng.gauss(0, 1)
        v.append(x + 40 * max(0.0, 1 - abs(i - 1500) / 450))
    jump, run = {4000}, set(range(5000, 5012))
    v = [y + 150 * (i in jump) + 140 * (i in run) for i, y in enumerate(v)]
    df = spark.createDataFrame([("t", i, "a", "gps_lat", float(i), y, i // 512, 1.0, "x") for i, y in enumerate(v)], SERIES)
    got = {r.row_id: r.reason for r in implausible(df, F.lit(True), []).collect()}
    assert got == {4000: "spike"} | {i: "shift" for i in run}
    assert implausible(df, F.lit(True), [], shock=1e9).count() == 0


def test_implausible_without_rows_or_spread(spark):
    empty = spark.createDataFrame([], SERIES)
    assert implausible(empty, F.col("value") >= 0, []).count() == 0
    flat = spark.createDataFrame([("t", i, "s", "gps_lat", float(i), 3.0, 0, 1.0, "x") for i in range(20)], SERIES)
    assert implausible(flat, F.col("value") >= 0, ["gps_speed_mps"]).count() == 0


LISTING = "stream string, filename string, sha string, bytes long, duration_s double, at long, bucket int"
FIELDS = {"sha": "text", "bytes": "number", "duration_s": "number"}


def _copies(spark, a, b, **more):
    key = [F.col("stream"), F.lower(F.trim("filename"))]
    sides = [current(spark.createDataFrame(x, LISTING), key, ["stream", "file_key"], "at", list(FIELDS)) for x in (a, b)]
    return {(r.stream, r.file_key, r.field_name): r.delta for r in copy_differences(*sides, ["stream", "file_key"], FIELDS, {"duration_s": 0.0005}, **more).collect()}


def test_copies(spark):
    a = [("S", "A.csv", "ab", 5, 1.0, 1, 0), ("S", "a.CSV", "ab", 6, 1.0, 2, 0), ("S", "b", " X ", 1, 2.0, 1, 0), ("S", "c", None, 1, None, 1, 0), ("S", "d", "q", None, 3.0, 1, 0), (None, "e", "q", 1, 1.0, 1, 0)]
    b = [("S", "a.csv", "AB", 9, 1.0004, 1, 0), ("S", "b", "x", 1, 2.001, 1, 0), ("S", "c", None, 1, None, 1, 0), ("S", "d", "q", 1, 3.0, 1, 0), ("V", "z", "q", 1, 1.0, 1, 0), (None, "e", "q", 1, 1.0, 1, 0)]
    want = {("S", "a.csv", "bytes"): 3.0, ("S", "b", "duration_s"): pytest.approx(0.001), ("S", "d", "bytes"): None, ("V", "z", "only_right"): None}
    assert _copies(spark, a + a[:2], b) == want
    assert _copies(spark, a, []) == {("S", k, "only_left"): None for k in ("a.csv", "b", "c", "d")} | {(None, "e", "only_left"): None}
    assert _copies(spark, [], []) == {}


def test_copies_of_many_rows(spark):
    rng = random.Random(1)
    a = [("S", f"f{i:05d}", f"h{i}", i, i / 7, 1, 0) for i in range(3000)]
    b, want = [], set()
    for r in a:
        roll = rng.random()
        if roll < 0.01:
            want.add((r[0], r[1], "only_left"))
        elif roll < 0.02:
            b.append((*r[:3], r[3] + 1, *r[4:]))
            want.add((r[0], r[1], "bytes"))
        else:
            b.append(r)
    assert _copies(spark, a, b, mask=7).keys() == want


def test_first_change_of_brute_force(spark):
    files = pd.DataFrame([(1, "f", "imu", T0, "accel_x\n1.5"), (2, "f", "imu", T0 + timedelta(days=1), "Accel X\n1")], columns=["file_id", "feed", "record_kind", "written_at", "payload"])
    assert brute.layout_changes(files, lambda x, k: resolve(x, k, frozenset())) == {(2, "accel_x", "renamed"), (2, "accel_x", "retyped")}


def test_chunks_are_cut_by_content(spark):
    """One added row moves only the cuts near it; each of the rolling hash's keys has a say in a cut."""
    from tracklathe.operators.copies import chunked

    keys = [f"k{i:05d}" for i in range(4000)]
    ends = lambda ks: {k for r in chunked(spark.createDataFrame([(k,) for k in ks], "k string"), ["k"], 1).groupBy("chunk").agg({"k": "max"}).collect() for k in [r["max(k)"]]}
    whole = ends(keys)
    assert 4000 / 64 / 2 < len(whole) < 4000 / 64 * 2
    moved = [0, 0, 0]
    for at in range(100, 3900, 190):
        other = ends(keys[:at] + [keys[at - 1] + "x"] + keys[at:]) ^ whole
        near = {keys[at - 1] + "x", *keys[at:at + 3]}
        assert other <= near
        for i in range(3):
            moved[i] += keys[at + i] in other
    gone = [ends(keys[:at] + keys[at + 1:]) ^ whole for at in [keys.index(k) - 2 for k in sorted(whole)[1:9]]]
    assert sum(bool(g) for g in gone) > 5  # a cut goes when a neighbour of its row does
