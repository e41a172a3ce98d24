"""Scans, guards, documents and sinks on files made here."""

import json

import pytest
from pyspark.sql import functions as F

from tracklathe import sinks
from tracklathe.functions.text import LeakageError
from tracklathe.sources import documents, recordings

HEAD = "Time since start (ms),ACCELEROMETER X (m/s²),GPS Latitude (deg),GPS Longitude (deg),Satellites in range,Date (yyyy-mm-dd hh-mi-ss_sss)"


def test_recording(spark, tmp_path):
    p = tmp_path / "S-a.csv"
    p.write_bytes((HEAD + "\n1,0.5,1.0,2.0,7,2032-01-01 00-00-00_000\n2,,1.0,2.0,8,x\n3,0.7,,,8,\n4,0.8,1.5,2.0,8,x\n").encode("latin-1"))
    rows = recordings.recording(spark, str(p)).orderBy("sample_idx")
    assert [(r.sample_idx, r.accel_x, r.gps_sats) for r in rows.collect()] == [(0, 0.5, 7), (1, None, 8), (2, 0.7, 8), (3, 0.8, 8)]
    assert [r.sample_idx for r in recordings.distinct_fixes(rows).orderBy("sample_idx").collect()] == [0, 3]
    bad = tmp_path / "bad.csv"
    bad.write_text(HEAD.replace("²", "2") + ",Wheel Speed\n1,1,1,1,1,x,9\n")
    with pytest.raises(LeakageError, match="wheel"):
        recordings.recording(spark, str(bad))
    assert recordings.first_line(spark, str(bad)).startswith("Time since")


def test_track_and_sidecar(spark, tmp_path):
    head = " Time Since Start of Day (seconds), GPS Latitude (degrees), GPS Longitude (degrees), Wheel Speed Front Left (rad/sec)\n"
    p = tmp_path / "V-a.csv"
    p.write_text(head + "1,1,1,9\n2,1,,9\n1,1,1,9\n3,1,1,9\n")
    t = recordings.track(spark, str(p))
    assert t.columns == ["time_of_day_s", "gps_lat", "gps_lon", "file", "sample_idx"] and [r.time_of_day_s for r in t.orderBy("sample_idx").collect()] == [1.0, 3.0]
    p.write_text(head + "5,1,1,9\n1,1,1,9\n2,1,1,9\n")
    with pytest.raises(Exception, match="back in time"):
        recordings.track(spark, str(p)).collect()
    s = tmp_path / "raw.csv"
    s.write_text(",".join(recordings.SIDECAR) + "\nmagnetometer,309988136818280,309988142043344,3,1,2,3,,,\n")
    assert recordings.is_sidecar(spark, str(s)) and recordings.sidecar(spark, str(s)).first().event_ns == 309988136818280
    assert not recordings.is_sidecar(spark, str(p))
    with pytest.raises(ValueError):
        recordings.sidecar(spark, str(p))
    assert recordings.checksums(spark, str(s)).first().bytes == s.stat().st_size


def test_manifest(spark):
    m = spark.createDataFrame([("S-", "x/Synchronised/Uncategorised/s-Ab1.csv", "1"), ("S-", "x/Synchronised/Categorised/S-AB1.csv", "2"), ("V-", "x/Synchronised/Categorised/V-ab1.csv", "3")], "stream string, path string, sha256 string")
    assert tuple(recordings.manifest_pick(m, "ab1", "S-").first()) == ("s-ab1", "x/Synchronised/Categorised/S-AB1.csv", 2)
    assert [r.stem for r in recordings.missing(m, spark.createDataFrame([("AB1",), ("zz",)], "stem string")).collect()] == ["zz"]


def test_documents(spark):
    one = lambda x: spark.createDataFrame([(json.dumps(x),)], "value string")
    t = documents.tunnels(one({"schema": "tunnels/1", "tunnels": [{"id": "a", "name": "A", "points": [{"lat": 0.0, "lon": 0.0}, {"lat": None, "lon": 1.0}, {"lat": 0.0, "lon": 0.01}]}, {"id": "b", "points": [{"lat": 0.0, "lon": 0.0}]}]}), "tunnels/1").collect()
    assert [(r.id, round(r.length_m, 1), len(r.points)) for r in t] == [("a", 1113.2, 2)]
    e = documents.trajectories(one({"schema": "trajectory/1", "sequence": "s", "length_s": 60, "start_idx": 3, "epochs": [{"t_s": 0.0, "est": [1, 2], "truth": [1, 1], "sigma": 0.1}]}), "trajectory/1").first()
    assert (e.sequence, e.epoch, e.est) == ("s", 0, [1.0, 2.0])
    with pytest.raises(Exception, match="unknown schema"):
        documents.trajectories(one({"schema": "other/9"}), "trajectory/1").collect()
    hit = {"geometry": {"coordinates": [77.2, 28.6]}, "properties": {"osm_id": 1, "name": "Gate", "street": " ", "city": "Delhi", "countrycode": "in"}}
    assert [(r.title, r.subtitle, r.lat) for r in documents.photon(one({"features": [hit, hit | {"properties": {"name": " "}}]}), country="IN").collect()] == [("Gate", "Delhi", 28.6)]
    assert [(r.title, r.subtitle) for r in documents.nominatim(one([{"place_id": 2, "display_name": "Gate, A, B, C, D", "lat": "28.6", "lon": "77.2"}, {"place_id": 3, "display_name": "X", "lat": "bad", "lon": "1"}])).collect()] == [("Gate", "A, B, C")]
    r = documents.routes(one({"code": "Ok", "routes": [{"distance": 10.0, "duration": 2.0, "geometry": {"coordinates": [[1.0, 2.0]]}, "legs": [{"steps": [{"distance": 10.0, "name": "Ring", "maneuver": {"type": "turn", "modifier": "left", "location": [1.0, 2.0]}}]}]}]})).first()
    assert r.steps[0].instruction == "Turn left onto Ring" and (r.points[0].lat, r.points[0].lon) == (2.0, 1.0)
    f = documents.fallback_route(spark.createDataFrame([(0.0, 0.0, 1.0, 2.0)], "lat1 double, lon1 double, lat2 double, lon2 double")).first()
    assert len(f.points) == 17 and f.points[8].lat == 0.5


def test_sinks(spark, tmp_path):
    stamp = sinks.Stamp("a" * 40, False, 7, "2031-01-01T00:00:00+00:00", "v")
    df = spark.createDataFrame([(2, 1.23456789), (1, 2.0)], "k long, x double")
    sinks.write_table(df, str(tmp_path / "t"), stamp)
    assert spark.read.parquet(str(tmp_path / "t")).where("stamp_reproducible and stamp_seed = 7").count() == 2
    with pytest.raises(Exception, match="exist"):
        sinks.write_table(df, str(tmp_path / "t"), stamp)
    sinks.write_text(df, str(tmp_path / "c"), stamp, ["k"])
    text = next((tmp_path / "c").glob("*.csv")).read_text().splitlines()
    assert text[1].startswith("1,2.0,") and text[2].startswith("2,1.23457,")
    assert [tuple(r) for r in sinks.dead_letters(df.where("k = 1"), "truth_gap", ["k"], F.lit("none near")).collect()] == [("truth_gap", "1", "none near")]
    seen = []
    sinks.write_session(df, str(tmp_path / "s"), stamp, lambda: seen.append(spark.read.json(str(tmp_path / "s")).first().status))
    assert seen == ["recording"] and spark.read.json(str(tmp_path / "s")).first().status == "complete"
    assert not sinks.Stamp("none", True, 1, "", "").reproducible and sinks.Stamp.make(3).seed == 3
