"""Closed forms, identities and invariants of the functions, kernels and machines."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracklathe.functions import geo, text
from tracklathe.kernels import inertial, lie
from tracklathe.operators.blocked import previous, ranked, tile
from tracklathe.operators.temporal import asof_join, islands
from tracklathe.streaming import machines


def run(handler, events):
    begin, on = handler
    s, out = begin(), []
    for e in events:
        out += on(s, e)
    return out, s


def test_geodesy(spark):
    rows = [(-37.95103341666667, 144.42486788888888, -37.65282113888889, 143.92649552777777), (28.60, 77.20, 28.60, 77.20), (None, 1.0, 2.0, 3.0)]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double")
    got = [r[0] for r in df.select(geo.vincenty(F.col("a"), F.col("b"), F.col("c"), F.col("d"))).collect()]
    assert got[0] == pytest.approx(54972.271, abs=0.01) and got[1] == 0.0 and got[2] is None
    angles = spark.createDataFrame([(x,) for x in (0.0, math.pi, -math.pi, 3 * math.pi, 2 * math.pi + 0.1)], "x double")
    assert [r[0] for r in angles.select(geo.wrap(F.col("x"))).collect()] == pytest.approx([0, math.pi, math.pi, math.pi, 0.1])
    e = spark.range(1).select(*geo.ellipse(F.lit(9.0), F.lit(0.0), F.lit(4.0)), geo.mahalanobis_squared(F.lit(3.0), F.lit(2.0), F.lit(9.0), F.lit(0.0), F.lit(4.0)), geo.mahalanobis_squared(F.lit(1.0), F.lit(1.0), F.lit(1.0), F.lit(1.0), F.lit(1.0))).first()
    assert tuple(e) == (3.0, 2.0, 0.0, 2.0, math.inf)


def test_guard_is_seen_to_fail():
    text.guard(["accel_x", "gps_lat"])
    with pytest.raises(text.LeakageError, match="wheel_speed"):
        text.guard(["accel_x", "wheel_speed"], context="file")
    with pytest.raises(text.LeakageError):
        text.guard(["accel_x", "gps_lat"], text.INERTIAL)
    assert issubclass(text.LeakageError, AssertionError)


def test_formats(spark):
    df = spark.createDataFrame([("2032-07-14 20-53-25_9", 0.0), ('"2032-07-14 20:53:25:000"', 359.0), ("x", 22.5), (None, 180.0)], "s string, d double")
    assert [tuple(r) for r in df.select(text.clock_seconds(F.col("s")), text.octant(F.col("d"))).collect()] == [(75205.9, "N"), (75205.0, "N"), (None, "NE"), (None, "S")]
    assert spark.range(1).select(text.hms(F.lit(3725.9)), text.distance_label(F.lit(999.0)), text.distance_label(F.lit(1450.0)), text.header(F.lit(" GPS  Speed (Kmh) "))).first()[0:4] == ("01:02:05", "999 m", "1.5 km", "gps_speed")


def test_blocked_operators(spark):
    rows = [("a", i, i * 10 if i % 3 else None, "x") for i in range(40)] + [(None, 5, 1, "x"), (None, 6, 2, "x")]
    df = spark.createDataFrame(rows, "k string, i long, v long, _near string").drop("_near")
    got = {(r.k, r.i): r.p for r in previous(df, ["k"], ["i"], F.floor(F.col("i") / 7), F.col("v"), "p", F.col("v").isNotNull()).collect()}
    last = None
    for _, i, v, _ in rows[:40]:
        assert got["a", i] == last
        last = v if v is not None else last
    assert got[None, 5] is None and got[None, 6] == 1
    placed = ranked(df.where("v is not null"), F.floor(F.col("v") / 50), [F.col("v"), F.col("k")], "place")
    assert sorted(r.place for r in placed.collect()) == list(range(1, 29))
    tiles = spark.range(1, 11).select(tile(F.col("id"), F.lit(10), 3).alias("t")).collect()
    assert [r.t for r in tiles] == [1, 1, 1, 1, 2, 2, 2, 3, 3, 3]


@pytest.mark.parametrize("width", [1.0, 1000.0])
def test_asof(spark, width):
    left = spark.createDataFrame([("a", 5.0, 1), ("a", 0.5, 2), ("b", 1.0, 3), ("a", None, 4), ("a", 7.0, 5)], "k string, t double, id int")
    right = spark.createDataFrame([("a", 1.0, 10), ("a", 5.0, 11), ("a", 5.0, 12), ("a", 9.0, 13), ("a", None, 14)], "k string, t double, id int")
    back = {r.id: r.r_id for r in asof_join(left, right, ["k"], "t", "id", width=width).collect()}
    assert back == {1: 12, 2: None, 3: None, 4: None, 5: 12}
    near = {r.id: r.r_id for r in asof_join(left, right, ["k"], "t", "id", "nearest", 2.0, width).collect()}
    assert near == {1: 12, 2: 10, 3: None, 4: None, 5: 12}
    runs = islands(spark.createDataFrame([("a", i, x) for i, x in enumerate([1, 1, 0, 1, 0, 0, 1])], "k string, i long, x int"), ["k"], "i", F.col("x") == 1)
    assert sorted((r.start, r.stop, r.n) for r in runs.collect()) == [(0, 2, 2), (3, 4, 1), (6, 7, 1)]


def _exp(m, terms=40):
    """A matrix exponential by its series, for small matrices in tests."""
    k = max(0, int(np.ceil(np.log2(max(np.abs(m).sum(axis=1).max(), 1e-9)))) + 1)
    out = term = np.eye(len(m))
    for i in range(1, terms):
        term = term @ (m / 2**k) / i
        out = out + term
    return np.linalg.matrix_power(out, 2**k)


def test_rotations():
    rng = np.random.default_rng(0)
    phi = rng.normal(size=(4, 5, 3))
    phi *= np.array([1e-6, 1e-2, 1.0, 3.0])[:, None, None] / np.linalg.norm(phi, axis=-1, keepdims=True)
    g0, g1, g2 = lie.gammas(phi)
    assert np.allclose(lie.log_so3(g0), phi, atol=1e-9)
    s = np.linspace(0, 1, 2001)
    for at in np.ndindex(4, 5):
        assert np.allclose(g0[at], _exp(lie.skew(phi[at])), atol=1e-12)
        assert np.allclose(g1[at], np.trapezoid(lie.gammas(s[:, None] * phi[at])[0], s, axis=0), atol=1e-5)
    assert np.allclose(g0, np.eye(3) + lie.skew(phi) @ g1, atol=1e-12) and np.allclose(g1, np.eye(3) + lie.skew(phi) @ g2, atol=1e-12)
    xi = np.concatenate([phi, rng.normal(size=(4, 5, 6))], axis=-1)
    assert np.allclose(lie.log_pose(*lie.exp_pose(xi)), xi, atol=1e-8)
    assert np.allclose(np.linalg.det(lie.orthonormal(np.array([np.diag([1.0, 1.0, -1.1]), 1.01 * np.eye(3)]))), 1.0)
    up = rng.normal(size=(20, 3))
    up /= np.linalg.norm(up, axis=1, keepdims=True)
    up[0], up[1] = [0, 0, 1], [0, 0, -1]
    assert np.allclose(np.einsum("nij,nj->ni", inertial.level(up), up), [0, 0, -1])


def test_discrete_noise_is_van_loan():
    rng = np.random.default_rng(1)
    a, n = np.zeros((2, 9, 9)), rng.normal(size=(9, 9))
    a[:, 3:6, :3], a[:, 6:, 3:6] = rng.normal(size=(2, 3, 3)), rng.normal(size=(2, 3, 3))
    q, dt = n @ n.T, np.array([0.3, 0.07])
    flow, noise = lie.discrete_noise(a, q, dt)
    for i in range(2):
        big = np.zeros((18, 18))
        big[:9, :9], big[:9, 9:], big[9:, 9:] = -a[i], q, a[i].T
        e = _exp(big * dt[i])
        assert np.allclose(flow[i], e[9:, 9:].T, atol=1e-10) and np.allclose(noise[i], e[9:, 9:].T @ e[:9, 9:], atol=1e-9)


UP = np.array([0.0, 0.0, -9.80665])


def _aligned(slots=1, speed=0.0, mount=np.eye(3)):
    f = inertial.Fleet(slots)
    for i in range(slots):
        f.start(i, inertial.Mount(mount, 0.0, 1.0, 0.05, True, 0.01), 0.0, speed)
        f.t[i] = 0.0
    return f


def test_filter_at_rest_and_with_fixes():
    rng, f, r = np.random.default_rng(2), _aligned(3), np.arange(3)
    bias = np.array([0.002, -0.001, 0.0015])
    for i in range(600):
        f.read(r, np.full(3, (i + 1) * 0.1), bias + rng.normal(0, 1e-4, (3, 3)), UP + rng.normal(0, 0.01, (3, 3)))
    assert (f.how == 1).all() and np.linalg.norm(f.v, axis=1).max() < 0.05 and np.allclose(f.bg, bias, atol=1e-3) and np.linalg.norm(f.p, axis=1).max() < 2
    assert np.linalg.eigvalsh(f.cov).min() > -1e-12
    g = inertial.Fleet.unpack(f.pack(r))
    assert all(np.array_equal(getattr(g, k), getattr(f, k)) for k in (*f.FIELDS, "g", "a", "t", "aligned"))
    far, one, three = np.array([[500.0, 0, 0]]), np.array([1]), np.array([3.0])
    assert [bool(f.fix(one, far, three)[0]) for _ in range(3)] == [False, False, True] and f.forced[1] == 1 and f.forced[0] == 0
    assert f.fix(one, f.p[one], three)[0]
    f.free[9:15] = 0.0  # biases held
    before = f.bg[0].copy()
    f.fix(np.array([0]), f.p[:1] + 2.0, three[:1])
    assert np.array_equal(f.bg[0], before)
    sure = f.cov[0, 15, 15]
    f.loosen(np.array([0]))
    assert f.cov[0, 15, 15] == pytest.approx(sure + f.c.knock**2)
    f.v[2] = [1e4, 0, 0]
    f.check(r)
    assert f.aligned.tolist() == [True, True, False] and f.lost.tolist() == [0, 0, 1]


def test_rows_of_a_fleet_do_not_touch():
    """A row's filter is the same alone as among others, whatever they do."""
    rng = np.random.default_rng(9)
    many, alone = _aligned(3, 8.0), _aligned(1, 8.0)
    for i in range(120):
        t, g, a = np.full(3, (i + 1) * 0.1), rng.normal(0, 0.02, (3, 3)), UP + rng.normal(0, 0.4, (3, 3))
        on = np.array([0, 1, 2]) if i % 3 else np.array([1])
        many.read(on, t[on], g[on], a[on])
        alone.read(np.array([0]), t[:1], g[1:2], a[1:2])
        if i % 10 == 0:
            many.aid(on, np.tile([0.8 * i, 0.0, 0.0], (len(on), 1)), np.full(len(on), 3.0), np.zeros(len(on)), np.full(len(on), 8.0))
            alone.aid(np.array([0]), np.array([[0.8 * i, 0.0, 0.0]]), np.array([3.0]), np.zeros(1), np.array([8.0]))
    for k in many.FIELDS:
        assert np.allclose(getattr(many, k)[1], getattr(alone, k)[0], atol=1e-9)


def _drive(seconds=240, hz=10, mount=0.9, tilt=0.2, bias=0.004, seed=6):
    """A level drive with changing speed and turns, read by a turned and tilted sensor: (events, true way, sensor to vehicle)."""
    rng, dt = np.random.default_rng(seed), 1 / hz
    t = np.arange(1, seconds * hz + 1) * dt
    speed = 12 + 4 * np.sin(t / 5) + 2 * np.sin(t / 2.3)
    yaw = 0.5 * np.sin(t / 11)
    forward, turn = np.gradient(speed, dt), np.gradient(yaw, dt)
    to = inertial.about_down(np.array(mount)) @ lie.gammas(np.array([tilt, -tilt / 2, 0.0]))[0]
    accel = np.column_stack([forward, speed * turn, np.full(len(t), -9.80665)]) @ to + rng.normal(0, 0.05, (len(t), 3))
    gyro = np.column_stack([0 * turn, 0 * turn, turn]) @ to + bias + rng.normal(0, 1e-3, (len(t), 3))
    way = np.cumsum(np.column_stack([speed * np.cos(yaw), speed * np.sin(yaw)]) * dt, axis=0)
    e = np.full((len(t), 14), np.nan)
    e[:, 0], e[:, 1], e[:, 2:5], e[:, 5:8] = np.arange(len(t)), t, gyro, accel
    fix = np.arange(len(t)) % hz == 0
    e[fix, 8:10], e[fix, 10], e[fix, 11], e[fix, 12], e[fix, 13] = way[fix] + rng.normal(0, 1, (fix.sum(), 2)), 0.0, 3.0, yaw[fix], speed[fix]
    return e, way, to


def test_alignment_finds_the_mount_and_beats_strapdown():
    e, way, to = _drive()
    t, speed = e[:, 1], np.repeat(e[::10, 13], 10)
    m = inertial.mount_fit(t[:600], e[:600, 5:8], e[:600, 2:5], speed[:600])
    off = lie.log_so3(m.rot @ to.T)
    assert m.resolved and abs(off[2]) < 0.1 and np.linalg.norm(off[:2]) < 0.08
    quiet = inertial.mount_fit(t[:600], np.tile(UP, (600, 1)) + np.random.default_rng(1).normal(0, 0.1, (600, 3)), e[:600, 2:5] * 0, speed[:600])
    assert not quiet.resolved
    f, blocks = inertial.Fleet(1), [e[i:i + 700] for i in range(0, len(e), 700)]
    snaps = []
    for b in blocks:
        rows, s = inertial.aided(f, np.array([0]), b, np.array([0, len(b)]), 50, 10)
        snaps += [(int(w), x) for _, ws, xs in s for w, x in zip(ws, xs)]
    assert f.aligned[0] and f.lost[0] == 0 and np.linalg.norm(f.p[0, :2] - way[-1]) < 8 and len({w for w, _ in snaps}) == 25
    state = {w: x for w, x in snaps}[15][None]
    part = e[(t >= 150) & (t <= 210)]
    run = lambda fleet, aiding: inertial.dead_reckoned(fleet, np.array([150.0]), np.array([60]), part, np.array([0, len(part)]), aiding)[0]
    true = way[np.searchsorted(t, 150 + np.arange(61) - 1e-9)]
    one = run(inertial.Fleet.unpack(state), True)
    free = inertial.Fleet.unpack(state)
    free.rot[0] = inertial.about_down(np.arctan2(*(true[1] - true[0])[::-1])) @ inertial.level(UP[None] / -UP[2])[0]
    two = run(free, False)
    error = lambda x: np.linalg.norm((x - x[0]) - (true - true[0]), axis=1)[-1]
    assert error(one) < 60 and error(two) > 3 * error(one)


def test_windows_replayed_are_the_pass_without_fixes():
    e, _, _ = _drive(100)
    e[750:, 8:] = np.nan  # no fix after 75 s
    e = np.delete(e, [i for i in range(760, 990) if i % 7 == 3], axis=0)  # readings are missing
    e[800, 2:8], e[810, 1] = np.nan, np.nan
    f = inertial.Fleet(1)
    snaps = []
    for lo in range(0, len(e), 333):
        b = e[lo:lo + 333]
        snaps += [(int(w), x) for _, ws, xs in inertial.aided(f, np.array([0]), b, np.array([0, len(b)]), 50, 10)[1] for w, x in zip(ws, xs)]
    state = {w: x for w, x in snaps}
    assert sorted(state) == list(range(11))
    part = e[(e[:, 1] >= 80) & (e[:, 1] <= 100)]
    g = inertial.Fleet.unpack(state[8][None])
    way = inertial.dead_reckoned(g, np.array([80.0]), np.array([20]), part, np.array([0, len(part)]), True)[0]
    assert np.allclose(g.p, f.p, atol=1e-6) and np.allclose(g.cov, f.cov, atol=1e-6) and not np.isnan(way).any()
    h = inertial.Fleet.unpack(np.array([state[8], state[9]]))
    parts = [part, part[part[:, 1] >= 90]]
    both = inertial.dead_reckoned(h, np.array([80.0, 90.0]), np.array([20, 10]), np.concatenate(parts), np.array([0, len(parts[0]), len(parts[0]) + len(parts[1])]), True)
    assert np.allclose(both[0], way, atol=1e-9) and np.isnan(both[1, 11:]).all() and np.allclose(both[1, :11], way[10:], atol=1e-6)


def test_gaps_and_fixes_count_whole():
    f, r = _aligned(1), np.array([0])
    still, none = np.array([UP]), np.full((1, 3), np.nan)
    for i in range(30):
        f.read(r, np.array([0.1 * (i + 1)]), np.zeros((1, 3)), still)
    steps, spread = f.steps[0], f.cov[0, 6, 6]
    f.read(r, np.array([13.0]), none, none)  # a stamp alone: ten seconds with the last reading
    assert f.steps[0] == steps + 10 and f.cov[0, 6, 6] > spread and f.t[0] == 13.0
    f.read(r, np.array([3613.0]), none, none)
    assert f.steps[0] == steps + 10 + f.c.steps and f.t[0] == 3613.0
    f.read(r, np.array([np.nan]), none, none)
    f.aid(r, np.array([[0.5, 0.0, 0.0]]), np.array([3.0]), np.array([np.nan]), np.array([np.nan]))
    assert f.fixes[0] == 1 and f.t[0] == 3613.0
    g = inertial.Fleet(1)
    g.aid(r, np.array([[7.0, 1.0, 0.0]]), np.array([3.0]), np.array([0.0]), np.array([9.0]))
    assert g.p[0].tolist() == [7.0, 1.0, 0.0] and not g.aligned[0]


def test_strapdown_of_a_tilt_error():
    e = np.full((600, 14), np.nan)
    e[:, 1], e[:, 2:5], e[:, 5:8] = np.arange(1, 601) * 0.1, 0.0, [0.0981, 0.0, -9.80665]
    f = _aligned(1)
    f.v[0] = 0.0
    way = inertial.dead_reckoned(f, np.zeros(1), np.array([60]), e, np.array([0, 600]), False)[0]
    assert way[-1, 0] == pytest.approx(0.5 * 0.0981 * 60**2, rel=0.01) and way[30, 0] == pytest.approx(0.5 * 0.0981 * 30**2, rel=0.01)  # ten milli-g over a minute: 176 m


def test_allan():
    rng = np.random.default_rng(3)
    curve = inertial.allan(rng.normal(size=20000), 0.1, [1, 2, 4, 8, 16, 32])
    slope = np.polyfit(np.log([c[0] for c in curve]), np.log([c[2] for c in curve]), 1)[0]
    assert slope == pytest.approx(-0.5, abs=0.05) and inertial.allan(np.ones(3), 0.1, [4]) == []


def _e(ms, kind, x=None, **more):
    return {"ms": ms, "kind": kind, "x": x} | more


def test_tunnel_machine():
    good = [_e(t, k, **m) for t in range(0, 3000, 500) for k, m in (("fix", {"verdict": "accepted"}), ("status", {"x": 35.0, "n": 8}))]
    out, _ = run(machines.tunnel(), [*good, _e(3000, "status", 20.0, n=3), _e(3100, "status", 10.0, n=1), _e(5000, "status", 30.0, n=6), _e(5100, "fix", verdict="accepted"), _e(5200, "fix", verdict="rejected"), _e(5300, "fix", verdict="accepted"), _e(5400, "fix", verdict="accepted"), *[_e(t, k, **m) for t in range(5600, 8200, 400) for k, m in (("fix", {"verdict": "accepted"}), ("status", {"x": 35.0, "n": 8}))]])
    assert [(r["ms"], r["trigger"], r["target"]) for r in out] == [(3000, "cn0_collapse", "armed"), (3100, "cn0_lost", "inside"), (5000, "cn0_recovered", "verify"), (5400, "chi2_pass", "rejoin"), (7600, "reconverged", "healthy")]
    dark, _ = run(machines.tunnel(), [*good, _e(2600, "light", 20000.0), _e(2700, "light", 50.0), _e(2750, "status", 22.0, n=5)])
    assert [r["trigger"] for r in dark] == ["lux_drop", "lux_drop"]
    piston, _ = run(machines.tunnel(), [*good, _e(2600, "pressure", 1000.0), _e(2700, "pressure", 1000.4)])
    assert [r["trigger"] for r in piston] == ["baro_piston"]
    silent, _ = run(machines.tunnel(), [_e(0, "fix", verdict="accepted"), _e(1300, "tick")])
    assert [r["trigger"] for r in silent] == ["gnss_timeout"]
    forced, _ = run(machines.tunnel(), [*good, _e(2600, "override", verdict="on"), _e(2700, "fix", verdict="accepted"), _e(2800, "override", verdict="auto")])
    assert [r["trigger"] for r in forced] == ["manual_on", "manual_off"] and forced[-1]["target"] == "verify"


def test_estimators():
    out, _ = run(machines.pace(), [{"id": 0, "ms": 0, "x": 20.0}, {"id": 1, "ms": 45_000, "x": 20.0}, {"id": 2, "ms": 90_000, "x": 0.0}])
    assert [r["pace"] for r in out] == pytest.approx([8.33, 8.33 + (1 - math.exp(-1)) * 11.67] * 1 + [8.33 + (1 - math.exp(-1)) * 11.67])
    out, _ = run(machines.slew(), [{"id": 0, "ms": 0, "jump": True, "dn": -100.0, "de": 3.0}, {"id": 1, "ms": 350, "jump": False, "dn": 0, "de": 0}, {"id": 2, "ms": 1050, "jump": False, "dn": 0, "de": 0}])
    assert [(r["north"], r["east"]) for r in out] == [(75.0, -3.0), (37.5, -1.5), (0.0, 0.0)]
    out, _ = run(machines.gate(), [{"id": i, "x": 20.0} for i in range(6)])
    assert [r["verdict"] for r in out] == ["rejected"] * 4 + ["forced", "rejected"]
    walk = [{"id": i, "ms": 100 * i, "kind": "accel", "x": 9.80665 + (2.5 if i % 6 == 3 else -1.0 if i % 6 == 0 else 0.0)} for i in range(60)]
    out, s = run(machines.motion(), walk)
    assert s["steps"] >= 8 and not s["still"]
    out, _ = run(machines.route([(0.0, 0.0), (0.0, 0.01)], [(0.0, 0.005), (0.0, 0.01)], 1112.0), [{"id": 0, "lat": 0.0, "lon": 0.0, "x": 0.0}, {"id": 1, "lat": 0.0, "lon": 0.005, "x": 10.0}, {"id": 2, "lat": 0.002, "lon": 0.006, "x": 10.0}, {"id": 3, "lat": 0.0, "lon": 0.00999, "x": 1.0}])
    assert [(r["step"], r["off_route"], r["arrived"]) for r in out] == [(0, False, False), (1, False, False), (1, True, False), (1, False, True)]


def test_stream_is_replay(spark):
    from compare import SMALL
    from tracklathe.plans import live

    a, b = (sorted(map(tuple, live.QUERIES[n](spark, SMALL).collect())) for n in ("fsm_replay", "fsm_stream"))
    assert a and a == b


def test_live_pose():
    e = lambda i, ms, kind, x=0.0, **m: {"id": i, "ms": ms, "kind": kind, "x": x, "c": 0.0, "north": 0.0, "east": 0.0} | m
    out, _ = run(machines.live(), [e(0, 0, "fix", 3.0, north=10.0), e(1, 0, "move", 10.0), e(2, 5000, "tunnel", 1.0), *[e(3 + i, 6000 + i, "fix", 1.0, north=900.0) for i in range(5)], e(8, 10000, "tunnel", 0.0), e(9, 20000, "move", 0.0)])
    assert out[0]["verdict"] == "accepted" and out[0]["north"] == pytest.approx(0.0)  # absorbed whole, shown where it was
    assert out[2]["north"] == pytest.approx(60.0) and out[2]["fresh"]
    assert [r["verdict"] for r in out[3:8]] == ["rejected"] * 4 + ["forced"] and out[8]["outage_s"] == 5.0 and out[8]["n_forced"] == 1
    assert out[8]["outage_m"] == pytest.approx(50.0) and not out[9]["fresh"] and out[9]["sigma"] > out[8]["sigma"]
