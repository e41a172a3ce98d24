"""Inertial kernels over many recordings at once: an invariant filter with alignment, aiding and constraints, replays, Allan."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from tracklathe.kernels.lie import discrete_noise, exp_pose, gammas, orthonormal, propagate, skew

GRAVITY = np.array([0.0, 0.0, 9.80665])  # north, east, down
DOWN = np.array([0.0, 0.0, 1.0])
I3 = np.eye(3)


@dataclass(frozen=True)
class Noise:
    """Spectral densities, measurement deviations, limits; fixed values of the domain."""

    gyro: float = 2.18e-4
    accel: float = 4.03e-3
    gyro_walk: float = 3.10e-5
    accel_walk: float = 9.67e-4
    mount_walk: float = 1.0e-3
    nhc: float = 0.5
    zupt: float = 0.02
    zaru: float = 6.894e-4
    gyro_start: float = 0.00349066
    accel_start: float = 0.08
    knock: float = 0.0872665
    knock_rate: float = 3.0
    gate: float = 11.345
    still_var: float = 0.02
    still_rate: float = 0.01
    course: float = 0.5
    speed: float = 0.5
    course_speed: float = 3.0
    position: float = 3.0
    nhc_speed: float = 1.0
    nhc_rate: float = 0.6
    nhc_side: float = 4.0
    veto_speed: float = 1.0
    veto_sigmas: float = 3.0
    fastest: float = 150.0
    window: int = 20
    step: float = 1.0
    steps: int = 64
    reject_most: int = 3
    align: int = 600
    align_s: float = 60.0
    smooth: int = 9
    correlation: float = 0.5
    effective: float = 15.0


def level(up: np.ndarray) -> np.ndarray:
    """The least rotations that bring unit vectors ``up`` to minus down."""
    axis, c = np.cross(up, -DOWN), -up[..., 2]
    s = np.linalg.norm(axis, axis=-1)
    flat = s < 1e-12
    with np.errstate(invalid="ignore", divide="ignore"):
        phi = np.where(flat[..., None], 0.0, axis / s[..., None] * np.arctan2(s, c)[..., None])
    return np.where((flat & (c < 0))[..., None, None], np.diag([1.0, -1.0, -1.0]), gammas(phi)[0])


def about_down(yaw: np.ndarray) -> np.ndarray:
    """Rotations about down alone."""
    return gammas(np.asarray(yaw, float)[..., None] * DOWN)[0]


def smoothed(x: np.ndarray, width: int) -> np.ndarray:
    """Centred moving mean along the first axis, shrinking at the edges."""
    n, half = len(x), width // 2
    total = np.concatenate([np.zeros((1, *x.shape[1:]), x.dtype), np.cumsum(x, axis=0)])
    lo, hi = np.maximum(np.arange(n) - half, 0), np.minimum(np.arange(n) + half + 1, n)
    return (total[hi] - total[lo]) / (hi - lo).reshape(-1, *[1] * (x.ndim - 1))


@dataclass
class Mount:
    """A mount's turn from the sensor to the vehicle, with the fit's correlation, spread, and whether it is to be trusted."""

    rot: np.ndarray
    yaw: float
    correlation: float
    spread: float
    resolved: bool
    level_sigma: float


def mount_fit(t: np.ndarray, accel: np.ndarray, gyro: np.ndarray, speed: np.ndarray, c: Noise = Noise()) -> Mount | None:
    """Levels a window of readings and turns it about the vertical so that it accelerates as the receiver's speed says.

    ``speed`` is the last fix's at each reading, NaN before the first. Forward acceleration is the change from one fix to
    the next over the readings between them, to the right speed times turn rate. Both planar accelerations are complex
    numbers, smoothed and centred; the turn is the argument of their product sum. The mean forward acceleration is
    then taken out of the vertical, and the fit done once more.
    """
    known = ~np.isnan(speed)
    if len(t) < 3 or known.sum() < 3:
        return None
    new = np.flatnonzero(known & np.concatenate([[True], speed[1:] != speed[:-1]]))
    forward = np.full(len(t), np.nan)
    for i, j in zip(new[:-1], new[1:]):
        forward[i:j] = (speed[j] - speed[i]) / max(t[j] - t[i], 1e-6)
    mean, span = accel.mean(axis=0), max(t[-1] - t[0], 1e-6)
    change = (speed[known][-1] - speed[known][0]) / span
    still = float(np.sqrt(c.still_var) / GRAVITY[2])
    ok = ~np.isnan(forward)

    def fit(mean: np.ndarray) -> Mount:
        flat = level(mean / np.linalg.norm(mean))
        a, w = accel @ flat.T, gyro @ flat.T
        none = Mount(flat, 0.0, 0.0, np.pi / 2, False, float(np.hypot(still, change / GRAVITY[2])))
        if ok.sum() < 3:
            return none
        z, r = smoothed((a[:, 0] + 1j * a[:, 1])[ok], c.smooth), smoothed((forward + 1j * np.nan_to_num(speed) * w[:, 2])[ok], c.smooth)
        z, r = z - z.mean(), r - r.mean()
        sizes = np.sum(np.abs(z) ** 2), np.sum(np.abs(r) ** 2)
        if min(sizes) <= 0:
            return none
        top, n = np.sum(np.conj(z) * r), max(2.0, len(z) / (2 * c.smooth))
        yaw, correlation = float(np.angle(top)), float(np.abs(top) / np.sqrt(sizes[0] * sizes[1]))
        rest = np.mean(np.abs(z - r * np.exp(-1j * yaw)) ** 2) / 2
        spread = float(min(np.sqrt(rest / np.mean(np.abs(r) ** 2) / n), np.pi / 2))
        resolved = correlation >= c.correlation and n >= c.effective
        gap = float(np.max(np.diff(t[new]))) if len(new) > 2 else span
        left = np.nanmax(np.abs(forward)) * min(gap, span) / span if resolved else change
        return Mount(about_down(yaw) @ flat, yaw, correlation, max(spread, 1e-3), bool(resolved), float(np.hypot(still, left / GRAVITY[2])))

    if np.linalg.norm(mean) < 1e-6:
        return None
    m = fit(mean)
    without = mean - change * m.rot[0]
    return fit(without) if m.resolved and np.linalg.norm(without) > 1e-6 else m


class Fleet:
    """Filters of many recordings side by side: 18-state, right-invariant; rows are addressed by arrays of slots.

    Rotation, velocity, position, gyro bias, accelerometer bias, mount (sensor to vehicle). The error of the pose is
    exp(xi) = estimate * truth^-1; a correction is taken off by exp(-K z) from the left. A filter stands at its last fix
    until it is aligned: levelled, with its mount resolved, and its heading from a fix's course. ``free`` masks the rows
    of the gain, so that biases can be held.
    """

    FIELDS = ("rot", "v", "p", "bg", "ba", "mount", "cov")

    def __init__(self, slots: int, noise: Noise = Noise()):
        self.c, c = noise, noise
        self.density = np.zeros((18, 18))
        self.density[:3, :3], self.density[3:6, 3:6] = I3 * c.gyro**2, I3 * c.accel**2
        self.density[9:, 9:] = np.diag(np.repeat(np.square([c.gyro_walk, c.accel_walk, c.mount_walk]), 3))
        self.free = np.ones(18)
        self.size = 0
        self.grow(slots)

    def grow(self, slots: int) -> None:
        m, c = slots - self.size, self.c
        new = {
            "rot": np.tile(I3, (m, 1, 1)), "mount": np.tile(I3, (m, 1, 1)), "cov": np.zeros((m, 18, 18)), **{k: np.zeros((m, 3)) for k in ("v", "p", "bg", "ba")},
            "t": np.full(m, np.nan), "aligned": np.zeros(m, bool), "reads": np.zeros(m, np.int64), "steps": np.zeros(m, np.int64), "rejected": np.zeros(m, np.int64),
            "fixes": np.zeros(m, np.int64), "lost": np.zeros(m, np.int64), "forced": np.zeros(m, np.int64), "g": np.full((m, c.window, 3), np.nan), "a": np.full((m, c.window, 3), np.nan),
            "trail": np.full((m, c.align, 8), np.nan), "speed": np.full(m, np.nan), "how": np.zeros(m, np.int64),
        }
        for k, x in new.items():
            setattr(self, k, np.concatenate([getattr(self, k), x]) if self.size else x)
        self.size = slots

    # Propagation ------------------------------------------------------------------------------------------------------
    def predict(self, r: np.ndarray, gyro: np.ndarray, accel: np.ndarray, dt: np.ndarray) -> None:
        w, f, v, p = gyro - self.bg[r], accel - self.ba[r], self.v[r], self.p[r]
        half = self.rot[r] @ gammas(w * (dt / 2)[:, None])[0]
        a, map_ = np.zeros((len(r), 18, 18)), np.zeros((len(r), 18, 18))
        turned = [half, skew(v) @ half, skew(p) @ half]
        a[:, :3, 9:12] = -turned[0]
        a[:, 3:6, :3], a[:, 3:6, 9:12], a[:, 3:6, 12:15] = skew(GRAVITY), -turned[1], -half
        a[:, 6:9, 3:6], a[:, 6:9, 9:12] = I3, -turned[2]
        for i in (0, 3, 6, 9, 12, 15):
            map_[:, i:i + 3, i:i + 3] = half if i < 9 else I3
        map_[:, 3:6, :3], map_[:, 6:9, :3] = turned[1], turned[2]
        flow, noise = discrete_noise(a, map_ @ self.density @ np.swapaxes(map_, 1, 2), dt)
        self.cov[r] = flow @ self.cov[r] @ np.swapaxes(flow, 1, 2) + noise
        self.rot[r], self.v[r], self.p[r] = propagate(self.rot[r], v, p, w, f, dt, GRAVITY)
        self.steps[r] += 1
        tidy = r[self.steps[r] % 1000 == 0]
        if len(tidy):
            self.rot[tidy] = orthonormal(self.rot[tidy])

    def across(self, r: np.ndarray, dt: np.ndarray, covariance: bool = True) -> None:
        """The whole of ``dt`` by the latest readings, in equal parts of at most ``step`` seconds, longer beyond ``steps`` of them."""
        parts = np.clip(np.ceil(dt / self.c.step - 1e-9), 1, self.c.steps)
        for k in range(int(parts.max()) if len(r) else 0):
            on = parts > k
            q = r[on]
            if covariance:
                self.predict(q, self.g[q, -1], self.a[q, -1], (dt / parts)[on])
            else:
                self.rot[q], self.v[q], self.p[q] = propagate(self.rot[q], self.v[q], self.p[q], self.g[q, -1], self.a[q, -1], (dt / parts)[on], GRAVITY)

    # Updates ----------------------------------------------------------------------------------------------------------
    def update(self, r: np.ndarray, z: np.ndarray, h: np.ndarray, noise: np.ndarray, gate: np.ndarray | None = None) -> np.ndarray:
        """Joseph updates by z = estimate - measurement; which of them their gates let through (no gate: infinity)."""
        ph = self.cov[r] @ np.swapaxes(h, 1, 2)
        s = h @ ph + noise
        with np.errstate(all="ignore"):
            k = np.swapaxes(np.linalg.solve(s, np.swapaxes(ph, 1, 2)), 1, 2) * self.free[:, None]
            taken = np.ones(len(r), bool) if gate is None else np.einsum("ni,ni->n", z, np.linalg.solve(s, z[..., None])[..., 0]) <= gate
        r, z, h, k, noise = r[taken], z[taken], h[taken], k[taken], noise[taken]
        if len(r):
            d = np.einsum("nij,nj->ni", k, z)
            turn, dv, dp = exp_pose(-d[:, :9])
            self.rot[r] = turn @ self.rot[r]
            self.v[r] = np.einsum("nij,nj->ni", turn, self.v[r]) + dv
            self.p[r] = np.einsum("nij,nj->ni", turn, self.p[r]) + dp
            self.bg[r] -= d[:, 9:12]
            self.ba[r] -= d[:, 12:15]
            self.mount[r] = gammas(-d[:, 15:])[0] @ self.mount[r]
            keep = np.eye(18) - k @ h
            cov = keep @ self.cov[r] @ np.swapaxes(keep, 1, 2) + k @ noise @ np.swapaxes(k, 1, 2)
            self.cov[r] = (cov + np.swapaxes(cov, 1, 2)) / 2
        return taken

    def fix(self, r: np.ndarray, position: np.ndarray, sigma: np.ndarray) -> np.ndarray:
        """Positions, down three times as uncertain; the third one in a row that a gate turns down is taken all the same."""
        h = np.zeros((len(r), 3, 18))
        h[:, :, :3], h[:, :, 6:9] = -skew(self.p[r]), I3
        force = self.rejected[r] + 1 >= self.c.reject_most
        taken = self.update(r, self.p[r] - position, h, (sigma**2)[:, None, None] * np.diag([1.0, 1.0, 9.0]), np.where(force, np.inf, self.c.gate))
        self.forced[r[taken & force]] += 1
        self.rejected[r] = np.where(taken, 0, self.rejected[r] + 1)
        return taken

    def velocity(self, r: np.ndarray, course: np.ndarray, speed: np.ndarray) -> None:
        """The receiver's course and speed as a level velocity, along and across track."""
        c = self.c
        cs, sn = np.cos(course), np.sin(course)
        turn = np.stack([np.stack([cs, -sn], -1), np.stack([sn, cs], -1)], -2)
        noise = turn @ np.diag([c.speed**2, c.course**2]) @ np.swapaxes(turn, 1, 2)
        h = np.zeros((len(r), 2, 18))
        h[:, :, :3], h[:, :, 3:6] = -skew(self.v[r])[:, :2], I3[:2]
        self.update(r, self.v[r, :2] - speed[:, None] * np.stack([cs, sn], -1), h, noise)

    def loosen(self, r: np.ndarray) -> None:
        """After a knock the mount is less certain; what is known otherwise stays."""
        i = np.arange(15, 18)
        self.cov[r[:, None], i, i] += self.c.knock**2

    def constrain(self, r: np.ndarray) -> None:
        """At rest velocity and turn rate are nothing; driving, the vehicle doesn't move sideways or up.

        A stop is vetoed while the filter is sure that it moves. The rate's noise is the still window's own. ``how``: 0
        nothing, 1 rest, 2 driving, 3 vetoed.
        """
        c, g, a = self.c, self.g[r], self.a[r]
        with np.errstate(invalid="ignore"):
            full = ~np.isnan(g[:, 0, 0])
            rate = g.mean(axis=1) - self.bg[r]
            rest = full & (a.var(axis=1).mean(axis=1) < c.still_var) & (np.linalg.norm(rate, axis=1) < c.still_rate)
            knocked = np.linalg.norm(g[:, -1] - g[:, -2], axis=1) > c.knock_rate
        if knocked.any():
            self.loosen(r[knocked])
        speed = np.linalg.norm(self.v[r], axis=1)
        most = np.sqrt(np.maximum(np.linalg.eigvalsh(self.cov[r, 3:6, 3:6])[:, -1], 0)) if rest.any() else np.zeros(len(r))
        veto = rest & (speed > c.veto_speed) & (speed > c.veto_sigmas * most)
        stop, how = rest & ~veto, np.where(veto, 3, 0)
        if stop.any():
            q = r[stop]
            h, back = np.zeros((len(q), 3, 18)), np.swapaxes(self.rot[q], 1, 2)
            h[:, :, 3:6] = back
            self.update(q, np.einsum("nij,nj->ni", back, self.v[q]), h, np.broadcast_to(I3 * c.zupt**2, (len(q), 3, 3)))
            h = np.zeros((len(q), 3, 18))
            h[:, :, 9:12] = I3
            sigma = np.maximum(g[stop].std(axis=1, ddof=1), c.zaru)
            self.update(q, self.bg[q] - g[stop, -1], h, sigma[:, :, None] ** 2 * I3, np.full(len(q), c.gate))
            how[stop] = 1
        m = self.mount[r]
        turn, side = np.einsum("nij,nj->ni", m, g[:, -1] - self.bg[r]), np.einsum("nij,nj->ni", m, a[:, -1] - self.ba[r])
        drive = ~rest & (speed >= c.nhc_speed) & (np.abs(turn[:, 2]) <= c.nhc_rate) & (np.abs(side[:, 1]) <= c.nhc_side)
        if drive.any():
            q = r[drive]
            to = self.mount[q] @ np.swapaxes(self.rot[q], 1, 2)
            vehicle = np.einsum("nij,nj->ni", to, self.v[q])
            h = np.zeros((len(q), 2, 18))
            h[:, :, 3:6], h[:, :, 15:18] = to[:, 1:], -skew(vehicle)[:, 1:]
            self.update(q, vehicle[:, 1:], h, np.broadcast_to(np.eye(2) * c.nhc**2, (len(q), 2, 2)))
            how[drive] = 2
        self.how[r] = how

    # Alignment --------------------------------------------------------------------------------------------------------
    def start(self, i: int, m: Mount, course: float, speed: float) -> None:
        """Writes an alignment into one filter: mount, heading, velocity and a fresh covariance of plain errors, made invariant."""
        c = self.c
        self.mount[i] = m.rot
        self.rot[i] = about_down(np.array(course)) @ m.rot
        self.v[i] = [speed * np.cos(course), speed * np.sin(course), 0.0]
        yaw = np.arctan2(c.course, speed)
        sd = np.repeat([m.level_sigma, c.course, c.position, c.gyro_start, c.accel_start, m.spread], 3)
        sd[2] = yaw
        plain, j = np.diag(sd**2), np.eye(18)
        j[3:6, :3], j[6:9, :3] = skew(self.v[i]), skew(self.p[i])
        self.cov[i] = j @ plain @ j.T
        self.aligned[i], self.rejected[i] = True, 0

    def align(self, r: np.ndarray, course: np.ndarray, speed: np.ndarray) -> None:
        """Tries to align filters at fixes that move, on the readings of the last minute; nothing later is read."""
        for i, c, v in zip(r, course, speed):
            rows = np.roll(self.trail[i], -(self.reads[i] % self.c.align), axis=0)
            rows = rows[~np.isnan(rows[:, 0])]
            rows = rows[rows[:, 0] >= self.t[i] - self.c.align_s]
            m = mount_fit(rows[:, 0], rows[:, 1:4], rows[:, 4:7], rows[:, 7], self.c) if len(rows) > 2 else None
            if m is not None and m.resolved:
                self.start(i, m, c, v)

    # One event of each row --------------------------------------------------------------------------------------------
    def read(self, r: np.ndarray, t: np.ndarray, gyro: np.ndarray, accel: np.ndarray, aided: bool = True) -> np.ndarray:
        """Takes the readings (NaN where there is none) and brings the filters to their stamps; which of them moved on."""
        reads = ~np.isnan(gyro[:, 0]) & ~np.isnan(t)
        q = r[reads]
        if len(q):
            for kept, x in ((self.g, gyro), (self.a, accel)):
                kept[q, :-1] = kept[q, 1:]
                kept[q, -1] = x[reads]
            if aided:
                self.trail[q, self.reads[q] % self.c.align] = np.column_stack([t[reads], accel[reads], gyro[reads], self.speed[q]])
            self.reads[q] += 1
        dt = np.nan_to_num(np.maximum(t - self.t[r], 0.0))
        first = np.isnan(self.t[r]) & ~np.isnan(t)
        self.t[r] = np.where(first | (dt > 0), t, self.t[r])
        go = self.aligned[r] & (dt > 0) & ~np.isnan(self.g[r, -1, 0])
        if go.any():
            self.across(r[go], dt[go])
            held = go & reads
            if held.any():
                self.constrain(r[held])
        return go

    def aid(self, r: np.ndarray, position: np.ndarray, sigma: np.ndarray, course: np.ndarray, speed: np.ndarray) -> None:
        """Takes fixes: aligned filters update position and velocity, the others stand there and try to align."""
        self.fixes[r] += 1
        self.speed[r] = np.where(np.isnan(speed), self.speed[r], speed)
        moves = ~np.isnan(course) & ~np.isnan(speed) & (speed >= self.c.course_speed)
        ready = self.aligned[r]
        if ready.any():
            self.fix(r[ready], position[ready], sigma[ready])
            both = ready & moves
            if both.any():
                self.velocity(r[both], course[both], speed[both])
        if not ready.all():
            self.p[r[~ready]] = position[~ready]
            tries = ~ready & moves
            self.align(r[tries], course[tries], speed[tries])

    def check(self, r: np.ndarray) -> None:
        """A filter that left what is physical is no longer aligned: it stands at its next fix and aligns anew."""
        bad = self.aligned[r] & ~(np.isfinite(self.cov[r, 6, 6]) & np.isfinite(self.p[r]).all(axis=1) & (np.linalg.norm(self.v[r], axis=1) <= self.c.fastest))
        q = r[bad]
        if len(q):
            self.lost[q] += 1
            self.aligned[q] = False
            for k, x in (("rot", I3), ("mount", I3), ("v", 0.0), ("bg", 0.0), ("ba", 0.0), ("cov", 0.0)):
                getattr(self, k)[q] = x
            self.p[q] = np.where(np.isfinite(self.p[q]), self.p[q], 0.0)

    def yaw(self, r: np.ndarray) -> np.ndarray:
        """The vehicles' headings: sensor attitude with the mount taken off."""
        to = self.rot[r] @ np.swapaxes(self.mount[r], 1, 2)
        return np.arctan2(to[:, 1, 0], to[:, 0, 0])

    def sigma(self, r: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(self.cov[r, 6, 6] + self.cov[r, 7, 7], 0.0))

    def pack(self, r: np.ndarray) -> np.ndarray:
        """Whole states as rows of numbers: snapshots that ``unpack`` reads."""
        parts = [getattr(self, k)[r].reshape(len(r), -1) for k in self.FIELDS]
        return np.concatenate([self.t[r, None], self.aligned[r, None].astype(float), *parts, self.g[r].reshape(len(r), -1), self.a[r].reshape(len(r), -1)], axis=1)

    @classmethod
    def unpack(cls, rows: np.ndarray, noise: Noise = Noise()) -> "Fleet":
        f, at = cls(len(rows), noise), 2
        f.t, f.aligned = rows[:, 0].copy(), rows[:, 1] > 0
        for k in (*cls.FIELDS, "g", "a"):
            x = getattr(f, k)
            n = int(np.prod(x.shape[1:]))
            setattr(f, k, rows[:, at:at + n].reshape(x.shape).copy())
            at += n
        return f


def lockstep(lengths: np.ndarray):
    """Yields, event after event, the number of the event and the rows that still have one."""
    order = np.argsort(-lengths, kind="stable")
    size = lengths[order]
    for i in range(int(size[0]) if len(size) else 0):
        yield i, order[: np.searchsorted(-size, -i, side="left")]


#: An event's numbers, in this order.
EVENT = ["idx", "t", "gx", "gy", "gz", "ax", "ay", "az", "north", "east", "down", "sigma", "course", "speed"]
HOW = ["none", "rest", "driving", "vetoed", "unaligned", "lost"]


def aided(f: Fleet, slots: np.ndarray, events: np.ndarray, at: np.ndarray, every: int, grid: float | None = None) -> tuple[list, list]:
    """The aided pass over one block of each row's events: (rows, snapshots).

    ``rows`` are (row, idx, north, east, down, speed, yaw, sigma, how, fixes) every ``every`` readings. With ``grid`` there is a
    snapshot (row, window, state) at the first reading of each window of ``grid`` seconds from time 0: the state of the
    event before. Without a stamp or reading an event still gives its fix.
    """
    rows, snaps, was = [], [], np.full(len(slots), -1)
    for i, on in lockstep(np.diff(at)):
        e, r = events[at[on] + i], slots[on]
        t, reads = e[:, 1], ~np.isnan(e[:, 2]) & ~np.isnan(e[:, 1])
        if grid is not None:
            w = np.floor(np.nan_to_num(t, nan=-1.0) / grid).astype(int)
            new = reads & (t >= 0) & (w > was[on])
            if new.any():
                snaps.append((on[new], w[new], f.pack(r[new])))
                was[on[new]] = w[new]
        f.read(r, t, e[:, 2:5], e[:, 5:8])
        fixed = ~np.isnan(e[:, 8])
        if fixed.any():
            x = e[fixed]
            f.aid(r[fixed], x[:, 8:11], np.where(x[:, 11] > 0, x[:, 11], f.c.position), x[:, 12], x[:, 13])
        lost = f.lost[r].copy()
        f.check(r)
        out = (f.lost[r] > lost) | (reads & (f.reads[r] % every == 0))
        if out.any():
            q = r[out]
            how = np.where(f.lost[q] > lost[out], 5, np.where(f.aligned[q], f.how[q], 4))
            rows.append((on[out], e[out, 0], f.p[q, 0], f.p[q, 1], f.p[q, 2], np.linalg.norm(f.v[q], axis=1), f.yaw(q), f.sigma(q), how, f.fixes[q]))
    return rows, snaps


def dead_reckoned(f: Fleet, begins: np.ndarray, epochs: np.ndarray, events: np.ndarray, at: np.ndarray, aiding: bool) -> np.ndarray:
    """Positions (rows, epochs, 2) at whole seconds from each row's begin on, without fixes; NaN beyond a row's epochs.

    ``aiding`` runs the filter with its constraints, else the poses are integrated as they are. An epoch between two
    readings is reached from the one before it at constant velocity. Filters that aren't aligned stand still.
    """
    out, due = np.full((len(begins), int(epochs.max()) + 1 if len(epochs) else 1, 2), np.nan), np.zeros(len(begins), int)

    def emit(on: np.ndarray, upto: np.ndarray) -> None:
        while len(on):
            go = (due[on] <= epochs[on]) & (begins[on] + due[on] < upto)
            on, upto = on[go], upto[go]
            ahead = np.where(np.isnan(f.t[on]), 0.0, np.maximum(begins[on] + due[on] - f.t[on], 0.0))
            out[on, due[on]] = f.p[on, :2] + np.where(f.aligned[on, None], f.v[on, :2], 0.0) * ahead[:, None]
            due[on] += 1

    for i, on in lockstep(np.diff(at)):
        e = events[at[on] + i]
        fine = ~np.isnan(e[:, 1])
        on, e = on[fine], e[fine]
        emit(on, e[:, 1])
        if aiding:
            f.read(on, e[:, 1], e[:, 2:5], e[:, 5:8], aided=False)
            f.check(on)
        else:
            dt = np.nan_to_num(np.maximum(e[:, 1] - f.t[on], 0.0))
            f.t[on] = np.fmax(f.t[on], e[:, 1])
            reads = ~np.isnan(e[:, 2])
            f.g[on[reads], -1], f.a[on[reads], -1] = e[reads, 2:5], e[reads, 5:8]
            go = (dt > 0) & ~np.isnan(f.g[on, -1, 0])
            f.across(on[go], dt[go], covariance=False)
    emit(np.arange(len(begins)), np.full(len(begins), np.inf))
    return out


def allan(x: np.ndarray, dt: float, sizes: list[int]) -> list[tuple[float, int, float]]:
    """(cluster time, terms, deviation) of the overlapping Allan deviation for each cluster size that fits."""
    theta = np.concatenate([[0.0], np.cumsum(x) * dt])
    out = []
    for m in sizes:
        if len(theta) > 2 * m:
            d = theta[2 * m:] - 2 * theta[m:-m] + theta[: -2 * m]
            out.append((m * dt, len(d), float(np.sqrt(np.sum(d * d) / (2 * (m * dt) ** 2 * len(d))))))
    return out
