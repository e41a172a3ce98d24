"""Plain re-computations that the engine's results are held against."""

from __future__ import annotations

import csv
import json
import re

import numpy as np
import pandas as pd


def outliers(v, ok, threshold=8.0, shock=3.5):
    """Which values are outliers of one whole series: the robust filter written plainly, value by value."""
    v = np.array(v, float)
    if not any(ok):
        return np.zeros(len(v), bool)
    q = np.quantile(v[ok], [0.05, 0.25, 0.5, 0.75, 0.95], method="inverted_cdf")
    level, sd, phi = q[2], 3 * max((q[4] - q[0]) / 3.29, (q[3] - q[1]) / 1.349), 0.0

    def cases(beyond):
        out, last, gap = np.zeros(len(v), bool), None, 1
        for i, x in enumerate(v - level):
            carry = phi**gap if last is not None else 0.0
            odd = sd > 0 and abs(x - carry * (last or 0.0)) > shock * sd * max(1 - carry * carry, 0) ** 0.5
            out[i] = odd and abs(x) > beyond * sd
            last, gap = (last, gap + 1) if odd or not ok[i] else (x, 1)
        # impossible values are told apart anyway
        return out | (~ok & (sd > 0) & (np.abs(v - level) > beyond * sd))

    for beyond in (threshold / 2, threshold):
        before = None
        for _ in range(12):
            out = cases(beyond)
            keep = ok & ~out
            if keep.sum() < 2:
                return out
            level, sd = v[keep].mean(), v[keep].std(ddof=1)
            both = keep[1:] & keep[:-1]
            a, b = (v - level)[1:][both], (v - level)[:-1][both]
            phi = min(max(float(a @ b) / float(b @ b), 0.0), 0.99) if b @ b > 0 else 0.0
            if before is not None and (out == before).all():
                break
            before = out
    return cases(threshold)


def spikes(series: dict[tuple, list[tuple[float, int, float]]], possible) -> set[tuple]:
    """(table, row, field) of impossible, stuck and outlying values; series maps (table, source, field) to (at, row, value)."""
    found = set()
    for (table, _, field), rows in series.items():
        rows = sorted(rows)
        v = np.array([r[2] for r in rows], float)
        ok = np.array([possible(field, x) for x in v], bool)
        stuck = np.zeros(len(v), bool)
        if field not in ("gps_lat", "gps_lon"):
            i = 0
            while i < len(v):
                j = i
                while j < len(v) and v[j] == v[i]:
                    j += 1
                if j - i >= 5 and v[i] != 0:
                    stuck[i:j] = True
                i = j
        found |= {(table, rows[i][1], field) for i in np.nonzero(~ok | outliers(v, ok) | stuck)[0]}
    return found


def grid(t: list[float], v: list[float], period: float, gap: float) -> dict[int, tuple[str, float | None]]:
    """period -> (status, value) by Steffen's cubic over strictly increasing stamps."""
    t, v = np.array(t, float), np.array(v, float)
    cuts = [0, *(np.nonzero(np.diff(t) > gap)[0] + 1), len(t)]
    seen = {int(x // period) for x in t}
    out = {k: ("gap", None) for k in range(int(t[0] // period), int(t[-1] // period) + 1)}
    for a, b in zip(cuts, cuts[1:]):
        x, y = t[a:b], v[a:b]
        h, n = np.diff(x), b - a
        s = np.diff(y) / h if n > 1 else np.zeros(0)
        d = np.zeros(n)
        for i in range(n):
            if n == 1:
                break
            h0, s0 = (h[i - 1], s[i - 1]) if i else (h[i], s[i])
            h1, s1 = (h[i], s[i]) if i < n - 1 else (h[i - 1], s[i - 1])
            p = (s0 * h1 + s1 * h0) / (h0 + h1)
            d[i] = (np.sign(s0) + np.sign(s1)) * min(abs(s0), abs(s1), 0.5 * abs(p))
        for k in range(int(x[0] // period), int(x[-1] // period) + 1):
            c = (k + 0.5) * period
            if c < x[0]:
                val = y[0]
            elif c >= x[-1]:
                val = y[-1]
            else:
                i = int(np.searchsorted(x, c, side="right")) - 1
                u = (c - x[i]) / h[i]
                val = y[i] * (1 + 2 * u) * (1 - u) ** 2 + h[i] * d[i] * u * (1 - u) ** 2 + y[i + 1] * u * u * (3 - 2 * u) + h[i] * d[i + 1] * u * u * (u - 1)
            if k in seen or x[0] <= c < x[-1]:
                out[k] = ("observed" if k in seen else "filled", float(val))
    return out


def layout_changes(files: pd.DataFrame, resolve) -> set[tuple]:
    """(file, field, change) of delimited and JSON files, feed by feed."""
    def kind(x, text):
        if x is None or str(x).strip() == "":
            return None
        if not text:
            return {bool: "flag", int: "whole", float: "decimal", str: "text", list: "list"}[type(x)]
        x = x.strip()
        return "whole" if re.fullmatch(r"[-+]?\d+", x) else "decimal" if re.fullmatch(r"[-+]?\d+\.\d+", x) else "flag" if x.lower() in ("true", "false") else "text"

    found = set()
    for _, feed in files.drop_duplicates().sort_values(["feed", "written_at", "file_id"]).groupby("feed"):
        before, had = None, {}
        for f in feed.itertuples():
            now = {}
            if f.record_kind == "imu":
                lines = [x for x in re.split(r"\r\n|\n|\r", f.payload.lstrip("﻿")) if x]
                rows = list(csv.reader(lines, delimiter=max(",;\t|", key=lines[0].count)))
                for i, label in enumerate(rows[0]):
                    now[resolve(label, "imu")] = (label, {kind(r[i], True) for r in rows[1:]} - {None})
            else:
                for r in (json.loads(x) for x in re.split(r"\r\n|\n|\r", f.payload.lstrip("﻿")) if x):
                    for label, x in r.items():
                        old = now.get(resolve(label, "axis"), (label, set()))[1]
                        now[resolve(label, "axis")] = (label, old | ({kind(x, False)} - {None}))
            squash = lambda x: re.sub(r"\s", "", x).lower()
            kinds = {k: ("decimal" if "decimal" in s else next(iter(s), None)) for k, (_, s) in now.items()}
            if before is not None:
                found |= {(f.file_id, k, "added") for k in now.keys() - before.keys()} | {(f.file_id, k, "removed") for k in before.keys() - now.keys()}
                for k in now.keys() & before.keys():
                    if squash(now[k][0]) != squash(before[k][0]):
                        found.add((f.file_id, k, "renamed"))
                    if kinds[k] and had.get(k) and kinds[k] != had[k]:
                        found.add((f.file_id, k, "retyped"))
            had |= {k: v for k, v in kinds.items() if v}
            before = now
    return found
