"""Geodesy and angles as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# WGS-84 and the spherical radius of the live map.
A, FLATTENING, SPHERE, METRES_A_DEGREE = 6378137.0, 1 / 298.257223563, 6371000.0, 111320.0
B = A * (1 - FLATTENING)
TURN = 2 * math.pi


def wrap(x: Column) -> Column:
    """An angle in (-pi, pi]."""
    return x - TURN * F.ceil((x - math.pi) / TURN)


def wrap_half_open(x: Column) -> Column:
    """An angle in [-pi, pi)."""
    return x - TURN * F.floor((x + math.pi) / TURN)


def ned(lat: Column, lon: Column, lat0: Column, lon0: Column) -> tuple[Column, Column]:
    """North and east metres from an origin by the series for metres a degree at its latitude."""
    r = F.radians(lat0)
    north = 111132.92 - 559.82 * F.cos(2 * r) + 1.175 * F.cos(4 * r) - 0.0023 * F.cos(6 * r)
    east = 111412.84 * F.cos(r) - 93.5 * F.cos(3 * r) + 0.118 * F.cos(5 * r)
    return (lat - lat0) * north, (lon - lon0) * east


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle metres on the sphere."""
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * SPHERE * F.asin(F.sqrt(F.least(a, F.lit(1.0))))


def flat(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Metres on a plane at the mean latitude."""
    east = (lon2 - lon1) * METRES_A_DEGREE * F.cos(F.radians((lat1 + lat2) / 2))
    return F.sqrt(F.pow((lat2 - lat1) * METRES_A_DEGREE, 2) + east * east)


def vincenty(lat1: Column, lon1: Column, lat2: Column, lon2: Column, turns: int = 8) -> Column:
    """Geodesic metres on WGS-84 by a fixed number of turns of the inverse series; equal points give exactly 0.

    For distances far from antipodal, which eight turns bring below a tenth of a millimetre. Null in, null out.
    """
    u1, u2 = F.atan((1 - FLATTENING) * F.tan(F.radians(lat1))), F.atan((1 - FLATTENING) * F.tan(F.radians(lat2)))
    gap = F.radians(lon2 - lon1)
    fixed = F.struct(F.sin(u1).alias("s1"), F.cos(u1).alias("c1"), F.sin(u2).alias("s2"), F.cos(u2).alias("c2"), gap.alias("gap"))

    def parts(p: Column, lam: Column) -> dict[str, Column]:
        sin_s = F.sqrt(F.pow(p["c2"] * F.sin(lam), 2) + F.pow(p["c1"] * p["s2"] - p["s1"] * p["c2"] * F.cos(lam), 2))
        cos_s = p["s1"] * p["s2"] + p["c1"] * p["c2"] * F.cos(lam)
        return {"sin": sin_s, "cos": cos_s, "s": F.atan2(sin_s, cos_s), "sina": F.coalesce(F.try_divide(p["c1"] * p["c2"] * F.sin(lam), sin_s), F.lit(0.0))}

    def tidy(p: Column, q: Column) -> Column:
        cos2a = 1 - q["sina"] * q["sina"]
        cos2m = F.coalesce(q["cos"] - F.try_divide(2 * p["s1"] * p["s2"], cos2a), F.lit(0.0))
        return F.struct(q["sin"].alias("sin"), q["cos"].alias("cos"), q["s"].alias("s"), q["sina"].alias("sina"), cos2a.alias("cos2a"), cos2m.alias("cos2m"))

    let = lambda x, f: F.get(F.transform(F.array(x), f), F.lit(0))

    def at(p: Column, lam: Column) -> Column:
        q = parts(p, lam)
        return let(F.struct(*[v.alias(k) for k, v in q.items()]), lambda z: tidy(p, z))

    def turn(p: Column, lam: Column) -> Column:
        def better(q: Column) -> Column:
            c = FLATTENING / 16 * q["cos2a"] * (4 + FLATTENING * (4 - 3 * q["cos2a"]))
            inner = q["cos2m"] + c * q["cos"] * (2 * q["cos2m"] * q["cos2m"] - 1)
            return p["gap"] + (1 - c) * FLATTENING * q["sina"] * (q["s"] + c * q["sin"] * inner)

        return let(at(p, lam), better)

    def length(q: Column) -> Column:
        u = q["cos2a"] * (A * A - B * B) / (B * B)
        big_a = 1 + u / 16384 * (4096 + u * (-768 + u * (320 - 175 * u)))
        big_b = u / 1024 * (256 + u * (-128 + u * (74 - 47 * u)))
        m = q["cos2m"]
        step = big_b * q["sin"] * (m + big_b / 4 * (q["cos"] * (2 * m * m - 1) - big_b / 6 * m * (4 * q["sin"] * q["sin"] - 3) * (4 * m * m - 3)))
        return B * big_a * (q["s"] - step)

    solve = lambda p: let(F.aggregate(F.sequence(F.lit(1), F.lit(turns)), p["gap"], lambda lam, _: turn(p, lam)), lambda lam: let(at(p, lam), length))
    return F.when((lat1 == lat2) & (lon1 == lon2), F.lit(0.0)).otherwise(let(fixed, solve))


def ellipse(nn: Column, ne: Column, ee: Column) -> tuple[Column, Column, Column]:
    """Semi-axes and orientation in (-pi/2, pi/2] of a 2 x 2 covariance; a negative eigenvalue counts as 0."""
    mean, half = (nn + ee) / 2, F.sqrt(F.pow((nn - ee) / 2, 2) + ne * ne)
    return F.sqrt(F.greatest(mean + half, F.lit(0.0))), F.sqrt(F.greatest(mean - half, F.lit(0.0))), 0.5 * F.atan2(2 * ne, nn - ee)


def mahalanobis_squared(n: Column, e: Column, nn: Column, ne: Column, ee: Column) -> Column:
    """The squared distance under a covariance; infinite where it is singular."""
    det = nn * ee - ne * ne
    return F.when(det > 0, (ee * n * n - 2 * ne * n * e + nn * e * e) / det).otherwise(F.lit(float("inf")))


def to_segment(x: Column, y: Column, x1: Column, y1: Column, x2: Column, y2: Column) -> tuple[Column, Column, Column]:
    """(along, lateral, distance) of a point to a segment on a plane: along unclamped, lateral to the line, distance to the clamped foot."""
    dx, dy = x2 - x1, y2 - y1
    size = F.sqrt(dx * dx + dy * dy)
    along = F.try_divide((x - x1) * dx + (y - y1) * dy, size)
    lateral = F.try_divide((x - x1) * dy - (y - y1) * dx, size)
    foot = F.greatest(F.least(along, size), F.lit(0.0))
    return along, lateral, F.sqrt(F.pow(along - foot, 2) + lateral * lateral)
