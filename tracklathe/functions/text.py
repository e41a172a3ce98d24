"""Headers, clocks, labels and formats as column expressions, and the guards over column names."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# The columns that may be read, those a model may see, and words that betray vehicle-bus columns.
INERTIAL = [f"{s}_{a}" for s, axes in (("accel", "xyz"), ("gravity", "xyz"), ("magnetic", "xyz")) for a in axes] + [f"{s}_{a}" for s in ("gyro", "orientation") for a in ("yaw", "pitch", "roll")]
TIME, GNSS = ["time_since_start_ms", "date"], ["gps_lat", "gps_lon", "gps_altitude_m", "gps_speed_mps", "gps_accuracy_m", "gps_orientation_deg", "gps_sats"]
ALLOWED = [*INERTIAL, *TIME, *GNSS]
TRUTH = ["time_of_day_s", "gps_lat", "gps_lon"]
BANNED = r"wheel|steer|rpm|engine|brake|throttle|gear|pedal|odo"


class LeakageError(AssertionError):
    """A column that must not be read or shown to a model; never to be caught."""


def guard(columns: list[str], allowed: list[str] = ALLOWED, context: str = "") -> None:
    """Raises unless every column is allowed, before any action; words of vehicle-bus columns make the message plainer."""
    bad = sorted(set(columns) - set(allowed))
    if bad:
        told = [c for c in bad if re.search(BANNED, c, re.I) or c.lower().startswith("v-")]
        raise LeakageError(f"{context}: columns not allowed: {', '.join(bad)}" + (f" (vehicle bus: {', '.join(told)})" if told else ""))


def header(label: Column) -> Column:
    """A label in lower case without unit, everything but letters and digits as single underscores."""
    t = F.lower(F.trim(F.regexp_replace(label, r"\s+", " ")))
    t = F.regexp_replace(t, r"\([^)]*\)|\[[^\]]*\]", " ")
    return F.regexp_replace(F.regexp_replace(t, r"[^a-z0-9]+", "_"), r"^_+|_+$", "")


def clock_seconds(text: Column) -> Column:
    """Seconds of the day in H-M-S or H:M:S with an optional fraction after . _ or :, found anywhere; null without a clock."""
    pattern = r"(\d{1,2})[-:](\d{2})[-:](\d{2})(?:[._:](\d{1,3}))?\"?\s*$"
    part = lambda i: F.regexp_extract(text, pattern, i)
    whole = part(1).cast("double") * 3600 + part(2).cast("double") * 60 + part(3).cast("double")
    return F.when(text.rlike(pattern), F.when(part(1) != "", F.lit(1.0)) * whole + F.when(part(4) != "", F.rpad(part(4), 3, "0").cast("double") / 1000).otherwise(0.0))


def octant(degrees: Column) -> Column:
    """The compass label of a course."""
    names = F.array(*[F.lit(x) for x in ("N", "NE", "E", "SE", "S", "SW", "W", "NW")])
    return F.get(names, F.floor((F.pmod(degrees, F.lit(360.0)) + 22.5) / 45).cast("int") % 8)


def hms(seconds: Column) -> Column:
    """Whole seconds as hh:mm:ss."""
    s = F.floor(seconds)
    return F.format_string("%02d:%02d:%02d", F.floor(s / 3600), F.floor(s % 3600 / 60), s % 60)


def distance_label(metres: Column) -> Column:
    """Metres below a kilometre, else kilometres with one decimal."""
    return F.when(metres < 1000, F.format_string("%d m", F.floor(metres))).otherwise(F.format_string("%.1f km", metres / 1000))


def six_digits(x: Column) -> Column:
    """A number to six significant digits."""
    return F.format_string("%.5e", x).cast("double")
