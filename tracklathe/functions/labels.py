"""Column labels as written by recorders, resolved to canonical field names."""

from __future__ import annotations

import re
from functools import lru_cache

#: Word stems of sensor families whose channels carry an axis.
AXIS_FAMILIES = {
    "accel": "accel", "accelerometer": "accel", "acceleration": "accel", "acc": "accel",
    "gravity": "gravity", "grav": "gravity",
    "gyro": "gyro", "gyroscope": "gyro",
    "magnetic": "magnetic", "magnetometer": "magnetic", "mag": "magnetic",
    "orientation": "orientation", "orient": "orientation", "attitude": "orientation",
}
AXES = {"x", "y", "z", "yaw", "pitch", "roll", "azimuth"}
TURN = {"x": "yaw", "y": "pitch", "z": "roll", "azimuth": "yaw"}

#: Words that name a field by themselves, in order of precedence.
IMU_WORDS = [
    ({"lat", "latitude"}, "gps_lat"), ({"lon", "lng", "long", "longitude"}, "gps_lon"),
    ({"altitude", "alt", "elevation", "height"}, "gps_altitude_m"), ({"speed", "velocity"}, "gps_speed_mps"),
    ({"accuracy", "hdop"}, "gps_accuracy_m"), ({"course", "heading", "bearing"}, "gps_orientation_deg"),
    ({"sat", "sats", "satellite", "satellites"}, "gps_sats"), ({"date", "datetime"}, "date"),
    ({"pressure", "baro", "barometer"}, "pressure_hpa"), ({"temp", "temperature"}, "ambient_temp_c"),
    ({"light", "lux", "illuminance"}, "light_lux"), ({"step", "steps", "stepcounter", "stepcount", "pedometer"}, "step_count"),
    ({"charging", "charger", "plugged", "plug"}, "charging"), ({"battery", "batt"}, "battery_pct"), ({"time", "elapsed", "timesincestart"}, "time_since_start_ms"),
]
AXIS_WORDS = [
    ({"shipped"}, "residual_shipped_rms"), ({"corrected"}, "residual_corrected_rms"), ({"attitude"}, "attitude_change_deg"),
    ({"min", "speed", "floor"}, "min_speed_mps"), ({"corr", "correlation", "correlations"}, "corr"), ({"slope", "slopes"}, "slope"),
    ({"r2", "squared", "rsquared"}, "r2"), ({"intervals", "interval"}, "n_intervals"), ({"blocks", "block"}, "n_blocks"),
    ({"best", "column"}, "best_column"), ({"verified", "checked"}, "verified"), ({"stem", "sequence", "recording"}, "stem"),
]


def plain(label: str) -> str:
    """The label without letter case and white space: labels that differ in no more than these count as one."""
    return re.sub(r"\s+", "", label.replace("﻿", "")).lower()


def words(label: str) -> list[str]:
    """Lower-case words of a label; units in brackets, camel case and punctuation resolved."""
    text = re.sub(r"[\[(]([^\])]*)[\])]", lambda m: f" {m[1]} " if m[1].strip().lower() in AXES else " ", label.replace("﻿", ""))
    text = re.sub(r"(?<=[a-z0-9])(?=[A-Z][a-z])", " ", text)
    return [w for w in re.split(r"[^a-z0-9]+", text.lower()) if w]


@lru_cache(maxsize=65536)
def resolve(label: str, record_kind: str, known: frozenset[tuple[str, str]]) -> str | None:
    """The canonical field of a label in records of a kind; null where no rule knows it.

    ``known`` holds (spelling without case and white space, field) of the field list itself and comes first.
    """
    for spelling, field in known:
        if plain(label) == spelling:
            return field
    have = words(label)
    bag = set(have)
    if record_kind == "imu":
        family = next((AXIS_FAMILIES[w] for w in have if w in AXIS_FAMILIES), None)
        axis = next((w for w in have if w in AXES), None)
        if family and axis and "gps" not in bag:
            turned = TURN.get(axis, axis) if family in ("gyro", "orientation") else axis
            return f"{family}_{turned}"
        if family == "orientation":
            return "gps_orientation_deg"
    for names, field in IMU_WORDS if record_kind == "imu" else AXIS_WORDS:
        if names & bag:
            return field
    return None
