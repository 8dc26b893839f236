"""Wind vectors and angles. NULL in, NULL out; NaN propagates."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from aeroframe.functions.common import NAN, col, divide


def wind_speed(u, v) -> Column:
    return F.hypot(col(u), col(v))


def wind_direction(u, v) -> Column:
    """Direction the wind comes from, degrees in [0, 360); calm gives 270."""
    return F.pmod(F.lit(270.0) - F.degrees(F.atan2(col(v), col(u))), F.lit(360.0))


def wind_speed_direction_to_uv(speed, direction) -> tuple[Column, Column]:
    angle = F.radians(col(direction))
    return -col(speed) * F.sin(angle), -col(speed) * F.cos(angle)


def angle_between(first, second, degrees: bool = True) -> Column:
    """Unsigned angle of two array columns; NaN where one has no length."""
    a, b = col(first), col(second)
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, p: s + p)
    cosine = F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))
    angle = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine)))
    return F.when(cosine.isNull(), F.lit(NAN)).otherwise(F.degrees(angle) if degrees else angle)


def circular_error(model, observed) -> Column:
    """Signed angular difference in [-180, 180)."""
    return F.pmod(col(model) - col(observed) + 180.0, F.lit(360.0)) - 180.0


def rotate_vectors(u, v, degrees) -> tuple[Column, Column]:
    """Counter-clockwise rotation."""
    a = F.radians(col(degrees))
    return col(u) * F.cos(a) - col(v) * F.sin(a), col(u) * F.sin(a) + col(v) * F.cos(a)


def rotate_velocity(u, v, w, horizontal_degrees: float = 0.0, vertical_degrees: float = 0.0) -> tuple[Column, Column, Column]:
    """Rotation about the vertical axis, then about the lateral axis."""
    h, t = math.radians(horizontal_degrees), math.radians(vertical_degrees)
    x = col(u) * math.cos(h) - col(v) * math.sin(h)
    y = col(u) * math.sin(h) + col(v) * math.cos(h)
    return x * math.cos(t) + col(w) * math.sin(t), y, -x * math.sin(t) + col(w) * math.cos(t)


def speed_up_ratio(speed, reference, minimum_reference: float = 0.1) -> Column:
    return F.when(F.abs(col(reference)) < minimum_reference, F.lit(NAN)).otherwise(divide(speed, reference))


def stress_from_moment(moment, distance, inertia) -> Column:
    return divide(col(moment) * col(distance), inertia)
