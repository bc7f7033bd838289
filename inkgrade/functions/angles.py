"""Angle and length columns of segments."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F


def seg_length(x1="x1", y1="y1", x2="x2", y2="y2") -> Column:
    dx, dy = F.col(x2) - F.col(x1), F.col(y2) - F.col(y1)
    return F.sqrt((dx * dx + dy * dy).cast("double"))


def raw_angle(x1="x1", y1="y1", x2="x2", y2="y2") -> Column:
    """Direction in degrees, in (-180, 180]."""
    return F.degrees(F.atan2((F.col(y2) - F.col(y1)).cast("double"), (F.col(x2) - F.col(x1)).cast("double")))


def mod180(angle: Column) -> Column:
    """Undirected angle in [0, 180)."""
    return F.pmod(angle, F.lit(180.0))


def acute(angle: Column) -> Column:
    """Angle to the horizontal in [0, 90] of an angle in [-180, 180]."""
    return F.least(F.abs(angle), 180.0 - F.abs(angle))


def skew_fold(angle: Column) -> Column:
    """Deviation from the nearest axis, in [-45, 45]; the input is in (-180, 180]."""
    half = F.when(angle <= -90, angle + 180.0).when(angle > 90, angle - 180.0).otherwise(angle)
    return F.when(half > 45, half - 90.0).when(half < -45, half + 90.0).otherwise(half)


def axial_diff(a: Column, b: Column) -> Column:
    """Smallest difference of two undirected angles."""
    d = F.abs(a - b) % 180.0
    return F.least(d, 180.0 - d)


def nearest_angle(angle: Column, allowed=(45.0, 60.0, 120.0, 135.0)) -> Column:
    """Struct(diff, idx, target) of the closest allowed angle; the first wins ties."""
    return F.array_min(F.array(*[
        F.struct(axial_diff(angle, F.lit(t)).alias("diff"), F.lit(i).alias("idx"), F.lit(t).alias("target"))
        for i, t in enumerate(allowed)]))


def cosine_sim(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)) + 1e-9)


# Comparing slopes instead of angles saves an arc tangent per test. Segments have whole-number ends, so
# no slope equals the tangent of one of the bounds in use, and both forms agree.
def _rise_run(x1="x1", y1="y1", x2="x2", y2="y2"):
    return F.abs(F.col(y2) - F.col(y1)), F.abs(F.col(x2) - F.col(x1))


def flat(degrees: float) -> Column:
    """Within ``degrees`` of the horizontal."""
    rise, run = _rise_run()
    return rise <= run * math.tan(math.radians(degrees))


def steep(degrees: float) -> Column:
    """At least ``degrees`` from the horizontal."""
    rise, run = _rise_run()
    return (run <= rise * math.tan(math.radians(90 - degrees))) & (rise > 0)


def slanted(low: float, high: float) -> Column:
    """Between ``low`` and ``high`` degrees from the horizontal."""
    rise, run = _rise_run()
    return (rise >= run * math.tan(math.radians(low))) & (rise <= run * math.tan(math.radians(high))) & (rise > 0)
