"""Angles as columns, in radians; zero is east, counter-clockwise is positive."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def known(value: Column) -> Column:
    """NaN and infinities as null, so that averages skip them and comparisons with them don't hold."""
    return F.when(F.isnan(value) | (F.abs(value) == float("inf")), None).otherwise(value)


def wrap(angle: Column) -> Column:
    """Into [-pi, pi), by the floored modulo."""
    return F.pmod(angle + math.pi, F.lit(2 * math.pi)) - math.pi


def turn(before: Column, after: Column) -> Column:
    """Signed turn from one bearing to the next."""
    return wrap(after - before)


def between(one: Column, other: Column) -> Column:
    """Absolute difference of two bearings."""
    return F.abs(wrap(one - other))


def bearing(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """Direction from the first point to the second."""
    return F.atan2(y1 - y0, x1 - x0)


def distance(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """Euclidean distance."""
    return F.sqrt(F.pow(x1 - x0, F.lit(2)) + F.pow(y1 - y0, F.lit(2)))


def quaternion_yaw(x: Column, y: Column, z: Column, w: Column) -> Column:
    """Yaw of an orientation quaternion."""
    return F.atan2(2 * (w * z + x * y), 1 - 2 * (y * y + z * z))
