"""Numeric, geometric and angular expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def finite(c: Column) -> Column:
    """NaN and infinities become NULL, so comparisons behave as in three-valued logic."""
    return F.when(~F.isnan(c) & (F.abs(c) != F.lit(float("inf"))), c)


def clip(c: Column, low: float, high: float) -> Column:
    """Clip that keeps NULL (``least``/``greatest`` would skip it)."""
    return F.when(c.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), c)))


def half_even(c: Column, digits: int = 0) -> Column:
    return F.bround(c, digits)


def frames_of(seconds: float | Column, fps: Column) -> Column:
    """Seconds to a whole number of frames, rounding ties to even."""
    s = F.lit(seconds) if isinstance(seconds, (int, float)) else seconds
    return F.rint(s * fps).cast("bigint")


def safe_div(a: Column, b: Column) -> Column:
    return F.try_divide(a, b)


def norm(*components: Column) -> Column:
    return F.sqrt(sum((c * c for c in components[1:]), components[0] * components[0]))


def dot(a: Sequence[Column], b: Sequence[Column]) -> Column:
    terms = [x * y for x, y in zip(a, b)]
    return sum(terms[1:], terms[0])


def cosine(a: Sequence[Column], b: Sequence[Column]) -> Column:
    """Clipped cosine similarity; NULL when either vector has zero length."""
    length = norm(*a) * norm(*b)
    return clip(F.when(length > 0, F.try_divide(dot(a, b), length)), -1.0, 1.0)


def joint_angle(p1: Sequence[Column], centre: Sequence[Column], p3: Sequence[Column]) -> Column:
    """Angle at ``centre`` in degrees; NULL when an arm is shorter than 1e-6."""
    a = [x - c for x, c in zip(p1, centre)]
    b = [x - c for x, c in zip(p3, centre)]
    na, nb = norm(*a), norm(*b)
    usable = (na >= 1e-6) & (nb >= 1e-6)
    return F.degrees(F.acos(clip(F.when(usable, dot(a, b) / (na * nb)), -1.0, 1.0)))


def signed_angle(ref: Sequence[Column], vec: Sequence[Column]) -> Column:
    cross = ref[0] * vec[1] - ref[1] * vec[0]
    return F.degrees(F.atan2(cross, dot(ref, vec)))


def wrap_degrees(c: Column) -> Column:
    """Angle in [-180, 180)."""
    return F.pmod(c + 180.0, F.lit(360.0)) - 180.0


def timeline_bin(percent: Column, size: int = 5) -> Column:
    """Left-closed bin index; exactly 100 belongs to no bin."""
    return F.when((percent >= 0) & (percent < 100), F.floor(percent / size).cast("int"))
