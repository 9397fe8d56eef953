"""Trajectory metrics on arrays of samples.

A trajectory arrives as one array inside one record, so its metrics are array
expressions: no explode, no shuffle. Points are structs with a time ``t`` in
microseconds and coordinates named by the caller.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..constants import BASIC_MIN_SAMPLES, HIGHER_MIN_SAMPLES
from .scalars import cosine, dot, finite, norm
from .text import iso_time, micros_of


def truthy(c: Column) -> Column:
    """JSON truth of a field read as text: missing, null, false, zero and "" are false."""
    return F.coalesce(~F.lower(c).isin("", "false", "null", "0", "0.0", "[]", "{}"), F.lit(False))


def coordinate(c: Column) -> Column:
    """A coordinate field as a finite double, else NULL."""
    return finite(c.try_cast("double"))


def has_point(p: Column) -> Column:
    return coordinate(p["x"]).isNotNull() & coordinate(p["y"]).isNotNull() & coordinate(p["z"]).isNotNull()


def sample_time(c: Column) -> Column:
    return micros_of(iso_time(c))


def unique_times(points: Column) -> Column:
    """Keep the first point per time; ``points`` are sorted by time then recording order."""
    return F.filter(points, lambda e, i: (i == 0) | (e["t"] > F.get(points, i - 1)["t"]))


def steps(points: Column, names: Sequence[str]) -> Column:
    """Displacements between neighbours: ``dt`` and mid time ``mt`` in seconds, one ``d`` per name."""
    first = F.get(points, F.lit(0))["t"]

    def step(e: Column, i: Column) -> Column:
        before = F.get(points, i)
        return F.struct(
            ((e["t"] - before["t"]) / 1e6).alias("dt"),
            ((e["t"] - first) / 1e6 + (before["t"] - first) / 1e6).alias("mt2"),
            *[(e[n] - before[n]).alias(f"d{n}") for n in names],
        )

    return F.transform(F.slice(points, F.lit(2), F.greatest(F.size(points) - 1, F.lit(0))), step)


def _sum(values: Column, f) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, e: acc + f(e))


def duration(points: Column) -> Column:
    n = F.size(points)
    return F.when(n >= 2, (F.get(points, n - 1)["t"] - F.get(points, F.lit(0))["t"]) / 1e6)


def path_length(points: Column, displacements: Column, names: Sequence[str]) -> Column:
    total = _sum(displacements, lambda d: norm(*[d[f"d{n}"] for n in names]))
    return F.when(F.size(points) >= 2, total)


def net_vector(points: Column, names: Sequence[str]) -> list[Column]:
    last, first = F.get(points, F.size(points) - 1), F.get(points, F.lit(0))
    return [last[n] - first[n] for n in names]


def basic_eligible(n: Column, duration_s: Column, path: Column) -> Column:
    return F.coalesce((n >= BASIC_MIN_SAMPLES) & (duration_s > 0) & (path > 0), F.lit(False))


def basic_columns(prefix: str, points: str, displacements: str, names: Sequence[str]) -> dict[str, Column]:
    """n, duration, path, net; eligibility and ratios follow in ``ratio_columns``."""
    p, d = F.col(points), F.col(displacements)
    return {
        f"{prefix}n": F.size(p).cast("bigint"),
        f"{prefix}duration_s": duration(p),
        f"{prefix}path_m": path_length(p, d, names),
        f"{prefix}net_m": F.when(F.size(p) >= 2, norm(*net_vector(p, names))),
    }


def ratio_columns(prefix: str) -> dict[str, Column]:
    n, s = F.col(f"{prefix}n"), F.col(f"{prefix}duration_s")
    path, net = F.col(f"{prefix}path_m"), F.col(f"{prefix}net_m")
    ok = basic_eligible(n, s, path)
    return {
        f"{prefix}path_efficiency": F.when(ok, net / path),
        f"{prefix}mean_speed_m_s": F.when(s > 0, path / s),
        f"{prefix}basic_eligible": ok,
    }


def velocity(displacements: Column, names: Sequence[str]) -> Column:
    """Velocities with mid times ``t`` in seconds."""
    return F.transform(
        displacements,
        lambda d: F.struct((d["mt2"] / 2).alias("t"), *[(d[f"d{n}"] / d["dt"]).alias(n) for n in names]),
    )


def derivative(values: Column, names: Sequence[str]) -> Column:
    """Difference quotient between neighbours, placed at their mid time."""

    def quotient(e: Column, i: Column) -> Column:
        before = F.get(values, i)
        dt = e["t"] - before["t"]
        return F.struct(((e["t"] + before["t"]) / 2).alias("t"), *[((e[n] - before[n]) / dt).alias(n) for n in names])

    return F.transform(F.slice(values, F.lit(2), F.greatest(F.size(values) - 1, F.lit(0))), quotient)


def rms(values: Column, names: Sequence[str]) -> Column:
    total = _sum(values, lambda e: dot([e[n] for n in names], [e[n] for n in names]))
    return F.when(F.size(values) > 0, F.sqrt(total / F.size(values)))


def sample_sd(values: Column) -> Column:
    n = F.size(values)
    mean = F.aggregate(values, F.lit(0.0), lambda a, e: a + e) / n
    return F.when(n >= 2, F.sqrt(F.aggregate(values, F.lit(0.0), lambda a, e: a + (e - mean) * (e - mean)) / (n - 1)))


def turning_degrees(displacements: Column, names: Sequence[str]) -> Column:
    """Sum of angles between neighbouring displacements, zero-length ones skipped."""

    def angle(e: Column, i: Column) -> Column:
        before = F.get(displacements, i)
        c = cosine([before[f"d{n}"] for n in names], [e[f"d{n}"] for n in names])
        return F.coalesce(F.degrees(F.acos(c)), F.lit(0.0))

    later = F.slice(displacements, F.lit(2), F.greatest(F.size(displacements) - 1, F.lit(0)))
    return F.aggregate(F.transform(later, angle), F.lit(0.0), lambda a, e: a + e)


def higher_eligible(n: Column) -> Column:
    return n >= HIGHER_MIN_SAMPLES


def attempts(intervals: Column) -> Column:
    """Distinct attempts in an array of (start, end): touching or overlapping ones merge."""
    usable = F.array_sort(F.filter(intervals, lambda e: e["s"].isNotNull() & (e["e"] >= e["s"])))
    zero = F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(None).cast("bigint").alias("reach"))

    def fold(acc: Column, e: Column) -> Column:
        opens = acc["reach"].isNull() | (e["s"] > acc["reach"])
        return F.struct(
            (acc["n"] + opens.cast("bigint")).alias("n"),
            F.when(opens, e["e"]).otherwise(F.greatest(acc["reach"], e["e"])).alias("reach"),
        )

    return F.aggregate(usable, zero, fold, lambda acc: acc["n"])


def on_grid(points: Column, share: str, value: str, cells: int) -> Column:
    """Linear interpolation at ``i / cells``, i = 0..cells, of points with ``share`` rising from 0 to 1."""

    def piece(e: Column, i: Column) -> Column:
        before = F.get(points, i)
        low, high = F.ceil(before[share] * cells).cast("int"), F.ceil(e[share] * cells).cast("int") - 1
        slope = (e[value] - before[value]) / (e[share] - before[share])
        cover = F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<int>"))
        return F.transform(cover, lambda g: slope * (g / cells - before[share]) + before[value])

    later = F.slice(points, F.lit(2), F.size(points) - 1)
    final = F.array(F.get(points, F.size(points) - 1)[value])
    return F.concat(F.flatten(F.transform(later, piece)), final)


