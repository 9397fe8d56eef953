"""Identifier, duration, timestamp and list-text expressions."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

# A decimal literal, digit groups optionally joined by single underscores.
_DIGITS = r"[0-9]+(_[0-9]+)*"
_NUMBER = rf"^\s*[+-]?({_DIGITS}(\.({_DIGITS})?)?|\.{_DIGITS})([eE][+-]?{_DIGITS})?\s*$"


def base_name(c: Column) -> Column:
    return F.regexp_extract(c, r"([^/]*)$", 1)


def drop_extension(c: Column) -> Column:
    """Remove the last extension; leading dots do not start one."""
    return F.regexp_replace(c, r"^(\.*[^.].*)\.[^.]*$", "$1")


def fold_numeric(c: Column) -> Column:
    """Numeric text to its integer text (``1.0`` becomes ``1``), other text unchanged."""
    number = F.regexp_replace(F.trim(c), "_", "").cast("double").cast("bigint")
    return F.when(c.rlike(_NUMBER), number.cast("string")).otherwise(c)


def video_name(c: Column) -> Column:
    """Lower-case stem without a trajectory suffix (feature extraction, whole videos)."""
    stem = drop_extension(base_name(F.trim(c)))
    return F.lower(F.regexp_replace(stem, r"_trajectory$", ""))


def boundary_video_id(c: Column) -> Column:
    """Id used by boundary detection: suffix, extension, then numeric folding."""
    name = base_name(F.trim(c))
    name = F.when(
        name.endswith("_trajectory.csv"), F.replace(name, F.lit("_trajectory.csv"), F.lit(""))
    ).otherwise(name)
    return fold_numeric(drop_extension(name))


def plain_video_id(c: Column, suffixes: Iterable[str]) -> Column:
    """Id used by segment tables: remove each suffix anywhere, then numeric folding."""
    name = base_name(F.trim(c))
    for suffix in suffixes:
        name = F.replace(name, F.lit(suffix), F.lit(""))
    return fold_numeric(name)


# Suffixes removed per table, in order.
SEGMENT_SOURCE_SUFFIXES = (".mp4", "_trajectory.csv")
SEGMENT_TABLE_SUFFIXES = ("_segments.csv", ".mp4")
CYCLE_TABLE_SUFFIXES = ("_segments.csv", "_trajectory.csv", ".mp4")


def natural_order(video: str) -> list[Column]:
    """Numeric ids first in numeric order, then the others by text."""
    number = F.when(F.col(video).rlike(_NUMBER), F.col(video)).cast("double").cast("bigint")
    return [number.asc_nulls_last(), F.col(video).asc()]


def minutes_seconds(seconds: Column) -> Column:
    """``"{m}m {s}s"``, truncating; empty for NULL."""
    text = F.format_string(
        "%dm %ds", F.floor(seconds / 60), F.floor(seconds - F.floor(seconds / 60) * 60)
    )
    return F.when(seconds.isNull(), "").otherwise(text)


def hours_minutes_seconds(seconds: Column) -> Column:
    whole = seconds.cast("bigint")
    h, m, s = F.floor(whole / 3600), F.floor((whole % 3600) / 60), whole % 60
    return (
        F.when(h > 0, F.format_string("%dh %dm %ds", h, m, s))
        .when(m > 0, F.format_string("%dm %ds", m, s))
        .otherwise(F.format_string("%ds", s))
    )


def iso_time(c: Column) -> Column:
    """ISO text to a zone-less timestamp; fractions are cut or padded to 6 digits."""
    t = F.trim(c)
    dot = F.instr(t, ".")
    fraction = F.rpad(F.substring(t, dot + 1, F.lit(6)), 6, "0")
    text = F.when(dot > 0, F.concat(F.substring(t, F.lit(1), dot), fraction)).otherwise(t)
    return F.when(t != "", text).cast("timestamp_ntz")


def micros_of(ts: Column) -> Column:
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), ts)


def elapsed_seconds(start: Column, end: Column) -> Column:
    return F.timestamp_diff("MICROSECOND", start, end) / F.lit(1e6)


def cycle_key(video: Column, cycle: Column) -> Column:
    return F.concat_ws(":", video.cast("string"), cycle.cast("string"))


def key_video(key: Column) -> Column:
    """Everything before the first ``:``."""
    return F.substring_index(key, ":", 1)
