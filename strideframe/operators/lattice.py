"""Frame lattices: sliding windows, training centres, resampling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import (
    NEGATIVE_EXCLUSION_SEC, NEGATIVE_RATIO, NEGATIVE_STEP_SEC, POSITIVE_OFFSETS_SEC, RANDOM_SEED,
    SEGMENT_STEP_SEC, SEGMENT_WINDOW_SEC,
)
from ..functions.scalars import frames_of
from .intervals import nearest


def segment_sizes(fps: Column) -> tuple[Column, Column]:
    """Window and step length in frames."""
    length = F.greatest(F.lit(2), frames_of(SEGMENT_WINDOW_SEC, fps))
    step = F.greatest(F.lit(1), frames_of(SEGMENT_STEP_SEC, fps))
    return length.cast("bigint"), step.cast("bigint")


def window_starts(lengths: DataFrame, keys: Sequence[str], n: str, length: Column, step: Column) -> DataFrame:
    """One row per full window: ``window`` (0-based), ``start`` and inclusive ``end``."""
    starts = F.when(F.col(n) >= length, F.sequence(F.lit(0).cast("bigint"), F.col(n) - length, step))
    return (
        lengths.select(*keys, length.alias("_len"), F.posexplode(starts).alias("window", "start"))
        .withColumn("window", F.col("window").cast("bigint"))
        .withColumn("end", F.col("start") + F.col("_len") - 1)
        .drop("_len")
    )


def frames_to_windows(df: DataFrame, pos: str, n: Column, length: Column, step: Column) -> DataFrame:
    """Copy each row into every full window that contains it (``window`` number added).

    A row meets at most ``ceil(length / step)`` windows, so no join is needed.
    """
    p = F.col(pos)
    last = F.floor((n - length) / step)
    first = F.greatest(F.lit(0), F.ceil((p - length + 1) / step))
    upto = F.least(last, F.floor(p / step))
    wins = F.when((n >= length) & (first <= upto), F.sequence(first, upto))
    return df.withColumn("window", F.explode(wins))


def frames_to_centres(df: DataFrame, pos: str, n: Column, half: Column, reach: Column, step: Column) -> DataFrame:
    """Copy rows to every centre ``half + i*step`` (``< n - half``) within ``reach`` frames."""
    p = F.col(pos)
    last = F.floor((n - half - 1 - half) / step)
    first = F.greatest(F.lit(0), F.ceil((p - reach - half) / step))
    upto = F.least(last, F.floor((p + reach - half) / step))
    wins = F.when((last >= 0) & (first <= upto), F.sequence(first, upto))
    return df.withColumn("_i", F.explode(wins)).withColumn("center_frame", half + F.col("_i") * step).drop("_i")


def positive_centres(manual: DataFrame, keys: Sequence[str], frame: str, fps: Column, n: Column, half: Column) -> DataFrame:
    """Manual frames shifted by the fixed offsets, inside the bounds, without repeats."""
    offsets = F.explode(F.array(*[F.lit(o) for o in POSITIVE_OFFSETS_SEC]))
    shifted = manual.withColumn("_o", offsets).withColumn(
        "center_frame", F.rint(F.col(frame) + F.col("_o") * fps).cast("bigint")
    )
    inside = (F.col("center_frame") >= half) & (F.col("center_frame") <= n - half - 1)
    return shifted.where(inside).select(*keys, "center_frame").distinct()


def negative_candidates(
    videos: DataFrame, manual: DataFrame, keys: Sequence[str], *, fps: Column, n: Column, half: Column, block: Column
) -> DataFrame:
    """Lattice centres further than the exclusion from every manual frame."""
    step = F.greatest(F.lit(1), frames_of(NEGATIVE_STEP_SEC, fps)).cast("bigint")
    exclusion = frames_of(NEGATIVE_EXCLUSION_SEC, fps)
    stop = n - half - 1
    lattice = videos.where(stop >= half).select(
        *keys, F.explode(F.sequence(half, stop, step)).alias("center_frame"), exclusion.alias("_ex")
    )
    near = nearest(lattice, manual.withColumnRenamed("frame", "center_frame"), keys, "center_frame", block=block)
    return near.where(F.abs(F.col("center_frame") - F.col("nearest")) > F.col("_ex")).select(*keys, "center_frame")


def sample_negatives(
    candidates: DataFrame, positives: DataFrame, keys: Sequence[str], *, seed: int = RANDOM_SEED
) -> DataFrame:
    """Up to ``NEGATIVE_RATIO`` negatives per positive and video, chosen by a seeded hash order.

    The threshold hash is found by counting hash prefixes, so no video is sorted whole.
    """
    keys = list(keys)
    wanted = candidates.select(*keys).distinct().join(
        positives.groupBy(*keys).agg(F.count("*").alias("_p")), keys, "left"
    ).select(*keys, F.greatest(F.lit(1), F.coalesce("_p", F.lit(0)) * NEGATIVE_RATIO).alias("_want"))
    hashed = candidates.withColumn("_h", F.xxhash64(F.lit(seed), *keys, "center_frame"))
    from .blocks import number_rows

    ranked = number_rows(hashed, keys, ["_h", "center_frame"], F.shiftright("_h", 44), out="_rank")
    return ranked.join(wanted, keys).where(F.col("_rank") < F.col("_want")).select(*keys, "center_frame")


def resample_positions(lengths: DataFrame, keys: Sequence[str], decoded: str, expected: str) -> DataFrame:
    """Source row for each expected frame: evenly spaced over the decoded rows, ties to even.

    A decoded count that already equals the expected one, or has a single row, is kept as is.
    """
    n, m = F.col(decoded), F.col(expected)
    even = F.rint(F.col("frame") * ((n - 1) / (m - 1).cast("double"))).cast("bigint")
    stretch = (n != m) & (n > 1) & (m > 1)
    count = F.when(stretch, m).when((m == 1) & (n > 1), F.lit(1)).otherwise(n)
    frames = lengths.withColumn("frame", F.explode(F.sequence(F.lit(0).cast("bigint"), (count - 1).cast("bigint"))))
    return frames.select(*keys, "frame", F.when(stretch, even).otherwise(F.col("frame")).alias("source"))
