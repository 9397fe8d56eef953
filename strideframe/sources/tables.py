"""Readers for the delimited and JSON inputs of the analyses."""

from __future__ import annotations

import csv
import os
from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..constants import DEFAULT_FPS
from ..functions.scalars import finite
from ..functions.text import SEGMENT_SOURCE_SUFFIXES, SEGMENT_TABLE_SUFFIXES, boundary_video_id, plain_video_id, video_name
from ..operators.blocks import number_rows
from .schemas import COORDINATES, HIP_COORDINATES, ContractError


#: Order of the rows of one file: the split's place in it, then the row's place in the split.
_ROW_ORDER = ("_block", "_row")


def headers(spark: SparkSession, folder: str, suffix: str = "") -> dict[tuple[str, ...], list[str]]:
    """Column names of the ``*suffix`` files of a folder, and the files that have them in this order.

    The first lines come from one distributed read of the files' first splits.
    """
    lines = spark.read.option("pathGlobFilter", f"*{suffix}").text(folder)
    first = (
        lines.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("_block"), "value")
        .where("_block = 0").withColumn("_row", F.monotonically_increasing_id())
        .groupBy("path").agg(F.min_by("value", "_row").alias("line"))
    )
    found: dict[tuple[str, ...], list[str]] = {}
    for row in first.orderBy("path").collect():
        names = next(csv.reader([(row["line"] or "").removeprefix("\ufeff")]), [])
        found.setdefault(tuple(n.strip() for n in names), []).append(row["path"])
    return found


def scan_csv(spark: SparkSession, folder: str, suffix: str, required: Iterable[str], optional: Iterable[str] = ()) -> DataFrame:
    """All ``*suffix`` files as text columns found by each file's own header, with ``_file`` and the row order.

    Files may order their columns differently and have others besides. A file without a required column is refused.
    """
    required, optional = list(required), list(optional)
    by_header = headers(spark, folder, suffix)
    if not by_header:
        raise FileNotFoundError(f"no *{suffix} files in {folder}")
    faults = [f"{os.path.basename(files[0])} ({len(files)} such): {sorted(gone)}" for names, files in by_header.items() if (gone := set(required) - set(names))]
    if faults:
        raise ContractError(f"files without required columns: {'; '.join(faults)}")
    parts = []
    for names, files in by_header.items():
        schema = T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(len(names))])
        rows = spark.read.schema(schema).option("header", True).option("enforceSchema", True).csv(files)
        wanted = [F.col(f"c{names.index(c)}").alias(c) for c in (*required, *optional) if c in names]
        place = [F.col("_metadata.file_name").alias("_file"), F.col("_metadata.file_block_start").alias("_block")]
        part = rows.select(*wanted, *place).withColumn("_row", F.monotonically_increasing_id())
        parts.append(part)
    return reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), parts)


def number(c: str) -> Column:
    """Text as a finite double; anything else is missing."""
    return finite(F.col(c).try_cast("double"))


def numbered_in_file(rows: DataFrame, out: str) -> DataFrame:
    """Zero-based position of each row of :func:`scan_csv` in its file; splits are the blocks of the count."""
    return number_rows(rows, ["_file"], ["_row"], F.col("_block"), out=out)


def read_trajectories(
    spark: SparkSession, folder: str, *, hips: bool = False, video_rule: str = "boundary"
) -> DataFrame:
    """Every ``*_trajectory.csv``: ``video_id``, ``frame`` and typed coordinates, found by each file's header.

    ``video_rule`` is ``boundary``, which needs a ``frame`` column in every file, or ``stem``, which numbers the rows
    of files that have none.
    """
    names = [*COORDINATES, *(HIP_COORDINATES if hips else ())]
    rule = {"boundary": boundary_video_id, "stem": video_name}[video_rule]
    stem = video_rule == "stem"
    raw = scan_csv(spark, folder, "_trajectory.csv", [*names, *([] if stem else ["frame"])], ["frame"] if stem else [])
    frame = F.col("frame").try_cast("double").cast("bigint") if "frame" in raw.columns else F.lit(None).cast("bigint")
    raw = raw.withColumn("frame", frame)
    if stem:
        # A file has all frames or, lacking the column, none.
        raw = numbered_in_file(raw, "_pos").withColumn("frame", F.coalesce("frame", "_pos"))
    return raw.select(rule(F.col("_file")).alias("video_id"), "frame", *[number(c).alias(c) for c in names])


def _last_rate(rows: DataFrame) -> DataFrame:
    """The rate in the last row of each video: last by file name, then by place in the file."""
    return rows.groupBy("video_id").agg(F.max_by("fps", F.struct("_file", *_ROW_ORDER)).alias("fps"))


def read_fps_by_filename(spark: SparkSession, path: str) -> DataFrame:
    """``Filename,FPS``: positive rates only, the last row of a repeated name wins, never empty."""
    df = scan_csv(spark, path, "", ["Filename", "FPS"])
    rows = df.select(video_name(F.col("Filename")).alias("video_id"), F.col("FPS").try_cast("double").alias("fps"), "_file", *_ROW_ORDER)
    out = _last_rate(rows.where("video_id IS NOT NULL AND fps > 0 AND NOT isnan(fps)"))
    if out.isEmpty():
        raise ValueError("the FPS table holds no positive rate")
    return out


def read_fps_by_video(spark: SparkSession, path: str) -> DataFrame:
    """``Video,FPS``: every rate kept, the last row of a repeated id wins."""
    df = scan_csv(spark, path, "", ["Video", "FPS"])
    video = plain_video_id(F.col("Video"), SEGMENT_SOURCE_SUFFIXES)
    return _last_rate(df.select(video.alias("video_id"), F.col("FPS").try_cast("double").alias("fps"), "_file", *_ROW_ORDER))


def fps_or_default(df: DataFrame, fps: DataFrame) -> DataFrame:
    return df.join(fps, "video_id", "left").fillna(DEFAULT_FPS, ["fps"])


def read_manual_boundaries(spark: SparkSession, path: str) -> DataFrame:
    """JSON object of video to frames, as ``video_id, frame``; an empty object is an error."""
    text = spark.read.option("wholetext", True).text(path)
    pairs = text.select(F.explode(F.from_json("value", "map<string,array<double>>", {"mode": "FAILFAST"})).alias("v", "frames"))
    if pairs.isEmpty():
        raise ValueError("the manual-boundaries JSON must be a non-empty object")
    frames = pairs.select(boundary_video_id(F.col("v")).alias("video_id"), F.explode("frames").alias("frame"))
    return frames.withColumn("frame", F.col("frame").cast("bigint"))


def read_segments(spark: SparkSession, folder: str) -> DataFrame:
    """Every ``*_segments.csv`` united by column name; missing ids come from the file name and row order.

    A column is numeric when all its values in all files are, which one pass over the files finds out.
    """
    names = list(dict.fromkeys(n for header in headers(spark, folder, "_segments.csv") for n in header))
    rows = scan_csv(spark, folder, "_segments.csv", [], names)
    checked = [n for n in names if n not in ("Video", "Segment_ID")]
    kinds = rows.agg(*[
        F.struct(F.bool_and(F.col(c).try_cast("bigint").isNotNull() | F.col(c).isNull()), F.bool_and(F.col(c).try_cast("double").isNotNull() | F.col(c).isNull())).alias(c)
        for c in checked
    ]).first() if checked else {}
    typed = rows.withColumns({c: F.col(c).try_cast("bigint" if kinds[c][0] else "double") for c in checked if kinds[c][1]})
    video = F.coalesce(F.col("Video"), F.col("_file")) if "Video" in names else F.col("_file")
    out = numbered_in_file(typed, "_n").withColumn("Video", plain_video_id(video, SEGMENT_TABLE_SUFFIXES))
    made = F.format_string("segment_%04d", F.col("_n") + 1)
    out = out.withColumn("Segment_ID", F.coalesce(F.col("Segment_ID"), made) if "Segment_ID" in names else made)
    return out.drop("_file", "_n", *_ROW_ORDER)
