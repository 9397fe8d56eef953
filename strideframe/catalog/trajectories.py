"""Pose-like trajectories derived from the event series: one video per user, one frame per event.

Coordinates are plain arithmetic on the value, the counter and the row position, written
once and used verbatim on both sides. Wrists are missing on error events.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .views import SERIES_SQL, series

_SWING = "(1e0 - abs(pos % 24 - 12) / 12e0)"
COLUMNS = {
    "left_shoulder_x": "4.5e-1 + k * 1e-5", "left_shoulder_y": "3e-1 + v * 1e-6",
    "right_shoulder_x": "5.5e-1 - v * 1e-6", "right_shoulder_y": "3e-1 + k * 1e-5",
    "left_elbow_x": "4.2e-1 + k * 3e-5", "left_elbow_y": "3.8e-1 + v * 3e-6",
    "right_elbow_x": "5.8e-1 - v * 3e-6", "right_elbow_y": "3.9e-1 - k * 2e-5",
    "left_wrist_x": f"CASE WHEN cat <> 'error' THEN 4.5e-1 - 2e-2 * {_SWING} + v * 2e-6 END",
    "left_wrist_y": f"CASE WHEN cat <> 'error' THEN 4.2e-1 + 3e-2 * {_SWING} + k * 3e-6 END",
    "right_wrist_x": f"CASE WHEN cat <> 'error' THEN 5.5e-1 - 2e-2 * {_SWING} + k * 5e-6 END",
    "right_wrist_y": f"CASE WHEN cat <> 'error' THEN 4.3e-1 + 3e-2 * {_SWING} - v * 2e-6 END",
    "left_hip_x": "4.6e-1 + v * 1e-6", "left_hip_y": "6e-1 + k * 2e-5",
    "right_hip_x": "5.4e-1 - k * 1e-5", "right_hip_y": "6.1e-1 + v * 1e-6",
}


def trajectory(spark: SparkSession, sf: str) -> DataFrame:
    s = series(spark, sf)
    return s.select(F.col("entity").alias("video_id"), F.col("pos").alias("frame"), *[F.expr(e).alias(c) for c, e in COLUMNS.items()])


def intervals(spark: SparkSession, sf: str) -> DataFrame:
    """P2 intervals of up to 40 frames, at least ten long."""
    per = series(spark, sf).groupBy(F.col("entity").alias("video_id"), F.expr("pos div 40").alias("c")).agg(F.max("pos").alias("last"))
    return per.where("last - c * 40 >= 9").select(
        "video_id", (F.col("c") + 1).alias("work_cycle_id"), F.lit("P2").alias("phase"),
        (F.col("c") * 40).alias("start_frame"), (F.col("last") + 1).alias("end_frame_exclusive"), F.lit(20.0).alias("fps"),
    )


def fps_table(spark: SparkSession, sf: str) -> DataFrame:
    """Sampling rate of the videos with more than twelve purchases; the others use the default."""
    per = series(spark, sf).groupBy(F.col("entity").alias("video_id")).agg(F.count_if(F.col("cat") == "purchase").alias("n"))
    return per.where("n > 12").select("video_id", F.lit(12.5).alias("fps"))


_LIST = ", ".join(f"{e} AS {c}" for c, e in COLUMNS.items())
TRAJECTORY_SQL = f"""{SERIES_SQL}, traj AS (SELECT entity AS video_id, pos AS frame, {_LIST} FROM series),
  ivl AS (SELECT video_id, c + 1 AS work_cycle_id, c * 40 AS sf, last + 1 AS ef, video_id || ':' || (c + 1) AS cycle_key
    FROM (SELECT entity AS video_id, pos // 40 AS c, max(pos) AS last FROM series GROUP BY 1, 2) WHERE last - c * 40 >= 9),
  rate AS (SELECT video_id, CASE WHEN n > 12 THEN CAST(12.5 AS DOUBLE) ELSE CAST(20 AS DOUBLE) END AS fps, len FROM (
    SELECT entity AS video_id, count(*) FILTER (cat = 'purchase') AS n, count(*) AS len FROM series GROUP BY 1))"""
