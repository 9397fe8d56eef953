"""Motion segments mapped onto work cycles, and their composition."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import CLUSTER_NAMES, TIMELINE_BIN_PERCENT
from ..functions.scalars import clip, timeline_bin
from ..functions.text import CYCLE_TABLE_SUFFIXES, natural_order, plain_video_id
from ..operators.blocks import number_rows, ranked_by_range
from ..operators.intervals import interval_join
from ..operators.stats import share_of_total

CYCLE_COLUMNS = (
    "Video_ID", "Cycle_Number_In_Video", "Cycle_ID", "Cycle_Start_Frame", "Cycle_End_Frame", "Cycle_Duration_sec",
)
# Cycles last at least 30 s, so a stretch of this many frames holds few of them.
NUMBER_BUCKET_FRAMES = 1_000_000


def first_present(df: DataFrame, candidates: Sequence[str], required: bool = True) -> str | None:
    found = next((c for c in candidates if c in df.columns), None)
    if found is None and required:
        raise ValueError(f"none of the columns {list(candidates)} is present")
    return found


def cluster_name(cluster: Column) -> Column:
    pairs = [F.lit(x) for item in CLUSTER_NAMES.items() for x in item]
    return F.try_element_at(F.create_map(*pairs), cluster)


def standard_segments(df: DataFrame) -> DataFrame:
    start, end = F.col("Start_Frame").cast("double"), F.col("End_Frame").cast("double")
    cluster = first_present(df, ["Cluster", "cluster"])
    keep = [c for c in ("Segment_ID",) if c in df.columns]
    return df.select(
        plain_video_id(F.col(first_present(df, ["Video"])).cast("string"), CYCLE_TABLE_SUFFIXES).alias("Video_ID"),
        *keep,
        start.alias("Segment_Start_Frame"), end.alias("Segment_End_Frame"),
        ((start + end) / 2).alias("Segment_Center_Frame"),
        F.col(cluster).cast("int").alias("Cluster"),
        *[F.col(c).cast("double").alias("Segment_FPS") for c in ("FPS",) if c in df.columns],
    )


def standard_cycles(df: DataFrame, segments: DataFrame | None = None) -> DataFrame:
    """Typed cycles numbered per video by start; a missing FPS comes from the segments."""
    video = plain_video_id(F.col(first_present(df, ["Video"])).cast("string"), CYCLE_TABLE_SUFFIXES)
    named = first_present(df, ["Work_Cycle_ID", "Work Cycle", "Work_Cycle", "Cycle_ID", "Cycle"], required=False)
    out = df.select(
        video.alias("Video_ID"),
        F.col("Start_Frame").cast("double").alias("Cycle_Start_Frame"),
        F.col("End_Frame").cast("double").alias("Cycle_End_Frame"),
        (F.col(f"`{named}`").cast("string") if named else F.lit(None).cast("string")).alias("Cycle_ID"),
        *([F.col("FPS").cast("double").alias("FPS")] if "FPS" in df.columns else []),
    )
    if "FPS" not in df.columns:
        if segments is None or "Segment_FPS" not in segments.columns:
            raise ValueError("FPS is in neither the cycle table nor the segment table")
        fps = segments.groupBy("Video_ID").agg(F.first("Segment_FPS", True).alias("FPS"))
        out = out.join(fps, "Video_ID", "left")
    bucket = F.floor(F.col("Cycle_Start_Frame") / NUMBER_BUCKET_FRAMES)
    out = number_rows(out, ["Video_ID"], ["Cycle_Start_Frame", "Cycle_End_Frame", "Cycle_ID"], bucket, out="_n")
    number = F.col("_n") + 1
    return out.select(
        "Video_ID", number.alias("Cycle_Number_In_Video"),
        F.coalesce("Cycle_ID", F.format_string("Cycle %d", number)).alias("Cycle_ID"),
        "Cycle_Start_Frame", "Cycle_End_Frame", "FPS",
        (F.col("Cycle_End_Frame") - F.col("Cycle_Start_Frame")).alias("Cycle_Duration_Frames"),
        ((F.col("Cycle_End_Frame") - F.col("Cycle_Start_Frame")) / F.col("FPS")).alias("Cycle_Duration_sec"),
    )


def map_segments(segments: DataFrame, cycles: DataFrame) -> DataFrame:
    """Segment midpoints assigned to half-open cycles, with relative time columns."""
    joined = interval_join(
        segments, cycles, ["Video_ID"], "Segment_Center_Frame", "Cycle_Start_Frame", "Cycle_End_Frame"
    )
    span = F.col("Cycle_End_Frame") - F.col("Cycle_Start_Frame")
    relative = {}
    for part in ("Start", "End", "Center"):
        frames = F.col(f"Segment_{part}_Frame") - F.col("Cycle_Start_Frame")
        relative[f"Relative_{part}_Frame"] = frames
        relative[f"Relative_{part}_sec"] = frames / F.col("FPS")
        relative[f"Relative_{part}_Percent"] = frames / span * 100
        relative[f"Relative_{part}_Percent_Clipped"] = clip(frames / span * 100, 0.0, 100.0)
    return joined.withColumns(relative)


def number_filled_cycles(mapped: DataFrame) -> DataFrame:
    """Add ``Cycle_Index_Global``: 1-based over cycles that received segments, videos in natural order."""
    filled = mapped.select("Video_ID", "Cycle_Number_In_Video").distinct()
    per_video = filled.groupBy("Video_ID").agg(F.count("*").alias("_n"))
    ahead = ranked_by_range(per_video, natural_order("Video_ID"), {"_offset": F.col("_n")}, out="_video_rank")
    offsets = ahead.select("Video_ID", "_offset")
    inside = number_rows(
        filled, ["Video_ID"], ["Cycle_Number_In_Video"], F.expr("Cycle_Number_In_Video div 65536"), out="_inside"
    )
    index = inside.join(offsets, "Video_ID").select(
        "Video_ID", "Cycle_Number_In_Video",
        (F.col("_offset") + F.col("_inside") + 1).alias("Cycle_Index_Global"),
    )
    return mapped.join(index, ["Video_ID", "Cycle_Number_In_Video"])


def cluster_distribution(mapped: DataFrame) -> DataFrame:
    """Segments and share per cluster over all mapped cycles."""
    out = share_of_total(mapped, [], "Cluster", "Segment_Count", "_total").drop("_total")
    return out.withColumn("Cluster_Name", cluster_name(F.col("Cluster")))


def cycle_composition(mapped: DataFrame) -> DataFrame:
    """Segments and share per cycle and cluster."""
    out = share_of_total(mapped, CYCLE_COLUMNS, "Cluster", "Segment_Count", "Cycle_Total_Segments")
    return out.withColumn("Cluster_Name", cluster_name(F.col("Cluster")))


def composition_wide(composition: DataFrame, clusters: Sequence[int] | None = None) -> DataFrame:
    """One row per cycle with ``Cluster_{c}_Percent``, absent clusters as 0."""
    grouped = composition.groupBy(*CYCLE_COLUMNS)
    pivot = grouped.pivot("Cluster", list(clusters)) if clusters else grouped.pivot("Cluster")
    wide = pivot.agg(F.first("Percentage"))
    found = [c for c in wide.columns if c not in CYCLE_COLUMNS]
    return wide.fillna(0.0, subset=found).withColumnsRenamed({c: f"Cluster_{c}_Percent" for c in found})


def timeline_distribution(mapped: DataFrame) -> DataFrame:
    """Cluster shares in left-closed bins of normalised cycle time.

    Every non-empty bin lists every cluster that occurs anywhere, with zero counts.
    """
    size = TIMELINE_BIN_PERCENT
    binned = mapped.withColumn("bin", timeline_bin(F.col("Relative_Center_Percent_Clipped"), size))
    counts = binned.where("bin IS NOT NULL").groupBy("bin", "Cluster").agg(F.count("*").alias("Segment_Count"))
    totals = counts.groupBy("bin").agg(F.sum("Segment_Count").alias("Bin_Total"))
    bins = F.explode(F.sequence(F.lit(0), F.lit(100 // size - 1)))
    every = mapped.select("Cluster").distinct().select("Cluster", bins.alias("bin"))
    full = every.join(totals, "bin").join(counts, ["bin", "Cluster"], "left").fillna(0, ["Segment_Count"])
    left = F.col("bin") * size
    return full.select(
        "bin", "Cluster", "Segment_Count", "Bin_Total",
        (F.col("Segment_Count") / F.col("Bin_Total") * 100).alias("Percentage"),
        cluster_name(F.col("Cluster")).alias("Cluster_Name"),
        F.format_string("[%d, %d)", left, left + size).alias("Bin_Label"),
        (left + size / 2).alias("Bin_Center_Percent"),
    )
