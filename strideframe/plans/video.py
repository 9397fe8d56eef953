"""Video analyses: clustering of feature tables and supervised cycle boundaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..constants import (
    BASE_PROB_THRESHOLD, DETECTOR_STEP_SEC, EDGE_IGNORE_SEC, MIN_BOUNDARY_GAP_SEC, MIN_WORK_CYCLE_SEC, NON_FEATURE_PATTERNS,
    SEGMENT_K_VALUES, SEGMENT_MAX_ITER, SEGMENT_META, SEGMENT_N_INIT, SMOOTH_PROB_SEC, VIDEO_K_RANGE,
    VIDEO_N_INIT, VIDEO_PROB_QUANTILE,
)
from ..functions.scalars import frames_of, half_even
from ..functions.text import minutes_seconds
from ..operators import features as X
from ..operators import lattice
from ..operators import modeling as ML
from ..operators import series as seq
from ..operators.blocks import Carry, carry, number_rows
from ..operators.intervals import nearest, suppress_neighbours
from ..operators.stats import exact_quantiles, share_of_total
from ..session import materialize
from ..sources.schemas import feature_columns


# --- clustering -----------------------------------------------------------------------
def _settings(scaled: DataFrame, names: Sequence[str], key: str, strict: bool) -> tuple[DataFrame, list[tuple[str, DataFrame, int | None, float | None]]]:
    """Two scores per row for display, and the spaces that are clustered."""
    base = materialize(ML.assemble(scaled, names))
    model, ratios = ML.explained_variance(base)
    display = ML.display_scores(base, model, key)
    out: list = [("Raw", base, None, None)]
    for target in (0.90, 0.95):
        n = ML.components_reaching(ratios, target, strict)
        out.append((f"PCA{round(target * 100)}", ML.project(base, model, n).drop("features").withColumnRenamed("reduced", "features"), n, sum(ratios[:n])))
    return display, out


def cluster_videos(table: DataFrame, *, ks=VIDEO_K_RANGE, n_init: int = VIDEO_N_INIT, expected_features: int | None = 88) -> dict[str, DataFrame]:
    """Mean-filled, standardised feature vectors clustered raw and at 90 / 95 % variance; exact silhouettes."""
    names = [c for c in table.columns if c not in ("Video", "FPS")]
    if expected_features is not None and len(names) != expected_features:
        raise ValueError(f"expected {expected_features} feature columns, got {len(names)}")
    scaled = ML.standardize(ML.fill_with_mean(table, names), names)
    return _sweep(scaled, "Video", names, ks, n_init, 300)


def cluster_segments(table: DataFrame, *, ks=SEGMENT_K_VALUES, n_init: int = SEGMENT_N_INIT) -> dict[str, DataFrame]:
    """Median-filled, standardised segments clustered in three spaces; exact silhouettes."""
    names = feature_columns(table, SEGMENT_META, NON_FEATURE_PATTERNS)
    filled = materialize(ML.fill_with_median(table, names))
    keyed = ML.standardize(filled, names).withColumn("_key", F.concat_ws("/", "Video", "Segment_ID"))
    out = _sweep(keyed, "_key", names, ks, n_init, SEGMENT_MAX_ITER)
    meta = keyed.select("_key", *[c for c in SEGMENT_META if c in table.columns])
    out["assignments"] = out["assignments"].join(meta, "_key").drop("_key")
    out["feature_summary"] = ML.feature_summary(filled, names)
    out["video_distribution"] = share_of_total(out["assignments"], ["Feature_Setting", "K", "Video"], "Cluster", "Segment_Count", "Video_Total_Segments")
    return out


def _sweep(scaled, key, names, ks, n_init, max_iter) -> dict[str, DataFrame]:
    assigned = summary = None
    display, settings = _settings(scaled, names, key, strict=True)
    for setting, df, components, variance in settings:
        a, s = ML.kmeans_sweep(df, key, setting, ks, n_init=n_init, max_iter=max_iter)
        s = s.withColumns({"PCA_N_Components": F.lit(components).cast("int"), "PCA_Explained_Variance": F.lit(variance).cast("double")})
        assigned = a if assigned is None else assigned.unionByName(a)
        summary = s if summary is None else summary.unionByName(s)
    sizes = share_of_total(assigned, ["Feature_Setting", "K"], "Cluster", "Segment_Count", "_t").drop("_t")
    return {"assignments": assigned.join(display, key), "summary": summary.orderBy("Feature_Setting", F.desc("Silhouette_Score")), "top3": ML.top_models(summary), "cluster_sizes": sizes}


# --- sampling rates ---------------------------------------------------------------------
def resolved_fps(videos: DataFrame) -> DataFrame:
    """Sampling rate and its origin from ``frames, duration_sec, container_fps``."""
    measured = F.when(F.col("duration_sec") > 0, F.col("frames") / F.col("duration_sec"))
    container = F.when(F.col("container_fps") > 0, F.col("container_fps"))
    fps = F.coalesce(measured, container, F.lit(20.0))
    source = F.when(measured.isNotNull(), "trajectory_frame_count / ffprobe_duration").when(
        container.isNotNull(), "OpenCV CAP_PROP_FPS fallback").otherwise("default_20fps_fallback")
    return videos.withColumns({
        "fps": fps, "fps_source": source,
        "duration_sec": F.when(measured.isNotNull(), F.col("duration_sec")).otherwise(F.col("frames") / fps),
    })


# --- boundaries ---------------------------------------------------------------------------
def training_set(trajectory: DataFrame, fps: DataFrame, manual: DataFrame) -> DataFrame:
    """Detector features around manual frames (label 1) and at sampled distant centres (label 0)."""
    annotated = trajectory.join(manual.select("video_id").distinct(), "video_id", "left_semi")
    videos = X.with_fps(annotated.groupBy("video_id").agg((F.max("frame") + 1).alias("n")), fps, "video_id")
    half = X.detector_sizes(F.col("fps"))[0]
    marked = manual.join(videos, "video_id")
    positive = materialize(lattice.positive_centres(marked, ["video_id"], "frame", F.col("fps"), F.col("n"), half))
    candidates = lattice.negative_candidates(
        videos, manual.select("video_id", "frame"), ["video_id"], fps=F.col("fps"), n=F.col("n"), half=half, block=F.expr("center_frame div 65536")
    )
    negative = lattice.sample_negatives(materialize(candidates), positive, ["video_id"])
    centres = materialize(positive.withColumn("label", F.lit(1)).unionByName(negative.withColumn("label", F.lit(0))))
    made = X.detector_features(annotated, fps, centres.select("video_id", "center_frame").distinct())
    return made.join(centres, ["video_id", "center_frame"]).withColumn(
        "sample_type", F.when(F.col("label") == 1, "positive").otherwise("negative")
    )


def boundary_probabilities(trajectory: DataFrame, fps: DataFrame, model: PipelineModel) -> DataFrame:
    """Sliding-window probabilities and their rolling median."""
    windows = X.detector_features(trajectory, fps)
    scored = materialize(ML.predict(model, windows, X.detector_names()).select("video_id", "center_frame", "center_time_sec", "probability", "fps"))
    return smooth_probabilities(scored)


def smooth_probabilities(scored: DataFrame) -> DataFrame:
    half, _, step = X.detector_sizes(F.col("fps"))
    placed = scored.withColumn("pos", F.floor((F.col("center_frame") - half) / step))
    points = max(3, round(SMOOTH_PROB_SEC / DETECTOR_STEP_SEC))
    # An even window leans one row back.
    return seq.rolling_median(placed, ["video_id"], {"prob_smooth": "probability"}, points // 2, (points - 1) // 2)


def find_boundaries(probabilities: DataFrame) -> DataFrame:
    """Adaptive-threshold peaks, the global maximum if there are none, thinned to the minimum gap."""
    p = materialize(probabilities.select("video_id", "pos", "center_frame", "center_time_sec", "prob_smooth", "fps"))
    best = F.max(F.struct("prob_smooth", (-F.col("center_frame")).alias("back"), "center_time_sec"))
    per = p.groupBy("video_id").agg(F.max("center_frame").alias("last_frame"), best.alias("best"), F.max("fps").alias("_fps"))
    per = per.join(exact_quantiles(p, ["video_id"], F.col("prob_smooth"), {"q": VIDEO_PROB_QUANTILE}), "video_id").withColumn(
        "threshold", F.greatest(F.lit(BASE_PROB_THRESHOLD), F.col("q"))
    )
    edge = frames_of(EDGE_IGNORE_SEC, F.col("fps"))
    f = F.col("center_frame")
    peaks = materialize(
        seq.local_peaks(p, ["video_id"], "prob_smooth", "_peak").where("_peak").join(per, "video_id")
        .where((f >= edge) & (f <= F.col("last_frame") - edge) & (F.col("prob_smooth") >= F.col("threshold")))
        .select("video_id", "center_frame", "center_time_sec", "prob_smooth", "threshold", "fps")
    )
    lone = per.join(peaks.select("video_id").distinct(), "video_id", "left_anti").where(F.col("best.prob_smooth") >= BASE_PROB_THRESHOLD)
    fallback = lone.select(
        "video_id", (-F.col("best.back")).alias("center_frame"), F.col("best.center_time_sec").alias("center_time_sec"),
        F.col("best.prob_smooth").alias("prob_smooth"), "threshold", F.col("_fps").alias("fps"),
    )
    ready = peaks.unionByName(fallback).withColumn("gap", frames_of(MIN_BOUNDARY_GAP_SEC, F.col("fps")))
    kept = suppress_neighbours(ready, ["video_id"], "center_frame", "prob_smooth", "gap")
    numbered = number_rows(kept, ["video_id"], ["center_frame"], F.expr("center_frame div 1000000"))
    return numbered.select(
        "video_id", (F.col("pos") + 1).alias("Boundary_ID"), F.col("center_frame").alias("Boundary_Frame"),
        half_even(F.col("center_time_sec"), 3).alias("Boundary_Time_sec"), minutes_seconds(F.col("center_time_sec")).alias("Boundary_Time"),
        half_even(F.col("prob_smooth"), 4).alias("Boundary_Probability"), half_even(F.col("threshold"), 4).alias("Threshold_Used"),
        half_even(F.col("fps"), 6).alias("FPS"),
    )


def work_cycles(boundaries: DataFrame) -> DataFrame:
    """Intervals between consecutive boundaries of at least the minimum length, renumbered."""
    nxt = carry(
        boundaries, ["video_id"], "Boundary_Frame",
        {"_f": Carry("lead", F.col("Boundary_Frame")), "_t": Carry("lead", F.col("Boundary_Time_sec")), "_p": Carry("lead", F.col("Boundary_Probability"))},
        F.expr("Boundary_Frame div 1000000"),
    )
    span = F.col("_t") - F.col("Boundary_Time_sec")
    long = nxt.where(span >= MIN_WORK_CYCLE_SEC)
    numbered = number_rows(long, ["video_id"], ["Boundary_Frame"], F.expr("Boundary_Frame div 1000000"))
    return numbered.select(
        "video_id", (F.col("pos") + 1).alias("Work_Cycle_ID"), F.col("Boundary_Frame").alias("Start_Frame"), F.col("_f").alias("End_Frame"),
        F.col("Boundary_Time_sec").alias("Start_sec"), F.col("_t").alias("End_sec"), half_even(span, 3).alias("Duration_sec"),
        minutes_seconds(F.col("Boundary_Time_sec")).alias("Start_Time"), minutes_seconds(F.col("_t")).alias("End_Time"),
        minutes_seconds(span).alias("Duration"), F.col("Boundary_Probability").alias("Start_Boundary_Probability"),
        F.col("_p").alias("End_Boundary_Probability"), "FPS",
    )


def compare_with_manual(boundaries: DataFrame, manual: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nearest predicted boundary of every manual frame, and the error summary per video."""
    predicted = boundaries.select("video_id", F.col("Boundary_Frame").alias("frame"))
    found = nearest(manual.select("video_id", "frame"), predicted, ["video_id"], "frame", block=F.expr("frame div 65536")).where("nearest IS NOT NULL")
    rate = boundaries.groupBy("video_id").agg(F.min_by("FPS", "Boundary_ID").alias("FPS"))
    error = F.col("nearest") - F.col("frame")
    rows = found.join(rate, "video_id").select(
        "video_id", F.col("frame").alias("Manual_Frame"), minutes_seconds(F.col("frame") / F.col("FPS")).alias("Manual_Time"),
        F.col("nearest").alias("Nearest_Predicted_Frame"), minutes_seconds(F.col("nearest") / F.col("FPS")).alias("Nearest_Predicted_Time"),
        error.alias("Frame_Error"), F.abs(error).alias("Abs_Frame_Error"), half_even(error / F.col("FPS"), 3).alias("Time_Error_sec"),
        half_even(F.abs(error) / F.col("FPS"), 3).alias("Abs_Time_Error_sec"), "FPS",
    )
    means = rows.groupBy("video_id").agg(
        F.count("*").alias("Manual_Boundary_Count"), F.avg("Abs_Frame_Error").alias("Mean_Abs_Frame_Error"), F.avg("Abs_Time_Error_sec").alias("Mean_Abs_Time_Error_sec")
    )
    for c in ("Abs_Frame_Error", "Abs_Time_Error_sec"):
        means = means.join(exact_quantiles(rows, ["video_id"], F.col(c), {f"Median_{c}": 0.5}), "video_id")
    return rows, means
