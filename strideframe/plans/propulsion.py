"""Bilateral forward candidates within P2 intervals and their characteristics."""

from __future__ import annotations

import math
from functools import reduce
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import (
    BOOTSTRAP_REPLICATES, BOOTSTRAP_SEED, FORWARD_VELOCITY_SW_S, HANDS, IMAGE_HEIGHT_PX, IMAGE_WIDTH_PX,
    MERGE_MAX_GAP_S, MERGE_RETURN_TOLERANCE_SW, MIN_NET_FORWARD_SW, NEEDLE_ANALYSIS_PX, NEEDLE_SCREEN_PX,
    REFERENCE_SHOULDER_WIDTH_M, SYNC_BRIDGE_S, SYNC_MIN_S,
)
from ..functions.scalars import dot, finite, frames_of, norm, signed_angle, wrap_degrees
from ..functions.text import cycle_key
from ..operators import series as seq
from ..operators.blocks import first_rows, number_rows
from ..operators.intervals import adjacent_gaps, interval_join, merge_without_return
from ..operators.stats import circular_summary, distribution, exact_quantiles, quantiles_of_columns
from ..session import materialize
from ..sources.schemas import TableContract, assert_rows, assert_unique

CYCLE = ["video_id", "work_cycle_id", "cycle_key"]
SHOULDERS = tuple(f"{h}_shoulder_{a}" for h in HANDS for a in "xy")
WRISTS = tuple(f"{h}_wrist_{a}" for h in HANDS for a in "xy")
# Accepted spellings of the interval columns.
INTERVAL_ALIASES = {
    "Video ID": "video_id", "Work cycle ID": "work_cycle_id", "Phase": "phase",
    "Start frame": "start_frame", "End frame (exclusive)": "end_frame_exclusive", "FPS": "fps",
}


def standard_intervals(df: DataFrame) -> DataFrame:
    """Typed P2 intervals, exactly one per cycle."""
    df = df.withColumnsRenamed({k: v for k, v in INTERVAL_ALIASES.items() if k in df.columns})
    TableContract("phase intervals", tuple(INTERVAL_ALIASES.values())).check(df)
    out = df.where(F.col("phase").cast("string") == "P2").select(
        F.col("video_id").cast("bigint"), F.col("work_cycle_id").cast("bigint"),
        F.col("start_frame").cast("bigint"), F.col("end_frame_exclusive").cast("bigint"), F.col("fps").cast("double"),
    ).withColumn("cycle_key", cycle_key(F.col("video_id"), F.col("work_cycle_id")))
    assert_unique(out, ["cycle_key"], "P2 interval table")
    return out


def clean_trajectory(df: DataFrame) -> DataFrame:
    """Typed coordinates, unusable ones missing, one row per video and frame."""
    names = [*SHOULDERS, *WRISTS]
    typed = df.select(
        F.col("video_id").cast("bigint"), F.col("frame").try_cast("double").cast("bigint").alias("frame"),
        *[finite(F.col(c).try_cast("double")).alias(c) for c in names],
    ).where("frame IS NOT NULL")
    return first_rows(typed, ["video_id", "frame"], names)


def _px(x: Column, y: Column, sign: float = 1.0) -> list[Column]:
    return [x * IMAGE_WIDTH_PX, y * (sign * IMAGE_HEIGHT_PX)]


def _middle(a: str, b: str, sign: float = 1.0) -> list[Column]:
    return _px((F.col(f"{a}_x") + F.col(f"{b}_x")) * 0.5, (F.col(f"{a}_y") + F.col(f"{b}_y")) * 0.5, sign)


def cycle_frames(trajectory: DataFrame, intervals: DataFrame) -> DataFrame:
    """Trajectory rows inside each half-open cycle, numbered densely per cycle (``pos``)."""
    spans = intervals.select(*CYCLE, "start_frame", "end_frame_exclusive", "fps")
    rows = interval_join(trajectory, spans, ["video_id"], "frame", "start_frame", "end_frame_exclusive")
    return number_rows(rows, ["cycle_key"], ["frame"], F.expr("frame div 65536"))


def prepare_cycles(trajectory: DataFrame, intervals: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Smoothed forward position and velocity of both wrists per cycle row, and the cycle scales."""
    frames = materialize(cycle_frames(trajectory, intervals))
    l, r = [F.col(f"left_shoulder_{a}") for a in "xy"], [F.col(f"right_shoulder_{a}") for a in "xy"]
    mx, my = _middle("left_shoulder", "right_shoulder")
    sized = frames.select(
        "cycle_key", norm(*_px(l[0] - r[0], l[1] - r[1])).alias("width"), mx.alias("mx"), my.alias("my")
    )
    scale = quantiles_of_columns(sized, ["cycle_key"], ["width", "mx", "my"], {"m": 0.5})
    out = [F.lit(NEEDLE_SCREEN_PX[0]) - F.col("mx_m"), F.lit(NEEDLE_SCREEN_PX[1]) - F.col("my_m")]
    counted = frames.groupBy("cycle_key").agg(F.count("*").alias("rows"))
    scales = materialize(intervals.join(counted, "cycle_key", "left").join(scale, "cycle_key", "left").select(
        *CYCLE, "fps", F.col("start_frame").alias("p2_start_frame"), F.col("end_frame_exclusive").alias("p2_end_frame_exclusive"),
        F.col("width_m").alias("median_shoulder_width_px"),
        (out[0] / norm(*out)).alias("outward_axis_screen_x"), (out[1] / norm(*out)).alias("outward_axis_screen_y"), "rows",
    ))
    assert_rows(scales, {
        "at least two rows per interval": F.col("rows") >= 2, "valid shoulder width": F.col("median_shoulder_width_px") > 0,
    })
    axis = [F.col("outward_axis_screen_x"), F.col("outward_axis_screen_y")]
    projected = frames.join(
        scales.select("cycle_key", "median_shoulder_width_px", "outward_axis_screen_x", "outward_axis_screen_y"), "cycle_key"
    ).select(
        "cycle_key", "pos", "frame", "fps",
        *[(dot(_px(F.col(f"{h}_wrist_x"), F.col(f"{h}_wrist_y")), axis) / F.col("median_shoulder_width_px")).alias(f"_{h}") for h in HANDS],
    )
    filled = seq.interpolate(projected, ["cycle_key"], {f"_f_{h}": f"_{h}" for h in HANDS}, mode="inside")
    smooth = seq.smooth_runs(
        filled, ["cycle_key"], {h: f"_f_{h}" for h in HANDS}, velocity={f"{h}_velocity": h for h in HANDS}, scale=F.col("fps")
    )
    rows = smooth.select("cycle_key", "pos", "frame", "fps", *HANDS, *[f"{h}_velocity" for h in HANDS])
    return materialize(rows), scales.drop("rows")


def detect(trajectory: DataFrame, intervals: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Merged automatic candidates and the per-cycle table with raw and merged counts."""
    rows, scales = prepare_cycles(trajectory, intervals)
    fastest = scales.agg(F.max("fps")).first()[0] or 1.0
    bridge = max(1, round(SYNC_BRIDGE_S * fastest))
    both = (F.col("left_velocity") > FORWARD_VELOCITY_SW_S) & (F.col("right_velocity") > FORWARD_VELOCITY_SW_S)
    closed = seq.closed_mask(rows, ["cycle_key"], both, frames_of(SYNC_BRIDGE_S, F.col("fps")), bridge, "sync")
    runs = seq.true_runs(materialize(closed), ["cycle_key"], F.col("sync"))
    ends = rows.select("cycle_key", "pos", *HANDS)

    def at(df: DataFrame, where: str, prefix: str) -> DataFrame:
        named = ends.select("cycle_key", F.col("pos").alias(where), *[F.col(h).alias(f"{prefix}_{h}") for h in HANDS])
        return df.join(named, ["cycle_key", where])

    moved = at(at(runs, "start", "_s"), "end", "_e")
    net = {h: F.col(f"_e_{h}") - F.col(f"_s_{h}") for h in HANDS}
    fps = scales.select("cycle_key", "fps")
    raw = moved.join(fps, "cycle_key").where(
        (F.col("length") >= frames_of(SYNC_MIN_S, F.col("fps")))
        & (net["left"] >= MIN_NET_FORWARD_SW) & (net["right"] >= MIN_NET_FORWARD_SW)
    ).select("cycle_key", "start", "end", "fps")
    raw = materialize(raw)
    merged = merge_without_return(
        raw, rows, ["cycle_key"], list(HANDS), max_gap=frames_of(MERGE_MAX_GAP_S, F.col("fps")),
        tolerance=MERGE_RETURN_TOLERANCE_SW, block=F.expr("start div 65536"),
    )
    spots = rows.select("cycle_key", "pos", "frame", *HANDS)
    named = lambda where, prefix: spots.select(
        "cycle_key", F.col("pos").alias(where), F.col("frame").alias(f"{prefix}_frame"), *[F.col(h).alias(f"_{prefix}_{h}") for h in HANDS]
    )
    full = merged.join(named("start", "start"), ["cycle_key", "start"]).join(named("end", "end"), ["cycle_key", "end"])
    f = F.col("fps")
    candidates = materialize(full.join(scales.select(*CYCLE, "fps"), "cycle_key").select(
        *CYCLE, "candidate_index", "source_raw_candidate_indices", "raw_core_count", "start_frame", "end_frame",
        (F.col("start_frame") / f).alias("start_time_s"), (F.col("end_frame") / f).alias("end_time_s"),
        ((F.col("end_frame") - F.col("start_frame")) / f).alias("duration_s"),
        *[(F.col(f"_end_{h}") - F.col(f"_start_{h}")).alias(f"{h}_net_forward_displacement_sw") for h in HANDS],
        F.lit("automatic_kinematic_candidate").alias("candidate_type"),
    ))
    counts = scales.join(raw.groupBy("cycle_key").agg(F.count("*").alias("raw_candidate_count")), "cycle_key", "left").join(
        candidates.groupBy("cycle_key").agg(F.count("*").alias("automatic_kinematic_candidate_count")), "cycle_key", "left"
    ).fillna(0, ["raw_candidate_count", "automatic_kinematic_candidate_count"])
    return candidates, materialize(counts)


# --- characteristics ----------------------------------------------------------------
def numbered_trajectory(trajectory: DataFrame) -> DataFrame:
    return number_rows(trajectory, ["video_id"], ["frame"], F.expr("frame div 65536"))


def cycle_directions(candidates: DataFrame, cycles: DataFrame, trajectory: DataFrame) -> DataFrame:
    """Principal direction of wrist midpoints per cycle against the task's outward axis (y up)."""
    spans = cycles.select(*CYCLE, "p2_start_frame", "p2_end_frame_exclusive")
    shoulders = trajectory.where(" AND ".join(f"{c} IS NOT NULL" for c in SHOULDERS))
    inside = interval_join(shoulders, spans, ["video_id"], "frame", "p2_start_frame", "p2_end_frame_exclusive")
    mx, my = _middle("left_shoulder", "right_shoulder", -1.0)
    per_cycle = quantiles_of_columns(
        inside.select("video_id", "cycle_key", mx.alias("mx"), my.alias("my")), ["video_id", "cycle_key"], ["mx", "my"], {"m": 0.5}
    )
    per_video = quantiles_of_columns(per_cycle, ["video_id"], ["mx_m", "my_m"], {"v": 0.5})
    away = [F.lit(NEEDLE_ANALYSIS_PX[0]) - F.col("mx_m_v"), F.lit(NEEDLE_ANALYSIS_PX[1]) - F.col("my_m_v")]
    reference = per_video.select("video_id", (away[0] / norm(*away)).alias("task_outward_x"), (away[1] / norm(*away)).alias("task_outward_y"))

    smooth = seq.rolling_median(numbered_trajectory(trajectory), ["video_id"], {f"_{c}": c for c in WRISTS}, 1, 1, min_valid=2)
    wx = (F.col("_left_wrist_x") + F.col("_right_wrist_x")) * (0.5 * IMAGE_WIDTH_PX)
    wy = (F.col("_left_wrist_y") + F.col("_right_wrist_y")) * (-0.5 * IMAGE_HEIGHT_PX)
    points = smooth.select("video_id", "frame", wx.alias("x"), wy.alias("y")).where("x IS NOT NULL AND y IS NOT NULL")
    events = candidates.select("video_id", "cycle_key", "start_frame", "end_frame")
    used = interval_join(points, events, ["video_id"], "frame", "start_frame", "end_frame", closed=True)
    unique = used.groupBy("video_id", "cycle_key", "frame").agg(F.first("x").alias("x"), F.first("y").alias("y"))
    axes = unique.groupBy("video_id", "cycle_key").agg(
        F.count("*").alias("paired_candidate_frames"), F.var_pop("x").alias("_vx"), F.var_pop("y").alias("_vy"), F.covar_pop("x", "y").alias("_c")
    )
    return principal_axis(axes.join(reference, "video_id")).join(cycles.select("cycle_key", "work_cycle_id"), "cycle_key").select(
        *CYCLE, "paired_candidate_frames", "task_outward_x", "task_outward_y", "propulsion_axis_x", "propulsion_axis_y",
        "angle_deg", F.abs("angle_deg").alias("absolute_angle_deg"), "pc1_variance_fraction",
    )


def principal_axis(df: DataFrame) -> DataFrame:
    """First principal axis from ``_vx, _vy, _c``, turned towards the reference, with its share and angle."""
    vx, vy, c = F.col("_vx"), F.col("_vy"), F.col("_c")
    theta = F.atan2(2 * c, vx - vy) * 0.5
    ref = [F.col("task_outward_x"), F.col("task_outward_y")]
    ax, ay = F.cos(theta), F.sin(theta)
    turn = F.when(ax * ref[0] + ay * ref[1] < 0, -1.0).otherwise(1.0)
    out = df.withColumns({"propulsion_axis_x": ax * turn, "propulsion_axis_y": ay * turn})
    spread = F.sqrt((vx - vy) * (vx - vy) / 4 + c * c)
    return out.withColumns({
        "pc1_variance_fraction": F.try_divide((vx + vy) / 2 + spread, vx + vy),
        "angle_deg": signed_angle(ref, [F.col("propulsion_axis_x"), F.col("propulsion_axis_y")]),
    })


def event_metrics(candidates: DataFrame, cycles: DataFrame, axes: DataFrame, trajectory: DataFrame) -> DataFrame:
    """Displacement, excursion, separation, path and speed of every candidate, in shoulder widths."""
    filled = seq.interpolate(numbered_trajectory(trajectory), ["video_id"], {f"_f_{c}": c for c in WRISTS}, mode="inside")
    smooth = seq.smooth_runs(filled, ["video_id"], {f"_m_{c}": f"_f_{c}" for c in WRISTS})
    l = _px(F.col("_m_left_wrist_x"), F.col("_m_left_wrist_y"), -1.0)
    r = _px(F.col("_m_right_wrist_x"), F.col("_m_right_wrist_y"), -1.0)
    named = smooth.select(
        "video_id", "frame", "pos", l[0].alias("lx"), l[1].alias("ly"), r[0].alias("rx"), r[1].alias("ry")
    ).withColumns({"mx": (F.col("lx") + F.col("rx")) * 0.5, "my": (F.col("ly") + F.col("ry")) * 0.5})
    w = seq.halo_window(["video_id"])
    near = seq.with_halo(named, 1, ahead=0)
    step = norm(F.col("mx") - F.lag("mx").over(w), F.col("my") - F.lag("my").over(w))
    stepped = seq.own_rows(near.withColumn("_step", F.when(F.col("frame") - F.lag("frame").over(w) == 1, step)))
    valid = materialize(stepped.where("mx IS NOT NULL AND my IS NOT NULL"))
    keys = [*CYCLE, "candidate_index"]
    spans = candidates.select(*keys, "start_frame", "end_frame", "start_time_s", "end_time_s", "duration_s")
    known = spans.join(axes.select("cycle_key", "propulsion_axis_x", "propulsion_axis_y"), "cycle_key").join(
        cycles.select("cycle_key", "median_shoulder_width_px"), "cycle_key"
    )
    rows = interval_join(valid, known, ["video_id"], "frame", "start_frame", "end_frame", closed=True)
    p = [F.col("propulsion_axis_x"), F.col("propulsion_axis_y")]
    across = [-p[1], p[0]]
    m = [F.col("mx"), F.col("my")]
    placed = materialize(rows.select(
        *keys, "frame", "start_frame", "_step", "median_shoulder_width_px",
        dot(m, p).alias("axial"), dot(m, across).alias("lateral"),
        F.abs(dot([F.col("rx") - F.col("lx"), F.col("ry") - F.col("ly")], across)).alias("transverse"),
    ))
    sw = F.max("median_shoulder_width_px")
    signed = (F.max_by("axial", "frame") - F.min_by("axial", "frame")) / sw
    path = F.coalesce(F.sum(F.when(F.col("frame") > F.col("start_frame"), F.col("_step"))), F.lit(0.0)) / sw
    sums = placed.groupBy(*keys).agg(
        F.count("*").alias("valid_bilateral_samples"), F.abs(signed).alias("axial_displacement_sw"),
        signed.alias("signed_axial_displacement_sw"), ((F.max("lateral") - F.min("lateral")) / sw).alias("lateral_excursion_sw"),
        path.alias("wrist_midpoint_path_length_sw"), sw.alias("_sw"),
    )
    middle = exact_quantiles(placed, keys, F.col("transverse"), {"_t": 0.5})
    return spans.join(sums, keys, "left").join(middle, keys, "left").select(
        *keys, "start_frame", "end_frame", "start_time_s", "end_time_s", "duration_s", "valid_bilateral_samples",
        "axial_displacement_sw", "signed_axial_displacement_sw", "lateral_excursion_sw",
        (F.col("_t") / F.col("_sw")).alias("transverse_wrist_separation_sw"), "wrist_midpoint_path_length_sw",
        F.when(F.col("duration_s") > 0, F.col("wrist_midpoint_path_length_sw") / F.col("duration_s")).alias("wrist_midpoint_path_speed_sw_per_s"),
    )


def candidate_gaps(metrics: DataFrame) -> DataFrame:
    """Seconds from the previous candidate's end to the next onset within a cycle."""
    flagged = metrics.select(*CYCLE, "candidate_index", "start_frame", "start_time_s", "end_time_s", F.lit(True).alias("_all"))
    out = adjacent_gaps(flagged, ["cycle_key"], "start_time_s", "end_time_s", "_all", order="start_frame", block=F.expr("start_frame div 65536"))
    return out.select(
        *CYCLE, (F.col("candidate_index") - 1).alias("preceding_candidate_index"),
        F.col("candidate_index").alias("current_candidate_index"), F.col("gap").alias("inter_action_gap_s"),
    )


#: Modulus and factors of the draw: products of two residues stay below 2^62.
DRAW_MODULUS, DRAW_FACTORS = (1 << 31) - 1, (48271, 69621)


def poisson_thresholds(modulus: int = DRAW_MODULUS) -> list[int]:
    """Residues from which on a uniform draw counts 1, 2, ... in a Poisson distribution of mean one."""
    masses = [math.exp(-1) / math.factorial(k) for k in range(13)]
    return [int(modulus * sum(masses[: k + 1])) for k in range(12)]


def draw_key(video: str) -> Column:
    """28 bits of a video's id, whatever its type."""
    return F.conv(F.substring(F.md5(F.col(video).cast("string")), 1, 7), 16, 10).cast("bigint")


def with_weight(df: DataFrame, key: str, replicate: str, seed: int, out: str) -> DataFrame:
    """How often a key is drawn in a replicate: a Poisson(1) count from an integer hash of key, replicate and seed."""
    (a, b), m = DRAW_FACTORS, DRAW_MODULUS
    steps = (f"({key} * {a} + {replicate} * {b} + {seed}) % {m}", f"(_x * _x + {key}) % {m}", f"(_x * _x + {replicate}) % {m}")
    for step in steps:
        df = df.withColumn("_x", F.expr(step))
    counts = [(F.col("_x") >= t).cast("int") for t in poisson_thresholds()]
    return df.withColumn(out, reduce(Column.__add__, counts)).drop("_x")


def cluster_bootstrap(axes: DataFrame, *, replicates: int = BOOTSTRAP_REPLICATES, seed: int = BOOTSTRAP_SEED) -> DataFrame:
    """Percentile interval of the circular mean, resampling whole videos (one row).

    Every video counts a Poisson(1) number of times in every replicate, drawn from a hash, so the draws need no
    stream, no numbering and no other video. Each task sums its videos' weighted vectors per replicate before one row
    per replicate is shuffled.
    """
    rad = F.radians("angle_deg")
    sums = axes.groupBy("video_id").agg(F.sum(F.sin(rad)).alias("s"), F.sum(F.cos(rad)).alias("c"))
    per = materialize(sums.withColumn("key", draw_key("video_id")))
    drawn = with_weight(per.withColumn("r", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1)))), "key", "r", seed, "w")
    totals = {n: F.sum(F.col(n) * F.col("w")).alias(n) for n in ("s", "c")}
    means = drawn.groupBy("r").agg(*totals.values(), F.sum("w").alias("w")).where("w > 0")
    videos, s, c = per.agg(F.count("*"), F.sum("s"), F.sum("c")).first()
    point = math.degrees(math.atan2(s, c)) if videos else None
    offsets = means.select(wrap_degrees(F.degrees(F.atan2("s", "c")) - F.lit(point)).alias("o"))
    q = exact_quantiles(offsets, [], F.col("o"), {"low": 0.025, "high": 0.975})
    return q.select(
        F.lit(videos).cast("bigint").alias("video_clusters"), F.lit(replicates).cast("bigint").alias("replicates"),
        wrap_degrees(F.lit(point) + F.col("low")).alias("interval_low_deg"), wrap_degrees(F.lit(point) + F.col("high")).alias("interval_high_deg"),
    )


def cycle_medians(metrics: DataFrame) -> DataFrame:
    q = quantiles_of_columns(metrics, CYCLE, ["axial_displacement_sw", "lateral_excursion_sw"], {"m": 0.5})
    return q.select(
        *CYCLE, F.col("axial_displacement_sw_m").alias("cycle_median_axial_displacement_sw"),
        F.col("lateral_excursion_sw_m").alias("cycle_median_lateral_excursion_sw"),
    )


def reconcile_counts(cycles: DataFrame, candidates: DataFrame, axes: DataFrame, metrics: DataFrame) -> DataFrame:
    """A ledger of every cycle that any table names: rows per table, the reported number of candidates, and ``agrees``.

    A cycle agrees when it is listed once, has one direction where it has candidates, and its candidates, their metrics and
    the reported number are the same count. Every table is counted before the full joins, so they are one to one.
    """
    sides = [
        cycles.groupBy("cycle_key").agg(F.count("*").alias("n_cycles"), F.max("automatic_kinematic_candidate_count").cast("bigint").alias("reported_candidates")),
        candidates.groupBy("cycle_key").agg(F.count("*").alias("n_candidates")), axes.groupBy("cycle_key").agg(F.count("*").alias("n_directions")),
        metrics.groupBy("cycle_key").agg(F.count("*").alias("n_metrics")),
    ]
    ledger = reduce(lambda a, b: a.join(b, "cycle_key", "full"), sides).fillna(0)
    one_direction = F.col("n_directions") == F.when(F.col("n_candidates") > 0, 1).otherwise(0)
    same = (F.col("n_candidates") == F.col("reported_candidates")) & (F.col("n_metrics") == F.col("n_candidates"))
    return ledger.withColumn("agrees", (F.col("n_cycles") == 1) & one_direction & same)


def check_ledger(ledger: DataFrame, named: int = 20) -> None:
    """Fail with the first cycles that don't agree and their counts."""
    wrong = ledger.where("NOT agrees").orderBy("cycle_key").limit(named).collect()
    if wrong:
        raise ValueError("counts differ in cycles " + "; ".join(str(r.asDict()) for r in wrong))


def summarize(candidates: DataFrame, cycles: DataFrame, trajectory: DataFrame, *, shoulder_width_m: float = REFERENCE_SHOULDER_WIDTH_M) -> dict:
    """All characteristic tables and the one-document summary."""
    axes = materialize(cycle_directions(candidates, cycles, trajectory))
    assert_rows(axes, {"three paired samples per cycle": F.col("paired_candidate_frames") >= 3, "non-degenerate direction": F.col("pc1_variance_fraction").isNotNull()})
    metrics = materialize(event_metrics(candidates, cycles, axes, trajectory))
    ledger = materialize(reconcile_counts(cycles, candidates, axes, metrics))
    check_ledger(ledger)
    if axes.count() != cycles.count():
        raise ValueError("every retained cycle must yield one direction estimate")
    primary = ("duration_s", "axial_displacement_sw", "lateral_excursion_sw", "transverse_wrist_separation_sw", "wrist_midpoint_path_speed_sw_per_s")
    assert_rows(metrics, {"paired samples": F.col("valid_bilateral_samples") >= 2, **{f"finite {c}": F.abs(c) < float("inf") for c in primary}})
    gaps = materialize(candidate_gaps(metrics))
    assert_rows(gaps, {"gaps are not negative": F.col("inter_action_gap_s") >= 0})
    medians = materialize(cycle_medians(metrics))
    p90 = {n: exact_quantiles(medians, [], F.col(f"cycle_median_{c}"), {"p90": 0.9}).first()["p90"] for n, c in (
        ("axial_displacement_design_basis", "axial_displacement_sw"), ("lateral_excursion_design_basis", "lateral_excursion_sw"))}
    described = {
        "candidate_count_per_cycle": (cycles, "automatic_kinematic_candidate_count"),
        "eventwise_transverse_wrist_separation": (metrics, "transverse_wrist_separation_sw"), "candidate_duration": (metrics, "duration_s"),
        "inter_action_gap": (gaps, "inter_action_gap_s"), "wrist_midpoint_path_speed": (metrics, "wrist_midpoint_path_speed_sw_per_s"),
    }
    summary = {name: distribution(df, [], c).first().asDict() for name, (df, c) in described.items()}
    summary["cohort"] = {
        "retained_cycles": cycles.count(), "automatic_kinematic_candidates": candidates.count(), "within_cycle_adjacent_candidate_pairs": gaps.count(),
    }
    summary["propulsion_direction"] = {**circular_summary(axes, [], "angle_deg").first().asDict(), **cluster_bootstrap(axes).first().asDict()}
    for name, value in p90.items():
        summary[name] = {"p90_sw": value, "reference_scaled_m": value * shoulder_width_m}
    for name, unit in (("eventwise_transverse_wrist_separation", "m"), ("wrist_midpoint_path_speed", "m_per_s")):
        summary[name][f"reference_scaled_median_{unit}"] = summary[name]["median"] * shoulder_width_m
    summary["reference_scaling"] = {"reference_shoulder_width_m": shoulder_width_m}
    return {"directions": axes, "metrics": metrics, "gaps": gaps, "cycle_medians": medians, "ledger": ledger, "summary": summary}
