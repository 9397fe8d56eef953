"""Motion features: 88 per video, 88 per sliding segment, 293 per detector window."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import AXIS_FEATURES, DEFAULT_FPS, DETECTOR_STEP_SEC, DETECTOR_WINDOW_SEC, EIGHT_STATS, MOTION_JOINTS
from ..functions import windowmath as M
from ..functions.scalars import frames_of, joint_angle
from ..session import materialize
from ..sources.schemas import COORDINATES, HIP_COORDINATES
from . import series as seq
from .blocks import number_rows
from .lattice import segment_sizes
from .sliding import BLOCK, complete, in_blocks, matrix, sorted_blocks, stacks, starts_of
from .spectra import series_spectrum

SIDES = ("left", "right")
ANGLES = tuple(f"{s}_{j}_angle" for s in SIDES for j in ("shoulder", "elbow"))
ANGLE_STATS = ("mean", "std", "change_mean", "change_std")


def feature_names() -> list[str]:
    """The 88 names: joint, feature, axis; then side, joint, angle statistic."""
    axis = [f"{j}_{f}_{a}" for j in MOTION_JOINTS for a in ("x", "y") for f in AXIS_FEATURES]
    return axis + [f"{a}_{s}" for a in ANGLES for s in ANGLE_STATS]


def with_fps(df: DataFrame, fps: DataFrame, key: str, default: float = DEFAULT_FPS) -> DataFrame:
    """Sampling rate per video, with the default where the table has none."""
    return df.join(fps.select(key, "fps"), key, "left").fillna(default, ["fps"])


def numbered(trajectory: DataFrame) -> DataFrame:
    return number_rows(trajectory, ["video_id"], ["frame"], F.expr("frame div 65536"))


# --- whole videos ------------------------------------------------------------------
def video_angles() -> dict[str, Column]:
    """Video-level angles: elbow, shoulder, opposite shoulder; and shoulder, elbow, wrist."""
    point = lambda j: [F.col(f"{j}_x"), F.col(f"{j}_y")]
    out = {}
    for side, other in (("left", "right"), ("right", "left")):
        s, e, w = (point(f"{side}_{j}") for j in ("shoulder", "elbow", "wrist"))
        out[f"{side}_shoulder_angle"] = joint_angle(e, s, point(f"{other}_shoulder"))
        out[f"{side}_elbow_angle"] = joint_angle(s, e, w)
    return out


def video_features(trajectory: DataFrame, fps: DataFrame) -> DataFrame:
    """88 features per video; only the spectrum of a series leaves the JVM.

    A series without any valid value keeps missing motion features but has zero
    dominant frequency and centroid; a series of fewer than two rows is all zero.
    """
    columns = [*COORDINATES, *ANGLES]
    rows = numbered(trajectory).withColumns(video_angles()).select("video_id", "pos", *columns)
    filled = materialize(
        seq.interpolate(rows, ["video_id"], {f"f_{c}": c for c in columns}, mode="both").select(
            "video_id", "pos", *[F.col(f"f_{c}").alias(c) for c in columns]
        )
    )
    rate = with_fps(filled.groupBy("video_id").agg(F.count("*").alias("_n")), fps, "video_id")
    w = seq.halo_window(["video_id"])
    near = seq.with_halo(filled, 1, ahead=0)
    moved = seq.own_rows(near.withColumns({f"d_{c}": F.col(c) - F.lag(c).over(w) for c in columns}))
    aggregates = []
    for c in columns:
        d = F.col(f"d_{c}")
        aggregates += [F.avg(F.abs(d)).alias(f"m_{c}"), F.stddev_pop(d).alias(f"s_{c}")]
    aggregates += [(F.max(c) - F.min(c)).alias(f"r_{c}") for c in COORDINATES]
    for a in ANGLES:
        aggregates += [F.avg(a).alias(f"a_{a}"), F.stddev_pop(a).alias(f"b_{a}")]
    motion = moved.groupBy("video_id").agg(*aggregates).join(rate, "video_id")

    series = F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).alias("x")) for c in COORDINATES])).alias("_s")
    long = filled.select("video_id", "pos", series).select("video_id", "pos", "_s.name", "_s.x")
    spectra = series_spectrum(long, ["video_id", "name"], rate.select("video_id", "fps", F.col("_n").alias("n")), "video_id")
    wide = spectra.groupBy("video_id").agg(*[
        F.max(F.when(F.col("name") == c, F.col(f))).alias(f"{f}|{c}") for c in COORDINATES for f in ("total_energy", "dominant_freq", "centroid")
    ])
    full = motion.join(wide, "video_id")
    short = F.col("_n") < 2
    out = []
    for c in COORDINATES:
        joint, axis = c.rsplit("_", 1)
        made = {
            "avg_speed": F.col(f"m_{c}") * F.col("fps"), "std_speed": F.col(f"s_{c}") * F.col("fps"), "amplitude": F.col(f"r_{c}"),
            **{f: F.col(f"`{f}|{c}`") for f in ("total_energy", "dominant_freq", "centroid")},
        }
        out += [F.when(short, 0.0).otherwise(made[f]).alias(f"{joint}_{f}_{axis}") for f in AXIS_FEATURES]
    for a in ANGLES:
        made = {
            "mean": F.col(f"a_{a}"), "std": F.col(f"b_{a}"),
            "change_mean": F.when(short, 0.0).otherwise(F.col(f"m_{a}") * F.col("fps")),
            "change_std": F.when(short, 0.0).otherwise(F.col(f"s_{a}") * F.col("fps")),
        }
        out += [made[s].alias(f"{a}_{s}") for s in ANGLE_STATS]
    return full.select(F.col("video_id").alias("Video"), F.col("fps").alias("FPS"), *out)


# --- windows -----------------------------------------------------------------------
def _rows_out(table: pa.Table, keys: Sequence[str], at: np.ndarray, names: Sequence[str], result: np.ndarray) -> pa.RecordBatch:
    taken = table.select(list(keys)).take(pa.array(at)).combine_chunks()
    columns = [column.combine_chunks() for column in taken.columns] + [pa.array(result[:, i], from_pandas=False) for i in range(len(names))]
    return pa.RecordBatch.from_arrays(columns, [*keys, *names])


def segment_features(trajectory: DataFrame, fps: DataFrame) -> DataFrame:
    """88 features per one-second segment every half second, with its frame bounds."""
    columns = [*COORDINATES, *HIP_COORDINATES]
    length, step = segment_sizes(F.col("fps"))
    rows = with_fps(numbered(trajectory).select("video_id", "pos", *columns), fps, "video_id").withColumns({"_length": length, "_step": step})
    names = feature_names()
    index = {c: i for i, c in enumerate(columns)}
    fields = ", ".join(f"{n} double" for n in names)
    video_type = trajectory.schema["video_id"].dataType.simpleString()

    def features(stack: np.ndarray, rate: np.ndarray) -> np.ndarray:
        whole = np.nan_to_num(M.fill_both(stack))
        parts = [M.axis_features(whole[:, index[c]], rate) for c in COORDINATES]
        point = lambda j: np.stack([stack[:, index[f"{j}_x"]], stack[:, index[f"{j}_y"]]], axis=-1)
        for side in SIDES:
            hip, s, e, w = (point(f"{side}_{j}") for j in ("hip", "shoulder", "elbow", "wrist"))
            parts += [M.angle_features(M.joint_angles(hip, s, e), rate), M.angle_features(M.joint_angles(s, e, w), rate)]
        return np.concatenate(parts, axis=1)

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in complete(batches, ["video_id", "_blk"]):
            pos, block, size, by, rate = (table.column(c).to_numpy() for c in ("pos", "_blk", "_length", "_step", "fps"))
            ends = np.append(np.flatnonzero(starts_of(table, ["video_id", "_blk"]))[1:], table.num_rows)
            end = np.repeat(ends, np.diff(np.append(0, ends)))
            # Positions are dense, so a window is whole where its last row is in the block.
            first = np.flatnonzero((pos % by == 0) & (pos // BLOCK == block) & (np.arange(table.num_rows) + size <= end))
            result = np.empty((len(first), len(names)))
            for at, stack in stacks(matrix(table, columns), first, size[first]):
                result[at] = features(stack, rate[first[at]])
            table = table.append_column("window", pa.array(pos // by))
            yield _rows_out(table, ["video_id", "window", "fps"], first, names, result)

    halo = in_blocks(rows, "pos", F.least(F.col("pos"), F.col("_length") - 1), F.lit(0))
    made = sorted_blocks(halo, "video_id", "pos").mapInArrow(compute, f"video_id {video_type}, window bigint, fps double, {fields}")
    start = F.col("window") * step
    end = start + length - 1
    return made.select(
        F.col("video_id").alias("Video"), F.format_string("segment_%04d", F.col("window") + 1).alias("Segment_ID"),
        start.alias("Start_Frame"), end.alias("End_Frame"), (start / F.col("fps")).alias("Start_sec"),
        (end / F.col("fps")).alias("End_sec"), F.col("fps").alias("FPS"), *names,
    )


# --- detector windows ----------------------------------------------------------------
# The seven distances and the speed groups of the detector.
DISTANCES = (
    ("wrist_distance", "left_wrist", "right_wrist"), ("elbow_distance", "left_elbow", "right_elbow"),
    ("shoulder_distance", "left_shoulder", "right_shoulder"), ("left_upper_arm_distance", "left_shoulder", "left_elbow"),
    ("right_upper_arm_distance", "right_shoulder", "right_elbow"), ("left_forearm_distance", "left_elbow", "left_wrist"),
    ("right_forearm_distance", "right_elbow", "right_wrist"),
)
REGIONS = ("shoulder", "elbow", "wrist")
SPEED_GROUPS = ("all_joint", "wrist", "shoulder", "elbow")


def detector_names() -> list[str]:
    """The 293 detector features in order."""
    stats = lambda prefix: [f"{prefix}_{s}" for s in EIGHT_STATS]
    names = ["window_n_rows", "coord_missing_ratio", "row_any_missing_ratio", *stats("visible_joint_count"),
             "left_limb_all_missing_ratio", "right_limb_all_missing_ratio"]
    coords = [f"{j}_{a}" for a in ("x", "y") for j in MOTION_JOINTS]
    for prefix in [*coords, "shoulder_y", "elbow_y", "wrist_y", "all_y", "all_x"]:
        names += stats(prefix)
    names += ["y_all_range_mean", "x_all_range_mean", "y_all_range_max", "x_all_range_max"]
    for prefix in [d[0] for d in DISTANCES] + [f"{j}_speed" for j in MOTION_JOINTS] + [f"{g}_speed" for g in SPEED_GROUPS]:
        names += stats(prefix)
    return names + [f"delta_{r}_y_last_minus_first" for r in REGIONS] + ["delta_wrist_distance_last_minus_first"]


def detector_sizes(fps: Column) -> tuple[Column, Column, Column]:
    """Lattice half width, extraction reach (at least three frames) and step."""
    half = frames_of(DETECTOR_WINDOW_SEC / 2, fps)
    return half, F.greatest(F.lit(3), half).cast("bigint"), F.greatest(F.lit(1), frames_of(DETECTOR_STEP_SEC, fps)).cast("bigint")


def detector_stack(stack: np.ndarray, fps: np.ndarray) -> np.ndarray:
    """Features of windows ``[windows, 12 coordinates, rows]``, coordinates in ``COORDINATES`` order."""
    count, _, n = stack.shape
    names = detector_names()
    if n == 0:
        empty = np.full((count, len(names)), np.nan)
        empty[:, 0] = 0
        return empty
    at = {c: i for i, c in enumerate(COORDINATES)}
    lost = ~np.isfinite(stack)
    seen = np.stack([~lost[:, at[f"{j}_x"]] & ~lost[:, at[f"{j}_y"]] for j in MOTION_JOINTS], axis=1).sum(axis=1).astype(float)
    limb = lambda side: lost[:, [i for c, i in at.items() if c.startswith(side)]].all(axis=1).mean(axis=-1)
    parts = [np.full(count, n), lost.mean(axis=(1, 2)), lost.any(axis=1).mean(axis=-1), M.stat_block(seen), limb("left"), limb("right")]
    full = M.fill_both(stack)
    of = lambda name: full[:, at[name]]
    join = lambda *cs: np.concatenate([of(c) for c in cs], axis=-1)
    for axis in ("x", "y"):
        parts += [M.stat_block(of(f"{j}_{axis}")) for j in MOTION_JOINTS]
    parts += [M.stat_block(join(f"left_{r}_y", f"right_{r}_y")) for r in REGIONS]
    parts += [M.stat_block(join(*[f"{j}_{a}" for j in MOTION_JOINTS])) for a in ("y", "x")]
    ranges = {a: np.stack([M.stat_block(of(f"{j}_{a}"))[:, 5] for j in MOTION_JOINTS], axis=-1) for a in ("y", "x")}
    parts += [M.stat_block(ranges[a])[:, k] for k in (0, 4) for a in ("y", "x")]
    apart = lambda a, b: np.hypot(of(f"{a}_x") - of(f"{b}_x"), of(f"{a}_y") - of(f"{b}_y"))
    parts += [M.stat_block(apart(a, b)) for _, a, b in DISTANCES]
    if n < 2:
        speed = {j: np.full((count, 1), np.nan) for j in MOTION_JOINTS}
    else:
        speed = {j: np.hypot(np.diff(of(f"{j}_x")), np.diff(of(f"{j}_y"))) * fps[:, None] for j in MOTION_JOINTS}
    parts += [M.stat_block(speed[j]) for j in MOTION_JOINTS]
    for group in SPEED_GROUPS:
        members = [j for j in MOTION_JOINTS if group == "all_joint" or group in j]
        parts.append(M.stat_block(np.concatenate([speed[j] for j in members], axis=-1)))
    if n < 6:
        parts.append(np.full((count, 4), np.nan))
    else:
        k = max(2, n // 3)
        middle = lambda v: M.stat_block(v)[:, 1]
        for r in REGIONS:
            l, rr = of(f"left_{r}_y"), of(f"right_{r}_y")
            parts.append(middle(np.concatenate([l[:, -k:], rr[:, -k:]], axis=-1)) - middle(np.concatenate([l[:, :k], rr[:, :k]], axis=-1)))
        wrists = apart("left_wrist", "right_wrist")
        parts.append(middle(wrists[:, -k:]) - middle(wrists[:, :k]))
    return np.concatenate([np.asarray(p, float).reshape(count, -1) for p in parts], axis=1)


def detector_features(trajectory: DataFrame, fps: DataFrame, centres: DataFrame | None = None) -> DataFrame:
    """293 features per window centre; the sliding lattice of each video unless ``centres`` is given.

    ``centres`` has ``video_id, center_frame``. Windows are by frame number, so missing
    frames make shorter windows and a centre without any frame still yields a row.
    """
    last = with_fps(trajectory.groupBy("video_id").agg((F.max("frame") + 1).alias("n")), fps, "video_id")
    half, reach, step = detector_sizes(F.col("fps"))
    if centres is None:
        stop = F.col("n") - half - 1
        wanted = last.where(stop >= half).select("video_id", "fps", F.explode(F.sequence(half, stop, step)).alias("center_frame"))
    else:
        wanted = centres.select("video_id", "center_frame").join(last, "video_id").select("video_id", "fps", "center_frame")
    frames = with_fps(trajectory.select("video_id", "frame", *COORDINATES), fps, "video_id")
    near = in_blocks(frames.withColumn("_reach", reach), "frame", F.col("_reach"), F.col("_reach")).withColumn("_centre", F.lit(False))
    asked = in_blocks(wanted.withColumnRenamed("center_frame", "frame").withColumn("_reach", reach), "frame", F.lit(0), F.lit(0))
    both = near.unionByName(asked.withColumn("_centre", F.lit(True)), allowMissingColumns=True)
    names = detector_names()
    video_type = trajectory.schema["video_id"].dataType.simpleString()

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in complete(batches, ["video_id", "_blk"]):
            series = np.cumsum(starts_of(table, ["video_id", "_blk"]))
            frame, far, rate, centre = (table.column(c).to_numpy(zero_copy_only=False) for c in ("frame", "_reach", "fps", "_centre"))
            chosen, seen = np.flatnonzero(centre), np.flatnonzero(~centre)
            # Series follow one another on one axis, further apart than any window reaches.
            base = int(frame.min()) - int(far.max()) if len(frame) else 0
            place = series * (int(frame.max()) + 2 * int(far.max()) - base + 1) + frame - base if len(frame) else frame
            low = np.searchsorted(place[seen], place[chosen] - far[chosen], "left")
            high = np.searchsorted(place[seen], place[chosen] + far[chosen], "right")
            result = np.empty((len(chosen), len(names)))
            for at, stack in stacks(matrix(table.select(COORDINATES).take(pa.array(seen)), COORDINATES), low, high - low):
                result[at] = detector_stack(stack, rate[chosen[at]])
            yield _rows_out(table.rename_columns(["center_frame" if c == "frame" else c for c in table.column_names]), ["video_id", "center_frame", "fps"], chosen, names, result)

    fields = ", ".join(f"{n} double" for n in names)
    made = sorted_blocks(both, "video_id", "_centre", "frame").mapInArrow(compute, f"video_id {video_type}, center_frame bigint, fps double, {fields}")
    return made.withColumns({
        "window_start_frame": F.col("center_frame") - reach, "window_end_frame": F.col("center_frame") + reach,
        "center_time_sec": F.col("center_frame") / F.col("fps"),
    })
