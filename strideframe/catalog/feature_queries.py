"""All columns of the feature operators, with oracles made from the operators' own name lists.

``model_queries`` has the same operators with a few columns each; here are the 88 of a video, the 88 of a segment and the
293 of a detector window.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..constants import AXIS_FEATURES, EIGHT_STATS, MOTION_JOINTS
from ..operators import features as X
from ..sources.schemas import COORDINATES
from .model_queries import _WIN, _angle
from .trajectories import TRAJECTORY_SQL, fps_table, trajectory

#: Added on both sides before rounding: coordinates are multiples of 1e-8, so exact halves of the last decimal are common.
_OFF_GRID = 3.1415926e-9


def video_features_all(spark, sf):
    """The 88 motion, spectral and angle features of each video."""
    out = X.video_features(trajectory(spark, sf), fps_table(spark, sf))
    return out.select("Video", "FPS", *[F.round(F.col(c) + _OFF_GRID, 5).alias(c) for c in X.feature_names()])


def window_features_all(spark, sf):
    """The 88 features of each segment."""
    out = X.segment_features(trajectory(spark, sf), fps_table(spark, sf))
    return out.select("Video", "Segment_ID", "Start_Frame", "End_Frame", "Start_sec", "End_sec", "FPS", *[F.round(F.col(c) + _OFF_GRID, 5).alias(c) for c in X.feature_names()])


def detector_features_all(spark, sf):
    """The 293 features of each window of the sliding lattice."""
    out = X.detector_features(trajectory(spark, sf), fps_table(spark, sf))
    return out.select("video_id", "center_frame", *[F.round(F.col(c) + _OFF_GRID, 6).alias(c) for c in X.detector_names()])


QUERIES = {"video_features_all": video_features_all, "window_features_all": window_features_all, "detector_features_all": detector_features_all}


def _filled_sql(source: str, named: dict[str, str], zero: bool) -> str:
    """fl: the named series of ``source(video_id, wi, fps, frame, ...)`` in long form, filled from both sides in each window."""
    union = " UNION ALL ".join(f"SELECT video_id, wi, fps, frame, '{name}' AS name, {e} AS x FROM {source}" for name, e in named.items())
    part = "PARTITION BY video_id, wi, name ORDER BY frame ROWS BETWEEN"
    value = "CASE WHEN x IS NOT NULL THEN x WHEN xa IS NOT NULL AND xb IS NOT NULL THEN xa + (xb - xa) / (fb - fa) * (frame - fa) ELSE coalesce(xa, xb) END"
    return f"""lo AS ({union}),
      fi AS (SELECT *, last_value(x IGNORE NULLS) OVER b AS xa, max(CASE WHEN x IS NOT NULL THEN frame END) OVER b AS fa,
          first_value(x IGNORE NULLS) OVER f AS xb, min(CASE WHEN x IS NOT NULL THEN frame END) OVER f AS fb FROM lo
        WINDOW b AS ({part} UNBOUNDED PRECEDING AND CURRENT ROW), f AS ({part} CURRENT ROW AND UNBOUNDED FOLLOWING)),
      fl AS (SELECT video_id, wi, fps, frame, name, {f"coalesce({value}, 0)" if zero else value} AS x,
          row_number() OVER (PARTITION BY video_id, wi, name ORDER BY frame) - 1 AS t, count(*) OVER (PARTITION BY video_id, wi, name) AS n FROM fi)"""


def _motion_sql(source: str, angles: dict[str, str], zero: bool) -> str:
    """ft: one row per video and window with the 88 features."""
    columns = []
    for c in COORDINATES:
        joint, axis = c.rsplit("_", 1)
        columns += [f"round(max(CASE WHEN name = '{c}' THEN {f} END) + {_OFF_GRID}::DOUBLE, 5) AS {joint}_{f}_{axis}" for f in AXIS_FEATURES]
    for a in X.ANGLES:
        parts = {"mean": "level", "std": "spread", "change_mean": "avg_speed", "change_std": "std_speed"}
        columns += [f"round(max(CASE WHEN name = '{a}' THEN {parts[s]} END) + {_OFF_GRID}::DOUBLE, 5) AS {a}_{s}" for s in X.ANGLE_STATS]
    return f"""{_filled_sql(source, {c: c for c in COORDINATES} | angles, zero)},
      ch AS (SELECT *, (x - lag(x) OVER (PARTITION BY video_id, wi, name ORDER BY t)) * fps AS d FROM fl),
      mo AS (SELECT video_id, wi, name, avg(abs(d)) AS avg_speed, stddev_pop(d) AS std_speed, max(x) - min(x) AS amplitude, avg(x) AS level, stddev_pop(x) AS spread
        FROM ch GROUP BY 1, 2, 3),
      sd AS (SELECT video_id, wi, name, k.k AS k, max(fps) AS fps, max(n) AS n,
          sqrt(sum(x * cos(2 * pi() * (k.k * t % n) / n)) ** 2 + sum(x * sin(2 * pi() * (k.k * t % n) / n)) ** 2) AS a
        FROM fl, range(0, 2000) k(k) WHERE k.k < n // 2 AND name NOT LIKE '%angle' GROUP BY 1, 2, 3, 4),
      sp AS (SELECT video_id, wi, name, sum(a) AS total_energy, coalesce(arg_max(k, a) FILTER (k > 0) * max(fps) / max(n), 0) AS dominant_freq,
          coalesce(sum(a * k * fps / n) / nullif(sum(a), 0), 0) AS centroid FROM sd GROUP BY 1, 2, 3),
      ft AS (SELECT video_id, wi, {", ".join(columns)} FROM mo LEFT JOIN sp USING (video_id, wi, name) GROUP BY 1, 2)"""


def _detector_sql() -> str:
    raw = " + ".join(f"CAST({j}_x IS NOT NULL AND {j}_y IS NOT NULL AS INT)" for j in MOTION_JOINTS)
    lost = " + ".join(f"CAST({c} IS NULL AS INT)" for c in COORDINATES)
    limb = {side: " AND ".join(f"{c} IS NULL" for c in COORDINATES if c.startswith(side)) for side in X.SIDES}
    hypot = lambda a, b: f"sqrt(({a}_x - {b}_x) ** 2 + ({a}_y - {b}_y) ** 2)"
    members = [("visible_joint_count", "seen"), *[(c, c) for c in COORDINATES]]
    members += [(f"{r}_y", f"{s}_{r}_y") for r in X.REGIONS for s in X.SIDES] + [(f"all_{a}", f"{j}_{a}") for a in ("x", "y") for j in MOTION_JOINTS]
    members += [(name, hypot(a, b)) for name, a, b in X.DISTANCES] + [(f"{j}_speed", f"sp_{j}") for j in MOTION_JOINTS]
    members += [(f"{g}_speed", f"sp_{j}") for g in X.SPEED_GROUPS for j in MOTION_JOINTS if g == "all_joint" or g in j]
    union = " UNION ALL ".join(f"SELECT video_id, wi, rn, n, '{name}' AS name, CAST({e} AS DOUBLE) AS x FROM sw" for name, e in members)
    stats = {"mean": "avg(x)", "median": "median(x)", "std": "stddev_pop(x)", "min": "min(x)", "max": "max(x)", "range": "max(x) - min(x)",
             "q25": "quantile_cont(x, 0.25)", "q75": "quantile_cont(x, 0.75)"}
    singles = {"window_n_rows": "max(n)", "coord_missing_ratio": "max(coord)", "row_any_missing_ratio": "max(anyrow)"}
    singles |= {f"{s}_limb_all_missing_ratio": f"max({s}_limb)" for s in X.SIDES}
    axis = lambda a: " OR ".join(f"name = '{j}_{a}'" for j in MOTION_JOINTS)
    singles |= {f"{a}_all_range_{s}": f"{f}(CASE WHEN {axis(a)} THEN s_range END)" for a in ("x", "y") for s, f in (("mean", "avg"), ("max", "max"))}
    singles |= {f"delta_{p}_last_minus_first": f"max(CASE WHEN name = '{p}' THEN delta END)" for p in [*[f"{r}_y" for r in X.REGIONS], "wrist_distance"]}
    singles |= {f"{p}_{s}": f"max(CASE WHEN name = '{p}' THEN s_{s} END)" for p in dict(members) for s in EIGHT_STATS}
    return f"""WITH {TRAJECTORY_SQL}, dc AS (SELECT video_id, fps, CAST(round_even(fps, 0) AS BIGINT) AS h, greatest(3, CAST(round_even(fps, 0) AS BIGINT)) AS reach,
        greatest(1, CAST(round_even(fps / 2, 0) AS BIGINT)) AS st, len FROM rate),
      ce AS (SELECT *, h + i.i * st AS c FROM dc, range(0, 4000) i(i) WHERE h + i.i * st < len - h),
      wr AS (SELECT traj.*, ce.c AS wi, ce.fps FROM traj JOIN ce ON ce.video_id = traj.video_id AND frame BETWEEN c - reach AND c + reach),
      ra AS (SELECT video_id, wi, frame, {raw} AS seen, ({lost}) / 12.0::DOUBLE AS lost, CAST(({lost}) > 0 AS INT) AS anylost,
          {", ".join(f"CAST({e} AS INT) AS {s}_lost" for s, e in limb.items())} FROM wr),
      mi AS (SELECT video_id, wi, avg(lost) AS coord, avg(anylost) AS anyrow, {", ".join(f"avg({s}_lost) AS {s}_limb" for s in limb)} FROM ra GROUP BY 1, 2),
      {_filled_sql("wr", {c: c for c in COORDINATES}, False)},
      fw AS (SELECT video_id, wi, frame, max(fps) AS fps, max(t) + 1 AS rn, max(n) AS n, {", ".join(f"max(CASE WHEN name = '{c}' THEN x END) AS {c}" for c in COORDINATES)}
        FROM fl GROUP BY 1, 2, 3),
      sw AS (SELECT fw.*, seen, {", ".join(f"sqrt(({j}_x - lag({j}_x) OVER w) ** 2 + ({j}_y - lag({j}_y) OVER w) ** 2) * fps AS sp_{j}" for j in MOTION_JOINTS)}
        FROM fw JOIN ra USING (video_id, wi, frame) WINDOW w AS (PARTITION BY video_id, wi ORDER BY frame)),
      me AS ({union}),
      st AS (SELECT video_id, wi, name, max(n) AS n, {", ".join(f"{e} AS s_{s}" for s, e in stats.items())},
          CASE WHEN max(n) >= 6 THEN median(x) FILTER (rn > n - greatest(2, n // 3)) - median(x) FILTER (rn <= greatest(2, n // 3)) END AS delta FROM me GROUP BY 1, 2, 3)
      SELECT video_id, wi AS center_frame, {", ".join(f"round(CAST({singles[c]} AS DOUBLE) + {_OFF_GRID}::DOUBLE, 6) AS {c}" for c in X.detector_names())}
      FROM st JOIN mi USING (video_id, wi) GROUP BY 1, 2"""


def _angle_or_null(*points: str) -> str:
    """``greatest`` and ``least`` skip missing values, so an angle with a missing point is made missing by hand."""
    return f"CASE WHEN {' AND '.join(f'{p}_{a} IS NOT NULL' for p in points for a in 'xy')} THEN {_angle(*points)} END"


_VIDEO_ANGLES = {f"{s}_{j}_angle": _angle_or_null(*p) for s, o in (("left", "right"), ("right", "left")) for j, p in (
    ("shoulder", (f"{s}_elbow", f"{s}_shoulder", f"{o}_shoulder")), ("elbow", (f"{s}_shoulder", f"{s}_elbow", f"{s}_wrist")))}
_WINDOW_ANGLES = {f"{s}_{j}_angle": _angle_or_null(*p) for s in X.SIDES for j, p in (
    ("shoulder", (f"{s}_hip", f"{s}_shoulder", f"{s}_elbow")), ("elbow", (f"{s}_shoulder", f"{s}_elbow", f"{s}_wrist")))}
_NAMES = ", ".join(X.feature_names())

ORACLES = {
    "video_features_all": f"""WITH {TRAJECTORY_SQL}, vr AS (SELECT traj.*, 0 AS wi, fps FROM traj JOIN rate USING (video_id)), {_motion_sql("vr", _VIDEO_ANGLES, False)}
      SELECT video_id AS "Video", fps AS "FPS", {_NAMES} FROM ft JOIN rate USING (video_id)""",
    "window_features_all": f"""WITH {TRAJECTORY_SQL}, {_WIN}, wr AS (SELECT traj.*, win.wi, win.fps FROM traj JOIN win ON win.video_id = traj.video_id AND frame BETWEEN ws AND we),
      {_motion_sql("wr", _WINDOW_ANGLES, True)}
      SELECT video_id AS "Video", 'segment_' || lpad(CAST(wi + 1 AS VARCHAR), 4, '0') AS "Segment_ID", ws AS "Start_Frame", we AS "End_Frame", ws / fps AS "Start_sec",
        we / fps AS "End_sec", fps AS "FPS", {_NAMES} FROM ft JOIN win USING (video_id, wi)""",
    "detector_features_all": _detector_sql(),
}
