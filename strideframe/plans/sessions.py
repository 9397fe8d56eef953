"""Session outcomes: transfer episodes, push actions, hand dynamics, session summary.

Samples of an action stay in the array they were recorded in; only one row per
action or hand crosses the network.
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import BASIC_MIN_SAMPLES, HIGHER_MIN_SAMPLES, PROFILE_GRID
from ..functions import trajectories as T
from ..functions.scalars import cosine, dot, norm, safe_div
from ..operators.intervals import adjacent_gaps, first_match
from ..operators.stats import exact_quantiles
from ..session import materialize

HOUR_US = 3_600_000_000
LEFT, RIGHT = ("lx", "ly", "lz"), ("rx", "ry", "rz")
XYZ = ("x", "y", "z")
HIGHER = ("speed_variability_m_s", "acceleration_rms_m_s2", "jerk_rms_m_s3", "direction_change_rate_deg_s")


def _xyz(p: Column) -> list[Column]:
    return [T.coordinate(p[n]) for n in XYZ]


# --- geometry -------------------------------------------------------------------
def geometry(p2: DataFrame) -> DataFrame:
    """Cue size, centre distance and the unit task axes of every session."""
    left, right = F.col("pushLeftZone"), F.col("pushRightZone")

    def unit(p: Column) -> Column:
        length = norm(*_xyz(p))
        return F.when(length > 0, F.array(*[c / length for c in _xyz(p)]))

    lc, rc = _xyz(left["tableLocalCenter"]), _xyz(right["tableLocalCenter"])
    return p2.select(
        "session",
        left["width"].try_cast("double").alias("cue_width_m"),
        left["length"].try_cast("double").alias("cue_length_m"),
        norm(*[b - a for a, b in zip(lc, rc)]).alias("cue_center_separation_m"),
        unit(left["tableLocalForward"]).alias("forward_axis"),
        unit(right["tableLocalForward"]).alias("_forward_right"),
        unit(left["tableLocalRight"]).alias("lateral_axis"),
        unit(right["tableLocalRight"]).alias("_lateral_right"),
    )


def check_axes(geo: DataFrame) -> DataFrame:
    """Fail on missing, differing or non-orthogonal axes; drop the right-hand copies."""

    def close(a: str, b: str) -> Column:
        # Same rule as an element-wise closeness test with rtol 1e-5 and atol 1e-6.
        return reduce(
            lambda x, y: x & y,
            [F.abs(F.col(a)[i] - F.col(b)[i]) <= 1e-6 + 1e-5 * F.abs(F.col(b)[i]) for i in range(3)],
        )

    axes = ("forward_axis", "_forward_right", "lateral_axis", "_lateral_right")
    known = reduce(lambda x, y: x & y, [F.col(a).isNotNull() for a in axes])
    product = dot([F.col("forward_axis")[i] for i in range(3)], [F.col("lateral_axis")[i] for i in range(3)])
    fault = (
        F.when(~known, "a task axis has no direction")
        .when(~close("forward_axis", "_forward_right"), "forward axes of the two zones disagree")
        .when(~close("lateral_axis", "_lateral_right"), "lateral axes of the two zones disagree")
        .when(F.abs(product) > 1e-6, "task axes aren't at a right angle")
    )
    checked = F.when(fault.isNotNull(), F.raise_error(F.concat_ws(": ", "session", fault)).cast("double"))
    return geo.select(
        "session", "cue_width_m", "cue_length_m",
        F.coalesce(checked, F.col("cue_center_separation_m")).alias("cue_center_separation_m"),
        "forward_axis", "lateral_axis",
    )


# --- transfer phases ------------------------------------------------------------
def transfer_episodes(phases: Mapping[str, DataFrame]) -> DataFrame:
    """One row per grasp episode of every phase, with basic trajectory metrics."""
    parts = []
    for label, df in phases.items():
        episodes = df.select("session", F.posexplode("grabSessions").alias("_i", "_e"))
        parts.append(episodes.withColumn("phase", F.lit(label)))
    rows = reduce(lambda a, b: a.unionByName(b), parts)

    def point(s: Column, i: Column) -> Column:
        x, y, z = _xyz(s["tableLocalPosition"])
        return F.struct(T.sample_time(s["time"]).alias("t"), i.alias("i"), x.alias("x"), y.alias("y"), z.alias("z"))

    samples = F.coalesce(F.col("_e.samples"), F.array().cast("array<struct<time:string,tableLocalPosition:struct<x:string,y:string,z:string>>>"))
    points = F.filter(F.transform(samples, point), lambda p: p["t"].isNotNull() & p["x"].isNotNull() & p["y"].isNotNull() & p["z"].isNotNull())
    start, end = T.sample_time(F.col("_e.startTime")), T.sample_time(F.col("_e.endTime"))
    return (
        rows.select(
            "session", "phase", (F.col("_i") + 1).cast("bigint").alias("episode_index"), F.col("_e.hand").alias("hand"),
            start.alias("start_us"), end.alias("end_us"), F.array_sort(points).alias("_sorted"),
        )
        .withColumn("_points", T.unique_times(F.col("_sorted")))
        .withColumn("_steps", T.steps(F.col("_points"), XYZ))
        .withColumns(T.basic_columns("", "_points", "_steps", XYZ))
        .withColumns(T.ratio_columns(""))
        .withColumn("episode_duration_s", (F.col("end_us") - F.col("start_us")) / 1e6)
        .drop("_sorted", "_points", "_steps")
    )


def transfer_attempts(phases: Mapping[str, DataFrame]) -> DataFrame:
    """Distinct attempts per session and phase, folded inside each session record."""
    parts = []
    for label, df in phases.items():
        spans = F.transform(
            F.coalesce(F.col("grabSessions"), F.array()),
            lambda e: F.struct(T.sample_time(e["startTime"]).alias("s"), T.sample_time(e["endTime"]).alias("e")),
        )
        parts.append(
            df.select("session", F.lit(label).alias("phase"), spans.alias("_spans"))
            .select("session", "phase", T.attempts(F.col("_spans")).alias("attempts"))
        )
    return reduce(lambda a, b: a.unionByName(b), parts)


def transfer_summary(phases: Mapping[str, DataFrame], episodes: DataFrame) -> DataFrame:
    """Span, counts, attempts and mean efficiency as ``{phase}_...`` columns."""
    by_phase = episodes.groupBy("session", "phase").agg(
        ((F.max("end_us") - F.min("start_us")) / 1e6).alias("span"),
        F.count("*").alias("episodes"),
        F.count("path_efficiency").alias("eligible"),
        F.avg("path_efficiency").alias("mean"),
    )
    full = transfer_attempts(phases).join(by_phase, ["session", "phase"], "left")
    names = {
        "recorded_activity_span_s": F.col("span"),
        "recorded_grasp_episodes": F.coalesce("episodes", F.lit(0)),
        "distinct_transfer_attempts": F.col("attempts"),
        "eligible_grasp_episodes": F.coalesce("eligible", F.lit(0)),
        "path_efficiency_mean": F.col("mean"),
    }
    return full.groupBy("session").agg(
        *[F.max(F.when(F.col("phase") == p, c)).alias(f"{p}_{n}") for p in phases for n, c in names.items()]
    )


# --- push actions ----------------------------------------------------------------
def explode_actions(p2: DataFrame, geo: DataFrame) -> DataFrame:
    """One row per recorded action; the samples remain an array."""
    cycle = F.posexplode("pushCycles").alias("_i", "_a")
    rows = p2.select("session", cycle).select("session", (F.col("_i") + 1).cast("bigint").alias("action_index"), "_a.*")
    return rows.join(geo.select("session", "cue_center_separation_m", "forward_axis", "lateral_axis"), "session")


def action_points(actions: DataFrame) -> DataFrame:
    """Paired samples sorted by time (``_paired``) and one per time (``_points``)."""

    def point(s: Column, i: Column) -> Column:
        l, r = _xyz(s["leftTableLocalPosition"]), _xyz(s["rightTableLocalPosition"])
        usable = T.truthy(s["hasLeft"]) & T.truthy(s["hasRight"])
        return F.struct(
            F.when(usable, T.sample_time(s["time"])).alias("t"), i.alias("i"),
            *[c.alias(n) for c, n in zip([*l, *r], [*LEFT, *RIGHT])],
            T.truthy(s["leftInLeftZone"]).alias("lin"), T.truthy(s["rightInRightZone"]).alias("rin"),
        )

    def known(p: Column) -> Column:
        return reduce(lambda a, b: a & b, [p[n].isNotNull() for n in ("t", *LEFT, *RIGHT)])

    both = T.truthy(F.col("usedLeft")) & T.truthy(F.col("usedRight")) & ~T.truthy(F.col("isSingleHand"))
    return (
        actions.withColumn("n_samples", F.coalesce(F.size("samples"), F.lit(0)).cast("bigint"))
        .withColumn("n_samples", F.greatest(F.col("n_samples"), F.lit(0)))
        .withColumn("_read", F.transform(F.coalesce(F.col("samples"), F.array()), point))
        .withColumn("_paired", F.array_sort(F.filter("_read", known)))
        .withColumn("_points", T.unique_times(F.col("_paired")))
        .withColumn("_steps", T.steps(F.col("_points"), [*LEFT, *RIGHT]))
        .withColumn("bilateral_classified", both)
        .withColumn("start_us", T.sample_time(F.col("startTime")))
        .withColumn("end_us", T.sample_time(F.col("endTime")))
        .drop("_read", "samples")
    )


def action_metrics(actions: DataFrame) -> DataFrame:
    """Every per-action and per-hand metric in one wide row per action."""
    df = action_points(actions)
    points, steps, paired = F.col("_points"), F.col("_steps"), F.col("_paired")
    for prefix, names in (("left_", LEFT), ("right_", RIGHT)):
        df = df.withColumns(T.basic_columns(prefix, "_points", "_steps", names)).withColumns(T.ratio_columns(prefix))
    basic = (
        F.col("bilateral_classified") & (F.size(paired) >= BASIC_MIN_SAMPLES)
        & F.col("left_basic_eligible") & F.col("right_basic_eligible")
    )
    df = df.withColumns({
        "n_paired_samples": F.size(paired).cast("bigint"),
        "basic_bilateral_eligible": basic,
        "duration_s": (F.col("end_us") - F.col("start_us")) / 1e6,
    })

    def gated(c: Column) -> Column:
        return F.when(F.col("basic_bilateral_eligible"), c)

    forward = [F.col("forward_axis")[i] for i in range(3)]
    lateral = [F.col("lateral_axis")[i] for i in range(3)]

    def excursion(names) -> Column:
        across = F.transform(points, lambda p: dot([p[n] for n in names], lateral))
        return F.array_max(across) - F.array_min(across)

    net = {"left": T.net_vector(points, LEFT), "right": T.net_vector(points, RIGHT)}
    separation = F.transform(paired, lambda p: norm(*[p[b] - p[a] for a, b in zip(LEFT, RIGHT)]))
    total = lambda values, f: F.aggregate(values, F.lit(0.0), lambda a, e: a + f(e))
    n = F.size(paired)
    share = lambda f: gated(F.size(F.filter(paired, f)) / n)
    df = df.withColumn("_separation", separation).withColumns({
        "directional_consistency_cosine": gated(cosine(net["left"], net["right"])),
        "left_right_path_length_difference_m": gated(F.abs(F.col("left_path_m") - F.col("right_path_m"))),
        "left_signed_forward_displacement_m": gated(dot(net["left"], forward)),
        "right_signed_forward_displacement_m": gated(dot(net["right"], forward)),
        "left_lateral_excursion_m": gated(excursion(LEFT)),
        "right_lateral_excursion_m": gated(excursion(RIGHT)),
        "left_guidance_adherence": share(lambda p: p["lin"]),
        "right_guidance_adherence": share(lambda p: p["rin"]),
        "bilateral_guidance_adherence": share(lambda p: p["lin"] & p["rin"]),
    })
    off = F.col("cue_center_separation_m")
    df = df.withColumns({
        "paired_quality_sample_count": F.coalesce(gated(n), F.lit(0)).cast("bigint"),
        "hand_separation_sum_m": F.coalesce(gated(total("_separation", lambda s: s)), F.lit(0.0)),
        "hand_separation_error_sum_m": F.coalesce(gated(total("_separation", lambda s: F.abs(s - off))), F.lit(0.0)),
        "bilateral_in_zone_sample_count": F.coalesce(
            gated(F.size(F.filter(paired, lambda p: p["lin"] & p["rin"]))), F.lit(0)
        ).cast("bigint"),
    })
    pair_mean = lambda a, b: (F.col(a) + F.col(b)) / 2
    df = df.withColumns({
        "mean_hand_separation_m": safe_div(F.col("hand_separation_sum_m"), F.col("paired_quality_sample_count")),
        "mean_abs_hand_separation_error_m": safe_div(F.col("hand_separation_error_sum_m"), F.col("paired_quality_sample_count")),
        "mean_bilateral_signed_forward_displacement_m": pair_mean("left_signed_forward_displacement_m", "right_signed_forward_displacement_m"),
        "mean_bilateral_lateral_excursion_m": pair_mean("left_lateral_excursion_m", "right_lateral_excursion_m"),
        "mean_bilateral_path_length_m": gated(pair_mean("left_path_m", "right_path_m")),
        "mean_bilateral_net_displacement_m": gated(pair_mean("left_net_m", "right_net_m")),
    }).withColumn(
        "mean_bilateral_path_speed_m_s", safe_div(F.col("mean_bilateral_path_length_m"), F.col("duration_s"))
    )
    # Higher-order dynamics: needs at least ten samples per hand.
    for hand, names in (("left", LEFT), ("right", RIGHT)):
        able = F.col("bilateral_classified") & T.higher_eligible(F.size(points))
        df = df.withColumn(f"{hand}_higher_order_eligible", able)
        df = df.withColumn("_v", F.when(able, T.velocity(steps, names)))
        df = df.withColumn("_a", T.derivative(F.col("_v"), names))
        df = df.withColumn("_j", T.derivative(F.col("_a"), names))
        df = df.withColumn("_s", F.transform("_v", lambda v: norm(*[v[m] for m in names])))
        turning = T.turning_degrees(steps, names)
        df = df.withColumns({
            f"{hand}_speed_variability_m_s": F.when(able, T.sample_sd(F.col("_s"))),
            f"{hand}_acceleration_rms_m_s2": F.when(able, T.rms(F.col("_a"), names)),
            f"{hand}_jerk_rms_m_s3": F.when(able, T.rms(F.col("_j"), names)),
            f"{hand}_direction_change_rate_deg_s": F.when(able, safe_div(turning, F.col(f"{hand}_duration_s"))),
        }).drop("_v", "_a", "_j", "_s")
    # Midpoint lateral displacement (mm) from the first sample on an even time grid.
    across = lambda p: dot([(p[a] + p[b]) / 2 for a, b in zip(LEFT, RIGHT)], lateral)
    df = df.withColumns({
        "_origin": across(F.get(points, F.lit(0))),
        "_t0": F.get(points, F.lit(0))["t"], "_t1": F.get(points, F.size(points) - 1)["t"],
    })
    df = df.withColumn("_trace", gated(F.transform(points, lambda p: F.struct(
        ((p["t"] - F.col("_t0")) / (F.col("_t1") - F.col("_t0"))).alias("share"),
        ((across(p) - F.col("_origin")) * 1000.0).alias("mm"),
    ))))
    df = df.withColumn("_mm", F.transform("_trace", lambda p: p["mm"])).withColumns({
        "peak_to_peak_mm": F.array_max("_mm") - F.array_min("_mm"),
        "trace_mm": T.on_grid(F.col("_trace"), "share", "mm", PROFILE_GRID - 1),
    }).drop("_origin", "_t0", "_t1", "_trace", "_mm")
    return df.withColumns({
        "recorded_action": F.lit(True),
        "single_hand_classified": ~F.col("bilateral_classified"),
        "used_left": T.truthy(F.col("usedLeft")),
        "used_right": T.truthy(F.col("usedRight")),
        "is_single_hand_field": T.truthy(F.col("isSingleHand")),
    }).drop("_paired", "_points", "_steps", "_separation", "usedLeft", "usedRight", "isSingleHand", "startTime", "endTime")


# Columns of the action table, in order.
ACTION_COLUMNS = (
    "session", "action_index", "duration_s", "recorded_action", "bilateral_classified", "single_hand_classified",
    "used_left", "used_right", "is_single_hand_field", "n_samples", "n_paired_samples", "basic_bilateral_eligible",
    "directional_consistency_cosine", "left_right_path_length_difference_m", "left_signed_forward_displacement_m",
    "right_signed_forward_displacement_m", "mean_bilateral_signed_forward_displacement_m", "left_lateral_excursion_m",
    "right_lateral_excursion_m", "mean_bilateral_lateral_excursion_m", "mean_hand_separation_m",
    "mean_abs_hand_separation_error_m", "paired_quality_sample_count", "hand_separation_sum_m",
    "hand_separation_error_sum_m", "left_guidance_adherence", "right_guidance_adherence", "bilateral_guidance_adherence",
    "bilateral_in_zone_sample_count", "mean_bilateral_path_length_m", "mean_bilateral_net_displacement_m",
    "mean_bilateral_path_speed_m_s",
)


def hand_metrics(actions: DataFrame) -> DataFrame:
    """Two rows per action, one per hand."""

    def side(hand: str) -> Column:
        p = hand.lower()
        gated = lambda c: F.when(F.col("basic_bilateral_eligible"), F.col(f"{p}_{c}"))
        return F.struct(
            F.lit(hand).alias("hand"),
            F.col(f"{p}_n").alias("n_samples"), F.col(f"{p}_duration_s").alias("sampled_duration_s"),
            gated("path_m").alias("path_length_m"), gated("net_m").alias("net_displacement_m"),
            gated("path_efficiency").alias("path_efficiency"), gated("mean_speed_m_s").alias("mean_path_speed_m_s"),
            F.col(f"{p}_signed_forward_displacement_m").alias("signed_forward_displacement_m"),
            F.col(f"{p}_lateral_excursion_m").alias("lateral_excursion_m"),
            F.col(f"{p}_guidance_adherence").alias("guidance_adherence"),
            F.col(f"{p}_higher_order_eligible").alias("higher_order_eligible"),
            *[F.col(f"{p}_{m}").alias(m) for m in HIGHER],
        )

    return actions.select(
        "session", "action_index", "bilateral_classified", "basic_bilateral_eligible",
        F.explode(F.array(side("Left"), side("Right"))).alias("_h"),
    ).select("session", "action_index", "bilateral_classified", "basic_bilateral_eligible", "_h.*")


def action_gaps(actions: DataFrame) -> DataFrame:
    """Seconds between originally adjacent bilateral actions."""
    ordered = actions.select("session", "start_us", "end_us", "bilateral_classified", F.struct("start_us", "action_index").alias("_order"))
    gaps = adjacent_gaps(
        ordered, ["session"], "start_us", "end_us", "bilateral_classified",
        order="_order", block=F.floor(F.col("start_us") / HOUR_US),
    )
    return gaps.select("session", (F.col("gap") / 1e6).alias("gap_s"))


def linked_events(p2_events: DataFrame, actions: DataFrame) -> DataFrame:
    """Safety events per session: raw, inside an action, inside a bilateral action."""
    spans = actions.select("session", "action_index", "start_us", "end_us", "bilateral_classified")
    hits = first_match(
        p2_events.where("at IS NOT NULL"), ["session", "event_index"], spans, ["session"], at="at", start="start_us",
        end="end_us", order=["start_us", "action_index"], carried=["bilateral_classified"],
    )
    inside = hits.groupBy("session").agg(
        F.count_if("linked").alias("linked"), F.count_if(F.col("bilateral_classified")).alias("linked_bilateral")
    )
    return p2_events.groupBy("session").agg(F.count("*").alias("raw")).join(inside, "session", "left").fillna(0)


# Metric -> {statistic: output column}.
SUMMARY_FIELDS = {
    "duration": {
        "n": "p2_action_duration_n", "mean": "p2_action_duration_mean_s", "sd": "p2_action_duration_sd_s", "cv": "p2_action_duration_cv",
        "q1": "p2_action_duration_q1_s", "median": "p2_action_duration_median_s", "q3": "p2_action_duration_q3_s",
    },
    "gap": {
        "n": "p2_inter_action_gap_n", "mean": "p2_inter_action_gap_mean_s", "sd": "p2_inter_action_gap_sd_s",
        "cv": "p2_inter_action_gap_cv", "q1": "p2_inter_action_gap_q1_s", "median": "p2_inter_action_gap_median_s",
        "q3": "p2_inter_action_gap_q3_s",
    },
    "efficiency": {
        "n": "p2_path_efficiency_n_hand_actions", "median": "p2_path_efficiency_median", "q1": "p2_path_efficiency_q1",
        "q3": "p2_path_efficiency_q3",
    },
    "direction": {
        "n": "p2_directional_consistency_n_actions", "mean": "p2_directional_consistency_mean", "sd": "p2_directional_consistency_sd",
        "q1": "p2_directional_consistency_q1", "median": "p2_directional_consistency_median", "q3": "p2_directional_consistency_q3",
        "negative": "p2_directional_consistency_negative_actions",
    },
    "path_difference": {
        "mean": "p2_path_length_difference_mean_m", "median": "p2_path_length_difference_median_m",
    },
    "forward": {
        "n": "p2_mean_bilateral_signed_forward_displacement_n_actions", "mean": "p2_mean_bilateral_signed_forward_displacement_mean_m",
        "sd": "p2_mean_bilateral_signed_forward_displacement_sd_m", "cv": "p2_mean_bilateral_signed_forward_displacement_cv",
        "q1": "p2_mean_bilateral_signed_forward_displacement_q1_m", "median": "p2_mean_bilateral_signed_forward_displacement_median_m",
        "q3": "p2_mean_bilateral_signed_forward_displacement_q3_m",
        "negative": "p2_mean_bilateral_signed_forward_displacement_negative_actions",
    },
    "lateral": {
        "n": "p2_mean_bilateral_lateral_excursion_n_actions", "mean": "p2_mean_bilateral_lateral_excursion_mean_m",
        "sd": "p2_mean_bilateral_lateral_excursion_sd_m", "cv": "p2_mean_bilateral_lateral_excursion_cv",
        "q1": "p2_mean_bilateral_lateral_excursion_q1_m", "median": "p2_mean_bilateral_lateral_excursion_median_m",
        "q3": "p2_mean_bilateral_lateral_excursion_q3_m",
    },
    "separation": {
        "mean": "p2_mean_hand_separation_mean_m", "sd": "p2_mean_hand_separation_sd_m", "cv": "p2_mean_hand_separation_cv",
    },
    "separation_error": {
        "mean": "p2_separation_error_mean_action_m", "median": "p2_separation_error_median_action_m",
        "q1": "p2_separation_error_q1_action_m", "q3": "p2_separation_error_q3_action_m",
    },
    "adherence": {
        "mean": "p2_bilateral_adherence_mean_action", "median": "p2_bilateral_adherence_median_action",
        "q1": "p2_bilateral_adherence_q1_action", "q3": "p2_bilateral_adherence_q3_action",
    },
    "net": {
        "sd": "p2_mean_bilateral_net_displacement_sd_m", "cv": "p2_mean_bilateral_net_displacement_cv",
    },
    "path": {
        "sd": "p2_mean_bilateral_path_length_sd_m", "cv": "p2_mean_bilateral_path_length_cv",
    },
    "speed": {
        "sd": "p2_mean_bilateral_speed_sd_m_s", "cv": "p2_mean_bilateral_speed_cv",
    },
    "speed_variability_m_s": {
        "mean": "p2_speed_variability_m_s_mean", "median": "p2_speed_variability_m_s_median", "q1": "p2_speed_variability_m_s_q1",
        "q3": "p2_speed_variability_m_s_q3",
    },
    "acceleration_rms_m_s2": {
        "mean": "p2_acceleration_rms_m_s2_mean", "median": "p2_acceleration_rms_m_s2_median", "q1": "p2_acceleration_rms_m_s2_q1",
        "q3": "p2_acceleration_rms_m_s2_q3",
    },
    "jerk_rms_m_s3": {
        "mean": "p2_jerk_rms_m_s3_mean", "median": "p2_jerk_rms_m_s3_median", "q1": "p2_jerk_rms_m_s3_q1", "q3": "p2_jerk_rms_m_s3_q3",
    },
    "direction_change_rate_deg_s": {
        "mean": "p2_direction_change_rate_deg_s_mean", "median": "p2_direction_change_rate_deg_s_median",
        "q1": "p2_direction_change_rate_deg_s_q1", "q3": "p2_direction_change_rate_deg_s_q3",
    },
}
# Metric -> column of the actions.
_ACTION_VALUES = {
    "direction": "directional_consistency_cosine", "path_difference": "left_right_path_length_difference_m",
    "forward": "mean_bilateral_signed_forward_displacement_m", "lateral": "mean_bilateral_lateral_excursion_m",
    "separation": "mean_hand_separation_m", "separation_error": "mean_abs_hand_separation_error_m",
    "adherence": "bilateral_guidance_adherence", "net": "mean_bilateral_net_displacement_m",
    "path": "mean_bilateral_path_length_m", "speed": "mean_bilateral_path_speed_m_s",
}


def _named(pairs: Mapping[str, Column]) -> Column:
    return F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), v.cast("double").alias("value")) for m, v in pairs.items()])).alias("_m")


def metric_values(actions: DataFrame, hands: DataFrame, gaps: DataFrame) -> DataFrame:
    """Long table ``(session, metric, value)`` of everything the summary describes."""
    timed = {"duration": F.when(F.col("bilateral_classified"), F.col("duration_s"))}
    per_action = {**timed, **{m: F.col(c) for m, c in _ACTION_VALUES.items()}}
    per_hand = {"efficiency": F.col("path_efficiency"), **{m: F.when(F.col("higher_order_eligible"), F.col(m)) for m in HIGHER}}
    parts = [
        actions.select("session", _named(per_action)), hands.select("session", _named(per_hand)),
        gaps.select("session", _named({"gap": F.col("gap_s")})),
    ]
    long = reduce(lambda a, b: a.unionByName(b), parts)
    return long.select("session", "_m.metric", "_m.value").where("value IS NOT NULL")


def metric_summaries(values: DataFrame) -> DataFrame:
    """One row per session and metric: moments, range, sign counts and exact quartiles."""
    v = F.col("value")
    moments = values.groupBy("session", "metric").agg(
        F.count("*").alias("n"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("sd"),
        safe_div(F.stddev_samp(v), F.avg(v)).alias("cv"), F.min(v).alias("min"), F.max(v).alias("max"),
        F.count_if(v < 0).alias("negative"), F.count_if(v > 0).alias("positive"),
    )
    quartiles = exact_quantiles(values, ["session", "metric"], v, {"q1": 0.25, "median": 0.5, "q3": 0.75})
    return moments.join(quartiles, ["session", "metric"])


def _wide(summaries: DataFrame) -> DataFrame:
    columns = []
    for metric, outputs in SUMMARY_FIELDS.items():
        for stat, name in outputs.items():
            c = F.max(F.when(F.col("metric") == metric, F.col(stat)))
            columns.append((F.coalesce(c, F.lit(0)) if stat in ("n", "negative") else c).alias(name))
    pick = lambda m, s: F.max(F.when(F.col("metric") == m, F.col(s)))
    crosses = F.coalesce((pick("forward", "negative") > 0) & (pick("forward", "positive") > 0), F.lit(False))
    steady = lambda m: F.coalesce(pick(m, "cv").isNotNull() & (pick(m, "mean") > 0), F.lit(False))
    return summaries.groupBy("session").agg(
        *columns,
        (steady("forward") & ~crosses).alias("p2_mean_bilateral_signed_forward_displacement_cv_interpretable"),
        steady("lateral").alias("p2_mean_bilateral_lateral_excursion_cv_interpretable"),
        crosses.alias("signed_forward_crosses_zero"),
    )


def action_counts(actions: DataFrame) -> DataFrame:
    """Counts, rates and pooled ratios per session (all algebraic)."""
    both, basic = F.col("bilateral_classified"), F.col("basic_bilateral_eligible")
    left, right = F.col("left_higher_order_eligible"), F.col("right_higher_order_eligible")
    base = actions.groupBy("session").agg(
        ((F.max("end_us") - F.min("start_us")) / 1e6).alias("p2_recorded_activity_span_s"),
        F.count("*").alias("p2_recorded_action_count"),
        F.count_if(both).alias("p2_bilateral_classified_count"),
        F.count_if(~both).alias("p2_single_hand_classified_count"),
        F.count_if(basic).alias("p2_basic_bilateral_action_count"),
        F.count_if(left | right).alias("p2_higher_order_action_count"),
        (F.count_if(left) + F.count_if(right)).alias("p2_higher_order_hand_action_count"),
        safe_div(F.sum("hand_separation_sum_m"), F.sum("paired_quality_sample_count")).alias("p2_mean_hand_separation_pooled_m"),
        safe_div(F.sum("hand_separation_error_sum_m"), F.sum("paired_quality_sample_count")).alias("p2_separation_error_pooled_m"),
        safe_div(F.sum("bilateral_in_zone_sample_count"), F.sum("paired_quality_sample_count")).alias("p2_bilateral_adherence_pooled"),
        F.bool_and(F.col("n_samples") == F.col("n_paired_samples")).alias("all_samples_paired"),
    )
    n, b, span = F.col("p2_recorded_action_count"), F.col("p2_bilateral_classified_count"), F.col("p2_recorded_activity_span_s")
    return base.withColumns({
        "p2_bilateral_participation_rate": safe_div(b, n),
        "p2_recorded_frequency_per_min": safe_div(n * 60.0, span),
        "p2_bilateral_frequency_per_min": safe_div(b * 60.0, span),
    })


_COUNTS = (
    "p2_recorded_action_count", "p2_bilateral_classified_count", "p2_single_hand_classified_count",
    "p2_basic_bilateral_action_count", "p2_higher_order_action_count", "p2_higher_order_hand_action_count",
)


def needle_events(p2: DataFrame) -> DataFrame:
    return p2.select("session", F.posexplode("needleSafetyEvents").alias("event_index", "_e")).select(
        "session", "event_index", T.sample_time(F.col("_e.time")).alias("at")
    )


def identity(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Whether all four files of a session carry the same id (a missing id counts as a value)."""
    ids = reduce(
        lambda a, b: a.unionByName(b),
        [tables[n].select("session", F.coalesce(F.concat(F.lit("="), "sessionId"), F.lit("missing")).alias("id")) for n in ("p1", "p2", "p3", "meta")],
    )
    return ids.groupBy("session").agg((F.min("id") == F.max("id")).alias("session_id_consistent"))


def analyse(tables: Mapping[str, DataFrame]) -> dict[str, DataFrame]:
    """All session outputs: summary, actions, hands, transfers, profiles, profile_summary, qa."""
    p2 = tables["p2"]
    phases = {"p1": tables["p1"], "p3": tables["p3"]}
    geo = check_axes(geometry(p2))
    # Actions are written before their metrics and episodes before their quantiles: a filter or join that is pushed below
    # the array columns would make the whole chain once more for every reference.
    actions = materialize(action_metrics(materialize(explode_actions(p2, geo))))
    hands = hand_metrics(actions)
    episodes = materialize(transfer_episodes(phases))
    summaries = metric_summaries(metric_values(actions, hands, action_gaps(actions)))

    efficiency = exact_quantiles(episodes, ["session", "phase"], F.col("path_efficiency"), {"q": 0.5}).groupBy("session").agg(
        *[F.max(F.when(F.col("phase") == p, F.col("q"))).alias(f"{p}_path_efficiency_median") for p in phases]
    )
    who = tables["meta"].select(
        "session", "profile",
        ((F.lower(F.coalesce("endReason", F.lit(""))) == "completed") & ~T.truthy(F.col("isPartialSession"))).alias("completed"),
        T.truthy(F.col("isSimulated")).alias("is_simulated"),
    )
    exits = p2.select("session", F.col("exitReason").alias("p2_exit_reason"))
    events = linked_events(needle_events(p2), actions)
    whole = who.join(identity(tables), "session").join(exits, "session").join(geo, "session")
    for part in (transfer_summary(phases, episodes), efficiency, action_counts(actions), _wide(summaries), events):
        whole = whole.join(part, "session", "left")
    zero = [*_COUNTS, *[f[s] for f in SUMMARY_FIELDS.values() for s in f if s in ("n", "negative")], "raw", "linked", "linked_bilateral"]
    flags = ["p2_mean_bilateral_signed_forward_displacement_cv_interpretable", "p2_mean_bilateral_lateral_excursion_cv_interpretable", "signed_forward_crosses_zero"]
    whole = materialize(
        whole.fillna(0, subset=zero).fillna(False, subset=flags).fillna(True, subset=["all_samples_paired"])
        .withColumns({
            "generated_phase_files": F.lit(3), "generated_metadata_files": F.lit(1),
            "p2_needle_events_raw": F.col("raw"), "p2_needle_events_action_linked": F.col("linked"),
            "p2_needle_events_outside_actions": F.col("raw") - F.col("linked"),
            "p2_needle_events_bilateral_action_linked": F.col("linked_bilateral"),
            "p2_needle_events_nonbilateral_or_outside": F.col("raw") - F.col("linked_bilateral"),
        }).drop("raw", "linked", "linked_bilateral")
    )
    traces = lateral_profiles(actions)
    return {
        "summary": whole.drop("forward_axis", "lateral_axis", "signed_forward_crosses_zero", "all_samples_paired"),
        "actions": actions.select(*ACTION_COLUMNS),
        "hands": hands,
        "transfers": episodes.drop("start_us", "end_us"),
        "profiles": profile_rows(traces),
        "profile_summary": profile_summary(traces),
        "qa": session_qa(whole, p2),
    }


def session_qa(whole: DataFrame, p2: DataFrame) -> DataFrame:
    """Checks and task axes of every session."""
    recorded = p2.select(
        "session", "coordinateSpace", F.col("pushCycleCount").alias("p2_push_count_field"),
        F.greatest(F.coalesce(F.size("pushCycles"), F.lit(0)), F.lit(0)).alias("p2_push_list_count"),
    )
    product = dot([F.col("forward_axis")[i] for i in range(3)], [F.col("lateral_axis")[i] for i in range(3)])
    return whole.join(recorded, "session").select(
        "session", F.col("session_id_consistent").alias("four_session_ids_consistent"),
        "p2_push_count_field", "p2_push_list_count", F.col("all_samples_paired").alias("p2_all_samples_paired"),
        F.struct(F.lit(HIGHER_MIN_SAMPLES).alias("minimum_samples")).alias("higher_order_rule"),
        F.struct(
            F.col("coordinateSpace").alias("coordinate_space"),
            F.col("forward_axis").alias("forward_unit_vector"), F.col("lateral_axis").alias("lateral_unit_vector"),
            F.lit(True).alias("left_right_zone_axes_matched"), product.alias("forward_lateral_dot_product"),
        ).alias("task_axes"),
        F.struct(
            "signed_forward_crosses_zero",
            F.col("p2_mean_bilateral_signed_forward_displacement_cv_interpretable").alias("signed_forward_cv_interpretable"),
            F.col("p2_mean_bilateral_lateral_excursion_cv_interpretable").alias("lateral_excursion_cv_interpretable"),
        ).alias("axis_projected_metrics"),
    )


# --- time-normalised lateral profiles ---------------------------------------------
def lateral_profiles(actions: DataFrame) -> DataFrame:
    """Profiles of the eligible actions; ``actions`` must be materialised metrics.

    (A filter over unmaterialised array columns would be pushed below them and
    evaluate the whole chain once more per reference.)
    """
    return actions.where("trace_mm IS NOT NULL").select("session", "action_index", "peak_to_peak_mm", "trace_mm")


def profile_rows(traces: DataFrame) -> DataFrame:
    cells = F.size("trace_mm") - 1
    return traces.select("session", "action_index", cells.alias("_n"), F.posexplode("trace_mm").alias("grid", "bilateral_midpoint_lateral_displacement_mm")).select(
        "session", "action_index", (F.col("grid") * 100.0 / F.col("_n")).alias("normalized_action_time_percent"),
        "bilateral_midpoint_lateral_displacement_mm",
    )


def profile_band(traces: DataFrame) -> DataFrame:
    """Median and quartiles over actions at every grid point."""
    points = traces.select("session", F.posexplode("trace_mm").alias("grid", "_v"))
    return exact_quantiles(points, ["session", "grid"], F.col("_v"), {"q1": 0.25, "median": 0.5, "q3": 0.75})


def profile_summary(traces: DataFrame) -> DataFrame:
    name = "raw_action_peak_to_peak_lateral_displacement_{}_mm"
    counts = traces.groupBy("session").agg(F.count("*").alias("eligible_bilateral_actions"))
    spread = exact_quantiles(
        traces, ["session"], F.col("peak_to_peak_mm"), {name.format("q1"): 0.25, name.format("median"): 0.5, name.format("q3"): 0.75}
    )
    middle = profile_band(traces).groupBy("session").agg(
        (F.max("median") - F.min("median")).alias("median_profile_peak_to_peak_lateral_displacement_mm")
    )
    return counts.join(spread, "session").join(middle, "session")


def plot_bands(summary: DataFrame) -> DataFrame:
    """Derived display columns: direction spread, and values masked where a CV is not interpretable."""
    mask = lambda flag, c: F.when(F.col(flag), F.col(c))
    f, l = "p2_mean_bilateral_signed_forward_displacement_cv", "p2_mean_bilateral_lateral_excursion_cv"
    return summary.select(
        "session",
        (F.col("p2_directional_consistency_q3") - F.col("p2_directional_consistency_q1")).alias("directional_consistency_iqr"),
        (F.col("p2_action_duration_q3_s") - F.col("p2_action_duration_q1_s")).alias("action_duration_iqr_s"),
        mask(f + "_interpretable", f).alias("forward_cv_shown"), mask(l + "_interpretable", l).alias("lateral_cv_shown"),
    )
