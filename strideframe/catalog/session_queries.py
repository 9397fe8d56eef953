"""Session outcome metrics with event samples grouped into actions of at most 20."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from ..plans import sessions as P
from ..session import materialize
from .views import CYCLE_LEN, SERIES_SQL, series, table

# One hand follows the value, the other the counter; error events miss the pairing.
_XYZ = "struct<x:string,y:string,z:string>"


def actions(spark, sf):
    """Actions of a series: 20 consecutive rows, all in one array (bounded by construction)."""
    z = (F.col("pos") % CYCLE_LEN) * 0.005
    xyz = lambda x, y: F.struct(x.cast("string").alias("x"), y.cast("string").alias("y"), z.cast("string").alias("z"))
    sample = F.struct(
        "pos", F.col("ts").cast("string").alias("time"),
        (F.col("cat") != "error").cast("string").alias("hasLeft"), F.lit("true").alias("hasRight"),
        xyz(F.col("v") * 1e-4 - 0.137, F.col("k") * 1e-4).alias("leftTableLocalPosition"),
        xyz(F.lit(0.137) - F.col("k") * 1e-4, F.col("v") * 2e-4).alias("rightTableLocalPosition"),
        (F.col("v") < 60).cast("string").alias("leftInLeftZone"), (F.col("k") < 70).cast("string").alias("rightInRightZone"),
    )
    rows = series(spark, sf).groupBy("entity", F.expr(f"pos div {CYCLE_LEN}").alias("c")).agg(
        F.array_sort(F.collect_list(sample)).alias("samples"), F.max("v").alias("top"),
    )
    at = lambda i: F.element_at("samples", i)["time"]
    return rows.select(
        F.col("entity").alias("session"), (F.col("c") + 1).alias("action_index"),
        at(1).alias("startTime"), at(-1).alias("endTime"),
        F.lit("true").alias("usedLeft"), F.lit("true").alias("usedRight"),
        (F.col("top") > 200).cast("string").alias("isSingleHand"), "samples",
        F.lit(0.274).alias("cue_center_separation_m"),
        F.array(*[F.lit(float(x)) for x in (0, 0, 1)]).alias("forward_axis"),
        F.array(*[F.lit(float(x)) for x in (1, 0, 0)]).alias("lateral_axis"),
    )


def _metrics(spark, sf):
    return P.action_metrics(actions(spark, sf))


def _rounded(df, keys, columns, digits=6):
    return df.select(*keys, *[F.round(c, digits).alias(c) for c in columns])


ACTION_OUT = (
    "duration_s", "left_path_m", "right_path_m", "left_net_m", "left_path_efficiency", "directional_consistency_cosine",
    "left_right_path_length_difference_m", "mean_bilateral_signed_forward_displacement_m", "mean_bilateral_lateral_excursion_m",
    "mean_hand_separation_m", "mean_abs_hand_separation_error_m", "left_guidance_adherence", "bilateral_guidance_adherence",
)
HIGHER_DIGITS = 9


def path_metrics(spark, sf):
    keys = ["session", "action_index", "bilateral_classified", "basic_bilateral_eligible", "n_samples", "n_paired_samples"]
    return _rounded(_metrics(spark, sf), keys, ACTION_OUT, 8)


def higher_order(spark, sf):
    """Speed variation, acceleration, jerk and turning of the left hand (times scaled to hours)."""
    return _rounded(_metrics(spark, sf), ["session", "action_index"], [f"left_{m}" for m in P.HIGHER], HIGHER_DIGITS)


def hand_rows(spark, sf):
    keys = ["session", "action_index", "hand", "bilateral_classified", "n_samples", "higher_order_eligible"]
    return _rounded(P.hand_metrics(_metrics(spark, sf)), keys, ["path_length_m", "path_efficiency", "guidance_adherence"])


def pooled_vs_mean(spark, sf):
    """Pooled ratio next to the mean of per-action ratios."""
    a = materialize(_metrics(spark, sf))
    counts = P.action_counts(a).select(
        "session", "p2_recorded_action_count", "p2_bilateral_classified_count", "p2_basic_bilateral_action_count",
        F.round("p2_bilateral_adherence_pooled", 6).alias("pooled"), F.round("p2_mean_hand_separation_pooled_m", 6).alias("pooled_separation"),
    )
    return counts.join(a.groupBy("session").agg(F.round(F.avg("bilateral_guidance_adherence"), 6).alias("mean_of_ratios")), "session")


def session_timing(spark, sf):
    """Durations of bilateral actions and gaps between originally adjacent ones, summarised per session."""
    a = materialize(_metrics(spark, sf))
    values = P.metric_values(a, P.hand_metrics(a), P.action_gaps(a)).where(F.col("metric").isin("duration", "gap"))
    out = P.metric_summaries(values)
    return _rounded(out, ["session", "metric", "n", "negative"], ["mean", "sd", "cv", "q1", "median", "q3"], 5)


def resample_101(spark, sf):
    traces = P.lateral_profiles(materialize(_metrics(spark, sf)))
    return _rounded(
        P.profile_rows(traces), ["session", "action_index"],
        ["normalized_action_time_percent", "bilateral_midpoint_lateral_displacement_mm"],
    )


def profile_band(spark, sf):
    traces = P.lateral_profiles(materialize(_metrics(spark, sf)))
    return _rounded(P.profile_band(traces), ["session", F.col("grid").cast("bigint").alias("grid")], ["q1", "median", "q3"])


def iso_time_parse(spark, sf):
    """Timestamps as text with 3, 6 and 7 fractional digits parsed back, and elapsed seconds."""
    t = table(spark, sf, "events").select("event_id", F.col("ts").cast("string").alias("s"))
    long = text.iso_time(F.concat(F.replace("s", F.lit(" "), F.lit("T")), F.lit("9+08:00")))
    padded = F.when(F.instr("s", ".") > 0, F.concat(F.substring_index("s", ".", 1), F.lit(".5"))).otherwise(F.col("s"))
    return t.select(
        "event_id", text.micros_of(text.iso_time(F.col("s"))).alias("us"),
        F.round(text.elapsed_seconds(text.iso_time(padded), text.iso_time(F.col("s"))), 6).alias("elapsed"),
        F.when(F.length("s") == 26, text.micros_of(long)).alias("us_long"),
    )


_SAMPLES = f"""{SERIES_SQL}, smp AS (SELECT entity, pos // 20 AS c, pos, t, cat <> 'error' AS ok,
    v * 1e-4 - 0.137 AS lx, k * 1e-4 AS ly, 0.137 - k * 1e-4 AS rx, v * 2e-4 AS ry, (pos % 20) * CAST(0.005 AS DOUBLE) AS z,
    v < 60 AS lin, k < 70 AS rin, v FROM series),
  act AS (SELECT entity, c, count(*) AS n, count(*) FILTER (ok) AS np, max(v) <= 200 AS both_used, min(t) AS t0, max(t) AS t1
    FROM smp GROUP BY entity, c),
  par AS (SELECT smp.*, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY entity, c) AS m,
      lag(t) OVER w AS pt, lag(lx) OVER w AS plx, lag(ly) OVER w AS ply, lag(rx) OVER w AS prx, lag(ry) OVER w AS pry, lag(z) OVER w AS pz
    FROM smp WHERE ok WINDOW w AS (PARTITION BY entity, c ORDER BY t)),
  agg AS (SELECT entity, c, m,
      sum(sqrt((lx-plx)**2 + (ly-ply)**2 + (z-pz)**2)) AS lpath, sum(sqrt((rx-prx)**2 + (ry-pry)**2 + (z-pz)**2)) AS rpath,
      arg_max(lx, i) - arg_min(lx, i) AS nlx, arg_max(ly, i) - arg_min(ly, i) AS nly, arg_max(z, i) - arg_min(z, i) AS nz,
      arg_max(rx, i) - arg_min(rx, i) AS nrx, arg_max(ry, i) - arg_min(ry, i) AS nry, (max(t) - min(t)) / 1e6 AS sdur,
      (max(lx) - min(lx) + max(rx) - min(rx)) / 2 AS lat,
      sum(sqrt((rx-lx)**2 + (ry-ly)**2)) AS seps, sum(abs(sqrt((rx-lx)**2 + (ry-ly)**2) - 0.274)) AS errs,
      count(*) FILTER (lin) AS nl, count(*) FILTER (rin) AS nr, count(*) FILTER (lin AND rin) AS nb
    FROM par GROUP BY entity, c, m),
  met AS (SELECT act.entity AS session, act.c + 1 AS action_index, act.n AS n_samples, act.np AS n_paired_samples, both_used,
      (t1 - t0) / 1e6 AS duration_s, coalesce(both_used AND m >= 3 AND sdur > 0 AND lpath > 0 AND rpath > 0, false) AS basic, agg.*,
      act.t0, act.t1, sqrt(nlx*nlx + nly*nly + nz*nz) AS lnet, sqrt(nrx*nrx + nry*nry + nz*nz) AS rnet
    FROM act LEFT JOIN agg ON agg.entity = act.entity AND agg.c = act.c)"""

_EFF = "CASE WHEN m >= 3 AND sdur > 0 AND {p}path > 0 THEN {p}net / {p}path END"
_GAPS = f"""WITH {_SAMPLES}, g AS (SELECT session, both_used, t0, lag(t1) OVER w AS pe, lag(both_used) OVER w AS pb FROM met
    WINDOW w AS (PARTITION BY session ORDER BY t0)),
  vals AS (SELECT session, 'duration' AS metric, duration_s AS v FROM met WHERE both_used
    UNION ALL SELECT session, 'gap', (t0 - pe) / 1e6 FROM g WHERE both_used AND pb AND pe IS NOT NULL)
  SELECT session, metric, count(*) AS n, count(*) FILTER (v < 0) AS negative, round(avg(v), 5) AS mean, round(stddev_samp(v), 5) AS sd,
    round(stddev_samp(v) / nullif(avg(v), 0), 5) AS cv, round(quantile_cont(v, 0.25), 5) AS q1, round(median(v), 5) AS median,
    round(quantile_cont(v, 0.75), 5) AS q3 FROM vals GROUP BY session, metric"""

_TRACE = f"""WITH {_SAMPLES}, e AS (SELECT par.entity, par.c, par.i, par.m, par.t, (par.lx + par.rx) / 2 AS lat, met.sdur
      FROM par JOIN met ON met.session = par.entity AND met.action_index = par.c + 1 WHERE basic),
  o AS (SELECT *, first_value(lat) OVER w AS lat0, first_value(t) OVER w AS t0 FROM e WINDOW w AS (PARTITION BY entity, c ORDER BY i)),
  s AS (SELECT entity, c, i, ((t - t0) / 1e6) / sdur AS share, (lat - lat0) * 1000 AS mm FROM o),
  q AS (SELECT *, lead(share) OVER w AS nshare, lead(mm) OVER w AS nmm FROM s WINDOW w AS (PARTITION BY entity, c ORDER BY i)),
  tr AS (SELECT entity AS session, c + 1 AS action_index, g AS grid,
      CASE WHEN nshare IS NULL THEN mm ELSE (nmm - mm) / (nshare - share) * (g / 100.0 - share) + mm END AS mm
    FROM q JOIN range(0, 101) r(g) ON CASE WHEN nshare IS NULL THEN g = 100 ELSE g >= ceil(share * 100) AND g < ceil(nshare * 100) END)"""

_HIGH = f"""WITH {_SAMPLES}, d AS (SELECT par.*, (t - pt) / 1e6 AS dt, first_value(t) OVER w AS t0 FROM par
      WINDOW w AS (PARTITION BY entity, c ORDER BY i)),
  v AS (SELECT entity, c, i, ((t - t0) + (pt - t0)) / 2e6 AS vt, (lx-plx)/dt AS vx, (ly-ply)/dt AS vy, (z-pz)/dt AS vz,
      lx-plx AS dx, ly-ply AS dy, z-pz AS dz FROM d WHERE i > 0),
  a0 AS (SELECT *, lag(vt) OVER w AS pvt, lag(vx) OVER w AS pvx, lag(vy) OVER w AS pvy, lag(vz) OVER w AS pvz,
      lag(dx) OVER w AS pdx, lag(dy) OVER w AS pdy, lag(dz) OVER w AS pdz FROM v WINDOW w AS (PARTITION BY entity, c ORDER BY i)),
  a AS (SELECT *, (vt + pvt) / 2 AS ta, (vx-pvx)/(vt-pvt) AS ax, (vy-pvy)/(vt-pvt) AS ay, (vz-pvz)/(vt-pvt) AS az,
      sqrt(dx*dx+dy*dy+dz*dz) * sqrt(pdx*pdx+pdy*pdy+pdz*pdz) AS den, dx*pdx+dy*pdy+dz*pdz AS num FROM a0),
  j0 AS (SELECT *, lag(ta) OVER w AS pta, lag(ax) OVER w AS pax, lag(ay) OVER w AS pay, lag(az) OVER w AS paz
    FROM a WINDOW w AS (PARTITION BY entity, c ORDER BY i)),
  h AS (SELECT entity, c, stddev_samp(sqrt(vx*vx+vy*vy+vz*vz)) AS sv, sqrt(avg(ax*ax+ay*ay+az*az)) AS ar,
      sqrt(avg((((ax-pax)/(ta-pta))**2) + (((ay-pay)/(ta-pta))**2) + (((az-paz)/(ta-pta))**2))) AS jr,
      coalesce(sum(CASE WHEN den > 0 THEN degrees(acos(greatest(-1.0, least(1.0, num / den)))) END), 0) AS turn FROM j0 GROUP BY entity, c)
  SELECT session, action_index, CASE WHEN ok THEN round(sv, 9) END AS left_speed_variability_m_s,
    CASE WHEN ok THEN round(ar, 9) END AS left_acceleration_rms_m_s2, CASE WHEN ok THEN round(jr, 9) END AS left_jerk_rms_m_s3,
    CASE WHEN ok THEN round(turn / sdur, 9) END AS left_direction_change_rate_deg_s
  FROM (SELECT met.*, h.sv, h.ar, h.jr, h.turn, both_used AND met.m >= 10 AS ok FROM met LEFT JOIN h ON h.entity = met.session AND h.c = met.action_index - 1)"""

QUERIES = {
    "path_metrics": path_metrics,
    "higher_order": higher_order,
    "hand_rows": hand_rows,
    "pooled_vs_mean": pooled_vs_mean,
    "session_timing": session_timing,
    "resample_101": resample_101,
    "profile_band": profile_band,
    "iso_time_parse": iso_time_parse,
}

ORACLES = {
    "path_metrics": f"""WITH {_SAMPLES} SELECT session, action_index, both_used AS bilateral_classified, basic AS basic_bilateral_eligible,
        n_samples, n_paired_samples, round(duration_s, 8) AS duration_s, round(lpath, 8) AS left_path_m, round(rpath, 8) AS right_path_m,
        CASE WHEN m >= 2 THEN round(lnet, 8) END AS left_net_m, round({_EFF.format(p='l')}, 8) AS left_path_efficiency,
        CASE WHEN basic THEN round(greatest(-1.0, least(1.0, (nlx*nrx + nly*nry + nz*nz) / nullif(lnet * rnet, 0))), 8) END AS directional_consistency_cosine,
        CASE WHEN basic THEN round(abs(lpath - rpath), 8) END AS left_right_path_length_difference_m,
        CASE WHEN basic THEN round(nz, 8) END AS mean_bilateral_signed_forward_displacement_m,
        CASE WHEN basic THEN round(lat, 8) END AS mean_bilateral_lateral_excursion_m,
        CASE WHEN basic THEN round(seps / m, 8) END AS mean_hand_separation_m,
        CASE WHEN basic THEN round(errs / m, 8) END AS mean_abs_hand_separation_error_m,
        CASE WHEN basic THEN round(nl / m, 8) END AS left_guidance_adherence,
        CASE WHEN basic THEN round(nb / m, 8) END AS bilateral_guidance_adherence FROM met""",
    "higher_order": _HIGH,
    "hand_rows": f"""WITH {_SAMPLES}, two AS (
        SELECT met.*, 'Left' AS hand, lpath AS hp, {_EFF.format(p='l')} AS he, nl AS hn FROM met
        UNION ALL SELECT met.*, 'Right', rpath, {_EFF.format(p='r')}, nr FROM met)
        SELECT session, action_index, hand, both_used AS bilateral_classified, coalesce(m, 0) AS n_samples,
        both_used AND coalesce(m, 0) >= 10 AS higher_order_eligible, CASE WHEN basic THEN round(hp, 6) END AS path_length_m,
        CASE WHEN basic THEN round(he, 6) END AS path_efficiency, CASE WHEN basic THEN round(hn / m, 6) END AS guidance_adherence FROM two""",
    "pooled_vs_mean": f"""WITH {_SAMPLES} SELECT session, count(*) AS p2_recorded_action_count,
        count(*) FILTER (both_used) AS p2_bilateral_classified_count, count(*) FILTER (basic) AS p2_basic_bilateral_action_count,
        round(sum(nb) FILTER (basic) / sum(m) FILTER (basic), 6) AS pooled, round(sum(seps) FILTER (basic) / sum(m) FILTER (basic), 6) AS pooled_separation,
        round(avg(nb / m) FILTER (basic), 6) AS mean_of_ratios FROM met GROUP BY session""",
    "session_timing": _GAPS,
    "resample_101": _TRACE + """ SELECT session, action_index, round(CAST(grid AS DOUBLE), 6) AS normalized_action_time_percent,
        round(mm, 6) AS bilateral_midpoint_lateral_displacement_mm FROM tr""",
    "profile_band": _TRACE + """ SELECT session, grid, round(quantile_cont(mm, 0.25), 6) AS q1, round(median(mm), 6) AS median,
        round(quantile_cont(mm, 0.75), 6) AS q3 FROM tr GROUP BY session, grid""",
    "iso_time_parse": """SELECT event_id, epoch_us(ts) AS us,
        round(CASE WHEN epoch_us(ts) % 1000000 = 0 THEN 0.0 ELSE (epoch_us(ts) % 1000000 - 500000) / 1e6 END, 6) AS elapsed,
        CASE WHEN epoch_us(ts) % 10 <> 0 THEN epoch_us(ts) END AS us_long FROM events""",
}
