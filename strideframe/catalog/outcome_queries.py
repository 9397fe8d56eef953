"""Session outcomes from nested documents: the given events folded into JSON, written, read back and analysed in one plan.

A session is up to 400 rows of a series, an action 20 of them, so no document grows with the tables. Phase 1 holds the left
hand of all actions, phase 3 the right hand of every second one; error rows miss the pairing and raise a safety event some
time later. Times run 36 000 times faster than in the table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans import sessions as P
from ..session import materialize, shared_path
from ..sources.sessions import read_session_store, write_session_store
from .views import CYCLE_LEN, SERIES_SQL, series

SESSION_ACTIONS = 20
#: Microseconds: the table's for one of the session's, a safety event's delay per k, how long a grasp outlasts its samples.
PACE, DELAY, HOLD = 36_000, 15_000, 1_200_000


def _stamp(us: Column) -> Column:
    return F.timestamp_micros(us).cast("string")


def _point(x: Column, y: Column, z: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"), z.cast("double").alias("z"))


def _folded(spark, sf) -> DataFrame:
    """One row per session with its actions, each with its samples and safety events."""
    per = CYCLE_LEN * SESSION_ACTIONS
    rows = series(spark, sf).select(
        "entity", F.concat_ws("-", F.col("entity").cast("string"), F.expr(f"pos div {per}").cast("string")).alias("session"),
        F.expr(f"pos div {CYCLE_LEN} % {SESSION_ACTIONS} + 1").alias("action_index"), "pos", "v", "k", "cat", F.expr(f"t div {PACE}").alias("us"),
    )
    z = (F.col("pos") % CYCLE_LEN) * 0.005
    sample = F.struct(
        "pos", "us", (F.col("cat") != "error").alias("paired"), _point(F.col("v") * 1e-4 - 0.137, F.col("k") * 1e-4, z).alias("left"),
        _point(F.lit(0.137) - F.col("k") * 1e-4, F.col("v") * 2e-4, z).alias("right"), (F.col("v") < 60).alias("lin"), (F.col("k") < 70).alias("rin"),
    )
    event = F.when(F.col("cat") == "error", F.struct(_stamp(F.col("us") + F.col("k") * DELAY).alias("time")))
    acts = rows.groupBy("entity", "session", "action_index").agg(
        F.array_sort(F.collect_list(sample)).alias("samples"), F.max("v").alias("top"), F.collect_list(event).alias("events")
    )
    return acts.groupBy("entity", "session").agg(F.array_sort(F.collect_list(F.struct("action_index", "samples", "top", "events"))).alias("acts"))


def _grasps(acts: Column, hand: str, hold: int) -> Column:
    return F.transform(acts, lambda a: F.struct(
        _stamp(F.element_at(a["samples"], 1)["us"]).alias("startTime"), _stamp(F.element_at(a["samples"], -1)["us"] + hold).alias("endTime"),
        F.lit(hand).alias("hand"),
        F.transform(a["samples"], lambda s: F.struct(_stamp(s["us"]).alias("time"), s[hand.lower()].alias("tableLocalPosition"))).alias("samples"),
    ))


def session_documents(spark, sf) -> dict[str, DataFrame]:
    """The four documents of every session; ids disagree, end reasons and flags vary by user."""
    folded = materialize(_folded(spark, sf))
    user, acts = F.col("entity"), F.col("acts")
    head = ["session", F.when(user % 2 == 0, "Simulated").otherwise("Researcher-operated").alias("profile")]
    own = F.col("session").alias("sessionId")
    even = user % 2 == 0
    number = lambda c: F.lit(c).cast("double")
    forward = F.when(even, _point(number(0), number(0), number(2))).otherwise(_point(number(0), number(0.3), number(0.4)))
    off = number(0.137) + (user % 5) * 0.001
    zone = lambda x: F.struct(
        number(0.028).alias("width"), number(0.056).alias("length"), _point(x, number(0), number(0)).alias("tableLocalCenter"),
        forward.alias("tableLocalForward"), _point(number(3), number(0), number(0)).alias("tableLocalRight"),
    )
    sample = lambda s: F.struct(
        _stamp(s["us"]).alias("time"), s["paired"].alias("hasLeft"), F.lit(True).alias("hasRight"), s["left"].alias("leftTableLocalPosition"),
        s["right"].alias("rightTableLocalPosition"), s["lin"].alias("leftInLeftZone"), s["rin"].alias("rightInRightZone"),
    )
    cycles = F.transform(acts, lambda a: F.struct(
        _stamp(F.element_at(a["samples"], 1)["us"]).alias("startTime"), _stamp(F.element_at(a["samples"], -1)["us"]).alias("endTime"),
        F.lit(True).alias("usedLeft"), F.lit(1).alias("usedRight"), (a["top"] > 200).alias("isSingleHand"), F.transform(a["samples"], sample).alias("samples"),
    ))
    reason = F.when(user % 4 == 0, "Completed").when(user % 4 == 1, "completed").when(user % 4 == 2, "Aborted")
    return {
        "p1": folded.select(*head, own, _grasps(acts, "Left", HOLD).alias("grabSessions")),
        "p2": folded.select(
            *head, own, F.when(user % 3 > 0, "timeout").alias("exitReason"), F.lit("table").alias("coordinateSpace"),
            (F.size(acts) + (user % 13 == 0).cast("int")).cast("bigint").alias("pushCycleCount"),
            F.flatten(F.transform(acts, lambda a: a["events"])).alias("needleSafetyEvents"), cycles.alias("pushCycles"),
            zone(-off).alias("pushLeftZone"), zone(off).alias("pushRightZone"),
        ),
        "p3": folded.select(*head, own, _grasps(F.filter(acts, lambda a: a["action_index"] % 2 == 0), "Right", 0).alias("grabSessions")),
        "meta": folded.select(
            *head, F.when(user % 7 == 0, "other").when(user % 11 > 0, F.col("session")).alias("sessionId"), reason.alias("endReason"),
            (user % 3 == 0).alias("isPartialSession"), (user % 2).alias("isSimulated"),
        ),
    }


def session_tables(spark, sf):
    folder = shared_path(spark, "sessions")
    write_session_store(session_documents(spark, sf), folder)
    return read_session_store(spark, folder)


def _digits(name: str) -> int:
    """Seconds and metres are decimal fractions and halves or quarters of them, so nine digits don't cut through a tie."""
    return 9 if name.endswith(("_s", "_m")) else 3 if "jerk" in name else 6


def _rounded(df: DataFrame) -> DataFrame:
    return df.select(*[F.round(n, _digits(n)).alias(n) if kind == "double" else F.col(n) for n, kind in df.dtypes])


def session_summary(spark, sf):
    """All 118 fields of every session."""
    return _rounded(P.analyse(session_tables(spark, sf))["summary"])


def transfer_episodes(spark, sf):
    """Every grasp of both transfer phases."""
    tables = session_tables(spark, sf)
    found = P.transfer_episodes({"p1": tables["p1"], "p3": tables["p3"]})
    return _rounded(found.select("session", "phase", "episode_index", "hand", "n", "episode_duration_s", "path_m", "net_m", "path_efficiency", "mean_speed_m_s"))


def transfer_summary(spark, sf):
    tables = session_tables(spark, sf)
    phases = {"p1": tables["p1"], "p3": tables["p3"]}
    return _rounded(P.transfer_summary(phases, P.transfer_episodes(phases)))


def session_geometry(spark, sf):
    """Cue sizes and the unit axes, after the check of the axes."""
    geo = P.check_axes(P.geometry(session_tables(spark, sf)["p2"]))
    axes = [F.round(F.col(a)[i], 6).alias(f"{a}_{n}") for a in ("forward_axis", "lateral_axis") for i, n in enumerate("xyz")]
    return geo.select("session", *[F.round(c, 6).alias(c) for c in ("cue_width_m", "cue_length_m", "cue_center_separation_m")], *axes)


def session_flags(spark, sf):
    """Completion, consistency and interpretability of every session, with its plot columns."""
    out = P.analyse(session_tables(spark, sf))
    qa = out["qa"].select(
        "session", "four_session_ids_consistent", "p2_push_count_field", F.col("p2_push_list_count").cast("bigint").alias("p2_push_list_count"),
        "p2_all_samples_paired", "axis_projected_metrics.*",
    )
    return _rounded(out["summary"].select("session", "completed", "is_simulated").join(qa, "session").join(P.plot_bands(out["summary"]), "session"))


_BASE = f"""{SERIES_SQL},
  smp AS (SELECT entity || '-' || (pos // 400) AS session, entity, pos // 20 % 20 + 1 AS ai, pos, t // {PACE} AS t, cat <> 'error' AS ok, k, v,
    v * 1e-4 - 0.137 AS lx, k * 1e-4 AS ly, 0.137 - k * 1e-4 AS rx, v * 2e-4 AS ry, (pos % 20) * CAST(0.005 AS DOUBLE) AS z, v < 60 AS lin, k < 70 AS rin FROM series),
  geo AS (SELECT DISTINCT session, entity, (0.137 + (entity % 5) * CAST(0.001 AS DOUBLE)) * 2 AS sep, CASE WHEN entity % 2 = 0 THEN CAST(0 AS DOUBLE) ELSE 0.6 END AS fy,
    CASE WHEN entity % 2 = 0 THEN CAST(1 AS DOUBLE) ELSE 0.8 END AS fz FROM smp),
  act AS (SELECT session, ai, count(*) AS n, count(*) FILTER (ok) AS np, max(v) <= 200 AS both_used, min(t) AS t0, max(t) AS t1 FROM smp GROUP BY session, ai),
  par AS (SELECT smp.*, geo.sep, row_number() OVER w - 1 AS i FROM smp JOIN geo USING (session) WHERE ok WINDOW w AS (PARTITION BY smp.session, ai ORDER BY t)),
  hand AS (SELECT session, ai, 'l' AS h, i, t, lx AS x, ly AS y, z FROM par UNION ALL SELECT session, ai, 'r', i, t, rx, ry, z FROM par),
  step AS (SELECT *, x - lag(x) OVER w AS dx, y - lag(y) OVER w AS dy, z - lag(z) OVER w AS dz, (t - lag(t) OVER w) / 1e6 AS dt,
      ((t - first_value(t) OVER w) + (lag(t) OVER w - first_value(t) OVER w)) / 2e6 AS vt FROM hand WINDOW w AS (PARTITION BY session, ai, h ORDER BY i)),
  acc AS (SELECT *, (vt + lag(vt) OVER w) / 2 AS ta, (dx/dt - lag(dx/dt) OVER w) / (vt - lag(vt) OVER w) AS ax, (dy/dt - lag(dy/dt) OVER w) / (vt - lag(vt) OVER w) AS ay,
      (dz/dt - lag(dz/dt) OVER w) / (vt - lag(vt) OVER w) AS az, dx * lag(dx) OVER w + dy * lag(dy) OVER w + dz * lag(dz) OVER w AS num,
      sqrt(dx*dx + dy*dy + dz*dz) * lag(sqrt(dx*dx + dy*dy + dz*dz)) OVER w AS den FROM step WHERE i > 0 WINDOW w AS (PARTITION BY session, ai, h ORDER BY i)),
  jrk AS (SELECT *, (ax - lag(ax) OVER w) / (ta - lag(ta) OVER w) AS jx, (ay - lag(ay) OVER w) / (ta - lag(ta) OVER w) AS jy, (az - lag(az) OVER w) / (ta - lag(ta) OVER w) AS jz
      FROM acc WINDOW w AS (PARTITION BY session, ai, h ORDER BY i)),
  dyn AS (SELECT session, ai, h, sum(sqrt(dx*dx + dy*dy + dz*dz)) AS path, stddev_samp(sqrt(dx*dx + dy*dy + dz*dz) / dt) AS sv, sqrt(avg(ax*ax + ay*ay + az*az)) AS ar,
      sqrt(avg(jx*jx + jy*jy + jz*jz)) AS jr, coalesce(sum(CASE WHEN den > 0 THEN degrees(acos(greatest(-1.0, least(1.0, num / den)))) END), 0) AS turn FROM jrk GROUP BY session, ai, h),
  ext AS (SELECT session, ai, h, arg_max(x, i) - arg_min(x, i) AS nx, arg_max(y, i) - arg_min(y, i) AS ny, arg_max(z, i) - arg_min(z, i) AS nz, max(x) - min(x) AS lat FROM hand GROUP BY session, ai, h),
  agg AS (SELECT session, ai, count(*) AS m, (max(t) - min(t)) / 1e6 AS sdur, sum(sqrt((rx-lx)**2 + (ry-ly)**2)) AS seps,
      sum(abs(sqrt((rx-lx)**2 + (ry-ly)**2) - sep)) AS errs, count(*) FILTER (lin AND rin) AS nb FROM par GROUP BY session, ai),
  met AS (SELECT act.*, agg.m, agg.sdur, agg.seps, agg.errs, agg.nb, dl.path AS lpath, dr.path AS rpath, fy, fz,
      coalesce(both_used AND m >= 3 AND sdur > 0 AND dl.path > 0 AND dr.path > 0, false) AS basic, both_used AND coalesce(m, 0) >= 10 AS able, (t1 - t0) / 1e6 AS dur,
      el.nx AS lnx, el.ny AS lny, el.nz AS lnz, er.nx AS rnx, er.ny AS rny, er.nz AS rnz, (el.lat + er.lat) / 2 AS lat,
      sqrt(el.nx**2 + el.ny**2 + el.nz**2) AS lnet, sqrt(er.nx**2 + er.ny**2 + er.nz**2) AS rnet
    FROM act JOIN geo USING (session) LEFT JOIN agg ON act.session = agg.session AND act.ai = agg.ai
      LEFT JOIN dyn dl ON act.session = dl.session AND act.ai = dl.ai AND dl.h = 'l' LEFT JOIN dyn dr ON act.session = dr.session AND act.ai = dr.ai AND dr.h = 'r'
      LEFT JOIN ext el ON act.session = el.session AND act.ai = el.ai AND el.h = 'l' LEFT JOIN ext er ON act.session = er.session AND act.ai = er.ai AND er.h = 'r'),
  ord AS (SELECT session, both_used, t0, lag(t1) OVER w AS pe, lag(both_used) OVER w AS pb FROM met WINDOW w AS (PARTITION BY session ORDER BY t0, ai)),
  high AS (SELECT dyn.*, met.sdur FROM dyn JOIN met ON dyn.session = met.session AND dyn.ai = met.ai WHERE able),
  vals AS (
    SELECT session, 'duration' AS metric, dur AS v FROM met WHERE both_used
    UNION ALL SELECT session, 'gap', (t0 - pe) / 1e6 FROM ord WHERE both_used AND pb AND pe IS NOT NULL
    UNION ALL SELECT session, 'efficiency', lnet / lpath FROM met WHERE basic UNION ALL SELECT session, 'efficiency', rnet / rpath FROM met WHERE basic
    UNION ALL SELECT session, 'direction', greatest(-1.0, least(1.0, (lnx*rnx + lny*rny + lnz*rnz) / nullif(lnet * rnet, 0))) FROM met WHERE basic AND lnet * rnet > 0
    UNION ALL SELECT session, 'path_difference', abs(lpath - rpath) FROM met WHERE basic
    UNION ALL SELECT session, 'forward', ((lny + rny) * fy + (lnz + rnz) * fz) / 2 FROM met WHERE basic
    UNION ALL SELECT session, 'lateral', lat FROM met WHERE basic UNION ALL SELECT session, 'separation', seps / m FROM met WHERE basic
    UNION ALL SELECT session, 'separation_error', errs / m FROM met WHERE basic UNION ALL SELECT session, 'adherence', nb / m FROM met WHERE basic
    UNION ALL SELECT session, 'net', (lnet + rnet) / 2 FROM met WHERE basic UNION ALL SELECT session, 'path', (lpath + rpath) / 2 FROM met WHERE basic
    UNION ALL SELECT session, 'speed', (lpath + rpath) / 2 / dur FROM met WHERE basic AND dur > 0
    UNION ALL SELECT session, 'speed_variability_m_s', sv FROM high UNION ALL SELECT session, 'acceleration_rms_m_s2', ar FROM high
    UNION ALL SELECT session, 'jerk_rms_m_s3', jr FROM high UNION ALL SELECT session, 'direction_change_rate_deg_s', turn / sdur FROM high WHERE sdur > 0),
  st AS (SELECT session, metric, count(*) AS n, avg(v) AS mean, stddev_samp(v) AS sd, stddev_samp(v) / nullif(avg(v), 0) AS cv, quantile_cont(v, 0.25) AS q1, median(v) AS median,
      quantile_cont(v, 0.75) AS q3, count(*) FILTER (v < 0) AS negative, count(*) FILTER (v > 0) AS positive FROM vals WHERE v IS NOT NULL GROUP BY session, metric)"""

_GRASPS = f""", raw AS (SELECT session, ai, 'p1' AS phase, ai AS e, pos, t, lx AS x, ly AS y, z FROM smp UNION ALL SELECT session, ai, 'p3', ai // 2, pos, t, rx, ry, z FROM smp WHERE ai % 2 = 0),
  rst AS (SELECT *, sqrt((x - lag(x) OVER w)**2 + (y - lag(y) OVER w)**2 + (z - lag(z) OVER w)**2) AS d FROM raw WINDOW w AS (PARTITION BY session, phase, e ORDER BY pos)),
  ep AS (SELECT session, phase, e AS episode_index, CASE phase WHEN 'p1' THEN 'Left' ELSE 'Right' END AS hand, count(*) AS n, min(t) AS s, max(t) + CASE phase WHEN 'p1' THEN {HOLD} ELSE 0 END AS f,
      (max(t) - min(t)) / 1e6 AS dur, sum(d) AS path, sqrt((arg_max(x, pos) - arg_min(x, pos))**2 + (arg_max(y, pos) - arg_min(y, pos))**2 + (arg_max(z, pos) - arg_min(z, pos))**2) AS net
    FROM rst GROUP BY session, phase, e),
  epi AS (SELECT *, CASE WHEN n >= 3 AND dur > 0 AND path > 0 THEN net / path END AS eff, s > coalesce(max(f) OVER (PARTITION BY session, phase ORDER BY s, f ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), s - 1) AS opens FROM ep),
  tr AS (SELECT session, phase, (max(f) - min(s)) / 1e6 AS span, count(*) AS episodes, count(*) FILTER (opens) AS attempts, count(eff) AS eligible, avg(eff) AS mean, median(eff) AS med FROM epi GROUP BY session, phase)"""

_TRANSFER = ", ".join(
    f"round({p}.span, 9) AS {p}_recorded_activity_span_s, coalesce({p}.episodes, 0) AS {p}_recorded_grasp_episodes, coalesce({p}.attempts, 0) AS {p}_distinct_transfer_attempts, "
    f"coalesce({p}.eligible, 0) AS {p}_eligible_grasp_episodes, round({p}.mean, 6) AS {p}_path_efficiency_mean" for p in ("p1", "p3"))
_PHASES = "LEFT JOIN tr p1 ON p1.session = geo.session AND p1.phase = 'p1' LEFT JOIN tr p3 ON p3.session = geo.session AND p3.phase = 'p3'"


def _stat(metric: str, stat: str, name: str) -> str:
    picked = f"max(CASE WHEN metric = '{metric}' THEN {stat} END)"
    return f"CAST(coalesce({picked}, 0) AS BIGINT) AS {name}" if stat in ("n", "negative") else f"round({picked}, {_digits(name)}) AS {name}"


_CROSSES = "coalesce(max(CASE WHEN metric = 'forward' THEN negative END) > 0 AND max(CASE WHEN metric = 'forward' THEN positive END) > 0, false)"
_STEADY = "coalesce(max(CASE WHEN metric = '{m}' THEN cv END) IS NOT NULL AND max(CASE WHEN metric = '{m}' THEN mean END) > 0, false)"
_FORWARD, _LATERAL = f"{_STEADY.format(m='forward')} AND NOT {_CROSSES}", _STEADY.format(m="lateral")
_OWN = f"""completed AS (SELECT session, entity % 4 < 2 AND entity % 3 <> 0 AS completed, entity % 2 = 1 AS is_simulated, entity % 7 <> 0 AND entity % 11 <> 0 AS same FROM geo),
  ev AS (SELECT smp.session, smp.t + k * {DELAY} AS moment FROM smp WHERE NOT ok),
  hit AS (SELECT ev.session, count(*) AS raw, count(m.ai) AS linked, count(*) FILTER (m.both_used) AS linked_both FROM ev LEFT JOIN LATERAL (SELECT ai, both_used FROM act
      WHERE act.session = ev.session AND moment BETWEEN t0 AND t1 ORDER BY t0, ai LIMIT 1) m ON true GROUP BY ev.session)"""

_SUMMARY = f"""WITH {_BASE}{_GRASPS}, {_OWN},
  wide AS (SELECT session, {", ".join(_stat(m, s, n) for m, fields in P.SUMMARY_FIELDS.items() for s, n in fields.items())},
    {_FORWARD} AS p2_mean_bilateral_signed_forward_displacement_cv_interpretable, {_LATERAL} AS p2_mean_bilateral_lateral_excursion_cv_interpretable FROM st GROUP BY session),
  cnt AS (SELECT session, round((max(t1) - min(t0)) / 1e6, 9) AS p2_recorded_activity_span_s, count(*) AS p2_recorded_action_count, count(*) FILTER (both_used) AS p2_bilateral_classified_count,
    count(*) FILTER (NOT both_used) AS p2_single_hand_classified_count, count(*) FILTER (basic) AS p2_basic_bilateral_action_count, count(*) FILTER (able) AS p2_higher_order_action_count,
    2 * count(*) FILTER (able) AS p2_higher_order_hand_action_count, round(sum(seps) FILTER (basic) / sum(m) FILTER (basic), 9) AS p2_mean_hand_separation_pooled_m,
    round(sum(errs) FILTER (basic) / sum(m) FILTER (basic), 9) AS p2_separation_error_pooled_m, round(sum(nb) FILTER (basic) / sum(m) FILTER (basic), 6) AS p2_bilateral_adherence_pooled,
    round(count(*) FILTER (both_used) / count(*), 6) AS p2_bilateral_participation_rate, round(count(*) * 60.0 / nullif((max(t1) - min(t0)) / 1e6, 0), 6) AS p2_recorded_frequency_per_min,
    round(count(*) FILTER (both_used) * 60.0 / nullif((max(t1) - min(t0)) / 1e6, 0), 6) AS p2_bilateral_frequency_per_min FROM met GROUP BY session),
  events_of AS (SELECT session, coalesce(raw, 0) AS p2_needle_events_raw, coalesce(linked, 0) AS p2_needle_events_action_linked, coalesce(raw - linked, 0) AS p2_needle_events_outside_actions,
    coalesce(linked_both, 0) AS p2_needle_events_bilateral_action_linked, coalesce(raw - linked_both, 0) AS p2_needle_events_nonbilateral_or_outside FROM geo LEFT JOIN hit USING (session))
  SELECT geo.session, CASE WHEN entity % 2 = 0 THEN 'Simulated' ELSE 'Researcher-operated' END AS profile, completed, is_simulated, same AS session_id_consistent,
    CASE WHEN entity % 3 > 0 THEN 'timeout' END AS p2_exit_reason, CAST(0.028 AS DOUBLE) AS cue_width_m, CAST(0.056 AS DOUBLE) AS cue_length_m, round(sep, 6) AS cue_center_separation_m, {_TRANSFER},
    round(p1.med, 6) AS p1_path_efficiency_median, round(p3.med, 6) AS p3_path_efficiency_median, cnt.* EXCLUDE (session),
    {", ".join(f"coalesce(wide.{n}, 0) AS {n}" if s in ("n", "negative") else f"wide.{n}" for fields in P.SUMMARY_FIELDS.values() for s, n in fields.items())},
    coalesce(wide.p2_mean_bilateral_signed_forward_displacement_cv_interpretable, false) AS p2_mean_bilateral_signed_forward_displacement_cv_interpretable,
    coalesce(wide.p2_mean_bilateral_lateral_excursion_cv_interpretable, false) AS p2_mean_bilateral_lateral_excursion_cv_interpretable,
    3 AS generated_phase_files, 1 AS generated_metadata_files, events_of.* EXCLUDE (session)
  FROM geo {_PHASES} JOIN completed ON completed.session = geo.session JOIN cnt ON cnt.session = geo.session JOIN events_of ON events_of.session = geo.session LEFT JOIN wide ON wide.session = geo.session"""

QUERIES = {
    "session_summary": session_summary,
    "transfer_episodes": transfer_episodes,
    "transfer_summary": transfer_summary,
    "session_geometry": session_geometry,
    "session_flags": session_flags,
}

ORACLES = {
    "session_summary": _SUMMARY,
    "transfer_episodes": f"""WITH {_BASE}{_GRASPS} SELECT session, phase, episode_index, hand, n, round((f - s) / 1e6, 9) AS episode_duration_s, round(path, 9) AS path_m,
        CASE WHEN n >= 2 THEN round(net, 9) END AS net_m, round(eff, 6) AS path_efficiency, CASE WHEN dur > 0 THEN round(path / dur, 9) END AS mean_speed_m_s FROM epi""",
    "transfer_summary": f"WITH {_BASE}{_GRASPS} SELECT geo.session, {_TRANSFER} FROM geo {_PHASES}",
    "session_geometry": f"""WITH {_BASE} SELECT session, CAST(0.028 AS DOUBLE) AS cue_width_m, CAST(0.056 AS DOUBLE) AS cue_length_m, round(sep, 6) AS cue_center_separation_m,
        CAST(0 AS DOUBLE) AS forward_axis_x, round(fy, 6) AS forward_axis_y, round(fz, 6) AS forward_axis_z, CAST(1 AS DOUBLE) AS lateral_axis_x, CAST(0 AS DOUBLE) AS lateral_axis_y,
        CAST(0 AS DOUBLE) AS lateral_axis_z FROM geo""",
    "session_flags": f"""WITH {_BASE}, {_OWN}, f AS (SELECT session, {_CROSSES} AS crosses, {_FORWARD} AS fi, {_LATERAL} AS li,
        max(CASE WHEN metric = 'direction' THEN q3 - q1 END) AS di, max(CASE WHEN metric = 'duration' THEN q3 - q1 END) AS du,
        max(CASE WHEN metric = 'forward' THEN cv END) AS fcv, max(CASE WHEN metric = 'lateral' THEN cv END) AS lcv FROM st GROUP BY session),
      a AS (SELECT session, count(*) AS n, bool_and(n = np) AS paired FROM met GROUP BY session)
      SELECT geo.session, completed, is_simulated, same AS four_session_ids_consistent, a.n + CAST(entity % 13 = 0 AS BIGINT) AS p2_push_count_field, a.n AS p2_push_list_count,
        a.paired AS p2_all_samples_paired, coalesce(crosses, false) AS signed_forward_crosses_zero, coalesce(fi, false) AS signed_forward_cv_interpretable, coalesce(li, false) AS lateral_excursion_cv_interpretable,
        round(di, 6) AS directional_consistency_iqr, round(du, 9) AS action_duration_iqr_s, CASE WHEN fi THEN round(fcv, 6) END AS forward_cv_shown, CASE WHEN li THEN round(lcv, 6) END AS lateral_cv_shown
      FROM geo JOIN completed ON completed.session = geo.session JOIN a ON a.session = geo.session LEFT JOIN f ON f.session = geo.session""",
}
