"""Sequence operators over the event series."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import series as seq
from ..operators.blocks import Carry, carry
from ..operators.stats import exact_quantiles
from .views import SERIES_SQL, series

KEY = ["entity"]
FPS = 20.0


def _out(df, *cols):
    return df.select("entity", "pos", *[F.round(c, 6).alias(c) for c in cols])


def first_diff_speed(spark, sf):
    d = seq.first_difference(series(spark, sf), KEY, "v", F.lit(FPS), "velocity")
    return d.groupBy("entity").agg(
        F.round(F.avg(F.abs("velocity")), 6).alias("avg_speed"),
        F.round(F.stddev_pop("velocity"), 6).alias("std_speed"),
        F.round(F.max("v") - F.min("v"), 6).alias("amplitude"),
    )


def central_gradient(spark, sf):
    return _out(seq.central_gradient(series(spark, sf), KEY, "x", F.lit(FPS), "gradient"), "gradient")


def rolling_median_5(spark, sf):
    return _out(seq.rolling_median(series(spark, sf), KEY, {"m": "x"}, 2, 2), "m")


def rolling_median_3_min2(spark, sf):
    return _out(seq.rolling_median(series(spark, sf), KEY, {"m": "x"}, 1, 1, min_valid=2), "m")


def rolling_median_4(spark, sf):
    return _out(seq.rolling_median(series(spark, sf), KEY, {"m": "x"}, 2, 1), "m")


def savgol_7(spark, sf):
    return _out(seq.quadratic_smooth(series(spark, sf), KEY, "v", "smooth"), "smooth")


def smooth_velocity_chain(spark, sf):
    filled = seq.interpolate(series(spark, sf), KEY, {"f": "x"}, mode="inside")
    out = seq.smooth_runs(filled, KEY, {"smooth": "f"}, velocity={"velocity": "smooth"}, scale=F.lit(FPS))
    return _out(out, "smooth", "velocity")


def interp_both(spark, sf):
    return _out(seq.interpolate(series(spark, sf), KEY, {"filled": "x"}, mode="both"), "filled")


def interp_zero(spark, sf):
    return _out(seq.interpolate(series(spark, sf), KEY, {"filled": "x"}, mode="zero"), "filled")


def interp_limit3(spark, sf):
    return _out(seq.interpolate(series(spark, sf), KEY, {"filled": "x"}, mode="inside"), "filled")


def true_runs(spark, sf):
    return seq.true_runs(series(spark, sf), KEY, F.col("v") > 40)


def close_short_gaps(spark, sf):
    closed = seq.closed_mask(series(spark, sf), KEY, F.col("v") > 40, F.lit(3), 3, "closed")
    return seq.true_runs(closed, KEY, F.col("closed"))


def running_totals(spark, sf):
    s = series(spark, sf)
    out = carry(s, KEY, "pos", {"total": Carry("sum", F.col("v"))}, F.expr("pos div 65536"))
    return _out(out, "total")


def local_peaks(spark, sf):
    """Peaks at or above max(floor, 0.90 quantile) outside the edges; else the first global maximum."""
    edge, base = 5, 100.0
    s = series(spark, sf).select("entity", "pos", "v")
    bound = (
        s.groupBy("entity").agg(
            F.max("pos").alias("last_pos"), F.max(F.struct("v", -F.col("pos"))).alias("top")
        ).join(exact_quantiles(s, KEY, F.col("v"), {"q90": 0.90}), "entity")
        .withColumn("threshold", F.greatest(F.lit(base), F.col("q90")))
    )
    peaks = (
        seq.local_peaks(s, KEY, "v", "is_peak").where("is_peak").join(bound, "entity")
        .where((F.col("pos") >= edge) & (F.col("pos") <= F.col("last_pos") - edge) & (F.col("v") >= F.col("threshold")))
        .select("entity", "pos", "v", "threshold")
    )
    lonely = bound.join(peaks.select("entity").distinct(), "entity", "left_anti").where(F.col("top.v") >= base)
    fallback = lonely.select("entity", (-F.col("top.col2")).alias("pos"), F.col("top.v").alias("v"), "threshold")
    return peaks.unionByName(fallback).select("entity", "pos", "v", F.round("threshold", 6).alias("threshold"))


def pre_post_delta(spark, sf):
    """Median of the last third minus median of the first third of each series (at least six rows)."""
    s = series(spark, sf).select("entity", "pos", "v")
    n = s.groupBy("entity").agg(F.count("*").alias("n")).where("n >= 6")
    j = s.join(n, "entity").withColumn("k", F.greatest(F.lit(2), F.floor(F.col("n") / 3)))
    part = F.when(F.col("pos") < F.col("k"), "first").when(F.col("pos") >= F.col("n") - F.col("k"), "last")
    thirds = j.withColumn("part", part).where("part IS NOT NULL")
    q = exact_quantiles(thirds, ["entity", "part"], F.col("v"), {"med": 0.5})
    side = {p: F.max(F.when(F.col("part") == p, F.col("med"))) for p in ("first", "last")}
    return q.groupBy("entity").agg(F.round(side["last"] - side["first"], 6).alias("delta"))


def joint_angle(spark, sf):
    """Angle at the current point between its neighbours, points (v, k)."""
    s = series(spark, sf)
    wide = seq.with_halo(s, 1)
    w = seq.halo_window(KEY)
    p = [F.col("v"), F.col("k").cast("double")]
    before, after = [F.lag(c).over(w) for c in p], [F.lead(c).over(w) for c in p]
    names = {f"_{n}{i}": c for n, pt in (("b", before), ("a", after)) for i, c in enumerate(pt)}
    out = seq.own_rows(wide.withColumns(names))
    angle = S.joint_angle([F.col("_b0"), F.col("_b1")], p, [F.col("_a0"), F.col("_a1")])
    return out.withColumn("angle", angle).select("entity", "pos", F.round("angle", 5).alias("angle"))


_W = "(PARTITION BY entity ORDER BY pos ROWS BETWEEN {} PRECEDING AND {} FOLLOWING)"
_PN = """pn AS (
  SELECT *, max(CASE WHEN x IS NOT NULL THEN pos END) OVER (PARTITION BY entity ORDER BY pos
                ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS pp,
            min(CASE WHEN x IS NOT NULL THEN pos END) OVER (PARTITION BY entity ORDER BY pos
                ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS np
  FROM series), pv AS (
  SELECT pn.*, a.x AS px, b.x AS nx FROM pn
  LEFT JOIN series a ON a.entity = pn.entity AND a.pos = pn.pp
  LEFT JOIN series b ON b.entity = pn.entity AND b.pos = pn.np)"""
_LINE = "(nx - px) / (np - pp) * (pos - pp) + px"
_BOTH = f"CASE WHEN x IS NOT NULL THEN x WHEN px IS NOT NULL AND nx IS NOT NULL THEN {_LINE} ELSE coalesce(px, nx) END"
_INSIDE = (
    f"CASE WHEN x IS NOT NULL THEN x WHEN px IS NOT NULL AND nx IS NOT NULL AND pos - pp <= 3 THEN {_LINE} END"
)


def _rolling(before, after, condition=""):
    w = _W.format(before, after)
    value = f"median(x) OVER {w}"
    if condition:
        value = f"CASE WHEN count(x) OVER {w} >= {condition} THEN {value} END"
    return f"WITH {SERIES_SQL} SELECT entity, pos, round({value}, 6) AS m FROM series"


def _fit(value, run, i, n):
    """Least-squares quadratic over seven points of a run, written out from the weights."""
    from ..operators.series import QUADRATIC_7

    def expr(place, first):
        weights, scale = QUADRATIC_7[place]
        terms = " + ".join(
            f"{c} * lead({value}, {k - place}) OVER ({run})" if k > place
            else (f"{c} * lag({value}, {place - k}) OVER ({run})" if k < place else f"{c} * {value}")
            for k, c in enumerate(weights)
        )
        return f"({terms}) / {scale}.0"

    cases = [f"WHEN {n} < 7 THEN {value}"]
    cases += [f"WHEN {i} = {p} THEN {expr(p, 0)}" for p in (0, 1, 2)]
    cases += [f"WHEN {n} - 1 - {i} = {6 - p} THEN {expr(p, 0)}" for p in (6, 5, 4)]
    return f"CASE {' '.join(cases)} ELSE {expr(3, 0)} END"


_RUNS = """marked AS (SELECT entity, pos, {mask} AS m FROM series),
  isl AS (SELECT entity, pos, pos - row_number() OVER (PARTITION BY entity ORDER BY pos) AS g FROM marked WHERE m)
  SELECT entity, min(pos) AS "start", max(pos) AS "end", count(*) AS length FROM isl GROUP BY entity, g"""

_CLOSED = """isl0 AS (SELECT entity, pos, pos - row_number() OVER (PARTITION BY entity ORDER BY pos) AS g
             FROM series WHERE v > 40),
  runs0 AS (SELECT entity, min(pos) AS s, max(pos) AS e FROM isl0 GROUP BY entity, g),
  flagged AS (SELECT *, CASE WHEN s - lag(e) OVER (PARTITION BY entity ORDER BY s) - 1 <= 3 THEN 0 ELSE 1 END AS f
              FROM runs0),
  grouped AS (SELECT *, sum(f) OVER (PARTITION BY entity ORDER BY s) AS g FROM flagged)
  SELECT entity, min(s) AS "start", max(e) AS "end", max(e) - min(s) + 1 AS length FROM grouped GROUP BY entity, g"""

_CHAIN = f"""WITH {SERIES_SQL}, {_PN},
  filled AS (SELECT entity, pos, {_INSIDE} AS f FROM pv),
  isl AS (SELECT *, pos - row_number() OVER (PARTITION BY entity ORDER BY pos) AS g FROM filled WHERE f IS NOT NULL),
  med AS (SELECT *, median(f) OVER (PARTITION BY entity, g ORDER BY pos
                 ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS m,
                 row_number() OVER (PARTITION BY entity, g ORDER BY pos) - 1 AS i,
                 count(*) OVER (PARTITION BY entity, g) AS n FROM isl),
  smo AS (SELECT *, {_fit("m", "PARTITION BY entity, g ORDER BY pos", "i", "n")} AS s FROM med),
  vel AS (SELECT *, CASE WHEN n < 2 THEN NULL
      WHEN i = 0 THEN lead(s) OVER r - s WHEN i = n - 1 THEN s - lag(s) OVER r
      ELSE (lead(s) OVER r - lag(s) OVER r) / 2 END * 20 AS vv
      FROM smo WINDOW r AS (PARTITION BY entity, g ORDER BY pos))
  SELECT series.entity, series.pos, round(s, 6) AS smooth, round(vv, 6) AS velocity
  FROM series LEFT JOIN vel ON vel.entity = series.entity AND vel.pos = series.pos"""

QUERIES = {
    "first_diff_speed": first_diff_speed,
    "central_gradient": central_gradient,
    "rolling_median_5": rolling_median_5,
    "rolling_median_3_min2": rolling_median_3_min2,
    "rolling_median_4": rolling_median_4,
    "savgol_7": savgol_7,
    "smooth_velocity_chain": smooth_velocity_chain,
    "interp_both": interp_both,
    "interp_zero": interp_zero,
    "interp_limit3": interp_limit3,
    "true_runs": true_runs,
    "close_short_gaps": close_short_gaps,
    "running_totals": running_totals,
    "local_peaks": local_peaks,
    "pre_post_delta": pre_post_delta,
    "joint_angle": joint_angle,
}

ORACLES = {
    "first_diff_speed": f"""WITH {SERIES_SQL}, d AS (
        SELECT entity, v, (v - lag(v) OVER (PARTITION BY entity ORDER BY pos)) * 20 AS velocity FROM series)
        SELECT entity, round(avg(abs(velocity)), 6) AS avg_speed, round(stddev_pop(velocity), 6) AS std_speed,
               round(max(v) - min(v), 6) AS amplitude FROM d GROUP BY entity""",
    "central_gradient": f"""WITH {SERIES_SQL}, d AS (SELECT *, lag(x) OVER w AS b, lead(x) OVER w AS a
        FROM series WINDOW w AS (PARTITION BY entity ORDER BY pos))
        SELECT entity, pos, round(20 * CASE WHEN x IS NULL THEN NULL
          WHEN a IS NOT NULL AND b IS NOT NULL THEN (a - b) / 2
          WHEN a IS NOT NULL THEN a - x WHEN b IS NOT NULL THEN x - b END, 6) AS gradient FROM d""",
    "rolling_median_5": _rolling(2, 2),
    "rolling_median_3_min2": _rolling(1, 1, "2"),
    "rolling_median_4": _rolling(2, 1),
    "savgol_7": f"""WITH {SERIES_SQL}, d AS (SELECT entity, pos, v, pos AS i,
        count(*) OVER (PARTITION BY entity) AS n FROM series)
        SELECT entity, pos, round({_fit("v", "PARTITION BY entity ORDER BY pos", "i", "n")}, 6) AS smooth FROM d""",
    "smooth_velocity_chain": _CHAIN,
    "interp_both": f"WITH {SERIES_SQL}, {_PN} SELECT entity, pos, round({_BOTH}, 6) AS filled FROM pv",
    "interp_zero": f"WITH {SERIES_SQL}, {_PN} SELECT entity, pos, round(coalesce({_BOTH}, 0), 6) AS filled FROM pv",
    "interp_limit3": f"WITH {SERIES_SQL}, {_PN} SELECT entity, pos, round({_INSIDE}, 6) AS filled FROM pv",
    "true_runs": f"WITH {SERIES_SQL}, " + _RUNS.format(mask="v > 40"),
    "close_short_gaps": f"WITH {SERIES_SQL}, {_CLOSED}",
    "running_totals": f"""WITH {SERIES_SQL} SELECT entity, pos,
        round(sum(v) OVER (PARTITION BY entity ORDER BY pos), 6) AS total FROM series""",
    "local_peaks": f"""WITH {SERIES_SQL}, b AS (SELECT entity, max(pos) AS last_pos,
          greatest(100.0, quantile_cont(v, 0.90)) AS threshold FROM series GROUP BY entity),
        d AS (SELECT *, lag(v) OVER w AS p, lead(v) OVER w AS n FROM series WINDOW w AS (PARTITION BY entity ORDER BY pos)),
        peaks AS (SELECT d.entity, d.pos, d.v, threshold FROM d JOIN b USING (entity)
          WHERE v >= p AND v >= n AND pos >= 5 AND pos <= last_pos - 5 AND v >= threshold),
        top AS (SELECT entity, pos, v, row_number() OVER (PARTITION BY entity ORDER BY v DESC, pos) AS r FROM series),
        fb AS (SELECT top.entity, top.pos, top.v, threshold FROM top JOIN b USING (entity)
          WHERE r = 1 AND v >= 100.0 AND entity NOT IN (SELECT entity FROM peaks))
        SELECT entity, pos, v, round(threshold, 6) AS threshold FROM (SELECT * FROM peaks UNION ALL SELECT * FROM fb)""",
    "pre_post_delta": f"""WITH {SERIES_SQL}, c AS (SELECT *, count(*) OVER (PARTITION BY entity) AS n FROM series),
        e AS (SELECT *, greatest(2, n // 3) AS kk FROM c WHERE n >= 6)
        SELECT entity, round(median(v) FILTER (pos >= n - kk) - median(v) FILTER (pos < kk), 6) AS delta
        FROM e GROUP BY entity""",
    "joint_angle": f"""WITH {SERIES_SQL}, d AS (SELECT entity, pos, lag(v) OVER w - v AS ax, lag(k) OVER w - k AS ay,
          lead(v) OVER w - v AS bx, lead(k) OVER w - k AS "by" FROM series WINDOW w AS (PARTITION BY entity ORDER BY pos)),
        n AS (SELECT *, sqrt(ax*ax + ay*ay) AS na, sqrt(bx*bx + "by"*"by") AS nb FROM d),
        c AS (SELECT entity, pos, CASE WHEN na >= 1e-6 AND nb >= 1e-6 THEN (ax*bx + ay*"by") / (na * nb) END AS cs FROM n)
        SELECT entity, pos, CASE WHEN cs IS NOT NULL
          THEN round(degrees(acos(greatest(-1.0, least(1.0, cs)))), 5) END AS angle FROM c""",
}
