"""Cycle-balanced density estimation over event points."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..constants import BANDWIDTHS_SW, HANDS, PHASES
from ..operators import density as D
from ..plans import spatial
from ..session import materialize
from .views import CYCLE_LEN, SERIES_SQL, series

GROUPS = ["phase", "hand"]


def points(spark, sf):
    """Event type as phase, counter half as hand, user as video, 20 rows as cycle."""
    phase = F.when(F.col("cat").isin("click", "error"), "P1").when(F.col("cat") == "view", "P3").otherwise("P2")
    return series(spark, sf).select(
        phase.alias("phase"), F.when(F.col("k") < 50, "left").otherwise("right").alias("hand"),
        F.col("entity").alias("video"), F.concat_ws(":", "entity", F.expr(f"pos div {CYCLE_LEN}")).alias("cycle"),
        (F.col("v") / 100 + 0.00033).alias("x"), (F.col("k") / 100 + 0.00033).alias("y"),
    )


def _cells(spark, sf):
    pts = points(spark, sf)
    grid = D.make_grid(pts, "x", "y")
    return grid, D.cycle_histograms(pts, GROUPS, "video", "cycle", "x", "y", grid)


def hist_2d_unit_mass(spark, sf):
    _, cells = _cells(spark, sf)
    return cells.select(*GROUPS, "cycle", F.col("ix").cast("bigint").alias("ix"), F.col("iy").cast("bigint").alias("iy"), F.round("w", 9).alias("w"))


def _scores(spark, sf):
    grid, cells = _cells(spark, sf)
    return D.leave_one_video_out(cells, GROUPS, "video", "cycle", grid)


def lovo_scores(spark, sf):
    return _scores(spark, sf).select(
        *GROUPS, "bandwidth_sw", "contributing_cycles",
        F.round("mean_heldout_cycle_log_score", 5).alias("mean_score"), F.round("sd_heldout_cycle_log_score", 5).alias("sd_score"),
    )


def bandwidth_rank(spark, sf):
    return D.rank_bandwidths(_scores(spark, sf)).withColumn(
        "equal_group_mean_loo_log_score", F.round("equal_group_mean_loo_log_score", 5)
    )


def paired_rule(spark, sf):
    """Paired losses from the best bandwidth, and the widest one within a standard error."""
    out = D.paired_rule(materialize(_scores(spark, sf)))
    return out.select("bandwidth_sw", F.round("paired_mean_loss_from_best", 5).alias("loss"), F.round("paired_se_loss_from_best", 5).alias("se"), "eligible", "selected")


def hdr_summary(spark, sf):
    grid, cells = _cells(spark, sf)
    mass = materialize(D.fitted_density(cells, GROUPS, "video", "cycle", grid, 0.04))
    out = D.hdr_summary(mass, GROUPS, grid)
    return out.select(*GROUPS, "coverage", *[F.round(c, 6).alias(c) for c in ("area_sw2", "achieved_probability_mass", "x_centroid_sw", "y_centroid_sw")])


def density_grid(spark, sf):
    """All cells of the smoothed mass, empty ones included, in figures per group."""
    grid, cells = _cells(spark, sf)
    mass = D.whole_grid(D.fitted_density(cells, GROUPS, "video", "cycle", grid, 0.04), GROUPS, grid)
    return mass.groupBy(*GROUPS).agg(
        F.count("*").alias("cells"), F.round(F.sum("mass"), 6).alias("total"), F.round(F.max("mass"), 9).alias("peak"),
        F.round(F.sum(F.col("mass") * F.col("mass")), 9).alias("roughness"),
    )


#: Thresholds for cycles of 20 rows.
SHORT_CYCLES = {"min_samples": 2, "min_availability": 0.4}


def audit(pts):
    """One row per cycle with the frames it keeps and those valid for either hand, per phase."""
    counts = {}
    for phase in PHASES:
        here = F.col("phase") == phase
        counts[f"{phase}_retained_frames"] = F.greatest(F.count_if(here), F.lit(1))
        for hand in HANDS:
            counts[f"{phase}_{hand}_valid_frames"] = F.count_if(here & (F.col("hand") == hand))
    return pts.groupBy(F.col("cycle").alias("cycle_key")).agg(*[c.alias(n) for n, c in counts.items()])


def eligibility_filter(spark, sf):
    """Points of the cycles that the plan finds eligible per phase, with thresholds for short cycles."""
    pts = points(spark, sf)
    ok = spatial.eligible_cycles(audit(pts), **SHORT_CYCLES).withColumnRenamed("cycle_key", "cycle")
    return pts.join(ok, ["cycle", "phase"], "left_semi").groupBy("phase", "hand").agg(
        F.countDistinct("cycle").alias("cycles"), F.count("*").alias("observations")
    )


def _plan(spark, sf):
    pts = points(spark, sf)
    named = pts.select(
        F.col("cycle").alias("cycle_key"), F.col("video").cast("string").alias("video_id"), F.split_part("cycle", F.lit(":"), F.lit(2)).alias("work_cycle_id"),
        *GROUPS, F.col("x").alias(spatial.X), F.col("y").alias(spatial.Y),
    )
    return spatial.analyse(named, audit(pts), **SHORT_CYCLES)


def spatial_regions(spark, sf):
    """The spatial plan's regions of both analysis sets, at the bandwidth that it selects."""
    out = _plan(spark, sf)
    rounded = ("area_sw2", "achieved_probability_mass", "x_centroid_sw", "y_centroid_sw", "centroid_distance_from_needle_sw")
    return out["primary_hdr"].unionByName(out["sensitivity_hdr"]).select(
        "analysis_set", *GROUPS, "coverage", "contributing_cycles", "valid_wrist_observations",
        *[F.round(c, 6).alias(c) for c in rounded], F.round("probability_mass_threshold", 9).alias("threshold"), "isotropic_bandwidth_sw",
    )


def spatial_grid(spark, sf):
    """The spatial plan's grid of eligible cycles: cells of at least 1e-6 with their place and the regions they lie in."""
    grid = _plan(spark, sf)["density_grid"].where("round(probability_mass, 9) >= 0.000001")
    return grid.select(
        *GROUPS, F.round(spatial.X, 6).alias("x"), F.round(spatial.Y, 6).alias("y"), F.round("probability_mass", 9).alias("mass"),
        "inside_50_percent_hdr", "inside_90_percent_hdr",
    )


_POINTS = f"""{SERIES_SQL}, pts AS (SELECT CASE WHEN cat IN ('click', 'error') THEN 'P1' WHEN cat = 'view' THEN 'P3' ELSE 'P2' END AS phase,
    CASE WHEN k < 50 THEN 'left' ELSE 'right' END AS hand, entity AS video, entity || ':' || (pos // 20) AS cycle,
    v / 100 + CAST(0.00033 AS DOUBLE) AS x, k / 100 + CAST(0.00033 AS DOUBLE) AS y FROM series),
  ext AS (SELECT floor((min(x) - CAST(0.72 AS DOUBLE)) / CAST(0.025 AS DOUBLE)) * CAST(0.025 AS DOUBLE) AS x0,
      ceil((max(x) + CAST(0.72 AS DOUBLE)) / CAST(0.025 AS DOUBLE)) AS x1, floor((min(y) - CAST(0.72 AS DOUBLE)) / CAST(0.025 AS DOUBLE)) * CAST(0.025 AS DOUBLE) AS y0,
      ceil((max(y) + CAST(0.72 AS DOUBLE)) / CAST(0.025 AS DOUBLE)) AS y1 FROM pts),
  dim AS (SELECT x0, y0, CAST(x1 - round(x0 / 0.025) AS BIGINT) + 40 AS nx, CAST(y1 - round(y0 / 0.025) AS BIGINT) + 40 AS ny FROM ext),
  raw AS (SELECT phase, hand, video, cycle, CAST(floor((x - x0) / 0.025) AS BIGINT) + 20 AS ix, CAST(floor((y - y0) / 0.025) AS BIGINT) + 20 AS iy,
      count(*) AS n FROM pts, dim GROUP BY ALL)"""
_CELLS = "cells AS (SELECT phase, hand, video, cycle, ix, iy, n / sum(n) OVER (PARTITION BY phase, hand, cycle) AS w FROM cnt)"
_PTS = f"{_POINTS}, cnt AS (SELECT * FROM raw), {_CELLS}"

_BW = ", ".join(f"({i}, CAST({b} AS DOUBLE))" for i, b in enumerate(BANDWIDTHS_SW))


def _kernels(values):
    return f"""bw AS (SELECT * FROM (VALUES {values}) t(b, h)),
  krad AS (SELECT b, h / 0.025 AS s, CAST(floor(8 * (h / 0.025) + 0.5) AS BIGINT) AS r FROM bw),
  kz AS (SELECT krad.b, s, r, sum(exp(-0.5 * (d / s) ** 2)) AS z FROM krad, range(-110, 111) t(d) WHERE abs(d) <= r GROUP BY ALL),
  mx AS (SELECT kz.b, i.i, sum(exp(-0.5 * ((j.j - i.i) / s) ** 2) / z) AS m FROM kz, dim, range(0, 600) i(i), range(0, 600) j(j)
      WHERE i.i < nx AND j.j < nx AND abs(j.j - i.i) <= r GROUP BY ALL),
  my AS (SELECT kz.b, i.i, sum(exp(-0.5 * ((j.j - i.i) / s) ** 2) / z) AS m FROM kz, dim, range(0, 600) i(i), range(0, 600) j(j)
      WHERE i.i < ny AND j.j < ny AND abs(j.j - i.i) <= r GROUP BY ALL),
  tot AS (SELECT phase, hand, cycle, mx.b, sum(w * mx.m * my.m) AS t FROM cells JOIN mx ON mx.i = ix JOIN my ON my.i = iy AND my.b = mx.b GROUP BY ALL),
  a AS (SELECT cells.phase, cells.hand, video, ix, iy, b, sum(w / t) AS a FROM cells JOIN tot USING (phase, hand, cycle) GROUP BY ALL)"""


def _lovo(cells):
    return f"""WITH {cells}, {_kernels(_BW)},
  own AS (SELECT DISTINCT phase, hand, video, ix, iy FROM cells),
  nc AS (SELECT phase, hand, video, count(DISTINCT cycle) AS c FROM cells GROUP BY ALL),
  na AS (SELECT phase, hand, sum(c) AS c FROM nc GROUP BY ALL),
  den AS (SELECT own.phase, own.hand, own.video, own.ix, own.iy, a.b,
      sum(a.a * exp(-0.5 * ((own.ix - a.ix) ** 2 + (own.iy - a.iy) ** 2) / (s * s)) / (z * z)) AS d
    FROM own JOIN a ON a.phase = own.phase AND a.hand = own.hand AND a.video <> own.video
    JOIN kz ON kz.b = a.b AND abs(own.ix - a.ix) <= r AND abs(own.iy - a.iy) <= r GROUP BY ALL),
  sc AS (SELECT c.phase, c.hand, c.cycle, bw.b, sum(c.w * ln(greatest(coalesce(d, 0) / (na.c - nc.c), 1e-15))) AS s
    FROM cells c CROSS JOIN bw JOIN nc USING (phase, hand, video) JOIN na USING (phase, hand)
    LEFT JOIN den ON den.phase = c.phase AND den.hand = c.hand AND den.video = c.video AND den.ix = c.ix AND den.iy = c.iy AND den.b = bw.b
    GROUP BY ALL),
  res AS (SELECT phase, hand, h AS bandwidth_sw, count(*) AS n, avg(s) AS m, stddev_samp(s) AS sd FROM sc JOIN bw USING (b) GROUP BY ALL)"""


_LOVO = _lovo(_PTS)
_MASS = f"""WITH {_PTS}, {_kernels("(0, CAST(0.04 AS DOUBLE))")},
  g AS (SELECT phase, hand, ix, iy, sum(a) AS a FROM a GROUP BY ALL),
  xp AS (SELECT phase, hand, t.j AS ix, iy, sum(a * exp(-0.5 * ((t.j - ix) / s) ** 2) / z) AS a FROM g, kz, dim, range(0, 600) t(j)
      WHERE t.j < nx AND abs(t.j - ix) <= r GROUP BY ALL),
  yp AS (SELECT phase, hand, ix, t.j AS iy, sum(a * exp(-0.5 * ((t.j - iy) / s) ** 2) / z) AS a FROM xp, kz, dim, range(0, 600) t(j)
      WHERE t.j < ny AND abs(t.j - iy) <= r GROUP BY ALL),
  mass AS (SELECT phase, hand, ix, iy, a / sum(a) OVER (PARTITION BY phase, hand) AS mass FROM yp)"""

# The plan: the scores of eligible cycles select the bandwidth, at which both sets are smoothed on one grid.
_PLAN = _lovo(f"""{_POINTS}, per AS (SELECT cycle, phase, sum(n) AS kept, coalesce(sum(n) FILTER (hand = 'left'), 0) AS l,
      coalesce(sum(n) FILTER (hand = 'right'), 0) AS r FROM raw GROUP BY 1, 2),
  ok AS (SELECT cycle, phase FROM per WHERE l >= 2 AND r >= 2 AND l / kept >= 0.4 AND r / kept >= 0.4),
  cnt AS (SELECT raw.* FROM raw JOIN ok USING (cycle, phase)), {_CELLS}""") + """,
  agg AS (SELECT bandwidth_sw, avg(m) AS s FROM res GROUP BY 1), sel AS (SELECT arg_max(bandwidth_sw, s) AS h FROM agg),
  k1 AS (SELECT kz.b, s, r, z, sel.h FROM kz JOIN bw USING (b) JOIN sel ON sel.h = bw.h),
  both2 AS (SELECT 'primary_completeness_screened' AS analysis_set, * FROM cnt UNION ALL BY NAME SELECT 'all_nonempty' AS analysis_set, * FROM raw),
  cells2 AS (SELECT *, n / sum(n) OVER (PARTITION BY analysis_set, phase, hand, cycle) AS w FROM both2),
  tot2 AS (SELECT analysis_set, phase, hand, cycle, sum(w * mx.m * my.m) AS t FROM cells2, k1 JOIN mx ON mx.b = k1.b JOIN my ON my.b = k1.b
      WHERE mx.i = ix AND my.i = iy GROUP BY ALL),
  g2 AS (SELECT analysis_set, phase, hand, ix, iy, sum(w / t) AS a FROM cells2 JOIN tot2 USING (analysis_set, phase, hand, cycle) GROUP BY ALL),
  xp AS (SELECT analysis_set, phase, hand, t.j AS ix, iy, sum(a * exp(-0.5 * ((t.j - ix) / s) ** 2) / z) AS a FROM g2, k1, dim, range(0, 600) t(j)
      WHERE t.j < nx AND abs(t.j - ix) <= r GROUP BY ALL),
  yp AS (SELECT analysis_set, phase, hand, ix, t.j AS iy, sum(a * exp(-0.5 * ((t.j - iy) / s) ** 2) / z) AS a FROM xp, k1, dim, range(0, 600) t(j)
      WHERE t.j < ny AND abs(t.j - iy) <= r GROUP BY ALL),
  mass AS (SELECT analysis_set, phase, hand, ix, iy, x0 + (ix - 20 + 0.5) * 0.025 AS x, y0 + (iy - 20 + 0.5) * 0.025 AS y,
      a / sum(a) OVER (PARTITION BY analysis_set, phase, hand) AS mass FROM yp, dim),
  cum AS (SELECT *, sum(mass) OVER (PARTITION BY analysis_set, phase, hand ORDER BY mass DESC, ix, iy ROWS UNBOUNDED PRECEDING) AS c FROM mass),
  th AS (SELECT analysis_set, phase, hand, cv AS coverage, max(mass) AS th FROM cum, (VALUES (CAST(0.5 AS DOUBLE)), (CAST(0.9 AS DOUBLE))) t(cv)
      WHERE c >= cv GROUP BY ALL)"""

QUERIES = {
    "spatial_regions": spatial_regions,
    "spatial_grid": spatial_grid,
    "hist_2d_unit_mass": hist_2d_unit_mass,
    "lovo_scores": lovo_scores,
    "bandwidth_rank": bandwidth_rank,
    "hdr_summary": hdr_summary,
    "density_grid": density_grid,
    "eligibility_filter": eligibility_filter,
    "paired_rule": paired_rule,
}

ORACLES = {
    "spatial_regions": _PLAN + """, obs AS (SELECT analysis_set, phase, hand, count(DISTINCT cycle) AS contributing_cycles, CAST(sum(n) AS BIGINT) AS valid_wrist_observations
        FROM both2 GROUP BY ALL),
        reg AS (SELECT analysis_set, phase, hand, coverage, count(*) * 0.025::DOUBLE * 0.025::DOUBLE AS area, sum(mass) AS got, sum(mass * x) / sum(mass) AS cx,
          sum(mass * y) / sum(mass) AS cy, max(th) AS th FROM mass JOIN th USING (analysis_set, phase, hand) WHERE mass >= th GROUP BY ALL)
        SELECT analysis_set, phase, hand, coverage, contributing_cycles, valid_wrist_observations, round(area, 6) AS area_sw2, round(got, 6) AS achieved_probability_mass,
          round(cx, 6) AS x_centroid_sw, round(cy, 6) AS y_centroid_sw, round(sqrt(cx * cx + cy * cy), 6) AS centroid_distance_from_needle_sw,
          round(th, 9) AS threshold, sel.h AS isotropic_bandwidth_sw
        FROM reg JOIN obs USING (analysis_set, phase, hand), sel""",
    "spatial_grid": _PLAN + """ SELECT phase, hand, round(x, 6) AS x, round(y, 6) AS y, round(mass, 9) AS mass,
          bool_or(mass >= th AND coverage < 0.7) AS inside_50_percent_hdr, bool_or(mass >= th AND coverage > 0.7) AS inside_90_percent_hdr
        FROM mass JOIN th USING (analysis_set, phase, hand)
        WHERE analysis_set = 'primary_completeness_screened' AND round(mass, 9) >= 0.000001 GROUP BY ALL""",
    "hist_2d_unit_mass": f"WITH {_PTS} SELECT phase, hand, cycle, ix, iy, round(w, 9) AS w FROM cells",
    "lovo_scores": _LOVO + " SELECT phase, hand, bandwidth_sw, n AS contributing_cycles, round(m, 5) AS mean_score, round(sd, 5) AS sd_score FROM res",
    "bandwidth_rank": _LOVO + """, agg AS (SELECT bandwidth_sw, avg(m) AS s FROM res GROUP BY 1)
        SELECT bandwidth_sw, round(s, 5) AS equal_group_mean_loo_log_score, rank() OVER (ORDER BY s DESC) AS score_rank,
        bandwidth_sw = (SELECT arg_max(bandwidth_sw, s) FROM agg) AS selected_shared_bandwidth FROM agg""",
    "paired_rule": _LOVO + """, agg AS (SELECT bandwidth_sw, avg(m) AS s FROM res GROUP BY 1), best AS (SELECT arg_max(bandwidth_sw, s) AS b FROM agg),
        ref AS (SELECT phase, hand, m AS t FROM res, best WHERE bandwidth_sw = b),
        per AS (SELECT bandwidth_sw, avg(t - m) AS loss, stddev_samp(t - m) / sqrt(count(*)) AS se FROM res JOIN ref USING (phase, hand) GROUP BY 1)
        SELECT bandwidth_sw, round(loss, 5) AS loss, round(se, 5) AS se, loss <= se AS eligible,
          bandwidth_sw = (SELECT max(bandwidth_sw) FROM per WHERE loss <= se) AS selected FROM per""",
    "hdr_summary": _MASS + """, cum AS (SELECT *, sum(mass) OVER (PARTITION BY phase, hand ORDER BY mass DESC, ix, iy ROWS UNBOUNDED PRECEDING) AS c FROM mass),
        th AS (SELECT phase, hand, cv AS coverage, max(mass) AS th FROM cum, (VALUES (CAST(0.5 AS DOUBLE)), (CAST(0.9 AS DOUBLE))) t(cv) WHERE c >= cv GROUP BY ALL)
        SELECT phase, hand, coverage, round(count(*) * 0.025::DOUBLE * 0.025::DOUBLE, 6) AS area_sw2, round(sum(mass), 6) AS achieved_probability_mass,
        round(sum(mass * (x0 + (ix - 20 + 0.5) * 0.025)) / sum(mass), 6) AS x_centroid_sw,
        round(sum(mass * (y0 + (iy - 20 + 0.5) * 0.025)) / sum(mass), 6) AS y_centroid_sw
        FROM mass JOIN th USING (phase, hand), dim WHERE mass >= th GROUP BY phase, hand, coverage""",
    "density_grid": _MASS + """ SELECT phase, hand, max(nx * ny) AS cells, round(sum(mass), 6) AS total, round(max(mass), 9) AS peak,
        round(sum(mass * mass), 9) AS roughness FROM mass, dim GROUP BY phase, hand""",
    "eligibility_filter": f"""WITH {_PTS}, per AS (SELECT cycle, phase, count(*) AS kept, count(*) FILTER (hand = 'left') AS l,
        count(*) FILTER (hand = 'right') AS r FROM pts GROUP BY 1, 2),
        ok AS (SELECT cycle, phase FROM per WHERE l >= 2 AND r >= 2 AND l / kept >= 0.4 AND r / kept >= 0.4)
        SELECT phase, hand, count(DISTINCT cycle) AS cycles, count(*) AS observations FROM pts JOIN ok USING (cycle, phase) GROUP BY 1, 2""",
}
