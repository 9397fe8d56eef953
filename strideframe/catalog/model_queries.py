"""Feature blocks, windows and models on derived trajectories and the embeddings."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..constants import VIDEO_K_RANGE, VIDEO_N_INIT
from ..operators import features as X
from ..operators import lattice
from ..operators import modeling as ML
from ..plans import video
from ..session import materialize
from .interval_queries import greedy_sql
from .trajectories import TRAJECTORY_SQL, fps_table, trajectory
from .views import SERIES_SQL, manual_frames, series, table


def sliding_windows(spark, sf):
    t = trajectory(spark, sf)
    n = X.with_fps(t.groupBy("video_id").agg(F.count("*").alias("n")), fps_table(spark, sf), "video_id")
    length, step = lattice.segment_sizes(F.col("fps"))
    return lattice.window_starts(n, ["video_id"], "n", length, step)


def window_features(spark, sf):
    """Speed, amplitude and angle features of each segment."""
    out = X.segment_features(trajectory(spark, sf), fps_table(spark, sf))
    return out.select("Video", "Segment_ID", "Start_Frame", "End_Frame", *[F.round(c, 5).alias(c) for c in (
        "left_wrist_avg_speed_x", "left_wrist_std_speed_x", "left_elbow_amplitude_y", "left_shoulder_angle_mean", "left_shoulder_angle_change_std")])


def dft_features(spark, sf):
    """Spectral features of whole series per video."""
    out = X.video_features(trajectory(spark, sf), fps_table(spark, sf))
    return out.select("Video", F.col("FPS").alias("FPS"), *[F.round(c, 5).alias(c) for c in (
        "left_elbow_total_energy_x", "left_elbow_dominant_freq_x", "left_elbow_centroid_x", "right_shoulder_total_energy_y", "right_shoulder_centroid_y")])


def video_features(spark, sf):
    out = X.video_features(trajectory(spark, sf), fps_table(spark, sf))
    return out.select("Video", *[F.round(c, 5).alias(c) for c in (
        "right_elbow_avg_speed_x", "right_elbow_std_speed_x", "right_elbow_amplitude_x", "left_shoulder_angle_mean", "left_shoulder_angle_std",
        "left_shoulder_angle_change_mean", "right_shoulder_angle_change_std")])


def detector_features(spark, sf):
    """A few of the 293 detector features on the sliding lattice."""
    out = X.detector_features(trajectory(spark, sf), fps_table(spark, sf))
    return out.select("video_id", "center_frame", F.col("window_n_rows").cast("bigint").alias("window_n_rows"), *[F.round(c, 6).alias(c) for c in (
        "coord_missing_ratio", "row_any_missing_ratio", "left_elbow_x_median", "left_elbow_x_std", "left_elbow_x_q25", "shoulder_y_mean",
        "elbow_distance_max", "right_elbow_speed_mean", "delta_shoulder_y_last_minus_first")])


def negatives_theta_anti(spark, sf):
    """Lattice centres further than eight seconds (at 2 fps) from every signup frame."""
    manual = manual_frames(spark, sf).withColumnRenamed("entity", "video_id")
    videos = trajectory(spark, sf).groupBy("video_id").agg((F.max("frame") + 1).alias("n")).join(manual.select("video_id").distinct(), "video_id", "left_semi")
    half = F.lit(2).cast("bigint")
    return lattice.negative_candidates(videos, manual, ["video_id"], fps=F.lit(0.5), n=F.col("n"), half=half, block=F.expr("center_frame div 65536"))


def positive_centres(spark, sf):
    manual = manual_frames(spark, sf).withColumnRenamed("entity", "video_id")
    n = trajectory(spark, sf).groupBy("video_id").agg((F.max("frame") + 1).alias("n"))
    return lattice.positive_centres(manual.join(n, "video_id"), ["video_id"], "frame", F.lit(5.0), F.col("n"), F.lit(5))


def boundary_cycles(spark, sf):
    """Boundaries and cycles from a probability-like curve over the series (value / 90, one row every 2 s, 0.5 fps)."""
    p = series(spark, sf).select(
        F.col("entity").alias("video_id"), F.col("pos").alias("center_frame"), (F.col("pos") / 0.5).alias("center_time_sec"),
        F.least(F.lit(1.0), F.col("v") / 90).alias("probability"), F.lit(0.5).alias("fps"),
    )
    return video.work_cycles(materialize(video.find_boundaries(video.smooth_probabilities(p))))


def _embedded(spark, sf):
    e = table(spark, sf, "embeddings")
    names = [f"e{i}" for i in range(64)]
    return e.select("vec_id", "label", *[F.col("embedding")[i].cast("double").alias(n) for i, n in enumerate(names)]), names


def standardize(spark, sf):
    df, names = _embedded(spark, sf)
    out = ML.standardize(df, names)
    return out.select("vec_id", *[F.round(c, 5).alias(c) for c in names])


def silhouette_exact(spark, sf):
    e = table(spark, sf, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("x"))
    return ML.silhouette_values(e, "vec_id", "x", "label").select("vec_id", F.col("label").cast("bigint").alias("label"), F.round("silhouette", 6).alias("silhouette"))


def pca_variance(spark, sf):
    df, names = _embedded(spark, sf)
    vec = ML.assemble(ML.standardize(df, names), names)
    return ML.variance_table(vec, ML.explained_variance(vec)[1])


def pca_moments(spark, sf):
    """Power sums of the component variances, which the covariance matrix gives as traces of its powers."""
    df, names = _embedded(spark, sf)
    vec = materialize(ML.assemble(ML.standardize(df, names), names))
    ratios = ML.variance_table(vec, ML.explained_variance(vec)[1])
    share = F.col("Explained_Variance_Ratio")
    return ratios.agg(
        F.count("*").alias("components"), F.round(F.sum(share), 9).alias("total"), F.round(F.sum(share * share), 9).alias("squares"),
        F.round(F.sum(share * share * share), 9).alias("cubes"),
    )


def display_scores(spark, sf):
    """The two display scores of every row: centred, uncorrelated, with the variances that the model names."""
    df, names = _embedded(spark, sf)
    vec = materialize(ML.assemble(ML.standardize(df, names), names))
    model, ratios = ML.explained_variance(vec)
    scores = ML.display_scores(vec, model, "vec_id")
    whole = F.lit(float(len(names))) * F.count("*") / (F.count("*") - 1)
    return scores.agg(
        F.count("*").alias("n_rows"), (F.abs(F.avg("PC1")) + F.abs(F.avg("PC2")) < 1e-9).alias("centred"), (F.abs(F.corr("PC1", "PC2")) < 1e-9).alias("uncorrelated"),
        (F.abs(F.var_samp("PC1") / whole - ratios[0]) + F.abs(F.var_samp("PC2") / whole - ratios[1]) < 1e-9).alias("variances_match"),
    )


def kmeans_consistency(spark, sf):
    """Best models of the video plan's K, measured anew: nearest centres, means, costs."""
    df, names = _embedded(spark, sf)
    return ML.sweep_consistency(ML.assemble(ML.standardize(df, names), names), "vec_id", VIDEO_K_RANGE, n_init=VIDEO_N_INIT)


def cv_folds(spark, sf):
    """Rows that the grouped cross-validation predicts, by group and label; groups by id, a small forest."""
    df, names = _embedded(spark, sf)
    data = df.withColumn("group", F.pmod("vec_id", F.lit(4))).withColumn("label", (F.col("label") >= 5).cast("int"))
    held = ML.leave_one_group_out(data, "group", names, trees=5)
    return held.groupBy("group", F.col("label").cast("int").alias("label")).agg(
        F.countDistinct("vec_id").alias("n_rows"), F.bool_and(F.col("probability").between(0, 1)).alias("probabilities"),
        F.bool_and((F.col("probability") >= 0.5) == (F.col("prediction") == 1)).alias("cut"),
    )


def kmeans_sweep(spark, sf):
    df, names = _embedded(spark, sf)
    _, summary = ML.kmeans_sweep(ML.assemble(ML.standardize(df, names), names), "vec_id", "Raw64", VIDEO_K_RANGE, n_init=VIDEO_N_INIT)
    return summary


def rf_cv(spark, sf):
    """Held-out predictions of the upper label half, groups by hash."""
    df, names = _embedded(spark, sf)
    data = df.withColumn("group", F.pmod(F.xxhash64("vec_id"), F.lit(3))).withColumn("label", (F.col("label") >= 5).cast("int"))
    return ML.confusion(ML.leave_one_group_out(data, "group", names))


_WIN = """wl AS (SELECT *, greatest(2, CAST(round_even(fps, 0) AS BIGINT)) AS wlen, greatest(1, CAST(round_even(fps / 2, 0) AS BIGINT)) AS wstep FROM rate),
  win AS (SELECT video_id, fps, w.w AS wi, w.w * wstep AS ws, w.w * wstep + wlen - 1 AS we FROM wl, range(0, 4000) w(w) WHERE w.w * wstep + wlen <= len)"""


def _filled(column, name, key="video_id, wi", source="wr"):
    """Both-sided interpolation of a column inside each window, missing series as zero."""
    return f"""{name}_n AS (SELECT *, max(CASE WHEN {column} IS NOT NULL THEN frame END) OVER (PARTITION BY {key} ORDER BY frame ROWS UNBOUNDED PRECEDING) AS pp,
      min(CASE WHEN {column} IS NOT NULL THEN frame END) OVER (PARTITION BY {key} ORDER BY frame ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS np FROM {source}),
  {name} AS (SELECT n.video_id, n.wi, n.fps, n.frame, coalesce(CASE WHEN n.{column} IS NOT NULL THEN n.{column} WHEN a.{column} IS NOT NULL AND b.{column} IS NOT NULL
      THEN a.{column} + (b.{column} - a.{column}) / (n.np - n.pp) * (n.frame - n.pp) ELSE coalesce(a.{column}, b.{column}) END, 0) AS x
    FROM {name}_n n LEFT JOIN traj a ON a.video_id = n.video_id AND a.frame = n.pp LEFT JOIN traj b ON b.video_id = n.video_id AND b.frame = n.np)"""


def _angle(p1, c, p3):
    ax, ay, bx, by = f"({p1}_x - {c}_x)", f"({p1}_y - {c}_y)", f"({p3}_x - {c}_x)", f"({p3}_y - {c}_y)"
    return f"degrees(acos(greatest(-1.0, least(1.0, ({ax}*{bx} + {ay}*{by}) / (sqrt({ax}*{ax} + {ay}*{ay}) * sqrt({bx}*{bx} + {by}*{by}))))))"


_SPECTRUM = """f0 AS (SELECT traj.video_id, frame, {col} AS x, fps, len FROM traj JOIN rate USING (video_id)),
  {name}d AS (SELECT video_id, k.k AS k, max(fps) AS fps, max(len) AS n, sqrt(sum(x * cos(2 * pi() * (k.k * frame % len) / len)) ** 2 + sum(x * sin(2 * pi() * (k.k * frame % len) / len)) ** 2) AS a
    FROM f0, range(0, 2000) k(k) WHERE k.k < len // 2 GROUP BY 1, 2),
  {name} AS (SELECT video_id, sum(a) AS e, arg_max(k, a) FILTER (k > 0) * max(fps) / max(n) AS dom, sum(a * k * fps / n) / sum(a) AS cen FROM {name}d GROUP BY 1)"""

QUERIES = {
    "sliding_windows": sliding_windows, "window_features": window_features, "dft_features": dft_features, "video_features": video_features,
    "detector_features": detector_features, "negatives_theta_anti": negatives_theta_anti, "positive_centres": positive_centres,
    "boundary_cycles": boundary_cycles, "standardize": standardize, "silhouette_exact": silhouette_exact, "pca_variance": pca_variance,
    "kmeans_sweep": kmeans_sweep, "rf_cv": rf_cv, "pca_moments": pca_moments, "display_scores": display_scores,
    "kmeans_consistency": kmeans_consistency, "cv_folds": cv_folds,
}

_DETECTOR = f"""WITH {TRAJECTORY_SQL}, dc AS (SELECT video_id, fps, CAST(round_even(fps, 0) AS BIGINT) AS h, greatest(3, CAST(round_even(fps, 0) AS BIGINT)) AS reach,
      greatest(1, CAST(round_even(fps / 2, 0) AS BIGINT)) AS st, len FROM rate),
  ce AS (SELECT *, h + i.i * st AS c FROM dc, range(0, 4000) i(i) WHERE h + i.i * st < len - h),
  wr AS (SELECT traj.*, ce.c AS wi, ce.fps, row_number() OVER w AS rn, count(*) OVER (PARTITION BY traj.video_id, ce.c) AS n,
      sqrt((right_elbow_x - lag(right_elbow_x) OVER w) ** 2 + (right_elbow_y - lag(right_elbow_y) OVER w) ** 2) * ce.fps AS sp
    FROM traj JOIN ce ON ce.video_id = traj.video_id AND frame BETWEEN c - reach AND c + reach WINDOW w AS (PARTITION BY traj.video_id, ce.c ORDER BY frame)),
  th AS (SELECT video_id, wi, median(y) FILTER (rn > n - kk) - median(y) FILTER (rn <= kk) AS d FROM (
      SELECT video_id, wi, rn, n, greatest(2, n // 3) AS kk, left_shoulder_y AS y FROM wr UNION ALL
      SELECT video_id, wi, rn, n, greatest(2, n // 3), right_shoulder_y FROM wr) GROUP BY 1, 2)
  SELECT video_id, wi AS center_frame, max(n) AS window_n_rows, round(avg((4 * CAST(left_wrist_x IS NULL AS INT)) / 12), 6) AS coord_missing_ratio,
    round(avg(CAST(left_wrist_x IS NULL AS INT)), 6) AS row_any_missing_ratio, round(median(left_elbow_x), 6) AS left_elbow_x_median, round(stddev_pop(left_elbow_x), 6) AS left_elbow_x_std,
    round(quantile_cont(left_elbow_x, 0.25), 6) AS left_elbow_x_q25, round((avg(left_shoulder_y) + avg(right_shoulder_y)) / 2, 6) AS shoulder_y_mean,
    round(max(sqrt((left_elbow_x - right_elbow_x) ** 2 + (left_elbow_y - right_elbow_y) ** 2)), 6) AS elbow_distance_max, round(avg(sp), 6) AS right_elbow_speed_mean,
    round(max(th.d), 6) AS delta_shoulder_y_last_minus_first FROM wr JOIN th USING (video_id, wi) GROUP BY 1, 2"""

_CLOCK = "CAST(floor({0} / 60) AS BIGINT) || 'm ' || CAST(floor({0} - floor({0} / 60) * 60) AS BIGINT) || 's'"

ORACLES = {
    "pca_moments": """WITH d AS (SELECT vec_id, unnest(range(0, 64)) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings),
        z AS (SELECT vec_id, i, (x - avg(x) OVER (PARTITION BY i)) / stddev_pop(x) OVER (PARTITION BY i) AS z FROM d),
        c AS (SELECT a.i, b.i AS j, sum(a.z * b.z) / (count(*) - 1) AS c FROM z a JOIN z b ON a.vec_id = b.vec_id GROUP BY 1, 2),
        t AS (SELECT sum(c) FILTER (i = j) AS t FROM c), s2 AS (SELECT a.i, b.j, sum(a.c * b.c) AS c FROM c a JOIN c b ON a.j = b.i GROUP BY 1, 2)
        SELECT CAST(64 AS BIGINT) AS components, round(1.0::DOUBLE, 9) AS total, round((SELECT sum(c) FILTER (i = j) FROM s2) / (t * t), 9) AS squares,
          round((SELECT sum(s2.c * c.c) FROM s2 JOIN c ON c.i = s2.j AND c.j = s2.i) / (t * t * t), 9) AS cubes FROM t""",
    "display_scores": "SELECT count(*) AS n_rows, true AS centred, true AS uncorrelated, true AS variances_match FROM embeddings",
    "kmeans_consistency": """SELECT CAST(k AS INTEGER) AS K, count(*) AS n_rows, CAST(k AS BIGINT) AS n_clusters, true AS nearest, true AS means, true AS cost_matches
        FROM embeddings, range(2, 14) t(k) GROUP BY k""",
    "cv_folds": """SELECT vec_id % 4 AS "group", CAST(label >= 5 AS INTEGER) AS label, count(*) AS n_rows, true AS probabilities, true AS cut FROM embeddings GROUP BY 1, 2""",
    "boundary_cycles": f"""WITH RECURSIVE {SERIES_SQL},
        sm AS (SELECT entity AS video_id, pos AS frame, median(least(1.0::DOUBLE, v / 90)) OVER (PARTITION BY entity ORDER BY pos ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING) AS p FROM series),
        th AS (SELECT video_id, max(frame) AS last, greatest(0.55::DOUBLE, quantile_cont(p, 0.9)) AS t FROM sm GROUP BY 1),
        nb AS (SELECT *, lag(p) OVER w AS a, lead(p) OVER w AS b FROM sm WINDOW w AS (PARTITION BY video_id ORDER BY frame)),
        pk AS (SELECT video_id, frame, p FROM nb JOIN th USING (video_id) WHERE p >= a AND p >= b AND frame >= 2 AND frame <= last - 2 AND p >= t),
        top AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY p DESC, frame) AS n FROM sm),
        cand AS (SELECT * FROM pk UNION ALL SELECT video_id, frame, p FROM top WHERE n = 1 AND p >= 0.55 AND video_id NOT IN (SELECT video_id FROM pk)),
        {greedy_sql("cand", "video_id", "frame", "p", "15")},
        chosen AS (SELECT video_id, unnest(arg_max(kept, r)) AS frame FROM picked GROUP BY 1),
        bd AS (SELECT c.video_id, c.frame, c.frame * 2.0::DOUBLE AS s, round_even(cand.p, 4) AS p FROM chosen c JOIN cand ON cand.video_id = c.video_id AND cand.frame = c.frame),
        nx AS (SELECT *, lead(frame) OVER w AS f2, lead(s) OVER w AS s2, lead(p) OVER w AS p2 FROM bd WINDOW w AS (PARTITION BY video_id ORDER BY frame))
        SELECT video_id, row_number() OVER (PARTITION BY video_id ORDER BY frame) AS "Work_Cycle_ID", frame AS "Start_Frame", f2 AS "End_Frame", s AS "Start_sec", s2 AS "End_sec",
          s2 - s AS "Duration_sec", {_CLOCK.format("s")} AS "Start_Time", {_CLOCK.format("s2")} AS "End_Time", {_CLOCK.format("(s2 - s)")} AS "Duration",
          p AS "Start_Boundary_Probability", p2 AS "End_Boundary_Probability", 0.5::DOUBLE AS "FPS" FROM nx WHERE s2 - s >= 30""",
    "sliding_windows": f'WITH {TRAJECTORY_SQL}, {_WIN} SELECT video_id, wi AS "window", ws AS "start", we AS "end" FROM win',
    "window_features": f"""WITH {TRAJECTORY_SQL}, {_WIN}, wr0 AS (SELECT traj.*, win.wi, win.fps, win.ws, win.we FROM traj JOIN win ON win.video_id = traj.video_id AND frame BETWEEN ws AND we),
        wr AS (SELECT *, min(CASE WHEN left_wrist_x IS NOT NULL THEN frame END) OVER (PARTITION BY video_id, wi) AS any_ok FROM wr0), {_filled("left_wrist_x", "lw")},
        d AS (SELECT *, (x - lag(x) OVER (PARTITION BY video_id, wi ORDER BY frame)) * fps AS vel FROM lw),
        s AS (SELECT video_id, wi, avg(abs(vel)) AS m, stddev_pop(vel) AS sd FROM d GROUP BY 1, 2),
        g0 AS (SELECT video_id, wi, fps, frame, {_angle("left_hip", "left_shoulder", "left_elbow")} AS g FROM wr),
        g1 AS (SELECT *, (g - lag(g) OVER (PARTITION BY video_id, wi ORDER BY frame)) * fps AS gd FROM g0),
        g2 AS (SELECT video_id, wi, avg(g) AS gm, stddev_pop(gd) AS gs FROM g1 GROUP BY 1, 2),
        am AS (SELECT video_id, wi, max(left_elbow_y) - min(left_elbow_y) AS amp FROM wr GROUP BY 1, 2)
        SELECT win.video_id AS "Video", 'segment_' || lpad(CAST(win.wi + 1 AS VARCHAR), 4, '0') AS "Segment_ID", ws AS "Start_Frame", we AS "End_Frame",
        round(m, 5) AS left_wrist_avg_speed_x, round(sd, 5) AS left_wrist_std_speed_x, round(amp, 5) AS left_elbow_amplitude_y, round(gm, 5) AS left_shoulder_angle_mean,
        round(gs, 5) AS left_shoulder_angle_change_std FROM win JOIN s USING (video_id, wi) JOIN g2 USING (video_id, wi) JOIN am USING (video_id, wi)""",
    "dft_features": f"""WITH {TRAJECTORY_SQL}, {_SPECTRUM.format(col="left_elbow_x", name="p")}, {_SPECTRUM.format(col="right_shoulder_y", name="q").replace("f0", "f1")}
        SELECT video_id AS "Video", fps AS "FPS", round(p.e, 5) AS left_elbow_total_energy_x, round(p.dom, 5) AS left_elbow_dominant_freq_x, round(p.cen, 5) AS left_elbow_centroid_x,
        round(q.e, 5) AS right_shoulder_total_energy_y, round(q.cen, 5) AS right_shoulder_centroid_y FROM rate JOIN p USING (video_id) JOIN q USING (video_id)""",
    "video_features": f"""WITH {TRAJECTORY_SQL}, a AS (SELECT traj.video_id, frame, fps, right_elbow_x AS x, {_angle("left_elbow", "left_shoulder", "right_shoulder")} AS g,
          {_angle("right_elbow", "right_shoulder", "left_shoulder")} AS h FROM traj JOIN rate USING (video_id)),
        d AS (SELECT *, (x - lag(x) OVER w) * fps AS dx, (g - lag(g) OVER w) * fps AS dg, (h - lag(h) OVER w) * fps AS dh FROM a WINDOW w AS (PARTITION BY video_id ORDER BY frame))
        SELECT video_id AS "Video", round(avg(abs(dx)), 5) AS right_elbow_avg_speed_x, round(stddev_pop(dx), 5) AS right_elbow_std_speed_x, round(max(x) - min(x), 5) AS right_elbow_amplitude_x,
        round(avg(g), 5) AS left_shoulder_angle_mean, round(stddev_pop(g), 5) AS left_shoulder_angle_std, round(avg(abs(dg)), 5) AS left_shoulder_angle_change_mean,
        round(stddev_pop(dh), 5) AS right_shoulder_angle_change_std FROM d GROUP BY 1""",
    "detector_features": _DETECTOR,
    "negatives_theta_anti": f"""WITH {TRAJECTORY_SQL}, man AS (SELECT entity AS video_id, pos AS frame FROM series WHERE cat = 'signup'),
        la AS (SELECT video_id, 2 + i.i * 2 AS c FROM rate, range(0, 4000) i(i) WHERE 2 + i.i * 2 < len - 2 AND video_id IN (SELECT video_id FROM man))
        SELECT la.video_id, la.c AS center_frame FROM la JOIN man ON man.video_id = la.video_id GROUP BY 1, 2 HAVING min(abs(la.c - man.frame)) > 4""",
    "positive_centres": f"""WITH {TRAJECTORY_SQL}, man AS (SELECT entity AS video_id, pos AS frame FROM series WHERE cat = 'signup')
        SELECT DISTINCT video_id, CAST(round_even(frame + o * 5, 0) AS BIGINT) AS center_frame FROM man JOIN rate USING (video_id), (VALUES (-0.5::DOUBLE), (0::DOUBLE), (0.5::DOUBLE)) t(o)
        WHERE round_even(frame + o * 5, 0) >= 5 AND round_even(frame + o * 5, 0) <= len - 6""",
    "standardize": "WITH d AS (SELECT vec_id, " + ", ".join(f"CAST(embedding[{i + 1}] AS DOUBLE) AS x{i}" for i in range(64)) + " FROM embeddings) SELECT vec_id, "
        + ", ".join(f"round((x{i} - avg(x{i}) OVER ()) / stddev_pop(x{i}) OVER (), 5) AS e{i}" for i in range(64)) + " FROM d",
    "silhouette_exact": """WITH p AS (SELECT a.vec_id, a.label, b.label AS other, a.vec_id = b.vec_id AS me,
          sqrt(list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda x: (x[1]::DOUBLE - x[2]::DOUBLE) ** 2))) AS d FROM embeddings a, embeddings b),
        m AS (SELECT vec_id, label, other, sum(d) AS s, count(*) AS n FROM p GROUP BY 1, 2, 3),
        ab AS (SELECT vec_id, label, max(CASE WHEN other = label THEN s / nullif(n - 1, 0) END) AS a, min(CASE WHEN other <> label THEN s / n END) AS b FROM m GROUP BY 1, 2)
        SELECT vec_id, CAST(label AS BIGINT) AS label, round(coalesce((b - a) / greatest(a, b), 0), 6) AS silhouette FROM ab""",
}
