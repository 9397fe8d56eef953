"""Candidate detection and characteristics against a direct NumPy evaluation."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from test_series import np_chain

from strideframe.constants import NEEDLE_ANALYSIS_PX, NEEDLE_SCREEN_PX
from strideframe.plans import propulsion as P

W, H, FPS = 3840.0, 2160.0, 20.0


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(8)
    parts = []
    for v in (1, 2):
        n = 240
        t = np.arange(n)
        saw = np.abs((t % 30) - 12) / 15.0
        pdf = pd.DataFrame({"video_id": v, "frame": t})
        for h, x0 in (("left", 0.45), ("right", 0.55)):
            pdf[f"{h}_shoulder_x"] = x0 + rng.normal(0, 0.001, n)
            pdf[f"{h}_shoulder_y"] = 0.30 + rng.normal(0, 0.001, n)
            pdf[f"{h}_wrist_x"] = x0 - 0.03 * (1 - saw) + rng.normal(0, 0.0004, n)
            pdf[f"{h}_wrist_y"] = 0.42 + 0.04 * (1 - saw) + rng.normal(0, 0.0004, n)
            pdf.loc[rng.random(n) < 0.05, f"{h}_wrist_x"] = np.nan
            pdf.loc[rng.random(n) < 0.03, f"{h}_shoulder_y"] = np.nan
        parts.append(pdf)
    intervals = pd.DataFrame([(1, 1, "P2", 5, 110, FPS), (1, 2, "P2", 110, 230, FPS), (2, 1, "P2", 0, 240, FPS), (2, 1, "P1", 0, 9, FPS)],
                             columns=["Video ID", "Work cycle ID", "Phase", "Start frame", "End frame (exclusive)", "FPS"])
    return pd.concat(parts, ignore_index=True), intervals


def runs_of(mask):
    e = np.flatnonzero(np.diff(np.r_[0, np.asarray(mask, int), 0]))
    return [(a, b - 1) for a, b in zip(e[::2], e[1::2])]


def direct(pdf, start, end):
    seg = pdf[(pdf.frame >= start) & (pdf.frame < end)].reset_index(drop=True)
    dx, dy = (seg.left_shoulder_x - seg.right_shoulder_x) * W, (seg.left_shoulder_y - seg.right_shoulder_y) * H
    width = np.nanmedian(np.hypot(dx, dy))
    mid = [np.nanmedian((seg[f"left_shoulder_{a}"] + seg[f"right_shoulder_{a}"]) / 2 * s) for a, s in (("x", W), ("y", H))]
    axis = np.array(NEEDLE_SCREEN_PX) - mid
    axis /= np.linalg.norm(axis)
    pos, vel = {}, {}
    for h in ("left", "right"):
        p = (seg[f"{h}_wrist_x"] * W * axis[0] + seg[f"{h}_wrist_y"] * H * axis[1]) / width
        pos[h], vel[h] = np_chain(p.interpolate(limit=3, limit_area="inside").to_numpy(), FPS)
    sync = (vel["left"] > 0.01) & (vel["right"] > 0.01)
    for a, b in runs_of(~sync):
        if a > 0 and b < len(sync) - 1 and b - a + 1 <= 3:
            sync[a : b + 1] = True
    raw = [(a, b) for a, b in runs_of(sync) if b - a + 1 >= 6 and min(pos[h][b] - pos[h][a] for h in pos) >= 0.005]
    merged = []
    for i, (a, b) in enumerate(raw, 1):
        if merged and a - merged[-1][1] - 1 <= 10 and all(
            np.isfinite(pos[h][merged[-1][1] : a + 1]).all() and (pos[h][merged[-1][1] : a + 1] - pos[h][merged[-1][1]]).min() >= -0.01 for h in pos
        ):
            merged[-1] = (merged[-1][0], b, [*merged[-1][2], i])
        else:
            merged.append((a, b, [i]))
    out = [(int(seg.frame[a]), int(seg.frame[b]), ";".join(map(str, r)), pos["left"][b] - pos["left"][a]) for a, b, r in merged]
    return out, len(raw), width


@pytest.fixture(scope="module")
def detected(spark, data):
    pdf, intervals = data
    noisy = pd.concat([pdf, pdf[pdf.frame == 50]])
    trajectory = spark.createDataFrame(noisy).replace(float("nan"), None)
    clean = P.clean_trajectory(trajectory)
    candidates, cycles = P.detect(clean, P.standard_intervals(spark.createDataFrame(intervals)))
    return clean, candidates, cycles


def test_detection_matches_direct_evaluation(data, detected):
    pdf, _ = data
    _, candidates, cycles = detected
    got, per = candidates.toPandas(), cycles.toPandas().set_index("cycle_key")
    total = 0
    for key, (v, a, b) in {"1:1": (1, 5, 110), "1:2": (1, 110, 230), "2:1": (2, 0, 240)}.items():
        want, raw, width = direct(pdf[pdf.video_id == v], a, b)
        mine = got[got.cycle_key == key].sort_values("candidate_index")
        assert mine[["start_frame", "end_frame", "source_raw_candidate_indices"]].values.tolist() == [list(w[:3]) for w in want]
        np.testing.assert_allclose(mine.left_net_forward_displacement_sw, [w[3] for w in want], atol=1e-9)
        assert per.loc[key, "raw_candidate_count"] == raw and per.loc[key, "automatic_kinematic_candidate_count"] == len(want)
        assert per.loc[key, "median_shoulder_width_px"] == pytest.approx(width)
        total += len(want)
    assert total == len(got) > 5


def test_directions_and_metrics(spark, data, detected):
    pdf, _ = data
    clean, candidates, cycles = detected
    out = P.summarize(candidates, cycles, clean)
    assert out["ledger"].where("agrees").count() == 3 == out["ledger"].count()
    short = P.reconcile_counts(cycles, candidates.where("candidate_index > 1 OR cycle_key <> '1:2'"), out["directions"], out["metrics"])
    assert [r.cycle_key for r in short.where("NOT agrees").collect()] == ["1:2"]
    with pytest.raises(ValueError, match="counts differ in cycles .*1:2"):
        P.check_ledger(short)
    lost = P.reconcile_counts(cycles.union(cycles.where("cycle_key = '2:1'")), candidates, out["directions"].where("cycle_key <> '1:1'"), out["metrics"])
    assert sorted(r.cycle_key for r in lost.where("NOT agrees").collect()) == ["1:1", "2:1"]
    axes = out["directions"].toPandas().set_index("cycle_key")
    metrics = out["metrics"].toPandas()
    cand = candidates.toPandas()
    for v, keys in {1: {"1:1": (5, 110), "1:2": (110, 230)}, 2: {"2:1": (0, 240)}}.items():
        p = pdf[pdf.video_id == v].reset_index(drop=True)
        sh = p.dropna(subset=list(P.SHOULDERS))
        mids = []
        for a, b in keys.values():
            s = sh[(sh.frame >= a) & (sh.frame < b)]
            mids.append([np.median((s.left_shoulder_x + s.right_shoulder_x) / 2 * W), np.median(-(s.left_shoulder_y + s.right_shoulder_y) / 2 * H)])
        ref = np.array(NEEDLE_ANALYSIS_PX) - np.median(mids, axis=0)
        ref /= np.linalg.norm(ref)
        smooth = p[list(P.WRISTS)].rolling(3, center=True, min_periods=2).median()
        pts = np.column_stack([(smooth.left_wrist_x + smooth.right_wrist_x) / 2 * W, -(smooth.left_wrist_y + smooth.right_wrist_y) / 2 * H])
        metric = {}
        for c in P.WRISTS:
            metric[c] = np_chain(p[c].interpolate(limit=3, limit_area="inside").to_numpy())[0]
        left = np.column_stack([metric["left_wrist_x"] * W, -metric["left_wrist_y"] * H])
        right = np.column_stack([metric["right_wrist_x"] * W, -metric["right_wrist_y"] * H])
        for key in keys:
            mine = cand[cand.cycle_key == key]
            inside = np.zeros(len(p), bool)
            for r in mine.itertuples():
                inside |= (p.frame >= r.start_frame) & (p.frame <= r.end_frame)
            q = pts[inside & np.isfinite(pts).all(axis=1)]
            values, vectors = np.linalg.eigh(np.cov(q.T))
            axis = vectors[:, -1] * np.sign(vectors[:, -1] @ ref)
            angle = np.degrees(np.arctan2(ref[0] * axis[1] - ref[1] * axis[0], ref @ axis))
            assert axes.loc[key, "angle_deg"] == pytest.approx(angle, abs=1e-6)
            assert axes.loc[key, "pc1_variance_fraction"] == pytest.approx(values[-1] / values.sum())
            assert axes.loc[key, "paired_candidate_frames"] == len(q)
            width = cycles.where(F.col("cycle_key") == key).first().median_shoulder_width_px
            for r in mine.itertuples():
                m = (p.frame >= r.start_frame) & (p.frame <= r.end_frame) & np.isfinite(left).all(axis=1) & np.isfinite(right).all(axis=1)
                mid, f = (left[m] + right[m]) / 2, p.frame[m].to_numpy()
                got = metrics[(metrics.cycle_key == key) & (metrics.candidate_index == r.candidate_index)].iloc[0]
                side = np.array([-axis[1], axis[0]])
                assert got.signed_axial_displacement_sw == pytest.approx((mid @ axis)[-1] / width - (mid @ axis)[0] / width)
                assert got.lateral_excursion_sw == pytest.approx(np.ptp(mid @ side) / width)
                assert got.transverse_wrist_separation_sw == pytest.approx(np.median(np.abs((right[m] - left[m]) @ side)) / width)
                path = np.linalg.norm(np.diff(mid, axis=0), axis=1)[np.diff(f) == 1].sum() / width
                assert got.wrist_midpoint_path_length_sw == pytest.approx(path) and got.valid_bilateral_samples == m.sum()
    assert out["gaps"].count() == len(cand) - 3 == out["summary"]["cohort"]["within_cycle_adjacent_candidate_pairs"]
    d = out["summary"]["propulsion_direction"]
    assert d["interval_low_deg"] <= d["signed_circular_mean_deg"] <= d["interval_high_deg"]


@pytest.mark.parametrize("videos", [7, 60])
def test_bootstrap_of_hashed_draws(spark, videos):
    import hashlib

    rng = np.random.default_rng(1)
    pdf = pd.DataFrame({"video_id": np.repeat(np.arange(videos), 3), "angle_deg": rng.normal(10, 25, 3 * videos)})
    df = spark.createDataFrame(pdf)
    got = P.cluster_bootstrap(df, replicates=300, seed=5).first()
    s = np.sin(np.radians(pdf.angle_deg)).groupby(pdf.video_id).sum().to_numpy()
    c = np.cos(np.radians(pdf.angle_deg)).groupby(pdf.video_id).sum().to_numpy()
    point = np.degrees(np.arctan2(s.sum(), c.sum()))
    m = P.DRAW_MODULUS
    keys = [int(hashlib.md5(str(v).encode()).hexdigest()[:7], 16) for v in range(videos)]

    def weight(key, r):
        x = (key * 48271 + r * 69621 + 5) % m
        x = (x * x + key) % m
        x = (x * x + r) % m
        return sum(x >= t for t in P.poisson_thresholds())

    weights = np.array([[weight(k, r) for k in keys] for r in range(300)])
    assert abs(weights.mean() - 1) < 0.1 and abs(weights.var() - 1) < 0.15
    some = weights.sum(1) > 0
    means = np.degrees(np.arctan2(weights[some] @ s, weights[some] @ c))
    low, high = np.quantile((means - point + 180) % 360 - 180, [0.025, 0.975]) + point
    assert (got.interval_low_deg, got.interval_high_deg) == (pytest.approx(low), pytest.approx(high))
