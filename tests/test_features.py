"""Feature blocks against per-window pandas evaluation."""

import os

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from strideframe.functions import windowmath as M
from strideframe.operators import features as X
from strideframe.operators import spectra
from strideframe.sources.schemas import COORDINATES, HIP_COORDINATES


def trajectory(lengths=(47, 23), seed=2, missing=0.1):
    rng = np.random.default_rng(seed)
    parts = []
    for v, n in enumerate(lengths, 1):
        pdf = pd.DataFrame(np.round(rng.random((n, 16)), 4), columns=[*COORDINATES, *HIP_COORDINATES])
        pdf[rng.random(pdf.shape) < missing] = np.nan
        pdf.insert(0, "frame", np.arange(n))
        pdf.insert(0, "video_id", str(v))
        parts.append(pdf)
    parts[0]["left_elbow_x"] = np.nan
    return pd.concat(parts, ignore_index=True)


def six(x, fps, zero):
    s = pd.Series(x).interpolate(limit_direction="both")
    x = (s.fillna(0.0) if zero else s).to_numpy()
    n = len(x)
    v = np.diff(x) * fps
    y, f = np.abs(np.fft.fft(x))[: n // 2], np.fft.fftfreq(n, 1 / fps)[: n // 2]
    e = y.sum()
    dom = f[np.argmax(y[1:]) + 1] if len(y) > 1 and np.any(y[1:] > 0) else 0
    return [np.abs(v).mean(), v.std(), x.max() - x.min(), e, dom, (f * y).sum() / e if e > 0 else 0]


def angle(p1, c, p3):
    a, b = p1 - c, p3 - c
    na, nb = np.linalg.norm(a), np.linalg.norm(b)
    if not (na >= 1e-6 and nb >= 1e-6):
        return np.nan
    return np.degrees(np.arccos(np.clip(a @ b / (na * nb), -1, 1)))


def expected(pdf, fps, zero):
    out = []
    for j in X.MOTION_JOINTS:
        for a in "xy":
            out += six(pdf[f"{j}_{a}"], fps, zero)
    pt = lambda j: pdf[[f"{j}_x", f"{j}_y"]].to_numpy()
    for side, other in (("left", "right"), ("right", "left")):
        s, e, w = pt(f"{side}_shoulder"), pt(f"{side}_elbow"), pt(f"{side}_wrist")
        first = [pt(f"{side}_hip"), s, e] if zero else [e, s, pt(f"{other}_shoulder")]
        for tri in (first, [s, e, w]):
            g = pd.Series([angle(*p) for p in zip(*tri)]).interpolate(limit_direction="both")
            g = (g.fillna(0.0) if zero else g).to_numpy()
            d = np.diff(g) * fps
            out += [g.mean(), g.std(), np.abs(d).mean(), d.std()]
    return out


@pytest.fixture(scope="module")
def frames(spark):
    pdf = trajectory()
    df = spark.createDataFrame(pdf).replace(float("nan"), None)
    fps = spark.createDataFrame([("2", 12.5)], "video_id string, fps double")
    return pdf, df, fps


def test_video_features(frames):
    pdf, df, fps = frames
    got = X.video_features(df, fps).toPandas().set_index("Video")
    assert len(X.feature_names()) == 88 and list(got.columns) == ["FPS", *X.feature_names()]
    for v, rate in (("1", 20.0), ("2", 12.5)):
        np.testing.assert_allclose(got.loc[v, X.feature_names()].to_numpy(float), expected(pdf[pdf.video_id == v], rate, False), atol=1e-9)


def test_segment_features_round_half_even(frames):
    pdf, df, fps = frames
    got = X.segment_features(df, fps).toPandas()
    for v, rate, length, step in (("1", 20.0, 20, 10), ("2", 12.5, 12, 6)):
        p = pdf[pdf.video_id == v].reset_index(drop=True)
        mine = got[got.Video == v].sort_values("Start_Frame")
        starts = list(range(0, len(p) - length + 1, step))
        assert mine.Start_Frame.tolist() == starts and mine.Segment_ID.iloc[0] == "segment_0001"
        for (_, row), s in zip(mine.iterrows(), starts):
            np.testing.assert_allclose(row[X.feature_names()].to_numpy(float), expected(p.iloc[s : s + length], rate, True), atol=1e-9)


def test_detector_features(frames):
    pdf, df, fps = frames
    holes = pdf[~((pdf.video_id == "1") & pdf.frame.between(30, 41))]
    sdf = df.join(df.sparkSession.createDataFrame(holes[["video_id", "frame"]]), ["video_id", "frame"])
    got = X.detector_features(sdf, fps).toPandas()
    names = X.detector_names()
    assert len(names) == len(set(names)) == 293
    p = holes[holes.video_id == "1"]
    mine = got[got.video_id == "1"].sort_values("center_frame")
    assert mine.center_frame.tolist() == list(range(20, 47 - 20, 10))
    full = p[(p.frame >= 0) & (p.frame <= 40)].reset_index(drop=True)
    row = mine.iloc[0]
    filled = full[list(COORDINATES)].interpolate(limit_direction="both")
    assert row.window_n_rows == len(full) == 30
    assert row.coord_missing_ratio == pytest.approx(full[list(COORDINATES)].isna().mean().mean())
    assert row.row_any_missing_ratio == pytest.approx(full[list(COORDINATES)].isna().any(axis=1).mean())
    assert row.left_wrist_x_q25 == pytest.approx(np.percentile(filled.left_wrist_x, 25))
    assert np.isnan(row.left_elbow_x_mean) and np.isnan(row.left_elbow_speed_mean)
    speed = np.hypot(np.diff(filled.right_wrist_x), np.diff(filled.right_wrist_y)) * 20
    assert row.right_wrist_speed_std == pytest.approx(speed.std())
    dist = np.hypot(filled.left_wrist_x - filled.right_wrist_x, filled.left_wrist_y - filled.right_wrist_y)
    assert row.delta_wrist_distance_last_minus_first == pytest.approx(np.median(dist[-10:]) - np.median(dist[:10]))
    ys = filled[[f"{j}_y" for j in X.MOTION_JOINTS]].to_numpy()
    assert row.all_y_median == pytest.approx(np.median(ys)) and row.y_all_range_max == pytest.approx(np.ptp(ys, axis=0).max())
    centres = df.sparkSession.createDataFrame([("1", 35), ("1", 90)], "video_id string, center_frame bigint")
    chosen = X.detector_features(sdf, fps, centres).toPandas().set_index("center_frame")
    assert chosen.loc[35, "window_n_rows"] == len(p[(p.frame >= 15) & (p.frame <= 55)]) and chosen.loc[90, "window_n_rows"] == 0


@pytest.mark.parametrize(("block", "rows"), [(16, 1), (7, 30), (3, 10_000)])
def test_windows_across_blocks_and_batches(frames, monkeypatch, block, rows):
    """Blocks shorter than a window, batches that end anywhere: the same features."""
    from strideframe.operators import sliding

    _, df, fps = frames
    holes = df.where("not (video_id = '1' and frame between 5 and 44)")
    keys = {"segment_features": ["Video", "Start_Frame"], "detector_features": ["video_id", "center_frame"]}
    want = {n: getattr(X, n)(holes, fps).toPandas().sort_values(k).reset_index(drop=True) for n, k in keys.items()}
    real = sliding.in_blocks, sliding.complete
    monkeypatch.setattr(X, "BLOCK", block)
    monkeypatch.setattr(X, "in_blocks", lambda *a: real[0](*a, block=block))
    monkeypatch.setattr(X, "complete", lambda b, k: real[1](b, k, rows))
    for name, key in keys.items():
        got = getattr(X, name)(holes, fps).toPandas().sort_values(key).reset_index(drop=True)
        pd.testing.assert_frame_equal(got, want[name])


def test_short_windows():
    out = M.axis_features(np.ones((2, 1)), np.array([20.0, 20.0]))
    assert (out == 0).all()
    five = X.detector_stack(np.random.default_rng(0).random((1, 12, 5)), np.array([20.0]))[0]
    assert np.isnan(five[-4:]).all() and np.isfinite(five[:-4]).all()


def test_long_series_transform_matches_the_short_one(spark, monkeypatch):
    rng = np.random.default_rng(4)
    parts = [pd.DataFrame({"v": v, "pos": np.arange(n), "x": rng.normal(size=n)}) for v, n in ((1, 97), (2, 128), (3, 150))]
    parts.append(pd.DataFrame({"v": 4, "pos": np.arange(70), "x": np.nan}))
    df = spark.createDataFrame(pd.concat(parts)).replace(float("nan"), None)
    sizes = df.groupBy("v").agg(F.count("*").alias("n"), F.lit(20.0).alias("fps"))
    short = spectra.series_spectrum(df, ["v"], sizes, "v").toPandas().set_index("v").sort_index()
    monkeypatch.setattr(spectra, "ARRAY_ROWS", 90)
    mixed = spectra.series_spectrum(df, ["v"], sizes, "v").toPandas().set_index("v").sort_index()
    pd.testing.assert_frame_equal(short, mixed, atol=1e-9, check_dtype=False)
    long = spectra.series_spectrum(df, ["v"], sizes, "v", limit=16).toPandas().set_index("v").sort_index()
    pd.testing.assert_frame_equal(short, long, atol=1e-9, check_dtype=False)
    assert short.loc[4].isna().tolist() == [True, False, False]


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="driver tables absent")
@pytest.mark.parametrize("name", ["video_features_all", "window_features_all", "detector_features_all"])
def test_every_feature_column_has_an_oracle(spark, name):
    from oracle_check import compare, connect

    import __spark_entry__ as entry

    sf, query = "/root/testdata/sf0.001", entry.queries()[name]
    names = X.detector_names() if name.startswith("detector") else X.feature_names()
    assert set(names) <= set(query(spark, sf).columns) and len(names) == (293 if name.startswith("detector") else 88)
    assert compare(spark, connect(sf), sf, query, entry.oracle_sql()[name]) == []
