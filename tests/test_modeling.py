"""Clustering helpers, silhouettes, classifier and boundary plan."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from strideframe.operators import clustering as C
from strideframe.operators import features as X
from strideframe.operators import modeling as ML
from strideframe.plans import video


def brute_silhouette(x, labels):
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    out = []
    for i, c in enumerate(labels):
        own = labels == c
        if own.sum() == 1:
            out.append(0.0)
            continue
        a = d[i, own].sum() / (own.sum() - 1)
        b = min(d[i, labels == o].mean() for o in set(labels) if o != c)
        out.append((b - a) / max(a, b))
    return np.array(out)


@pytest.fixture(scope="module")
def blobs(spark):
    rng = np.random.default_rng(9)
    x = np.concatenate([rng.normal(m, 0.3, (20, 4)) for m in (0, 2, 5)] + [np.full((1, 4), 9.0)])
    labels = np.repeat([0, 1, 2, 3], [20, 20, 20, 1])
    pdf = pd.DataFrame(x, columns=list("abcd")).assign(id=range(61), label=labels)
    return pdf, spark.createDataFrame(pdf).withColumn("x", F.array(*"abcd")), x, labels


@pytest.mark.parametrize("block", [10_000, 13])
def test_silhouette_is_exact_with_any_block(blobs, block, monkeypatch):
    _, df, x, labels = blobs
    monkeypatch.setattr(C, "BLOCK_POINTS", block)
    got = ML.silhouette_values(df, "id", "x", "label").toPandas().sort_values("id")
    np.testing.assert_allclose(got.silhouette, brute_silhouette(x, labels), atol=1e-10)
    assert ML.silhouette_score(df.where("label = 0"), "id", "x", "label") is None


def test_filling_scaling_and_components(spark, blobs):
    pdf, df, x, _ = blobs
    holes = spark.createDataFrame([(1.0, None, None), (None, 4.0, None), (5.0, 8.0, None), (6.0, None, None)], "a double, b double, c double")
    assert ML.column_medians(holes, ["a", "b", "c"]) == {"a": 5.0, "b": 6.0, "c": 0.0}
    assert ML.fill_with_mean(holes, ["a", "b"]).agg(F.sum("a")).first()[0] == 16.0
    scaled = ML.standardize(df, list("abcd"))
    z = (x - x.mean(0)) / x.std(0)
    np.testing.assert_allclose(scaled.orderBy("id").select(*"abcd").toPandas().to_numpy(), z)
    model, ratios = ML.explained_variance(ML.assemble(scaled, list("abcd")))
    values = np.linalg.eigvalsh(np.cov(z.T))[::-1]
    np.testing.assert_allclose(ratios, values / values.sum(), atol=1e-9)
    assert ML.components_reaching([0.5, 0.4, 0.1], 0.9) == 2 and ML.components_reaching([0.5, 0.25, 0.25], 0.75, strict=True) == 3
    scores = ML.project(ML.assemble(scaled, list("abcd")), model, 2).select("reduced").toPandas()
    np.testing.assert_allclose(np.var(np.stack([v.toArray() for v in scores.reduced]), axis=0, ddof=1), values[:2])


def test_kmeans_sweep_finds_the_blobs(blobs):
    _, df, _, labels = blobs
    vec = ML.assemble(df, list("abcd"))
    assigned, summary = ML.kmeans_sweep(vec, "id", "Raw", [2, 4], n_init=3)
    best = ML.top_models(summary, 1).first()
    assert best.K == 4 and sorted(map(int, best.Cluster_Sizes.split(","))) == [1, 20, 20, 20]
    got = assigned.where("K = 4").toPandas().sort_values("id").Cluster.to_numpy()
    assert len({(a, b) for a, b in zip(got, labels)}) == 4


def test_fused_lloyd_is_lloyd(blobs, monkeypatch):
    """The fused passes move every start as a plain NumPy loop does, also in several groups, and empty clusters stay put."""
    _, df, x, _ = blobs
    points = df.select(F.col("x").alias("_x"))
    starts = C.starting_fits(points, [2, 3], 3, 7)
    far = C.Fit(2, 99, np.array([[0.0] * 4, [1e6] * 4]))
    want = []
    for f in [*starts, far]:
        c = f.centres.copy()
        while True:
            d = ((x[:, None] - c[None]) ** 2).sum(-1)
            own = d.argmin(1)
            moved = np.array([x[own == i].mean(0) if (own == i).any() else c[i] for i in range(f.k)])
            if ((moved - c) ** 2).sum() <= 1e-4 * x.var(0).mean():
                break
            c = moved
        want.append((c, d.min(1).sum()))
    monkeypatch.setattr(C, "CENTRE_BYTES", 4 * 8 * 7)
    for f, (centres, cost) in zip(C.lloyd(points, [*starts, far], max_iter=300, tol=1e-4), want, strict=True):
        np.testing.assert_allclose(f.centres, centres, atol=1e-9)
        assert f.cost == pytest.approx(cost)
    assert (far.centres[1] == 1e6).all()
    limited = C.lloyd(points, C.starting_fits(points, [3], 1, 7), max_iter=0, tol=1e-4)[0]
    assert limited.settled and limited.cost >= want[3][1] - 1e-9


def test_several_labellings_share_their_distances(blobs, monkeypatch):
    _, df, x, labels = blobs
    monkeypatch.setattr(C, "BLOCK_POINTS", 20)
    two = df.withColumn("half", (F.col("label") >= 2).cast("int")).withColumn("one", F.lit(5))
    got = C.silhouettes(two, "id", "x", ["label", "half", "one"]).toPandas().sort_values("id")
    for name, own in (("label", labels), ("half", (labels >= 2).astype(int))):
        np.testing.assert_allclose(got[got.labelling == name].silhouette, brute_silhouette(x, own), atol=1e-10)
    assert (got[got.labelling == "one"].silhouette == 0).all()


def test_sweep_consistency(blobs):
    _, df, _, _ = blobs
    rows = ML.sweep_consistency(ML.assemble(df, list("abcd")), "id", [2, 4], n_init=2).collect()
    assert [(r.K, r.n_rows, r.n_clusters, r.nearest, r.means, r.cost_matches) for r in sorted(rows)] == [(k, 61, k, True, True, True) for k in (2, 4)]


def test_forest_and_report(spark, tmp_path):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(120, 3))
    pdf = pd.DataFrame(x, columns=["f1", "f2", "f3"]).assign(label=(x[:, 0] > 0).astype(int), video=np.arange(120) % 3)
    pdf.loc[::17, "f2"] = np.nan
    df = spark.createDataFrame(pdf).replace(float("nan"), None)
    cv = ML.leave_one_group_out(df, "video", ["f1", "f2", "f3"], trees=20)
    assert cv.count() == 120
    report = {r["class"]: r for r in ML.classification_report(cv).collect()}
    assert report[1].f1 > 0.85 and report[0].support + report[1].support == 120
    model = ML.forest_pipeline(df, ["f1", "f2", "f3"], trees=20)
    model.write().overwrite().save(str(tmp_path / "model"))
    from pyspark.ml import PipelineModel

    again = PipelineModel.load(str(tmp_path / "model"))
    assert ML.importances(df, again, ["f1", "f2", "f3"]).first().feature == "f1"
    assert ML.predict(again, df.drop("f3"), ["f1", "f2", "f3"]).where("probability IS NULL").count() == 0


def probabilities(spark, values, fps=20.0, video="1"):
    rows = [(video, 20 + 10 * i, (20 + 10 * i) / fps, float(v), fps) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "video_id string, center_frame bigint, center_time_sec double, probability double, fps double")


def test_boundaries_and_cycles(spark):
    rng = np.random.default_rng(12)
    p = np.round(0.3 * rng.random(600), 3)
    for c, h in ((100, 0.9), (130, 0.95), (250, 0.8), (420, 0.85), (595, 0.99)):
        p[c - 2 : c + 3] = h
    scored = video.smooth_probabilities(probabilities(spark, p))
    s = pd.Series(p).rolling(4, center=True, min_periods=1).median().to_numpy()
    np.testing.assert_allclose(scored.orderBy("center_frame").toPandas().prob_smooth, s)
    frames = 20 + 10 * np.arange(600)
    limit = max(0.55, np.quantile(s, 0.9))
    peaks = [i for i in range(1, 599) if 100 <= frames[i] <= frames[-1] - 100 and s[i] >= max(s[i - 1], s[i + 1], limit)]
    kept = []
    for i in sorted(peaks, key=lambda i: (-s[i], i)):
        if all(abs(frames[i] - frames[k]) >= 600 for k in kept):
            kept.append(i)
    found = video.find_boundaries(scored).orderBy("Boundary_ID").toPandas()
    assert found.Boundary_Frame.tolist() == sorted(int(frames[k]) for k in kept)
    cycles = video.work_cycles(spark.createDataFrame(found)).orderBy("Work_Cycle_ID").toPandas()
    assert cycles.Start_Frame.tolist() == found.Boundary_Frame.tolist()[:-1] and (cycles.Duration_sec >= 30).all()
    manual = spark.createDataFrame([("1", int(found.Boundary_Frame[0]) + 7)], "video_id string, frame bigint")
    rows, summary = video.compare_with_manual(spark.createDataFrame(found), manual)
    assert rows.first().Frame_Error == -7 and summary.first().Median_Abs_Frame_Error == 7.0


def test_lone_maximum_is_the_fallback(spark):
    p = np.full(60, 0.1)
    p[2:6] = 0.6
    found = video.find_boundaries(video.smooth_probabilities(probabilities(spark, p))).collect()
    assert len(found) == 1 and found[0].Boundary_Probability == 0.6
    assert video.find_boundaries(video.smooth_probabilities(probabilities(spark, np.full(60, 0.2)))).count() == 0


def test_training_set(spark):
    rng = np.random.default_rng(6)
    n = 1500
    pdf = pd.DataFrame(rng.random((n, 12)), columns=list(X.COORDINATES))
    pdf.insert(0, "frame", np.arange(n))
    pdf.insert(0, "video_id", "1")
    manual = spark.createDataFrame([("1", 700)], "video_id string, frame bigint")
    out = video.training_set(spark.createDataFrame(pdf), spark.createDataFrame([("1", 20.0)], "video_id string, fps double"), manual).toPandas()
    assert sorted(out[out.label == 1].center_frame) == [690, 700, 710]
    assert (out.label == 0).sum() == 12 and (abs(out[out.label == 0].center_frame - 700) > 160).all()


def test_fps_fallback_chain(spark):
    df = spark.createDataFrame([("a", 100, 4.0, 30.0), ("b", 100, None, 30.0), ("c", 100, 0.0, None)], "v string, frames int, duration_sec double, container_fps double")
    got = {r.v: (r.fps, r.duration_sec, r.fps_source.split()[0]) for r in video.resolved_fps(df).collect()}
    assert got["a"][:2] == (25.0, 4.0) and got["b"][0] == 30.0 and got["c"][:2] == (20.0, 5.0)


def test_queries_run_the_plans_in_full(spark, monkeypatch):
    """kmeans_sweep and rf_cv call their operators with the plans' K, starts and trees."""
    from strideframe import constants
    from strideframe.catalog import model_queries as Q

    seen = {}
    monkeypatch.setattr(Q, "_embedded", lambda spark, sf: (spark.createDataFrame([(i, i % 10, i * 1.0, i % 3 * 1.0) for i in range(30)], "vec_id long, label int, e0 double, e1 double"), ["e0", "e1"]))
    with monkeypatch.context() as m:
        m.setattr(ML, "kmeans_sweep", lambda df, key, setting, ks, *, n_init: (None, (list(ks), n_init)))
        assert Q.kmeans_sweep(spark, "") == (list(constants.VIDEO_K_RANGE), constants.VIDEO_N_INIT) == (list(range(2, 14)), 50)
    pipeline = ML.forest_pipeline
    monkeypatch.setattr(ML, "forest_pipeline", lambda df, f, *, trees, seed: seen.setdefault("trees", []).append(trees) or pipeline(df, f, trees=3, seed=seed))
    assert sum(r.n for r in Q.rf_cv(spark, "").collect()) == 30 and seen["trees"] == [500] * 3


def test_fused_passes_send_one_set_of_sums_per_core(blobs, spark, monkeypatch):
    """What an iteration shuffles is tasks times centres, so a session of many shuffle partitions doesn't slow it down."""
    _, df, _, _ = blobs
    seen, lloyd = [], C.lloyd
    monkeypatch.setattr(C, "lloyd", lambda points, fits, **more: seen.append(points.rdd.getNumPartitions()) or lloyd(points, fits, **more))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    try:
        fits = C.best_fits(df, "x", [2, 4], n_init=2)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert seen == [spark.sparkContext.defaultParallelism] and set(fits) == {2, 4}


def test_silhouette_of_close_rows_far_from_the_origin(spark, monkeypatch):
    """Products of long vectors would lose the small distances; equal rows are exactly 0 apart. No loop over columns is left."""
    rng = np.random.default_rng(21)
    x = 1e4 + np.concatenate([rng.normal(0, 1e-3, (30, 5)), rng.normal(50, 1, (30, 5))])
    x[10:20] = x[0]
    labels = np.repeat([0, 1, 2], [10, 20, 30])
    df = spark.createDataFrame([(i, int(c), v.tolist()) for i, (c, v) in enumerate(zip(labels, x))], "id long, label int, x array<double>")
    monkeypatch.setattr(C, "BLOCK_POINTS", 25)
    got = ML.silhouette_values(df, "id", "x", "label").toPandas().sort_values("id")
    np.testing.assert_allclose(got.silhouette, brute_silhouette(x, labels), atol=1e-9)
    a, b = rng.normal(size=(256, 64)), rng.normal(size=(1024, 64))
    norms = lambda v: (v * v).sum(axis=1)
    assert (C._distances(a, a, norms(a), norms(a)).diagonal() == 0).all()
    np.testing.assert_allclose(C._distances(a, b, norms(a), norms(b)), np.sqrt(((a[:, None] - b[None]) ** 2).sum(-1)), rtol=1e-10)


@pytest.mark.parametrize("kind", ["plain", "far", "ties", "outlier", "tiny"])
def test_single_precision_search_is_exact(kind):
    """What single precision leaves open is measured in double: the members are those of the double search, equal centres go to the first."""
    rng = np.random.default_rng(5)
    sizes = [2, 2, 3, 5, 5, 5]
    x, centres = rng.normal(size=(700, 6)), rng.normal(size=(sum(sizes), 6))
    if kind == "far":
        x, centres = x + 3e4, centres + 3e4
    elif kind == "ties":
        x[::7], centres[1], centres[6] = (centres[7] + centres[8]) / 2, centres[0], centres[5]
    elif kind == "outlier":
        x[3], x[4], centres[9] = 1e30, 1e200, -1e25
    elif kind == "tiny":
        x, centres = x * 1e-22, centres * 1e-22
    at = 0
    with np.errstate(over="ignore", invalid="ignore"):
        apart = (centres * centres).sum(1) - 2 * x @ centres.T
        member = np.concatenate([m for _, m in C._members(x, centres, sizes)])
    for k in sizes:
        own = member[at : at + k]
        assert (own.sum(axis=0) == 1).all()
        place = own.argmax(axis=0)
        best = apart[:, at : at + k]
        chosen = best[np.arange(700), place]
        assert np.allclose(chosen, best.min(axis=1), rtol=1e-13, atol=1e-13 * np.abs(best[np.isfinite(best)]).max() if kind != "outlier" else 1e-9)
        at += k
    if kind == "ties":
        assert not member[1].any() and not member[6].any()


def test_a_pass_sends_slices_and_drops_its_centres(blobs, spark, monkeypatch):
    """An iteration collects one value per slice of centres, not a row per centre, and its broadcast goes with it."""
    from pyspark.core.broadcast import Broadcast

    _, df, x, _ = blobs
    gone, seen, destroy = [], [], Broadcast.destroy
    monkeypatch.setattr(Broadcast, "destroy", lambda self, *a, **k: gone.append(1) or destroy(self, *a, **k))
    monkeypatch.setattr(C, "SLICE_CENTRES", 4)
    fits = C.starting_fits(df.select(F.col("x").alias("_x")), [2, 3], 2, 7)
    frame = type(df)
    collect, pandas = frame.collect, frame.toPandas
    monkeypatch.setattr(frame, "collect", lambda self: seen.append(collect(self)) or seen[-1])
    monkeypatch.setattr(frame, "toPandas", lambda self: seen.append(pandas(self)) or seen[-1])
    sums, sizes, costs = C._step(df.select(F.col("x").alias("_x")).repartition(3), fits, x.mean(axis=0))
    assert sum(map(len, seen)) == 3 and gone == [1]
    at = 0
    for fit, cost in zip(fits, costs, strict=True):
        d = ((x[:, None] - fit.centres[None]) ** 2).sum(-1)
        own = d.argmin(1)
        for i in range(fit.k):
            assert sizes[at + i] == (own == i).sum()
            np.testing.assert_allclose(sums[at + i], x[own == i].sum(0), atol=1e-9)
        assert cost == pytest.approx(d.min(1).sum())
        at += fit.k


def test_a_tile_without_close_rows_is_not_searched(monkeypatch):
    """One least value tells that no distance has to be taken from differences; a missing one still does."""
    rng = np.random.default_rng(8)
    a, b = rng.normal(size=(8, 3)), rng.normal(size=(16, 3))
    norms = lambda v: (v * v).sum(axis=1)
    gone = b.copy()
    gone[2, 1] = np.nan
    assert np.isnan(C._distances(a, gone, norms(a), norms(gone))[:, 2]).all()
    monkeypatch.setattr(C.np, "nonzero", lambda *_: pytest.fail("searched"))
    np.testing.assert_allclose(C._distances(a, b, norms(a), norms(b)), np.sqrt(((a[:, None] - b[None]) ** 2).sum(-1)), rtol=1e-10)
