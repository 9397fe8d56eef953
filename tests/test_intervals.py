"""Interval operators against brute force, including the long-chain path of the greedy selection."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from strideframe.operators import intervals as iv
from strideframe.operators import lattice


def greedy(frames, scores, gap):
    kept = []
    for i in np.lexsort((frames, -scores)):
        if all(abs(frames[i] - k) >= gap for k in kept):
            kept.append(frames[i])
    return sorted(kept)


@pytest.mark.parametrize("block", [10, 70, 65_536])
def test_suppress_neighbours(spark, block):
    rng = np.random.default_rng(11)
    parts = []
    for k in range(3):
        f = np.sort(rng.choice(400, 60, replace=False))
        parts.append(pd.DataFrame({"k": k, "f": f, "s": np.round(rng.random(60), 1), "gap": 9}))
    pdf = pd.concat(parts)
    out = iv.suppress_neighbours(spark.createDataFrame(pdf), ["k"], "f", "s", "gap", block_frames=block).toPandas()
    for k, g in pdf.groupby("k"):
        assert sorted(out[out.k == k].f) == greedy(g.f.to_numpy(), g.s.to_numpy(), 9)


def test_rounds_of_a_long_ramp_follow_its_blocks(spark, monkeypatch):
    """200 000 rising candidates, each nearer than the gap to the next: one round per block crossed."""
    calls = []
    monkeypatch.setattr(iv, "materialize", lambda df: calls.append(1) or __import__("strideframe.session", fromlist=["x"]).materialize(df))
    ramp = spark.range(200_000).select(F.lit(1).alias("k"), (F.col("id") * 3).alias("f"), F.col("id").cast("double").alias("s"), F.lit(5).alias("gap"))
    out = iv.suppress_neighbours(ramp, ["k"], "f", "s", "gap", block_frames=3 * 65_536)
    got = out.agg(F.count("*"), F.min("f"), F.max("f")).first()
    assert tuple(got) == (100_000, 3, 599_997) and len(calls) <= 9  # one write per round, two per later one


def test_interval_join_inclusivity(spark):
    points = spark.createDataFrame([("a", float(t)) for t in range(0, 12)], "k string, t double")
    spans = spark.createDataFrame([("a", 2.0, 5.0), ("a", 5.0, 9.0), ("b", 0.0, 99.0), ("a", 9.0, 3.0)], "k string, s double, e double")
    half = iv.interval_join(points, spans, ["k"], "t", "s", "e").collect()
    assert sorted((r.t, r.s) for r in half) == [(2.0, 2.0), (3.0, 2.0), (4.0, 2.0)] + [(float(t), 5.0) for t in (5, 6, 7, 8)]
    closed = iv.interval_join(points, spans, ["k"], "t", "s", "e", closed=True).collect()
    assert sorted((r.t, r.s) for r in closed if r.t == 5.0) == [(5.0, 2.0), (5.0, 5.0)]


@pytest.mark.parametrize("closed", [False, True])
def test_interval_join_mixes_lengths_of_all_sizes(spark, closed):
    """Empty, short and day-long intervals, negative and large places, nulls: the brute-force pairs, and few copies."""
    rng = np.random.default_rng(8)
    start = np.concatenate([rng.uniform(-50, 50, 60), rng.uniform(0, 1e9, 40), [0.0, 7.0, 7.0]])
    length = np.concatenate([rng.choice([0.0, 1e-6, 0.5, 3.0, 80.0], 60), 10 ** rng.uniform(-3, 9, 40), [86_400e6, 0.0, 1e-9]])
    spans = pd.DataFrame({"k": rng.integers(0, 2, len(start)), "s": start, "e": start + length})
    at = np.concatenate([rng.uniform(-60, 60, 150), rng.uniform(0, 2e9, 150), start[:40], (start + length)[:40], [7.0]])
    points = pd.DataFrame({"k": rng.integers(0, 2, len(at)), "t": at, "i": range(len(at))})
    left = spark.createDataFrame(points).unionByName(spark.createDataFrame([(0, None, -1)], "k long, t double, i long"))
    right = spark.createDataFrame(spans).unionByName(spark.createDataFrame([(0, 1.0, None)], "k long, s double, e double"))
    got = sorted((r.i, r.s, r.e) for r in iv.interval_join(left, right, ["k"], "t", "s", "e", closed=closed).collect())
    pairs = points.merge(spans, on="k")
    inside = (pairs.t >= pairs.s) & ((pairs.t <= pairs.e) if closed else (pairs.t < pairs.e))
    assert got == sorted(pairs[inside][["i", "s", "e"]].itertuples(index=False, name=None)) and got
    level = iv._level(F.col("s"), F.col("e"))
    copies = right.where("e >= s").select((iv._bucket(F.col("e"), level) - iv._bucket(F.col("s"), level) + 1).alias("n"))
    assert copies.agg(F.max("n")).first()[0] <= 18


def test_touching_attempts_merge_and_reversed_rows_drop(spark):
    rows = [("a", 1, 0, 5), ("a", 2, 5, 8), ("a", 3, 9, 10), ("a", 4, 20, 15), ("a", 5, 9, 30), ("a", 6, 31, 31)]
    df = spark.createDataFrame(rows, "k string, i int, s int, e int").withColumn("o", F.struct("s", "i"))
    out = iv.attempt_count(df, ["k"], "s", "e", order="o", block=F.expr("s div 4")).collect()
    assert [(r.k, r.attempts) for r in out] == [("a", 3)]


def test_gaps_never_bridge_an_unflagged_row(spark):
    rows = [("a", 0, 1, True), ("a", 2, 3, False), ("a", 5, 6, True), ("a", 8, 9, True)]
    df = spark.createDataFrame(rows, "k string, s int, e int, f boolean")
    out = iv.adjacent_gaps(df, ["k"], "s", "e", "f", order="s", block=F.expr("s div 3")).collect()
    assert [(r.s, r.gap) for r in out] == [(8, 2)]


def test_event_on_action_boundary_links_to_the_first_action(spark):
    actions = spark.createDataFrame([("a", 1, 0, 5, True), ("a", 2, 5, 9, False)], "k string, i int, s int, e int, b boolean")
    events = spark.createDataFrame([("a", 1, 5), ("a", 2, 9), ("a", 3, 10)], "k string, id int, t int")
    out = iv.first_match(events, ["id"], actions, ["k"], at="t", start="s", end="e", order=["s", "i"], carried=["i", "b"])
    assert {r.id: (r.linked, r.i) for r in out.collect()} == {1: (True, 1), 2: (True, 2), 3: (False, None)}


def test_nearest_prefers_the_earlier_frame_on_ties(spark):
    left = spark.createDataFrame([("a", 10), ("a", 0), ("b", 1)], "k string, f int")
    right = spark.createDataFrame([("a", 7), ("a", 13), ("a", 4)], "k string, f int")
    out = iv.nearest(left, right, ["k"], "f", block=F.expr("f div 5")).collect()
    assert {(r.k, r.f): r.nearest for r in out} == {("a", 10): 7, ("a", 0): 4, ("b", 1): None}


def test_window_lattices(spark):
    rows = [("v", p, 11, 12.5) for p in range(11)]
    df = spark.createDataFrame(rows, "v string, pos bigint, n bigint, fps double")
    length, step = lattice.segment_sizes(F.col("fps"))
    assert df.select(length, step).first()[:] == (12, 6)
    five, two = F.lit(5).cast("bigint"), F.lit(2).cast("bigint")
    wins = lattice.window_starts(df.select("v", "n").distinct(), ["v"], "n", five, two).collect()
    assert sorted((r.window, r.start, r.end) for r in wins) == [(0, 0, 4), (1, 2, 6), (2, 4, 8), (3, 6, 10)]
    got = lattice.frames_to_windows(df, "pos", F.col("n"), five, two).groupBy("window").agg(F.sort_array(F.collect_list("pos")).alias("p"))
    assert {r.window: r.p for r in got.collect()} == {i: list(range(2 * i, 2 * i + 5)) for i in range(4)}
    half, reach, hop = (F.lit(x).cast("bigint") for x in (2, 3, 3))
    cents = lattice.frames_to_centres(df, "pos", F.col("n"), half, reach, hop).groupBy("center_frame").agg(F.sort_array(F.collect_list("pos")).alias("p"))
    want = {c: [p for p in range(11) if abs(p - c) <= 3] for c in range(2, 11 - 2, 3)}
    assert {r.center_frame: r.p for r in cents.collect()} == want


def test_training_centres(spark):
    fps, n = 20.0, 2000
    manual = spark.createDataFrame([("v", 100), ("v", 700)], "v string, frame bigint")
    half = F.lit(20).cast("bigint")
    pos = lattice.positive_centres(manual, ["v"], "frame", F.lit(fps), F.lit(n), half)
    assert sorted(r.center_frame for r in pos.collect()) == [90, 100, 110, 690, 700, 710]
    videos = spark.createDataFrame([("v",)], "v string")
    neg = lattice.negative_candidates(videos, manual, ["v"], fps=F.lit(fps), n=F.lit(n).cast("bigint"), half=half, block=F.expr("center_frame div 64"))
    want = [c for c in range(20, n - 20, 60) if min(abs(c - 100), abs(c - 700)) > 160]
    assert sorted(r.center_frame for r in neg.collect()) == want
    chosen = [r.center_frame for r in lattice.sample_negatives(neg, pos, ["v"]).collect()]
    assert len(chosen) == min(24, len(want)) and set(chosen) <= set(want)


def test_resample_positions(spark):
    df = spark.createDataFrame([("a", 11, 5), ("b", 4, 7), ("c", 3, 3), ("d", 9, 1)], "v string, n bigint, m bigint")
    out = lattice.resample_positions(df, ["v"], "n", "m").collect()
    got = {v: [r.source for r in sorted(out, key=lambda r: r.frame) if r.v == v] for v in "abcd"}
    assert got["a"] == np.linspace(0, 10, 5).round().astype(int).tolist()
    assert got["b"] == np.linspace(0, 3, 7).round().astype(int).tolist()
    assert got["c"] == [0, 1, 2] and got["d"] == [0]


def test_merge_at_the_exact_gap(spark):
    v = [0, 1, 2, 3, 2.995, 2.995, 3, 4, 5, 1, 2, 3]
    pos = spark.createDataFrame([("a", i, float(x)) for i, x in enumerate(v)], "k string, pos bigint, v double")
    runs = spark.createDataFrame([("a", 0, 3), ("a", 6, 8), ("a", 9, 11)], "k string, start bigint, end bigint")
    args = dict(tolerance=0.01, block=F.expr("start div 4"))
    out = iv.merge_without_return(runs, pos, ["k"], ["v"], max_gap=F.lit(2), **args).collect()
    got = sorted((r.candidate_index, r.start, r.end, r.source_raw_candidate_indices) for r in out)
    assert got == [(1, 0, 8, "1;2"), (2, 9, 11, "3")]
    out = iv.merge_without_return(runs, pos, ["k"], ["v"], max_gap=F.lit(1), **args).collect()
    assert len(out) == 3
