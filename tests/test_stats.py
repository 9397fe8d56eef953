"""Exact quantiles and summary blocks against NumPy."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from strideframe.operators import selection, stats


@pytest.mark.parametrize("leaf", [1, 40, 1 << 16])
def test_exact_quantiles(spark, leaf):
    rng = np.random.default_rng(7)
    parts = [pd.DataFrame({"k": k, "x": np.round(rng.gamma(2.0, 3.0, n), d)})
             for k, (n, d) in enumerate([(1, 3), (2, 3), (3, 3), (10, 0), (500, 1), (3000, 6)])]
    parts.append(pd.DataFrame({"k": 8, "x": [4.0] * 400}))
    parts.append(pd.DataFrame({"k": 9, "x": [np.nan, 1.0, 3.0]}))
    pdf = pd.concat(parts)
    df = spark.createDataFrame(pdf).repartition(5)
    probs = {"lo": 0.025, "q1": 0.25, "med": 0.5, "p90": 0.9, "hi": 0.975, "max": 1.0}
    got = stats.exact_quantiles(df, ["k"], F.col("x"), probs, leaf=leaf).toPandas().set_index("k")
    assert len(got) == 8
    for k, g in pdf.groupby("k"):
        for name, p in probs.items():
            assert got.loc[k, name] == pytest.approx(np.nanquantile(g.x, p), abs=1e-12), (k, name)


def test_values_that_differ_in_their_last_bits(spark):
    """Neighbouring doubles, both signs, subnormals, zeros and infinities: every split down to the last bits is needed."""
    base = np.array([1.0, -1.0, 5e-324, -5e-324, 1e-310, 0.0, -0.0, np.inf, -np.inf, 1.7976931348623157e308, 2.0**-1022, 8.0, 0.1])
    near = np.concatenate([base, np.nextafter(base[:6], np.inf), np.nextafter(base[:6], -np.inf), np.full(60, 0.1), np.nextafter(np.full(60, 0.1), 1)])
    df = spark.createDataFrame(pd.DataFrame({"x": near}))
    bits = df.select("x", selection.ordered_bits(F.col("x")).alias("b")).toPandas().sort_values("b")
    assert (np.diff(bits.x.to_numpy()[np.isfinite(bits.x)]) >= 0).all()
    pairs = sorted({(x + 0.0, b) for x, b in zip(bits.x, bits.b)})
    assert len({b for _, b in pairs}) == len({x for x, _ in pairs}) == len(pairs)
    finite = df.where("abs(x) < double('infinity')")
    ordered = np.sort(near[np.isfinite(near)])
    probs = {f"p{i}": i / 8 for i in range(9)}
    row = stats.exact_quantiles(finite, [], F.col("x"), probs, leaf=3).first()
    for name, p in probs.items():
        at = p * (len(ordered) - 1)
        low, high = ordered[int(np.floor(at))], ordered[int(np.ceil(at))]
        assert row[name] == low + (high - low) * (at - np.floor(at))


def test_null_keys_are_a_group(spark):
    df = spark.createDataFrame([(None, 1.0), (None, 2.0), ("a", 5.0)], "k string, x double")
    got = {r.k: r.m for r in stats.exact_quantiles(df, ["k"], F.col("x"), {"m": 0.5}, leaf=1).collect()}
    assert got == {None: 1.5, "a": 5.0}


def test_summary_blocks(spark):
    pdf = pd.DataFrame({"k": ["a"] * 5 + ["b"], "x": [1.0, 2.0, 4.0, 8.0, -1.0, 5.0]})
    df = spark.createDataFrame(pdf)
    a = pdf[pdf.k == "a"].x
    eight = stats.eight_stats(df, ["k"], "x").toPandas().set_index("k").loc["a"]
    assert eight["std"] == pytest.approx(a.std(ddof=0)) and eight["range"] == 9.0
    summary = stats.summarize(df, ["k"], "x").toPandas().set_index("k")
    assert summary.loc["a", "cv"] == pytest.approx(a.std() / a.mean())
    assert np.isnan(summary.loc["b", "sd"]) and np.isnan(summary.loc["b", "cv"])
    whole = stats.distribution(df, [], "x").toPandas().iloc[0]
    assert whole["n"] == 6 and whole["median"] == pytest.approx(pdf.x.median())


def test_circular_summary(spark):
    degrees = np.array([170.0, -175.0, 160.0, -160.0])
    df = spark.createDataFrame(pd.DataFrame({"k": 1, "d": degrees}))
    row = stats.circular_summary(df, ["k"], "d").first()
    c, s = np.cos(np.radians(degrees)).mean(), np.sin(np.radians(degrees)).mean()
    assert row["mean_resultant_length_R"] == pytest.approx(np.hypot(c, s))
    assert row["signed_circular_mean_deg"] == pytest.approx(np.degrees(np.arctan2(s, c)))
    assert row["circular_sd_deg"] == pytest.approx(np.degrees(np.sqrt(-2 * np.log(np.hypot(c, s)))))
    assert row["median_absolute_deviation_deg"] == pytest.approx(np.median(np.abs(degrees)))


@pytest.mark.parametrize("leaf", [1, 1000])
def test_quantiles_without_keys(spark, leaf):
    df = spark.createDataFrame(pd.DataFrame({"x": np.arange(101.0)}))
    row = stats.exact_quantiles(df, [], F.col("x"), {"p": 0.335, "m": 0.5}, leaf=leaf).first()
    assert (row.p, row.m) == (pytest.approx(33.5), 50.0)
    assert stats.exact_quantiles(df.where("x < 0"), [], F.col("x"), {"m": 0.5}, leaf=leaf).count() == 0


@pytest.mark.parametrize("leaf", [50, 1 << 16])
def test_tasks_sort_rows_and_no_goals(spark, leaf, monkeypatch):
    """Splits are counted by hashing, ranks take one sort of bounded tasks, and goals aren't copied to every row."""
    plans = []
    monkeypatch.setattr(selection, "materialize", lambda df: plans.append(df) or df.localCheckpoint())
    monkeypatch.setattr(selection, "TASK_ROWS", 100, raising=False)
    rng = np.random.default_rng(8)
    pdf = pd.DataFrame({"k": rng.choice(["a", "b", None], 1500, p=[0.8, 0.15, 0.05]), "x": rng.normal(size=1500).round(2)})
    out = stats.exact_quantiles(spark.createDataFrame(pdf), ["k"], F.col("x"), {"q1": 0.25, "m": 0.5}, leaf=leaf)
    got = {r.k: (r.q1, r.m) for r in out.collect()}
    for k, g in pdf.groupby("k", dropna=False):
        assert got[None if pd.isna(k) else k] == pytest.approx(tuple(np.quantile(g.x, [0.25, 0.5])))
    texts = [df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0] for df in [*plans, out]]
    assert not any("SortAggregate" in t for t in texts)
    if leaf > 50:
        assert texts[-1].count("Window [") == 1 and "REPARTITION_BY_NUM" in texts[-1]
