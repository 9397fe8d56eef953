import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from strideframe.llm import mixing


def brute_targets(sizes, weights=(5, 2, 1), share=1.5, most=2.0):
    """Share out, stop those above their cap, share the excess again, until none is above."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    stopped, total = {}, share * sum(sizes.values())
    while True:
        free = [s for s in names if s not in stopped]
        rest = total - sum(stopped.values())
        level = rest / sum(weight[s] for s in free) if free else 0
        over = [s for s in free if weight[s] * level > most * sizes[s]]
        if not over:
            return stopped | {s: weight[s] * level for s in free}
        stopped |= {s: most * sizes[s] for s in over}


def brute_tilt(sizes, target, most=2.0):
    """The dual variable by bisection."""
    s = np.array([x for x in sizes if x], float)
    mean = sum(sizes) / len(sizes)

    def taken(t):
        return float((s * np.minimum(most, np.exp(np.minimum(t * s / mean, 700)))).sum())

    low, high = -1.0, 1.0
    while taken(low) > target:
        low *= 2
    while taken(high) < target:
        high *= 2
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if taken(mid) < target else (low, mid)
    return mid


def data(seed=1):
    rng = np.random.default_rng(seed)
    rows, i = [], 0
    for source, n in (("a", 300), ("b", 40), ("Z", 150), ("é", 90), (None, 60), ("one", 1), ("zero", 3)):
        for size in rng.lognormal(4, 1.2, n).astype(int) + 1:
            rows.append((i, source, 0 if source == "zero" else int(size)))
            i += 1
    return rows


def test_targets_and_tilts(spark):
    rows = data()
    sizes = spark.createDataFrame([(s, n) for _, s, n in rows], "source string, size long")
    by = {}
    for _, s, n in rows:
        by.setdefault(s, []).append(n)
    want = brute_targets({s: sum(v) for s, v in by.items()})
    solved = {r.source: r for r in mixing.tilts(sizes, mixing.targets(sizes)).collect()}
    assert set(solved) == set(by)
    for s, r in solved.items():
        assert math.isclose(r.target, want[s], rel_tol=1e-12, abs_tol=1e-9) and r.source_size == sum(by[s])
        if 0 < r.target < 2 * r.source_size:
            assert math.isclose(r.tilt, brute_tilt(by[s], r.target), rel_tol=1e-5, abs_tol=1e-7)


@pytest.mark.parametrize("group_rows", [1024, 16])
def test_mix_meets_its_targets(spark, group_rows):
    rows = data(2)
    docs = spark.createDataFrame(rows, "doc_id long, source string, size long")
    got = mixing.mix(docs, F.col("size"), group_rows=group_rows).toPandas()
    assert len(got) == len(rows) and got["_mix_copies"].between(0, 2).all()
    sums = got.assign(taken=got["size"] * got["_mix_copies"]).groupby("source", dropna=False).agg(t=("taken", "sum"), g=("_mix_target", "first"), n=("size", "count"))
    busy = sums[sums.n > 30]
    assert (abs(busy.t - busy.g) <= 0.01 * busy.g + 20).all()
    again = mixing.mix(docs.repartition(7), F.col("size"), group_rows=group_rows).toPandas()
    assert dict(zip(got.doc_id, got["_mix_copies"])) == dict(zip(again.doc_id, again["_mix_copies"]))


def test_query_and_stage(spark, rows, docs, odd):
    from strideframe.llm.queries import QUERIES

    got = QUERIES["op5_source_mixing"](spark, "/root/testdata/sf0.001").toPandas().set_index("doc_id")
    sizes = {d: len(re.findall(r"[^\x20\x09-\x0D]+", r[0] or "")) for d, r in rows.items()}
    assert got["size"].to_dict() == sizes and (got.taken <= 2 * got["size"]).all()
    by = {}
    for d, r in rows.items():
        by[r[2]] = by.get(r[2], 0) + sizes[d]
    want = brute_targets(by)
    assert all(math.isclose(got.target[d], want[rows[d][2]], rel_tol=1e-9) for d in rows)
    staged = mixing.mixing_stage(spark, docs, "")
    assert staged.columns == [*docs.columns, "copy"] and staged.count() == got.copies.sum()
    out = mixing.mixing_stage(spark, odd, "")
    assert out.columns == [*odd.columns, "copy"] and 7 <= out.count() <= 20
    assert mixing.mixing_stage(spark, odd.limit(0), "").count() == 0


def test_columns_with_the_names_used_inside(spark, odd, tmp_path):
    clashing = odd.selectExpr("*", "1 as copy", "'t' as _tilt", "2 as _rows", "'s' as _s", "3 as _mean", "4 as _mix_size", "5 as _mix_copies")
    out = mixing.mixing_stage(spark, clashing, "")
    assert out.columns == [*clashing.columns, "copy_"]
    out.write.parquet(str(tmp_path / "mixed"))
    read = spark.read.parquet(str(tmp_path / "mixed"))
    assert {(r.copy, r._tilt, r._rows, r._s, r._mean, r._mix_size, r._mix_copies) for r in read.collect()} == {(1, "t", 2, "s", 3, 4, 5)}
    plain = mixing.mixing_stage(spark, odd, "")
    assert sorted(map(str, read.select("doc_id", "copy_").collect())) == sorted(str(r).replace("copy=", "copy_=") for r in plain.select("doc_id", "copy").collect())
    assert mixing.mix(clashing).count() == odd.count()


def test_unsettled_sources_are_an_error(spark):
    sizes = spark.createDataFrame([("a", 10), ("a", 90), ("b", 5)], "source string, size long")
    with pytest.raises(RuntimeError, match="don't settle"):
        mixing.tilts(sizes, mixing.targets(sizes), steps=0)
