import hashlib
import random

import numpy as np
from pyspark.sql import functions as F

from strideframe.llm import lines


def brute(rows, min_chars=40, min_docs=5):
    """Straight from the definition: {doc_id: (n_lines, n_dropped, kept)}."""
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})

    def key(line):
        return line.strip(" \t\n\x0b\x0c\r").translate(lower)

    held = {}
    for d, text in rows:
        for line in (text or "").split("\n"):
            held.setdefault(key(line), set()).add(d)
    out = {}
    for d, text in rows:
        parts = (text or "").split("\n")
        kept = [x for x in parts if not (len(key(x)) >= min_chars and len(held[key(x)]) >= min_docs and d != max(held[key(x)], key=lambda v: (v is not None, v)))]
        out[d] = (len(parts), len(parts) - len(kept), "\n".join(kept))
    return out


def result(docs, index):
    found = lines.dedup(docs, index).select("doc.doc_id", "n_lines", "n_dropped", "kept").collect()
    return {r.doc_id: (r.n_lines, r.n_dropped, r.kept) for r in found}, len(found)


def table(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


def sample_rows():
    long = ["A line that many documents hold, number %d, with padding" % i for i in range(4)]
    rng = random.Random(3)
    rows = []
    for d in range(40):
        parts = rng.sample(long, rng.randint(0, 3)) + [f"own line of document {d} which is long enough", "short"]
        if d % 7 == 0:
            parts.append("  \t" + long[0].upper() + "\x0b ")
        rng.shuffle(parts)
        rows.append((d, "\n".join(parts)))
    return [*rows, (50, None), (51, ""), (52, "\n\n")]


def test_matches_brute_force(spark):
    rows = sample_rows()
    docs = table(spark, rows)
    found, n = result(docs, lines.build(docs))
    assert n == len(rows) and found == brute(rows)
    assert any(x[1] for x in found.values())


def test_insert_and_remove_are_reversible(spark):
    rows = sample_rows()
    first, second = table(spark, rows[:25]), table(spark, rows[25:])
    whole = table(spark, rows)
    grown = lines.insert(lines.build(first), second)
    assert result(whole, grown)[0] == brute(rows)
    back = lines.remove(grown, second.select("doc_id"))
    assert result(first, back)[0] == brute(rows[:25])
    fresh = lines.build(first)
    assert {tuple(r) for r in back.counts.collect()} == {tuple(r) for r in fresh.counts.collect()}
    keys = fresh.counts.where("docs >= 5").select("h1", "h2").toPandas()
    held = {r.shard: lines.CuckooFilter.load(r.data) for r in back.filters.collect()}
    assert all(held[0].contains(keys.h1.to_numpy(), keys.h2.to_numpy()))
    assert sum((f.table > 0).sum() for f in held.values()) == len(keys)


def test_filter_never_misses_and_forgets():
    rng = np.random.default_rng(1)
    a, b = rng.integers(-(1 << 63), 1 << 63, (2, 5000), dtype=np.int64)
    made = lines.CuckooFilter.of(a[:4000], b[:4000])
    assert made.contains(a[:4000], b[:4000]).all()
    assert made.contains(a[4000:], b[4000:]).mean() < 0.01
    for x, y in zip(a[:2000].tolist(), b[:2000].tolist()):
        assert made.remove(x, y)
    assert made.contains(a[2000:4000], b[2000:4000]).all()
    assert (made.table > 0).sum() == 2000


def test_odd_rows(spark, odd):
    found = lines.dedup(odd, lines.build(odd)).select("doc.*", F.col("n_lines").alias("lines"), "n_dropped", "kept").collect()
    assert len(found) == 10 and {r.lines for r in found if r.doc_id in (1, 2)} == {1}
    assert all(r.kept == (r.text or "") and r.n_dropped == 0 for r in found)
    out = lines.line_stage(spark, odd, "")
    assert out.columns == odd.columns and out.count() == 10
    assert lines.line_stage(spark, odd.limit(0), "").count() == 0


def test_null_id_is_the_smallest_document(spark):
    line = "one line that is found in every document of this table"
    docs = table(spark, [(None, line), *[(d, line) for d in range(4)]])
    found, _ = result(docs, lines.build(docs))
    assert {k: v[1] for k, v in found.items()} == {None: 1, 0: 1, 1: 1, 2: 1, 3: 0}


def test_query_on_documents(spark, rows):
    from strideframe.llm.queries import QUERIES

    want = brute([(d, r[0]) for d, r in rows.items()])
    got = {r.doc_id: (r.n_lines, r.n_dropped, r.kept_sha256) for r in QUERIES["op4_line_dedup"](spark, "/root/testdata/sf0.001").collect()}
    assert got == {d: (a, b, hashlib.sha256(c.encode()).hexdigest()) for d, (a, b, c) in want.items()}


def test_stage_keeps_a_column_with_its_inner_name(spark):
    docs = table(spark, sample_rows()).selectExpr("*", "doc_id + 1 as _line_stage", "'x' as kept", "0 as n_dropped")
    out = lines.line_stage(spark, docs, "").collect()
    assert all(r._line_stage == r.doc_id + 1 and r.kept == "x" for r in out)
    assert {r.doc_id: r.text or "" for r in out} == {d: kept for d, (_, _, kept) in brute(sample_rows()).items()}


def test_filters_too_large_for_a_broadcast_stay_with_their_shards(spark, rows, monkeypatch):
    docs = spark.createDataFrame([(d, r[0]) for d, r in rows.items()], "doc_id long, text string")
    index = lines.build(docs)

    def kept():
        return sorted(tuple(r) for r in lines.dedup(docs, index).select("doc.doc_id", "n_lines", "n_dropped", "kept").collect())

    want, probed = kept(), lines._probe(index).count()
    monkeypatch.setattr(lines, "FILTER_BYTES", 0)
    monkeypatch.setattr(lines, "GROUP_ROWS", 64)
    assert kept() == want and lines._probe(index).count() == probed


def test_keys_are_found_by_bisection(spark):
    """Every size of the list of lost keys: each of them goes, each other line stays."""
    line = "line number {} of the list, which is long enough to count".format
    copies = [(d, "\n".join(line(i) for i in range(d))) for d in range(1, 41)]
    docs = spark.createDataFrame([*copies, (100, "\n".join(f"own {line(i)}" for i in range(30)))], "doc_id long, text string")
    got = {r.doc_id: (r.n_lines, r.n_dropped) for r in lines.dedup(docs, lines.build(docs)).select("doc.doc_id", "n_lines", "n_dropped").collect()}
    assert got == {d: (d, 0 if d == 40 else min(d, 36)) for d in range(1, 41)} | {100: (30, 0)}
