import re
from collections import Counter

import numpy as np
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from strideframe.llm import licences

CUES = {
    "apache": "apache license, version 2.0", "gpl": "gnu general public license", "mit": "the mit license", "creative_commons": "cc by",
    "proprietary": "all rights reserved",
}


def test_finds_notices_and_leaves_prose_alone(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    from strideframe.llm.queries import QUERIES

    texts = {r.doc_id: (r.text or "").lower() for r in docs.collect()}
    got = QUERIES["op1_license_scan"](spark, "/root/testdata/sf0.01").collect()
    assert len(got) == len(texts)
    want = {d: {k for k, cue in CUES.items() if cue in t} for d, t in texts.items()}
    found = {r.doc_id: set(filter(None, r.confirmed_families.split(","))) for r in got}
    total = sum(map(len, want.values()))
    assert total > 20 and sum(len(want[d] & found[d]) for d in want) >= 0.95 * total
    assert sum(len(found[d] - want[d]) for d in want) <= 0.05 * total


def test_unknown_and_odd_rows(spark, docs, odd):
    model = licences.fit(docs)
    rows = [
        (1, "some prose first\nPermission is hereby granted, free of charge, to any person obtaining a copy of this software\nlast line"),
        (2, "You must hold a driving license to drive here, said the public officer."), (3, "word " * 500 + "Licensed under CC BY-SA 4.0. " + "word " * 500),
    ]
    got = {r.doc_id: r for r in licences.scan(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()}
    assert got[1].confirmed == ["mit"] and got[2].families == []
    assert licences.scan(odd, model).count() == 10 and licences.scan(odd.limit(0), model).count() == 0
    assert licences.fit(odd.limit(0)).families == model.families


def known_terms(words):
    return tuple(sorted({w for w in words if w in licences.WORDS} | {p for p in map(" ".join, zip(words, words[1:])) if p in licences.PAIRS}))


def test_pieces_carry_their_known_terms(spark):
    text = " ".join(f"w{i} of the license under the terms" if i % 5 else "version 2 0 x" for i in range(60)) + "\n\n..\nmit\nthe software"
    got = licences.pieces(spark.createDataFrame([(1, text), (2, None), (3, "")], "doc_id long, text string")).collect()
    lines = [w for line in text.split("\n") if (w := re.findall("[a-z0-9]+", line))]
    starts = [(w, i) for w in lines for i in range(0, max(0, len(w) - 25) // 24 * 24 + 1, 24)]
    assert Counter(tuple(r.tokens) for r in got) == Counter(tuple(w[i : i + 48]) for w, i in starts)
    assert all(tuple(sorted(set(r.terms))) == known_terms(r.tokens) for r in got) and {r.doc_id for r in got} == {1}


def test_every_distinct_paragraph_trains_and_calibrates(spark):
    prose = [f"paragraph {i} with {'license' if i % 3 else 'software'} text{' under the sun' if i % 7 == 0 else ''} n{i * i}" for i in range(9_500)]
    near = spark.createDataFrame([(f"source code mozilla public v 2 mpl 2 file x{i}",) for i in range(60)], "text string")
    # Near licences that only the held-out part has: the fit can't learn them, the thresholds must.
    prose += [r.text for r in near.where(F.pmod(F.xxhash64(F.split("text", " ")), F.lit(5)) == 0).collect()]
    quoting = [f"number {i} all rights reserved" for i in range(40)]
    lines = [*prose, *prose[:500], *quoting]
    docs = spark.createDataFrame([(i, "\n".join(lines[i * 50 : i * 50 + 50])) for i in range(len(lines) // 50 + 1)], "doc_id long, text string")
    split = [re.findall("[a-z0-9]+", t.lower()) for t in [*prose, *licences.NEAR_MISSES]]
    quotes = [any(" ".join(w[i : i + 3]) in licences.TRIPLES for i in range(len(w) - 2)) for w in split[: len(prose)]]
    want = [w for w, quoted in zip(split, [*quotes, *[False] * len(licences.NEAR_MISSES)], strict=True) if not quoted]
    rows = licences.training_rows(docs).where(F.col("family") == licences.UNKNOWN)
    seen = Counter()
    for r in rows.collect():
        seen[tuple(r.terms)] += r.n
    assert seen == Counter(map(known_terms, want)) and sum(seen.values()) > 9_000

    model = licences.fit(docs)
    all_pieces = spark.createDataFrame([(w, list(known_terms(w))) for w in want], "tokens array<string>, terms array<string>")
    held = all_pieces.where(F.pmod(F.xxhash64("tokens"), F.lit(5)) == 0)
    scores = np.array([r.p for r in model.fitted.transform(licences.features(held)).select(vector_to_array("probability").alias("p")).collect()])
    limits = np.quantile(np.maximum(scores, licences.LEAST), licences.QUANTILE, axis=0)
    assert len(scores) > 1_700 and np.allclose(model.thresholds[:-1], limits[:-1], atol=2e-6)
    assert model.thresholds[model.families.index("mpl")] > licences.LEAST
