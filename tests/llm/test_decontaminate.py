import hashlib
import re

import pytest

from strideframe.llm import decontaminate

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def brute(docs, items, window=13):
    grams = {}
    for item, text in items:
        w = words(text)
        for i in range(max(1, len(w) - window + 1) if w else 0):
            grams.setdefault(tuple(w[i : i + window]), set()).add(str(item))
    sizes = {len(g) for g in grams}
    out = {}
    for d, text in docs:
        w, hit, found = words(text), set(), set()
        for k in sizes:
            for i in range(len(w) - k + 1):
                if (g := tuple(w[i : i + k])) in grams:
                    hit.update(range(i, i + k))
                    found |= grams[g]
        out[d] = (len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w))
    return out


ITEM = " ".join(f"q{i}" for i in range(20))
ITEMS = [(1, ITEM), (2, "Short item Ä"), (10, ITEM.upper()), (3, None), (4, "..."), (5, "one"), (6, " ".join(["dup"] * 15))]
DOCS = [
    (1, "x " + ITEM.replace(" ", ", ") + " y"), (2, ITEM.replace("q5", "other")), (3, "short ITEM Ä, short item ä"), (4, None), (5, ""), (6, "!?"),
    (7, "pad " * 400 + ITEM), (8, "one"), (9, " ".join(["dup"] * 40)), (10, ITEM + " " + ITEM), (11, "clean words only " * 9), (12, "q0 " * 30 + ITEM[:40]),
]


@pytest.mark.parametrize("limit", [64 << 20, 700])
def test_matches_brute_force(spark, monkeypatch, limit):
    """In one broadcast and in several."""
    monkeypatch.setattr(decontaminate, "BROADCAST_BYTES", limit)
    docs = spark.createDataFrame(DOCS, "doc_id long, text string")
    found = decontaminate.contamination(docs, spark.createDataFrame(ITEMS, "item_id long, text string")).collect()
    got = {
        r.doc_id: (r.n_words, r.n_hit, len(r["items"] or []), hashlib.sha256(",".join(r["items"] or []).encode()).hexdigest(), r.contaminated) for r in found
    }
    assert got == brute(DOCS, ITEMS)
    assert {d for d, x in got.items() if x[4]} >= {1, 3, 8, 9, 10} and not got[7][4] and got[7][1] == 20


def test_modes(spark):
    docs, items = spark.createDataFrame(DOCS, "doc_id long, text string"), spark.createDataFrame(ITEMS, "item_id long, text string")
    want = brute(DOCS, ITEMS)
    kept = decontaminate.decontaminate(docs, items)
    assert {r.doc_id for r in kept.collect()} == {d for d, x in want.items() if not x[4]}
    cut = {r.doc_id: r.text for r in decontaminate.decontaminate(docs, items, "spans").collect()}
    assert {d: len(words(t)) for d, t in cut.items()} == {d: x[0] - x[1] for d, x in want.items()}
    assert cut[11] == DOCS[10][1] and cut[4] is None
    with pytest.raises(ValueError):
        decontaminate.decontaminate(docs, items, "other")


def test_odd_rows(spark, odd):
    items = spark.createDataFrame([(1, "the same row")], "item_id long, text string")
    found = decontaminate.contamination(odd, items).collect()
    assert len(found) == 10 and sorted(r.doc_id for r in found if r.contaminated) == [5, 5, 6]
    kept = decontaminate.decontaminate(odd, items)
    assert kept.columns == odd.columns and kept.count() == 7
    assert decontaminate.contamination(odd, items.limit(0)).where("contaminated").count() == 0
    assert decontaminate.decontaminate(odd.limit(0), items).count() == 0


def test_query_on_documents(spark, rows):
    from strideframe.llm.queries import QUERIES

    items = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").select("item_id", "text").collect()]
    got = {r.doc_id: tuple(r)[1:] for r in QUERIES["op8_decontamination"](spark, "/root/testdata/sf0.001").collect()}
    assert got == brute([(d, r[0]) for d, r in rows.items()], items)


def test_cutting_keeps_a_column_with_its_inner_name(spark):
    words = " ".join(f"w{i}" for i in range(13))
    docs = spark.createDataFrame([(1, f"before {words} after", 7)], "doc_id long, text string, _cut long")
    bench = spark.createDataFrame([(1, words)], "item_id long, text string")
    rows = decontaminate.decontaminate(docs, bench, "spans").collect()
    assert [(r.doc_id, r._cut) for r in rows] == [(1, 7)] and "w5" not in rows[0].text and rows[0].text.startswith("before")


def test_a_word_that_all_items_share(spark):
    """Items that share their longest word propose at most a window per place; the rows are those of brute force."""
    items = [(i, " ".join(["extraordinarilylong" if k == i % 13 else f"i{i}k{k}" for k in range(13)])) for i in range(60)]
    docs = [(d, " ".join([items[d][1], "extraordinarilylong"] * 3)) for d in range(20)] + [(99, "extraordinarilylong " * 200)]
    found = decontaminate.contamination(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    got = {r.doc_id: (r.n_words, r.n_hit, len(r["items"] or []), r.contaminated) for r in found.collect()}
    assert got == {d: (x[0], x[1], x[2], x[4]) for d, x in brute(docs, items).items()}
