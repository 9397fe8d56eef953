from itertools import permutations
import re

from strideframe.llm import filter_audit


def brute(docs, labels):
    """{(part, order, step): counts} straight from the definition, one order after the other."""
    found = []
    for d, text, lang in docs:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        fails = {
            "A": len(words) < 100, "B": 100 * len(set(words)) < 80 * len(words), "C": 100 * len(re.findall("[A-Z]", text)) > 10 * len(text),
            "D": bool(re.search(r"[#$%&*|]", text)),
            "E": d is not None and any(o is not None and o < d and (t or "") == text for o, t, _ in docs),
        }
        own = [(q, x) for i, q, x in labels if i == d and d is not None]
        found.append((lang or "", fails, any(q == 1 for q, _ in own), any(x == 1 for _, x in own)))
    out = {}
    for part in {f[0] for f in found}:
        here = [f for f in found if f[0] == part]
        shapley = dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left = list(here)
            for step, f in enumerate(order, 1):
                gone = [x for x in left if x[1][f]]
                left = [x for x in left if not x[1][f]]
                shapley[f] += len(gone)
                out[part, "".join(order), step] = [
                    len(left), len(gone), sum(x[1][f] for x in here) - len(gone), sum(x[1][f] and sum(x[1].values()) == 1 for x in here),
                    sum(x[2] for x in gone), sum(x[3] for x in gone),
                ]
        for key in [k for k in out if k[0] == part]:
            out[key].append(shapley[key[1][key[2] - 1]])
    return {k: tuple(v) for k, v in out.items()}


def result(docs, labels):
    rows = filter_audit.audit(docs, labels).collect()
    found = {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in rows}
    assert len(found) == len(rows)
    return found


def _tables(spark, docs, labels):
    return spark.createDataFrame(docs, "doc_id long, text string, lang string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_matches_every_order_played_through(spark):
    prose = " ".join(f"word{i}" for i in range(120))
    docs = [(i, prose + (" # " if i % 3 == 0 else f" own{i}"), "en") for i in range(12)]
    docs += [(20, None, None), (21, "", "en"), (22, "", ""), (23, "SHOUT " * 130, "de"), (24, "SHOUT " * 130, "de"), (24, "SHOUT " * 130, "de")]
    docs += [(25, "a b\tc\x0bd", "de"), (None, "", "en"), (None, prose, "fr"), (26, prose, "fr"), (27, " ".join("xyz"), "fr")]
    labels = [(0, 1, 0), (3, 1, 1), (23, 0, 1), (24, None, None), (24, 1, None), (25, 0, 0), (None, 1, 1), (99, 1, 1)]
    assert result(*_tables(spark, docs, labels)) == brute(docs, labels)


def test_whole_small_table(spark, docs, rows):
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    known = [(r.doc_id, r.quality, r.toxic) for r in labels.collect()]
    assert result(docs, labels) == brute([(d, t, lang) for d, (t, lang, _) in rows.items()], known)


def test_hot_group_of_copies(spark):
    docs = [(i, "one text for most", "en") for i in range(3000)] + [(3000 + i, f"text {i}", "en") for i in range(50)]
    counts = filter_audit.combinations(*_tables(spark, docs, [])).collect()
    assert {(r.failed, r.n) for r in counts} == {(1, 51), (17, 2999)}


def test_odd_rows_empty_tables_and_other_columns(spark, odd):
    labels = spark.createDataFrame([(5, 1, 0, "x")], "doc_id long, quality int, toxic int, failed string")
    plain = odd.select("doc_id", "text", "lang")
    extra = plain.selectExpr("*", "1 as failed", "'q' as hash", "2 as n", "3 as part", "4 as bit", "5 as label_id", "6 as good")
    found = result(extra, labels)
    assert found == brute([tuple(r) for r in plain.collect()], [(5, 1, 0)])
    none = odd.limit(0)
    assert filter_audit.audit(none, labels).count() == 0
    assert result(plain, labels.limit(0)) == brute([tuple(r) for r in plain.collect()], [])
