import hashlib

import pytest
from pyspark.sql import functions as F

from strideframe.llm import order_minhash


def check(found, rows):
    """Against the definition of the edited text, and the promises on fingerprints."""
    prints, bad = {}, []
    for i, (d, text) in enumerate(rows):
        following = rows[(i + 1) % len(rows)][1]
        q = len(text) // 4
        edited = text[: len(text) - q] + following[:q]
        r = found[d]
        prints.setdefault(text, r.fingerprint)
        prints.setdefault(edited, r.edited_fingerprint)
        if (r.n_chars, r.edited_sha256) != (len(text), hashlib.sha256(edited.encode()).hexdigest()):
            bad.append(d)
        assert prints[text] == r.fingerprint and prints[edited] == r.edited_fingerprint
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 and (text != following or r.near_next == 1)
    assert not bad


@pytest.mark.parametrize("block", [256, 7])
def test_query_on_documents(spark, rows, monkeypatch, block):
    from strideframe.llm.queries import QUERIES

    monkeypatch.setattr(order_minhash, "BLOCK_DOCS", block)
    found = {r.doc_id: r for r in QUERIES["op9_order_minhash"](spark, "/root/testdata/sf0.001").collect()}
    assert len(found) == len(rows)
    check(found, sorted((d, r[0]) for d, r in rows.items()))
    long = [d for d, r in rows.items() if len(r[0]) > 1000]
    assert sum(found[d].near_edited for d in long) / len(long) > 0.5 > 0.1 > sum(found[d].near_next for d in long) / len(long)


def test_sparse_ids_and_last_to_first(spark):
    rows = [(i**4, " ".join(f"w{i}x{j}" for j in range(i * 7 % 60))) for i in range(60)]
    found = {r.doc_id: r for r in order_minhash.neighbour_likeness(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()}
    check(found, rows)


def prints(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    signed = order_minhash.with_signature(docs.withColumn("text", F.coalesce("text", F.lit(""))), "text", "sig").select("doc_id", "sig")
    return {r.doc_id: r.sig for r in signed.collect()}


def near(a, b):
    return (sum(x == y for x, y in zip(a, b)) / len(a)) ** 0.5


def test_sensitive_to_repeats_and_order(spark):
    words = [f"w{i}" for i in range(400)]
    turned = [w for i in range(0, 400, 40) for w in words[i : i + 40][::-1]]
    swapped = words[200:] + words[:200]
    sig = prints(spark, [" ".join(words), " ".join(words[:390] + ["new"] * 10), " ".join(turned), " ".join(swapped), "a b a b a b", "a b a b", None, " \t"])
    assert near(sig[0], sig[1]) > 0.9 and near(sig[0], sig[2]) < 0.3
    assert 0.3 < near(sig[0], sig[3]) < 0.9, "the same pairs in another order"
    assert sig[4] != sig[5] and sig[6] == sig[7] == [0] * 32


def test_odd_rows(spark, odd):
    found = order_minhash.neighbour_likeness(odd).collect()
    assert len(found) == 10
    assert {len(r.fingerprint) for r in found} == {256}
    assert order_minhash.neighbour_likeness(odd.limit(0)).count() == 0
    alone = order_minhash.neighbour_likeness(odd.where("doc_id = 4")).first()
    assert alone.near_next == 1.0
