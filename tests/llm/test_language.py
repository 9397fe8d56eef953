import zlib

from pyspark.sql import functions as F

from strideframe.llm import language


def test_held_out_accuracy(spark):
    """Only rows that are not held out are learned from."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    from strideframe.llm.queries import QUERIES

    lang = {r.doc_id: (r.lang, r.text) for r in docs.collect()}
    got = QUERIES["op7_language_id"](spark, "/root/testdata/sf0.01").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    held = [r for r in got if r.held_out]
    assert sum(r.lang_pred == lang[r.doc_id][0] for r in held) / len(held) > 0.98
    assert all(0 <= r.score <= 1 for r in got)


def test_predictions_see_the_text_alone(spark, docs):
    model = language.fit(docs)
    a = {r.doc_id: r.language for r in language.identify(docs, model).collect()}
    other = docs.withColumn("lang", F.lit("xx")).withColumn("source", F.lit(None).cast("string"))
    assert a == {r.doc_id: r.language for r in language.identify(other, model).collect()}


def test_unseen_words_back_off(spark):
    rows = [(i, "the thing with the other thing", "en") for i in range(20)] + [(i, "der die das schlicht geschacht", "de") for i in range(20, 40)]
    model = language.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert model.languages == ("de", "en")
    got = model.predict(["thithing", "schlachts", "zzz", "1234 !?", None, "\u00b2 \u00bd", "\u00e91 the thing"])
    assert [x for x, _ in got] == ["en", "de", got[2][0], "und", "und", "und", "en"] and got[2][0] in ("de", "en")
    assert got[3] == ("und", 0.0) and model.predict(["the thing"] * 3) == [model.predict(["the thing"])[0]] * 3


def test_odd_rows(spark, odd):
    model = language.fit(odd)
    found = language.identify(odd.select("doc_id", "text"), model).collect()
    assert len(found) == 10 and {r.language.lang_pred for r in found if r.doc_id in (1, 2, 3)} == {"und"}
    kept = language.language_stage(spark, odd, "")
    assert kept.columns == odd.columns and kept.count() == 7
    nothing = language.fit(odd.limit(0))
    assert nothing.predict(["some text"]) == [("und", 0.0)] and language.language_stage(spark, odd.limit(0), "").count() == 0
