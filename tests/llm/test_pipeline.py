import corpus_pipeline
from strideframe.llm import queries


def test_stages_agree_with_their_operators(spark, docs):
    """Each stage on the rows that its predecessor kept, against the operator's own tested results."""
    sf = "/root/testdata/sf0.001"
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "simhash_near_dedup", "decontamination", "source_mixing"]
    current = docs.limit(150).cache()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, current, sf).cache()
        assert out.columns == docs.columns, name
        before, after = {r.doc_id: r for r in current.collect()}, {r.doc_id: r for r in out.collect()}
        assert set(after) <= set(before)
        if name == "line_dedup":
            assert set(after) == set(before) and all(r.n_chars == len(r.text) for r in after.values())
        else:
            assert all(after[d] == before[d] for d in after)
        current = out
    mixed = corpus_pipeline.STAGES[-1][1](spark, current, sf)
    assert mixed.columns == [*docs.columns, "copy"] and mixed.count() > 0


def test_run_is_whole_and_repeatable(spark):
    a = corpus_pipeline.run(spark, "/root/testdata/sf0.001").toPandas()
    b = corpus_pipeline.run(spark, "/root/testdata/sf0.001").toPandas()
    key = ["doc_id", "copy"]
    assert len(a) and a.sort_values(key).reset_index(drop=True).equals(b.sort_values(key).reset_index(drop=True))
    assert set(queries.ORACLES) <= set(queries.QUERIES)
