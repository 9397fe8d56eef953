import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def docs(spark):
    """The smallest table of documents."""
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="session")
def rows(docs):
    """{doc_id: (text, lang, source)} of the smallest table."""
    return {r.doc_id: (r.text, r.lang, r.source) for r in docs.collect()}


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in any column, empty and blank texts, a very long text, repeated rows and columns with clashing names."""
    long = " ".join(f"word{i % 977} and more" for i in range(30_000))
    data = [
        (1, None, None, None, None, "x"), (2, "", "en", "a", 0, None), (3, " \t\n ", None, "a", 4, "y"),
        (4, long, "en", None, len(long), "z"), (5, "the same row", "en", "b", 12, "k"), (5, "the same row", "en", "b", 12, "k"),
        (6, "the same row", "de", "b", 12, "k"), (None, "no id at all", "en", "b", 12, "k"), (7, "a\n\nb\n" + "-" * 50, "en", "b", 6, "k"),
        (8, "ends with a tail \U0001F600é", "fr", "c", 19, "k"),
    ]
    return spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long, size string")
