import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, size string, key string, word string"


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents from (doc_id, text[, source]); with extra columns whose names
    the operators use themselves."""
    def make(rows):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", len(r[1] or ""), "x", "y", "z") for r in rows]
        return spark.createDataFrame(full, DOCS)
    return make


@pytest.fixture(scope="session")
def sf001_docs(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
