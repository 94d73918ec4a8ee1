import pytest


@pytest.fixture(scope="session")
def documents(spark):
    """Rows to documents with an extra column that clashes with result columns."""

    def make(rows):
        full = [(i, t, "en", "s", len(t or ""), 9.5, None) for i, t in rows]
        return spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long, score double, key string")

    return make
