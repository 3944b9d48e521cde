import pytest


@pytest.fixture
def docs(spark):
    """Makes a documents table of texts, or of (doc_id, text) pairs."""

    def make(texts, lang="en"):
        rows = [t if isinstance(t, tuple) else (i, t) for i, t in enumerate(texts)]
        rows = [(i, t, lang, "s", None if t is None else len(t)) for i, t in rows]
        return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")

    return make


EDGES = [None, "", " ", "\n\n", "a", "a", "x" * 300_000, "word " * 20_000, "é😀 ▁ \u0000 z", (None, "a"), (4, "a"), (None, None)]
