import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, fp string, extra int"


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents with columns whose names clash with those the operators use."""

    def make(rows):
        full = [(i, t, lang, source, None if t is None else len(t), 0.5, "x", None) for i, t, lang, source in rows]
        return spark.createDataFrame(full, DOCS)

    return make


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, empty and very long texts, repeats."""
    long = " ".join(f"word{i % 977}" for i in range(30_000))
    return [(1, None, None, None), (2, "", "en", "a"), (3, "?! --", "en", "a"), (4, long, "en", "b"), (5, long, "en", "b"), (None, "some plain words here", None, "b"), (7, "twice the same row", "de", None), (7, "twice the same row", "de", None)]


@pytest.fixture(scope="session")
def sf(spark):
    return "/root/testdata/sf0.001"
