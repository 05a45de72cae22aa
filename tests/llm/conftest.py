import pytest

DOCUMENT = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def make_docs(spark):
    """A documents table from (doc_id, text) pairs, with an extra column of a clashing name."""

    def build(*rows, extra="score"):
        return spark.createDataFrame(
            [(i, t, "en", "s", len(t or ""), "x") for i, t in rows], f"{DOCUMENT}, {extra} string")

    return build
