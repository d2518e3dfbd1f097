import pytest


@pytest.fixture()
def docs(spark):
    """Makes documents of (doc_id, text) pairs, with a column more than operators need."""

    def make(rows):
        return spark.createDataFrame([(i, t, "en", "s", -1, "x") for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, size string")

    return make
