import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="session")
def docs(spark):
    """Makes a documents frame from (id, text, lang) rows, with an extra column that clashes with an operator's own names."""

    def make(rows, extra=True):
        frame = spark.createDataFrame([(i, t, lang, "s", None if t is None else len(t)) for i, t, lang in rows], SCHEMA)
        return frame.selectExpr("*", "'x' AS component_id", "1 AS h1", "'y' AS id") if extra else frame

    return make


ODD = [(None, "no id here", None), (1, None, None), (2, "", "en"), (3, "word", None), (3, "word", None), (4, "a " * 20_000, "fr"), (5, "é" * 600, "de")]


@pytest.fixture(scope="session")
def odd(docs):
    """Nulls, empty and very long texts, repeated rows."""
    return docs(ODD)


@pytest.fixture(scope="session")
def none(docs):
    return docs([]).where("false")
