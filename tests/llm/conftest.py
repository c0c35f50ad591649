import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, class int, id string, words string, key string"


@pytest.fixture
def make(spark):
    """Documents from (doc_id, text, lang, source) rows, with more columns whose names operators use inside."""

    def docs(rows):
        return spark.createDataFrame([(*r, len(r[1] or ""), 7, "x", None, "k") for r in rows], SCHEMA).repartition(3)

    return docs
