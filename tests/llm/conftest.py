import pytest


@pytest.fixture()
def docs(spark):
    """Documents with nulls, empty and repeated rows, and a column that clashes with operators' own."""

    def make(texts, **more):
        rows = [(i, t, "en", "src0", len(t or ""), "x") for i, t in enumerate(texts)] if not isinstance(texts, dict) else [(k, v, "en", "src0", len(v or ""), "x") for k, v in texts.items()]
        return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, n_words string")

    return make
