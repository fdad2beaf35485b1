import pytest

from larkspur.llm.common import prepare

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents from texts, or from (doc_id, text, source) rows."""
    prepare(spark)

    def make(rows, ids=None):
        rows = [r if isinstance(r, tuple) else ((ids or range(len(rows)))[i], r, "a") for i, r in enumerate(rows)]
        return spark.createDataFrame([(d, t, "en", s, len(t or "")) for d, t, s in rows], DOCS)

    return make
