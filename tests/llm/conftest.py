import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture()
def make_docs(spark):
    """Documents of (id, text) or (id, text, lang, source)."""

    def make(rows):
        full = [(*r, *(None,) * (4 - len(r))) for r in rows]
        return spark.createDataFrame(
            [(i, t, lang, s, None if t is None else len(t)) for i, t, lang, s in full], DOCS
        )

    return make
