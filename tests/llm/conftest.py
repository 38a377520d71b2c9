import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def documents(spark):
    """Makes a documents table of (doc_id, text) or longer rows; extra columns with the operators' own names come along."""

    def make(rows):
        full = [(*(*r, None, None)[:4], len(r[1] or "")) for r in rows]
        df = spark.createDataFrame(full, DOCS)
        return df.selectExpr("*", "'x' AS id", "'y' AS digest", "1 AS node", "2 AS a", "3 AS b", "'z' AS start", "4 AS rank", "5 AS block", "6 AS h")

    return make
