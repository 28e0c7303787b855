import pytest


@pytest.fixture
def docs(spark):
    """Rows ``(doc_id, text[, source])`` as documents, with a column that clashes with output names."""
    def build(*rows):
        full = [(r[0], r[1], r[2] if len(r) > 2 else "s", "x") for r in rows]
        return spark.createDataFrame(full, "doc_id bigint, text string, source string, kept string")
    return build
