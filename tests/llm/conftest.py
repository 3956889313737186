import pytest


@pytest.fixture
def docs(spark):
    """Rows (doc_id, text) as a table with further columns, some of whose names clash."""

    def make(rows, extra=True):
        df = spark.createDataFrame(rows, "doc_id bigint, text string")
        return df.selectExpr("doc_id", "text", "'x' as id", "1 as row", "cast(null as string) as words", "2 as n", "array(1) as bands") if extra else df

    return make
