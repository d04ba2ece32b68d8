import pytest


@pytest.fixture
def frame(spark):
    """Documents with an extra column of a clashing name."""

    def make(rows, schema="doc_id long, text string"):
        return spark.createDataFrame(rows, schema).selectExpr("*", "'x' AS h", "1 AS score")

    return make
