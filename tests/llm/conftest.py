import pytest


@pytest.fixture(scope="session")
def make(spark):
    """make("a string, b int", rows) -> DataFrame of few partitions"""
    return lambda schema, rows: spark.createDataFrame(rows, schema).coalesce(2)
