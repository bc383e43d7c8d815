import pytest


@pytest.fixture(scope="session", autouse=True)
def small_batches(spark):
    """Batches of a few rows, so that tests cross their borders."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
