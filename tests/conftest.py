import itertools

import pytest

from sieveframe import build_session


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session("tests", "local[4]", **{
        "spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false",
        "spark.checkpoint.dir": str(tmp_path_factory.mktemp("checkpoint")),
        "spark.driver.extraJavaOptions": "-Dlog4j2.level=OFF"})
    session.sparkContext.setLogLevel("OFF")
    yield session
    session.stop()


@pytest.fixture
def put(tmp_path):
    """Writes a text file and returns its path."""
    numbers = itertools.count()

    def write(text, name="in.csv", encoding="utf-8"):
        folder = tmp_path / str(next(numbers))
        folder.mkdir()
        (folder / name).write_bytes(text.encode(encoding))
        return str(folder / name)

    return write


@pytest.fixture
def evaluate(spark):
    """Applies a column function to a list of strings and returns the list of results."""
    from pyspark.sql import functions as F

    def run(function, values, dtype="string"):
        df = spark.createDataFrame(list(enumerate(values)), f"i int, v {dtype}")
        return [row[0] for row in df.select(function(F.col("v")).alias("r"), "i").orderBy("i").select("r").collect()]

    return run
