"""Tables of the queries, and tables that are written once and read again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sieveframe.session import scratch_folder

BATCH_ROWS = 1000  # rows per Arrow batch: long texts make the default of 10,000 large


def load(spark: SparkSession, folder: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return spark.read.parquet(f"{folder}/{name}.parquet")


def stored(df: DataFrame, purpose: str) -> DataFrame:
    """``df`` written under the shared checkpoint folder and read again: lineage ends here."""
    folder = scratch_folder(df.sparkSession, purpose)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def fold_remainder(key: str, modulus: int) -> Column:
    """crc32 of the key as text, modulo ``modulus``; null where the key is null."""
    return F.crc32(F.col(f"`{key}`").cast("string").cast("binary")) % modulus


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names with as many underscores before them as it takes to clash with no column of ``df``."""
    taken = {c.lower() for c in df.columns}
    mark = "_"
    while any(mark + name in taken for name in names):
        mark += "_"
    return [mark + name for name in names]
