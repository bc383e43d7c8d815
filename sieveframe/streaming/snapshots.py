"""Latest rows of a growing table: numbered batches, folded now and then into a bucketed snapshot.

A batch is stored under its own number, so that one that is repeated replaces itself. ``compact`` folds the
batches since the last snapshot into it: only buckets that hold one of their keys are written anew, and a
manifest, which lists the folder of every bucket and the last batch within, is written last. Readers take the
newest manifest, so they see one version, whole, whatever is being written; later batches are folded on top.
"""

from __future__ import annotations

from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sieveframe.functions.cells import column
from sieveframe.operators.records import latest_by_key

BUCKETS = 64

_MANIFEST = "version long, bucket int, folder string, buckets int"


def store_batch(batch: DataFrame, path: str, number: int) -> None:
    """Store a batch under its number, in place of an earlier try; for ``foreachBatch`` as it is."""
    batch.write.mode("overwrite").parquet(f"{path}/batches/batch={number}")


def _bucket(key: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(column(key)), F.lit(buckets)).cast("int")


def _exists(spark: SparkSession, folder: str, schema: str | None = None) -> DataFrame | None:
    """The table under ``folder``, or nothing while there is none."""
    try:
        reader = spark.read if schema is None else spark.read.schema(schema).option("recursiveFileLookup", True)
        return reader.parquet(folder)
    except AnalysisException as error:
        if error.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return None


def manifest(spark: SparkSession, path: str) -> list:
    """``version, bucket, folder, buckets`` of the newest snapshot: one row for each bucket that holds rows."""
    listed = _exists(spark, f"{path}/manifests", _MANIFEST)
    if listed is None:
        return []
    newest = listed.agg(F.max("version")).first()[0]
    return listed.where(F.col("version") == newest).collect()


def _since(spark: SparkSession, path: str, version: int) -> DataFrame | None:
    batches = _exists(spark, f"{path}/batches")
    return None if batches is None else batches.where(F.col("batch") > version).drop("batch")


def _rows(spark: SparkSession, entries: list) -> DataFrame | None:
    return spark.read.parquet(*[f"{e['folder']}/bucket={e['bucket']}" for e in entries]) if entries else None


def compact(spark: SparkSession, path: str, key: str, order: str, buckets: int = BUCKETS) -> int | None:
    """Fold the batches since the last snapshot into the next, and return its version, the last batch within.

    Nothing happens without new batches. The number of buckets is that of the first snapshot. A run that is
    broken off leaves no manifest, and the next one writes its folder anew. Folders that no manifest names any
    more may be deleted once no reader is left on them.
    """
    before = manifest(spark, path)
    last = before[0]["version"] if before else -1
    buckets = before[0]["buckets"] if before else buckets
    batches = _exists(spark, f"{path}/batches")
    version = None if batches is None else batches.agg(F.max("batch")).first()[0]
    if version is None or version <= last:
        return None if last < 0 else last
    new = batches.where(F.col("batch").between(last + 1, version)).drop("batch").withColumn("bucket", _bucket(key, buckets))
    touched = {r["bucket"] for r in new.select("bucket").distinct().collect()}  # ``buckets`` rows at most
    old = _rows(spark, [e for e in before if e["bucket"] in touched])
    both = new if old is None else new.unionByName(old.withColumn("bucket", _bucket(key, buckets)))
    folder = f"{path}/snapshots/version={version}"
    latest_by_key(both, [key, "bucket"], order).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(folder)
    entries = [(int(version), e["bucket"], e["folder"], buckets) for e in before if e["bucket"] not in touched] \
        + [(int(version), b, folder, buckets) for b in sorted(touched)]
    spark.createDataFrame(entries, _MANIFEST).coalesce(1).write.mode("overwrite").parquet(f"{path}/manifests/{version}")
    return int(version)


def read_latest(spark: SparkSession, path: str, key: str, order: str) -> DataFrame:
    """The latest row of each key: the newest snapshot with the batches after it folded on top."""
    entries = manifest(spark, path)
    parts = [_rows(spark, entries), _since(spark, path, entries[0]["version"] if entries else -1)]
    found = [p for p in parts if p is not None]
    if not found:
        raise ValueError("nothing has been stored yet")
    return latest_by_key(reduce(DataFrame.unionByName, found), key, order)
