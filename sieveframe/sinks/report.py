"""The machine-readable report."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sieveframe.plans.clean import CleanResult, reconcile


def describe_input(report: DataFrame, manifest: DataFrame) -> DataFrame:
    """Adds ``files, bytes, sha256`` of the input; the digest only if the input is a single file."""
    total = manifest.agg(
        F.count("*").alias("files"), F.coalesce(F.sum("length"), F.lit(0)).alias("bytes"),
        F.when(F.count("*") == 1, F.max("sha256")).alias("sha256"))
    return report.withColumn("_one", F.lit(1)).join(total.withColumn("_one", F.lit(1)), "_one").drop("_one")


def write_report(result: CleanResult, path: str, manifest: DataFrame | None = None,
                 parts: DataFrame | None = None) -> None:
    """Writes ``path/report`` and ``path/header_map`` (JSON), and ``path/parts`` if there are any.

    The profile is part of the one report row. The report is checked for reconciled counts first.
    """
    report = reconcile(result.report)
    if manifest is not None:
        report = describe_input(report, manifest)
    report.coalesce(1).write.mode("errorifexists").option("ignoreNullFields", False).json(f"{path}/report")
    spark = report.sparkSession
    pairs = spark.createDataFrame(result.header_map, "position int, source string, target string")
    pairs.coalesce(1).write.mode("errorifexists").json(f"{path}/header_map")
    if parts is not None:
        parts.write.mode("errorifexists").json(f"{path}/parts")
