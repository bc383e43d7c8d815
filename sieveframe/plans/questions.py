"""Look-ups on a stored report: what changed, what is missing, copies, sizes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sieveframe.functions.text import norm
from sieveframe.operators.profile import missing_report, with_texts


def what_changed(report: DataFrame) -> DataFrame:
    return report.select("operation", "rows_read", "rows_exported", "changes.*", "values_changed",
                         "duplicates", "irregular_rows", "invalid_dates")


def missing_cells(report: DataFrame, limit: int | None = None) -> DataFrame:
    """Columns with missing cells and their share of the rows evaluated."""
    columns = report.select("rows_evaluated", F.inline("profile"))
    return missing_report(columns, F.col("rows_evaluated"), limit)


def duplicates_found(report: DataFrame) -> DataFrame:
    return report.select("duplicates", F.col("changes.duplicates_removed").alias("removed"))


def table_size(report: DataFrame) -> DataFrame:
    return report.select("rows_evaluated", F.size("columns").alias("columns"))


def asked_column(report: DataFrame, question: str) -> DataFrame:
    """Profile of the first column whose name appears as words in ``question``."""
    columns = report.select(F.inline("profile"))
    text = F.concat(F.lit(" "), norm(F.lit(question)), F.lit(" "))
    named = text.contains(F.concat(F.lit(" "), norm(F.col("column")), F.lit(" ")))
    return with_texts(columns.filter(named).orderBy("position").limit(1))
