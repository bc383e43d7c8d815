"""Whole-row operators: empty rows and exact copies."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sieveframe.functions.cells import column, is_blank


def all_of(conditions: Sequence[Column]) -> Column:
    """Their conjunction as a balanced tree: generated code that stops at the first that fails."""
    if len(conditions) == 1:
        return conditions[0]
    half = len(conditions) // 2
    return all_of(conditions[:half]) & all_of(conditions[half:])


def row_is_blank(names: Sequence[str]) -> Column:
    return all_of([is_blank(column(n)) for n in names])


def drop_empty(df: DataFrame, names: Sequence[str] | None = None) -> DataFrame:
    """Rows in which at least one cell holds more than white space."""
    return df.filter(~row_is_blank(names or df.columns))


def fingerprint(df: DataFrame, names: Sequence[str]) -> Column:
    """SHA-256 of a whole row, written so that no two different rows are written alike."""
    def part(name: str) -> Column:
        cell, kind = column(name), df.schema[name].dataType
        if isinstance(kind, (T.FloatType, T.DoubleType)):
            cell = cell + F.lit(0.0).cast(kind)  # one zero
        if not isinstance(kind, T.StringType):
            cell = F.to_json(F.struct(cell.alias("v")))
        return F.coalesce(F.concat(F.octet_length(cell).cast("string"), F.lit(":"), cell), F.lit("-"))

    return F.unhex(F.sha2(F.concat(*[part(n) for n in names]).cast("binary"), 256))


def duplicate_count(df: DataFrame, names: Sequence[str] | None = None) -> DataFrame:
    """How many rows repeat an earlier row in full: ``rows, duplicates``.

    Rows are folded by the 32 bytes of their SHA-256, inside each task before the shuffle, so a row repeated
    very often costs no more than a rare one, and a wide row no more than a narrow one. No two different texts
    with the same digest are known.
    """
    copies = df.select(fingerprint(df, list(names or df.columns)).alias("mark")).groupBy("mark").agg(F.count("*").alias("n"))
    return copies.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"),
                      F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicates"))


def exact_dedup(df: DataFrame, names: Sequence[str] | None = None) -> DataFrame:
    """One copy of every row."""
    return df.dropDuplicates(list(names)) if names else df.dropDuplicates()


def first_copies(df: DataFrame, place: Sequence[str], names: Sequence[str] | None = None) -> DataFrame:
    """The first copy of every row, in order: ``names`` (all others than ``place``) and the columns of ``place``.

    ``place`` names columns whose values put the rows in order and are never equal for two rows. Copies are
    folded inside each task before the shuffle; the result is range-sorted, so its files follow the order.
    """
    names = list(names or [c for c in df.columns if c not in place])
    first = df.groupBy(*[column(n) for n in names]).agg(F.min(F.struct(*map(column, place))).alias("_first"))
    return first.select(*map(column, names), *[F.col("_first")[p].alias(p) for p in place]).orderBy(*map(column, place))
