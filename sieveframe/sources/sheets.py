"""Several named tables as one."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sieveframe.functions.cells import column
from sieveframe.functions.names import check_width, reserve
from sieveframe.operators.rows import row_is_blank
from sieveframe.sources.tables import WIDTH, SourceTable, as_table

SHEET_KEY = "_sheet"


def sheet_table(sheets: dict[str, DataFrame], key: str = SHEET_KEY) -> SourceTable:
    """Union of the sheets' columns in first-seen order, with the sheet's name in the last column.

    A column a sheet lacks is empty there. A row that is wholly blank stays as an empty row
    without a sheet name, and counts as one of irregular width.
    """
    tables = {title: as_table(df) for title, df in sheets.items()}
    originals: dict[str, str] = {}
    for table in tables.values():
        for name, original in zip(table.names, table.originals):
            originals.setdefault(name, original)
    key = reserve(key, originals)
    names = check_width([*originals, key])
    width_name = reserve(WIDTH, names)

    def titled(title: str, df: DataFrame, own: list[str]) -> DataFrame:
        blank = row_is_blank(own)
        cells = [F.when(blank, "").otherwise(column(n)).alias(n) for n in own]
        return df.select(*cells, F.when(blank, "").otherwise(F.lit(title)).alias(key),
                         F.when(blank, 0).otherwise(len(names)).alias(width_name))

    union = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True),
                   [titled(title, t.data, t.names) for title, t in tables.items()])
    data = union.select(*[F.coalesce(column(n), F.lit("")).alias(n) for n in names], column(width_name))
    return SourceTable(data, names, [*originals.values(), key], len(names), "sheets", width_column=width_name)


def sheet_union(sheets: dict[str, DataFrame], key: str = SHEET_KEY) -> DataFrame:
    """Only the cells of ``sheet_table``."""
    table = sheet_table(sheets, key)
    return table.data.select(*[column(n) for n in table.names])
