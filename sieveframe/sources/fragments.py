"""Tables that come in pieces, such as those found page by page in a document."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sieveframe.functions.cells import strip
from sieveframe.operators.joins import spread_join
from sieveframe.sources.tables import SourceTable, table_of_fields

FRAGMENT = ["doc", "page", "table_no"]


@dataclass(frozen=True)
class StackedFragments:
    rows: DataFrame      # doc, page, table_no, row_no, header, cells: body rows of accepted documents
    documents: DataFrame  # doc, fragments, pages, pages_without_tables, headers, accepted
    rejected: DataFrame   # documents whose fragments disagree on the header


def header_cells(cells: Column) -> Column:
    """Header texts on one line each, trimmed."""
    return F.transform(cells, lambda c: strip(F.replace(F.coalesce(c, F.lit("")), F.lit("\n"), F.lit(" "))))


def stack_fragments(fragments: DataFrame) -> StackedFragments:
    """Stack the fragments ``(doc, page, table_no, row_no, cells)`` of every document.

    Row 0 of a fragment is its header. A fragment of fewer than two rows is skipped; a page
    without tables is one row with a NULL ``table_no``. A document whose fragments have different
    headers is rejected as a whole.

    Rows meet their header in spread joins, so a document or a fragment that holds most of the rows
    still runs over many tasks.
    """
    found = fragments.filter(F.col("table_no").isNotNull())
    sizes = found.groupBy(*FRAGMENT).agg(F.count("*").alias("size")).filter("size >= 2").select(*FRAGMENT)
    tops = found.filter("row_no = 0").select(*FRAGMENT, header_cells(F.col("cells")).alias("header"))
    pieces = tops.join(sizes, FRAGMENT, "left_semi")  # one row per fragment on either side
    tables = pieces.groupBy("doc").agg(
        F.count("*").alias("fragments"), F.min("header").alias("header"),
        (F.min("header") == F.max("header")).alias("one_header"))
    pages = (fragments.groupBy("doc", "page").agg(F.count("table_no").alias("rows"))
             .groupBy("doc").agg(F.count("*").alias("pages"), F.count_if(F.col("rows") == 0).alias("pages_without_tables")))
    documents = pages.join(tables, "doc", "left").select(
        "doc", F.coalesce("fragments", F.lit(0)).alias("fragments"), "pages", "pages_without_tables", "header",
        F.coalesce("one_header", F.lit(False)).alias("accepted"))
    good = spread_join(pieces, tables.filter("one_header").select("doc"), ["doc"], "left_semi")
    body = spread_join(found.filter("row_no > 0"), good, FRAGMENT)
    rejected = documents.filter("fragments > 0 AND NOT accepted")
    return StackedFragments(body, documents, rejected)


def fragment_table(fragments: DataFrame) -> SourceTable:
    """One table from fragments that must all share one header."""
    stacked = stack_fragments(fragments)
    verdict = stacked.documents.filter("fragments > 0").agg(
        F.min("header").alias("header"), F.max("header").alias("other"), F.bool_and("accepted").alias("accepted"),
        F.sum("fragments").alias("fragments"), F.sum("pages_without_tables").alias("bare_pages")).first()
    if verdict["header"] is None:
        raise ValueError("no table was found in the fragments")
    if not verdict["accepted"] or verdict["header"] != verdict["other"]:
        raise ValueError("the fragments have different headers; separate them first")
    table = table_of_fields(stacked.rows, "cells", verdict["header"])
    note = f"{verdict['fragments']} fragments stacked; {verdict['bare_pages']} pages without tables"
    return SourceTable(table.data, table.names, table.originals, table.header_width, "fragments",
                       width_column=table.width_column, warnings=[note])
