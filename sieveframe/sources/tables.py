"""Readers: a file or a folder of files becomes a ``SourceTable`` of text columns."""

from __future__ import annotations

import csv
import io
from collections.abc import Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sieveframe.functions.cells import column, stringify
from sieveframe.functions.names import MAX_COLUMNS, check_width, reserve, unique_names, widened_names
from sieveframe.session import written
from sieveframe.sources.files import encoding_of
from sieveframe.sources.records import (DELIMITERS, HEAD_BYTES, MARKS, SENT_SPLITS, UTF8, UTF16, WINDOWS, chosen_delimiter, cut_records,
                                        fold_splits, head_text, is_blank_line, placed_splits, raw_lines, record_width, rows_before)

# Fixed values.
CHARSETS = {UTF8: "UTF-8", UTF16: "UTF-16", WINDOWS: "windows-1252"}
SUFFIX_FORMATS = {".csv": "csv", ".tsv": "tsv", ".parquet": "parquet"}

FREE_TEXT = (T.StringType, T.CharType, T.VarcharType, T.BinaryType)

HEAD_LINES = 1000
PLACES = ("path", "record", "line", "row")  # where a row of a delimited file comes from
WIDTH = "_width"  # fields in the source row, kept beside the cells of ragged formats
RAW = "_raw"


@dataclass(frozen=True)
class SourceTable:
    """A table of text cells with what is known about where it came from."""

    data: DataFrame
    names: list[str]
    originals: list[str]
    header_width: int
    kind: str = "dataframe"
    path: str = ""
    encoding: str = ""
    delimiter: str = ""
    width_column: str | None = None
    stripped: frozenset[str] = frozenset()  # columns whose text cannot have white space at its ends
    warnings: list[str] = field(default_factory=list)
    place_columns: tuple[str, ...] = ()  # file, record and line of each row, if asked for

    @property
    def extra_names(self) -> list[str]:
        return self.names[self.header_width:]


def as_table(source: SourceTable | DataFrame) -> SourceTable:
    """A typed DataFrame as a table of text cells; a ``SourceTable`` is returned as it is."""
    if isinstance(source, SourceTable):
        return source
    names = check_width(unique_names(source.columns))
    renamed = source.toDF(*names)
    stripped = frozenset(f.name for f in renamed.schema.fields if not isinstance(f.dataType, FREE_TEXT))
    return SourceTable(stringify(renamed), names, list(source.columns), len(names), stripped=stripped)


def table_of_fields(df: DataFrame, fields: str, headers: Sequence[str], width: int | None = None) -> SourceTable:
    """Rows held as arrays of strings become a table as wide as its widest row."""
    if width is None:
        width = df.agg(F.max(F.size(fields))).first()[0] or 0
    names = unique_names(headers)
    wide = widened_names(names, max(width, len(names)))
    width_name = reserve(WIDTH, wide)
    cells = [F.coalesce(F.try_element_at(column(fields), F.lit(i)), F.lit("")).alias(name)
             for i, name in enumerate(wide, 1)]
    data = df.select(*cells, F.greatest(F.size(fields), F.lit(0)).alias(width_name))
    return SourceTable(data, wide, [str(h) for h in headers], len(names), "fields", width_column=width_name)


def widen(df: DataFrame, fields: str, headers: Sequence[str], width: int | None = None) -> DataFrame:
    """Only the padded cells of ``table_of_fields``."""
    table = table_of_fields(df, fields, headers, width)
    return table.data.select(*[column(n) for n in table.names])


def irregular(df: DataFrame, fields: str, header_width: int) -> DataFrame:
    """Rows whose number of fields differs from the header's."""
    return df.filter(F.size(fields) != header_width)


def _text_schema(names: Sequence[str]) -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType()) for n in names])


def read_csv(spark: SparkSession, path: str, sep: str | None = None, encoding: str | None = None, strict: bool = True,
             ordered: bool = False, place: bool = False, max_cell_chars: int = -1) -> SourceTable:
    """Delimited text with a header row.

    One scan of the raw lines folds every split of a file to a row (see ``records``) and finds what is left
    open; a second one finds the width of the widest row, so that no field is lost. Blank lines are rows. A
    quote that is never closed, or is followed by text after it closes, is refused; ``strict=False`` reads such
    a file with a warning. With ``place`` the table has columns for the file, the record's number in it (the
    header is 0), its first line (from 1) and the row's number in all files by path (from 1), which come from
    sums over splits and files; ``ordered`` sorts by them. ``max_cell_chars`` bounds a cell.
    """
    if sep is not None and sep not in DELIMITERS:
        raise ValueError(f"the delimiter must be one of {DELIMITERS}")
    if encoding is not None and encoding not in CHARSETS:
        raise ValueError(f"the encoding must be one of {sorted(CHARSETS)}")
    head, charset = _head(spark, path)
    sep = sep or chosen_delimiter(head, True)
    splits = written(placed_splits(fold_splits(raw_lines(spark, path, charset), [sep])), "splits")
    marks = splits if charset is None else fold_splits(raw_lines(spark, path))
    files = splits.groupBy("path").agg(F.bool_and("valid").alias("valid"), F.max_by("ends_inside", "block").alias("unclosed"))
    files = files.join(marks.where("block = 0").select("path", "charset"), "path")
    facts = splits.agg(
        F.max("header").alias("header"), F.count_distinct("header").alias("headers"), F.sum("open_lines").alias("open_lines"),
        F.sum("odd_lines").alias("odd_lines"), F.sum("blanks").alias("blanks")).first()
    kinds = files.agg(F.count_distinct(encoding_of(F.col("charset"), F.col("valid"))).alias("encodings"),
                      F.max(encoding_of(F.col("charset"), F.col("valid"))).alias("encoding"), F.count_if("unclosed").alias("unclosed")).first()
    if not facts["headers"]:
        raise ValueError("the table has no header; nothing was processed")
    if facts["headers"] > 1 or (encoding is None and kinds["encodings"] > 1):
        raise ValueError("the files differ in header or encoding; read them one by one")
    encoding = encoding or kinds["encoding"]
    if encoding == WINDOWS and spark.conf.get("spark.sql.legacy.javaCharsets", "false") != "true":
        raise ValueError("reading windows-1252 needs spark.sql.legacy.javaCharsets=true")
    warnings = [f"{n} {what}" for n, what in ((kinds["unclosed"], "files leave a quote open"),
                                              (facts["odd_lines"], "lines have text after a closing quote")) if n]
    if strict and warnings:
        raise ValueError("; ".join(warnings))

    text = bytes(facts["header"]).decode("utf-8" if charset else CHARSETS[encoding], "replace")
    originals = next(csv.reader(io.StringIO(text, newline=""), delimiter=sep), [])
    names = check_width(unique_names(originals))
    options = {"sep": sep, "quote": '"', "escape": '"', "mode": "PERMISSIVE", "maxCharsPerColumn": max_cell_chars,
               "maxColumns": MAX_COLUMNS + 1}
    whole_lines = not (facts["open_lines"] or facts["odd_lines"] or facts["blanks"] or charset or ordered or place)
    if whole_lines:  # every line is a record, and Spark's reader leaves none out
        reader = spark.read.options(**options, header=True, encoding=CHARSETS[encoding], recursiveFileLookup=True,
                                    columnNameOfCorruptRecord=RAW, columnPruning=False)
        narrow = reader.schema(_text_schema(["c0", RAW])).csv(path)
        width = narrow.agg(F.max(record_width(F.col(RAW), sep)), F.count("c0")).first()[0]
    else:
        lines = raw_lines(spark, path, charset or (CHARSETS[encoding] if encoding == WINDOWS else None))
        records = cut_records(lines, splits, sep).where("record > 0")
        if place:
            before = rows_before(splits)
            records = records.join(F.broadcast(before) if before.count() <= SENT_SPLITS else before, "path") \
                .withColumn("row", F.col("rows_before") + F.col("record"))
        width = records.agg(F.max(record_width(F.col("text"), sep))).first()[0]
    wide = widened_names(names, max(width or 0, len(names)))
    width_name = reserve(WIDTH, wide)
    slots = [f"c{i}" for i in range(len(wide))]
    places = dict(zip(PLACES, (reserve(p, wide) for p in PLACES))) if place else {}
    if whole_lines:
        cells, raw = reader.schema(_text_schema([*slots, RAW])).csv(path), F.col(RAW)
        fields = [F.col(s) for s in slots]
    else:
        # A line of nothing but spaces is a record of its own, which Spark's parser would not see.
        blank, raw = is_blank_line(F.col("text")), F.col("text")
        split_ = F.split(raw, "\\" + sep)
        schema = ", ".join(f"{s} string" for s in slots)
        cells = records.select("*", F.from_csv(raw, schema, options).alias("cells"))
        fields = [F.when(blank, F.get(split_, i)).otherwise(F.col("cells")[s]) for i, s in enumerate(slots)]
        if ordered:
            cells = cells.orderBy("path", "record")
    own = F.when(raw == "", 0).otherwise(record_width(raw, sep))
    data = cells.select(
        *[F.coalesce(f, F.lit("")).alias(name) for f, name in zip(fields, wide)],
        F.coalesce(own, F.lit(len(wide))).alias(width_name),
        *[(F.col(p) + 1 if p == "line" else F.col(p)).alias(name) for p, name in places.items()])
    return SourceTable(data, wide, originals, len(names), "csv", path, encoding, sep, width_name, warnings=warnings,
                       place_columns=tuple(places.values()))


def _head(spark: SparkSession, path: str) -> tuple[str, str | None]:
    """The first lines of one file, 64 KiB at most, and its UTF-16 charset if it has one."""
    line = F.substring(F.col("line").cast("binary"), 1, HEAD_BYTES).alias("line")
    found = raw_lines(spark, path).where("block = 0").select("path", line).head(HEAD_LINES)
    head = b"".join(bytes(r["line"]) for r in found if r["path"] == found[0]["path"])[:HEAD_BYTES]
    return head_text(head), MARKS.get(head[:2])


def in_file_order(df: DataFrame, *position: Column) -> DataFrame:
    """``df`` sorted by file path and ``position`` in the file: a range sort over distinct keys."""
    place = [F.col("_metadata.file_path"), *position]
    keys = [reserve(f"_at_{i}", df.columns) for i in range(len(place))]
    return df.select("*", *[p.alias(k) for p, k in zip(place, keys)]).orderBy(*keys).drop(*keys)


def read_parquet(spark: SparkSession, path: str, ordered: bool = False) -> SourceTable:
    df = spark.read.parquet(path)
    if ordered:
        df = in_file_order(df, F.col("_metadata.row_index"))
    return replace(as_table(df), kind="parquet", path=path)


def read_table(spark: SparkSession, path: str, fmt: str | None = None, sep: str | None = None,
               encoding: str | None = None, strict: bool = True, ordered: bool = False, place: bool = False) -> SourceTable:
    """CSV, TSV or Parquet, told apart by suffix unless ``fmt`` names the format.

    ``ordered`` sorts the rows of several files by path and place, for outputs that must keep that
    order; within one file it is kept anyway. ``place`` adds the place of each row of delimited text.
    """
    if fmt is None:
        fmt = next((f for suffix, f in SUFFIX_FORMATS.items() if path.lower().endswith(suffix)), None)
    if fmt == "parquet":
        return read_parquet(spark, path, ordered)
    if fmt in ("csv", "tsv"):
        return read_csv(spark, path, "\t" if fmt == "tsv" else sep, encoding, strict, ordered, place)
    raise ValueError("the format must be csv, tsv or parquet")
