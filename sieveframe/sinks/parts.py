"""Delimited text in parts of bounded size, each with its own header."""

from __future__ import annotations

from collections.abc import Sequence

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from sieveframe.functions.cells import column
from sieveframe.plans.clean import COUNTERS, CleanResult
from sieveframe.sources.files import DELIMITERS

# Fixed values.
MAX_PART_BYTES = 40 * 1024**2
LINE_END = "\r\n"
BYTE_ORDER_MARK = "\ufeff"

GROUP_ROWS_BITS = 20  # rows are packed into parts within runs of 2^20 consecutive rows


def csv_field(cell: Column, delimiter: str) -> Column:
    """A cell as written: quoted only if it holds a delimiter, a quote or a line break."""
    special = "[\"\\r\\n\\" + delimiter + "]"
    quoted = F.concat(F.lit('"'), F.replace(cell, F.lit('"'), F.lit('""')), F.lit('"'))
    return F.when(cell.rlike(special), quoted).otherwise(cell)


def csv_line(cells: Sequence[Column], delimiter: str) -> Column:
    if len(cells) == 1:
        return F.when(cells[0] == "", '""').otherwise(csv_field(cells[0], delimiter))
    return F.concat_ws(delimiter, *[csv_field(c, delimiter) for c in cells])


def header_line(names: Sequence[str], delimiter: str) -> str:
    def quoted(name: str) -> str:
        needs = any(ch in name for ch in ('"', "\r", "\n", delimiter)) or (name == "" and len(names) == 1)
        return '"' + name.replace('"', '""') + '"' if needs else name

    return BYTE_ORDER_MARK + delimiter.join(map(quoted, names))


def assign_parts(df: DataFrame, max_bytes: int = MAX_PART_BYTES, sep: str = ",",
                 names: Sequence[str] | None = None, group_rows_bits: int = GROUP_ROWS_BITS) -> DataFrame:
    """``row_id, part, line, line_bytes`` for every row, in input order.

    No part with its header exceeds ``max_bytes``; a row that cannot fit fails the job. Rows are
    packed by a running sum of bytes within runs of consecutive rows (``part_group``), which never
    grow with the table. A row above half the room gets a part of its own; the others are cut at
    multiples of the room less the largest of them, so that parts are filled but never overrun.
    """
    if sep not in DELIMITERS:
        raise ValueError(f"the delimiter must be one of {DELIMITERS}")
    names = list(names or df.columns)
    head = len((header_line(names, sep) + LINE_END).encode())
    room = max_bytes - head
    if room <= 0:
        raise ValueError("the header alone exceeds the size of a part")
    lines = df.select(
        F.monotonically_increasing_id().alias("row_id"),
        csv_line([column(c) for c in df.columns], sep).alias("line"))
    sized = lines.withColumn("line_bytes", F.octet_length("line").cast("bigint") + len(LINE_END))
    fits = F.when(F.col("line_bytes") <= room, F.col("line_bytes")).otherwise(
        F.raise_error("a single row exceeds the size of a part").cast("bigint"))
    grouped = sized.select("row_id", "line", fits.alias("line_bytes"),
                           F.shiftright("row_id", group_rows_bits).alias("part_group"))

    large = F.col("line_bytes") > room // 2
    small_bytes = F.when(large, 0).otherwise(F.col("line_bytes"))
    group = Window.partitionBy("part_group")
    running = group.orderBy("row_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    packed = grouped.select(
        "*", (F.sum(small_bytes).over(running) - small_bytes).alias("start"),
        F.sum(F.when(large, 1).otherwise(0)).over(running).alias("large_before"),
        F.max(small_bytes).over(group).alias("largest"))
    slot = F.when(large, 0).otherwise(1 + F.floor(F.col("start") / (room - F.col("largest"))))
    part = F.concat_ws("-", *[F.lpad(c.cast("string"), width, "0") for c, width in (
        (F.col("part_group"), 12), (F.col("large_before"), 7), (slot, 7))])
    return packed.select("row_id", part.alias("part"), "line", "line_bytes", "part_group")


def write_parts(df: DataFrame, path: str, max_bytes: int = MAX_PART_BYTES, sep: str = ",",
                names: Sequence[str] | None = None, group_rows_bits: int = GROUP_ROWS_BITS) -> None:
    """Write ``path/part=…/``, one file per part; an existing ``path`` is never overwritten.

    ``names`` is the header if it differs from the columns (it may repeat names). One shuffle moves
    rows to their group; the window and the write share its partitioning and order.
    """
    _part_lines(df, max_bytes, sep, names, group_rows_bits).write.mode("errorifexists") \
        .option("lineSep", LINE_END).partitionBy("part").text(path)


def _part_lines(df: DataFrame, max_bytes: int, sep: str, names: Sequence[str] | None, group_rows_bits: int) -> DataFrame:
    """``part, value``: the lines of all parts in order, the first of each with the header before it."""
    names = list(names or df.columns)
    parts = assign_parts(df, max_bytes, sep, names, group_rows_bits)
    before = F.lag("part").over(Window.partitionBy("part_group").orderBy("row_id"))
    first = F.coalesce(before != F.col("part"), F.lit(True))
    head = F.lit(header_line(names, sep) + LINE_END)
    return (parts.select("part", "row_id", F.when(first, F.concat(head, F.col("line"))).otherwise(F.col("line")).alias("value"))
            .sortWithinPartitions("part", "row_id").select("part", "value"))


def write_result(result: CleanResult, path: str, max_bytes: int = MAX_PART_BYTES) -> dict[str, int]:
    """Write what a cleaning operation produced, and return its ``COUNTERS`` with ``rows_exported``.

    The counters come with the write, so the input is read once. Map tasks that are run again after a loss
    of executors count again; the rows that the last stage writes are counted once, and if the two disagree
    the counters are taken anew. The analysis-only operations write nothing.
    """
    if not result.writes:
        raise ValueError("this operation only analyses; it has no output table")
    data, counted = result.observed()
    wrote = Observation()
    lines = _part_lines(data, max_bytes, result.delimiter, result.output_names, GROUP_ROWS_BITS)
    lines.observe(wrote, F.count(F.lit(1)).alias("rows_exported")).write.mode("errorifexists") \
        .option("lineSep", LINE_END).partitionBy("part").text(path)
    return run_counters(result, counted, _observed(wrote, ["rows_exported"])["rows_exported"])


def run_counters(result: CleanResult, counted: Observation, exported: int) -> dict[str, int]:
    """The counters of a run that exported so many rows; taken anew if tasks that were run again counted twice."""
    counters = {**_observed(counted, COUNTERS), "rows_exported": exported}
    if not result.removes_copies and exported != counters["rows_evaluated"]:
        again, counted = result.observed()
        again.write.format("noop").mode("overwrite").save()
        counters |= _observed(counted, COUNTERS)
    return counters


def _observed(counted: Observation, names: Sequence[str]) -> dict[str, int]:
    """What an observation holds after its action; a plan that is known to be empty before it runs drops it."""
    try:
        return dict(counted.get)
    except Py4JJavaError:
        return dict.fromkeys(names, 0)


def part_files(spark: SparkSession, path: str) -> DataFrame:
    """``part, bytes`` of a written output, from the file listing alone."""
    listed = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").option("recursiveFileLookup", True).load(path)
    return listed.select(F.regexp_extract("path", "part=([0-9-]+)", 1).alias("part"), F.col("length").alias("bytes"))
