"""Delimited parts laid out over one global order, the same however the input is dealt to tasks.

Each task numbers its own rows as they pass and writes them once, so that their order is settled. What a task
holds folds to one small row; prefix sums over those give every row its number in the whole table and the bytes
before it, without a sort and without a task that sees all rows. Parts are cut from the bytes alone.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext, cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sieveframe.functions.cells import column
from sieveframe.plans.clean import CleanResult
from sieveframe.session import written
from sieveframe.sinks.parts import LINE_END, MAX_PART_BYTES, csv_line, header_line, run_counters
from sieveframe.sources.files import DELIMITERS

FOLDER_BITS = 15  # a folder of a written output holds the files of 2^15 parts at most
SENT_ROWS = 1 << 20  # rows of facts about tasks, or about parts, that are broadcast at most

# A task of its own for each part costs more than a small part; a name counts 1,000 files of a task in order.
SMALL_PART, GROUP_BYTES, GROUP_PARTS, LEAST_GROUPS = 1 << 20, 32 << 20, 1000, 64

NUMBERED = "task long, number long, line_start long, start long, large_before long, line_bytes long, line string"

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need no copy of this module


def _number(batches: Iterator[pa.RecordBatch], half: int) -> Iterator[pa.RecordBatch]:
    """Rows with their number in the task and, before them, all bytes, those of small rows, and large rows (itself included)."""
    task = TaskContext.get().partitionId()
    rows, total, small_total, large_total = 0, 0, 0, 0
    for batch in batches:
        size = batch.column("line_bytes").to_numpy()
        small = np.where(size > half, 0, size)
        ends, small_ends, large = total + size.cumsum(), small_total + small.cumsum(), large_total + (size > half).cumsum()
        yield pa.RecordBatch.from_arrays([
            pa.array(np.full(len(size), task, np.int64)), pa.array(np.arange(rows, rows + len(size))), pa.array(ends - size),
            pa.array(small_ends - small), pa.array(large), batch.column("line_bytes"), batch.column("line")],
            [c.split()[0] for c in NUMBERED.split(", ")])
        if len(size):
            rows, total, small_total, large_total = rows + len(size), int(ends[-1]), int(small_ends[-1]), int(large[-1])


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The text of each part, as one row; what is held is the part that is open."""
    part, folder, held = None, None, []

    def given(done: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({n: [d[k] for d in done] for k, n in enumerate(("part", "folder", "value"))}, schema=pa.schema(
            [("part", pa.int64()), ("folder", pa.string()), ("value", pa.string())]))

    for batch in batches:
        done, numbers, values = [], batch.column("part").to_numpy(), batch.column("value")
        starts = np.flatnonzero(np.diff(numbers, prepend=-1)).tolist()
        for low, high in zip(starts, [*starts[1:], len(numbers)]):
            if part is not None and numbers[low] != part:
                done.append((part, folder, LINE_END.join(held)))
                held = []
            part, folder = int(numbers[low]), batch.column("folder")[low].as_py()
            held += values.slice(low, high - low).to_pylist()
        yield given(done)
    if part is not None:
        yield given([(part, folder, LINE_END.join(held))])


def _head(names: Sequence[str], sep: str) -> str:
    return header_line(names, sep) + LINE_END


def _sent(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= SENT_ROWS else df


def place_lines(df: DataFrame, max_bytes: int = MAX_PART_BYTES, sep: str = ",", names: Sequence[str] | None = None) -> DataFrame:
    """``part, row, first_row, offset, line, line_bytes``: every row's line with its number in the table, the bytes of lines before it, and its part.

    The order is that of the partitions of ``df`` and of the rows in them: of a file as it is scanned, or of what
    ``orderBy`` gives. Rows, offsets and parts count from 0 without gaps. No part with its header exceeds
    ``max_bytes``; a row that cannot fit fails the job. A row above half the room is a part of its own; the
    others are cut where the bytes of such rows reach multiples of the room less the largest of them, so the
    layout depends on the lines alone. The lines are written once under the scratch folder. A null cell is
    empty, as everywhere; an empty table has no line and no part.
    """
    if sep not in DELIMITERS:
        raise ValueError(f"the delimiter must be one of {DELIMITERS}")
    room = max_bytes - len(_head(list(names or df.columns), sep).encode())
    if room <= 0:
        raise ValueError("the header alone exceeds the size of a part")
    cells = [F.coalesce(column(c).cast("string"), F.lit("")) for c in df.columns]
    sized = df.select(csv_line(cells, sep).alias("line")).withColumn(
        "line_bytes", F.octet_length("line").cast("bigint") + len(LINE_END))
    fits = F.when(F.col("line_bytes") <= room, F.col("line_bytes")).otherwise(
        F.raise_error("a single row exceeds the size of a part").cast("bigint"))
    half = room // 2
    lines = written(sized.select("line", fits.alias("line_bytes")).mapInArrow(lambda batches: _number(batches, half), NUMBERED), "lines")

    small = F.when(F.col("line_bytes") <= half, F.col("line_bytes")).otherwise(0)
    tasks = lines.groupBy("task").agg(
        F.count(F.lit(1)).alias("rows"), F.sum("line_bytes").alias("bytes"), F.sum(small).alias("small"),
        F.max("large_before").alias("large"), F.max(small).alias("largest"))
    # One row for each task of the input from here to the join.
    before = Window.orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    facts = written(tasks.select("task", F.max("largest").over(Window.partitionBy()).alias("largest"), *[
        F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}_before_task") for c in ("rows", "bytes", "small", "large")]), "tasks")
    found = lines.join(_sent(facts, facts.count()), "task")
    large = F.col("line_bytes") > half
    turn = F.col("large_before") + F.col("large_before_task")
    slot = F.when(large, 0).otherwise(1 + F.floor((F.col("start") + F.col("small_before_task")) / (room - F.col("largest"))))
    placed = found.select(
        (F.col("number") + F.col("rows_before_task")).alias("row"), (F.col("line_start") + F.col("bytes_before_task")).alias("offset"),
        turn.alias("turn"), slot.cast("bigint").alias("slot"), "line", "line_bytes")
    # One row for each part.
    parts = placed.groupBy("turn", "slot").agg(F.min("row").alias("first_row"))
    numbered = written(parts.select("*", (F.row_number().over(Window.orderBy("first_row")) - 1).cast("bigint").alias("part")), "parts")
    return placed.join(_sent(numbered, numbered.count()), ["turn", "slot"]).select(
        "part", "row", "first_row", "offset", "line", "line_bytes")


def part_layout(placed: DataFrame) -> DataFrame:
    """``part, rows, first_row, last_row, first_byte, bytes`` of every part; bytes are those of its lines, without the header."""
    return placed.groupBy("part").agg(
        F.count(F.lit(1)).alias("rows"), F.min("row").alias("first_row"), F.max("row").alias("last_row"),
        F.min("offset").alias("first_byte"), F.sum("line_bytes").alias("bytes"))


def write_in_order(df: DataFrame, path: str, max_bytes: int = MAX_PART_BYTES, sep: str = ",",
                   names: Sequence[str] | None = None) -> DataFrame:
    """Write one file for each part and return the ``part_layout``; an existing ``path`` is never overwritten.

    Folders ``folder=00000``, ``folder=00001`` … hold 2^15 files each, and file names sort in the order of the rows.
    One shuffle moves lines to the task of their part; a task sorts its lines, on disk where they are many. Parts of
    1 MiB at most share tasks, in runs of consecutive ones, and each is joined in memory. An empty table writes no file.
    """
    names = list(names or df.columns)
    placed = place_lines(df, max_bytes, sep, names)
    layout = part_layout(placed)
    last = layout.agg(F.max("part").alias("last")).first()["last"]
    parts = (last if last is not None else -1) + 1
    value = F.when(F.col("row") == F.col("first_row"), F.concat(F.lit(_head(names, sep)), F.col("line"))).otherwise(F.col("line"))
    lines = placed.select("part", _folder(F.col("part")).alias("folder"), "row", value.alias("value"))
    if max_bytes <= SMALL_PART:
        share = max(1, min(GROUP_BYTES // max_bytes, GROUP_PARTS, parts // LEAST_GROUPS))
        group = F.floor(F.col("part") / share).cast("int")
        whole = lines.repartitionById(max(1, -(-parts // share)), group).sortWithinPartitions("part", "row") \
            .mapInArrow(_joined, "part long, folder string, value string")
        sink = whole.sortWithinPartitions("folder", "part").select("folder", "value").write.option("maxRecordsPerFile", 1)
    else:
        tasks = max(1, min(parts, 1 << FOLDER_BITS))
        sink = (lines.repartitionById(tasks, (F.col("part") % (1 << FOLDER_BITS)).cast("int"))
                .sortWithinPartitions("folder", "row").select("folder", "value").write)
    sink.mode("errorifexists").option("lineSep", LINE_END).partitionBy("folder").text(path)
    return layout


def write_result_in_order(result: CleanResult, path: str, max_bytes: int = MAX_PART_BYTES) -> dict[str, int]:
    """``write_in_order`` of what a cleaning operation produced; returns the counters of ``write_result``.

    The counters come with the one pass over the input that writes its lines.
    """
    if not result.writes:
        raise ValueError("this operation only analyses; it has no output table")
    data, counted = result.observed()
    layout = write_in_order(data, path, max_bytes, result.delimiter, result.output_names)
    exported = layout.agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("rows")).first()["rows"]
    return run_counters(result, counted, exported)


def _folder(part: Column) -> Column:
    return F.lpad(F.shiftright(part, FOLDER_BITS).cast("string"), 5, "0")
