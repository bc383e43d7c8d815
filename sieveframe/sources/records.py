"""Records of delimited text, found by a scan of quote states that any number of tasks share.

A physical line may begin outside or inside a quoted field, and what it does to that state is a map of two
values to two values. Maps compose, so every split of a file is folded on its own into one small row: where it
ends if it begins outside, and if it begins inside, with the counts that belong to either case. A window over
the splits of each file then says where each one really begins, and how many lines and records lie before it.
With that a second scan cuts records out of raw lines in place: line breaks inside cells, blank lines, line
numbers and quotes that are never closed need no task that reads a file whole. Only what is left of a record
that crosses the end of a split travels to the split it began in.
"""

from __future__ import annotations

import csv
import io
import re
import sys
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Fixed values.
DELIMITERS = [",", ";", "\t", "|"]
HEAD_BYTES = 65536
UTF16, UTF8, WINDOWS = "utf-16", "utf-8-sig", "cp1252"
MARKS = {b"\xff\xfe": "UTF-16LE", b"\xfe\xff": "UTF-16BE"}

SENT_SPLITS = 1 << 20  # rows of facts about splits that are broadcast at most
SENT_RESTS = 10_000  # records across splits whose ends are broadcast at most

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need no copy of this module

# Bits of a line's code: it ends inside a quoted field, or has text after a closing quote, if it begins
# outside (the first of each pair) or inside.
ENDS_OUT, ENDS_IN, ODD_OUT, ODD_IN = 1, 2, 4, 8
PLAIN = ENDS_IN  # a line without a quote leaves the state as it is

SPLITS = ("path string, length long, block long, valid boolean, lines long, blanks long, quotes long, first_line binary, "
          "header binary, charset string, delimiter string, ends array<array<boolean>>, records array<array<long>>, odd array<array<long>>, "
          "opened array<array<long>>")
RECORDS = "path string, record long, line long, kind int, text string"
WHOLE, OPEN, REST = 0, 1, 2  # kinds: a whole record, one that its split does not end, the rest of another split's


def _mark(delimiter: str) -> str:
    return "\\t" if delimiter == "\t" else delimiter


def quoted_field(delimiter: str) -> str:
    """A quoted field with what comes before it; a quote opens one only where a field begins."""
    return f'(^|[{_mark(delimiter)}])"[^"]*+(?:""[^"]*+)*+'


def line_code(line: Column, delimiter: str) -> Column:
    """What a line without its end does to the state, as bits."""
    def ends(text: Column, end: int, odd: int) -> Column:
        # A line break and the closing quote, if there is one, stand for each quoted field.
        left = F.regexp_replace(text, quoted_field(delimiter) + '("?)', "$1\n$2")
        return F.when(left.endswith("\n"), end).otherwise(0) + F.when(left.rlike(f'\n"[^{_mark(delimiter)}]'), odd).otherwise(0)

    code = ends(line, ENDS_OUT, ODD_OUT) + ends(F.concat(F.lit('"'), line), ENDS_IN, ODD_IN)
    return F.when(F.contains(line, F.lit('"')), code).otherwise(PLAIN)


def record_width(record: Column, delimiter: str) -> Column:
    """Fields in one raw record; a quoted field that is never closed ends with it."""
    bare = F.when(F.contains(record, F.lit('"')), F.regexp_replace(record, quoted_field(delimiter) + '(?:"|\\z)', "$1")).otherwise(record)
    return F.length(bare) - F.length(F.replace(bare, F.lit(delimiter), F.lit(""))) + 1


def raw_lines(spark: SparkSession, path: str, charset: str | None = None) -> DataFrame:
    """``path, length, block, line`` with line ends; a lone carriage return ends a line too.

    Lines are those of ``charset``, or raw bytes without one. Only UTF-16 needs it to find them. A byte order
    mark is left out.
    """
    wide = charset is not None and charset.startswith("UTF-16")
    reader = spark.read.option("recursiveFileLookup", True).option("lineSep", "\n")
    value = F.col("value") if charset is None else F.decode(F.col("value").cast("binary"), charset)
    at_start = F.col("_metadata.file_block_start") == 0
    ended = F.concat(F.when(at_start & F.startswith(value, F.lit("\ufeff")), F.substring(value, 2, 1 << 30)).otherwise(value), F.lit("\n"))
    several = F.split(ended, "(?<=\r)(?!\n)")
    lone = F.contains(ended, F.lit("\r")) & ended.rlike("\r(?!\n)")
    return (reader.option("encoding", charset) if wide else reader).text(path).select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("length"),
        F.col("_metadata.file_block_start").alias("block"),
        F.explode(F.when(lone, several).otherwise(F.array(ended))).alias("line"))


def _end_cut(line: Column) -> Column:
    return F.rtrim(line, F.lit("\r\n"))


def is_blank_line(line: Column) -> Column:
    """Nothing but spaces and control characters, tabs included: what Spark's CSV reader would leave out."""
    return line.rlike(r"^[\x00-\x20]*\z")


def states(codes: np.ndarray, begins: bool) -> tuple[np.ndarray, bool]:
    """For each line whether it begins inside a quoted field, and whether the last one ends inside."""
    out, inn = codes & ENDS_OUT > 0, codes & ENDS_IN > 0
    fixed = np.maximum.accumulate(np.where(out == inn, np.arange(len(codes)), -1))  # the last line that decides by itself
    turns = np.cumsum(out & ~inn)
    value = np.where(fixed >= 0, out[fixed], begins) ^ ((turns - np.where(fixed >= 0, turns[fixed], 0)) & 1).astype(bool)
    return np.append(begins, value[:-1]), bool(value[-1]) if len(value) else begins


def field_counts(head: str, delimiter: str, cut: bool) -> list[int]:
    """Fields of each record of the head of a file that holds any; the last one counts only if it is whole."""
    widths = [len(row) for row in csv.reader(io.StringIO(head, newline=""), delimiter=delimiter)]
    return [w for w in (widths[:-1] if cut and len(widths) > 1 else widths) if w]


def consistency(head: str, delimiter: str, cut: bool) -> tuple[float, int, int]:
    """The largest share of records with the same number of fields, two at least; quoted fields; that number."""
    widths = field_counts(head, delimiter, cut)
    share, width = max(((n / len(widths), w) for w, n in Counter(widths).items() if w > 1), default=(0.0, 0))
    mark = re.escape(delimiter)
    return share, len(re.findall(f'(?:^|{mark})"(?:[^"]|"")*+"(?=[\r\n{mark}]|\\Z)', head, re.MULTILINE)), width


def chosen_delimiter(head: str, cut: bool) -> str:
    """The candidate that cuts most records of a file's head alike.

    Of several the one with more quoted fields, then with more fields, then the earlier; if none cuts any
    record, the one seen most often in the first line.
    """
    found = [consistency(head, d, cut) for d in DELIMITERS]
    best = max(range(len(found)), key=lambda k: (found[k], -k))
    if found[best][0] > 0:
        return DELIMITERS[best]
    return max(DELIMITERS, key=next(iter(io.StringIO(head)), "").count)


def head_text(head: bytes) -> str:
    """A file's head as text whose structure can be told: one character for each byte, unless it is UTF-16."""
    if head[:2] in MARKS:
        return head[2:len(head) - len(head) % 2].decode(MARKS[head[:2]], "replace")
    return head.decode("latin-1")


@dataclass
class Split:
    """What is known of a split's lines so far, for each candidate and both ways to begin."""

    path: str
    length: int
    block: int
    candidates: int
    first_candidate: str
    valid: bool = True
    lines: int = 0
    blanks: int = 0
    quotes: int = 0
    head: bytes = b""
    begun: bool = False  # the head holds the whole first record
    ends: list = field(default_factory=list)

    def __post_init__(self):
        self.ends = [[False, True] for _ in range(self.candidates)]
        self.records, self.odd, self.opened = ([[0, 0] for _ in range(self.candidates)] for _ in range(3))

    def add(self, codes: np.ndarray, valid: np.ndarray, blank: np.ndarray, quotes: np.ndarray, heads: pa.Array) -> None:
        self.valid = self.valid and bool(valid.all())
        self.lines += len(codes)
        self.blanks += int(blank.sum())
        self.quotes += int(quotes.sum())
        if self.block == 0 and (len(self.head) < HEAD_BYTES or not self.begun):
            self._read_head(codes, heads)
        for k in range(self.candidates):
            code = codes >> 4 * k & 15
            plain = bool((code == PLAIN).all())
            for begins in (0, 1):
                inside = self.ends[k][begins]
                if plain:
                    self.records[k][begins] += 0 if inside else len(code)
                    self.opened[k][begins] += len(code) if inside else 0
                    continue
                before, self.ends[k][begins] = states(code, inside)
                self.records[k][begins] += int((~before).sum())
                self.odd[k][begins] += int((np.where(before, code & ODD_IN, code & ODD_OUT) > 0).sum())
                self.opened[k][begins] += int(np.append(before[1:], self.ends[k][begins]).sum())

    def _read_head(self, codes: np.ndarray, lines: pa.Array) -> None:
        before, last = states(codes & 15, self.ends[0][0])
        closed = np.flatnonzero(~np.append(before[1:], last))
        least = 0 if self.begun else int(closed[0]) + 1 if len(closed) else len(codes)
        for k, line in enumerate(lines):
            if k >= least and len(self.head) >= HEAD_BYTES:
                break
            self.head += line.as_py()
        self.begun = self.begun or len(closed) > 0

    def row(self) -> tuple:
        first = header = charset = delimiter = None
        if self.block == 0:
            csv.field_size_limit((1 << 31) - 1)
            text, charset = head_text(self.head), MARKS.get(self.head[:2])
            lines = io.StringIO(text, newline="").readlines() or [""]
            delimiter = chosen_delimiter(text, len(self.head) < self.length)
            first, header = (x.rstrip("\r\n").encode("utf-8" if charset else "latin-1") for x in (lines[0], self._first_record(lines)))
        return (self.path, self.length, self.block, self.valid, self.lines, self.blanks, self.quotes, first, header, charset,
                delimiter, self.ends, self.records, self.odd, self.opened)

    def _first_record(self, lines: list[str]) -> str:
        """The first record as candidate 0 cuts it."""
        reader = csv.reader(lines, delimiter=self.first_candidate)
        next(reader, None)
        return "".join(lines[:reader.line_num])


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[int, int]]:
    """Runs of lines of one split."""
    paths = batch.column("path").dictionary_encode().indices.to_numpy()
    blocks = batch.column("block").to_numpy()
    cuts = np.flatnonzero((np.diff(paths, prepend=-1) != 0) | (np.diff(blocks, prepend=-1) != 0))
    yield from zip(cuts.tolist(), [*cuts[1:].tolist(), batch.num_rows])


def _fold(batches: Iterator[pa.RecordBatch], candidates: Sequence[str]) -> Iterator[pa.RecordBatch]:
    split, done = None, []
    for batch in batches:
        codes, quotes = batch.column("codes").to_numpy(), batch.column("quotes").to_numpy()
        valid, blank = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("valid", "blank"))
        for low, high in _runs(batch):
            path, block = batch.column("path")[low].as_py(), batch.column("block")[low].as_py()
            if split is None or (split.path, split.block) != (path, block):
                if split is not None:
                    done.append(split.row())
                split = Split(path, batch.column("length")[low].as_py(), block, len(candidates), candidates[0])
            split.add(codes[low:high], valid[low:high], blank[low:high], quotes[low:high], batch.column("head").slice(low, high - low))
    if split is not None:
        done.append(split.row())
    names = [c.split()[0] for c in SPLITS.split(", ")]
    yield pa.RecordBatch.from_pydict({n: [r[k] for r in done] for k, n in enumerate(names)}, schema=pa.schema([
        ("path", pa.string()), ("length", pa.int64()), ("block", pa.int64()), ("valid", pa.bool_()), ("lines", pa.int64()),
        ("blanks", pa.int64()), ("quotes", pa.int64()), ("first_line", pa.binary()), ("header", pa.binary()), ("charset", pa.string()), ("delimiter", pa.string()),
        ("ends", pa.list_(pa.list_(pa.bool_()))), *[(n, pa.list_(pa.list_(pa.int64()))) for n in ("records", "odd", "opened")]]))


def fold_splits(lines: DataFrame, candidates: Sequence[str] = DELIMITERS) -> DataFrame:
    """One row for each split of ``raw_lines``: what it holds, and where it ends for either way to begin."""
    line = _end_cut(F.col("line"))
    codes = sum((line_code(line, d) * (1 << 4 * k) for k, d in enumerate(candidates)), F.lit(0))
    some = F.contains(line, F.lit('"'))
    quotes = F.when(some, F.octet_length(line) - F.octet_length(F.replace(line, F.lit('"'), F.lit("")))).otherwise(0)
    plain = sum(PLAIN << 4 * k for k in range(len(candidates)))
    return lines.select(
        "path", "length", "block", F.when(some, codes).otherwise(plain).cast("int").alias("codes"), quotes.cast("int").alias("quotes"),
        F.is_valid_utf8("line").alias("valid"), is_blank_line(line).alias("blank"),
        F.coalesce(F.when(F.col("block") == 0, F.col("line").cast("binary")), F.lit(b"")).alias("head")) \
        .mapInArrow(partial(_fold, candidates=list(candidates)), SPLITS)


def placed_splits(splits: DataFrame, candidate: int | Column = 0) -> DataFrame:
    """Splits with how they really begin: ``inside``, and the lines and records of the file before them."""
    def of(name: str) -> Column:
        return F.get(F.col(name), candidate if isinstance(candidate, Column) else F.lit(candidate))

    own = splits.select("*", F.get(of("ends"), 0).alias("_out"), F.get(of("ends"), 1).alias("_in"))
    file = Window.partitionBy("path").orderBy("block")
    so_far, before = file.rowsBetween(Window.unboundedPreceding, 0), file.rowsBetween(Window.unboundedPreceding, -1)
    turned = own.withColumn("_turns", F.sum(F.when(F.col("_out") & ~F.col("_in"), 1).otherwise(0)).over(so_far))
    fixed = F.when(F.col("_out") == F.col("_in"), F.struct(F.col("_out").alias("value"), F.col("_turns").alias("turns")))
    seen = turned.withColumn("_fixed", F.last(fixed, ignorenulls=True).over(before)) \
        .withColumn("_before", F.coalesce(F.lag("_turns").over(file), F.lit(0)))
    odd = (F.col("_before") - F.coalesce(F.col("_fixed.turns"), F.lit(0))) % 2 == 1
    began = seen.withColumn("inside", F.coalesce(F.col("_fixed.value"), F.lit(False)) != odd)

    def actual(name: str) -> Column:
        return F.when(F.col("inside"), F.get(of(name), 1)).otherwise(F.get(of(name), 0))

    counted = began.select(
        *splits.columns[:11], "inside", F.when(F.col("inside"), F.col("_in")).otherwise(F.col("_out")).alias("ends_inside"),
        actual("records").alias("records"), actual("odd").alias("odd_lines"), actual("opened").alias("open_lines"))
    return counted.select("*", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}_before") for c in ("lines", "records")])


def rows_before(splits: DataFrame) -> DataFrame:
    """``path, rows_before``: the records after their header of all files before, by path. One row for each file."""
    files = splits.groupBy("path").agg((F.sum("records") - 1).alias("rows"))
    before = Window.orderBy("path").rowsBetween(Window.unboundedPreceding, -1)
    return files.select("path", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("rows_before"))


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Records in the order of their lines; what is held is the one record that is open."""
    key, pending, begun, kind = None, [], (0, 0), WHOLE
    names = [c.split()[0] for c in RECORDS.split(", ")]

    def given(path: str, record: np.ndarray, line: np.ndarray, kinds: np.ndarray, texts: pa.Array) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(path, pa.string()), len(record)), pa.array(record), pa.array(line),
                                           pa.array(kinds.astype(np.int32)), texts], names)

    def held(open_: bool) -> pa.RecordBatch:
        text = pa.array(["".join(pending)], pa.string())
        found = REST if kind == REST else OPEN if open_ else WHOLE
        return given(key[0], np.array([begun[0]]), np.array([begun[1]]), np.array([found]), text)

    inside, record, line = False, 0, 0
    for batch in batches:
        codes, texts = batch.column("codes").to_numpy(), batch.column("line")
        for low, high in _runs(batch):
            here = (batch.column("path")[low].as_py(), batch.column("block")[low].as_py())
            if here != key:
                if pending:
                    yield held(True)
                key, pending, kind = here, [], WHOLE
                inside = batch.column("inside")[low].as_py()
                record, line = batch.column("records_before")[low].as_py(), batch.column("lines_before")[low].as_py()
                if inside:
                    kind, begun = REST, (record - 1, line)
            before, after = states(codes[low:high], inside)
            part, n = texts.slice(low, high - low), high - low
            starts = np.flatnonzero(~before)
            first = int(starts[0]) if len(starts) else n
            if first:  # lines of the record that was open
                pending += part.slice(0, first).to_pylist()
            if len(starts) or (first and not after):
                if pending:
                    yield held(False)
                pending, kind = [], WHOLE
            closed = starts if not after else starts[:-1]  # the last record is not whole yet
            if len(closed):
                offsets = np.append(closed, n if not after else starts[-1]) - closed[0]
                run = part.slice(int(closed[0]), int(offsets[-1]))
                if len(closed) < len(run):
                    run = pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), run), "")
                yield given(key[0], record + np.arange(len(closed)), line + closed, np.zeros(len(closed)), run)
            if after and len(starts):
                last = int(starts[-1])
                pending, kind, begun = part.slice(last).to_pylist(), WHOLE, (record + len(starts) - 1, line + last)
            inside, record, line = after, record + len(starts), line + n
    if pending:
        yield held(True)


def cut_records(lines: DataFrame, splits: DataFrame, delimiter: str) -> DataFrame:
    """``path, record, line, text`` of every record of ``raw_lines``, counted from 0 in each file, in order.

    ``splits`` are the placed ones, as a written table: one row for each split, so that they are broadcast up
    to ``SENT_SPLITS``. No line travels, but for the ends of records that cross a split.
    """
    facts = splits.agg(F.count(F.lit(1)).alias("n"), F.count_if("inside").alias("crossing")).first()
    places = splits.select("path", "block", "inside", "lines_before", "records_before")
    coded = lines.select("path", "block", "line", line_code(_end_cut(F.col("line")), delimiter).cast("int").alias("codes"))
    coded = coded.join(F.broadcast(places) if facts["n"] <= SENT_SPLITS else places, ["path", "block"])
    found = coded.mapInArrow(_cut, RECORDS)
    text = F.col("text")
    if facts["crossing"]:
        rests = coded.where("inside").mapInArrow(_cut, RECORDS).where(F.col("kind") == REST).groupBy("path", "record").agg(
            F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line", "text"))), lambda x: x["text"]), "").alias("rest"))
        rests = rests.select(F.col("path").alias("_path"), F.col("record").alias("_record"), "rest")
        sent = F.broadcast(rests) if facts["crossing"] <= SENT_RESTS else rests
        crossing = (F.col("kind") == OPEN) & (F.col("path") == F.col("_path")) & (F.col("record") == F.col("_record"))
        found = found.where(F.col("kind") != REST).join(sent, crossing, "left")
        text = F.concat("text", F.coalesce("rest", F.lit("")))
        if facts["crossing"] > SENT_RESTS or facts["n"] > SENT_SPLITS:
            found = found.orderBy("path", "record")
    return found.select("path", "record", "line", F.regexp_replace(text, "(?:\r?\n|\r)\\z", "").alias("text"))
