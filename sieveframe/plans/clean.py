"""The named cleaning and profiling operations, each a lazy plan over one table."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from sieveframe.functions import cells as C
from sieveframe.functions.names import unique_names
from sieveframe.functions.text import COMMAND_OPERATIONS, DIRECTION_NAMES
from sieveframe.operators.profile import DOUBLES, MEASURES, cell_facts, fold_facts
from sieveframe.operators.rows import duplicate_count, exact_dedup, row_is_blank
from sieveframe.sources.files import DELIMITERS
from sieveframe.sources.tables import SourceTable, as_table


@dataclass(frozen=True)
class Operation:
    """What an operation does to rows; everything else it leaves alone."""

    trim: bool = False
    drop_empty: bool = False
    rename: bool = False
    dedup: bool = False
    guard: bool = False
    convert: bool = False
    writes: bool = True
    delimiter: str | None = None


OPERATIONS = {
    "tidy": Operation(trim=True, drop_empty=True, rename=True, guard=True, delimiter=","),
    "headers": Operation(rename=True),
    "trim": Operation(trim=True),
    "drop_empty": Operation(drop_empty=True),
    "dedup": Operation(dedup=True),
    "delimiter": Operation(),
    "punctuation": Operation(convert=True),
    "profile": Operation(writes=False),
    "missing": Operation(writes=False),
    "duplicates": Operation(writes=False),
}


class CleanResult:
    """``data`` is a narrow plan (one shuffle if it removes copies); ``report`` is one row.

    ``data`` carries unique names; ``output_names`` are those of the written header, which may repeat.
    ``report`` holds the profile too, from one pass over the cells, and counts copies by digests of the
    rows; whole rows are shuffled only to remove copies. ``profile`` is that pass alone. Both are planned when
    first asked for. ``observed`` is ``data`` with counters that come with whatever reads it.
    """

    def __init__(self, data: DataFrame, output_names: list[str], make_report: Callable[[], DataFrame],
                 delimiter: str, writes: bool, header_map: list[tuple[int, str, str]],
                 make_profile: Callable[[], DataFrame] | None = None,
                 make_observed: Callable[[], tuple[DataFrame, Observation]] | None = None,
                 removes_copies: bool = False) -> None:
        self.data, self.output_names, self.delimiter = data, output_names, delimiter
        self.writes, self.header_map, self.removes_copies = writes, header_map, removes_copies
        self._make_report, self._make_profile, self._make_observed = make_report, make_profile, make_observed

    @cached_property
    def report(self) -> DataFrame:
        return self._make_report()

    @cached_property
    def profile(self) -> DataFrame:
        """One row per column of the cleaned table, before formulas are guarded."""
        if self._make_profile is None:
            return self.report.select(F.inline("profile"))
        return self._make_profile()


    def observed(self) -> tuple[DataFrame, Observation]:
        """``data`` once more, and an observation that holds its ``COUNTERS`` after the first action on it.

        Tasks that are run again, after executors were lost, count again; see ``write_result``.
        """
        if self._make_observed is None:
            raise ValueError("this result has no counters")
        return self._make_observed()


COUNTERS = ["rows_read", "empty_rows_found", "rows_evaluated", "irregular_rows", "trimmed", "punctuation", "ignored_conversions",
            "formula_guarded"]


def resolve(operation: str) -> str:
    name = COMMAND_OPERATIONS.get(operation, operation)
    if name not in OPERATIONS:
        raise ValueError(f"unknown operation {operation!r}; use one of {sorted(OPERATIONS)}")
    return name


def header_map(originals: list[str], targets: list[str]) -> list[tuple[int, str, str]]:
    return [(i, source, target) for i, (source, target) in enumerate(zip(originals, targets))]


def header_frame(df: DataFrame) -> DataFrame:
    """``position, source, target`` for the columns of ``df``."""
    pairs = header_map(df.columns, unique_names(df.columns))
    return df.sparkSession.createDataFrame(pairs, "position int, source string, target string")


def _check(table: SourceTable, op: Operation, delimiter: str | None, column: str | None,
           direction: str | None) -> str:
    chosen = op.delimiter or delimiter or table.delimiter or ","
    if chosen not in DELIMITERS:
        raise ValueError(f"the delimiter must be one of {DELIMITERS}")
    if op.convert:
        if column not in table.names[:table.header_width]:
            raise ValueError(f"column not found; use one of {table.names[:table.header_width]}")
        C.punctuation_pattern(direction)
    return chosen


def row_steps(table: SourceTable, op: Operation, column: str | None = None, direction: str | None = None) -> DataFrame:
    """The transformed cells with what was changed in each row: a projection, no shuffle.

    Counters of a row that is wholly empty and dropped are not kept, as it is never looked at.
    """
    def changed(name: str) -> Column:
        return F.when(C.strip(C.column(name)) != C.column(name), 1).otherwise(0)

    padded = [n for n in table.names if n not in table.stripped]
    values, converted, ignored = [], F.lit(0), F.lit(0)
    for name in table.names:
        cell = C.strip(C.column(name)) if op.trim and name in padded else C.column(name)
        if op.convert and name == column:
            matches = cell.rlike(C.punctuation_pattern(direction))
            new = C.convert_punctuation(cell, direction)
            converted = F.when(new != cell, 1).otherwise(0)
            ignored = F.when((cell != "") & ~matches, 1).otherwise(0)
            cell = new
        values.append(cell.alias(name))
    trimmed = sum(map(changed, padded), F.lit(0)) if op.trim else F.lit(0)
    odd = (F.when(C.column(table.width_column) != table.header_width, 1).otherwise(0)
           if table.width_column else F.lit(0))
    return table.data.select(*values, trimmed.cast("bigint").alias("_trimmed"), converted.alias("_converted"),
                             ignored.alias("_ignored"), odd.alias("_irregular"))


def clean(source: SourceTable | DataFrame, operation: str = "tidy", *, deduplicate: bool = False,
          delimiter: str | None = None, column: str | None = None, direction: str | None = None) -> CleanResult:
    """Apply one named operation to a table; values are never filled in or guessed.

    ``deduplicate`` also removes exact copies, ``delimiter`` is that of the output, ``column`` and
    ``direction`` (``br_to_us`` or ``us_to_br``) belong to ``punctuation``. Nothing runs until the
    data or the report is asked for.
    """
    name = resolve(operation)
    op = OPERATIONS[name]
    table = as_table(source)
    direction = DIRECTION_NAMES.get(direction, direction)
    out_delimiter = _check(table, op, delimiter, column, direction)
    dedup = deduplicate or op.dedup
    names = table.names
    targets = names if op.rename else [*table.originals, *table.extra_names]

    steps = row_steps(table, op, column, direction)
    blank = row_is_blank(names)

    def cleaned(rows: DataFrame) -> DataFrame:
        data = rows.filter(~blank) if op.drop_empty else rows
        data = data.select(*[C.column(n) for n in names])
        if dedup:
            data = exact_dedup(data)
        return data.select(*[C.guard(C.column(n)).alias(n) for n in names]) if op.guard else data

    mapping = header_map(table.originals, targets)
    changed_headers = sum(a != b for a, b in zip(table.originals, names)) if op.rename else 0
    options = {k: v for k, v in (("delimiter", delimiter), ("column", column), ("direction", direction)) if v}

    def make_report() -> DataFrame:
        return _report(table, steps, name, op, dedup, blank, options, out_delimiter, changed_headers)

    def make_observed() -> tuple[DataFrame, Observation]:
        counted = Observation()
        return cleaned(steps.observe(counted, *_counters(steps, op, blank, names))), counted

    def make_profile() -> DataFrame:
        kept = steps.filter(~blank) if op.drop_empty else steps
        return fold_facts(cell_facts(kept, names), names).select("column", "position", *MEASURES, *DOUBLES)

    return CleanResult(cleaned(steps), targets, make_report, out_delimiter, op.writes, mapping, None if dedup else make_profile,
                       make_observed, dedup)


def _counters(steps: DataFrame, op: Operation, blank: Column, names: list[str]) -> list[Column]:
    """The ``COUNTERS`` as aggregates over the rows of ``steps``, before copies are removed."""
    kept = ~blank if op.drop_empty else F.lit(True)

    def total(value: Column) -> Column:
        return F.coalesce(F.sum(F.when(kept, value).otherwise(0).cast("bigint")), F.lit(0))

    guards = [F.when(C.needs_guard(C.column(n)), 1).otherwise(0) for n in names] if op.guard else []
    values = [F.count(F.lit(1)), F.count_if(blank), total(F.lit(1)), total(F.col("_irregular")), total(F.col("_trimmed")),
              total(F.col("_converted")), total(F.col("_ignored")), total(sum(guards, F.lit(0)))]
    return [value.alias(name) for name, value in zip(COUNTERS, values)]


def _report(table: SourceTable, steps: DataFrame, name: str, op: Operation, dedup: bool, blank: Column,
            options: dict[str, str], delimiter: str, changed_headers: int) -> DataFrame:
    """Counters and profile in one pass over the cells; copies are counted by digests of the rows.

    With copies removed, they are folded first and every distinct row is weighed.
    """
    counters = ["_trimmed", "_converted", "_ignored", "_irregular"]
    guarded = {"guarded": C.needs_guard} if op.guard else {}
    if dedup:
        distinct = steps.groupBy(*[C.column(n) for n in table.names]).agg(
            F.count("*").alias("_n"), *[F.sum(c).alias(c) for c in counters])
        distinct = distinct.withColumn("_blank", blank)
        kept = ~F.col("_blank") if op.drop_empty else F.lit(True)
        weight = F.when(kept, F.lit(1)).otherwise(0).cast("bigint")
        rows = {
            "read": F.col("_n"), "evaluated": weight,
            "empty": F.when(F.col("_blank"), F.col("_n")).otherwise(0),
            "duplicates": F.when(kept, F.col("_n") - 1).otherwise(0),
            **{c.strip("_"): F.when(kept, F.col(c)).otherwise(0) for c in counters},
        }
        facts = cell_facts(distinct, table.names, weight, rows, guarded)
    else:
        marked = steps.withColumn("_blank", blank)
        kept = ~F.col("_blank") if op.drop_empty else F.lit(True)
        rows = {"read": F.lit(1), "evaluated": F.when(kept, 1).otherwise(0), "empty": F.when(F.col("_blank"), 1).otherwise(0),
                **{c.strip("_"): F.when(kept, F.col(c)).otherwise(0) for c in counters}}
        facts = cell_facts(marked, table.names, None, rows, guarded, F.col("_blank") if op.drop_empty else None)
    sums = [*[f"row_{r}" for r in rows], *[f"cell_{g}" for g in guarded]]
    folded = fold_facts(facts, table.names, sums)

    totals = folded.agg(
        *[F.sum(s).alias(s) for s in sums], F.sum("invalid_date").alias("invalid_dates"),
        F.array_sort(F.collect_list(F.struct("column", "position", *MEASURES, *DOUBLES)),
                     lambda a, b: a["position"] - b["position"]).alias("profile"))
    if not dedup:
        copies = duplicate_count(steps.filter(~blank) if op.drop_empty else steps, table.names)
        totals = totals.withColumn("_one", F.lit(1)).join(
            copies.select(F.col("duplicates").alias("row_duplicates"), F.lit(1).alias("_one")), "_one")
    guarded_total = F.col("cell_guarded") if guarded else F.lit(0).cast("bigint")
    removed = F.col("row_empty") if op.drop_empty else F.lit(0).cast("bigint")
    duplicates_removed = F.col("row_duplicates") if dedup else F.lit(0).cast("bigint")
    exported = F.col("row_evaluated") if op.writes else F.lit(0).cast("bigint")

    def texts(values: list[str]) -> Column:
        return F.array(*map(F.lit, values)).cast("array<string>")

    changes = F.struct(
        F.lit(changed_headers).alias("headers"), F.col("row_trimmed").alias("trimmed"),
        removed.alias("empty_rows"), guarded_total.alias("formula_guarded"),
        duplicates_removed.alias("duplicates_removed"), F.col("row_converted").alias("punctuation"))
    return totals.select(
        F.lit(table.path).alias("source"), F.lit(name).alias("operation"),
        F.create_map(*[F.lit(p) for pair in options.items() for p in pair]).cast("map<string,string>").alias("options"),
        F.lit(delimiter).alias("out_delimiter"), F.col("row_ignored").alias("ignored_conversions"),
        F.lit(op.writes).alias("wrote_csv"), F.col("row_empty").alias("empty_rows_found"),
        F.col("row_read").alias("rows_read"), exported.alias("rows_exported"),
        F.col("row_evaluated").alias("rows_evaluated"), F.col("row_duplicates").alias("duplicates"),
        F.col("row_irregular").alias("irregular_rows"), texts(table.names).alias("columns"),
        F.lit(table.encoding).alias("encoding"), F.lit(table.delimiter).alias("delimiter"),
        changes.alias("changes"), texts(table.warnings).alias("warnings"), "invalid_dates",
        (F.col("row_trimmed") + guarded_total + F.col("row_converted")).alias("values_changed"), "profile")


def reconcile(report: DataFrame) -> DataFrame:
    """The report, failing if rows read differ from rows kept and removed."""
    accounted = F.col("rows_evaluated") + F.col("changes.empty_rows") + F.col("changes.duplicates_removed")
    verdict = F.when(F.col("rows_read") == accounted, True).otherwise(
        F.raise_error("rows read do not match rows kept and removed").cast("boolean"))
    return report.withColumn("reconciled", verdict)
