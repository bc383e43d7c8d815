"""What every column holds: missing cells, kinds of value, exact numeric statistics.

All cells go through one narrow aggregation on ``(position, class)``: rows are turned into cells
inside the task, folded there, and at most six rows per column and task are shuffled, whatever the
size of the table. This also keeps the generated code small for tables of many columns.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sieveframe.functions import cells as C
from sieveframe.sources.tables import SourceTable, as_table

SUMMARY_COLUMNS = 15
_BASE = 10**8  # copies are weighed in two parts, so that products still fit decimal(38,10)
_TOTAL = "decimal(37,10)"

MEASURES = ["missing", "types", "numeric", "number_inexact", "negative", "comma_number", "leading_zero",
            "invalid_date", "min_num", "max_num", "sum_num", "mean_num", "mixed_type"]
# The same statistics as doubles: for numbers and totals that decimal(38,10) cannot hold.
DOUBLES = ["min_double", "max_double", "sum_double", "mean_double"]


def cell_facts(df: DataFrame, names: Sequence[str], weight: Column | None = None,
               row_sums: dict[str, Column] | None = None, cell_sums: dict[str, object] | None = None,
               dropped: Column | None = None) -> DataFrame:
    """One row per ``(position, class)`` with counts and numeric statistics of its cells.

    ``weight`` is the number of copies a row stands for. ``row_sums`` are totalled once per row (at
    position 0), ``cell_sums`` are functions of a cell and are weighted like it. Rows that are ``dropped``,
    which must be blank, only enter the ``row_sums``; they go with ``weight`` unset.
    """
    row_sums, cell_sums = row_sums or {}, cell_sums or {}
    carried = [value.alias(f"row_{name}") for name, value in row_sums.items()]
    if weight is not None:
        carried.append(weight.alias("weight"))
    cells = F.array(*[C.column(n) for n in names])
    if dropped is not None:
        carried.append(dropped.alias("dropped"))
        cells = F.when(dropped, F.array(F.lit(""))).otherwise(cells)
    unpivoted = df.select(*carried, F.posexplode(cells).alias("position", "raw"))
    kept = [F.col(f"row_{name}") for name in row_sums] + ([F.col("weight")] if weight is not None else []) \
        + ([F.col("dropped")] if dropped is not None else [])
    value = unpivoted.select(*kept, "position", "raw", C.blank_to_empty(F.col("raw")).alias("cell"))
    read = value.select(*kept, "position", "raw", "cell", C.exact_number(F.col("cell")).alias("exact"))
    numbers = read.select(*kept, "position", "raw", "cell", "exact",
                          C.cell_class(F.col("cell"), F.col("exact")).alias("class"))

    copies = F.lit(1) if weight is None else F.col("weight")
    counted = F.lit(True) if weight is None else F.col("weight") > 0
    numeric = F.col("class") == C.NUMERIC
    exact = F.when(numeric, F.col("exact"))
    other = F.when(numeric & F.col("exact").isNull(), F.col("cell").try_cast("double"))  # a number all the same
    below_zero = (exact < 0) | (exact.isNull() & F.col("cell").rlike(r"^-[0-9.]*[1-9]"))

    def total(condition: Column | None = None) -> Column:
        share = copies if condition is None else F.when(condition, copies).otherwise(0)
        return F.sum(share).cast("bigint")

    def or_zero(sum_: Column, condition: Column) -> Column:
        """The sum, 0 only if there was nothing to add: a total that overflows stays NULL."""
        return F.when(F.count_if(condition) == 0, F.lit(0).cast(_TOTAL)).otherwise(sum_.try_cast(_TOTAL))

    if weight is None:
        sums = [or_zero(F.try_sum(exact), exact.isNotNull()).alias("sum_num")]
    else:
        low = (copies % _BASE).cast("decimal(9,0)")
        high = F.when(copies >= _BASE, F.floor(copies / _BASE).cast("decimal(9,0)"))
        high_sum = F.try_multiply(F.try_sum(exact * high).try_cast("decimal(28,10)"), F.lit(_BASE).cast("decimal(9,0)"))
        sums = [F.try_add(or_zero(F.try_sum(exact * low), exact.isNotNull()),
                          or_zero(high_sum, exact.isNotNull() & high.isNotNull())).alias("sum_num")]
    sums += [F.sum(other * copies).alias("sum_other"), F.min(F.when(counted, other)).alias("min_other"),
             F.max(F.when(counted, other)).alias("max_other"),
             F.sum(F.coalesce(exact.cast("double"), other) * copies).alias("sum_double")]
    return numbers.groupBy("position", "class").agg(
        total(None if dropped is None else ~F.col("dropped")).alias("cells"),
        total((F.col("class") == C.TEXT) & C.is_comma_number(F.col("cell"))).alias("comma_number"),
        total(numeric & below_zero).alias("negative"),
        total(numeric & exact.isNull()).alias("number_inexact"),
        F.min(F.when(counted, exact)).alias("min_num"),
        F.max(F.when(counted, exact)).alias("max_num"),
        *sums,
        *[total(condition(F.col("raw"))).alias(f"cell_{name}") for name, condition in cell_sums.items()],
        *[F.sum(F.when(F.col("position") == 0, F.col(f"row_{name}"))).cast("bigint").alias(f"row_{name}")
          for name in row_sums])


def fold_facts(facts: DataFrame, names: Sequence[str], sums: Sequence[str] = ()) -> DataFrame:
    """``cell_facts`` as one profile row per column, in table order, plus the named ``sums``."""
    def of_class(kind: str) -> Column:
        return F.coalesce(F.sum(F.when(F.col("class") == kind, F.col("cells"))), F.lit(0))

    def counted(name: str) -> Column:
        return F.coalesce(F.sum(name), F.lit(0))

    per_column = facts.groupBy("position").agg(
        *[of_class(kind).alias(f"n_{kind}") for kind in C.CLASSES],
        *[counted(n).alias(n) for n in ("comma_number", "negative", "number_inexact")],
        F.min("min_num").alias("min_num"), F.max("max_num").alias("max_num"),
        F.max(F.when(F.col("class") == C.NUMERIC, F.col("sum_num"))).alias("sum_num"),  # one row at most
        F.min("min_other").alias("min_other"), F.max("max_other").alias("max_other"),
        F.sum("sum_other").alias("sum_other"), F.sum("sum_double").alias("sum_double"),
        *[counted(n).alias(n) for n in sums])
    # At most MAX_COLUMNS rows on either side; columns of a table without rows are kept.
    listed = facts.sparkSession.range(0, len(names), 1, 1).select(
        F.element_at(F.array(*map(F.lit, names)), (F.col("id") + 1).cast("int")).alias("column"),
        F.col("id").cast("int").alias("position"))
    joined = listed.join(F.broadcast(per_column), "position", "left").fillna(0, [
        *[f"n_{kind}" for kind in C.CLASSES], "comma_number", "negative", "number_inexact", *sums])
    numeric = F.col(f"n_{C.NUMERIC}")
    types = F.map_filter(F.create_map(*[part for kind in C.CLASSES if kind != C.MISSING
                                        for part in (F.lit(kind), F.col(f"n_{kind}"))]), lambda _, n: n > 0)

    def rounded(name: str) -> Column:
        return F.col(name).try_cast("decimal(38,10)")

    def extreme(pick: Callable, name: str, beyond: Column) -> Column:
        """Of the exact and the other numbers; NULL where it is one that the decimal cannot hold."""
        lost = F.col(f"{name}_other").isNotNull() & rounded(f"{name}_other").isNull() & beyond
        return F.when(~lost, pick(F.col(f"{name}_num").cast("decimal(38,10)"), rounded(f"{name}_other"))).alias(f"{name}_num")

    others = F.when(F.col("sum_other").isNull(), F.lit(0).cast("decimal(38,10)")).otherwise(rounded("sum_other"))
    total = F.when(numeric > 0, F.try_add(F.col("sum_num"), others).try_cast("decimal(38,10)"))
    return joined.select(
        "column", "position", F.col(f"n_{C.MISSING}").alias("missing"), types.alias("types"),
        F.col(f"n_{C.NUMERIC}").alias("numeric"), "number_inexact", "negative", "comma_number",
        F.col(f"n_{C.IDENTIFIER}").alias("leading_zero"), F.col(f"n_{C.INVALID_DATE}").alias("invalid_date"),
        extreme(F.least, "min", F.col("min_other") < 0), extreme(F.greatest, "max", F.col("max_other") > 0),
        total.alias("sum_num"),
        F.when(numeric > 0, F.try_divide(total, numeric)).try_cast("decimal(38,10)").alias("mean_num"),
        F.least(F.col("min_num").cast("double"), "min_other").alias("min_double"),
        F.greatest(F.col("max_num").cast("double"), "max_other").alias("max_double"),
        "sum_double", F.when(numeric > 0, F.col("sum_double") / numeric).alias("mean_double"),
        ((F.col(f"n_{C.NUMERIC}") > 0) & (F.col(f"n_{C.TEXT}") > 0)).alias("mixed_type"), *sums)


def profile(source: SourceTable | DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """One row per column of the table as it is; ``columns`` limits the scan to those."""
    table = as_table(source)
    names = list(columns or table.names)
    return fold_facts(cell_facts(table.data, names), names)


def missing_report(profiled: DataFrame, rows: int | Column, limit: int | None = None) -> DataFrame:
    """Columns with missing cells and their share of ``rows`` in percent, in table order.

    ``limit`` (``SUMMARY_COLUMNS`` in a summary) names only the first ones.
    """
    rows = F.lit(rows) if isinstance(rows, int) else rows
    share = F.bround(100 * F.col("missing").cast("double") / F.greatest(rows, F.lit(1)), 1)
    found = profiled.filter("missing > 0").select("column", "position", "missing", share.alias("percent"))
    return found if limit is None else found.orderBy("position").limit(limit)


def invalid_dates(profiled: DataFrame) -> DataFrame:
    return profiled.agg(F.coalesce(F.sum("invalid_date"), F.lit(0)).alias("invalid_dates"))


def mixed_type_columns(profiled: DataFrame) -> DataFrame:
    return profiled.filter("mixed_type").select("column", "position")


def with_texts(profiled: DataFrame) -> DataFrame:
    """A profile with its numbers also as text for reading."""
    texts = [C.number_text(F.col(n)).alias(f"{n}_text") for n in ("min_num", "max_num", "mean_num", "sum_num")]
    return profiled.select("column", *MEASURES, *DOUBLES, *texts)


def column_stats(profiled: DataFrame, name: str) -> DataFrame:
    return with_texts(profiled.filter(F.col("column") == name))
