"""Exact totals of numbers of any size: sums of base-10^9 limbs, free of order and of decimal limits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sieveframe.functions import cells as C
from sieveframe.sources.tables import SourceTable, as_table

DIGITS = 9  # of a limb
_BASE = 10**DIGITS
_SUM = "decimal(28,0)"  # of 10^19 limbs

def limbs(numbers: DataFrame, cell: str) -> DataFrame:
    """The rows with ``place, limb`` of the text ``cell``, whose value is the sum of ``limb * 10^(9 * place)``.

    Each number also has a row with place NULL and limb 1, to be counted by. The digits are moved so that the
    last one stands at a multiple of nine, then cut from the right. Steps are columns of their own: a lambda
    works out what it refers to for each limb anew, unless it is a column.
    """
    text, count = F.lower(F.col(cell)), F.ceil(F.length("_digits") / DIGITS).cast("int")
    mantissa = F.substring_index(text, "e", 1)
    read = numbers.withColumns({
        "_sign": F.when(F.startswith(text, F.lit("-")), -1).otherwise(1), "_mantissa": F.ltrim(mantissa, F.lit("+-")),
        "_exponent": F.when(F.contains(text, F.lit("e")), F.substring_index(text, "e", -1).try_cast("int"))})
    whole = F.substring_index("_mantissa", ".", 1)
    fraction = F.when(F.contains("_mantissa", F.lit(".")), F.substring_index("_mantissa", ".", -1)).otherwise("")
    cut = read.withColumns({"_whole": whole, "_fraction": fraction})
    powers = cut.withColumn("_power", F.coalesce("_exponent", F.lit(0)) - F.length("_fraction"))
    moved = powers.withColumn("_moved", F.pmod("_power", F.lit(DIGITS)))
    digits = moved.withColumn("_digits", F.concat("_whole", "_fraction", F.repeat(F.lit("0"), F.col("_moved"))))
    counted = digits.withColumns({"_count": count, "_lowest": ((F.col("_power") - F.col("_moved")) / DIGITS).cast("int")})
    padded = counted.withColumn("_digits", F.lpad("_digits", F.col("_count") * DIGITS, F.lit("0")))
    each = F.transform(F.sequence(F.lit(0), F.col("_count") - 1), lambda j: F.struct(
        (F.col("_lowest") + F.col("_count") - 1 - j).alias("place"),
        (F.col("_sign") * F.substring("_digits", j * DIGITS + 1, F.lit(DIGITS)).cast("int")).alias("limb")))
    one = F.array(F.struct(F.lit(None).cast("int").alias("place"), F.lit(1).alias("limb")))
    exploded = padded.select(*numbers.columns, F.inline(F.concat(one, each)))
    return exploded.where("place IS NULL OR limb <> 0")


def _carried(sums: Column, lowest: Column, highest: Column, sign: int) -> Column:
    """``(carry, text)`` of the sums: nine digits for each place, and what is left above the highest."""
    zero, base = F.lit(0).cast(_SUM), F.lit(_BASE).cast(_SUM)

    def step(state: Column, place: Column) -> Column:
        value = (F.coalesce(F.try_element_at(sums, place), zero) * sign + state["carry"]).cast(_SUM)
        digits = F.pmod(value, base).cast(_SUM)
        return F.struct(((value - digits) / base).cast(_SUM).alias("carry"),
                        F.concat(F.lpad(digits.cast("string"), DIGITS, "0"), state["text"]).alias("text"))

    return F.aggregate(F.sequence(lowest, highest), F.struct(zero.alias("carry"), F.lit("").alias("text")), step)


def total_text(sums: Column) -> Column:
    """The total of a map of sums by place, as plain decimal text without idle zeros."""
    lowest = F.least(F.coalesce(F.array_min(F.map_keys(sums)), F.lit(0)), F.lit(0))
    highest = F.greatest(F.coalesce(F.array_max(F.map_keys(sums)), F.lit(0)), F.lit(0))
    up, down = _carried(sums, lowest, highest, 1), _carried(sums, lowest, highest, -1)
    negative = up["carry"] < 0
    digits = F.when(negative, F.concat(down["carry"].cast("string"), down["text"])).otherwise(
        F.concat(up["carry"].cast("string"), up["text"]))
    behind = -lowest * DIGITS
    whole = F.regexp_replace(F.substring(digits, F.lit(1), F.length(digits) - behind), "^0+(?=[0-9])", "")
    fraction = F.rtrim(F.substring(digits, F.length(digits) - behind + 1, behind), F.lit("0"))
    return F.concat(F.when(negative, "-").otherwise(""), whole, F.when(fraction != "", F.concat(F.lit("."), fraction)).otherwise(""))


def exact_totals(source: SourceTable | DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """``column, position, numeric, total`` of the columns that hold numbers; the total is exact text.

    Numbers are those of the profile, with any exponent it takes. Limbs are added inside the tasks, so that at
    most some fifty rows for each column and task are shuffled; no order of rows changes a digit.
    """
    table = as_table(source)
    names = list(columns or table.names)
    cells = table.data.select(F.posexplode(F.array(*[C.column(n) for n in names])).alias("position", "raw"))
    value = cells.select("position", C.blank_to_empty(F.col("raw")).alias("cell"))
    numbers = value.where(C.cell_class(F.col("cell"), C.exact_number(F.col("cell"))) == C.NUMERIC)
    # Sums of a task are longs (of 2^33 limbs at most, or the job fails), those of all tasks decimals.
    each = limbs(numbers, "cell").select("position", "place", "limb", F.spark_partition_id().alias("task"))
    tasks = each.groupBy("position", "place", "task").agg(F.sum(F.col("limb").cast("bigint")).alias("sum"))
    sums = tasks.groupBy("position", "place").agg(F.sum(F.col("sum").cast("decimal(19,0)")).cast(_SUM).alias("sum"))
    folded = sums.groupBy("position").agg(
        F.sum(F.when(F.col("place").isNull(), F.col("sum"))).cast("bigint").alias("numeric"),
        F.map_from_entries(F.collect_list(F.when(F.col("place").isNotNull(), F.struct("place", "sum")))).alias("sums"))
    name = F.element_at(F.array(*map(F.lit, names)), F.col("position") + 1)
    return folded.select(name.alias("column"), "position", "numeric", total_text(F.col("sums")).alias("total"))
