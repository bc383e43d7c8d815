"""Column expressions on single cells. Every function is ``Column -> Column``.

Cells are strings and ``''`` is the only missing value; ``stringify`` brings a typed table there.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sieveframe.functions.names import reserve

# The characters that count as white space at the edge of a cell.
WHITESPACE = "".join(
    map(chr, [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B),
              0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))

# The shapes of a cell. ``\z`` and not ``$``, which also matches before a final newline.
LEADING_ZERO = r"^[+-]?0[0-9]"
NUMBER = r"^[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?\z"
COMMA_NUMBER = r"^[+-]?[0-9]+,[0-9]+\z"
ISO_LIKE = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}([ T][^\n]*)?\z"
MAX_NUMBER_LENGTH = 99
MAX_EXPONENT = 100
FORMULA_STARTS = ["=", "@", "+", "-"]

# A number whose digits fit decimal(28,10) without rounding; only these enter sums and extremes.
EXACT_NUMBER = r"^[+-]?([0-9]{1,18}(\.[0-9]{0,10})?|\.[0-9]{1,10})\z"
EXACT_TYPE = T.DecimalType(28, 10)

MISSING, IDENTIFIER, NUMERIC = "missing", "possible_identifier", "number"
ISO_DATE, INVALID_DATE, TEXT = "iso_date", "invalid_date", "text"
CLASSES = [MISSING, IDENTIFIER, NUMERIC, ISO_DATE, INVALID_DATE, TEXT]

DIRECTIONS = {"br_to_us": (",", "."), "us_to_br": (".", ",")}  # decimal mark, thousands mark


def _clock(hour: str, rest: str) -> str:
    fraction = r"([.,][0-9]+)?"
    return f"{hour}({fraction}|:{rest}({fraction}|:{rest}{fraction})|{rest}({fraction}|{rest}{fraction}))"


_HOUR = "([01][0-9]|2[0-3])"
ISO_TIME = rf"^{_clock(_HOUR, '[0-5][0-9]')}(Z|[+-]{_clock(_HOUR, '[0-9]{2}')})?\z"


def strip(cell: Column) -> Column:
    """Remove white space, Unicode kinds included, from both ends."""
    return F.trim(cell, F.lit(WHITESPACE))


def is_blank(cell: Column) -> Column:
    """White space or nothing; looks no further than the first other character."""
    return F.ltrim(cell, F.lit(WHITESPACE)) == ""


def blank_to_empty(cell: Column) -> Column:
    """White space alone counts as missing; other values keep their padding."""
    return F.when(is_blank(cell), "").otherwise(cell)


def _bound(value: Column, function: Callable[[Column], Column]) -> Column:
    """``function(value)`` with ``value`` computed once, however often the function names it.

    For long rules that few cells need: they stay out of the generated code of the common path,
    which the JVM would otherwise refuse to compile for its size.
    """
    return F.get(F.transform(F.array(value), function), F.lit(0))


def _adjusted_exponent(number: Column) -> Column:
    """Decimal exponent of the leading digit, from the text alone; NULL if it is absurdly large."""
    unsigned = F.ltrim(number, F.lit("+-"))
    whole = F.regexp_extract(unsigned, r"^([0-9]*)", 1)
    fraction = F.regexp_extract(unsigned, r"^[0-9]*\.([0-9]*)", 1)
    exponent = F.coalesce(
        F.nullif(F.regexp_extract(unsigned, "[eE]([+-]?[0-9]+)$", 1), F.lit("")), F.lit("0")).try_cast("int")
    significant = F.ltrim(F.concat(whole, fraction), F.lit("0"))
    return F.when(significant == "", exponent.cast("bigint") - F.length(fraction)).otherwise(
        exponent.cast("bigint") + F.length(significant) - F.length(fraction) - 1)


def is_number(cell: Column) -> Column:
    """Plain or scientific number text within bounds of length and magnitude."""
    scientific = cell.contains("e") | cell.contains("E")
    bounded = _bound(cell, lambda c: F.coalesce(F.abs(_adjusted_exponent(c)) <= MAX_EXPONENT, F.lit(False)))
    return cell.rlike(EXACT_NUMBER) | (
        cell.rlike(NUMBER) & (F.length(cell) <= MAX_NUMBER_LENGTH) & F.when(scientific, bounded).otherwise(True))


def iso_valid(cell: Column) -> Column:
    """True for an ISO date, or date and time, that exists in the calendar."""
    day_exists = F.substring(cell, 1, 10).try_cast("date").isNotNull() & ~cell.startswith("0000")
    time_reads = (F.length(cell) == 10) | F.substr(cell, F.lit(12)).rlike(ISO_TIME)
    return cell.rlike(ISO_LIKE) & day_exists & time_reads


def exact_number(cell: Column) -> Column:
    """The value as decimal(28,10) if the text fits it digit for digit, else NULL."""
    return F.when(_may_be_number(cell) & cell.rlike(EXACT_NUMBER), cell.try_cast(EXACT_TYPE))


def _may_be_number(cell: Column) -> Column:
    """Numbers and dates open with a digit, a sign or a mark; plain text is told apart by one byte."""
    return F.substring(cell, 1, 1).between("+", "9")


def cell_class(cell: Column, exact: Column | None = None) -> Column:
    """Observed kind of a cell, one of ``CLASSES``; the first match wins. Nothing is converted.

    ``exact`` is the cell's ``exact_number`` where that is already at hand.
    """
    numeric = is_number(cell) if exact is None else exact.isNotNull() | is_number(cell)
    return (F.when(cell == "", MISSING)
            .when(~_may_be_number(cell), TEXT)
            .when(cell.rlike(LEADING_ZERO), IDENTIFIER)
            .when(numeric, NUMERIC)
            .when(cell.rlike(ISO_LIKE), F.when(iso_valid(cell), ISO_DATE).otherwise(INVALID_DATE))
            .otherwise(TEXT))


def is_comma_number(cell: Column) -> Column:
    return cell.rlike(COMMA_NUMBER)


def needs_guard(cell: Column) -> Column:
    """True when a spreadsheet could run the cell as a formula."""
    opens_formula = reduce(or_, [cell.startswith(mark) for mark in FORMULA_STARTS])
    return opens_formula & ~cell.rlike(NUMBER) & ~is_comma_number(cell)


def guard(cell: Column) -> Column:
    return F.when(needs_guard(cell), F.concat(F.lit("'"), cell)).otherwise(cell)


def punctuation_pattern(direction: str) -> str:
    if direction not in DIRECTIONS:
        raise ValueError(f"direction must be one of {sorted(DIRECTIONS)}")
    mark, thousands = map(re.escape, DIRECTIONS[direction])
    return rf"^[+-]?(0|[1-9][0-9]*|[1-9][0-9]{{0,2}}({thousands}[0-9]{{3}})+)({mark}[0-9]+)?\z"


def convert_punctuation(cell: Column, direction: str) -> Column:
    """Swap the decimal mark and drop thousands marks; text outside the grammar stays as it is."""
    pattern = punctuation_pattern(direction)
    mark, thousands = DIRECTIONS[direction]
    return F.when(cell.rlike(pattern), F.translate(cell, mark + thousands, thousands)).otherwise(cell)


def number_text(number: Column, missing: str = "não disponível") -> Column:
    """At most four decimals, ``.`` for thousands and ``,`` for decimals; huge values stay plain."""
    grouped = F.regexp_replace(F.format_number(number, 4), r"\.?0+$", "")
    return (F.when(number.isNull(), missing)
            .when(F.abs(number) >= F.lit("1e15").cast("decimal(38,10)"), number.cast("string"))
            .otherwise(F.translate(grouped, ",.", ".,")))


def _shortest_scientific(number: Column) -> Column:
    """The fewest of 15, 16 or 17 significant digits that read back as ``number``, as ``d.ddde+XX``."""
    candidates = [F.format_string(f"%.{digits - 1}e", number) for digits in (15, 16)]
    return F.coalesce(*[F.when(c.try_cast("double") == number, c) for c in candidates],
                      F.format_string("%.16e", number))


def _float_text(number: Column, printed: Column | None = None) -> Column:
    """Shortest text of a double: plain from 1e-4 up to 1e16, else with an exponent of two digits or more.

    The runtime's own text (``printed``) serves for most values; only exponents, infinities and long
    texts, which may carry a surplus digit, take the slow branch.
    """
    def rare(scientific: Column) -> Column:
        plain = F.regexp_replace(scientific.try_cast("decimal(38,21)").cast("string"), r"(\.[0-9]+?)0*$", "$1")
        size = F.abs(number)
        return (F.when((size >= 1e-4) & (size < 1e16), plain)
                .otherwise(F.regexp_replace(scientific, r"\.?0+e", "e")))

    if printed is None:
        return _bound(number, lambda x: _float_text(x, x.cast("string")))
    return (F.when(number.isNull() | F.isnan(number), "")
            .when(printed.endswith("Infinity"), F.when(number < 0, "-inf").otherwise("inf"))
            .when((F.length(printed) > 16) | printed.contains("E"), _bound(_shortest_scientific(number), rare))
            .otherwise(printed))


def _clock_text(moment: Column, separator: str) -> Column:
    text = moment.cast("string")
    fraction = F.substring_index(text, ".", -1)
    seconds = F.regexp_replace(F.substring_index(text, ".", 1), " ", separator)
    return F.when(text.contains("."), F.concat(seconds, F.lit("."), F.rpad(fraction, 6, "0"))).otherwise(seconds)


def _moment_text(value: Column, dtype: T.DataType, separator: str) -> Column:
    if isinstance(dtype, T.TimestampType):
        utc = F.convert_timezone(None, F.lit("UTC"), value.cast("timestamp_ntz"))
        return F.concat(_clock_text(utc, separator), F.lit("+00:00"))
    return _clock_text(value, separator)


_MOMENTS = (T.TimestampType, T.TimestampNTZType)
_NESTED = (T.ArrayType, T.MapType, T.StructType)


def _json_text(value: Column, dtype: T.DataType) -> Column:
    """JSON text of a nested value with ``", "`` and ``": "`` between its items."""
    def quoted(text: Column) -> Column:
        single = F.to_json(F.array(text))
        return F.substr(single, F.lit(2), F.length(single) - 2)

    def listed(items: Column) -> Column:
        return F.concat(F.lit("["), F.array_join(items, ", "), F.lit("]"))

    if isinstance(dtype, T.ArrayType):
        text = listed(F.transform(value, lambda item: _json_text(item, dtype.elementType)))
    elif isinstance(dtype, T.MapType):
        text = listed(F.transform(F.map_entries(value), lambda pair: F.concat(
            F.lit("["), _json_text(pair["key"], dtype.keyType), F.lit(", "),
            _json_text(pair["value"], dtype.valueType), F.lit("]"))))
    elif isinstance(dtype, T.StructType):
        members = [F.concat(quoted(F.lit(f.name)), F.lit(": "), _json_text(value[f.name], f.dataType))
                   for f in dtype.fields]
        text = F.concat(F.lit("{"), F.concat_ws(", ", *members), F.lit("}"))
    elif isinstance(dtype, (T.FloatType, T.DoubleType)):
        number = value.cast("double")
        text = (F.when(F.isnan(number), "NaN")
                .otherwise(F.regexp_replace(_float_text(number), "inf$", "Infinity")))
    elif isinstance(dtype, (T.IntegralType, T.BooleanType)):
        text = value.cast("string")
    elif isinstance(dtype, _MOMENTS):
        text = quoted(_moment_text(value, dtype, " "))
    else:
        text = quoted(value.cast("string"))
    return F.when(value.isNull(), "null").otherwise(text)


def to_text(value: Column, dtype: T.DataType) -> Column:
    """One typed value as cell text; missing and NaN become ``''``."""
    if isinstance(dtype, T.StringType):
        text = value
    elif isinstance(dtype, (T.FloatType, T.DoubleType)):
        text = _float_text(value.cast("double"))
    elif isinstance(dtype, T.BooleanType):
        text = F.initcap(value.cast("string"))
    elif isinstance(dtype, _MOMENTS):
        text = _moment_text(value, dtype, "T")
    elif isinstance(dtype, _NESTED):
        text = F.when(value.isNull(), "").otherwise(_json_text(value, dtype))
    else:
        text = value.cast("string")
    return F.coalesce(text, F.lit(""))


def column(name: str) -> Column:
    """A column by its exact name, dots and spaces included."""
    return F.col("`" + name.replace("`", "``") + "`")


def stringify(df: DataFrame) -> DataFrame:
    """Every column as cell text, missing values as ``''``. Flat columns stay within generated code."""
    floats = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.FloatType, T.DoubleType))]
    printed = {name: reserve(f"_text_{i}", df.columns) for i, name in enumerate(floats)}
    staged = df.withColumns({text: column(name).cast("double").cast("string") for name, text in printed.items()})
    return staged.select(*[
        (_float_text(column(f.name).cast("double"), column(printed[f.name])) if f.name in printed
         else to_text(column(f.name), f.dataType)).alias(f.name) for f in df.schema.fields])
