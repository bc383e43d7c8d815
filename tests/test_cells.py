"""Cell rules against plain Python."""

import datetime as dt
import random
import re
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from sieveframe.functions import cells as C

SEED = 7


def strings(alphabet, count, longest=9):
    chance = random.Random(SEED)
    return ["".join(chance.choice(alphabet) for _ in range(chance.randint(0, longest))) for _ in range(count)]


def test_strip_is_unicode_strip(evaluate):
    values = strings([" ", "\t", "\x0b", "\x1c", "\x1f", "\x85", "\xa0", " ", "　", "​", "a", "é"], 600, 5)
    assert evaluate(C.strip, values) == [v.strip() for v in values]
    assert evaluate(C.is_blank, values) == [not v.strip() for v in values]


def test_white_space_set_is_that_of_python():
    assert set(C.WHITESPACE) == {chr(i) for i in range(0x110000) if chr(i).isspace()}


def number_in_bounds(text):
    if not re.fullmatch(r"[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?", text) or len(text) >= 100:
        return False
    try:
        return abs(Decimal(text).adjusted()) <= 100
    except ArithmeticError:
        return False


def test_numbers(evaluate):
    values = strings("0123456789.eE+-,", 3000) + [
        "1e100", "9.99e100", "1e101", "-1e-100", "1e-101", "0e100", "0e101", "0.00e102", "0.00e103", "1" * 99, "1" * 100,
        "12\n", "1e99999999999", "00", "+.5", "-0", "5.", "0.0000001e-94", "123456789012345678901e80"]
    assert evaluate(C.is_number, values) == [number_in_bounds(v) for v in values]


@pytest.mark.parametrize("value, kind", [
    ("", "missing"), ("007 bond", "possible_identifier"), ("01/02/2025", "possible_identifier"),
    ("001,20", "possible_identifier"), ("0123.5", "possible_identifier"), ("-05", "possible_identifier"),
    ("-0", "number"), ("0,5", "text"), ("1,234", "text"), ("2025-02-28", "iso_date"), ("2025-02-30", "invalid_date"),
    ("2024-02-29T10:11", "iso_date"), ("2025-01-01 25:00", "invalid_date"), ("2025-1-1", "text"), ("n/a", "text"),
    ("0000-01-01", "possible_identifier"), ("1900-01-01 99", "invalid_date"), ("2025-02-28x", "text"), (" 1", "text"),
])
def test_class_ladder(evaluate, value, kind):
    assert evaluate(C.cell_class, [value]) == [kind]


def test_iso_dates_agree_with_the_calendar(evaluate):
    chance = random.Random(SEED)
    values = []
    for _ in range(600):
        text = f"{chance.randint(0, 2100):04d}-{chance.randint(0, 13):02d}-{chance.randint(0, 32):02d}"
        text += chance.choice(["", "T10", "T10:11", " 24:01", "T10:11:12", "T10:11:60", "T10:11:12.5", "T101112", "T10:11Z",
                               "T10:11+03:00", "T10:11-0330", " 10:1", "T", " x"])
        values.append(text)

    def reads(text):
        try:
            return bool(dt.datetime.fromisoformat(text))
        except ValueError:
            return False

    assert evaluate(C.iso_valid, values) == [reads(v) for v in values]


def test_exact_numbers_keep_every_digit(evaluate):
    values = ["1.5", "-12.50", "1e3", "0.12345678901", "1234567890123456789", "123456789012345678.0123456789", ".5", "7."]
    assert evaluate(C.exact_number, values) == [
        Decimal("1.5"), Decimal("-12.50"), None, None, None, Decimal("123456789012345678.0123456789"), Decimal("0.5"),
        Decimal("7")]


def test_guard(evaluate):
    values = ["=1+1", "@x", "+a", "-1.234,56", "-12,50", "-12.50", "+5", "a=1", "", "-", "-1e5"]
    assert evaluate(C.guard, values) == [
        "'=1+1", "'@x", "'+a", "'-1.234,56", "-12,50", "-12.50", "+5", "a=1", "", "'-", "-1e5"]


def test_punctuation(evaluate):
    br = ["1.234,56", "001,20", "1.5", "1.234", "12,5", "-1.234.567,8", "0,5", "1.23,4", "", " ", "12", "1234,5"]
    assert evaluate(lambda c: C.convert_punctuation(c, "br_to_us"), br) == [
        "1234.56", "001,20", "1.5", "1234", "12.5", "-1234567.8", "0.5", "1.23,4", "", " ", "12", "1234.5"]
    us = ["1,234.56", "-12.50", "1,23", "0.5"]
    assert evaluate(lambda c: C.convert_punctuation(c, "us_to_br"), us) == ["1234,56", "-12,50", "1,23", "0,5"]
    with pytest.raises(ValueError):
        C.punctuation_pattern("sideways")


def test_number_text(evaluate):
    values = [Decimal("1234567.891"), Decimal(1200), Decimal(0), None, Decimal("-0.5"), Decimal("100.00005"), Decimal(10) ** 15]
    assert evaluate(C.number_text, values, "decimal(38,10)") == [
        "1.234.567,891", "1.200", "0", "não disponível", "-0,5", "100", "1000000000000000.0000000000"]


def test_doubles_print_like_python(evaluate, spark):
    chance = random.Random(SEED)
    values = [chance.uniform(-1, 1) * 10.0 ** chance.randint(-320, 308) for _ in range(1500)]
    values += [1e7, 1e16, 1e15, 0.001, 1e-4, 1e-5, 0.0, -0.0, 2.0**-44, 8.41e21, 1e23, 123456789.125, 2.2250738585072014e-308]
    assert evaluate(lambda c: C.to_text(c, spark.createDataFrame([], "v double").schema["v"].dataType), values, "double") == [
        repr(v) for v in values]


def test_stringify_typed_table(spark):
    df = spark.createDataFrame(
        [(True, 1.5, None, dt.datetime(2024, 1, 1, 0, 0, 7, 179570), dt.date(2024, 2, 29), Decimal("1.50"), ["a", None, 'q"'],
          {"k": 1}, (1, "é"), 0.1, float("nan")),
         (None, float("inf"), "x", dt.datetime(2024, 1, 1), None, None, None, None, None, -1e20, float("-inf"))],
        "b boolean, d double, s string, t timestamp_ntz, day date, n decimal(5,2), l array<string>, m map<string,int>, "
        "r struct<a:int,`b c`:string>, f float, e double")
    first, second = C.stringify(df).collect()
    assert tuple(first) == ("True", "1.5", "", "2024-01-01T00:00:07.179570", "2024-02-29", "1.50", '["a", null, "q\\""]',
                            '[["k", 1]]', '{"a": 1, "b c": "é"}', "0.10000000149011612", "")
    assert tuple(second)[:4] == ("", "inf", "x", "2024-01-01T00:00:00") and second["e"] == "-inf"
    assert second["f"] == repr(float(__import__("struct").unpack("f", __import__("struct").pack("f", -1e20))[0]))


def test_zoned_times_are_written_in_utc(spark):
    df = spark.sql("select timestamp '2024-06-01 12:00:00.5+02:00' as t")
    assert C.stringify(df).first()[0] == "2024-06-01T10:00:00.500000+00:00"
    assert F is not None
