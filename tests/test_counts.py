"""Copies by fingerprint, counters that come with a write, and exact totals."""

import random
from decimal import Decimal, getcontext

import pytest
from pyspark.sql import functions as F

from sieveframe import clean
from sieveframe.operators import rows as R
from sieveframe.operators.totals import exact_totals
from sieveframe.sinks.parts import write_result


def copies(df, names=None):
    return tuple(R.duplicate_count(df, names).first())


CELLS = [("a", None), (None, "a"), ("a", None), ("", "a"), ("b", "c"), ("bc", ""), ("b", "c"), ("b", "c")]


def test_copies(spark):
    df = spark.createDataFrame(CELLS, "x string, y string")
    assert copies(df) == (8, 3) and copies(df, ["y"]) == (8, 8 - 4)
    assert copies(df.limit(0)) == (0, 0)
    assert copies(spark.createDataFrame([("a", "a", 1.5)], "x string, _mark string, z double")) == (1, 0)


def test_rows_that_look_alike_are_no_copies(spark):
    df = spark.createDataFrame([("1:a", ""), ("1", ":a"), ("", "1:a"), (None, "1:a"), ("-", None), (None, "-")], "x string, y string")
    assert copies(df) == (6, 0)
    typed = spark.createDataFrame([(1, 0.0, ["a, b"]), (1, -0.0, ["a, b"]), (1, 0.0, ["a", "b"]), (None, float("nan"), None), (None, float("nan"), None)],
                                  "i int, d double, l array<string>")
    assert copies(typed) == (5, 2)


def test_reports_shuffle_no_rows(spark):
    df = spark.range(100).select(*[F.concat(F.lit("v"), (F.col("id") % 90).cast("string")).alias(f"c{i}") for i in range(8)])
    for name in ("missing", "profile", "headers", "tidy"):
        report = clean(df, name).report
        plan = report._jdf.queryExecution().executedPlan().toString()
        keys = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
        whole = [line for line in keys if "c0#" in line and "c7#" in line]
        assert not whole
        assert report.first()["duplicates"] == 10


def test_counters_come_with_the_write(spark, tmp_path):
    df = spark.createDataFrame([(" a", "=1+1"), ("a", "=1+1"), ("", " "), ("a", "=1+1"), ("-5", "x ")], "k string, v string")
    found = write_result(clean(df, "tidy"), str(tmp_path / "tidy"))
    assert found == {"rows_read": 5, "empty_rows_found": 1, "rows_evaluated": 4, "irregular_rows": 0, "trimmed": 2, "punctuation": 0,
                     "ignored_conversions": 0, "formula_guarded": 3, "rows_exported": 4}
    report = clean(df, "tidy").report.first()
    assert {k: report[k] for k in ("rows_read", "empty_rows_found", "rows_evaluated", "rows_exported")} == {
        k: found[k] for k in ("rows_read", "empty_rows_found", "rows_evaluated", "rows_exported")}
    assert write_result(clean(df, "dedup"), str(tmp_path / "dedup"))["rows_exported"] == 4
    nothing = write_result(clean(df.limit(0), "tidy"), str(tmp_path / "none"))
    assert set(nothing.values()) == {0}


def test_the_input_is_read_once(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)
    spark.range(50).select(F.col("id").cast("string").alias("k")).write.parquet(str(tmp_path / "in"))

    def count(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    df = spark.read.parquet(str(tmp_path / "in")).mapInArrow(count, "k string")
    assert write_result(clean(df, "tidy"), str(tmp_path / "out"))["rows_read"] == 50
    assert seen.value == 50


def test_counters_that_disagree_are_taken_anew(spark, tmp_path, monkeypatch):
    """As if a map task had run twice: its first counts are thrown away."""
    result = clean(spark.createDataFrame([("a",), ("b",)], "k string"), "tidy")
    honest = result._make_observed
    calls = []

    def doubled():
        calls.append(1)
        data, counted = honest()
        if len(calls) == 1:
            class Doubled:
                @property
                def get(self):
                    return {k: 2 * v for k, v in counted.get.items()}
            return data, Doubled()
        return data, counted

    result._make_observed = doubled
    assert write_result(result, str(tmp_path / "out"))["rows_evaluated"] == 2 and len(calls) == 2


def test_exact_totals(spark):
    getcontext().prec = 400
    rng = random.Random(9)

    def number():
        digits = "".join(rng.choices("0123456789", k=rng.randint(1, 30))).lstrip("0") or "0"
        text = rng.choice(["", "-", "+"]) + digits + rng.choice(["", ".", ".5", ".000125", f".{rng.randrange(10**9)}"])
        return text + rng.choice(["", "", f"e{rng.randint(-60, 60)}", f"E+{rng.randint(0, 50)}"])

    cells = [number() for _ in range(300)] + ["1e90", "-1e90", "0", "-0.0", "1e-90", "n/a", "", "007"]
    df = spark.createDataFrame([(c, "5", "x", "-0.10") for c in cells], "a string, b string, c string, d string").repartition(5)
    found = {r["column"]: r for r in exact_totals(df).collect()}
    expected = sum(Decimal(c) for c in cells[:305])
    assert Decimal(found["a"]["total"]) == expected and found["a"]["numeric"] == 305 and "e" not in found["a"]["total"].lower()
    assert found["b"]["total"] == str(5 * len(cells)) and "c" not in found
    assert Decimal(found["d"]["total"]) == Decimal("-0.1") * len(cells) and not found["d"]["total"].endswith("0")


@pytest.mark.parametrize("cells,total", [(["0"], "0"), (["-0"], "0"), (["0.5", "-0.5"], "0"), (["1e12", "-1"], "999999999999"),
                                         (["-1e-12"], "-0.000000000001"), (["1e50", "1e-50", "-1e50"], "0." + "0" * 49 + "1"), (["-999999999", "-1"], "-1000000000")])
def test_totals_in_plain_text(spark, cells, total):
    assert exact_totals(spark.createDataFrame([(c,) for c in cells], "v string")).first()["total"] == total




def test_a_number_is_taken_apart_once(spark):
    """Not again for each of its limbs."""
    totals = exact_totals(spark.createDataFrame([("1" * 60, "-2.5e3")], "a string, b string"))
    plan = totals._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("repeat(0") == 1 and plan.count("substring_index") <= 5
    assert [r["total"] for r in totals.orderBy("position").collect()] == ["1" * 60, "-2500"]
