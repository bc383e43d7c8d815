"""Records and streams."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from sieveframe.operators import records as R
from sieveframe.operators.joins import spread_join
from sieveframe.session import scratch_folder
from sieveframe.streaming.records import fold_batches, ingest, run_available, stream_clean, stream_dedup, stream_latest


def jobs(spark):
    return spark.createDataFrame(
        [(1, "a", "done", "r1"), (2, "a", "running", None), (3, "b", "queued", None), (4, "a", "queued", None),
         (5, "c", "failed", "r5")], "id int, chat string, status string, report string")


def test_latest_first_oldest(spark):
    df = jobs(spark)
    assert {r["chat"]: r["id"] for r in R.latest_by_key(df, "chat", "id").collect()} == {"a": 4, "b": 3, "c": 5}
    assert {r["chat"]: r["id"] for r in R.latest_by_key(df, "chat", "id", F.col("report").isNotNull()).collect()} == {"a": 1, "c": 5}
    assert {r["chat"]: r["id"] for r in R.first_by_key(df, "chat", "id").collect()} == {"a": 1, "b": 3, "c": 5}
    assert R.oldest(df, "id", 1, F.col("status") == "queued").first()["id"] == 3
    assert [r["id"] for r in R.pending(df, "id", "report").collect()] == [1, 5]
    assert R.latest_by_key(df, "chat", "id").columns == df.columns


def test_status_and_active(spark):
    df = jobs(spark).filter("id <> 4")
    assert {r["chat"]: r["status"] for r in R.status_fold(df, "chat", "status", "id").collect()} == {
        "a": "queued", "b": "queued", "c": "failed"}
    assert {r["chat"]: r["active"] for r in R.active_counts(jobs(spark), "chat", "status").collect()} == {
        "a": 2, "b": 1, "c": 0, None: 3}


def test_retention_keeps_what_is_active(spark):
    old, new = dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 9)
    df = spark.createDataFrame([(1, "queued", old), (2, "done", old), (3, "done", new), (4, None, old)],
                               "job int, status string, created timestamp_ntz")
    now, done = F.to_timestamp_ntz(F.lit("2024-01-10 00:00:00")), F.col("status").isin(*R.FINISHED)
    assert sorted(r["job"] for r in R.retain(df, "created", done, now).collect()) == [1, 3, 4]
    sent = spark.createDataFrame([(1, "p"), (2, "p"), (2, "q"), (9, "p")], "job int, name string")
    assert sorted(tuple(r) for r in R.retain_children(sent, df, "job", "created", done, now).collect()) == [(1, "p"), (9, "p")]


def test_gaps_and_allow_list(spark):
    expected = spark.createDataFrame([(1, "p1"), (1, "report"), (2, "p1"), (2, "p1")], "job int, name string")
    sent = spark.createDataFrame([(1, "p1"), (2, "report")], "job int, name string")
    assert sorted(tuple(r) for r in R.delivery_gaps(expected, sent).collect()) == [(1, "report"), (2, "p1")]
    assert R.allow_list(expected, "job", []).count() == 4
    assert R.allow_list(expected, "job", [2]).count() == 2
    assert R.allow_list(expected, "job", sent.select("job").filter("job = 1")).count() == 2
    assert R.allow_list(expected, "job", range(2, R_LONG)).count() == 2


R_LONG = 100_010


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_spread_join_is_a_join(spark, how):
    left = spark.range(3000).select("id", F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 50).alias("k"))
    right = spark.range(0, 40, 2).select(F.col("id").alias("k"), (F.col("id") * 10).alias("v"))
    spread, plain = spread_join(left, right, ["k"], how), left.join(right, "k", how)
    assert sorted(map(str, spread.select(*plain.columns).collect())) == sorted(map(str, plain.collect()))


@pytest.fixture
def stream(spark, tmp_path):
    folder = tmp_path / "in"
    schema = "id long, ts timestamp, chat string, v string"

    def add(rows):
        frame = spark.createDataFrame([(i, dt.datetime.fromisoformat(t), c, v) for i, t, c, v in rows], schema)
        frame.coalesce(1).write.mode("append").parquet(str(folder))

    add([(1, "2024-01-01", "a", " x "), (2, "2024-01-02", "b", "=y")])
    return (lambda: spark.readStream.schema(schema).parquet(str(folder))), add


@pytest.mark.parametrize("bounds", [(), ("ts", "7 days")])
def test_replays_are_ignored_across_restarts(spark, stream, bounds):
    source, add = stream
    root = scratch_folder(spark, "t")

    def step():
        return run_available(stream_dedup(source(), "id", *bounds), f"{root}/d", f"{root}/c")

    assert sorted(r["id"] for r in step().collect()) == [1, 2]
    add([(1, "2024-01-03", "a", "again"), (3, "2024-01-03", "a", "new")])
    assert sorted((r["id"], r["v"]) for r in step().collect()) == [(1, " x "), (2, "=y"), (3, "new")]


def test_latest_value_per_key_over_batches(spark, stream):
    source, add = stream
    root = scratch_folder(spark, "t")

    def step():
        ingest(stream_latest(source(), "chat", "id", ["v"]), f"{root}/d", f"{root}/c").awaitTermination()
        return {r["chat"]: (r["id"], r["v"]) for r in fold_batches(spark.read.parquet(f"{root}/d"), "chat").collect()}

    assert step() == {"a": (1, " x "), "b": (2, "=y")}
    add([(5, "2024-01-03", "a", "late"), (4, "2024-01-03", "a", "older")])
    assert step() == {"a": (5, "late"), "b": (2, "=y")}


def test_stream_tidy_and_its_limits(spark, stream):
    source, _ = stream
    root = scratch_folder(spark, "t")
    cleaned = run_available(stream_clean(source().select("id", "v"), "tidy"), f"{root}/d", f"{root}/c")
    assert sorted(tuple(r) for r in cleaned.collect()) == [("1", "x"), ("2", "'=y")]
    for operation in ("dedup", "profile"):
        with pytest.raises(ValueError):
            stream_clean(source(), operation)


def test_a_pair_that_is_a_third_of_all_rows(spark):
    hot = F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).cast("int")
    expected = spark.range(3000).select(hot.alias("job"), F.lit("p").alias("name"))
    sent = spark.range(1, 2000).select(F.col("id").cast("int").alias("job"), F.lit("p").alias("name"))
    wanted = {0} | {i for i in range(2000, 3000) if i % 3}
    assert {r["job"] for r in R.delivery_gaps(expected, sent).collect()} == wanted
    last = R.latest_by_key(spark.range(3000).select(hot.alias("k"), "id"), "k", "id")
    assert {r["k"]: r["id"] for r in last.collect()}[0] == 2997


def test_stream_keeps_headers_unless_the_operation_renames(spark):
    df = spark.createDataFrame([(" x ", "y", "z")], "a string, b string, c string")
    assert stream_clean(df.toDF(" ID ", "Nota", "nota"), "trim").columns[0] == " ID "
    assert stream_clean(df.toDF(" ID ", "Nota", "b"), "trim").columns == [" ID ", "Nota", "b"]
    assert stream_clean(df.toDF(" ID ", "Nota", "b"), "tidy").columns == ["id", "nota", "b"]
