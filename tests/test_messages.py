"""The ledger of messages over several micro-batches, and character references."""

import html
import html.entities
import random
import time

import pytest
from pyspark.sql import functions as F

from sieveframe.functions.text import decode_entities
from sieveframe.sources.payloads import json_rows
from sieveframe.streaming.messages import fold_ledger, stream_ledger
from sieveframe.streaming.records import run_available

SCHEMA = "id long, ts timestamp, done boolean"


def run(spark, root, batches, **options):
    """Each batch arrives on its own, with a restart between; the written ledger as sorted rows."""
    for rows in batches:
        df = spark.createDataFrame(rows, "id long, ts string, done boolean").withColumn("ts", F.col("ts").cast("timestamp"))
        df.write.mode("append").parquet(f"{root}/in")
        stream = spark.readStream.schema(SCHEMA).parquet(f"{root}/in")
        written = run_available(stream_ledger(stream, "id", "ts", "done", **options), f"{root}/out", f"{root}/state", idle=False)
    return written


def test_first_arrivals_are_never_lost(spark, tmp_path):
    written = run(spark, tmp_path, [
        [(1, "2024-03-01", None), (2, "2024-03-20", False), (2, "2024-03-21", False), (None, "2024-03-20", None)],
        [(1, "2024-03-01", None), (3, "2024-01-01", None), (4, "2024-03-19", None)],  # 3 lies behind the watermark
        [(3, "2024-01-01", None), (9, "2024-01-01", True)]], horizon="7 days")
    found = {r["id"]: (str(r["ts"])[:10], r["late"], r["replays"]) for r in fold_ledger(written, "id", "ts").collect()}
    assert found == {1: ("2024-03-01", False, 1), 2: ("2024-03-20", False, 1), 3: ("2024-01-01", True, 1),
                     4: ("2024-03-19", False, 0), None: ("2024-03-20", False, 0)}
    assert written.where("stored").count() == 5


def test_handled_messages_are_forgotten_and_others_are_not(spark, tmp_path):
    batches = [[(1, "2024-03-01", False), (1, "2024-03-01", True), (2, "2024-03-01", False)]]
    run(spark, tmp_path, batches, keep_ms=1)
    time.sleep(0.1)
    run(spark, tmp_path, [[(5, "2024-03-02", False)]], keep_ms=1)  # the timer of 1 is due
    written = run(spark, tmp_path, [[(1, "2024-03-01", False), (2, "2024-03-01", False)]], keep_ms=1)
    stored = {r["id"]: r["n"] for r in written.groupBy("id").agg(F.count_if("stored").alias("n")).collect()}
    assert stored == {1: 2, 2: 1, 5: 1}


def test_keys_share_a_call(spark, tmp_path):
    """Python is called for each bucket, not for each key; keys beyond a double stay exact beside a missing one."""
    keys = [2**60 + n for n in range(50)] + [None]
    batches = [[(k, "2024-03-20", False) for k in keys], [(keys[0], "2024-03-20", True), (None, "2024-03-20", False)]]
    run(spark, tmp_path, batches[:1], keep_ms=1, buckets=1)
    run(spark, tmp_path, batches[1:], keep_ms=1, buckets=1)
    time.sleep(0.1)
    written = run(spark, tmp_path, [[(keys[0], "2024-03-20", False), (keys[1], "2024-03-20", False)]], keep_ms=1, buckets=1)
    replays = {r["id"]: r["replays"] for r in fold_ledger(written, "id", "ts").collect()}
    assert replays == {**dict.fromkeys(keys, 0), None: 1, keys[0]: 1, keys[1]: 1}
    time.sleep(0.1)
    run(spark, tmp_path, [[(keys[2], "2024-03-20", True)]], keep_ms=1, buckets=1)  # keys[0] is due and not named
    written = run(spark, tmp_path, [[(keys[0], "2024-03-20", False)]], keep_ms=1, buckets=1)
    assert written.where((F.col("id") == keys[0]) & F.col("stored")).count() == 2


@pytest.mark.parametrize("seed", [1, 2])
def test_references_equal_a_browsers(evaluate, seed):
    rng = random.Random(seed)
    names = sorted(html.entities.html5)
    pieces = ["&", "&#", "&#x", ";", " ", "a", "é", "x41", "128", "150;", "amp", "amp;", "lt", "notit;", "copy b", "<", "#", "0", "D800;", "\n"]
    texts = ["".join(rng.choices(pieces + ["&" + n for n in rng.sample(names, min(30, len(names)))], k=rng.randint(0, 9))) for _ in range(150)]
    assert evaluate(decode_entities, texts) == [html.unescape(t) for t in texts]


def test_single_references(evaluate):
    texts = ["&copy b", "&lt x", "&NotEqualTilde;", "&#x80;", "&notit;", "&nothing;", "&amp;lt;", "", None]
    assert evaluate(decode_entities, texts) == ["© b", "< x", "≂̸", "€", "¬it;", "¬hing;", "&lt;", "", None]


def test_json_values_by_their_types(spark):
    payloads = ['{"rows": [{"a": 1, "b": [1, {"x": "p,q:r \\"s", "y": null}], "a": "last"}, {"c": -1e999, "b": "[1,2]", "a": {}}]}']
    good, bad = json_rows(spark.createDataFrame(list(enumerate(payloads)), "n int, payload string"), "payload", ["n"])
    assert good.columns == ["a", "b", "c"] and bad.count() == 0
    assert sorted(tuple(r) for r in good.collect()) == [("last", '[1, {"x": "p,q:r \\"s", "y": null}]', ""), ("{}", "[1,2]", "-inf")]
    assert spark.conf.get("spark.sql.variant.allowDuplicateKeys") == "false"


def test_payloads_are_parsed_once(spark):
    payloads = ['{"rows": [{"a": 1, "b": "x"}, {"a": true, "a": null}]}', '{"rows": []}', '{"rows": [1]}', '{"rows": [{"a": 1}, null]}', "no", None]
    good, bad = json_rows(spark.createDataFrame(list(enumerate(payloads)), "n int, payload string"), "payload", ["n"])
    plan = good._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json(") == 1 and plan.lower().count("parsejson") <= 1
    assert sorted(tuple(r) for r in good.collect()) == [("", ""), ("1", "x")]
    assert sorted(r["n"] for r in bad.collect()) == [2, 3, 4, 5]
