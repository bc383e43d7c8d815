import hashlib
import os
from urllib.parse import unquote

import pytest

from sieveframe.sources import files
from sieveframe.sources.files import BYTE_ORDER_MARK, Sha256, hands_on_state, manifest


def test_a_state_is_handed_on():
    data = os.urandom(1000)
    digest = Sha256()
    for start in range(0, len(data), 77):
        digest.update(data[start:start + 77])
        digest = Sha256(digest.state())
    assert hands_on_state() and digest.hexdigest() == hashlib.sha256(data).hexdigest()


@pytest.mark.parametrize("handed_on", [True, False])
def test_large_files_are_digested_in_steps(spark, tmp_path, monkeypatch, handed_on):
    if not handed_on:
        monkeypatch.setattr(files, "hands_on_state", lambda: False)
    monkeypatch.setattr(files, "LONGEST_LINE", 1_000_000)
    noise = bytes(os.urandom(3_000_000))
    contents = {
        "noise.parquet": noise, "ended.csv": noise[:2_000_000] + b"\n", "marked.csv": BYTE_ORDER_MARK + b"a;b\r\n" * 300_000,
        "marked_open.csv": BYTE_ORDER_MARK + b"a;b\r\n" * 300_000 + b"1", "breaks.txt": b"\n" * 1_500_000, "long.bin": b"x" * 2_500_000,
        "long_then.bin": b"x" * 2_500_000 + b"\n" + b"y" * 700_000, "crossing.bin": noise[:140_000] + b"\n" + b"x" * 1_000_002 + b"\ny",
        "in reach.bin": noise[:140_000] + b"\n" + b"x" * 900_000 + b"\n" + noise[:300_000], "packed.csv.gz": noise[:1_500_000], "step.bin": noise[:400_000],
        "two.bin": noise[:800_000], "two_and.bin": noise[:800_001], "small.csv": b"x;y\n"}
    for name, data in contents.items():
        (tmp_path / name).write_bytes(data)
    spark.conf.set("spark.sql.files.maxPartitionBytes", 150_000)
    try:
        found = {unquote(os.path.basename(r["path"])): (r["length"], r["sha256"]) for r in manifest(spark, str(tmp_path), 400_000).collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert found == {name: (len(data), hashlib.sha256(data).hexdigest()) for name, data in contents.items()}


def test_no_task_reads_a_large_file_whole(spark, tmp_path):
    """A split or a step of each file at most; before, the task of a file read all of it."""
    from pyspark.sql import functions as F

    data = bytes(os.urandom(4_000_000))
    (tmp_path / "a.bin").write_bytes(data)
    spark.conf.set("spark.sql.files.maxPartitionBytes", 250_000)
    folder = spark.conf.get("spark.checkpoint.dir")
    before = set(os.listdir(folder))
    try:
        assert manifest(spark, str(tmp_path), 500_000).first()["sha256"] == hashlib.sha256(data).hexdigest()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    made, = (name for name in set(os.listdir(folder)) - before if name.startswith("digest-"))
    pieces = spark.read.parquet(f"{folder}/{made}/pieces").groupBy("step").agg(F.sum("size").alias("size")).collect()
    assert len(pieces) == 8 and max(r["size"] for r in pieces) < 510_000
    states = sorted(spark.read.parquet(f"{folder}/{made}/states/*").select("done").toPandas()["done"])
    assert len(states) == 8 and states[-1] == 4_000_000
    assert max(b - a for a, b in zip([0, *states], states)) < 510_000
