"""Numbered batches folded into snapshots."""

import glob

import pytest

from sieveframe.streaming import snapshots as S


def latest(spark, path):
    return {r["k"]: (r["n"], r["v"]) for r in S.read_latest(spark, path, "k", "n").collect()}


def put(spark, path, number, rows):
    S.store_batch(spark.createDataFrame(rows, "k string, n long, v string"), path, number)


def test_batches_and_snapshots_hold_the_latest_rows(spark, tmp_path):
    path = str(tmp_path / "t")
    with pytest.raises(ValueError):
        S.read_latest(spark, path, "k", "n")
    assert S.compact(spark, path, "k", "n") is None
    put(spark, path, 0, [("a", 1, "x"), ("b", 2, "x"), (None, 3, "x")])
    assert latest(spark, path) == {"a": (1, "x"), "b": (2, "x"), None: (3, "x")}
    assert S.compact(spark, path, "k", "n", buckets=4) == 0
    put(spark, path, 1, [("a", 9, "half")])
    put(spark, path, 1, [("a", 5, "y"), ("c", 6, "y")])  # the batch once more, whole
    expected = {"a": (5, "y"), "b": (2, "x"), "c": (6, "y"), None: (3, "x")}
    assert latest(spark, path) == expected
    assert S.compact(spark, path, "k", "n") == 1 and latest(spark, path) == expected
    assert S.compact(spark, path, "k", "n") == 1  # nothing new
    put(spark, path, 1, [("a", 5, "y"), ("c", 6, "y")])  # repeated after the snapshot
    put(spark, path, 2, [("b", 1, "older")])
    assert latest(spark, path) == expected and S.compact(spark, path, "k", "n") == 2 and latest(spark, path) == expected


def test_only_touched_buckets_are_written(spark, tmp_path):
    path = str(tmp_path / "t")
    put(spark, path, 0, [(f"k{i}", i, "x") for i in range(200)])
    S.compact(spark, path, "k", "n", buckets=16)
    put(spark, path, 1, [("k7", 500, "y")])
    S.compact(spark, path, "k", "n", buckets=99)
    assert len(glob.glob(f"{path}/snapshots/version=1/bucket=*")) == 1
    assert len(S.manifest(spark, path)) == 16 and latest(spark, path)["k7"] == (500, "y") and len(latest(spark, path)) == 200


def test_a_broken_run_shows_nothing(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    put(spark, path, 0, [("a", 1, "x")])
    S.compact(spark, path, "k", "n")
    put(spark, path, 1, [("a", 2, "y")])
    with monkeypatch.context() as patch:
        patch.setattr(spark, "createDataFrame", lambda *a: 1 / 0)
        with pytest.raises(ZeroDivisionError):  # after the rows, before the manifest
            S.compact(spark, path, "k", "n")
    assert S.manifest(spark, path)[0]["version"] == 0 and latest(spark, path) == {"a": (2, "y")}
    assert S.compact(spark, path, "k", "n") == 1 and latest(spark, path) == {"a": (2, "y")}
