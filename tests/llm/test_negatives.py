"""Hard negatives against all pairs, and the cases that the docstring states."""

import math
import random
from collections import Counter

import numpy as np
import pytest

from sieveframe.llm import negatives


def brute(rows, positives, k, low, high, scale):
    rows = [r for r in dict.fromkeys((i, tuple(v) if v is not None else None, lab) for i, v, lab in rows)
            if r[2] is not None and r[1] and all(x is not None and math.isfinite(x) for x in r[1])]
    whole = [[math.floor(float(x) * scale) for x in v] for _, v, _ in rows]
    out = []
    for a, (anchor, vector, label) in enumerate(rows):
        if anchor is None or anchor % 100:
            continue
        scored = [(-max(min(sum(x * y for x, y in zip(whole[a], whole[b])), 2 ** 63 - 1), -2 ** 63 + 1), i is None, i or 0, lab)
                  for b, (i, v, lab) in enumerate(rows) if b != a and len(v) == len(vector)]
        own = sorted(s for s in scored if s[3] == label and (s[1] or s[2] != anchor))[:positives]
        for p in own:
            found = [s for s in sorted(s for s in scored if s[3] != label) if low * -p[0] <= 100 * -s[0] <= high * -p[0]][:k]
            out += [(anchor, None if p[1] else p[2], rank + 1, None if s[1] else s[2], -p[0], -s[0]) for rank, s in enumerate(found)]
    return Counter(out)


def made(seed, n, spread=2.0, size=6):
    rng = np.random.default_rng(seed)
    middles = rng.normal(size=(4, size))
    rows = []
    for k in range(n):
        label = int(rng.integers(0, 4))
        rows.append((k * 20, [float(np.float32(x)) for x in middles[label] + spread * rng.normal(size=size) + 1], label))
    rows += [(rows[3][0], rows[3][1], rows[3][2]), (100, rows[5][1], 9), (None, rows[6][1], rows[6][2]), (None, rows[7][1], 2),
             (7, None, 1), (8, [1.0, None] * 3, 1), (9, [float("nan")] + [0.0] * 5, 1), (10, [float("inf")] + [0.0] * 5, 2),
             (11, [1.0] * size, None), (12, [], 1), (13, [1.0, 2.0], 1), (200, [1.0, 2.0], 1), (14, [1.0, 1.0], 2), (15, [0.0] * size, 3)]
    random.Random(seed).shuffle(rows)
    return rows


SCHEMA = "vec_id long, embedding array<float>, label int"


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_all_pairs(spark, monkeypatch, seed):
    for name, size in (("ANCHORS", 7), ("ROWS", 31), ("TILE", 100)):  # several blocks and tiles
        monkeypatch.setattr(negatives, name, size)
    rows = made(seed, 150)
    found = negatives.hard_negatives(spark.createDataFrame(rows, SCHEMA), low=30, high=90, negatives=4).collect()
    assert Counter(tuple(r) for r in found) == brute(rows, 5, 4, 30, 90, 256)
    assert found


def test_ties_and_a_hot_group(spark):
    """A third of all rows are one vector; ties go by id."""
    rows = [(k, [0.5, 0.5], 0) for k in range(0, 400, 10)] + [(k, [0.25, 0.3], 1) for k in range(1, 120)] + [(500, [0.2, 0.2], 2)]
    found = negatives.hard_negatives(spark.createDataFrame(rows, SCHEMA)).collect()
    assert Counter(tuple(r) for r in found) == brute(rows, 5, 10, 30, 90, 256)
    first = [r["negative_id"] for r in sorted(found, key=lambda r: r["rank"]) if r["anchor_id"] == 0 and r["positive_id"] == 10]
    assert first == list(range(1, 11))


@pytest.mark.parametrize("size", [1e6, 1e12, 1e30])
def test_scores_beyond_the_digits_of_doubles(spark, size):
    rows = [(i, [x * size for x in v] if v and None not in v else v, lab) for i, v, lab in made(3, 60)]
    rows = [(i, [float(np.float32(x)) for x in v] if v and None not in v else v, lab) for i, v, lab in rows]
    found = negatives.hard_negatives(spark.createDataFrame(rows, SCHEMA)).collect()
    assert Counter(tuple(r) for r in found) == brute(rows, 5, 10, 30, 90, 256)


def test_empty_table_and_other_columns(spark):
    assert negatives.hard_negatives(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = spark.createDataFrame([(100, [1.0], 1, "x"), (1, [0.5], 1, "y"), (2, [0.25], 2, "z")], SCHEMA + ", score string")
    found = negatives.hard_negatives(rows.withColumnRenamed("score", "row"))
    assert [tuple(r) for r in found.collect()] == [(100, 1, 1, 2, 32768, 16384)]


def test_shares_round_like_whole_numbers():
    scores = np.array([-7, -1, 0, 1, 3, 99, 101, 2 ** 62], np.int64)
    assert negatives.share_floor(scores, 90).tolist() == [90 * int(s) // 100 for s in scores]
    assert negatives.share_ceil(scores, 30).tolist() == [-(-30 * int(s) // 100) for s in scores]
