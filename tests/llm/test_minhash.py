"""Near-duplicates against all pairs, and the cases that the docstring states."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest

from sieveframe.llm import minhash

WORD = re.compile(r"[^\x20\x09-\x0d]+")


def brute(rows):
    """Set size and component of every row, by comparing all pairs."""
    sets = []
    for _, text in rows:
        words = [w.translate({k: k + 32 for k in range(65, 91)}) for w in WORD.findall(text or "")]
        sets.append({tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))} if words else set())
    group = list(range(len(rows)))
    changed = True
    while changed:
        changed = False
        for i in range(len(rows)):
            for j in range(len(rows)):
                common = len(sets[i] & sets[j])
                if sets[i] and sets[j] and 100 * common >= 85 * (len(sets[i]) + len(sets[j]) - common) and group[j] < group[i]:
                    group[i], changed = group[j], True
    out = []
    for k, (doc_id, _) in enumerate(rows):
        ids = [rows[i][0] for i in range(len(rows)) if group[i] == group[k] and rows[i][0] is not None]
        least = (min(ids) if ids else None) if sets[k] else doc_id
        out.append((doc_id, len(sets[k]), least, doc_id == least))
    return out


def near_rows(seed=1):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(500)]
    rows, number = [], 0
    for _ in range(12):
        base = [rng.choice(vocabulary) for _ in range(rng.choice((4, 7, 30, 120, 400)))]
        for _ in range(rng.randint(1, 6)):
            words = list(base)
            for _ in range(rng.randint(0, 3)):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
            rows.append((number, " ".join(words)))
            number += rng.randint(1, 3)
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("rows", [
    near_rows(), near_rows(2),
    [(1, None), (2, ""), (3, " \n\t"), (4, "A b"), (5, "a B"), (6, "a b c"), (None, "a b"), (None, "x y z"), (5, "a b"), (5, "a b")],
    [(7, "É à b c d e f"), (8, "é à b c d e f"), (9, "a\x1cb c\x85d e f\xa0g"), (10, "a\x1cb c\x85d e f\xa0g")],
], ids=["near", "near-2", "odd", "letters"])
def test_equals_all_pairs(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumnRenamed("doc_id", "doc_id")
    found = [tuple(r) for r in minhash.near_duplicates(df).collect()]
    def order(r):
        return tuple((x is None, x or 0) for x in r)
    assert sorted(found, key=order) == sorted(brute(rows), key=order)


def test_empty_table_and_clashing_columns(spark):
    df = spark.createDataFrame([], "doc_id long, text string, node string, root int")
    assert minhash.near_duplicates(df).count() == 0
    assert minhash.without_near_duplicates(df).columns == df.columns


def test_one_row_of_each_group_stays(spark):
    rows = [(2, "a b c d e f", "x"), (1, "a b c d e f", "y"), (1, "a b c d e f", "z"), (3, None, "n"), (3, None, "n"), (4, "q r", "o")]
    df = spark.createDataFrame(rows, "doc_id long, text string, row_key string")
    kept = sorted(minhash.without_near_duplicates(df).collect(), key=lambda r: r.doc_id)
    assert [r.doc_id for r in kept] == [1, 3, 3, 4]
    assert kept[0].row_key in "yz"


def test_blocks_of_a_mixed_bucket_find_links():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 62, 200).astype(np.uint64)
    sets = [np.unique(np.where(rng.random(200) < share, rng.integers(0, 1 << 62, 200).astype(np.uint64), base)) for share in (0, .03, .05, .3, .6)]
    matrix = minhash.close(sets, sets, 85)
    for i, a in enumerate(sets):
        for j, b in enumerate(sets):
            common = len(np.intersect1d(a, b))
            assert matrix[i, j] == (100 * common >= 85 * (len(a) + len(b) - common))


def test_densified_signatures_estimate_similarity():
    rng = np.random.default_rng(4)
    errors = []
    for size in (20, 300, 3000):
        for _ in range(20):
            a = np.unique(rng.integers(0, 1 << 63, size).astype(np.uint64) << np.uint64(1))
            b = np.unique(np.concatenate([a[: int(len(a) * .8)], rng.integers(0, 1 << 63, size // 5).astype(np.uint64)]))
            signature = minhash.signatures([a, b], 252)
            truth = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
            errors.append((signature[0] == signature[1]).mean() - truth)
    assert abs(np.mean(errors)) < 0.03


def test_long_text():
    text = " ".join(f"w{k}" for k in range(200_000))
    assert [len(s) for s in minhash.shingle_sets(pa.array([text, "x" * 1_000_000]))] == [199_996, 1]
