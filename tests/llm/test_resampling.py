"""Importance resampling against a plain version, and the cases that the docstring states."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest

from sieveframe.llm import resampling

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lowered(text):
    return (text or "").translate({k: k + 32 for k in range(65, 91)})


def brute(docs, target, percent, least, longest, buckets, seed):
    """Rows of ``resampling`` for lists of ``(doc_id, text)``."""
    def features(text):
        words = WORD.findall(lowered(text))
        return words, [zlib.crc32(" ".join(words[i:i + n]).encode()) % buckets
                       for n in range(1, longest + 1) for i in range(len(words) - n + 1)]

    raw, wanted = Counter(), Counter()
    for _, text in docs:
        raw.update(features(text)[1])
    for text in target:
        wanted.update(features(text)[1])
    s, t = sum(raw.values()), sum(wanted.values())
    rows = []
    for doc_id, text in docs:
        words, found = features(text)
        gains = [math.floor(1000 * math.log((wanted[b] + 1) * (s + buckets) / ((raw[b] + 1) * (t + buckets)))) for b in found]
        weight = sum(gains) // len(gains) if gains else 0
        h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        rows.append([doc_id, len(found), weight, score, None, len(words) >= least, hashlib.md5((text or "").encode()).digest()])
    fit = sorted((r for r in rows if r[5]), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[6]))
    for k, row in enumerate(fit[:len(fit) * percent // 100]):
        row[4] = k + 1
    return Counter(tuple(r[:5]) for r in rows)


def made(seed=1, n=300):
    rng = random.Random(seed)
    vocabulary = ["Tree", "house", "É", "naïve", "x9", "WORD", "語語", "of", "the", "a"]
    rows = [(k, " ".join(rng.choices(vocabulary, k=rng.choice((0, 1, 5, 25, 60)))) + rng.choice(("", ".", "--", "\n"))) for k in range(n)]
    rows += [(n + 1, None), (n + 2, ""), (None, "a b c d e f"), (None, None), (7, rows[7][1]), (7, rows[7][1])]
    rng.shuffle(rows)
    return rows, [" ".join(rng.choices(vocabulary[:4], k=40)) for _ in range(5)] + [None, ""]


@pytest.mark.parametrize("longest", [1, 3])
def test_equals_the_plain_version(spark, longest):
    rows, target = made()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame([(k, t) for k, t in enumerate(target)], "item_id long, text string")
    options = dict(percent=30, least_words=5, longest=longest, buckets=97, seed=5)
    found = resampling.resampling(docs, bench, **options).drop("digest").collect()
    plain = brute(rows, target, 30, 5, longest, 97, 5)
    assert Counter(tuple(r) for r in found) == plain
    ranks = sorted(r["rank"] for r in found if r["rank"] is not None)
    assert ranks == list(range(1, len(ranks) + 1)) and ranks


def test_windows_come_from_offsets():
    text = "ab  c, é-d9\x00x"
    words = resampling.word_offsets(text)
    assert [w for w, _ in words] == ["ab", "c", "é", "d9", "x"]
    assert all(text[start:end] == w for w, (start, end) in words)
    assert list(resampling.features(words, 2)) == ["ab", "c", "é", "d9", "x", "ab c", "c é", "é d9", "d9 x"]
    assert list(resampling.features([], 3)) == []


def test_a_tie_across_ranges_goes_by_id(spark):
    """All rows weigh alike and share a score where the ids repeat."""
    rows = [(k % 5, "w " * 20) for k in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame([], "item_id long, text string")
    found = resampling.resampling(docs, bench, percent=50).where("rank is not null").orderBy("rank").collect()
    assert [r["rank"] for r in found] == list(range(1, 21))
    assert [(-r["score"], r["doc_id"]) for r in found] == sorted((-r["score"], r["doc_id"]) for r in found)


def test_drawn_rows_keep_their_columns(spark):
    rows, target = made(2)
    docs = spark.createDataFrame([(i, t, "k") for i, t in rows], "doc_id long, text string, score string") \
        .withColumnRenamed("score", "rank")
    bench = spark.createDataFrame([(k, t) for k, t in enumerate(target)], "item_id long, text string")
    options = dict(percent=40, least_words=1, buckets=97)
    drawn = resampling.resampled(docs, bench, **options)
    ranked = resampling.resampling(docs, bench, **options).where("rank is not null").groupBy("doc_id").count().collect()
    assert drawn.columns == docs.columns
    assert Counter(r["doc_id"] for r in drawn.collect()) == Counter({r["doc_id"]: r["count"] for r in ranked})


def test_empty_tables_and_a_long_text(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    assert resampling.resampling(none, bench).count() == 0
    long = spark.createDataFrame([(1, "word " * 200_000), (2, "x" * 1_000_000)], "doc_id long, text string")
    found = {r["doc_id"]: r["n_features"] for r in resampling.resampling(long, none).collect()}
    assert found == {1: 200_000, 2: 1}
