"""Importance resampling towards a target: words by an untrained pre-tokeniser, CRC buckets, Gumbel top-k.

A Regex Split over the ASCII-lowered text returns words with their offsets. Pairs of offsets, one for the
first and one for the last word of a run, cut the features out of the words joined by spaces; CRC-32 deals
them into buckets, which are counted inside the tasks before the shuffle. A
bucket's gain says how much likelier the target is to fill it; a document's weight is the floored mean of
its gains, and with seeded Gumbel noise the highest scores are a draw without replacement.

Ranks come without a sort in one task: a histogram of the integer scores (some 10^5 at any size, as a gain
is a logarithm of counts and the noise of 2^32 values) gives the lowest score that can be drawn, and the rows
above it are range-partitioned, counted, and numbered inside their range.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from functools import cache, partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sieveframe.llm.tables import fresh, stored
from sieveframe.llm.words import slices

BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"  # what separates words: ASCII but for digits and small letters
LONGEST = 1
BUCKETS = 10_000
LEAST_WORDS = 20
PERCENT = 10
SEED = 2024
CACHED = 1 << 18  # features whose buckets a task remembers

FEATURES = "doc_id long, digest binary, n_words long, buckets array<int>"


@cache
def _splitter():
    from tokenizers import Regex, pre_tokenizers

    return pre_tokenizers.Split(Regex(BETWEEN), "removed")


def word_offsets(text: str) -> list[tuple[str, tuple[int, int]]]:
    """Words of an ASCII-lowered text, each with the place where it starts and ends."""
    return _splitter().pre_tokenize_str(text)


class Buckets(dict):
    """Bucket of each feature: the CRC-32 of its UTF-8 bytes modulo the number of buckets."""

    def __init__(self, size: int):
        super().__init__()
        self.size = size

    def __missing__(self, feature: str) -> int:
        if len(self) >= CACHED:
            self.clear()
        found = self[feature] = zlib.crc32(feature.encode()) % self.size
        return found


def features(words: list[tuple[str, tuple[int, int]]], longest: int) -> Iterator[str]:
    """All runs of 1 to ``longest`` consecutive words, joined by one space."""
    line = " ".join(word for word, _ in words)
    sizes = np.fromiter((end - start for _, (start, end) in words), np.int64, len(words))
    ends = (np.cumsum(sizes + 1) - 1).tolist()
    starts = (np.cumsum(sizes + 1) - 1 - sizes).tolist()
    for length in range(1, longest + 1):
        for start, end in zip(starts, ends[length - 1:]):
            yield line[start:end]


def _features(batches: Iterator[pa.RecordBatch], longest: int, size: int) -> Iterator[pa.RecordBatch]:
    known = Buckets(size)
    for batch in batches:
        for part in slices(batch, "text"):
            counts, lists = [], []
            for text in pc.ascii_lower(pc.fill_null(part.column("text"), "")):
                words = word_offsets(text.as_py())
                counts.append(len(words))
                lists.append(np.array([known[f] for f in features(words, longest)] if longest > 1 else [known[w] for w, _ in words], np.int32))
            offsets = np.cumsum([0, *map(len, lists)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([
                part.column("doc_id"), part.column("digest"), pa.array(counts, pa.int64()),
                pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(lists), pa.int32()))],
                ["doc_id", "digest", "n_words", "buckets"])


def histogram(rows: DataFrame, size: int) -> np.ndarray:
    """How many features of ``rows(buckets)`` each bucket holds."""
    total = np.zeros(size, np.int64)
    for row in rows.select(F.explode("buckets").alias("bucket")).groupBy("bucket").count().collect():  # one row a bucket
        total[row["bucket"]] = row["count"]
    return total


def gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log of how much likelier the target is to fill a bucket, each count raised by one."""
    size, s, t = float(len(raw)), float(raw.sum()), float(target.sum())
    return np.array([math.floor(1000 * math.log((b + 1.0) * (s + size) / ((a + 1.0) * (t + size))))
                     for a, b in zip(raw.tolist(), target.tolist())], np.int64)


def weighed(rows: DataFrame, gain: np.ndarray) -> DataFrame:
    """``doc_id, digest, n_words, n_features, weight``: the floored mean of the gains of a row's buckets."""
    table = F.split(F.lit(",".join(map(str, gain.tolist()))), ",").cast("array<long>")  # folded to a constant
    total = F.aggregate("buckets", F.lit(0).cast("long"), lambda s, b: s + F.get(table, b))
    n = F.size("buckets").cast("long")
    return rows.select("doc_id", "digest", "n_words", n.alias("n_features"),
                       F.floor(total / F.greatest(n, F.lit(1))).alias("weight"))


def bucketed(docs: DataFrame, longest: int, size: int) -> DataFrame:
    """``doc_id, digest, n_words, buckets``: a text's features in order, by their buckets."""
    text = F.col("text").cast("string")
    id_ = F.col("doc_id").cast("long") if "doc_id" in docs.columns else F.lit(None).cast("long")
    return docs.select(id_.alias("doc_id"), F.unhex(F.md5(F.coalesce(text, F.lit("")))).alias("digest"), text.alias("text")) \
        .mapInArrow(partial(_features, longest=longest, size=size), FEATURES)


def noise(seed: int) -> Column:
    """Thousandths of a Gumbel variable that depends on ``doc_id`` alone; a null id is an empty one."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    drawn = F.conv(F.substring(F.sha2(key.cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((drawn + 0.5) / F.lit(4294967296.0))))


def _lowest(rows: DataFrame, wanted: int) -> int:
    """The score at which the ``wanted`` highest ones are reached, from one row for each distinct score."""
    for row in sorted(rows.groupBy("score").count().collect(), key=lambda r: -r["score"]):
        wanted -= row["count"]
        if wanted <= 0:
            return row["score"]
    raise ValueError("fewer rows than wanted")


def numbered(rows: DataFrame, order: list[Column]) -> DataFrame:
    """``rows`` with ``rank`` 1, 2, 3... in that order: a range for each task, whose counts are added up."""
    dealt = stored(rows.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "ranges")
    parts = dealt.groupBy("part").agg(F.count(F.lit(1)).alias("n"))  # one row for each range
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    place = F.row_number().over(Window.partitionBy("part").orderBy(*order))
    return dealt.withColumn("place", place).join(F.broadcast(starts), "part") \
        .withColumn("rank", F.col("before") + F.col("place")).drop("part", "before", "place")


def resampling(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS,
               longest: int = LONGEST, buckets: int = BUCKETS, seed: int = SEED) -> DataFrame:
    """``doc_id, n_features, weight, score, rank, digest`` of every row of ``docs(doc_id, text)``.

    ``rank`` counts the drawn documents, ``percent`` of those with ``least_words`` or more, from the highest
    score; it is null for the others. Ties go to the smaller doc_id, null last, then to the text's ``digest``;
    rows equal in both are alike, and as many of them as it takes are drawn. A null or empty text has no
    features and weight 0. A null doc_id draws as an empty one. Empty tables leave all counts 0. Texts of any
    length are read whole. Other columns are ignored.
    """
    known = stored(bucketed(docs, longest, buckets), "buckets")
    gain = gains(histogram(known, buckets), histogram(bucketed(target, longest, buckets), buckets))
    scored = stored(weighed(known, gain).withColumn("score", F.col("weight") + noise(seed)), "scores")
    fit = F.col("n_words") >= least_words
    wanted = scored.where(fit).count() * percent // 100
    columns = ["doc_id", "n_features", "weight", "score", "rank", "digest"]
    if not wanted:
        return scored.withColumn("rank", F.lit(None).cast("long")).select(*columns)
    high = fit & (F.col("score") >= _lowest(scored.where(fit), wanted))
    first = numbered(scored.where(high), [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("digest")]) \
        .withColumn("rank", F.when(F.col("rank") <= wanted, F.col("rank").cast("long")))
    return first.select(*columns).union(scored.where(~high).withColumn("rank", F.lit(None).cast("long")).select(*columns))


def resampled(docs: DataFrame, target: DataFrame, **options: int) -> DataFrame:
    """The drawn rows of ``docs``, with their columns.

    Of rows equal in doc_id and text as many come back as were drawn, with the other columns of one of them.
    """
    key, mark, times, own_key, own_mark = fresh(docs, "key", "mark", "times", "own_key", "own_mark")
    drawn = resampling(docs, target, **options).where("rank is not null").groupBy("doc_id", "digest") \
        .agg(F.count(F.lit(1)).cast("int").alias(times)).select(F.col("doc_id").alias(key), F.col("digest").alias(mark), times)
    marked = docs.withColumn(own_key, F.col("doc_id").cast("long")) \
        .withColumn(own_mark, F.unhex(F.md5(F.coalesce(F.col("text").cast("string"), F.lit("")))))
    return marked.dropDuplicates([own_key, own_mark]).join(
        drawn, F.col(key).eqNullSafe(F.col(own_key)) & (F.col(mark) == F.col(own_mark))) \
        .withColumn(times, F.explode(F.sequence(F.lit(1), times))).select(*docs.columns)
