"""Benchmark decontamination: a broadcast hash set of test n-grams, probed by every window of the documents.

Built-in functions only. Texts become words; every run of ``SIZE`` words of a benchmark item is an entry of
the set (an item of fewer words is one entry of its own length). Documents are cut into blocks of words, a
block into windows, and each window is looked up in the set by its words themselves, so that a hit of the
hash table is verified by comparison in the same step. Only windows that start with two words with which an
entry of a broadcast set may start, by a bitmap of their hashes, are spelled out and looked up. Only hits and one mark for each document leave the
task: the shuffle holds no text. The set is broadcast when its bytes are within ``BROADCAST_BYTES``; a larger
one is joined by shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from sieveframe.llm.tables import fresh, stored

SIZE = 10
BLOCK = 1024  # window starts that are spelled out at a time
BROADCAST_BYTES = 64 << 20
MOST_SLOTS = 1 << 20
PER_ENTRY = 64  # bytes that an entry takes besides its words

LOW_BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"  # what separates words of a lowered text
BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"  # the same of any text
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
KEY = ["doc_id", "digest"]


def words_of(text: Column) -> Column:
    """Words of the text with A-Z lower-cased; a null text has none."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    lowered = F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))
    # Not regexp_extract_all, which copies the text for each word.
    return F.array_remove(F.split(lowered, LOW_BETWEEN), "")


def digest_of(text: Column) -> Column:
    return F.unhex(F.md5(F.coalesce(text.cast("string"), F.lit(""))))


NO_RUNS = "array<struct<at:int,length:int,window:string>>"


def start_slot(words: Column, i: Column, length: int, slots: int) -> Column:
    """The slot of a run by how it starts: its first two words, or its only one."""
    first = [F.try_element_at(words, i), *([F.try_element_at(words, i + 1)] if length > 1 else [])]
    return F.pmod(F.xxhash64(*first), F.lit(slots)).cast("int") + 1


def runs(words: Column, length: int, most: Column, before: Column, starts: bytes | None = None) -> Column:
    """The first ``most`` runs of ``length`` words, with the number of the word that each starts at.

    With ``starts`` only runs whose slot is marked there are spelled out.
    """
    n = F.least(F.size(words) - length + 1, most)
    places = F.sequence(F.lit(1), n)
    if starts is not None:
        places = F.filter(places, lambda i: F.substring(F.lit(starts), start_slot(words, i, length, len(starts)), F.lit(1)) == F.lit(b"\x01"))
    found = F.transform(places, lambda i: F.struct(
        (before + i - 1).alias("at"), F.lit(length).alias("length"),
        F.array_join(F.slice(words, i, length), " ").alias("window")))
    return F.when(n > 0, found).otherwise(F.array().cast(NO_RUNS))


@dataclass
class TestSet:
    """Entries ``(entry, window)`` and where they come from ``(entry, item_id)``, both written tables."""

    __test__ = False

    entries: DataFrame
    origins: DataFrame
    lengths: list[int]
    small: bool
    starts: bytes | None  # slots in which an entry starts; none for a set that is not small

    def sent(self, side: DataFrame) -> DataFrame:
        return F.broadcast(side) if self.small else side


def test_set(benchmark: DataFrame, size: int = SIZE, broadcast_bytes: int = BROADCAST_BYTES) -> TestSet:
    """The windows of ``benchmark(item_id, text)``. A null text has none; a null item_id marks words but is not named."""
    words = benchmark.select(F.col("item_id").alias("item_id"), words_of(F.col("text")).alias("words"))
    long = words.where(F.size("words") >= size).select("item_id", F.explode(
        runs(F.col("words"), size, F.size("words"), F.lit(0))).alias("w")).select("item_id", "w.length", "w.window")
    short = words.where((F.size("words") > 0) & (F.size("words") < size)).select(
        "item_id", F.size("words").alias("length"), F.array_join("words", " ").alias("window"))
    pairs = stored(long.union(short).distinct(), "test-windows")
    entries = stored(pairs.select("window", "length").distinct().withColumn("entry", F.monotonically_increasing_id()), "test-set")
    facts = entries.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("window")).alias("bytes"),
                        F.sort_array(F.collect_set("length")).alias("lengths")).first()  # at most ``size`` lengths
    origins = stored(pairs.where("item_id is not null").join(entries, ["window", "length"]).select("entry", "item_id"), "test-items")
    small = (facts["bytes"] or 0) + PER_ENTRY * max(facts["n"], origins.count()) <= broadcast_bytes
    return TestSet(entries.select("entry", "window"), origins, facts["lengths"], small, _starts(entries, facts) if small else None)


def _starts(entries: DataFrame, facts: Row) -> bytes:
    """A byte for each slot; there are ``MOST_SLOTS`` at most, and no more of them marked than there are entries."""
    marks = bytearray(min(MOST_SLOTS, 1 << (16 * facts["n"] + 1).bit_length()))
    words = F.split("window", " ")
    for length in facts["lengths"]:
        slot = start_slot(words, F.lit(1), length, len(marks)).alias("slot")
        for row in entries.where(F.col("length") == length).select(slot).distinct().collect():
            marks[row["slot"] - 1] = 1
    return bytes(marks)


test_set.__test__ = False


def matched(docs: DataFrame, tests: TestSet) -> DataFrame:
    """``doc_id, digest, n_words, copies, hit, entries`` for each distinct document: the words hit, and by which entries."""
    rows = docs.select(F.col("doc_id").alias("doc_id"), digest_of(F.col("text")).alias("digest"), words_of(F.col("text")).alias("words")) \
        .withColumn("n_words", F.size("words"))
    cut = F.transform(F.sequence(F.lit(0), F.floor((F.col("n_words") - 1) / BLOCK).cast("int")), lambda b: F.struct(
        (b * BLOCK).alias("before"), F.slice("words", b * BLOCK + 1, BLOCK + reaching(tests)).alias("words")))
    blocks = rows.select(*KEY, "n_words", F.explode_outer(F.when(F.col("n_words") > 0, cut)).alias("block"))
    # The mark stands for the document, whether anything is hit or not; no window starts with a space.
    mark = F.array(F.struct(F.lit(0).alias("at"), F.lit(0).alias("length"), F.concat(F.lit(" "), F.hex("digest")).alias("window")))
    first = F.coalesce(F.col("block.before"), F.lit(0)) == 0
    none = F.array().cast(NO_RUNS)
    every = [runs(F.col("block.words"), n, F.lit(BLOCK), F.col("block.before"), tests.starts) for n in tests.lengths]
    every = [F.when(F.col("block").isNotNull(), e).otherwise(none) for e in every]
    windows = blocks.select(*KEY, "n_words", F.explode(F.concat(F.when(first, mark).otherwise(none), *every)).alias("w")) \
        .select(*KEY, "n_words", "w.at", "w.length", "w.window")
    met = windows.join(tests.sent(tests.entries), "window", "left").where("entry is not null or length = 0")
    hit = F.collect_set(F.when(F.col("entry").isNotNull(), F.struct("at", "length")))
    found = met.groupBy(*KEY).agg(F.max("n_words").alias("n_words"), F.count(F.when(F.col("length") == 0, 1)).alias("copies"),
                                  hit.alias("hit"), F.collect_set("entry").alias("entries"))
    inside = F.flatten(F.transform("hit", lambda h: F.sequence(h["at"], h["at"] + h["length"] - 1)))
    return found.withColumn("hit", F.sort_array(F.array_distinct(inside)))


def reaching(tests: TestSet) -> int:
    """Words of the next block that the last windows of a block reach into."""
    return max(tests.lengths, default=1) - 1


def contamination(docs: DataFrame, benchmark: DataFrame, size: int = SIZE, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """``doc_id, n_words, n_hit, n_items, items_sha256, contaminated`` of every row of ``docs(doc_id, text)``.

    A word is hit that lies inside any occurrence of a window of ``benchmark(item_id, text)``. ``items_sha256``
    is the digest of the ids of the items met, sorted as text and joined by commas (of an empty text without
    any). A null or empty text has no words; a null item_id counts as no item; repeated items count once;
    repeated rows are found alike, once each. Texts of any length are read whole. Other columns are ignored.
    """
    tests = test_set(benchmark, size, broadcast_bytes)
    found = stored(matched(docs, tests), "contamination")
    named = found.where(F.size("entries") > 0).select(*KEY, F.explode("entries").alias("entry")) \
        .join(tests.sent(tests.origins), "entry").groupBy(*KEY).agg(F.collect_set(F.col("item_id").cast("string")).alias("items"))
    named = named.withColumnsRenamed({k: f"{k}_" for k in KEY})
    items = F.coalesce("items", F.array().cast("array<string>"))
    thousand = F.floor((F.col("copies") - 1) / 1000)
    each = F.sequence(F.lit(1).cast("long"), F.least(F.lit(1000).cast("long"), F.col("copies") - F.col("_k") * 1000))
    return found.join(named, F.col("doc_id").eqNullSafe(F.col("doc_id_")) & (F.col("digest") == F.col("digest_")), "left") \
        .withColumn("_k", F.explode(F.sequence(F.lit(0).cast("long"), thousand))).withColumn("_k", F.explode(each)).select(
        "doc_id", F.col("n_words").cast("long").alias("n_words"), F.size("hit").cast("long").alias("n_hit"),
        F.size(items).cast("long").alias("n_items"),
        F.sha2(F.array_join(F.sort_array(items), ",").cast("binary"), 256).alias("items_sha256"),
        (F.size("hit") > 0).alias("contaminated"))


def without_words(text: Column, hit: Column, n_words: Column) -> Column:
    """The text without the words numbered in ``hit`` (ascending, from 0) and what separates each from the next."""
    starts = F.filter(hit, lambda x, i: F.coalesce(F.get(hit, i - 1), F.lit(-2)) != x - 1)
    ends = F.transform(F.filter(hit, lambda x, i: F.coalesce(F.get(hit, i + 1), F.lit(-2)) != x + 1), lambda x: x + 1)
    pieces = F.split(F.regexp_replace(text, f"^{BETWEEN}+", ""), f"(?<={BETWEEN})(?!{BETWEEN})")  # words, each with what follows
    kept = F.arrays_zip(F.concat(F.array(F.lit(0)), ends).alias("low"), F.concat(starts, F.array(n_words)).alias("high"))
    return F.concat(F.regexp_extract(text, f"^{BETWEEN}*", 0), F.array_join(F.transform(kept, lambda r: F.array_join(
        F.slice(pieces, r["low"] + 1, r["high"] - r["low"]), "")), ""))


def decontaminated(docs: DataFrame, benchmark: DataFrame, remove: str = "documents", size: int = SIZE,
                   broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """``docs`` without the documents that hold a window of the benchmark, or without the words that lie in one.

    Columns stay as they are, and so do texts without a hit. With ``remove="spans"`` a hit text loses the
    words hit with what separates them from the next word; its other columns are not counted anew.
    """
    if remove not in ("documents", "spans"):
        raise ValueError("remove documents or spans")
    found = stored(matched(docs, test_set(benchmark, size, broadcast_bytes)), "contamination").where(F.size("hit") > 0)
    key, mark, hit, total = fresh(docs, "key", "mark", "hit", "total")
    found = found.select(F.col("doc_id").alias(key), F.col("digest").alias(mark), F.col("hit").alias(hit), F.col("n_words").alias(total))
    same = docs["doc_id"].eqNullSafe(found[key]) & (digest_of(docs["text"]) == found[mark])
    if remove == "documents":
        return docs.join(found, same, "left_anti")
    text = F.when(F.col(hit).isNull(), F.col("text")).otherwise(
        without_words(F.col("text").cast("string"), F.col(hit), F.col(total)))
    return docs.join(found, same, "left").withColumn("text", text).select(*docs.columns)
