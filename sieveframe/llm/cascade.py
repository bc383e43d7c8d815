"""Quality rules as a short-circuit cascade, in built-in expressions only.

A rule has a name and a condition that rejects. On a sample every rule's cost (seconds of a run of it
alone) and selectivity (the share it rejects) are estimated; the rules then run in the order of
rejections per second, as the branches of one CASE, so that a text is judged by the cheapest likely
rule first and by no rule after one that rejects it. The order changes the time and never the verdict.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SAMPLE_ROWS = 1000
MIN_WORDS, MAX_REPEAT = 50, 50  # the base rules' limits: words, percent of words in repeated windows
SPACE = r"[\x20\x09-\x0D]++"


def words(text: Column) -> Column:
    """The words of a text, in order; none for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


def duplicate_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line."""
    lines = F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return (F.size(lines) - F.size(F.array_distinct(lines))).cast("long")


def with_repeated_words(df: DataFrame) -> DataFrame:
    """``df(w, …)`` with ``n_repeat_words``: words in windows of three that the text holds twice or more.

    Each window is one long: its hash above, its place below, with as many bits as the text needs. After
    sorting, equal windows are neighbours; equal hashes are confirmed on the words themselves. Texts
    whose windows all have different hashes are done after the first step.
    """
    hashed = df.withColumn("n", F.size("w")).withColumn("hashes", F.when(F.col("n") > 3, F.transform(
        F.sequence(F.lit(0), F.col("n") - 3),
        lambda i: F.xxhash64(F.get("w", i), F.get("w", i + 1), F.get("w", i + 2)))))
    mask = (F.pow(F.lit(2.0), F.ceil(F.log2(F.col("n") + 1))) - 1).cast("long")
    masked = hashed.withColumn("mask", mask).withColumn("high", F.bitwise_not("mask"))
    repeats = F.size(F.array_distinct("hashes")) < F.size("hashes")
    packed = masked.withColumn("packed", F.when(repeats, F.sort_array(F.transform(
        "hashes", lambda h, i: h.bitwiseAND(F.col("high")).bitwiseOR(i.cast("long"))))))

    def same(x: Column, y: Column) -> Column:
        i, j = x.bitwiseAND(F.col("mask")).cast("int"), y.bitwiseAND(F.col("mask")).cast("int")
        near = x.bitwiseXOR(y).bitwiseAND(F.col("high")) == 0
        equal = [F.get("w", i + d) == F.get("w", j + d) for d in range(3)]
        return F.coalesce(near & equal[0] & equal[1] & equal[2], F.lit(False))

    again = F.filter("packed", lambda x, k: same(x, F.get("packed", k - 1)) | same(x, F.get("packed", k + 1)))
    spread = F.transform(again, lambda x: F.transform(
        F.array(*[F.lit(d) for d in range(3)]), lambda d: x.bitwiseAND(F.col("mask")).cast("int") + d))
    covered = F.size(F.array_distinct(F.flatten(spread)))
    return packed.withColumn("n_repeat_words", F.when(F.col("packed").isNull(), F.lit(0)).otherwise(covered).cast("long")) \
        .drop("n", "hashes", "mask", "high", "packed")


@dataclass(frozen=True)
class Rule:
    """``rejects`` gives the condition on the frame of metrics (see ``measured``)."""

    name: str
    rejects: Callable[[], Column]


def per_hundred_words(count: Column, limit: float) -> Column:
    return 100 * count > limit * F.col("n_words")


RULES = (
    Rule("symbols", lambda: per_hundred_words(F.col("n_symbols"), 10)),
    Rule("duplicate_lines", lambda: 100 * F.col("n_dup_lines") > 30 * F.size(F.split("text", "\n"))),
    Rule("word_length", lambda: (F.col("word_chars") < 3 * F.col("n_words")) | (F.col("word_chars") > 12 * F.col("n_words"))),
    Rule("letters", lambda: 100 * F.regexp_count("text", F.lit(r"\p{L}++")) < 80 * F.col("n_words")),
    Rule("capitals", lambda: 100 * F.regexp_count("text", F.lit(r"\p{Lu}")) > 40 * F.col("word_chars")),
    Rule("exclamation", lambda: per_hundred_words(F.regexp_count("text", F.lit("!")), 30)),
    Rule("bullets", lambda: 100 * F.regexp_count("text", F.lit(r"(?m)^[\x20\x09]*+[•*+-][\x20\x09]")) > 90 * F.size(F.split("text", "\n"))),
    Rule("ellipsis", lambda: 100 * F.regexp_count("text", F.lit(r"(?m)(?:\.\.\.|…)$")) > 30 * F.size(F.split("text", "\n"))),
)


def measured(docs: DataFrame) -> DataFrame:
    """``doc_id, text`` and the metrics of every row."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    listed = docs.select("doc_id", text.alias("text")).withColumn("w", words(F.col("text")))
    metrics = F.struct(
        F.size("w").cast("long").alias("n_words"), F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
        duplicate_lines(F.col("text")).alias("n_dup_lines"), F.col("n_repeat_words"))
    # As a generator's output the metrics are found once: a filter on them is not pushed down into their steps.
    return with_repeated_words(listed).select("doc_id", "text", F.inline(F.array(metrics)))


def ordered(docs: DataFrame, rules: Sequence[Rule] = RULES, sample_rows: int = SAMPLE_ROWS
            ) -> list[tuple[Rule, float, float]]:
    """The rules with cost and share of rejections, the most rejections per second first.

    The sample is drawn by a hash of the id, at most ``sample_rows`` rows; only they are held with texts.
    """
    place = F.xxhash64("doc_id")
    least = docs.select(place.alias("place")).orderBy("place").limit(sample_rows).collect()  # numbers alone
    last = least[-1].place if least else 0
    sample = measured(docs.where(place <= last).limit(sample_rows)).persist()
    try:
        n = max(1, sample.count())
        found = []
        for rule in rules:
            seconds = []
            for _ in range(2):  # the first run also compiles
                began = time.perf_counter()
                rejected = sample.agg(F.count(F.when(rule.rejects(), 1))).first()[0]
                seconds.append(time.perf_counter() - began)
            found.append((rule, min(seconds), rejected / n))
    finally:
        sample.unpersist()
    return sorted(found, key=lambda x: (-(x[2] / max(x[1], 1e-6)), x[1], x[0].name))


def short_circuit(rules: Sequence[Rule]) -> Column:
    """True where no rule rejects; a rule is evaluated only where those before it passed."""
    verdict = F.lit(True)
    for rule in reversed(rules):
        verdict = F.when(rule.rejects(), F.lit(False)).otherwise(verdict)
    return verdict


def quality(docs: DataFrame, rules: Sequence[Rule] = RULES, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """Metrics, ``base_failed`` and ``kept`` of every row of ``docs(doc_id, text)``.

    A null or empty text has no words and fails the base rules; a null doc_id stays null; repeated rows
    come out alike; texts of any length are read whole. Other columns are ignored.
    """
    metrics = measured(docs)
    order = [rule for rule, _, _ in ordered(docs.select("doc_id", "text"), rules, sample_rows)]
    base = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT * F.col("n_words"))
    return metrics.withColumn("base_failed", base).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        F.when(F.col("base_failed"), F.lit(False)).otherwise(short_circuit(order)).alias("kept"))
