"""Mixing sources to target weights by capped water-filling, with seeded whole and fractional repetitions.

The budget is shared by weight; a source that would be read more than ``max_epochs`` times is clamped
there and its excess goes to the others by weight, until none is above. A source's rate is its target
over its size: every document is taken as often as the whole part says, and the fractional part is a
seeded run of documents, in the order of a hash, that ends inside a document where the target does.

Positions in that order come from two windows: inside a bucket of the hash's first digits, and over the
buckets of a source (at most ``16 ** PREFIX``), so that a source with a third of all rows is dealt over
all tasks. No text is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sieveframe.llm.minhash import row_key
from sieveframe.llm.tables import fresh, stored

WORD = r"[^\x20\x09-\x0D]++"
PREFIX = 4
MAX_EPOCHS = 2.0


def size_of(text: str = "text") -> Column:
    """Number of words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def water_filled(sources: DataFrame, budget: float, max_epochs: float = MAX_EPOCHS) -> DataFrame:
    """``sources(source, source_size, weight)`` with the target of each: clamp, reshare, repeat.

    Each round is one aggregation over the sources and clamps at least one more, or ends.
    """
    cap = F.col("source_size") * F.lit(max_epochs)
    clamped, known = F.lit(False), -1
    while True:
        got = sources.agg(F.coalesce(F.sum(F.when(clamped, cap)), F.lit(0.0)).alias("used"),
                          F.coalesce(F.sum(F.when(~clamped, F.col("weight"))), F.lit(0)).cast("double").alias("free"),
                          F.count(F.when(clamped, 1)).alias("n")).first()
        left, share = budget - got.used, got.free or 1.0
        if got.n == known or got.free == 0:
            break
        known = got.n
        clamped = F.col("weight") * F.lit(left) > cap * F.lit(share)
    target = F.when(clamped, cap).otherwise(F.col("weight") * F.lit(left) / F.lit(share))
    return sources.withColumn("target", target.cast("double"))


def source_key() -> Column:
    """The source as a key that is never null."""
    return F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("")).alias("src")


def mixture(docs: DataFrame, weights: DataFrame, epochs: float, seed: str = "mix", max_epochs: float = MAX_EPOCHS
            ) -> DataFrame:
    """``doc_id, source, size, source_size, target, taken`` of every row of ``docs(doc_id, text, source)``.

    ``weights(source, weight)`` has one row for each source, null included; ``epochs`` is the budget as a
    multiple of all sizes. A null text has size 0 and takes nothing; a null doc_id is hashed as an empty
    one. Rows of one id and size are ordered arbitrarily, so that only which of two equal rows carries
    the cut is open. The same seed gives the same mix, on any layout. Other columns are ignored.
    """
    return _mixed(docs, weights, epochs, seed, max_epochs).drop("row_key")


def _mixed(docs: DataFrame, weights: DataFrame, epochs: float, seed: str, max_epochs: float) -> DataFrame:
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"))
    sized = stored(docs.select("doc_id", "source", source_key(), row_key().alias("row_key"), size_of().alias("size"), key.alias("key"))
                   .withColumn("bucket", F.substring("key", 1, PREFIX)), "sizes")
    parts = stored(sized.groupBy("src", "bucket").agg(F.sum("size").alias("part")), "mix-parts")
    totals = parts.groupBy("src").agg(F.sum("part").alias("source_size"))
    sources = stored(totals.join(weights.select(source_key(), "weight"), "src"), "mix-sources")
    budget = epochs * (sources.agg(F.sum("source_size")).first()[0] or 0)
    before = F.sum("part").over(Window.partitionBy("src").orderBy("bucket")) - F.col("part")
    placed = (parts.withColumn("before", before).drop("part")
              .join(water_filled(sources, budget, max_epochs), "src"))
    within = F.sum("size").over(Window.partitionBy("src", "bucket").orderBy("key", "size")
                                .rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")
    rows = sized.withColumn("within", within).join(placed, ["src", "bucket"])
    whole = F.floor(F.col("target") / F.greatest("source_size", F.lit(1)))
    extra = F.round(F.col("target") - whole * F.col("source_size")).cast("long")
    fraction = F.least(F.greatest(extra - F.col("before") - F.col("within"), F.lit(0)), F.col("size"))
    return rows.select("doc_id", "row_key", "source", "size", "source_size", "target",
                       (whole * F.col("size") + fraction).cast("long").alias("taken"))


def mixed_rows(docs: DataFrame, weights: DataFrame, epochs: float, seed: str = "mix", max_epochs: float = MAX_EPOCHS
               ) -> DataFrame:
    """``docs`` with all its columns, each row as often as the mix takes it.

    A document that is taken in part counts as whole from one half on; one without words is not taken.
    """
    row, times, n, copy = fresh(docs, "row", "times", "n", "copy")
    whole = F.coalesce(F.round(F.col("taken") / F.nullif("size", F.lit(0))), F.lit(0)).cast("long")
    taken = stored(_mixed(docs, weights, epochs, seed, max_epochs).groupBy(F.col("row_key").alias(row))
                   .agg(F.sum(whole).alias(times), F.count(F.lit(1)).alias(n)).where(F.col(times) > 0), "taken")
    joined = docs.withColumn(row, row_key()).join(taken, row)

    def repeated(rows: DataFrame, often: Column) -> DataFrame:
        return rows.withColumn(copy, F.explode(F.array_repeat(F.lit(0), often.cast("int"))))

    rest = F.col(times) % F.col(n)
    rows = repeated(joined, F.floor(F.col(times) / F.col(n)))
    if not taken.where(rest > 0).isEmpty():  # rows equal in id and text share what does not divide
        rows = rows.unionByName(repeated(joined.where(rest > 0).dropDuplicates([row]), rest))
    return rows.select(*docs.columns)


def cycled_weights(docs: DataFrame, weights: tuple[int, ...]) -> DataFrame:
    """Weights given in turn to the sources by code point, null last.

    The window sees one row for each source, not for each document.
    """
    named = docs.select("source").distinct()
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    listed = F.array(*[F.lit(w) for w in weights])
    return named.select("source", F.element_at(listed, (place % len(weights) + 1).cast("int")).alias("weight"))
