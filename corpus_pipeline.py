"""A corpus from raw documents to packed sequences, in five stages; each is written and read again.

Every stage takes ``(spark, docs, sf_dir)`` and works on all that the one before has kept. The first four
return the columns of ``docs``, whatever they are; the last one returns pieces of sequences. Null texts and
ids, repeated rows and empty tables go the way that the operators of the stages state.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sieveframe.llm import minhash, mixture, packing, pseudonyms, toxicity
from sieveframe.llm.catalog import PSEUDONYM_KEY, vocabulary
from sieveframe.llm.tables import fresh, load, stored

WEIGHTS = (3, 1, 2)
EPOCHS = 1.5


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity is under the threshold."""
    (name,) = fresh(docs, "toxic")
    score = toxicity.toxic_scores(docs, load(spark, sf_dir, "labels"))
    return docs.withColumn(name, score).where(F.col(name) < toxicity.THRESHOLD).select(*docs.columns)


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: a similarity of 0.8 or more over five-word shingles."""
    return minhash.without_near_duplicates(docs, minhash.AT_80)


def with_pseudonyms(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts whose personal values are replaced; their lengths are counted anew."""
    new = pseudonyms.replacer(PSEUDONYM_KEY)(F.col("text"))
    changed = docs.withColumn("text", new["text"])
    return changed.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else changed


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of their sources takes them."""
    return mixture.mixed_rows(docs, mixture.cycled_weights(docs, WEIGHTS), EPOCHS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents, placed in sequences."""
    return packing.pack(docs, vocabulary(), with_ids=False)


STAGES = [("toxicity", without_toxic), ("near_dedup", without_near_duplicates), ("pii", with_pseudonyms),
          ("mixing", mixed), ("packing", packed)]

ORACLE_SQL = None  # a learned score is no SQL; tests hold each stage against a plain version


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
