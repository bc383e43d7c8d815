"""Toxicity of texts: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

A document's features are the hashes of its distinct words (A-Z lower-cased, ASCII punctuation cut from
both ends), of pairs of neighbours and of pairs with one word between. Training is one online pass per
epoch with a learning rate for each coordinate; the L1 term leaves few weights, which are sent to all
tasks: at most ``2 ** BITS`` of them, whatever the size of the corpus.
"""

from __future__ import annotations

import string
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sieveframe.llm.tables import fold_remainder
from sieveframe.llm.words import Words, mix, split

BITS = 20
TRAIN_ROWS = 20_000  # labelled rows used for the fit, the first by a hash of their id
EPOCHS = 8
ALPHA, BETA, L1, L2 = 1.0, 1.0, 4.0, 1.0
THRESHOLD = 0.3


def trimmed(words: Words) -> Words:
    """The same words without ASCII punctuation at their ends; words of nothing else are left out."""
    encoded = pc.ascii_trim(words.vocabulary, string.punctuation).dictionary_encode()
    codes = encoded.indices.to_numpy(zero_copy_only=False).astype(np.int64)[words.codes]
    owners, empty = words.owners, pc.index(encoded.dictionary, "").as_py()
    if empty >= 0:
        keep = codes != empty
        codes, owners = codes[keep], owners[keep]
    return Words(words.texts, owners, codes, encoded.dictionary)


def features(texts: pa.Array, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """``(text, feature)`` of all words, neighbours and skip-grams of the texts, repeats included."""
    words = trimmed(split(texts))
    hashes = words.hashes()[words.codes] if len(words.codes) else np.zeros(0, np.uint64)
    owners, shift = words.owners, np.uint64(64 - bits)
    out = [(owners, mix(hashes) >> shift)]
    for gap, factor in ((1, 0x9E3779B97F4A7C15), (2, 0xC2B2AE3D27D4EB4F)):
        if len(hashes) > gap:
            same = owners[gap:] == owners[:-gap]
            pairs = mix(hashes[:-gap] * np.uint64(factor) + hashes[gap:]) >> shift
            out.append((owners[gap:][same], pairs[same]))
    return np.concatenate([o for o, _ in out]), np.concatenate([f for _, f in out]).astype(np.int64)


class Ftrl:
    """Per-coordinate FTRL-proximal state of a logistic regression with binary features."""

    def __init__(self, size: int, alpha: float = ALPHA, beta: float = BETA, l1: float = L1, l2: float = L2):
        self.z, self.n = np.zeros(size + 1), np.zeros(size + 1)  # the last coordinate is the bias
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, at: np.ndarray) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        l1 = np.where(at == len(self.z) - 1, 0.0, self.l1)
        slack = np.sign(z) * l1 - z
        return np.where(np.abs(z) <= l1, 0.0, slack / ((self.beta + np.sqrt(n)) / self.alpha + self.l2))

    def learn(self, at: np.ndarray, label: int) -> None:
        w = self.weights(at)
        gradient = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - label
        step = (np.sqrt(self.n[at] + gradient ** 2) - np.sqrt(self.n[at])) / self.alpha
        self.z[at] += gradient - step * w
        self.n[at] += gradient ** 2


def _fit(batches: Iterator[pa.RecordBatch], bits: int, epochs: int) -> Iterator[pa.RecordBatch]:
    rows: list[tuple[np.ndarray, int]] = []
    for batch in batches:
        owners, found = features(batch.column("text"), bits)
        order = np.argsort(owners, kind="stable")
        cuts = np.searchsorted(owners[order], np.arange(batch.num_rows + 1))
        for k, label in enumerate(batch.column("label").to_pylist()):
            at = np.unique(found[order[cuts[k]:cuts[k + 1]]])
            rows.append((np.append(at, 1 << bits).astype(np.int32), label))
    model = Ftrl(1 << bits)
    for _ in range(epochs):
        for at, label in rows:
            model.learn(at, label)
    every = np.arange((1 << bits) + 1)
    weights = model.weights(every)
    kept = np.flatnonzero(weights)
    yield pa.RecordBatch.from_arrays([pa.array(kept), pa.array(weights[kept])], ["feature", "weight"])


def fit(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS, bits: int = BITS, epochs: int = EPOCHS
        ) -> tuple[np.ndarray, np.ndarray]:
    """Features and weights learned from ``labels(doc_id, label)`` and the texts of ``docs(doc_id, text)``.

    The fit uses at most ``train_rows`` labelled ids, the first by a hash of the id, and as many texts of
    them; rows equal in id and text teach once. An id with several labels counts as 1 if one of them is. Null ids and labels teach nothing; without labels there are no
    weights and every score is 0.5.
    """
    chosen = (labels.where("doc_id is not null and label is not null").groupBy("doc_id")
              .agg(F.max(F.col("label").cast("int")).alias("label"))
              .orderBy(F.xxhash64(F.lit(9), "doc_id"), "doc_id").limit(train_rows))
    texts = docs.select("doc_id", "text").where("text is not null")
    joined = (texts.join(F.broadcast(chosen), "doc_id")  # at most train_rows rows of two numbers
              .groupBy("doc_id", "text").agg(F.max("label").alias("label")))
    sample = (joined.orderBy(F.xxhash64(F.lit(9), "doc_id"), "doc_id", F.xxhash64("text"), "text").limit(train_rows)
              .select(F.xxhash64(F.lit(9), "doc_id", "text").alias("place"), "text", "label")
              .repartition(1).sortWithinPartitions("place", "label"))
    rows = sample.mapInArrow(partial(_fit, bits=bits, epochs=epochs), "feature long, weight double").collect()
    rows.sort()
    return np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows])


def scorer(model: tuple[np.ndarray, np.ndarray], bits: int = BITS):
    """A function of a text column that gives the probability of the label 1."""
    @F.arrow_udf("double")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        weights = np.zeros(1 << bits, np.float32)
        inner = model[0] < 1 << bits
        weights[model[0][inner]] = model[1][inner]
        bias = float(model[1][~inner].sum())
        for texts in batches:
            owners, found = features(texts, bits)
            hit = np.flatnonzero(weights[found])
            pairs = np.unique(owners[hit].astype(np.int64) << bits | found[hit])
            total = np.bincount(pairs >> bits, weights[pairs & (1 << bits) - 1], len(texts)) + bias
            yield pa.array(1 / (1 + np.exp(-np.clip(total, -35, 35))))

    return score


def toxic_scores(docs: DataFrame, labels: DataFrame, modulus: int = 4, held_out: int = 2, **options) -> Column:
    """Score column for ``text``, learned from labels whose id's remainder is not ``held_out``."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").alias("label"))
    return scorer(fit(docs, known.where(fold_remainder("doc_id", modulus) != held_out), **options))(F.col("text"))


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row of ``docs(doc_id, text)``.

    A null or empty text has the score of the bias alone; a null doc_id is not held out and teaches
    nothing. Every row is scored by its own text, repeated rows alike. Other columns are ignored.
    """
    return docs.select("doc_id", F.coalesce(fold_remainder("doc_id", 4) == 2, F.lit(False)).alias("held_out"),
                       toxic_scores(docs, labels).alias("score")) \
        .withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
