"""Language of texts by error-correcting output codes over character n-grams.

Every language has a codeword of bits; a bit divides the languages in two, and its classifier is the
log odds of hashed byte n-grams (1 to 3 bytes of the lower-cased word with a mark at both ends) between
the two sides. All classifiers come from one table of counts by language and feature, summed over all
labelled documents before it leaves the executors, so its size depends on languages and features only.
A text's margins are decoded to the codeword of least logistic loss, each bit weighed by how well it
separates its two sides; a small lead over the next codeword flags the text as ambiguous.
"""

from __future__ import annotations

import itertools
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sieveframe.llm.tables import fold_remainder
from sieveframe.llm.toxicity import trimmed
from sieveframe.llm.words import mix, split

BITS = 14  # of a feature's hash
GRAMS = (1, 2, 3)
SMOOTHING = 0.5
EXHAUSTIVE = 5  # up to so many languages, every division into two sides is a bit
LEAD = 0.2  # lead in score under which a text is ambiguous
UNKNOWN = "und"
LETTER = r"\p{L}"


def word_grams(vocabulary: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """``(word, feature)`` of all n-grams of every word, with a mark before and after it."""
    marked = pc.binary_join_element_wise("\x02", pc.utf8_lower(vocabulary), "\x03", "")
    marked = pc.cast(marked, pa.string())
    offsets = np.frombuffer(marked.buffers()[1], np.int32)[marked.offset:marked.offset + len(marked) + 1]
    data = np.frombuffer(marked.buffers()[2], np.uint8)[offsets[0]:offsets[-1]].astype(np.uint64)
    words = np.repeat(np.arange(len(marked)), np.diff(offsets))
    owners, codes = [], []
    rolled = np.zeros(len(data), np.uint64)
    for k in range(max(GRAMS)):
        size = len(data) - k
        if size <= 0:
            break
        rolled = rolled[:size] << np.uint64(8) | data[k:]
        if k + 1 in GRAMS:
            inside = words[:size] == words[k:]
            owners.append(words[:size][inside])
            codes.append(mix(rolled[inside] + np.uint64(k + 1 << 32)) >> np.uint64(64 - BITS))
    owner = np.concatenate(owners) if owners else np.zeros(0, np.int64)
    code = np.concatenate(codes).astype(np.int64) if codes else np.zeros(0, np.int64)
    order = np.argsort(owner, kind="stable")
    return owner[order], code[order]


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    tables: dict[str, np.ndarray] = defaultdict(lambda: np.zeros(1 << BITS))
    for batch in batches:
        words = trimmed(split(batch.column("text")))
        word, gram = word_grams(words.vocabulary)
        langs = batch.column("lang").dictionary_encode()
        lang_of = langs.indices.to_numpy(zero_copy_only=False)[words.owners]
        for k, name in enumerate(langs.dictionary.to_pylist()):
            often = np.bincount(words.codes[lang_of == k], minlength=len(words.vocabulary))
            tables[name] += np.bincount(gram, often[word], 1 << BITS)
    for name, table in tables.items():
        used = np.flatnonzero(table)
        yield pa.RecordBatch.from_arrays([pa.array([name] * len(used), pa.string()), pa.array(used),
                                          pa.array(table[used].astype(np.int64))], ["lang", "feature", "n"])


def codewords(languages: int, seed: int = 5) -> np.ndarray:
    """A row of -1 and 1 for each language: all divisions of few languages, seeded ones of many."""
    if languages <= EXHAUSTIVE:
        columns = [(1, *rest) for rest in itertools.product((1, -1), repeat=max(0, languages - 1))][1:]
        return np.array(columns, float).reshape(len(columns), languages).T.reshape(languages, len(columns))
    rng = np.random.default_rng(seed)
    bits = int(np.ceil(10 * np.log2(languages)))
    best, distance = None, -1
    for _ in range(200):  # the draw whose nearest two codewords are farthest apart
        drawn = rng.choice((-1.0, 1.0), (languages, bits))
        near = ((bits - drawn @ drawn.T) / 2 + bits * np.eye(languages)).min()
        if near > distance and np.all(np.abs(drawn.sum(0)) < languages):
            best, distance = drawn, near
    return best


@dataclass
class Model:
    languages: list[str]
    code: np.ndarray  # languages x bits
    odds: np.ndarray  # features x bits
    trust: np.ndarray  # weight of a bit's loss


def fit(docs: DataFrame) -> Model:
    """Model of ``docs(text, lang)``; rows without text or language teach nothing."""
    labelled = docs.select(F.col("text").cast("string"), F.col("lang").cast("string")) \
        .where("text is not null and lang is not null")
    found = (labelled.mapInArrow(_counts, "lang string, feature long, n long")
             .groupBy("lang", "feature").agg(F.sum("n").alias("n")).toArrow())
    languages = sorted(set(found.column("lang").to_pylist()))
    place = {name: k for k, name in enumerate(languages)}
    counts = np.zeros((len(languages), 1 << BITS))
    counts[[place[x] for x in found.column("lang").to_pylist()], found.column("feature").to_numpy()] = \
        found.column("n").to_numpy()
    share = (counts + SMOOTHING) / (counts + SMOOTHING).sum(1, keepdims=True)  # each language weighs the same
    code = codewords(len(languages))
    sides = [np.log(np.stack([share[code[:, b] == side].mean(0) for b in range(code.shape[1])], 1))
             if code.size else np.zeros((1 << BITS, 0)) for side in (1, -1)]
    odds = sides[0] - sides[1]
    reach = (code * (share @ odds)).min(0) if code.size else np.zeros(0)  # mean log odds of the worst language
    trust = np.maximum(reach, 1e-3)
    return Model(languages, code, odds.astype(np.float32), trust / trust.sum() if len(trust) else trust)


def _decoded(model: Model, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best language, its share of the weight of all codewords, and its lead over the next."""
    words = trimmed(split(texts))
    word, gram = word_grams(words.vocabulary)
    bits = model.code.shape[1]
    by_word = np.stack([np.bincount(word, model.odds[gram, b], len(words.vocabulary)) for b in range(bits)], 1) \
        if bits else np.zeros((len(words.vocabulary), 0))
    grams = np.bincount(word, minlength=len(words.vocabulary))
    total = np.stack([np.bincount(words.owners, by_word[words.codes, b], len(texts)) for b in range(bits)], 1) \
        if bits else np.zeros((len(texts), 0))
    n = np.maximum(np.bincount(words.owners, grams[words.codes], len(texts)), 1)
    margin = total / np.sqrt(n)[:, None]  # grows with the text, but slower than the number of n-grams
    loss = np.stack([np.logaddexp(0, -margin * row) @ model.trust for row in model.code], 1)
    weight = np.exp(loss.min(1, keepdims=True) - loss)
    weight /= weight.sum(1, keepdims=True)
    best = weight.argmax(1)  # of equal ones, the first by name
    ranked = np.sort(weight, 1)
    lead = ranked[:, -1] - ranked[:, -2] if weight.shape[1] > 1 else np.ones(len(texts))
    return best, weight.max(1), lead


def identifier(model: Model):
    """A function of a text column: its language, a score from 0 to 1, and whether that is ambiguous."""
    @F.arrow_udf("lang_pred string, score double, ambiguous boolean")
    def identify(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        names = np.array(model.languages, object)
        for texts in batches:
            known = pc.fill_null(pc.match_substring_regex(texts, LETTER), False).to_numpy(zero_copy_only=False)
            if not model.languages:
                known = np.zeros(len(texts), bool)
            pred = np.full(len(texts), UNKNOWN, object)
            score, ambiguous = np.zeros(len(texts)), np.ones(len(texts), bool)
            if known.any():
                best, weight, lead = _decoded(model, texts)
                pred[known], score[known] = names[best][known], weight[known]
                ambiguous[known] = lead[known] < LEAD
            yield pa.StructArray.from_arrays([pa.array(pred, pa.string()), pa.array(score), pa.array(ambiguous)],
                                             ["lang_pred", "score", "ambiguous"])

    return identify


def held_out() -> Column:
    return F.coalesce(fold_remainder("doc_id", 3) == 1, F.lit(False))


def languages(docs: DataFrame) -> DataFrame:
    """``doc_id, held_out, lang_pred, score, ambiguous`` of every row of ``docs(doc_id, text, lang)``.

    The model learns from rows that are not held out and have a language; a null doc_id is not held
    out. A text that is null or has no letter, and every text if nothing was learned, is ``und`` with
    score 0. The prediction uses the text alone, so repeated texts agree. Other columns are ignored.
    """
    model = fit(docs.where(~held_out()))
    return docs.select("doc_id", held_out().alias("held_out"), identifier(model)(F.col("text")).alias("found")) \
        .select("doc_id", "held_out", "found.*")
