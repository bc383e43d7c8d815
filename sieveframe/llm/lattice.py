"""Log probability of texts by unigram models over all segmentations of their words.

A text is a stream of words and one end. A word's lattice has arcs for the whole word, scored by its
discounted counts in the training texts, and, with the weight that the discount frees, every way to
spell the word and the space before it by pieces of an existing byte-level vocabulary. The probability
of a word is the sum over all paths, found by the forward recursion in log space; as no arc crosses a
word's start, the recursion over a text is the sum over its words. Piece scores start from their order
in the vocabulary and are fitted by expectation maximisation over the distinct words of all training
texts, which stay distributed: only one number for each piece reaches the driver.

Whole-word scores exist for every language that the training texts name (the ``CLASSES - 1`` most
frequent ones and all others together), each backing off to the common ones; a text's probability is
the sum over the languages it may be in, so its own language is never looked at.

Word counts grow with the corpus, so they are joined, not broadcast: the ``TOP`` most frequent words are
sent to all tasks, and the other words of a text go through a join on the word's hash. No key of that
join is frequent, as frequent words are in the table.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sieveframe.llm.tables import fold_remainder, stored
from sieveframe.llm.words import as_long, gathered, mix, slices, split

TOP = 1 << 17
CLASSES = 8
ROUNDS = 4
PRIOR = 1.0  # pseudo-count of all pieces together, dealt by their order in the vocabulary
SCALE = 1e6  # expected counts are summed as whole millionths, so that their order does not matter
FILTER_BITS = 22
WORDS = 50_000  # words whose lattices are swept together

SCORED = ("doc_id long, row_key long, held_out boolean, n_tokens long, n_known long, base double, paths array<double>, "
          "tail array<struct<word: long, times: int, spelled: double>>")


@dataclass
class Pieces:
    """Hashes of the pieces in ascending order, their log probabilities, and a filter over the hashes."""

    hashes: np.ndarray
    scores: np.ndarray
    longest: int
    first: np.ndarray  # which pieces start with the space

    def __post_init__(self):
        self.seen = np.zeros(1 << FILTER_BITS, bool)
        self.seen[(self.hashes >> np.uint64(64 - FILTER_BITS)).astype(np.int64)] = True

    def scored(self, scores: np.ndarray) -> Pieces:
        return Pieces(self.hashes, scores, self.longest, self.first)

    def per_word(self) -> float:
        """Log of the factor that makes the spellings of all words sum to 1."""
        weight = np.exp(self.scores)
        start = weight[self.first].sum()
        return float(np.log(1 - weight[~self.first].sum()) - np.log(start))

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the hashes are pieces, and their numbers."""
        maybe = np.flatnonzero(self.seen[(hashes >> np.uint64(64 - FILTER_BITS)).astype(np.int64)])
        at = np.minimum(np.searchsorted(self.hashes, hashes[maybe]), len(self.hashes) - 1)
        hit = self.hashes[at] == hashes[maybe]
        return maybe[hit], at[hit]


def rolled(hashes: np.ndarray, data: np.ndarray) -> np.ndarray:
    return mix(hashes * np.uint64(0x9E3779B97F4A7C15) + data + np.uint64(1))


def read_pieces(ranks: str) -> Pieces:
    """The pieces of a ranks file that lie within a word and its space, scored by their order alone."""
    with open(ranks, "rb") as lines:
        listed = [base64.b64decode(line.split()[0]) for line in lines]
    used = [(p, k) for k, p in enumerate(listed) if p == b" " or not any(x in b" \t\n\x0b\x0c\r" for x in p[p[:1] == b" ":])]
    hashes = np.zeros(len(used), np.uint64)
    for k, (piece, _) in enumerate(used):
        value = np.zeros(1, np.uint64)
        for x in piece:
            value = rolled(value, np.array([x], np.uint64))
        hashes[k] = value[0]
    weight = 1 / (np.array([rank for _, rank in used]) + 100.0)
    order = np.argsort(hashes)
    return Pieces(hashes[order], np.log(weight / weight.sum())[order], max(len(p) for p, _ in used),
                  np.array([p[:1] == b" " for p, _ in used])[order])


def arcs(words: pa.Array, pieces: Pieces) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Arcs ``(start, end, piece)`` over the bytes of all words, and each word's first position.

    Positions of word ``k`` are ``first[k]`` to ``first[k + 1] - 1``: one before each byte of the space
    and the word, and one after the last.
    """
    marked = pc.cast(pc.binary_join_element_wise(" ", words, ""), pa.large_string())
    offsets = np.frombuffer(marked.buffers()[1], np.int64)[marked.offset:marked.offset + len(marked) + 1]
    data = np.frombuffer(marked.buffers()[2], np.uint8)[offsets[0]:offsets[-1]].astype(np.uint64)
    offsets = offsets - offsets[0]
    sizes = np.diff(offsets)
    shift = np.repeat(np.arange(len(sizes)), sizes)  # positions have one more for each word before
    end_of = np.repeat(offsets[1:], sizes)
    starts, hashes = np.arange(len(data)), np.zeros(len(data), np.uint64)
    found = []
    for size in range(1, pieces.longest + 1):
        inside = starts + size <= end_of[starts]
        starts, hashes = starts[inside], hashes[inside]
        if not len(starts):
            break
        hashes = rolled(hashes, data[starts + size - 1])
        hit, number = pieces.find(hashes)
        at = starts[hit] + shift[starts[hit]]
        found.append((at, at + size, number))
    start, end, piece = (np.concatenate([f[k] for f in found]) for k in range(3)) if found else (np.zeros(0, np.int64),) * 3
    return start, end, piece, np.append(offsets[:-1] + np.arange(len(sizes)), len(data) + len(sizes))


def _swept(first: np.ndarray, n: int, source: np.ndarray, target: np.ndarray, score: np.ndarray, place: np.ndarray,
           begin: np.ndarray) -> np.ndarray:
    """Log sums of all paths from ``begin`` to every position; ``place`` orders the targets."""
    value = np.full(n, -np.inf)
    value[begin] = 0
    order = np.argsort(place * (n + 1) + target, kind="stable")
    source, target, score, place = source[order], target[order], score[order], place[order]
    cuts = np.flatnonzero(np.diff(place, prepend=-1))
    for low, high in zip(cuts, np.append(cuts[1:], len(place))):
        into, paths = target[low:high], value[source[low:high]] + score[low:high]
        groups = np.flatnonzero(np.diff(into, prepend=-1))
        top = np.maximum.reduceat(paths, groups)
        safe = np.where(np.isfinite(top), top, 0)
        total = np.add.reduceat(np.exp(paths - np.repeat(safe, np.diff(np.append(groups, len(paths))))), groups)
        with np.errstate(divide="ignore"):
            value[into[groups]] = safe + np.log(total)
    return value


def forward(words: pa.Array, pieces: Pieces, scores: np.ndarray | None = None) -> tuple:
    """Log probability of each word, and what ``expected`` needs."""
    start, end, piece, first = arcs(words, pieces)
    score = (pieces.scores if scores is None else scores)[piece]
    word = np.searchsorted(first, start, side="right") - 1
    n = int(first[-1]) if len(first) else 0
    alpha = _swept(first, n, start, end, score, end - first[word], first[:-1])
    return alpha[first[1:] - 1], (start, end, piece, score, word, first, alpha, n)


def expected(total: np.ndarray, state: tuple, times: np.ndarray, size: int) -> np.ndarray:
    """How often each piece is used over all paths of all words, each word counted ``times``."""
    start, end, piece, score, word, first, alpha, n = state
    beta = _swept(first, n, end, start, score, first[word + 1] - 1 - start, first[1:] - 1)
    share = np.exp(np.minimum(alpha[start] + score + beta[end] - total[word], 0))
    return np.bincount(piece, share * times[word], size)


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text"):
            words = split(part.column("text"))
            kind = part.column("class").to_numpy()[words.owners].astype(np.int64)
            pairs, often = np.unique(words.codes * CLASSES + kind, return_counts=True)
            yield pa.RecordBatch.from_arrays([words.vocabulary.take(pa.array(pairs // CLASSES)), pa.array(pairs % CLASSES),
                                              pa.array(often)], ["word", "class", "n"])


def _expected(batches: Iterator[pa.RecordBatch], pieces: Pieces) -> Iterator[pa.RecordBatch]:
    sums = np.zeros(len(pieces.hashes))
    for batch in gathered(batches, WORDS):
        total, state = forward(batch.column("word"), pieces)
        sums += expected(total, state, np.ones(batch.num_rows), len(sums))
    used = np.flatnonzero(sums)
    yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(np.round(sums[used] * SCALE).astype(np.int64))],
                                     ["piece", "n"])


def fitted(vocabulary: DataFrame, pieces: Pieces, rounds: int = ROUNDS) -> Pieces:
    """The pieces with scores that fit the distinct words of ``vocabulary(word)``.

    Each word counts once: spelling is for words that are rare or new.
    """
    prior = PRIOR * np.exp(pieces.scores)
    for _ in range(rounds):
        rows = (vocabulary.select("word").mapInArrow(partial(_expected, pieces=pieces), "piece long, n long")
                .groupBy("piece").agg(F.sum(F.col("n").cast("decimal(38,0)")).cast("double").alias("n")).toArrow())
        counts = prior.copy()
        counts[rows.column("piece").to_numpy()] += rows.column("n").to_numpy() / SCALE
        pieces = pieces.scored(np.log(counts / counts.sum()))
    return pieces


def frequent_words(vocabulary: DataFrame, most: int) -> DataFrame:
    """At most ``most`` rows of ``vocabulary(n, ...)``, the most frequent ones down to a threshold.

    The threshold comes from a histogram of the logarithms of the counts, which has some hundred rows
    at any size, so that no task sorts or gathers the vocabulary. Equal counts stay together.
    """
    step = F.floor(F.log2("n") * 16)
    steps = vocabulary.groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("words"), F.min("n").alias("least")).collect()
    taken, least = 0, None
    for row in sorted(steps, key=lambda r: -r.step):
        taken += row.words
        if taken > most:
            break
        least = row.least
    return vocabulary.where(F.col("n") >= least) if least is not None else vocabulary.limit(0)


@dataclass
class Model:
    """What scoring needs besides the counts of rare words; its size does not depend on the corpus."""

    pieces: Pieces
    top: np.ndarray  # hashes of the most frequent words, ascending
    spelled: np.ndarray  # log10 of the probability of all their spellings
    counts: np.ndarray  # of those words by class
    words: np.ndarray  # of training texts, by class
    distinct: np.ndarray  # by class
    all_distinct: int
    texts: np.ndarray  # by class
    discount: float

    @property
    def end(self) -> float:
        return (self.texts.sum() + 1) / (self.words.sum() + self.texts.sum() + 2)

    @property
    def freed(self) -> float:
        """The share of spelled words; that of a whole word is ``(count - discount) / (words + 1)``."""
        return (self.discount * self.all_distinct + 1) / (self.words.sum() + 1)

    @property
    def freed_by_class(self) -> np.ndarray:
        """The share that a class leaves to the common words."""
        return (self.discount * self.distinct + 1) / (self.words + 1)

    @property
    def prior(self) -> np.ndarray:
        return (self.texts + 1) / (self.texts + 1).sum()


def spellings(words: pa.Array, pieces: Pieces) -> np.ndarray:
    """Log10 of the probability of each word by its pieces."""
    return (forward(words, pieces)[0] + pieces.per_word()) / np.log(10) if len(words) else np.zeros(0)


def _spelled(batches: Iterator[pa.RecordBatch], pieces: Pieces) -> Iterator[pa.RecordBatch]:
    for batch in gathered(batches, WORDS):
        yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(spellings(batch.column("word"), pieces))],
                                         [*batch.schema.names[1:], "spelled"])


def _score(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text"):
            words = split(part.column("text"))
            hashes = words.hashes()
            spelled, by_class = np.zeros(len(hashes)), np.zeros((len(hashes), CLASSES))
            if len(model.top):
                at = np.minimum(np.searchsorted(model.top, hashes), len(model.top) - 1)
                found = model.top[at] == hashes
                by_class[found], spelled[found] = model.counts[at[found]], model.spelled[at[found]]
            n = by_class.sum(1)
            known = n > 0
            spelled[~known] = spellings(words.vocabulary.filter(pa.array(~known)), model.pieces)
            common = np.maximum(n - model.discount, 0) / (model.words.sum() + 1) + model.freed * 10.0 ** np.maximum(spelled, -300)
            whole = np.maximum(by_class - model.discount, 0) / (model.words + 1) + model.freed_by_class * common[:, None]
            path = np.log10(np.where(known[:, None], whole, 1))

            def summed(by_word: np.ndarray) -> np.ndarray:
                return np.bincount(words.owners, by_word[words.codes], words.texts)

            rest = ~known[words.codes]
            pairs, times = np.unique(words.owners[rest].astype(np.int64) << 32 | words.codes[rest], return_counts=True)
            offsets = np.searchsorted(pairs, np.arange(words.texts + 1, dtype=np.int64) << 32)
            codes = pairs & (1 << 32) - 1
            tail = pa.StructArray.from_arrays([pa.array(as_long(hashes[codes])), pa.array(times.astype(np.int32)),
                                               pa.array(spelled[codes])], ["word", "times", "spelled"])
            paths = np.stack([summed(path[:, k]) for k in range(CLASSES)], 1)
            yield pa.RecordBatch.from_arrays([
                part.column("doc_id"), part.column("row_key"), part.column("held_out"),
                pa.array(words.counts() + 1, pa.int64()), pa.array(summed(known).astype(np.int64)),
                pa.array(summed(np.log10(n + 1))),
                pa.ListArray.from_arrays(pa.array(np.arange(words.texts + 1, dtype=np.int32) * CLASSES), pa.array(paths.ravel())),
                pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), tail),
            ], ["doc_id", "row_key", "held_out", "n_tokens", "n_known", "base", "paths", "tail"])


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        hashes = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in batch.column("word").to_pylist()), np.uint64, batch.num_rows)
        yield pa.RecordBatch.from_arrays([pa.array(as_long(hashes)), *batch.columns], ["hash", *batch.schema.names])


def lattice_scores(docs: DataFrame, ranks: str, modulus: int = 7, remainder: int = 2, top: int = TOP, rounds: int = ROUNDS
                   ) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` of ``docs(doc_id, text, lang)``.

    Scores are log10 probabilities. A null or empty text is its end alone; a null doc_id is not held out
    and teaches; a null lang counts with the rarer languages; repeated rows are scored alike and teach as
    often as they come. Words of any length are read whole, and joined by a 64-bit hash. Other columns
    are ignored.
    """
    held_out = F.coalesce(fold_remainder("doc_id", modulus) == remainder, F.lit(False))
    taught = docs.where(~held_out)
    langs = taught.groupBy("lang").count().where("lang is not null").orderBy(F.desc("count"), "lang").limit(CLASSES - 1).collect()
    kind = F.lit(CLASSES - 1)
    for k, row in enumerate(langs):
        kind = F.when(F.col("lang") == row.lang, k).otherwise(kind)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")) \
        .withColumn("row_key", F.xxhash64("doc_id", "text")).withColumn("held_out", held_out)
    numbers = [f"n{k}" for k in range(CLASSES)]
    vocabulary = stored(
        taught.select(F.col("text").cast("string").alias("text"), kind.alias("class"))
        .mapInArrow(_word_counts, "word string, class long, n long").groupBy("word")
        .agg(*[F.coalesce(F.sum(F.when(F.col("class") == k, F.col("n"))), F.lit(0)).alias(c) for k, c in enumerate(numbers)])
        .withColumn("n", sum((F.col(c) for c in numbers[1:]), F.col(numbers[0])))
        .mapInArrow(_hashed, "hash long, word string, " + ", ".join(f"{c} long" for c in numbers) + ", n long"), "vocabulary")
    texts = np.zeros(CLASSES, np.int64)
    for row in taught.groupBy(kind.alias("class")).count().collect():
        texts[row["class"]] = row["count"]
    facts = vocabulary.agg(
        F.count(F.lit(1)).alias("v"), F.count(F.when(F.col("n") == 1, 1)).alias("once"), F.count(F.when(F.col("n") == 2, 1)).alias("twice"),
        F.array(*[F.coalesce(F.sum(c), F.lit(0)) for c in numbers]).alias("words"),
        F.array(*[F.count(F.when(F.col(c) > 0, 1)) for c in numbers]).alias("distinct")).first()
    pieces = fitted(vocabulary, read_pieces(ranks), rounds)
    frequent = frequent_words(vocabulary, top).select("word", "hash", *numbers).mapInArrow(
        partial(_spelled, pieces=pieces), "hash long, " + ", ".join(f"{c} long" for c in numbers) + ", spelled double").toArrow()
    hashes = frequent.column("hash").to_numpy().astype(np.int64).view(np.uint64)  # at most ``top`` rows
    order = np.argsort(hashes)
    counts = np.stack([frequent.column(c).to_numpy()[order] for c in numbers], 1)
    discount = min(max(facts.once / max(facts.once + 2 * facts.twice, 1), 0.1), 0.9)
    model = Model(pieces, hashes[order], frequent.column("spelled").to_numpy()[order], counts, np.array(facts.words),
                  np.array(facts.distinct), facts.v, texts, discount)
    scored = stored(rows.mapInArrow(partial(_score, model=model), SCORED), "scored")
    # A row without a word stands for its text, so that equal rows, which share a key, can be told apart.
    mark = F.struct(F.lit(None).cast("long").alias("word"), F.lit(0).alias("times"), F.lit(0.0).alias("spelled"))
    rest = scored.where(F.size("tail") > 0).select("row_key", F.explode(F.concat("tail", F.array(mark))).alias("t"))
    known = vocabulary.select(F.col("hash").alias("word"), "n", *numbers)
    found = rest.select("row_key", "t.word", "t.times", "t.spelled").join(known, "word", "left")
    total, freed, shares = int(model.words.sum()), float(model.freed), model.freed_by_class
    common = F.greatest(F.col("n") - F.lit(discount), F.lit(0.0)) / F.lit(total + 1.0) \
        + F.lit(freed) * F.pow(F.lit(10.0), F.greatest("spelled", F.lit(-300.0)))

    def path(k: int) -> Column:
        own = F.greatest(F.col(numbers[k]) - F.lit(discount), F.lit(0.0)) / F.lit(float(model.words[k] + 1))
        new = F.col("spelled") + F.lit(float(np.log10(freed) + np.log10(shares[k])))
        return F.when(F.col("n").isNull(), new).otherwise(F.log10(own + F.lit(float(shares[k])) * F.col("common")))

    sums = found.withColumn("common", common).groupBy("row_key").agg(
        F.count(F.when(F.col("word").isNull(), 1)).alias("copies"),
        F.coalesce(F.sum(F.when(F.col("n").isNotNull(), F.col("times"))), F.lit(0)).alias("known"),
        F.coalesce(F.sum(F.col("times") * F.log10(F.col("n") + 1)), F.lit(0.0)).alias("log"),
        *[F.sum(F.when(F.col("times") > 0, F.col("times") * path(k)).otherwise(0.0)).alias(f"path{k}") for k in range(CLASSES)])
    train_tokens, distinct = total + int(texts.sum()), facts.v + int(texts.sum() > 0)
    size = float(np.log10(train_tokens + distinct + 1))

    def with_rest(own: Column, rest: str) -> Column:
        return own + F.coalesce(F.col(rest) / F.col("copies"), F.lit(0.0))

    base = with_rest(F.col("base"), "log") + F.lit(float(np.log10(texts.sum() + 1))) - F.col("n_tokens") * F.lit(size)
    ends = (F.col("n_tokens") - 1) * F.lit(float(np.log10(1 - model.end))) + F.lit(float(np.log10(model.end)))
    by_class = F.array(*[with_rest(F.col("paths")[k], f"path{k}") + F.lit(float(np.log10(model.prior[k]))) for k in range(CLASSES)])
    n_known = with_rest(F.col("n_known"), "known").cast("long") + F.lit(int(texts.sum() > 0))
    summed = F.log10(F.aggregate("by_class", F.lit(0.0), lambda a, x: a + F.pow(F.lit(10.0), x - F.array_max("by_class"))))
    return scored.join(sums, "row_key", "left").withColumn("by_class", by_class).select(
        "doc_id", "held_out", "n_tokens", n_known.alias("n_known"), F.lit(train_tokens).cast("long").alias("train_tokens"),
        base.alias("base_score"), (F.array_max("by_class") + summed + ends).alias("score"))
