"""Lattice sums against all segmentations, counts against a plain count, and scores that are a distribution."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from sieveframe.llm import lattice
from sieveframe.llm.catalog import vocabulary

RANKS = vocabulary("byte_bpe_multi_50k").ranks
WORD = re.compile(r"[^\x20\x09-\x0d]+")


@pytest.fixture(scope="module")
def small():
    """Pieces of a few strings, with their probabilities by name."""
    names = [b" ", b"a", b"b", b" a", b"ab", b" ab", b"aba", "é".encode()]
    hashes = []
    for name in names:
        value = np.zeros(1, np.uint64)
        for x in name:
            value = lattice.rolled(value, np.array([x], np.uint64))
        hashes.append(value[0])
    scores = np.log(np.array([.1, .2, .05, .15, .1, .2, .1, .1]))
    order = np.argsort(np.array(hashes, np.uint64))
    pieces = lattice.Pieces(np.array(hashes, np.uint64)[order], scores[order], 3, np.array([n[:1] == b" " for n in names])[order])
    return pieces, dict(zip(names, np.exp(scores))), [names[k] for k in order]


def all_cuts(text):
    if not text:
        yield []
    for k in range(1, len(text) + 1):
        for rest in all_cuts(text[k:]):
            yield [text[:k], *rest]


def test_sums_over_all_segmentations(small):
    pieces, weight, names = small
    words = ["a", "abab", "b", "é", "aé", "x", "babaab", "a" * 300]
    total, state = lattice.forward(pa.array(words), pieces)
    uses = lattice.expected(total[:5], lattice.forward(pa.array(words[:5]), pieces)[1], np.arange(1, 6), len(names))
    expected = Counter()
    for k, word in enumerate(words[:-1]):
        paths = [cut for cut in all_cuts(b" " + word.encode()) if all(p in weight for p in cut)]
        values = [math.prod(weight[p] for p in cut) for cut in paths]
        assert np.isclose(np.exp(total[k]), sum(values))
        for cut, value in zip(paths, values):
            for p in cut:
                if k < 5:
                    expected[p] += (k + 1) * value / sum(values)
    assert np.allclose(uses, [expected[n] for n in names])
    assert np.isfinite(total[-1])


def test_spellings_of_all_words_sum_to_one(small):
    pieces, weight, _ = small
    start = sum(w for p, w in weight.items() if p[:1] == b" ")
    inner = 1 - start
    assert np.isclose(np.exp(pieces.per_word()), (1 - inner) / start)


def plain(rows):
    """The columns of the contract, by counting."""
    def words(text):
        return [w.translate({k: k + 32 for k in range(65, 91)}) for w in WORD.findall(text or "")]

    out_of = [doc_id is not None and zlib.crc32(str(doc_id).encode()) % 7 == 2 for doc_id, _, _ in rows]
    counts, texts = Counter(), 0
    for (_, text, _), out in zip(rows, out_of):
        if not out:
            counts.update(words(text))
            texts += 1
    n, v = sum(counts.values()) + texts, len(counts) + (texts > 0)
    for (doc_id, text, _), out in zip(rows, out_of):
        cs = [counts[w] for w in words(text)] + [texts]
        yield doc_id, out, len(cs), sum(c > 0 for c in cs), n, sum(math.log10((c + 1) / (n + v + 1)) for c in cs)


@pytest.mark.parametrize("top", [0, 3, 1 << 17])
def test_counts_and_base_score(spark, top):
    rows = [(k, " ".join(("The", "cat", "sat", f"w{k % 11}", f"é{k}")[: k % 6]), "en" if k % 2 else "fr") for k in range(60)]
    rows += [(None, "the cat", None), (5, None, "en"), (6, "", None), (7, "new7 new7 CAT", "en"), (7, "new7 new7 CAT", "en"), (8, "q" * 30_000, "fr")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", "'x' as word", "1 as n", "2 as path0")
    found = lattice.lattice_scores(df, RANKS, top=top, rounds=1).collect()

    def key(r):
        return (r[0] is None, r[0] or 0, *r[1:5], round(r[5], 6))

    assert sorted(map(key, (tuple(r)[:6] for r in found))) == sorted(map(key, plain(rows)))
    assert all(r.score < 0 and math.isfinite(r.score) for r in found)


def test_rare_words_score_alike_by_table_and_by_join(spark):
    rows = [(k, f"a b c{k % 5} d{k}", "en") for k in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    one, two = ({r.doc_id: r.score for r in lattice.lattice_scores(df, RANKS, top=t, rounds=1).collect()} for t in (2, 10_000))
    assert all(math.isclose(one[k], two[k], rel_tol=1e-9) for k in one)


def test_known_words_of_one_length_stay_a_distribution(spark):
    rows = [(k, f"w{k % 3}", "en" if k % 2 else "fr") for k in range(70)]
    df = spark.createDataFrame(rows + [(1000 + k, f"w{k}", None) for k in range(3)] + [(2000, "", None)], "doc_id long, text string, lang string")
    scores = {r.doc_id: 10 ** r.score for r in lattice.lattice_scores(df, RANKS, rounds=1).collect()}
    assert sum(scores[1000 + k] for k in range(3)) + scores[2000] < 1


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert lattice.lattice_scores(df, RANKS, rounds=1).count() == 0
