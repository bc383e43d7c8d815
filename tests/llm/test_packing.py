"""Packing against the tokenizer of the same vocabulary, and the windows' rules."""

import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from sieveframe.llm import packing
from sieveframe.llm.catalog import vocabulary


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(vocabulary().tokenizer)
    tokenizer.encode_special_tokens = True
    return tokenizer


def test_ids_are_those_of_the_tokenizer(tokenizer):
    encode = vocabulary().encoder()
    rng = random.Random(5)
    parts = [" ", "  ", "\t", "\n", "\r", "\x0b", "\x85", "\xa0", " ", "　", "\x1c", "a", "b's", "'ll", "12", "é́", "中文",
             "\U0001f600", "½", "<|endoftext|>", "_-$%", "\x00", "﻿"]
    for _ in range(1500):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 30)))
        assert list(encode(text)) == tokenizer.encode(text, add_special_tokens=False).ids
    assert len(encode(" " * 600_000)) == len(tokenizer.encode(" " * 600_000, add_special_tokens=False).ids)


def rows_of(spark):
    rng = random.Random(6)
    rows = [(k, " ".join(rng.choice(("alpha", "Beta", "über", "42")) for _ in range(rng.choice((0, 1, 50, 900, 4000))))) for k in range(60)]
    return rows + [(None, "no id"), (3, None), (4, ""), (4, ""), (5, "x" * 100_000)]


def check(rows, pieces, tokenizer):
    pieces = [tuple(p) for p in pieces]
    expected = defaultdict(list)
    for doc_id, text in rows:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [packing.END]
        expected[doc_id].append(np.array(ids, np.uint32))
    whole = defaultdict(int)
    for doc_id, start, length, crc, tokens, _, _ in pieces:
        assert any(len(x) == tokens and zlib.crc32(x[start:start + length].astype("<u4").tobytes()) == crc for x in expected[doc_id])
        whole[doc_id] += length
    assert whole == {k: sum(map(len, v)) for k, v in expected.items()}
    sequences = defaultdict(list)
    for _, _, length, _, _, sequence, offset in pieces:
        sequences[sequence].append((offset, length))
    for parts in sequences.values():
        parts.sort()
        assert [o for o, _ in parts] == [0, *np.cumsum([n for _, n in parts])[:-1]]
        total = sum(n for _, n in parts)
        assert total <= 2048 and total & (total - 1) == 0  # full, or a power of two: nothing is padded
    return sequences


def test_each_id_lies_in_one_piece_and_nothing_is_padded(spark, tokenizer):
    rows = rows_of(spark)
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' as ids", "1 as length").repartition(3)
    check(rows, packing.pack(df, vocabulary(), with_ids=False).collect(), tokenizer)


def test_ids_and_empty_table(spark):
    df = spark.createDataFrame([(1, "one two")], "doc_id long, text string")
    rows = sorted(packing.pack(df, vocabulary()).collect(), key=lambda r: r.start)
    ids = [x for r in rows for x in r.ids]
    assert [r.length for r in rows] == [len(r.ids) for r in rows] == [2, 1]
    assert ids == [*vocabulary().encoder()("one two"), packing.END]
    assert packing.pack(df.limit(0), vocabulary()).count() == 0


def test_level_makes_the_sum_of_squares_least():
    rng = np.random.default_rng(7)
    for _ in range(200):
        windows = packing.Windows(16)
        windows.levels[1:16] = rng.integers(0, 4, 15)
        size = int(rng.integers(1, 16))

        def cost(level):
            after = windows.levels.copy()
            after[level] -= level > 0
            if level + size < 16:
                after[level + size] += 1
            return int((after[1:16] ** 2).sum())

        allowed = [0, *[h for h in range(1, 17 - size) if windows.levels[h]]]
        assert cost(windows.level_for(size)) == min(map(cost, allowed))


def test_open_windows_are_bounded():
    windows = packing.Windows(16, max_open=5)
    for k in range(100):
        windows.add(k, np.full(9, k, np.uint32))
        assert windows.n_open <= 6
    windows.close()
    lengths = [sum(len(p[2]) for p in w) for w in windows.done]
    assert sum(lengths) == 900 and all(n & (n - 1) == 0 for n in lengths) and sum(n < 16 for n in lengths) <= 4
