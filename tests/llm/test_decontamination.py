"""Decontamination against a plain version, and the cases that the docstring states."""

import hashlib
import random
import re
from collections import Counter

import pytest

from sieveframe.llm import decontamination

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words_of(text):
    return WORD.findall((text or "").translate({k: k + 32 for k in range(65, 91)}))


def hits(words, items, size):
    hit, met = set(), set()
    for item_id, text in items:
        w = words_of(text)
        n = min(size, len(w))
        for i in range(len(w) - n + 1) if w else ():
            for p in range(len(words) - n + 1):
                if words[p:p + n] == w[i:i + n]:
                    hit.update(range(p, p + n))
                    met.add(item_id)
    return hit, sorted(str(m) for m in met if m is not None)


def brute(docs, items, size):
    out = []
    for doc_id, text in docs:
        words = words_of(text)
        hit, met = hits(words, items, size)
        out.append((doc_id, len(words), len(hit), len(met), hashlib.sha256(",".join(met).encode()).hexdigest(), bool(hit)))
    return Counter(out)


def made(seed, size):
    rng = random.Random(seed)
    vocabulary = ["Alpha", "beta", "É", "é", "x9", "Don't", "語"]
    items = [(k, " ".join(rng.choices(vocabulary, k=rng.choice((1, 2, size - 1, size, size + 1, 3 * size))))) for k in range(12)]
    items += [(3, None), (None, " ".join(rng.choices(vocabulary, k=size))), (50, ""), (2, items[2][1]), (101, items[3][1])]
    docs = []
    for k in range(60):
        words = rng.choices(vocabulary + [f"w{x}" for x in range(40)], k=rng.choice((0, 1, 9, 40, 200)))
        for _ in range(rng.randint(0, 2)):
            at = rng.randrange(len(words) + 1)
            words[at:at] = (rng.choice(items)[1] or "").upper().split()
        docs.append((k, rng.choice((" ", ", ", "\n")).join(words)))
    return docs + [(70, None), (71, ""), (None, items[2][1]), (5, docs[5][1]), (5, docs[5][1])], items


@pytest.mark.parametrize("size,sent", [(4, 64 << 20), (4, 0), (10, 64 << 20)], ids=["short", "joined", "ten"])
def test_equals_the_plain_version(spark, monkeypatch, size, sent):
    monkeypatch.setattr(decontamination, "BLOCK", 7)  # texts cross the borders of blocks
    docs, items = made(size, size)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = decontamination.contamination(df, bench, size, sent).collect()
    assert Counter(tuple(r) for r in found) == brute(docs, items, size)


def test_spans_and_documents_go(spark):
    items = [(1, "one two three"), (2, "Nine")]
    docs = [(1, "  Zero one, TWO three! Four.", "a"), (2, "none here", "b"), (3, "nine-nine", "c"), (4, None, "d"), (5, "x nine y NINE", "e"),
            (6, "one two three one two three five", "f")]
    df = spark.createDataFrame(docs, "doc_id long, text string, hit string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    cut = {r["doc_id"]: r["text"] for r in decontamination.decontaminated(df, bench, "spans", size=3).collect()}
    assert cut == {1: "  Zero Four.", 2: "none here", 3: "", 4: None, 5: "x y ", 6: "five"}
    kept = decontamination.decontaminated(df, bench, "documents", size=3)
    assert kept.columns == df.columns and sorted(r["doc_id"] for r in kept.collect()) == [2, 4]
    with pytest.raises(ValueError):
        decontamination.decontaminated(df, bench, "lines")


def test_cut_texts_hold_the_words_that_were_not_hit(spark):
    docs, items = made(8, 4)
    df = spark.createDataFrame(docs, "doc_id long, text string").dropDuplicates()
    bench = spark.createDataFrame(items, "item_id long, text string")
    cut = decontamination.decontaminated(df, bench, "spans", size=4).collect()
    expected = Counter()
    for doc_id, text in set(docs):
        words = words_of(text)
        hit, _ = hits(words, items, 4)
        expected[doc_id, tuple(w for k, w in enumerate(words) if k not in hit)] += 1
    assert Counter((r["doc_id"], tuple(words_of(r["text"]))) for r in cut) == expected


def test_empty_tables_and_a_long_text(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    nothing = spark.createDataFrame([], "item_id long, text string")
    assert decontamination.contamination(none, bench).count() == 0
    assert decontamination.contamination(spark.createDataFrame([(1, "a b")], "doc_id long, text string"), nothing).collect()[0]["n_hit"] == 0
    long = spark.createDataFrame([(1, "z " * 60_000 + "a b c"), (2, "x" * 1_000_000)], "doc_id long, text string")
    found = {r["doc_id"]: (r["n_words"], r["n_hit"]) for r in decontamination.contamination(long, bench).collect()}
    assert found == {1: (60_003, 3), 2: (1, 0)}


def test_repeated_rows_come_back_as_often(spark):
    rows = spark.createDataFrame([(1, "a b c")] * 2345, "doc_id long, text string")
    bench = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    found = decontamination.contamination(rows, bench).groupBy("n_hit").count().collect()
    assert [tuple(r) for r in found] == [(2, 2345)]


def test_no_python_in_the_plan(spark):
    bench = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    plan = decontamination.matched(docs, decontamination.test_set(bench))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "BroadcastHashJoin" in plan
