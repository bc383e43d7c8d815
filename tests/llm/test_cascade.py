"""Metrics of the cascade against a plain count, and a verdict that no order changes."""

import random
import re
import unicodedata

from pyspark.sql import functions as F

from sieveframe.llm import cascade

WORD = re.compile(r"[^\x20\x09-\x0d]+")


def metrics(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    covered = {p for i, w in enumerate(windows) if windows.count(w) > 1 for p in (i, i + 1, i + 2)}
    lines = [line for line in text.split("\n") if WORD.search(line)]
    return (len(words), sum(map(len, words)), sum(x in "#*$%&|<>" for x in text), len(lines) - len(set(lines)), len(covered))


def texts():
    rng = random.Random(11)
    out = [None, "", " \n \t", "a b c", "a b c a b c", "a a a", "a a a a", "x\n\nx\n x\nx", "#*$%&|<>", "É\x1cb\xa0c\x85d e", "z " * 5000]
    for _ in range(60):
        vocabulary = [rng.choice(("ab", "É", "***", "THE!!", "c|d", "1", "\U0001f600")) + str(rng.randint(0, 9)) for _ in range(rng.choice((2, 5, 40)))]
        out.append("".join(rng.choice(vocabulary) + rng.choice((" ", " ", "  ", "\n", "\t")) for _ in range(rng.choice((4, 30, 200)))))
    return out


def test_equals_plain_counts(spark):
    rows = list(enumerate(texts()))
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' as w", "1 as n", "2 as n_words")
    found = {r.doc_id: r for r in cascade.quality(df).collect()}
    for k, text in rows:
        r = found[k]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == metrics(text), repr(text)[:80]
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words) and not (r.base_failed and r.kept)


def test_order_follows_rejections_per_second_and_keeps_the_verdict(spark):
    df = spark.createDataFrame(list(enumerate(texts())), "doc_id long, text string")
    order = cascade.ordered(df)
    assert sorted(r.name for r, _, _ in order) == sorted(r.name for r in cascade.RULES)
    worth = [share / max(seconds, 1e-6) for _, seconds, share in order]
    assert worth == sorted(worth, reverse=True)
    frame = cascade.measured(df)
    one = frame.select("doc_id", cascade.short_circuit(cascade.RULES).alias("k"))
    two = frame.select("doc_id", cascade.short_circuit(cascade.RULES[::-1]).alias("k"))
    plain = frame.select("doc_id", (~F.lit(False) & ~sum([r.rejects().cast("int") for r in cascade.RULES], F.lit(0)).cast("boolean")).alias("k"))
    assert sorted(one.collect()) == sorted(two.collect()) == sorted(plain.collect())


def test_clean_documents_stay(spark):
    folder = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{folder}/labels.parquet").select("doc_id", "quality")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    rows = cascade.quality(docs).where("not base_failed").join(labels, "doc_id").collect()
    clean = [r.kept for r in rows if r.quality == 1]
    junk = [r.kept for r in rows if r.quality == 0]
    assert sum(clean) >= 0.99 * len(clean) and sum(junk) <= 0.2 * len(junk)


def test_null_ids_repeated_rows_and_empty_table(spark):
    df = spark.createDataFrame([(None, "a b"), (None, "a b"), (1, None)], "doc_id long, text string")
    assert cascade.quality(df).where("doc_id is null and n_words = 2").count() == 2
    assert cascade.quality(df.limit(0)).count() == 0
    assert unicodedata.category("É") == "Lu"
