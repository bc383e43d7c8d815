"""Language identification: codes, counts against a plain count, held-out accuracy, odd rows."""

import numpy as np
import pyarrow as pa
import pytest

from sieveframe.llm import langid
from sieveframe.llm.catalog import QUERIES


@pytest.mark.parametrize("languages", [0, 1, 2, 3, 4, 5, 6, 12, 40])
def test_codewords_tell_languages_apart(languages):
    code = langid.codewords(languages)
    assert code.shape[0] == languages
    assert len({tuple(row) for row in code}) == languages or languages < 2
    assert all(abs(column.sum()) < languages for column in code.T)


def test_grams_of_a_word():
    words, grams = langid.word_grams(pa.array(["ab", "", "é"]))
    # two marks and the bytes between: all runs of 1 to 3
    assert np.bincount(words, minlength=3).tolist() == [4 + 3 + 2, 2 + 1, 4 + 3 + 2]
    assert len(set(grams[words == 0])) == 9


def test_held_out_documents(spark):
    folder = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "lang")
    rows = QUERIES["op5_language_id_ecoc"](spark, folder).where("held_out").join(docs, "doc_id").collect()
    assert sum(r.lang == r.lang_pred for r in rows) >= 0.97 * len(rows)


def test_odd_rows(spark):
    rows = [(k, "the cat and the dog " * 3 if k % 2 else "der Hund und die Katze " * 3, "en" if k % 2 else "de") for k in range(20)]
    rows += [(None, "the dog", None), (21, None, "en"), (22, "", "de"), (23, "12 34 --", None), (24, "und " * 50_000, None), (24, "the", None), (24, "the", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", "'x' as found", "2 as score")
    found = {(r.doc_id, k): r for k, r in enumerate(langid.languages(df).collect())}
    by_row = [found[key] for key in sorted(found, key=lambda x: x[1])]
    assert [r.lang_pred for r in by_row[20:]] == ["en", "und", "und", "und", "de", "en", "en"]
    assert all(0 <= r.score <= 1 for r in by_row) and not by_row[20].held_out
    assert [r.score for r in by_row[21:24]] == [0, 0, 0] and by_row[21].ambiguous
    assert langid.languages(df.limit(0)).count() == 0


def test_nothing_learned_and_one_language(spark):
    df = spark.createDataFrame([(2, "words", None)], "doc_id long, text string, lang string")
    assert langid.languages(df).first().lang_pred == "und"
    df = spark.createDataFrame([(k, "words", "en") for k in range(9)], "doc_id long, text string, lang string")
    assert {r.lang_pred for r in langid.languages(df).collect()} == {"en"}
