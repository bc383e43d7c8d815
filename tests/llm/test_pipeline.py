"""The stages one by one against plain expectations, on a small table with odd rows."""

import random

import pytest

import corpus_pipeline
from sieveframe.llm import pseudonyms, toxicity
from sieveframe.llm.tables import stored


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(12)
    rows, labels = [], []
    for k in range(300):
        words = [f"w{rng.randrange(800)}" for _ in range(rng.choice((5, 60, 200)))]
        toxic = k % 6 == 0
        if toxic:
            words[::4] = ["vile"] * len(words[::4])
        rows.append((k, " ".join(words), rng.choice(("en", None)), rng.choice("abc"), None))
        labels.append((k, 1, int(toxic)))
    rows += [(400, rows[1][1], "en", "a", 3), (402, "card 4111111111111111", None, "b", 1),
             (403, None, None, "c", None), (None, "no id but words enough to be five or more", None, "a", None), (404, "", "en", "b", 0)]
    path = str(tmp_path_factory.mktemp("tables"))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.selectExpr("*", "1 as _n", "2 as __n", "'x' as row_key", "0 as _toxic", "1 as _row").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, stored(stage(spark, docs, folder), f"test-{name}")
        seen[name] = {r.doc_id for r in docs.select("doc_id").collect()}
        if name != "packing":
            assert docs.columns == columns
        if name == "toxicity":
            score = toxicity.toxicity(before, spark.read.parquet(f"{folder}/labels.parquet")).collect()
            assert seen[name] == {r.doc_id for r in score if r.score < toxicity.THRESHOLD}
            assert not seen[name] & {k for k in range(0, 300, 6)} and seen[name] >= {k for k in range(300) if k % 6}
        if name == "near_dedup":
            assert not seen[name] & {400} and {1, 402, 403, 404, None} <= seen[name]
        if name == "pii":
            text = docs.where("doc_id = 402").first()
            new = pseudonyms.only_digits(text.text)
            assert new != "4111111111111111" and int(new[-1]) == pseudonyms.luhn(new[:-1]) and text.n_chars == len(text.text)
        if name == "mixing":
            assert not seen[name] & {403, 404}  # they have no words to take
    assert seen["packing"] == seen["mixing"]


def test_empty_documents(spark, folder, tmp_path):
    spark.read.parquet(f"{folder}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{folder}/labels.parquet").limit(0).write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_run_is_the_stages_in_turn(spark, folder):
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "near_dedup", "pii", "mixing", "packing"]
    pieces = corpus_pipeline.run(spark, folder)
    assert pieces.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    assert pieces.count() > 0


def test_near_duplicates_from_four_fifths_on(spark, folder):
    rows = []
    for k in range(40):
        words = [f"d{k}w{i}" for i in range(100)]
        near, far = list(words), list(words)
        for i in (20, 60):
            near[i] = "changed"  # 86 of 106 shingles in common: 0.811
        for i in (20, 50, 80):
            far[i] = "other"  # 81 of 111: 0.73
        rows += [(3 * k, " ".join(words)), (3 * k + 1, " ".join(near)), (3 * k + 2, " ".join(far))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = {r.doc_id for r in dict(corpus_pipeline.STAGES)["near_dedup"](spark, docs, folder).collect()}
    assert kept == {r[0] for r in rows if r[0] % 3 != 1}
