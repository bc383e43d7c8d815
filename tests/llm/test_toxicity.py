"""FTRL against its definition, features against a plain list, held-out accuracy, odd rows."""

import numpy as np
import pyarrow as pa

from pyspark.sql import functions as F

from sieveframe.llm import toxicity
from sieveframe.llm.catalog import QUERIES


def test_one_step_is_the_definition():
    model = toxicity.Ftrl(4, alpha=0.5, beta=1.0, l1=0.1, l2=0.2)
    z, n = np.zeros(5), np.zeros(5)
    for at, label in (([0, 2, 4], 1), ([1, 2, 4], 0), ([0, 4], 1)):
        w = np.zeros(5)
        for i in range(5):
            l1 = 0 if i == 4 else 0.1
            if abs(z[i]) > l1:
                w[i] = -(z[i] - np.sign(z[i]) * l1) / ((1 + np.sqrt(n[i])) / 0.5 + 0.2)
        p = 1 / (1 + np.exp(-w[at].sum()))
        for i in at:
            g = p - label
            step = (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / 0.5
            z[i] += g - step * w[i]
            n[i] += g * g
        model.learn(np.array(at), label)
    assert np.allclose(model.z, z) and np.allclose(model.n, n)


def test_features_are_words_neighbours_and_skips():
    owners, found = toxicity.features(pa.array(["One, two three!", None, "", "...", "two"]))
    assert np.bincount(owners, minlength=5).tolist() == [3 + 2 + 1, 0, 0, 0, 1]
    same = toxicity.features(pa.array(["ONE two. THREE"]))[1]
    assert sorted(same) == sorted(found[owners == 0])
    assert found[owners == 4][0] in found[owners == 0]


def test_learns_planted_words_and_leaves_the_rest(spark):
    rows = [(k, "bad word here " * (k % 5 == 0) + " ".join(f"w{(k * 7 + i) % 90}" for i in range(30))) for k in range(600)]
    docs = spark.createDataFrame(rows + [(None, "bad"), (601, None), (602, ""), (0, rows[0][1])], "doc_id long, text string") \
        .selectExpr("*", "1 as score", "0 as label")
    labels = spark.createDataFrame([(k, int(k % 5 == 0)) for k in range(600)] + [(None, 1), (3, None)], "doc_id long, toxic int")
    found = toxicity.toxicity(docs, labels).collect()
    assert len(found) == 604 and all(0 <= r.score <= 1 for r in found)
    for r in found:
        if r.doc_id is not None and r.doc_id < 600:
            assert r.predicted == (r.doc_id % 5 == 0)
    assert not next(r for r in found if r.doc_id is None).held_out
    assert len({r.score for r in found if r.doc_id == 0}) == 1


def test_no_labels_and_no_rows(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    assert toxicity.toxicity(docs, labels).first().score == 0.5
    assert toxicity.toxicity(docs.limit(0), labels).count() == 0


def test_held_out_documents(spark):
    folder = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{folder}/labels.parquet").select("doc_id", "toxic")
    rows = QUERIES["op9_toxicity_ftrl"](spark, folder).where("held_out").join(labels, "doc_id").collect()
    toxic = [r.predicted for r in rows if r.toxic == 1]
    clean = [r.predicted for r in rows if r.toxic == 0]
    assert sum(clean) <= 0.05 * len(clean) and sum(toxic) >= 0.5 * len(toxic)


def test_repeated_ids_teach_once_and_within_the_bound(spark):
    rows = [(k, "vile words here" if k % 2 else "kind words there") for k in range(6)]
    labels = spark.createDataFrame([(k, k % 2) for k in range(6)], "doc_id long, label int")

    def fitted(rows, **options):
        features, weights = toxicity.fit(spark.createDataFrame(rows, "doc_id long, text string"), labels, bits=12, epochs=1, **options)
        return features.tolist(), weights.tolist()

    assert fitted(rows + [rows[1]] * 300) == fitted(rows)
    texts = [(1, f"vile {k}") for k in range(300)]
    first = spark.createDataFrame(texts, "doc_id long, text string").orderBy(F.xxhash64("text"), "text").limit(6).collect()
    assert fitted(texts, train_rows=6) == fitted([tuple(r) for r in first], train_rows=6)
