"""Toxicity: held-out labels, and results without a model."""

import pytest
from pyspark.sql import functions as F

from tabsift.llm import toxicity
from tabsift.llm.common import crc_mod

from .conftest import ALL_IDS, same_ids


@pytest.fixture(scope="module")
def labelled(spark):
    """Texts in which one document of four holds a few telling words."""
    import random
    r = random.Random(5)
    plain = ["".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(2, 8))) for _ in range(800)]
    bad = ["vexworm", "grumpelt", "sniddle", "blatter", "zorkish"]
    rows, labels = [], []
    for i in range(1200):
        words = [r.choice(plain) for _ in range(r.randint(20, 120))]
        toxic = i % 4 == 0
        if toxic:
            for _ in range(r.randint(1, 4)):
                words.insert(r.randrange(len(words)), r.choice(bad))
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    return spark.createDataFrame(rows, "doc_id long, text string").cache(), spark.createDataFrame(labels, "doc_id long, toxic int").cache()


def test_held_out_accuracy(labelled):
    docs, labels = labelled
    model = toxicity.train(docs, labels)
    rows = toxicity.toxicity(docs, model).join(labels, "doc_id").filter(crc_mod(F.col("doc_id"), 5) == 0).collect()
    assert len(rows) > 200
    assert sum(r["predicted"] == r["toxic"] for r in rows) >= 0.97 * len(rows)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in rows)
    for r in rows[:20]:
        assert r["score"] == toxicity.score({x["doc_id"]: x["text"] for x in docs.filter(F.col("doc_id") == r["doc_id"]).collect()}[r["doc_id"]], model)


def test_held_out_labels_are_not_read(labelled):
    docs, labels = labelled
    changed = labels.withColumn("toxic", F.when(crc_mod(F.col("doc_id"), 5) == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert toxicity.train(docs, labels) == toxicity.train(docs, changed)


def test_difference_is_that_of_the_compressors(labelled):
    docs, labels = labelled
    model = toxicity.train(docs, labels)
    pair = [toxicity._compressor(d) for d in (model.ordinary, model.toxic)]
    words = toxicity.windows("Vexworm, and the zorkish abc!")
    plain = [len(pair[0].compress(f)) - len(pair[1].compress(f)) for w in words for f in [toxicity.BEFORE + b" " + w + b" " + toxicity.AFTER]]
    assert toxicity.window_differences("Vexworm, and the zorkish abc!", model).tolist() == plain and plain[0] >= model.threshold


def test_without_a_class(spark, labelled):
    docs, labels = labelled
    for kept, score in ((labels.limit(0), 0.0), (labels.filter("toxic = 0"), 0.0), (labels.filter("toxic = 1"), 1.0)):
        model = toxicity.train(docs, kept)
        assert {r["score"] for r in toxicity.toxicity(docs.limit(5), model).collect()} == {score}


def test_odd_documents(odd_documents, labelled):
    docs, empty, _ = odd_documents
    model = toxicity.train(*labelled)
    rows = toxicity.toxicity(docs, model).collect()
    assert same_ids(rows) == ALL_IDS
    assert len({r["score"] for r in rows if r["doc_id"] in (2, 3, 6)}) == 1
    assert toxicity.toxicity(empty, model).count() == 0
    odd_labels = labelled[1].unionByName(labelled[1].limit(40)).withColumn("toxic", F.when(F.col("doc_id") == 3, None).when(F.col("doc_id") == 7, 9).otherwise(F.col("toxic"))).withColumn("text", F.lit("x"))
    assert toxicity.train(labelled[0], odd_labels.withColumn("doc_id", F.when(F.col("doc_id") != 11, F.col("doc_id")))).constant is None
