"""Importance resampling against plain Python, term by term."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tabsift.llm import importance

from .conftest import ALL_IDS, same_ids

TEXTS = ["", None, "one", "One two-three", "  --  ", "a b a b a", "Über ÉCOLE naïve", "x\x00y 7up 7UP", "東京 タワー 東京", "end. ", "\n\t"]


def plain_words(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)


def plain_grams(text, most=2):
    w = plain_words(text)
    return [" ".join(w[i:i + n]) for n in range(1, most + 1) for i in range(len(w) - n + 1)]


def plain_draw(docs, target, percent=25, least=20, most=2, size=10000):
    bucket = lambda g: zlib.crc32(g.encode()) % size
    s, t = Counter(), Counter()
    for _, text in docs:
        s.update(map(bucket, plain_grams(text, most)))
    for text in target:
        t.update(map(bucket, plain_grams(text, most)))
    sa, ta = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1.0) * (sa + size) / ((s[b] + 1.0) * (ta + size))))
    out = []
    for doc_id, text in docs:
        grams = plain_grams(text, most)
        weight = sum(gain(bucket(g)) for g in grams) // len(grams) if grams else 0
        h = int(hashlib.sha256(f"7:{'null' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        out.append([doc_id, len(plain_words(text)), len(grams), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), None])
    can = sorted((r for r in out if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0]))
    for i, r in enumerate(can[:len(can) * percent // 100]):
        r[5] = i + 1
    return sorted(map(tuple, out), key=repr)


@pytest.mark.parametrize("most", [1, 2, 3, 4])
def test_grams_of_texts(most):
    grams = importance.grams_of(pa.array(TEXTS), most, 1000)
    assert grams.words.tolist() == [len(plain_words(t)) for t in TEXTS]
    for n, (index, owner) in enumerate(grams.orders, 1):
        true = [(i, zlib.crc32(g.encode()) % 1000) for i, t in enumerate(TEXTS) for g in plain_grams(t, n) if len(g.split(" ")) == n]
        assert list(zip(owner.tolist(), grams.buckets[index].tolist(), strict=True)) == true


def test_no_words_at_all():
    for texts in ([], [None, ""], ["--"]):
        grams = importance.grams_of(pa.array(texts, pa.string()), 3)
        assert grams.words.tolist() == [0] * len(texts) and all(not len(i) for i, _ in grams.orders)


def test_gains_by_hand():
    gains = importance.bucket_gains(np.array([3, 0]), np.array([0, 5]))
    assert gains.tolist() == [math.floor(1000 * math.log(1 * 5 / (4 * 7))), math.floor(1000 * math.log(6 * 5 / 7))]


@pytest.mark.parametrize("percent,most", [(25, 2), (60, 3), (0, 1), (100, 2)])
def test_documents_against_plain_version(spark, sf, percent, most):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    target = spark.read.parquet(f"{sf}/benchmark.parquet")
    found = importance.resampled(docs, target, percent=percent, max_words=most).collect()
    true = plain_draw([tuple(r) for r in docs.collect()], [r["text"] for r in target.collect()], percent, most=most)
    assert sorted(map(tuple, found), key=repr) == true


def test_ties_by_id_and_repeated_rows(spark):
    """Rows of one id share noise: with equal texts they tie and fill neighbouring ranks."""
    text = " ".join(f"w{i}" for i in range(30))
    rows = [(i, text) for i in range(40)] + [(7, text)] * 25 + [(None, text)] * 3
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    target = spark.createDataFrame([("w1 w2 other",), (None,)], "text string")
    found = sorted(map(tuple, importance.resampled(docs, target, percent=50).collect()), key=repr)
    true = plain_draw(rows, ["w1 w2 other", None], 50)
    assert found == true
    drawn = sorted(r[5] for r in found if r[5])
    assert drawn == list(range(1, len(rows) // 2 + 1))


def test_odd_documents(odd_documents, spark):
    docs, empty, _ = odd_documents
    target = spark.createDataFrame([("the quick brown fox",)], "text string")
    rows = importance.resampled(docs, target).collect()
    assert same_ids(rows) == ALL_IDS
    assert {(r["n_features"], r["weight"]) for r in rows if r["doc_id"] in (2, 3, 6)} == {(0, 0)}
    assert importance.resampled(empty, target).count() == 0
    without = importance.resampled(docs, target.limit(0))  # smoothing alone
    assert same_ids(without.collect()) == ALL_IDS and without.filter(F.col("rank").isNotNull()).count() == 6 * 25 // 100
