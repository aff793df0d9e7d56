"""Language-model scores against a plain bigram model in Python, and Elias-Fano against arrays."""

import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabsift.llm import lm
from tabsift.llm.common import crc_mod
from tabsift.llm.elias_fano import EliasFano, Trie, quantise, restored

from .conftest import ALL_IDS, same_ids


@pytest.mark.parametrize("n,last", [(0, 10), (1, 1), (5, 5), (1000, 1 << 20), (3000, (1 << 64) - 1), (400, 499), (2000, 1 << 40)])
def test_elias_fano(n, last):
    r = np.random.default_rng(n)
    values = np.unique(r.integers(0, last, n, dtype=np.uint64, endpoint=True))
    coded = EliasFano.build(values, last)
    asked = np.concatenate([values, r.integers(0, last, 300, dtype=np.uint64, endpoint=True)])
    if len(values):
        assert (coded.access(np.arange(len(values))) == values).all()
        assert (coded.successor(asked) == np.searchsorted(values, asked)).all()
    assert coded.find(asked).tolist() == [int(np.searchsorted(values, x)) if x in set(values.tolist()) else -1 for x in asked.tolist()] if n < 500 else True


def test_repeated_values():
    values = np.sort(np.random.default_rng(1).integers(0, 50, 400)).astype(np.uint64)
    coded = EliasFano.build(values, 60)
    assert (coded.access(np.arange(400)) == values).all()
    assert (coded.successor(np.arange(60, dtype=np.uint64)) == np.searchsorted(values, np.arange(60, dtype=np.uint64))).all()


def test_quantised_counts():
    n = np.arange(0, 200_000)
    back = restored(quantise(n))
    assert (back[:33] == n[:33]).all() and (np.abs(back[33:] / n[33:] - 1) < 0.05).all()


def test_trie_in_a_mapped_file(tmp_path):
    words = np.array([3, 7, 1 << 60, (1 << 64) - 1], dtype=np.uint64)
    context, successor = np.array([0, 0, 2, 3]), np.array([5, (1 << 32) - 1, 0, 9], dtype=np.uint32)
    Trie.build(words, np.array([4, 0, 2, 1]), context, successor, np.array([1, 3, 2, 100])).to_file(str(tmp_path / "t"))
    trie = Trie.mapped(str(tmp_path / "t"))
    rank = trie.words.find(np.array([3, 4, 7, (1 << 64) - 1], dtype=np.uint64))
    assert rank.tolist() == [0, -1, 1, 3] and trie.counts(rank).tolist() == [4, 0, 0, 1]
    pairs = np.array([0, 0, 0, 1, 2, 3, -1]), np.array([5, 6, (1 << 32) - 1, 5, 0, 9, 9], dtype=np.uint32)
    assert restored(trie.joint(*pairs)).round().tolist() == [1, 0, 3, 0, 2, round(float(restored(quantise(np.array([100])))[0])), 0]


def plain_model(rows):
    """{position: (n_tokens, n_known, N, base, score)} for rows of (text, train)."""
    tokens = [[*(t or "").encode().lower().split(), b"\n"] for t, _ in rows]
    one, two = Counter(), Counter()
    for words, (_, train) in zip(tokens, rows):
        if train:
            one.update(words)
            two.update(zip([b"\n", *words], words))
    total, distinct = sum(one.values()), len(one)
    p = lambda c: (one[c] + 0.5) / (total + 0.5 * (distinct + 1))
    out = []
    for words in tokens:
        score = 0.0
        for b, c in zip([b"\n", *words], words):
            m = lm.MU * (one[b] + 1) ** lm.GROWTH
            score += math.log10((float(restored(quantise(np.array([two[b, c]])))[0]) + m * p(c)) / (one[b] + m))
        out.append((len(words), sum(one[w] > 0 for w in words), total, sum(math.log10(p(w)) for w in words), score))
    return out


@pytest.mark.parametrize("batch_bytes,shard_bytes,hot_share", [(16 << 20, 12 << 20, 0.002), (20_000, 40_000, 0.02), (50_000, 60_000, 1e-9)])
def test_against_plain_model(spark, monkeypatch, batch_bytes, shard_bytes, hot_share):
    monkeypatch.setattr(lm, "HOT_SHARE", hot_share)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").withColumn("train", crc_mod(F.col("doc_id"), 5) != 1).repartition(3)
    rows = docs.select("doc_id", "text", "train").collect()
    expected = dict(zip([r["doc_id"] for r in rows], plain_model([(r["text"], r["train"]) for r in rows])))
    found = lm.scores(docs, "train", batch_bytes=batch_bytes, shard_bytes=shard_bytes).collect()
    assert len(found) == len(rows)
    for r in found:
        n, known, total, base, score = expected[r["doc_id"]]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (n, known, total)
        assert r["base_score"] == pytest.approx(base, rel=1e-9) and r["score"] == pytest.approx(score, rel=1e-7)


def test_probabilities_add_up():
    """Over the whole vocabulary and the unknown word, the conditional probabilities of a context sum to one."""
    one = Counter({b"a": 5, b"b": 3, b"\n": 2})
    two = Counter({b"a": 3, b"b": 2})  # successors of a
    total, distinct = sum(one.values()), len(one)
    m = lm.MU * (one[b"a"] + 1) ** lm.GROWTH
    p = {c: (n + 0.5) / (total + 0.5 * (distinct + 1)) for c, n in one.items()} | {None: 0.5 / (total + 0.5 * (distinct + 1))}
    assert sum((two[c] + m * q) / (one[b"a"] + m) for c, q in p.items()) == pytest.approx(1)


def test_held_out_text_is_likelier_than_under_the_base(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").withColumn("train", crc_mod(F.col("doc_id"), 5) != 1)
    rows = lm.scores(docs, "train").join(docs.select("doc_id", "train"), "doc_id").filter("not train").agg(F.sum("score"), F.sum("base_score")).first()
    assert rows[0] > rows[1]


def test_odd_documents(odd_documents, tmp_path):
    docs, empty, rows = odd_documents
    docs = docs.withColumn("learn", F.when(F.col("doc_id") < 6, True))
    found = lm.scores(docs, "learn", model_folder=f"file://{tmp_path}").collect()
    assert same_ids(found) == ALL_IDS and list(tmp_path.glob("shard-*.trie"))
    expected = plain_model([(r[1], r[0] is not None and r[0] < 6) for r in rows])
    assert sorted((r["n_tokens"], r["n_known"], round(r["score"], 6)) for r in found) == sorted((e[0], e[1], round(e[4], 6)) for e in expected)
    none = lm.scores(docs.withColumn("learn", F.lit(False)), "learn").collect()
    assert {(r["n_known"], r["train_tokens"]) for r in none} == {(0, 0)}
    assert lm.scores(empty.withColumn("learn", F.lit(True)), "learn").count() == 0
