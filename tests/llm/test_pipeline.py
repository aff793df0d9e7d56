"""The corpus pipeline against plain versions of its stages, and on odd tables."""

import os
from itertools import combinations

import corpus_pipeline
from pyspark.sql import functions as F

from tabsift.llm import decontaminate, packing, pii, quality
from tabsift.llm.common import written
from tabsift.llm.tokens import WordIds, vocabulary_path

from .test_decontaminate import plain_score
from .test_simhash import components, plain_fingerprint

SF = "/root/testdata/sf0.001"


def staged(spark, docs, sf_dir):
    """The rows of each stage."""
    out = []
    for name, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, sf_dir), "stage")
        out.append(docs)
    return out


def test_stage_by_stage(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    one, two, three, four, five = staged(spark, docs, SF)
    assert all(x.columns == docs.columns for x in (one, two, three, four))
    ids = lambda d: sorted(r["doc_id"] for r in d.select("doc_id").collect())
    assert ids(one) == sorted(r["doc_id"] for r in quality.verdicts(docs).filter("kept").collect())
    texts = dict(one.select("doc_id", "text").collect())
    fps = {k: plain_fingerprint(t) for k, t in texts.items()}
    groups = components(sorted(fps), [(a, b) for a, b in combinations(sorted(fps), 2) if (fps[a] ^ fps[b]).bit_count() <= 4])
    assert ids(two) == sorted(set(groups.values()))
    known = {}
    number = lambda t: [known.setdefault(w, len(known)) for w in decontaminate.words_of(t)]
    items = [number(r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    marks = {i: set(zip(x, x[1:], x[2:])) for i, x in enumerate(items)}
    leaked = set()
    for k in ids(two):
        words = number(texts[k])
        grams = set(zip(words, words[1:], words[2:]))
        leaked |= {k for i, x in enumerate(items) if len(x) >= 8 and grams & marks[i] and plain_score(x, words) >= min(0.5 * len(x), 30)}
    assert ids(three) == sorted(set(ids(two)) - leaked)
    for r in four.collect():
        assert r["text"] == pii.masked(texts[r["doc_id"]], pii.all_spans([texts[r["doc_id"]]])[0][1])
        assert r["n_chars"] == len(r["text"]) or r["text"] == texts[r["doc_id"]]
    memo, clean = WordIds(vocabulary_path()), dict(four.select("doc_id", "text").collect())
    assert {r["doc_id"]: r["n"] for r in five.groupBy("doc_id").agg(F.sum("length").alias("n")).collect()} == {k: len(memo.text(t)) // 4 for k, t in clean.items()}
    assert {r["length"] for r in five.select("length").distinct().collect()} <= {1 << b for b in range(13)} and packing.MAX_TOKENS == 4096


def test_run_equals_the_stages(spark):
    run = corpus_pipeline.run(spark, SF)
    last = staged(spark, spark.read.parquet(f"{SF}/documents.parquet"), SF)[-1]
    key = lambda d: sorted(map(tuple, d.select("doc_id", "start", "length", "ids_crc32").collect()))
    assert key(run) == key(last)


def test_odd_documents(spark, odd_documents, tmp_path):
    docs, empty, _ = odd_documents
    os.symlink(f"{SF}/benchmark.parquet", tmp_path / "benchmark.parquet")
    stages = staged(spark, docs, str(tmp_path))
    assert all(s.columns == docs.columns for s in stages[:-1])
    assert {r["doc_id"] for r in stages[0].collect()} >= {1, 5, 8} and not {2, 3, 6, 7} & {r["doc_id"] for r in stages[0].collect()}
    assert all(s.count() == 0 for s in staged(spark, empty, str(tmp_path)))
