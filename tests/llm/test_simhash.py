"""SimHash against a plain per-bit fingerprint and all-pairs components."""

from itertools import combinations

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tabsift.llm import simhash
from tabsift.llm.components import component_roots

from .conftest import ALL_IDS, same_ids


def plain_fingerprint(text, k=4):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in "".join(" " if c in "\t\n\v\f\r" else c for c in lowered).split(" ") if w]
    shingles = [" ".join(words[i:i + k]) for i in range(len(words) - k + 1)] or ([" ".join(words)] if words else [])
    out = 0
    for bit in range(64):
        if 2 * sum(xxhash.xxh64_intdigest(s, 42) >> bit & 1 for s in shingles) > len(shingles):
            out |= 1 << bit
    return out


def components(nodes, links):
    up = {n: n for n in nodes}

    def find(n):
        while up[n] != n:
            n = up[n]
        return n
    for a, b in links:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_fingerprint():
    for text in ("", None, "one", "One two\tTHREE", "a b c d", "a b c d e f g a b c d e", "ÀB é x ß\x1f y z w", "x " * 500):
        assert simhash.fingerprint(text) == plain_fingerprint(text), text


@pytest.mark.parametrize("bits", [0, 1, 3, 4, 6])
@pytest.mark.parametrize("segments", [1, 2, 3, 5, 9])
def test_plan_misses_nothing(bits, segments):
    plan = simhash.segment_plan(segments, bits)
    assert sum(w for _, w, _ in plan) == 64 and sum(r + 1 for *_, r in plan) == bits + 1


def near_fingerprints(seed=1):
    r = np.random.default_rng(seed)
    out = [int(x) for x in r.integers(0, 1 << 64, 40, dtype=np.uint64)]
    for base in list(out):
        for _ in range(6):
            out.append(base ^ sum(1 << int(b) for b in r.choice(64, r.integers(0, 7), replace=False)))
    return sorted(set(out))


@pytest.mark.parametrize("segments,max_bucket", [(3, 1 << 16), (2, 1 << 16), (5, 4)])
def test_links_connect_like_all_pairs(spark, segments, max_bucket):
    fps = near_fingerprints()
    signed = np.array(fps, dtype=np.uint64).view(np.int64).tolist()
    found = spark.createDataFrame([(x,) for x in signed], "fp long")
    links = [(r["a"], r["b"]) for r in simhash.linked_fingerprints(found, 4, segments, max_bucket).collect()]
    true = [(a, b) for a, b in combinations(signed, 2) if ((a ^ b) & (1 << 64) - 1).bit_count() <= 4]
    assert all(((a ^ b) & (1 << 64) - 1).bit_count() <= 4 for a, b in links)
    assert components(signed, links) == components(signed, true)


def test_large_bucket_grows_groups():
    base = 0x123456789ABCDEF0
    fps = np.array([base ^ (1 << a) ^ (1 << b) for a in range(64) for b in range(a)], dtype=np.uint64)
    links = simhash.bucket_links(fps, 4)
    assert len(links) == len(fps) - 1 and len({b for _, b in links}) == len(links)


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 180)] + [(7, 7), (300, 301)]
    roots = {r["node"]: r["root"] for r in component_roots(spark.createDataFrame(links, "a long, b long")).collect()}
    assert len(roots) == 61 + 80 + 2
    assert len({roots[i] for i in range(61)}) == 1 and len({roots[i] for i in range(100, 180)}) == 1 and len(set(roots.values())) == 3
    assert component_roots(spark.createDataFrame([], "a long, b long")).count() == 0


def test_documents_against_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = docs.select("doc_id", "text").collect()
    fps = {r["doc_id"]: plain_fingerprint(r["text"]) for r in rows}
    ids = sorted(fps)
    true = components(ids, [(a, b) for a, b in combinations(ids, 2) if (fps[a] ^ fps[b]).bit_count() <= 4])
    found = simhash.near_duplicates(docs).collect()
    assert {r["doc_id"]: r["component_id"] for r in found} == true
    assert {r["doc_id"]: r["fingerprint"] for r in found} == {k: f"{v:016x}" for k, v in fps.items()}
    kept = simhash.representatives(docs)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == sorted(set(true.values()))


def test_odd_documents(odd_documents):
    docs, empty, _ = odd_documents
    rows = simhash.near_duplicates(docs).collect()
    assert same_ids(rows) == ALL_IDS
    named = {(r["doc_id"], r["component_id"]) for r in rows}
    assert {(2, 2), (3, 2), (6, 2), (5, 1), (1, 1), (None, 1), (7, 7)} <= named
    assert {r["fingerprint"] for r in rows if r["doc_id"] in (2, 3, 6)} == {"0" * 16}
    kept = simhash.representatives(docs)
    assert kept.columns == docs.columns
    stay = same_ids(kept.collect())
    assert stay.count(None) == 1 and stay.count(5) == 0 and stay.count(1) == 1 and 2 in stay and 7 in stay
    assert simhash.representatives(docs.filter("doc_id = 5")).count() == 1  # a repeated document stays once
    assert simhash.near_duplicates(empty).count() == 0 and simhash.representatives(empty).count() == 0
    assert simhash.near_duplicates(docs.filter(F.col("doc_id").isNull())).collect()[0]["component_id"] is None


def test_repeated_ids_in_several_groups(spark):
    """Each row of a repeated id is judged by its own group: one row of each group stays."""
    a, z, q = "alpha beta gamma delta epsilon zeta", "nine ten eleven twelve thirteen fourteen", "red green blue black white brown"
    rows = [(1, a), (5, a), (5, z), (5, z), (7, q), (7, "one two three four five six"), (8, q), (None, a)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert len({simhash.fingerprint(t) for _, t in rows}) == 4
    kept = [tuple(r) for r in simhash.representatives(docs).collect()]
    assert sorted(kept, key=repr) == sorted([(1, a), (5, z), (7, q), (7, "one two three four five six"), (None, a)], key=repr)
