"""PartEnum join against plain sets and all pairs."""

import random
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tabsift.llm import partenum

from .conftest import ALL_IDS, same_ids
from .test_simhash import components


def plain_set(text, k=4):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in "".join(" " if c in "\t\n\v\f\r" else c for c in lowered).split(" ") if w]
    return {" ".join(words[i:i + k]) for i in range(len(words) - k + 1)} or ({" ".join(words)} if words else set())


def plain_join(rows, percent=85, k=4):
    """(doc_id, n_shingles, component_id) of every row, by all pairs of rows."""
    sets = [plain_set(t, k) for _, t in rows]
    links = [(i, j) for i, j in combinations(range(len(rows)), 2) if sets[i] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])]
    group = components(range(len(rows)), links)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            least[group[i]] = min(least.get(group[i], doc_id), doc_id)
    return sorted(((d, len(sets[i]), least.get(group[i])) for i, (d, _) in enumerate(rows)), key=repr)


def found_join(docs, **how):
    return sorted(map(tuple, partenum.joined_sets(docs, **how).collect()), key=repr)


def test_sets_of_texts():
    texts = ["", None, "one", "One two\tTHREE", "a b c d", "A b c d e f a b c d", "ÀB é x ß\x1f y z w", " lead  trail ", "x " * 50, "\x0b\x0c"]
    for k in (1, 2, 4):
        for t, s in zip(texts, partenum.shingle_sets(pa.array(texts), k), strict=True):
            assert len(s) == len(plain_set(t, k)) and (np.diff(s.astype(object)) > 0).all(), (t, k)
    pair = partenum.shingle_sets(pa.array(["p q r s t u", "p q r s t v", "q p r s t u"]))
    assert len(np.intersect1d(pair[0], pair[1])) == 2 and len(np.intersect1d(pair[0], pair[2])) == 1
    assert partenum.shingle_sets(pa.array([], pa.string())) == []


@pytest.mark.parametrize("k", range(200))
def test_scheme_leaves_enough_partitions(k):
    how = partenum.scheme(k)
    worst = k // (how.k2 + 1)  # partitions that k differences can spoil
    assert how.n1 - worst >= how.spare + 1 and how.n2 > how.k2


@pytest.mark.parametrize("percent", [85, 70, 90])
def test_bands_hold_every_pair_of_sizes(percent):
    first, last = partenum._bands(percent, 2000)
    for a in range(1, 900):
        for b in range(a, a * 100 // percent + 1):
            i, j = np.searchsorted(last, a), np.searchsorted(last, b)
            assert j - i in (0, 1) and first[i] <= a <= last[i]


@pytest.mark.parametrize("percent", [85, 70])
def test_linked_sets_share_a_signature(percent):
    """Random pairs at and inside the threshold, at sizes of every scheme, meet in a bucket with one set of the upper band."""
    r = np.random.default_rng(5)
    checked = 0
    for size in [*range(5, 60), 64, 80, 99, 100, 117, 150, 230, 400, 1000, 3000]:
        for _ in range(6):
            other = int(r.integers(size * percent // 100, size + 1))
            room = int(partenum.allowed(size, other, percent))
            if room < size - other:
                continue
            cut = (room - (size - other)) // 2  # elements of the smaller set outside the larger
            if other <= cut or not (cut or size > other):
                continue
            pool = np.unique(r.integers(0, 1 << 63, size + cut + 8).astype(np.uint64))[:size + cut]
            a, b = np.sort(pool[:size]), np.sort(np.r_[pool[:other - cut], pool[size:]])
            assert 100 * len(np.intersect1d(a, b)) >= percent * len(np.union1d(a, b))
            sig, who = partenum.signatures([a, b], percent)
            shared = np.intersect1d(sig[who == 0] >> np.uint64(1), sig[who == 1] >> np.uint64(1))
            upper = np.union1d(sig[sig & np.uint64(1) == 0] >> np.uint64(1), [])
            assert len(np.intersect1d(shared, upper)), (size, other)
            checked += 1
    assert checked > 150


def test_sketches_bound_the_difference():
    r = np.random.default_rng(2)
    for n, m in [(6, 7), (40, 44), (300, 330), (2000, 2200)]:
        pool = np.unique(r.integers(0, 1 << 63, 2 * m).astype(np.uint64))
        for shift in (0, 1, n // 10, n // 2):
            a, b = np.sort(pool[:n]), np.sort(pool[shift:shift + m])
            rows = partenum.folded([partenum.sketch_of(a), partenum.sketch_of(b)])
            assert np.bitwise_count(rows[0] ^ rows[1]).sum() <= len(np.setxor1d(a, b))
    wide = partenum.sketch_of(pool[:2000])
    assert (partenum.folded([wide, np.zeros(1, np.uint64)])[0] == np.bitwise_xor.reduce(wide)).all()


def edited(seed, bases, copies, words, most):
    """Texts of invented words, each with copies that have up to ``most`` words changed, dropped or added."""
    r, rows = random.Random(seed), []
    for b in range(bases):
        base = [f"v{r.randrange(400)}" for _ in range(r.choice(words))]
        for _ in range(copies):
            text = list(base)
            for _ in range(r.randrange(most + 1)):
                at = r.randrange(len(text))
                text[at:at + r.randrange(2)] = [f"w{r.randrange(9)}"] * r.randrange(2)
                text = text or ["z"]
            rows.append((len(rows), " ".join(text)))
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed,words,most,chunk", [(1, [1, 2, 3, 5, 8, 9, 10, 12], 1, 4096), (2, [15, 20, 30, 45, 60], 2, 4096),
                                                   (3, [25, 40, 70], 2, 3), (4, [120, 300], 6, 4)])
def test_edited_copies_against_all_pairs(spark, seed, words, most, chunk):
    """With a small chunk every bucket is looked through in pairs of chunks."""
    rows = edited(seed, 12, 25, words, most)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert found_join(docs, chunk=chunk) == plain_join(rows)


def test_passage_in_many_documents(spark):
    """Documents that share one long passage, at similarities on both sides of the threshold."""
    r = random.Random(9)
    passage = [f"p{i}" for i in range(100)]
    rows = [(i, " ".join(passage + [f"u{r.randrange(10**6)}" for _ in range(r.choice([0, 3, 8, 9, 12, 30]))])) for i in range(150)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert found_join(docs, hot_share=3) == plain_join(rows)


def test_other_parameters(spark):
    rows = edited(6, 8, 20, [12, 30, 50], 4)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert found_join(docs, shingle=2, percent=60) == plain_join(rows, 60, 2)


def test_documents_against_all_pairs(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    true = plain_join([tuple(r) for r in docs.collect()])
    assert found_join(docs) == true and sum(d != c for d, _, c in true) > 3


def test_rows_without_ids_link_others(spark):
    base = [f"w{i}" for i in range(60)]
    far = ["x0", "x1", *base[2:-2], "y0", "y1"]  # too far from base, near to the one between
    rows = [(None, " ".join(["x0", "x1", *base[2:]])), (None, " ".join(["x0", "x1", *base[2:]])), (4, " ".join(base)), (9, " ".join(far)),
            (None, "alone here with some words"), (None, ""), (3, "  "), (3, "\n"), (5, "a b"), (5, "c d"), (5, "A  B"), (6, "a b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    true = plain_join(rows)
    assert (9, 57, 4) in true and (None, 57, 4) in true and (None, 2, None) in true
    assert found_join(docs) == true


def test_odd_documents(odd_documents):
    docs, empty, rows = odd_documents
    found = partenum.joined_sets(docs)
    assert found.columns == ["doc_id", "n_shingles", "component_id"]
    assert same_ids(found.collect()) == ALL_IDS
    assert sorted(map(tuple, found.collect()), key=repr) == plain_join([(r[0], r[1]) for r in rows])
    assert partenum.joined_sets(empty).count() == 0
    assert found_join(docs.select(F.col("doc_id").alias("id"), F.col("text").alias("sig")), doc_id="id", text="sig") == sorted(map(tuple, found.collect()), key=repr)
