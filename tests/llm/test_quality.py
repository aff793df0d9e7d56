"""Quality rules against plain counting."""

import re
from collections import Counter

import numpy as np
import pytest

from tabsift.llm import quality

from .conftest import ALL_IDS, same_ids


def plain_counts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    seen, dup = set(), 0
    for line in lines:
        dup += line in seen
        seen.add(line)
    windows = Counter(tuple(words[i:i + 8]) for i in range(len(words) - 7))
    covered = {j for i in range(len(words) - 7) if windows[tuple(words[i:i + 8])] > 1 for j in range(i, i + 8)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered)


@pytest.mark.parametrize("text", [None, "", "  ", "a", "a b c d e f g h a b c d e f g h", "x " * 50, "l one\nl one\n\nl one \n l one\n", "é ü&#| <b> \x1f z\x0bq",
                                  "a b a b a b a b a b c", "p q r s t u v w x y z p q r s t u v w"])
def test_counts(text):
    assert quality.counts_of(text)[:5] == plain_counts(text)


def test_counts_of_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = dict(docs.select("doc_id", "text").collect())
    for r in quality.verdicts(docs).collect():
        n, chars, symbols, dup, repeat = plain_counts(texts[r["doc_id"]])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (n, chars, symbols, dup, repeat)
        assert r["base_failed"] == (n < 20 or 100 * repeat > 30 * n)
        assert not (r["base_failed"] and r["kept"])


def test_labels_agree(spark):
    """Good documents of the labelled table stay, most bad ones go."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = dict(spark.read.parquet("/root/testdata/sf0.01/labels.parquet").select("doc_id", "quality").collect())
    rows = [(labels[r["doc_id"]], r["kept"], r["base_failed"]) for r in quality.verdicts(docs).collect() if r["doc_id"] in labels]
    good = [kept for q, kept, failed in rows if q == 1 and not failed]
    bad = [kept for q, kept, _ in rows if q == 0]
    assert sum(good) >= 0.98 * len(good) and sum(bad) <= 0.25 * len(bad)


def test_groups_use_their_own_fences(spark, monkeypatch):
    """A group of long words is not judged by another group's; a small group falls back on its language."""
    monkeypatch.setattr(quality, "MIN_GROUP", 30)
    short = [(i, " ".join(["word", "good", "text"] * 10), "en", "a") for i in range(40)]
    long = [(100 + i, " ".join(["extraordinarily", "longwindedness"] * 12), "xx", "b") for i in range(40)]
    odd = [(200, " ".join(["extraordinarily", "longwindedness"] * 12), "en", "new")]
    docs = spark.createDataFrame(short + long + odd, "doc_id long, text string, lang string, source string")
    monkeypatch.setattr(quality, "MAX_REPEAT_PERCENT", 100)
    kept = {r["doc_id"]: r["kept"] for r in quality.verdicts(docs).collect()}
    assert all(kept[i] for i in range(40)) and all(kept[100 + i] for i in range(40)) and not kept[200]


def test_fences_come_from_the_group(spark, monkeypatch):
    """A share of symbols that stands out in one group is usual in another; an even tail loses nothing."""
    monkeypatch.setattr(quality, "MIN_GROUP", 50)
    words = lambda i, marks: " ".join(f"{'#' if j < marks else 'x'}{(i * 7 + j * j) % 1000:03d}" for j in range(100))
    clean = [(i, words(i, 0), "en", "a") for i in range(195)] + [(1000 + i, words(i, 6), "en", "a") for i in range(5)]
    marked = [(2000 + i, words(i, 6), "en", "b") for i in range(200)]
    even = [(3000 + i, words(i, i // 10), "en", "c") for i in range(200)]
    docs = spark.createDataFrame(clean + marked + even, "doc_id long, text string, lang string, source string")
    lost = {r["doc_id"] for r in quality.verdicts(docs).collect() if not r["kept"]}
    assert lost == set(range(1000, 1005))


def test_odd_documents(odd_documents):
    docs, empty, _ = odd_documents
    rows = quality.verdicts(docs).collect()
    assert same_ids(rows) == ALL_IDS
    assert all(r["base_failed"] and r["n_words"] == 0 for r in rows if r["doc_id"] in (2, 3, 6))
    kept = quality.kept_documents(docs)
    assert kept.columns == docs.columns and same_ids(kept.collect()) == sorted((r["doc_id"] for r in rows if r["kept"]), key=lambda v: (v is not None, v or 0))
    assert quality.verdicts(empty).count() == 0 and quality.kept_documents(empty).count() == 0


TAILS = {
    "normal": lambda r, n: r.normal(10, 1, n), "exponential": lambda r, n: r.exponential(1, n), "log-normal": lambda r, n: r.lognormal(0, 1, n),
    "narrow log-normal": lambda r, n: r.lognormal(0, 0.5, n), "pareto": lambda r, n: r.pareto(2, n),
}


@pytest.mark.parametrize("name", sorted(TAILS))
def test_smooth_tails_have_fences(name):
    """Without any gap a tail is fenced by its own decline: next to nothing of it is lost, what lies far beyond is."""
    x = TAILS[name](np.random.default_rng(4), 100_000)
    fence = quality.fence_of(np.quantile(x, quality.TAIL), float(np.median(x)), len(x))
    lost = (x > fence).mean()
    assert np.isfinite(fence) and lost <= 1e-3 and fence < np.median(x) + 12 * (np.quantile(x, 0.99) - np.median(x))
    scaled = quality.fence_of(np.quantile(7 * x, quality.TAIL), float(np.median(7 * x)), len(x))
    assert scaled == pytest.approx(7 * fence, rel=1e-6)


def test_gap_comes_before_the_decline():
    r = np.random.default_rng(1)
    x = np.r_[r.normal(0.05, 0.01, 95_000), r.uniform(0.4, 0.6, 5_000)]
    fence = quality.fence_of(np.quantile(x, quality.TAIL), float(np.median(x)), len(x))
    assert 0.08 < fence < 0.4
    flat = quality.fence_of(np.full(len(quality.TAIL), 0.3), 0.3, 50)
    assert flat == pytest.approx(0.3 + quality.LEAST_GAP)


def test_groups_with_smooth_tails(spark, monkeypatch):
    """Each group's own spread decides: the same share of symbols is usual in a wide group and goes in a narrow one."""
    monkeypatch.setattr(quality, "MIN_GROUP", 100)
    r = np.random.default_rng(3)
    text = lambda marks: " ".join(f"{'#' if j < marks else 'x'}{(j * j * 7 + int(r.integers(900))) % 1000:03d}" for j in range(200))
    wide = [(i, text(int(min(r.exponential(25), 150))), "en", "wide") for i in range(400)]
    narrow = [(1000 + i, text(int(r.poisson(3))), "en", "narrow") for i in range(400)] + [(5000, text(120), "en", "narrow"), (5001, text(120), "en", "wide")]
    docs = spark.createDataFrame(wide + narrow, "doc_id long, text string, lang string, source string")
    lost = {r["doc_id"] for r in quality.verdicts(docs).collect() if not r["kept"]}
    assert 5000 in lost and 5001 not in lost and len(lost) <= 8


def test_few_documents_are_judged_too(spark):
    """A handful of documents has fences of its own; one among equals that is far off goes, small differences stay."""
    usual = [(i, " ".join(f"word{(i * 31 + j * j) % 997}" for j in range(60)), "en", "a") for i in range(12)]
    odd = [(99, " ".join(f"&&&&&&&&&&&&&&&&&&{j}" for j in range(60)), "en", "a")]
    docs = spark.createDataFrame(usual + odd, "doc_id long, text string, lang string, source string")
    fences = quality.fences(quality.measured(docs, ["lang", "source"]))
    assert all(v is not None for v in fences.first().asDict().values())
    kept = {r["doc_id"] for r in quality.verdicts(docs).collect() if r["kept"]}
    assert kept >= set(range(12))
