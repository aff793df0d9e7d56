"""Benchmark leaks: alignment against plain dynamic programming, and planted copies."""

import random

import numpy as np

from tabsift.llm import decontaminate as D


def plain_score(a, b):
    h = np.zeros((len(a) + 1, len(b) + 1), dtype=int)
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            h[i, j] = max(0, h[i - 1, j - 1] + (1 if a[i - 1] == b[j - 1] else -1), h[i - 1, j] - 1, h[i, j - 1] - 1)
    return h.max()


def test_alignment():
    random.seed(4)
    for _ in range(200):
        a = np.array([random.randrange(6) for _ in range(random.randrange(1, 14))])
        b = np.array([random.randrange(7) - 1 for _ in range(random.randrange(1, 30))])
        score, first, last = D.align(a, b)
        assert score == plain_score(a, b)
        assert not score or D.align(a, b[first:last])[0] == score


def corpus():
    r = random.Random(9)
    vocabulary = ["".join(r.choice("abcdefghijkl") for _ in range(r.randint(2, 7))) for _ in range(400)]
    draw = lambda n: " ".join(r.choice(vocabulary) for _ in range(n))
    items = [(i, draw(30)) for i in range(12)]
    docs = [(i, draw(r.randint(20, 200))) for i in range(60)]
    edited = lambda t, k: " ".join(w if i % k else "changed" for i, w in enumerate(t.split()))
    docs += [(100, draw(50) + " " + items[0][1] + " " + draw(50)), (101, draw(10) + ". " + items[1][1].upper().replace(" ", ", ") + "!"),
             (102, draw(30) + " " + edited(items[2][1], 6) + " " + draw(5)), (103, " ".join(items[3][1].split()[:10])),
             (104, draw(900) + " " + " ".join(w for i, w in enumerate(items[4][1].split()) if i % 7) + " " + draw(900))]
    docs += [(200 + i, items[5][1]) for i in range(30)]  # a passage that many documents share is found all the same
    return docs, items


def test_planted(spark):
    docs, items = corpus()
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    expected = {(100, 0), (101, 1), (102, 2), (104, 4)} | {(200 + i, 5) for i in range(30)}
    rows = D.leaks(d, b).collect()
    assert {(r["doc_id"], r["item_id"]) for r in rows} == expected
    texts = dict(docs)
    assert all(r["score"] == 1 and texts[r["doc_id"]][r["start"]:r["end"]].lower().replace(",", "") == dict(items)[r["item_id"]] for r in rows if r["doc_id"] in (100, 101))
    in_blocks = D.leaks(d, b, block_chars=600).collect()
    assert {(r["doc_id"], r["item_id"], r["points"]) for r in in_blocks} == {(r["doc_id"], r["item_id"], r["points"]) for r in rows}
    clean = D.clean_documents(d, b)
    assert {r["doc_id"] for r in clean.collect()} == {i for i, _ in docs} - {i for i, _ in expected}


def test_against_aligning_everything(spark):
    """Every pair that a full alignment finds well over the threshold is found through the seeds."""
    docs, items = corpus()
    known = {}
    number = lambda t: np.array([known.setdefault(w, len(known)) for w in D.words_of(t)])
    numbered = [(i, number(t)) for i, t in items]
    true = {(d, i) for d, t in docs for i, a in numbered if plain_score(a, number(t)) >= 0.5 * len(a)}
    rows = D.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r["doc_id"], r["item_id"]) for r in rows} == true


def test_edited_copies_beside_exact_ones(spark):
    """Edits break 3-grams or all of them; an exact copy in the corpus makes those that are left the commoner ones."""
    words = [f"w{i}" for i in range(16)]
    edited = " ".join("changed" if i % 5 == 4 else w for i, w in enumerate(words))
    spread = " ".join(w + " new" if i % 2 and i < 15 else w for i, w in enumerate(words))  # no three words in a row are left
    long = [f"v{i}" for i in range(200)]
    thin = " ".join("changed" if i % 3 == 2 else w for i, w in enumerate(long))
    docs = [(1, " ".join(words)), (2, "so " + edited + " it is"), (3, spread), (4, " ".join(long)), (5, thin), (6, " ".join(words[:7]) + " " + " ".join(long[:20]))]
    docs += [(100 + i, " ".join(words)) for i in range(20)]
    items = [(1, " ".join(words)), (2, " ".join(long))]
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    known = {}
    number = lambda t: [known.setdefault(w, len(known)) for w in D.words_of(t)]
    true = {(i, k, int(p)) for i, t in docs for k, a in items if (p := plain_score(number(a), number(t))) >= min(0.5 * len(a.split()), 30)}
    assert {(2, 1, 10), (3, 1, 9)} <= true and any(i == 5 for i, _, _ in true)
    assert {(r["doc_id"], r["item_id"], r["points"]) for r in D.leaks(d, b).collect()} == true


def test_short_and_unspaced_items(spark):
    """A short item leaks where it stands whole; characters are the words of a script without spaces."""
    items = [(1, "Who wrote Hamlet?"), (2, "two words"), (3, "中国的首都是哪一个城市呢请回答"), (4, "東京はどこ"), (5, "Hamlet"), (6, "ภาษาไทยเป็นภาษาราชการของประเทศ")]
    docs = [(1, "Quiz: who wrote HAMLET, and when?"), (2, "who really wrote hamlet"), (3, "two words"), (4, "wrote hamlet who"),
            (5, "问题：中国的首都是哪一座城市呢请回答。"), (6, "では、東京はどこですか"), (7, "東京はここ"), (8, "x ภาษาไทยเป็นภาษาราชการของประเทศไทย"), (9, "two wordsmith words")]
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    rows = {(r["doc_id"], r["item_id"]): r for r in D.leaks(d, b).collect()}
    assert set(rows) == {(1, 1), (3, 2), (5, 3), (6, 4), (8, 6)}
    texts = dict(docs)
    cut = {k: texts[k[0]][r["start"]:r["end"]] for k, r in rows.items()}
    assert cut[1, 1] == "who wrote HAMLET" and cut[5, 3] == "中国的首都是哪一座城市呢请回答" and cut[6, 4] == "東京はどこ"
    assert rows[1, 1]["points"] == 3 and rows[5, 3]["points"] == 13 and rows[6, 4]["score"] == 1
    assert {r["doc_id"] for r in D.clean_documents(d, b).collect()} == {2, 4, 7, 9}


def test_odd_documents(spark, odd_documents):
    docs, empty, rows = odd_documents
    items = spark.createDataFrame([(1, rows[0][1]), (2, None), (3, ""), (4, "one"), (5, rows[0][1])], "item_id long, text string")
    found = D.leaks(docs, items).collect()
    assert sorted(((r["doc_id"] or 0), r["item_id"]) for r in found) == sorted((i, k) for i in (0, 1, 5, 5, 8) for k in (1, 5))
    clean = D.clean_documents(docs, items)
    assert clean.columns == docs.columns and sorted(r["doc_id"] for r in clean.collect()) == [2, 3, 4, 6, 7]
    assert D.leaks(empty, items).count() == 0 and D.leaks(docs, items.limit(0)).count() == 0
    assert D.clean_documents(docs, items.limit(0)).count() == len(rows)
