"""Personal data: exact patterns by plain rules, decoding against a full Viterbi, sentences the model has not seen."""

import hashlib
import random
import re
import time

import numpy as np
import pytest

from tabsift.llm import pii
from tabsift.llm.pii_table import labelled_table

from .conftest import ALL_IDS, same_ids


def plain_base(text):
    out = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append(("email", *m.span()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(x) <= 255 for x in m.group().split(".")):
            out.append(("ip", *m.span()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = [int(c) for c in m.group() if c.isdigit()][::-1]
        if 13 <= len(d) <= 19 and (sum(d[::2]) + sum(sum(divmod(2 * x, 10)) for x in d[1::2])) % 10 == 0:
            out.append(("card", *m.span()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= len(re.sub(r"[^0-9]", "", m.group())) <= 15:
            out.append(("phone", *m.span()))
    return out


TEXTS = ["a.b@c.de, x@y", "1.2.3.4 256.1.1.1 1.2.3.4.5 001.2.3.0004", "4111 1111 1111 1111 and 4111-1111-1111-1112", "+1 (784) 555-8120.", "+12 3", "é +49 30 1234567 ü a@b.c",
         "4539578763621486", "x" * 50 + "@" + "y.z", "0000000000000", "1" * 4000 + ".1.1.1"]


@pytest.mark.parametrize("text", TEXTS)
def test_base(text):
    assert pii.base_spans(text) == plain_base(text)


def full_viterbi(words, model):
    if not len(words.starts):
        return np.zeros(0, dtype=np.int64)
    known, back = np.unique(words.shapes, return_inverse=True)
    tables = [pii.shape_features(known) @ model.weights[o] for o in range(3)]
    emit = tables[0][back]
    emit[1:] += tables[1][back[:-1]]
    emit[:-1] += tables[2][back[1:]]
    score, steps = emit[0] + model.first, []
    for e in emit[1:]:
        moved = score[:, None] + model.transitions
        steps.append(moved.argmax(axis=0))
        score = moved.max(axis=0) + e
    path = [int((score + model.last).argmax())]
    for s in reversed(steps):
        path.append(int(s[path[-1]]))
    return np.array(path[::-1])


def test_decoding_is_exact(spark):
    model = pii.trained()
    texts = [r["text"] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").limit(150).collect()]
    texts += [s for s, _ in labelled_table(99)[:150]] + ["", " ".join(["+1 (784) 555-8120 4.4.4.4 a@b.c"] * 40)]
    words = [pii.shaped_words(t) for t in texts]
    for w, found in zip(words, pii.decode(words, model), strict=True):
        assert full_viterbi(w, model).tolist() == found.tolist()


def test_unseen_sentences():
    rows = labelled_table(12345)
    right = sum(np.array_equal(pii.decode([w := pii.shaped_words(t)], pii.trained())[0], pii._labels(w, spans)) for t, spans in rows)
    assert right >= 0.97 * len(rows)


def test_added_spans_and_masking():
    text = 'Use password=9c82e4685ca7e26784 or token = "69760a67bd64a3a7e9ecd68ae8373485c8942606", then mail a.b@c.de.'
    base, every = pii.all_spans([text])[0]
    assert [k for k, *_ in base] == ["email"] and [k for k, *_ in every] == ["email", "secret", "secret"]
    clean = pii.masked(text, every)
    assert "9c82e" not in clean and "69760a" not in clean and "[EMAIL]" in clean
    assert pii.masked("abcdef", [("ip", 1, 3), ("card", 2, 5)]) == "a[IP]f"


def test_plain_text_is_left_alone():
    text = "In 2019 the version 3.2 of it sold 1,250 times (see page 17). ALL!! GOOD!! the&&& | of%%% | and so on."
    assert pii.all_spans([text]) == [([], [])]


def test_reports(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = dict(docs.select("doc_id", "text").collect())
    for r in pii.reports(docs).collect():
        base = plain_base(texts[r["doc_id"]] or "")
        assert r["base_sha256"] == hashlib.sha256(pii.digest(base).encode()).hexdigest()
        assert all(r[f"n_{k}"] == sum(s[0] == k for s in base) for k in pii.BASE_KINDS)
        assert set(pii.digest(base).split(",")) <= set(r["spans"].split(",")) | {""}


def test_odd_documents(odd_documents):
    docs, empty, rows = odd_documents
    assert same_ids(pii.reports(docs).collect()) == ALL_IDS and same_ids(pii.spans(docs).collect()) == ALL_IDS
    out = pii.redacted(docs)
    assert out.columns == docs.columns and same_ids(out.collect()) == ALL_IDS
    assert {r["doc_id"]: r["text"] for r in out.collect()}[3] is None
    assert pii.reports(empty).count() == 0 and pii.redacted(empty).count() == 0


OLD_EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
OLD_IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")


def test_base_patterns_as_written():
    """Addresses found from their @ and from chains of numbers are those of the patterns, read as they stand."""
    r = random.Random(3)
    for _ in range(5000):
        text = "".join(r.choice("ab1@.. -%9") for _ in range(r.randrange(1, 40)))
        assert [m.span() for m in OLD_EMAIL.finditer(text)] == list(pii.emails(text)), text
        text = "".join(r.choice("12503.... x") for _ in range(r.randrange(1, 50)))
        assert [m.span() for m in OLD_IP.finditer(text) if all(int(p) <= 255 for p in m.group().split("."))] == list(pii.addresses(text)), text


@pytest.mark.parametrize("run", ["a", "1", "1.", "a@", "@", "a@b.", "+1", "1-", "a.b@c", "0", "+1(", "é", "a" * 50 + " "])
def test_long_runs_take_linear_time(run):
    """A megabyte of one run, then an address: found in well under the time of a rescan."""
    text = run * (1_000_000 // len(run)) + " x@y.zz"
    started = time.perf_counter()
    spans = pii.base_spans(text)
    assert time.perf_counter() - started < 5
    assert ("email", len(text) - 6, len(text)) in spans or run in ("a@", "a@b.", "a.b@c", "@")
    assert pii.base_spans("0" * 6000 + "1.2.3.4") == [("ip", 0, 6007)]
