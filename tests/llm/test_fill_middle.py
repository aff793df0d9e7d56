"""Fill-in-middle against slices of Python strings, and its wavelet matrix against counting."""

import hashlib
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tabsift.llm import fill_middle
from tabsift.llm.wavelet import WaveletMatrix

from .conftest import ALL_IDS, same_ids

TEXTS = ["", "a", " ", "\n", "one two", "  lead and\ttail  ", "a\nb\n\nc", "ends\n", "é", "naïve café — 東京タワー 🙂🙂 x", "x_1 = (a+b)*3;\r\n\r\nreturn", "word " * 70,
         "\n\n\n", "!?", "ab" * 200, "\x00\x7f ok", "é" * 130 + "\n" + "z"]


@pytest.mark.parametrize("size", [0, 1, 63, 64, 65, 1000])
def test_ranks_by_counting(size):
    symbols = np.random.default_rng(size).integers(0, 6, size).astype(np.uint8)
    matrix, at = WaveletMatrix(symbols, 3), np.arange(size + 1)
    for s in range(8):
        assert matrix.rank(s, at).tolist() == [int((symbols[:i] == s).sum()) for i in at], s
    if size:
        pair = matrix.count((1, 4), at)
        for wanted in (0, 1, int(pair[-1]) // 2, int(pair[-1])):
            found = matrix.bisect((1, 4), np.array([0]), np.array([size]), np.array([wanted]))[0]
            assert found == max(i for i in at if pair[i] <= wanted)


def pieces(text, unit):
    """The units of a text: joined they give the text (what has no unit of its own stays alone)."""
    if unit == "char":
        return list(text)
    if unit == "line":
        return re.findall(r"[^\n]*\n|[^\n]+", text)
    word = r"[0-9A-Za-z_\u0080-\U0010ffff]"
    first = rf"(?<!{word}){word}" if unit == "word" else rf"(?<!{word}){word}|\n|[^\x20\t\x0b\x0c\r0-9A-Za-z_\u0080-\U0010ffff]"
    starts = [m.start() for m in re.finditer(first, text)]
    if not starts:
        return []
    ends = [*starts[1:], len(text)]
    return [text[0:ends[0]], *(text[a:b] for a, b in zip(starts[1:], ends[1:], strict=True))]


@pytest.mark.parametrize("unit", sorted(fill_middle.UNITS))
def test_units_and_cuts(unit):
    raw = [t.encode() for t in TEXTS]
    bounds = np.cumsum([0, *map(len, raw)])
    cuts = fill_middle.Cuts(np.frombuffer(b"".join(raw), np.uint8), bounds, unit)
    plain = [pieces(t, unit) for t in TEXTS]
    assert cuts.units.tolist() == [len(p) for p in plain]
    for share in (0.0, 0.3, 0.5, 0.9, 1.0):
        units = (cuts.units * share).astype(np.int64)
        at = cuts.after(units)
        got = [raw[i][:at[i] - bounds[i]].decode() for i in range(len(raw))]
        assert got == ["".join(p[:n]) for p, n in zip(plain, units.tolist(), strict=True)]
        assert cuts.characters(at).tolist() == [len(g) for g in got]


def plain_version(doc_id, text):
    text, n = text or "", len(text or "")
    h = [int(hashlib.sha256(f"1:{'null' if doc_id is None else doc_id}".encode()).hexdigest()[i:i + 8], 16) for i in (0, 8, 16, 24)]
    if not text or any(s in text for s in fill_middle.SENTINELS) or h[2] % 100 >= 90:
        return doc_id, n, "plain", None, None, text, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = text[:a], text[a:b], text[b:]
    spm = h[3] % 100 < 20
    return doc_id, n, "spm" if spm else "psm", a, b - a, f"<S>{s}<P>{p}<M>{m}" if spm else f"<P>{p}<S>{s}<M>{m}", text


def outcome(docs):
    made = fill_middle.fill_in_middle(docs)
    return [tuple(r) for r in made.select("*", fill_middle.restored(F.col("form"), F.col("output"))).collect()]


def test_against_plain_version(spark):
    rows = [(i, TEXTS[i % len(TEXTS)] + ("<S>" if i % 50 == 49 else "") + ("<" if i % 7 == 3 else "")) for i in range(600)]
    rows += [(None, "no id here"), (None, None), (5, "again"), (5, "again"), (6, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(repr, outcome(docs))) == sorted(repr(plain_version(*r)) for r in rows)
    forms = {r[2] for r in outcome(docs)}
    assert forms == {"plain", "psm", "spm"}


def test_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    assert sorted(map(repr, outcome(docs))) == sorted(repr(plain_version(*r)) for r in docs.collect())


@pytest.mark.parametrize("unit", ["word", "token", "line"])
def test_other_units_restore(spark, sf, unit):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    made = fill_middle.fill_in_middle(docs, unit, transformed_percent=100, sentinels=("«p»", "«s»", "«m»"))
    back = made.select("doc_id", "form", fill_middle.restored(F.col("form"), F.col("output"), ("«p»", "«s»", "«m»")).alias("t"))
    texts = dict(docs.collect())
    rows = back.collect()
    assert all(r["t"] == (texts[r["doc_id"]] or "") for r in rows) and sum(r["form"] != "plain" for r in rows) > 0.9 * len(rows)
    with pytest.raises(ValueError):
        fill_middle.fill_in_middle(docs, "page")


def test_odd_documents(odd_documents):
    docs, empty, _ = odd_documents
    rows = fill_middle.fill_in_middle(docs).collect()
    assert same_ids(rows) == ALL_IDS and fill_middle.fill_in_middle(empty).count() == 0
    assert {(r["n"], r["form"], r["prefix_chars"], r["output"]) for r in rows if r["doc_id"] in (2, 3)} == {(0, "plain", None, "")}
    assert {tuple(r) for r in rows} == {plain_version(r["doc_id"], r["text"])[:6] for r in docs.collect()}


def test_sliced_batches():
    """A batch that is a slice of a longer one reads its own texts only."""
    texts = pa.array(TEXTS).slice(4, 6)
    assert [len(t) for t in texts.to_pylist()] == [len(t) for t in TEXTS[4:10]]
    column = texts.cast(pa.large_binary())
    bounds = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    assert (np.diff(bounds) == [len(t.encode()) for t in TEXTS[4:10]]).all()
