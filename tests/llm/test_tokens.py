"""Token ids, packing and token-id files against the tokenizers library itself."""

import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tabsift.llm import packing, token_ids
from tabsift.llm.tokens import END_ID, WordIds, vocabulary_path

from .conftest import ALL_IDS, same_ids

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def memo():
    return WordIds(vocabulary_path())


def direct(memo, text):
    return [*(memo.tokenizer.encode(text, add_special_tokens=False).ids if text else []), END_ID]


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.characters(codec="utf-8"), st.sampled_from("aZé ß.,!'|<>&\n\tJ̌İΣ1½")), max_size=60))
def test_memo_equals_library(text):
    held = test_memo_equals_library.memo = getattr(test_memo_equals_library, "memo", None) or WordIds(vocabulary_path())
    assert np.frombuffer(held.text(text), "<u4").tolist() == direct(held, text)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet=st.one_of(st.characters(codec="utf-8"), st.sampled_from("aZé .,'<|\n\t\x0b\x1c\x85  ̈")), max_size=30)), max_size=6))
def test_columns_equal_library(texts):
    held = test_columns_equal_library.memo = getattr(test_columns_equal_library, "memo", None) or WordIds(vocabulary_path())
    assert [x.tolist() for x in held.texts(pa.array(texts, pa.string()))] == [direct(held, t) for t in texts]
    assert [x.tolist() for x in held.texts(pa.array(["x", *texts], pa.string()).slice(1))] == [direct(held, t) for t in texts]


def test_memo_on_documents(memo, spark):
    for (text,) in spark.read.parquet(f"{SF}/documents.parquet").select("text").limit(80).collect():
        assert np.frombuffer(memo.text(text), "<u4").tolist() == memo.texts(pa.array([text]))[0].tolist() == direct(memo, text)


def test_memo_restarts(memo, monkeypatch):
    monkeypatch.setattr("tabsift.llm.tokens.MEMO_CHUNKS", 3)
    held = WordIds(vocabulary_path())
    text = "a few different words, more than the memo keeps: one two three " * 3
    assert np.frombuffer(held.text(text), "<u4").tolist() == direct(memo, text)


@pytest.mark.parametrize("n", [1, 2, 3, 4095, 4096, 4097, 12345])
def test_binary_lengths(n):
    lengths = packing.binary_lengths(n)
    assert sum(lengths) == n and all(x & (x - 1) == 0 and x <= 4096 for x in lengths) and lengths == sorted(lengths, reverse=True)


def test_binary_lengths_needs_a_power():
    with pytest.raises(ValueError):
        packing.binary_lengths(5, 1000)


def test_packing_round_trip(spark, odd_documents, memo):
    docs, empty, given_rows = odd_documents
    rows = packing.packed_sequences(docs, max_tokens=64).collect()
    assert len({r["sequence_id"] for r in rows}) == len(rows) and {r["offset"] for r in rows} == {0}
    back = {}
    for r in sorted(rows, key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, r["start"])):
        ids = packing.sequence_ids(r["ids"])
        assert len(ids) == r["length"] and r["ids_crc32"] == zlib.crc32(ids.astype("<u4").tobytes())
        back.setdefault((r["doc_id"], r["start"]), []).append(ids)
    for doc_id, text, *_ in given_rows:
        whole, at = direct(memo, text), 0
        while at < len(whole):
            ids = back[doc_id, at][0]
            assert whole[at:at + len(ids)] == ids.tolist()
            at += len(ids)
    assert packing.packed_sequences(empty).count() == 0


def test_codec_round_trip():
    r = np.random.default_rng(3)
    for n in (0, 1, 3, 4, 5, 1000):
        ranks = r.choice([0, 255, 256, 65535, 65536, (1 << 24) - 1, 1 << 24, (1 << 32) - 1], n).astype(np.uint32)
        control, data = token_ids.encode(ranks)
        assert len(control) == (n + 3) // 4 and token_ids.decode(control, data, n).tolist() == ranks.tolist()


def test_files_round_trip(spark, memo, monkeypatch):
    monkeypatch.setattr(token_ids, "BLOCK_TOKENS", 500)
    docs = spark.read.parquet(f"{SF}/documents.parquet").repartition(5)
    rows = sorted(token_ids.read_token_files(token_ids.write_token_files(docs)).collect(), key=lambda r: r["doc_id"])
    texts = dict(docs.select("doc_id", "text").collect())
    assert [r["doc_id"] for r in rows] == sorted(texts)
    start = 0
    for r in rows:
        ids = direct(memo, texts[r["doc_id"]])
        assert np.frombuffer(r["ids"], "<u4").tolist() == ids
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_files_of_odd_documents(odd_documents):
    docs, empty, _ = odd_documents
    rows = token_ids.read_token_files(token_ids.write_token_files(docs), keep_ids=False).collect()
    assert same_ids(rows) == ALL_IDS
    by_start = sorted(rows, key=lambda r: r["start"])
    assert same_ids(rows) == [r["doc_id"] for r in by_start]  # null first, then rising
    assert all(a["start"] + a["n_tokens"] == b["start"] for a, b in zip(by_start, by_start[1:]))
    assert token_ids.read_token_files(token_ids.write_token_files(empty)).count() == 0


def test_ranks_follow_counts(spark):
    docs = spark.createDataFrame([(i, "b b b a a c") for i in range(4)], "doc_id long, text string")
    ranked = token_ids.ranked_ids(token_ids.token_table(docs))
    memo = WordIds(vocabulary_path())
    assert ranked.tolist()[:2] == [direct(memo, w)[0] for w in ("b", "a")] and len(ranked) == 4
