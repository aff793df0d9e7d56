"""Language-model scores of whole texts from an Elias-Fano bigram trie in shards.

Tokens are lower-cased words and one end per text; the end is also the context of a text's first word. With n the counts
in the training texts, p(c) = (n(c) + 0.5) / (N + 0.5 (V + 1)) and p(c | b) = (n(b c) + m p(c)) / (n(b) + m): Dirichlet smoothing whose
weight m = MU (n(b) + 1)^GROWTH follows the number of different successors that a word of that count has. It needs no
count beyond n(b), so a context's successors may live apart.

Two jobs, no step of which holds more than a batch or a shard:

1. Each task cuts its texts into batches. A batch sends every shard one message: the words that live there (by hash) with
   their counts in the batch's training texts, and their successors. A shard adds the messages up, builds its trie as a
   file, maps it into memory, and answers each message by searching the trie: the exact count of every word, the
   quantised joint count of every pair. The batch's token numbers travel beside the messages.
2. Each batch meets the answers to its messages and sums up its texts.

Contexts that are a large share of the corpus (found on a sample; the choice moves work only) keep their successors
spread over all shards by the successor.
"""

from __future__ import annotations

import os
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_schema, batch_of, pieces_of, written
from .elias_fano import Trie, restored

MU, GROWTH = 5.0, 0.8
#: Bytes of text in a batch and, about, behind a shard.
BATCH_BYTES, SHARD_BYTES = 16 << 20, 12 << 20
#: A context with this share of the sample's tokens is spread; one text in SAMPLE is in the sample.
HOT_SHARE, SAMPLE = 0.002, 32
#: Kinds of rows between the jobs.
TOKENS, MESSAGE, ANSWER, TOTALS = 0, 1, 2, 3

ROWS = "batch long, kind int, shard long, key long, payload binary"


def hashes_of(text: str | None) -> list[int]:
    """64-bit hashes of the lower-cased words of a text."""
    import xxhash
    return list(map(xxhash.xxh64_intdigest, text.encode().lower().split())) if text else []


def end_hash() -> int:
    import xxhash
    return xxhash.xxh64_intdigest(b"\n")  # no word holds a line feed


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays as one compressed byte string."""
    press = zstandard.ZstdCompressor(level=1)
    out = [np.array([len(arrays)], dtype="<i8").tobytes()]
    for a in arrays:
        body, kind = press.compress(np.ascontiguousarray(a).tobytes()), a.dtype.str.encode().ljust(8)
        out += [kind, np.array([len(a), len(body)], dtype="<i8").tobytes(), body]
    return b"".join(out)


def unpack(data: bytes) -> list[np.ndarray]:
    press, at, out = zstandard.ZstdDecompressor(), 8, []
    for _ in range(int.from_bytes(data[:8], "little")):
        kind = data[at:at + 8].decode().strip()
        n, size = np.frombuffer(data[at + 8:at + 24], dtype="<i8").tolist()
        out.append(np.frombuffer(press.decompress(data[at + 24:at + 24 + size], max_output_size=max(1, n * np.dtype(kind).itemsize)), dtype=kind))
        at += 24 + size
    return out


class Layout:
    """Where the words and pairs of a batch live; rebuilt alike from the batch's tokens and its words' shards."""

    def __init__(self, tokens: np.ndarray, trained: np.ndarray, ends: np.ndarray, word_shard: np.ndarray, hot: np.ndarray, shards: int, end: int):
        """``tokens``: local word numbers, texts one after another, each closed by ``end``; ``ends``: where each text ends."""
        context = np.empty_like(tokens)
        context[1:] = tokens[:-1]
        if len(tokens):
            context[np.r_[0, ends[:-1]]] = end
        key = context.astype(np.int64) << 32 | tokens
        self.pairs, self.pair_of = np.unique(key, return_inverse=True)
        self.context, self.successor = self.pairs >> 32, self.pairs & 0xFFFFFFFF
        self.counts = np.bincount(self.pair_of, weights=trained, minlength=len(self.pairs)).astype(np.int64)
        home = word_shard[self.context].astype(np.int64)
        spread = np.zeros(len(word_shard), dtype=bool)
        spread[hot] = True
        shard = np.where(spread[self.context], (home + word_shard[self.successor]) % shards, home)
        self.pair_order = np.argsort(shard, kind="stable")  # within a shard by context, then successor
        self.pair_bounds = np.searchsorted(shard[self.pair_order], np.arange(shards + 1))
        self.word_order = np.argsort(word_shard, kind="stable")
        self.word_bounds = np.searchsorted(word_shard[self.word_order], np.arange(shards + 1))

    def words_in(self, shard: int) -> np.ndarray:
        return self.word_order[self.word_bounds[shard]:self.word_bounds[shard + 1]]

    def pairs_in(self, shard: int) -> np.ndarray:
        return self.pair_order[self.pair_bounds[shard]:self.pair_bounds[shard + 1]]


def _messages(ids: pa.Array, texts: list, trained: list[bool], batch: int, shards: int, hot: np.ndarray) -> Iterator[tuple]:
    """Rows (batch, kind, shard, key, payload) of one batch."""
    sizes, all_hashes, end = [], [], end_hash()
    for text in texts:
        found = hashes_of(text)
        found.append(end)
        sizes.append(len(found))
        all_hashes.append(np.array(found, dtype=np.uint64))
    flat = np.concatenate(all_hashes)
    words, tokens = np.unique(flat, return_inverse=True)
    del all_hashes, flat
    ends = np.cumsum(sizes)
    word_shard = (words % np.uint64(shards)).astype(np.uint32)
    hot_local = np.flatnonzero(np.isin(words, hot))
    use = np.repeat(np.array(trained, dtype=bool), sizes)
    end_local = int(np.searchsorted(words, np.uint64(end)))
    layout = Layout(tokens, use, ends, word_shard, hot_local, shards, end_local)
    word_counts = np.bincount(tokens, weights=use, minlength=len(words)).astype(np.int64)
    index = pa.RecordBatch.from_arrays([ids], ["doc_id"])
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, index.schema) as out:
        out.write_batch(index)
    yield batch, TOKENS, -1, shards + batch, pack(np.frombuffer(sink.getvalue(), dtype=np.uint8), np.array(sizes, dtype=np.int64),
                                                  tokens.astype(np.uint32), word_shard, hot_local.astype(np.uint32), np.array([end_local, shards], dtype=np.int64))
    for shard in range(shards):
        mine, pairs = layout.words_in(shard), layout.pairs_in(shard)
        context = layout.context[pairs]
        heads = np.flatnonzero(np.r_[True, context[1:] != context[:-1]]) if len(pairs) else np.zeros(0, dtype=np.int64)
        yield batch, MESSAGE, shard, shard, pack(
            words[mine], word_counts[mine].astype(np.uint32), words[context[heads]] if hot_local.size and np.isin(context[heads], hot_local).any() else np.zeros(0, np.uint64),
            np.searchsorted(mine, context[heads]).astype(np.uint32), np.diff(np.r_[heads, len(pairs)]).astype(np.uint32),
            (words[layout.successor[pairs]] >> np.uint64(32)).astype(np.uint32), layout.counts[pairs].astype(np.uint32))


def _opened(payload: bytes) -> tuple:
    """(words, counts, context hash of each pair, successor, joint) of a message."""
    words, counts, named, place, lengths, successor, joint = unpack(payload)
    context = named if len(named) else (words[place] if len(place) else np.zeros(0, np.uint64))
    return words, counts, np.repeat(context, lengths), successor, joint


def _answers(shard: int, rows: list[tuple[int, bytes]], folder: str | None) -> Iterator[tuple]:
    """Build the shard's trie from its messages and answer them."""
    held = [(batch, *_opened(payload)) for batch, payload in rows]
    words, inverse = np.unique(np.concatenate([h[1] for h in held]), return_inverse=True)
    counts = np.bincount(inverse, weights=np.concatenate([h[2] for h in held]), minlength=len(words)).astype(np.int64)
    seen = counts > 0
    used = [h[5] > 0 for h in held]
    pair_context = np.concatenate([h[3][u] for h, u in zip(held, used, strict=True)])
    names = np.unique(np.concatenate([words[seen], pair_context]))
    own = np.zeros(len(names), dtype=np.int64)
    own[np.searchsorted(names, words[seen])] = counts[seen]
    level = np.searchsorted(names, pair_context).astype(np.uint64) << np.uint64(32)
    level |= np.concatenate([h[4][u] for h, u in zip(held, used, strict=True)]).astype(np.uint64)
    pairs, inverse = np.unique(level, return_inverse=True)
    joint = np.bincount(inverse, weights=np.concatenate([h[5][u] for h, u in zip(held, used, strict=True)]), minlength=len(pairs)).astype(np.int64)
    with tempfile.TemporaryDirectory() as scratch:
        path = os.path.join(scratch, "trie")
        Trie.build(names, own, (pairs >> np.uint64(32)).astype(np.int64), (pairs & np.uint64(0xFFFFFFFF)).astype(np.uint32), joint).to_file(path)
        del level, pairs, inverse, joint, pair_context
        if folder:
            import pyarrow.fs as pafs
            store, base = pafs.FileSystem.from_uri(folder)
            with store.open_output_stream(f"{base}/shard-{shard:06d}.trie") as out, open(path, "rb") as src:
                out.write(src.read())
        trie = Trie.mapped(path)
        yield -1, TOTALS, shard, pack(np.array([counts.sum(), int(seen.sum())], dtype=np.int64))
        for batch, asked, _, context, successor, _ in held:
            rank, back = np.unique(context, return_inverse=True)
            found = trie.joint(trie.words.find(rank)[back], successor) if len(context) else np.zeros(0, np.uint8)
            yield batch, ANSWER, shard, pack(trie.counts(trie.words.find(asked)), found)


def _scores(ids: list, sizes: np.ndarray, layout: Layout, word_count: np.ndarray, codes: np.ndarray, tokens: np.ndarray, total: int, distinct: int) -> dict:
    unigram = (word_count + 0.5) / (total + 0.5 * (distinct + 1))
    before = word_count[layout.context]
    smooth = MU * (before + 1.0) ** GROWTH
    pair = np.log10((restored(codes) + smooth * unigram[layout.successor]) / (before + smooth))
    ends = np.cumsum(sizes)
    starts = ends - sizes
    add = lambda x: np.add.reduceat(x, starts)  # noqa: E731  every text has a token
    return {"n_tokens": sizes, "n_known": add((word_count[tokens] > 0).astype(np.int64)), "base_score": add(np.log10(unigram)[tokens]), "score": add(pair[layout.pair_of])}


def scores(docs: DataFrame, train: str, text: str = "text", doc_id: str = "doc_id", model_folder: str | None = None,
           batch_bytes: int = BATCH_BYTES, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """doc_id, ``train``, n_tokens, n_known, train_tokens, base_score, score of every whole text.

    The model learns from rows whose boolean column ``train`` is true (null counts as false). A null or empty text is its
    end alone. A null doc_id and repeated rows keep their rows (and repeated training rows count each time); other
    columns are not read. Without training rows all counts are 0 and all words equally unlikely; an empty table gives an
    empty result. ``model_folder``: where to keep the shards' trie files, if anywhere.
    """
    plain = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.coalesce(F.col(train), F.lit(False)).alias("train"))
    size = plain.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = 1 + size // shard_bytes
    hot = _hot_contexts(plain)
    id_type = docs.schema[doc_id].dataType
    row_schema = T._parse_datatype_string(ROWS)
    arrow = arrow_schema(row_schema)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, number = TaskContext.get().partitionId(), 0
        held, size = [], 0

        def flush():
            nonlocal held, size, number
            joined = pa.Table.from_batches(held).combine_chunks()
            rows = _messages(joined.column("doc_id").combine_chunks() if joined.num_rows else pa.array([]), joined.column("text").to_pylist(),
                             joined.column("train").to_pylist(), task << 24 | number, shards, hot)
            held, size, number = [], 0, number + 1
            for row in rows:
                yield batch_of(arrow, {n: [v] for n, v in zip(arrow.names, row, strict=True)})

        for piece in pieces_of(batches, "text"):
            held.append(piece)
            size += piece.column("text").nbytes
            if size >= batch_bytes:
                yield from flush()
        if held:
            yield from flush()

    sent = plain.mapInArrow(send, row_schema)
    back_schema = T._parse_datatype_string("batch long, kind int, shard long, payload binary")
    back = arrow_schema(back_schema)

    def answer(group: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, shard = [], None
        for part in group:
            for batch, kind, number, payload in zip(*(part.column(c).to_pylist() for c in ("batch", "kind", "shard", "payload")), strict=True):
                if kind == TOKENS:  # passes by
                    yield batch_of(back, {"batch": [batch], "kind": [kind], "shard": [number], "payload": [payload]})
                else:
                    shard = number
                    rows.append((batch, payload))
        if rows:
            for row in _answers(shard, sorted(rows), model_folder):
                yield batch_of(back, {n: [v] for n, v in zip(back.names, row, strict=True)})

    answers = written(sent.groupBy("key").applyInArrow(answer, back_schema), "lm-answers", codec="none")
    total, distinct = 0, 0
    for (payload,) in answers.filter(F.col("kind") == TOTALS).select("payload").toLocalIterator():  # two numbers a shard
        part = unpack(payload)[0]
        total, distinct = total + int(part[0]), distinct + int(part[1])
    schema = T.StructType([T.StructField(doc_id, id_type), T.StructField("n_tokens", T.LongType()), T.StructField("n_known", T.LongType()),
                           T.StructField("train_tokens", T.LongType()), T.StructField("base_score", T.DoubleType()), T.StructField("score", T.DoubleType())])
    result = arrow_schema(schema)

    def finish(group: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, own = {}, None
        for part in group:
            for kind, shard, payload in zip(*(part.column(c).to_pylist() for c in ("kind", "shard", "payload")), strict=True):
                if kind == TOKENS:
                    own = unpack(payload)
                else:
                    found[shard] = unpack(payload)
        ids, sizes, tokens, word_shard, hot_local, (end, n_shards) = own
        tokens = tokens.astype(np.int64)
        layout = Layout(tokens, np.zeros(len(tokens), dtype=bool), np.cumsum(sizes), word_shard, hot_local, int(n_shards), int(end))
        word_count, codes = np.zeros(len(word_shard), dtype=np.int64), np.zeros(len(layout.pairs), dtype=np.uint8)
        for shard, (counts, joint) in found.items():
            word_count[layout.words_in(shard)] = counts
            codes[layout.pairs_in(shard)] = joint
        keys = pa.ipc.open_stream(ids.tobytes()).read_all().column("doc_id").combine_chunks()
        columns = _scores(keys, sizes, layout, word_count, codes, tokens, total, distinct)
        yield batch_of(result, {doc_id: keys, "train_tokens": np.full(len(sizes), total), **columns})

    return answers.filter(F.col("kind") != TOTALS).groupBy("batch").applyInArrow(finish, schema)


def _hot_contexts(plain: DataFrame) -> np.ndarray:
    """Hashes of the words with at least HOT_SHARE of a sample's tokens: 1 / HOT_SHARE of them at most."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end = end_hash()
        for batch in pieces_of(batches, "text", 8 << 20):
            flat = np.array([h for t in batch.column("text").to_pylist() for h in (*hashes_of(t), end)], dtype=np.uint64)
            words, n = np.unique(flat, return_counts=True)
            often = n >= max(2, HOT_SHARE * len(flat) / 2)
            yield pa.RecordBatch.from_arrays([pa.array(words[often].view(np.int64)), pa.array(n[often]), pa.array(np.r_[len(flat), np.zeros(int(often.sum()) - 1, np.int64)] if often.any() else [], pa.int64())], ["word", "n", "tokens"])

    sample = plain.filter(F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(SAMPLE)) == 0).select("text")
    rows = sample.mapInArrow(count, "word long, n long, tokens long").groupBy("word").agg(F.sum("n").alias("n"), F.sum("tokens").alias("tokens"))
    rows = written(rows, "lm-often")
    tokens = rows.agg(F.sum("tokens")).first()[0] or 0
    hot = rows.filter(F.col("n") >= HOT_SHARE * tokens).select("word").toPandas()["word"].to_numpy(dtype=np.int64)
    return np.sort(hot.view(np.uint64))
