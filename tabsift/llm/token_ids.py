"""Token-id files: frequency-ranked ids in a byte-aligned variable-length code with separate control bytes.

Ids are replaced by their rank in the corpus (0: most frequent), so the commonest 256 take one byte. A rank takes 1 to 4
bytes; four two-bit lengths share a control byte, and control bytes stand apart from data bytes, so a whole block is
decoded by one table lookup and one masked copy in numpy.

A file holds blocks of documents in ascending doc_id order; files are ranges of doc_id:

    block   = b"TIDS", uint32 n_docs, n_tokens, key_bytes, control_bytes, data_bytes (little-endian),
              keys (Arrow IPC batch of doc_id and its token count), control bytes, data bytes
    ranks   = one file, uint32 ids in rank order (at most the vocabulary's size)
"""

from __future__ import annotations

import functools
import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_schema, batch_of, crc32, fields, pieces_of, shared_uri, written
from .tokens import END_ID, vocabulary_path, word_ids

HEAD = "<4sIIIII"
#: Tokens of a block, at which a writer closes it; one document more may follow.
BLOCK_TOKENS = 1 << 20
#: Lengths (less one) of the four ranks that a control byte stands for.
LENGTHS = (np.arange(256, dtype=np.uint8)[:, None] >> np.array([0, 2, 4, 6], dtype=np.uint8)) & 3
_PLACES = np.arange(4, dtype=np.uint8)


def encode(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """(control bytes, data bytes) of non-negative integers under 2^32."""
    ranks = np.ascontiguousarray(ranks, dtype="<u4")
    code = (ranks > 0xFF).astype(np.uint8) + (ranks > 0xFFFF) + (ranks > 0xFFFFFF)
    data = ranks.view(np.uint8).reshape(-1, 4)[_PLACES <= code[:, None]]
    four = np.zeros((len(code) + 3) // 4 * 4, dtype=np.uint8)
    four[:len(code)] = code
    four = four.reshape(-1, 4) << np.array([0, 2, 4, 6], dtype=np.uint8)
    return np.bitwise_or.reduce(four, axis=1).astype(np.uint8).tobytes(), data.tobytes()


def decode(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The ``n`` integers behind control and data bytes."""
    code = LENGTHS[np.frombuffer(control, np.uint8)].reshape(-1)[:n]
    out = np.zeros((n, 4), dtype=np.uint8)
    out[_PLACES <= code[:, None]] = np.frombuffer(data, np.uint8)
    return out.view("<u4").reshape(-1)


def token_table(docs: DataFrame, vocabulary: str | None = None, end_id: int = END_ID, text: str = "text",
                doc_id: str = "doc_id") -> DataFrame:
    """doc_id, n_tokens and ids (zstandard of little-endian uint32, or uint16 where the vocabulary allows) of whole texts."""
    path = vocabulary or vocabulary_path()
    schema = T.StructType([*fields(docs, doc_id), T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.BinaryType())])
    arrow = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, pack = word_ids(path), zstandard.ZstdCompressor(level=1)
        kind = _kind(memo)
        for batch in pieces_of(batches, text, 8 << 20):
            ids = memo.texts(batch.column(text), end_id)
            yield batch_of(arrow, {doc_id: batch.column(doc_id), "n_tokens": [len(x) for x in ids],
                                   "ids": [pack.compress(x.astype(kind).tobytes()) for x in ids]})

    return docs.select(doc_id, text).mapInArrow(run, schema)


def _kind(memo) -> str:
    return "<u2" if memo.tokenizer.get_vocab_size() <= 1 << 16 else "<u4"


def _unpack(ids: bytes, n: int, unpack: zstandard.ZstdDecompressor) -> np.ndarray:
    raw = unpack.decompress(ids)
    return np.frombuffer(raw, "<u2" if len(raw) == 2 * n else "<u4")


def ranked_ids(tokens: DataFrame) -> np.ndarray:
    """Ids by falling count over the whole corpus, ties by id. At most one row per id of the vocabulary reaches the driver."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, unpack = np.zeros(1 << 16, dtype=np.int64), zstandard.ZstdDecompressor()
        for batch in batches:
            rows = list(zip(batch.column("ids").to_pylist(), batch.column("n_tokens").to_pylist(), strict=True))
            for at in range(0, len(rows), 500):
                part = np.bincount(np.concatenate([_unpack(ids, n, unpack) for ids, n in rows[at:at + 500]]), minlength=len(total))
                if len(part) > len(total):
                    total = np.concatenate([total, np.zeros(len(part) - len(total), dtype=np.int64)])
                total += part
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int64()), pa.array(total[seen], pa.int64())], ["id", "n"])

    rows = tokens.select("ids", "n_tokens").mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toPandas()
    return rows.sort_values(["n", "id"], ascending=[False, True])["id"].to_numpy(dtype=np.int64)


def write_token_files(docs: DataFrame, folder: str | None = None, vocabulary: str | None = None, end_id: int = END_ID,
                      text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Write the ids of every whole text as files in ascending doc_id order; returns the table of files.

    A null or empty text is the end id alone. A null doc_id stays null and comes first; repeated doc_ids stand side by
    side, fewer tokens first. Columns other than doc_id and text are not read. No documents: no files. A retried task
    writes a file under a new name, and only names of finished tasks get into the table. Columns: file, ranks, first
    (its first doc_id), n_docs, n_tokens, start (tokens of all files before it).
    """
    spark = docs.sparkSession
    folder = (folder or shared_uri(spark, "token-ids")).rstrip("/")
    tokens = written(token_table(docs, vocabulary, end_id, text, doc_id), "token-table", codec="none")
    ranked = ranked_ids(tokens)
    store, at = pafs.FileSystem.from_uri(folder)
    store.create_dir(at, recursive=True)
    with store.open_output_stream(f"{at}/ranks") as out:
        out.write(ranked.astype("<u4").tobytes())
    rank_of = np.zeros(int(ranked.max()) + 1 if len(ranked) else 1, dtype=np.uint32)
    rank_of[ranked] = np.arange(len(ranked), dtype=np.uint32)
    schema = T.StructType([T.StructField("file", T.StringType()), T.StructField("ranks", T.StringType()),
                           T.StructField("first", docs.schema[doc_id].dataType), T.StructField("n_docs", T.LongType()),
                           T.StructField("n_tokens", T.LongType())])
    arrow = arrow_schema(schema)
    key_type = arrow.field("first").type

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pafs.FileSystem.from_uri(folder)
        unpack, name = zstandard.ZstdDecompressor(), f"ids-{uuid.uuid4().hex}"
        sink, keys, parts, held, docs_out, tokens_out, first = None, [], [], 0, 0, 0, None

        def close_block():
            nonlocal keys, parts, held, docs_out, tokens_out
            index = pa.RecordBatch.from_arrays([pa.array(keys, key_type), pa.array([len(x) for x in parts], pa.int64())],
                                               ["doc_id", "n_tokens"])
            message = _ipc(index)
            control, data = encode(rank_of[np.concatenate(parts)])
            sink.write(struct.pack(HEAD, b"TIDS", len(keys), held, len(message), len(control), len(data)))
            for piece in (message, control, data):
                sink.write(piece)
            docs_out, tokens_out = docs_out + len(keys), tokens_out + held
            keys, parts, held = [], [], 0

        for batch in batches:
            for key, n, ids in zip(*(batch.column(c).to_pylist() for c in (doc_id, "n_tokens", "ids")), strict=True):
                if sink is None:
                    sink, first = fs.open_output_stream(f"{base}/{name}"), key
                keys.append(key)
                parts.append(_unpack(ids, n, unpack))
                held += n
                if held >= BLOCK_TOKENS:
                    close_block()
        if sink is not None:
            if keys:
                close_block()
            sink.close()
            yield batch_of(arrow, {"file": [f"{folder}/{name}"], "ranks": [f"{folder}/ranks"], "first": [first],
                                   "n_docs": [docs_out], "n_tokens": [tokens_out]})

    ordered = tokens.repartitionByRange(doc_id).sortWithinPartitions(doc_id, "n_tokens", "ids")
    files = written(ordered.mapInArrow(write, schema), "token-files")
    before = Window.orderBy(F.col("first").asc_nulls_first(), "file").rowsBetween(Window.unboundedPreceding, -1)
    return files.withColumn("start", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))  # one row per file


def _ipc(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


@functools.lru_cache(maxsize=2)
def _ranks(uri: str) -> np.ndarray:
    fs, path = pafs.FileSystem.from_uri(uri)
    with fs.open_input_stream(path) as src:
        return np.frombuffer(src.read(), "<u4")


def read_blocks(file: str, ranks: str) -> Iterator[tuple[list, list[int], np.ndarray]]:
    """(doc_ids, token counts, ids) of a file's blocks."""
    fs, path = pafs.FileSystem.from_uri(file)
    with fs.open_input_stream(path) as src:
        while head := src.read(struct.calcsize(HEAD)):
            magic, _, n, key_bytes, control_bytes, data_bytes = struct.unpack(HEAD, head)
            if magic != b"TIDS":
                raise ValueError(f"{file} is no token-id file")
            keys = pa.ipc.open_stream(src.read(key_bytes)).read_all()
            rank = decode(src.read(control_bytes), src.read(data_bytes), n)
            yield keys.column("doc_id").to_pylist(), keys.column("n_tokens").to_pylist(), _ranks(ranks)[rank]


def read_token_files(files: DataFrame, keep_ids: bool = True, doc_id: str = "doc_id") -> DataFrame:
    """One row per document from the files: doc_id, start, n_tokens, ids_crc32 and, if kept, ids (little-endian uint32)."""
    schema = T.StructType([T.StructField(doc_id, files.schema["first"].dataType), T.StructField("start", T.LongType()),
                           T.StructField("n_tokens", T.LongType()), T.StructField("ids_crc32", T.LongType()),
                           *([T.StructField("ids", T.BinaryType())] if keep_ids else [])])
    arrow = arrow_schema(schema)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, ranks, start in zip(*(batch.column(c).to_pylist() for c in ("file", "ranks", "start")), strict=True):
                for keys, counts, ids in read_blocks(file, ranks):
                    ends = np.cumsum(counts)
                    raw = [ids[e - n:e].astype("<u4").tobytes() for e, n in zip(ends, counts, strict=True)]
                    columns = {doc_id: keys, "start": [start + int(e) - n for e, n in zip(ends, counts, strict=True)],
                               "n_tokens": counts, "ids_crc32": [crc32(x) for x in raw]}
                    yield batch_of(arrow, columns | ({"ids": raw} if keep_ids else {}))
                    start += int(ends[-1]) if len(ends) else 0

    tasks = max(files.sparkSession.sparkContext.defaultParallelism, 1)
    return files.select("file", "ranks", "start").repartition(max(tasks, files.count())).mapInArrow(read, schema)
