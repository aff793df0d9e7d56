"""Sequence packing by power-of-two decomposition.

A document of n tokens is cut into the powers of two that add up to n (the largest allowed one as often as it fits, then
the binary digits of the rest). Every piece is a sequence of its own: its length is a power of two, so nothing is
padded, and no sequence crosses documents. Pieces of equal length are written into one bucket (a folder of the table),
from which a training run draws batches of one length. No shuffle is needed: a row is read, cut and written.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_schema, batch_of, crc32, fields, numbered, pieces_of, written
from .tokens import END_ID, vocabulary_path, word_ids

MAX_TOKENS = 4096


def binary_lengths(n: int, max_tokens: int = MAX_TOKENS) -> list[int]:
    """Powers of two that add up to ``n``, longest first: ``max_tokens`` as often as it fits, then the rest's binary digits."""
    if max_tokens & (max_tokens - 1):
        raise ValueError("max_tokens must be a power of two")
    whole, rest = divmod(n, max_tokens)
    return [max_tokens] * whole + [1 << b for b in reversed(range(max_tokens.bit_length() - 1)) if rest >> b & 1]


def pieces(docs: DataFrame, vocabulary: str | None = None, max_tokens: int = MAX_TOKENS, end_id: int = END_ID,
           text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Pieces of every whole text: doc_id, start, length, doc_tokens, ids_crc32, ids (little-endian uint32).

    A null or empty text is the end id alone (one piece of length 1); a null doc_id stays null; repeated rows are cut
    each for itself; other columns of ``docs`` are not read. An empty table gives an empty result.
    """
    path = vocabulary or vocabulary_path()
    schema = T.StructType([*fields(docs, doc_id), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()),
                           T.StructField("doc_tokens", T.LongType()), T.StructField("ids_crc32", T.LongType()),
                           T.StructField("ids", T.BinaryType())])
    arrow = arrow_schema(schema)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = word_ids(path)
        for batch in pieces_of(batches, text, 4 << 20):
            out: list[list] = [[], [], [], [], [], []]
            for key, flat in zip(batch.column(doc_id).to_pylist(), memo.texts(batch.column(text), end_id), strict=True):
                ids = flat.tobytes()
                n, start = len(flat), 0
                for length in binary_lengths(n, max_tokens):
                    part = ids[4 * start:4 * (start + length)]
                    for column, v in zip(out, (key, start, length, n, crc32(part), part), strict=True):
                        column.append(v)
                    start += length
            yield batch_of(arrow, dict(zip(arrow.names, out, strict=True)))

    return docs.select(doc_id, text).mapInArrow(cut, schema)


def packed_sequences(docs: DataFrame, vocabulary: str | None = None, max_tokens: int = MAX_TOKENS, end_id: int = END_ID,
                     text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The pieces as sequences, written in buckets of equal length: the columns of ``pieces`` and sequence_id, offset (0)."""
    bucketed = written(pieces(docs, vocabulary, max_tokens, end_id, text, doc_id), "packed", by="length")
    return numbered(bucketed, "sequence_id").withColumn("offset", F.lit(0).cast("long"))


def sequence_ids(row_ids: bytes) -> np.ndarray:
    """The token ids of one stored piece."""
    return np.frombuffer(row_ids, dtype="<u4")
