"""Importance resampling towards a target: hashed n-gram counts of corpus and target give each bucket a gain, a document
the mean gain of its n-grams, and Gumbel noise turns the best sums into a draw without replacement.

N-grams never become strings in bulk. Arrow lower-cases and splits a batch's texts, flattens the lists and encodes the
words as dictionary indices; indices shifted against each other are the n-grams, of which only the batch's distinct ones
meet CRC-32; gains are taken by index and summed by segments. The corpus is read twice (counts, then weights); what
leaves a task is one number per bucket, then one short row per document.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_schema, fields, pieces_of, written

#: What lies between words: every ASCII character but digits and lower-case letters.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
MAX_WORDS, BUCKETS = 2, 10000


@dataclass
class Grams:
    """The n-grams of a batch: ``words`` of each text, distinct n-grams' ``buckets``, and for each order the index into
    them of every n-gram with the text that it is in."""

    words: np.ndarray
    buckets: np.ndarray
    orders: list[tuple[np.ndarray, np.ndarray]]


def grams_of(texts: pa.Array, max_words: int = MAX_WORDS, buckets: int = BUCKETS) -> Grams:
    """All runs of 1 to ``max_words`` words of each text (null: none), hashed by CRC-32 of their bytes joined by a space."""
    lists = pc.split_pattern_regex(pc.ascii_lower(pc.fill_null(texts, "")), pattern=BETWEEN)
    size = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
    flat = pc.list_flatten(lists)
    real = pc.not_equal(flat, "").to_numpy(zero_copy_only=False)  # a split leaves empty ends
    owner = np.repeat(np.arange(len(texts)), size)[real]
    coded = pc.dictionary_encode(flat.filter(pa.array(real)))
    word = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    said = [w.encode() for w in coded.dictionary.to_pylist()]
    crcs = np.array([zlib.crc32(w) for w in said], dtype=np.uint32)
    tails = [b" " + w for w in said]
    found, orders, gram, owners, base = [crcs], [(word, owner)], word, owner, 0
    for n in range(2, max_words + 1):
        whole = owners[:len(gram) - 1] == owner[n - 1:] if len(gram) else np.zeros(0, dtype=bool)
        pair = (gram[:-1] - base)[whole] * max(len(said), 1) + word[n - 1:][whole]
        pairs = pc.dictionary_encode(pa.array(pair))
        key = pairs.dictionary.to_numpy(zero_copy_only=False)
        before = found[-1]
        base += len(before)
        heads = before[key // max(len(said), 1)].tolist()
        found.append(np.fromiter((zlib.crc32(tails[t], h) for t, h in zip((key % max(len(said), 1)).tolist(), heads, strict=True)),
                                 dtype=np.uint32, count=len(key)))
        # places stay aligned with the words: an n-gram is named where it begins, -1 where it would leave its text
        named = np.full(len(whole), -1, dtype=np.int64)
        named[whole] = pairs.indices.to_numpy(zero_copy_only=False) + base
        orders.append((named[whole], owners[:-1][whole] if len(gram) else owners[:0]))
        gram, owners = named, np.where(whole, owners[:-1], -1) if len(gram) else owners[:0]
    return Grams(np.bincount(owner, minlength=len(texts)), (np.concatenate(found) % buckets).astype(np.int64), orders)


def bucket_counts(df: DataFrame, text: str = "text", max_words: int = MAX_WORDS, buckets: int = BUCKETS) -> np.ndarray:
    """How many n-grams of all texts fall into each bucket; ``buckets`` numbers a task, added up before the driver sees them."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, dtype=np.int64)
        for batch in pieces_of(batches, text):
            grams = grams_of(batch.column(text), max_words, buckets)
            for index, _ in grams.orders:
                total += np.bincount(grams.buckets[index], minlength=buckets)
        hit = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(hit), pa.array(total[hit])], ["bucket", "n"])

    out = np.zeros(buckets, dtype=np.int64)
    for r in df.select(text).mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


def bucket_gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln of the smoothed share in the target over that in the corpus) of each bucket."""
    size, s_all, t_all = len(corpus), float(corpus.sum()), float(target.sum())
    return np.array([math.floor(1000 * math.log((t + 1.0) * (s_all + size) / ((s + 1.0) * (t_all + size))))
                     for s, t in zip(corpus.tolist(), target.tolist(), strict=True)], dtype=np.int64)


def gumbel(seed: str, doc_id) -> int:
    """floor(-1000 ln(-ln u)), u from the first 32 bits of sha256(``seed:doc_id``); a null id counts as the word null."""
    h = int(hashlib.sha256(f"{seed}:{'null' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def weights(docs: DataFrame, gains: np.ndarray, max_words: int = MAX_WORDS, seed: str = "7", text: str = "text",
            doc_id: str = "doc_id") -> DataFrame:
    """doc_id, n_words, n_features, weight (floored mean gain; no words: 0) and score (with noise) of every row."""
    schema = T.StructType([*fields(docs, doc_id), *(T.StructField(c, T.LongType()) for c in ("n_words", "n_features", "weight", "score"))])
    arrow, buckets = arrow_schema(schema), len(gains)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces_of(batches, text):
            grams = grams_of(batch.column(text), max_words, buckets)
            gain = pa.array(gains).take(pa.array(grams.buckets)).to_numpy()  # of each distinct n-gram
            total, number = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
            for index, owner in grams.orders:
                if len(owner):
                    first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
                    total[owner[first]] += np.add.reduceat(gain[index], first)
                    number += np.bincount(owner, minlength=batch.num_rows)
            weight = total // np.maximum(number, 1)
            noise = np.array([gumbel(seed, v) for v in batch.column(doc_id).to_pylist()], dtype=np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(doc_id).cast(arrow.field(0).type),
                                              *(pa.array(x) for x in (grams.words, number, weight, weight + noise))], schema=arrow)

    return docs.select(doc_id, text).mapInArrow(run, schema)


def resampled(docs: DataFrame, target: DataFrame, percent: int = 25, min_words: int = 20, max_words: int = MAX_WORDS,
              buckets: int = BUCKETS, seed: str = "7", text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, n_words, n_features, weight, score and rank (1, 2, ... of those drawn, else null) of every row of ``docs``.

    Of the N rows with at least ``min_words`` words, floor(percent · N / 100) are drawn: highest scores, ties to the
    smaller doc_id (null ids last, repeated rows in any order). Null and empty texts have no n-grams and weight 0; an
    empty target or corpus leaves the gains to the smoothing. A null doc_id draws its noise like the word null. Columns
    other than doc_id and text are not read; an empty table gives an empty result.

    Scores are whole numbers within some 100,000 values whatever the corpus, so one count per score finds the cut; only
    rows from there on are dealt by ranges, and a rank is a range's offset and the place in it.
    """
    gains = bucket_gains(bucket_counts(docs, text, max_words, buckets), bucket_counts(target, text, max_words, buckets))
    found = written(weights(docs, gains, max_words, seed, text, doc_id).withColumn("row_", F.monotonically_increasing_id()), "weights")
    drawable = F.col("n_words") >= min_words
    cut, quota = _cut(found.filter(drawable), percent)
    names = [doc_id, "n_words", "n_features", "weight", "score"]
    nobody = F.lit(None).cast("long").alias("rank")
    if not quota:
        return found.select(*names, nobody)
    order = [F.col("score").desc(), F.col(doc_id).asc_nulls_last(), F.col("row_").asc()]
    best = found.filter(drawable & (F.col("score") >= cut)).repartitionByRange(*order).sortWithinPartitions(*order)
    best = written(best.withColumn("part_", F.spark_partition_id()).withColumn("place_", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))), "best")
    offsets, at = [], 0
    for r in sorted(best.groupBy("part_").agg(F.count(F.lit(1)).alias("n")).collect(), key=lambda r: r["part_"]):
        offsets.append((r["part_"], at))
        at += r["n"]
    offset = found.sparkSession.createDataFrame(offsets, "part_ int, offset_ long")  # one row for each range
    rank = F.col("offset_") + F.col("place_") + 1
    ranked = best.join(F.broadcast(offset), "part_").select(*names, F.when(rank <= quota, rank).alias("rank"))
    return ranked.unionByName(found.filter(~(drawable & (F.col("score") >= cut))).select(*names, nobody))


def _cut(rows: DataFrame, percent: int) -> tuple[int, int]:
    """The least score that can be drawn and the number of rows drawn."""
    counts = sorted(((r["score"], r["n"]) for r in rows.groupBy("score").agg(F.count(F.lit(1)).alias("n")).collect()), reverse=True)
    quota, above = sum(n for _, n in counts) * percent // 100, 0
    for score, n in counts:
        above += n
        if above >= quota:
            return score, quota
    return 0, 0
