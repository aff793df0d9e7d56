"""Benchmark decontamination: rare bigram seeds find the passages, Smith-Waterman alignment over words scores them.

The items of the benchmark are the query set: they are taken in blocks of bounded text, and a block with its seeds goes to
every task. An alignment (match +1, mismatch and gap -1) of ``p`` points has at most one run of matches more than edits, so
at least ``p - 1`` bigrams of the item lie in it unbroken. A first pass over all documents counts how often each bigram of the
block occurs in the corpus; of the bigrams of an item that occur, all but the ``p - 2`` commonest are seeds, ``p`` being the points of a
leak: a passage without a seed cannot be one. A second pass looks the seeds up in every text, drops the items of which
fewer than ``p - 1`` bigrams lie near each other, and aligns the others with the words there. No pair over the threshold is lost.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_schema, batch_of, fields, pieces_of

#: Items with fewer words cannot be told from chance by an alignment; only their whole sequence of words is a leak.
MIN_ITEM_WORDS = 8
#: A pair is a leak from this share of the item's best score on, or from so many points on.
MIN_SHARE, MIN_POINTS = 0.5, 30
#: Characters of benchmark text in a block.
BLOCK_CHARS = 8 << 20

#: Scripts written without spaces: Thai and Lao, Myanmar, Khmer, kana, Han. Each of their characters is a word.
UNSPACED = ("\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3005-\u3007\u3040-\u30ff\u31f0-\u31ff\u3400-\u4dbf\u4e00-\u9fff"
            "\uf900-\ufaff\uff66-\uff9f\U00020000-\U0003ffff")
_WORD = re.compile(rf"[^\W{UNSPACED}]+|\w")


def words_of(text: str | None) -> list[str]:
    """Runs of word characters, and single ones of unspaced scripts, lower-cased."""
    if not text:
        return []
    lowered = text.lower()
    if len(lowered) == len(text):  # else a letter became several, and word boundaries could move
        return _WORD.findall(lowered)
    found = _WORD.findall(text)
    return " ".join(found).lower().split(" ") if found else []


def align(item: np.ndarray, words: np.ndarray) -> tuple[int, int, int]:
    """Smith-Waterman with linear gaps: (score, first, last + 1) of the best local alignment in ``words``; earliest on ties."""
    n = len(words)
    place = np.arange(n + 1)
    row, begin = np.zeros(n + 1, dtype=np.int64), place.copy()
    best = (0, 0, 0)
    for w in item:
        step = np.where(words == w, 1, -1)
        score, start = row - 1, begin  # a gap in the words
        diagonal = row[:-1] + step
        better = diagonal >= score[1:]
        score[1:] = np.where(better, diagonal, score[1:])
        start = start.copy()
        start[1:] = np.where(better, begin[:-1], start[1:])
        start = np.where(score <= 0, place, start)
        score = np.maximum(score, 0)
        lifted = score + place  # a gap in the item: the best earlier cell less its distance
        top = np.maximum.accumulate(lifted)
        source = np.maximum.accumulate(np.where(lifted == top, place, 0))
        row, begin = top - place, start[source]
        at = int(row.argmax())
        if row[at] > best[0]:
            best = (int(row[at]), int(begin[at]), at)
    return best


def ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The numbers ``start`` to ``start + size - 1`` of every pair, one after the other."""
    return np.arange(size.sum()) + np.repeat(start - np.cumsum(size) + size, size)


class Block:
    """Items of one block: word ids, bigram keys and, once their corpus counts are known, the seeds."""

    def __init__(self, rows: list[tuple], min_words: int, min_share: float, min_points: int):
        self.vocabulary = {}
        self.items = []  # (item_id, word ids)
        for item_id, text in rows:
            words = words_of(text)
            if len(words) >= 2:
                ids = [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words]
                self.items.append((item_id, np.array(ids, dtype=np.int64)))
        self.base = len(self.vocabulary) + 1
        #: Points from which an item's alignment is a leak; fewer than two cannot be told by bigrams.
        self.least = np.array([len(ids) if len(ids) < min_words else max(2, math.ceil(min(min_share * len(ids), min_points)))
                               for _, ids in self.items], dtype=np.int64)
        grams = [self.grams(ids) for _, ids in self.items]
        self.size = np.array([len(g) for g in grams], dtype=np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.keys, self.of = np.unique(np.concatenate(grams), return_inverse=True) if grams else (np.zeros(0, dtype=np.int64),) * 2

    def ids(self, words: list[str]) -> np.ndarray:
        get = self.vocabulary.get
        return np.array(list(map(get, words, repeat(-1))), dtype=np.int64)

    def grams(self, ids: np.ndarray) -> np.ndarray:
        """The key of the bigram at each place; negative where a word is foreign to the block."""
        first, second = ids[:-1], ids[1:]
        return np.where((first >= 0) & (second >= 0), first * self.base + second, -1)

    def found(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places, index into ``keys``) of the bigrams of a text that are among the block's."""
        grams = self.grams(ids)
        places = np.flatnonzero(grams >= 0)
        if not len(places) or not len(self.keys):
            return places[:0], places[:0]
        at = np.searchsorted(self.keys, grams[places])
        hit = self.keys[np.minimum(at, len(self.keys) - 1)] == grams[places]
        return places[hit], at[hit]

    def choose(self, counts: np.ndarray) -> None:
        """Seeds: of an item's bigrams that occur, all but the commonest ``least - 2`` (the last ones on ties)."""
        item = np.repeat(np.arange(len(self.items)), self.size)
        n = counts[self.of]
        order = np.lexsort((-n, item))  # commonest first within an item
        rank = np.arange(len(order)) - np.repeat(self.start, self.size)
        seed = order[(rank >= self.least[item] - 2) & (n[order] > 0)]
        pairs = np.unique(np.stack([self.of[seed], item[seed]], axis=1), axis=0)
        self.seed_items = pairs[:, 1]
        self.seed_start = np.searchsorted(pairs[:, 0], np.arange(len(self.keys) + 1))

    def candidates(self, index: np.ndarray) -> np.ndarray:
        """Items with a seed and at least ``least - 1`` of their bigrams among the ``index`` of a text."""
        own = np.unique(index)
        begin, size = self.seed_start[own], self.seed_start[own + 1] - self.seed_start[own]
        items = np.unique(self.seed_items[ranges(begin, size)])
        if not len(items):
            return items
        sizes = self.size[items]
        wanted = self.of[ranges(self.start[items], sizes)]
        here = own[np.minimum(np.searchsorted(own, wanted), len(own) - 1)] == wanted
        return items[np.add.reduceat(here.astype(np.int64), np.cumsum(sizes) - sizes) >= self.least[items] - 1]

    def leaks(self, words: list[str]) -> Iterator[tuple]:
        """(item_id, score share, points, first word, last word + 1) of every item that a text leaks."""
        ids = self.ids(words)
        places, index = self.found(ids)
        for number in self.candidates(index).tolist() if len(index) else ():
            item_id, item = self.items[number]
            least = int(self.least[number])
            spare = max(0, len(item) - least)  # words that a leak's passage holds beside the item's
            offsets = self.of[self.start[number]:self.start[number] + self.size[number]]
            near = places[np.isin(index, offsets)]
            # the bigrams of a passage lie within its length
            last = np.searchsorted(near, near + len(item) + spare - 1)
            dense = np.flatnonzero(last - np.arange(len(near)) >= least - 1)
            best, window, merged = (0, 0, 0), None, []
            for i in dense.tolist():
                a, b = max(0, int(near[i]) - len(item) - spare), min(len(ids), int(near[i]) + len(item) + spare)
                if merged and a <= merged[-1][1]:
                    merged[-1][1] = max(b, merged[-1][1])
                else:
                    merged.append([a, b])
            for a, b in merged:
                points, first, end = align(item, ids[a:b])
                if points > best[0]:
                    best, window = (points, first, end), a
            if best[0] >= least:
                yield item_id, best[0] / len(item), best[0], window + best[1], window + best[2]


def prepared_blocks(docs: DataFrame, benchmark: DataFrame, min_words: int, min_share: float, min_points: int, block_chars: int,
                    text: str, item_id: str, item_text: str) -> Iterator[Block]:
    """The benchmark's blocks, each with its seeds chosen by the counts over all of ``docs``."""
    items = benchmark.select(item_id, item_text).filter(F.col(item_text).isNotNull())
    chars = items.agg(F.sum(F.length(item_text))).first()[0] or 0
    blocks = 1 + chars // block_chars
    for b in range(blocks):
        mine = items if blocks == 1 else items.filter(F.pmod(F.xxhash64(item_id, item_text), F.lit(blocks)) == b)
        rows = sorted((tuple(r) for r in mine.collect()), key=repr)  # about block_chars characters
        block = Block(rows, min_words, min_share, min_points)
        if not block.items:
            continue
        shared = docs.sparkSession.sparkContext.broadcast(block)

        def count(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            block = shared.value
            total = np.zeros(len(block.keys), dtype=np.int64)
            for batch in pieces_of(batches, text):
                for value in batch.column(text).to_pylist():
                    _, index = block.found(block.ids(words_of(value)))
                    total += np.bincount(index, minlength=len(total))
            seen = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], ["i", "n"])

        counts = np.zeros(len(block.keys), dtype=np.int64)
        got = docs.select(text).mapInArrow(count, "i long, n long").groupBy("i").agg(F.sum("n").alias("n")).toPandas()
        counts[got["i"].to_numpy(dtype=np.int64)] = got["n"].to_numpy(dtype=np.int64)  # at most the block's bigrams
        block.choose(counts)
        yield block


def leaks(docs: DataFrame, benchmark: DataFrame, min_words: int = MIN_ITEM_WORDS,
          min_share: float = MIN_SHARE, min_points: int = MIN_POINTS, block_chars: int = BLOCK_CHARS, text: str = "text",
          doc_id: str = "doc_id", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row per document and benchmark item it holds: doc_id, item_id, score, points, start, end (code points, end exclusive).

    ``score`` is the alignment's points over the item's words (1: a full copy). Words are runs of word characters, and single
    characters of scripts without spaces, lower-cased. An item under ``min_words`` words matches whole or not at all. Null or
    empty texts and items, and items of one word, match nothing; equal items and repeated documents each give their rows; of several equally good places the first counts. Only the named columns
    are read. An empty table on either side gives an empty result.
    """
    spark = docs.sparkSession
    schema = T.StructType([*fields(docs, doc_id), T.StructField(item_id, benchmark.schema[item_id].dataType),
                           T.StructField("score", T.DoubleType()), T.StructField("points", T.LongType()),
                           T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
    arrow = arrow_schema(schema)
    result = spark.createDataFrame([], schema)
    for block in prepared_blocks(docs, benchmark, min_words, min_share, min_points, block_chars, text, item_id, item_text):
        shared = spark.sparkContext.broadcast(block)

        def search(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            block = shared.value
            for batch in pieces_of(batches, text):
                out: list[tuple] = []
                for key, value in zip(batch.column(doc_id).to_pylist(), batch.column(text).to_pylist(), strict=True):
                    places = None
                    for item, share, points, a, z in block.leaks(words_of(value)):
                        places = places or [m.span() for m in _WORD.finditer(value)]
                        out.append((key, item, share, points, places[a][0], places[z - 1][1]))
                if out:
                    yield batch_of(arrow, dict(zip(arrow.names, map(list, zip(*out, strict=True)), strict=True)))

        result = result.unionByName(docs.select(doc_id, text).mapInArrow(search, schema))
    return result


def clean_documents(docs: DataFrame, benchmark: DataFrame, min_words: int = MIN_ITEM_WORDS,
                    min_share: float = MIN_SHARE, min_points: int = MIN_POINTS, block_chars: int = BLOCK_CHARS, text: str = "text",
                    item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows of ``docs`` without a leak, all columns kept: searched as in ``leaks``, without a join."""
    arrow, left = arrow_schema(docs.schema), docs
    for block in prepared_blocks(docs, benchmark, min_words, min_share, min_points, block_chars, text, item_id, item_text):
        shared = docs.sparkSession.sparkContext.broadcast(block)

        def keep(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            block = shared.value
            for batch in pieces_of(batches, text):
                clean = [next(block.leaks(words_of(v)), None) is None for v in batch.column(text).to_pylist()]
                some = batch.filter(pa.array(clean, pa.bool_()))
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(some.columns, arrow, strict=True)], schema=arrow)

        left = left.mapInArrow(keep, docs.schema)
    return left
