"""Toxicity by compression distance: two zstandard dictionaries, one trained on toxic and one on ordinary text.

The windows of a text are its words. A window is compressed with either dictionary between two fixed marks that both
dictionaries hold (zstandard stores blocks of a few bytes raw and looks for no match in a block's last bytes); the
difference of the two lengths tells how much better the toxic dictionary knows the window. Few words of a toxic document
are toxic, so the toxic dictionary is trained on the stretches of toxic documents whose letters are far commoner there
than in ordinary ones. The threshold on the difference, and the logistic scale from window counts to a score, are
calibrated on labelled documents that neither dictionary has seen. A worker keeps the differences of words it has met.
"""

from __future__ import annotations

import functools
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_schema, batch_of, crc_mod, fields, pieces_of

#: Bounds of the training sample: labelled documents of each class, and different words taken of each.
SAMPLE_PER_CLASS, SAMPLE_WORDS = 4000, 2000
ORDINARY_BYTES, TOXIC_BYTES = 65536, 4096
#: A letter n-gram (or word) is telling if this share of toxic documents hold it, this many times more often than ordinary ones.
GRAM, MIN_SHARE, MIN_RATIO = 4, 0.006, 10.0
#: Share of ordinary documents that may hold a window over the threshold.
MAX_FALSE = 0.002
MEMO_WORDS = 600_000
BEFORE, AFTER = bytes(range(1, 25)), bytes(range(200, 224))

_SPLIT = re.compile(rb"[\x00-\x40\x5b-\x60\x7b-\x7f]+")


def windows(text: str | None) -> list[bytes]:
    """The words of a text: runs of letters, lower-cased in ASCII."""
    return [w for w in _SPLIT.split(text.encode().lower()) if w] if text else []


@dataclass(frozen=True)
class Model:
    ordinary: bytes
    toxic: bytes
    threshold: int = 4
    weights: tuple[float, ...] = (0.0, 0.0, 0.0)
    bias: float = 0.0
    constant: float | None = None  # the score of all texts where one class had no labels


class Differences(dict):
    """word → bytes saved by the toxic dictionary against the ordinary one."""

    def __init__(self, ordinary: bytes, toxic: bytes):
        super().__init__()
        self.pair = [_compressor(d) for d in (ordinary, toxic)]

    def __missing__(self, word: bytes) -> int:
        framed = b"%b %b %b" % (BEFORE, word, AFTER)
        value = len(self.pair[0].compress(framed)) - len(self.pair[1].compress(framed))
        if len(word) <= 64:
            if len(self) >= MEMO_WORDS:
                self.clear()
            self[word] = value
        return value


def _compressor(content: bytes) -> zstandard.ZstdCompressor:
    held = zstandard.ZstdCompressionDict(content + BEFORE + AFTER, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    how = zstandard.ZstdCompressionParameters.from_level(
        5, dict_size=len(content) + len(BEFORE) + len(AFTER), source_size=96, min_match=4, write_content_size=False,
        write_checksum=False, write_dict_id=False, format=zstandard.FORMAT_ZSTD1_MAGICLESS)
    held.precompute_compress(compression_params=how)
    return zstandard.ZstdCompressor(dict_data=held, compression_params=how)


@functools.lru_cache(maxsize=2)
def _differences(ordinary: bytes, toxic: bytes) -> Differences:
    return Differences(ordinary, toxic)


def window_differences(text: str | None, model: Model) -> np.ndarray:
    words = windows(text)
    known = _differences(model.ordinary, model.toxic)
    return np.fromiter(map(known.__getitem__, words), dtype=np.int64, count=len(words))


def features(differences: np.ndarray, threshold: int) -> tuple[float, float, float]:
    """Best difference, windows over the threshold and their excess (both as logarithms)."""
    if not len(differences):
        return 0.0, 0.0, 0.0
    over = differences[differences >= threshold]
    return float(max(0, differences.max())), float(np.log1p(len(over))), float(np.log1p((over - threshold + 1).sum()))


def score(text: str | None, model: Model) -> float:
    """0 to 1; an empty text scores by the bias alone."""
    if model.constant is not None:
        return model.constant
    x = np.dot(features(window_differences(text, model), model.threshold), model.weights) + model.bias
    return float(1 / (1 + np.exp(-np.clip(x, -35, 35))))


def _dictionary(samples: list[bytes], size: int, segment: int) -> bytes:
    """A dictionary trained on the samples in mixed (hashed) order; where they are too few to train on, their end is the dictionary."""
    import xxhash
    mixed = [s for _, _, s in sorted((xxhash.xxh64_intdigest(s, i % 64), i, s) for i, s in enumerate(samples))]
    joined = [b" ".join(mixed[i:i + 10]) for i in range(0, len(mixed), 10)]
    try:
        return zstandard.train_dictionary(size, joined, k=segment, d=6).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return (b" ".join(samples)[-size:]).rjust(16)


def without_copies(documents: list[set[bytes]]) -> list[set[bytes]]:
    """One of each set of near copies: documents that share their three least-hashed words under either of two seeds."""
    import xxhash
    seen, out = set(), []
    for words in documents:
        marks = {(seed, tuple(sorted(xxhash.xxh64_intdigest(w, seed) for w in words)[:3])) for seed in (1, 2)}
        if words and not marks & seen:
            out.append(words)
        seen |= marks
    return out


def toxic_samples(toxic: list[set[bytes]], ordinary: list[set[bytes]]) -> list[bytes]:
    """Words, and stretches of words, that are telling of toxic documents: one entry per document that holds them."""
    padded = lambda w: b" " + w + b" "
    cut = lambda w: {padded(w)[i:i + GRAM] for i in range(len(w) + 3 - GRAM)}

    def counted(documents):
        words, grams = Counter(), Counter()
        for held in documents:
            words.update(held)
            grams.update(set().union(*map(cut, held)) if held else ())
        return words, grams

    (tw, tg), (ow, og) = counted(toxic), counted(ordinary)
    least = max(4, MIN_SHARE * len(toxic))

    def telling(found, other):
        return {g for g, n in found.items() if n >= least and (n + .5) / (len(toxic) + 1) >= MIN_RATIO * (other[g] + .5) / (len(ordinary) + 1)}

    words, grams = telling(tw, ow), telling(tg, og)
    out: Counter = Counter()
    for held in toxic:
        for w in held:
            if w in words:
                out[padded(w)] += 1
                continue
            text, spans = padded(w), []
            for i in range(len(text) - GRAM + 1):
                if text[i:i + GRAM] in grams:
                    if spans and i <= spans[-1][1]:
                        spans[-1][1] = i + GRAM
                    else:
                        spans.append([i, i + GRAM])
            out.update(text[a:b] for a, b in spans)
    # the commonest last: nearest to the window, and kept where the dictionary has no room for all
    return [s for s, n in sorted(out.items(), key=lambda x: (x[1], x[0])) for _ in range(min(n, 8))]


def _logistic(x: np.ndarray, y: np.ndarray, share: float, ridge: float = 0.05) -> tuple[tuple[float, ...], float]:
    """Newton's method to convergence; ``share`` is class 1's share among all labels, whatever the sample's is."""
    x1 = np.column_stack([x, np.ones(len(x))])
    weight = np.where(y > 0, share / max(y.sum(), 1), (1 - share) / max((1 - y).sum(), 1)) * len(y)
    beta, keep = np.zeros(x1.shape[1]), ridge * np.diag([1.0] * x.shape[1] + [1e-6])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x1 @ beta, -30, 30)))
        step = np.linalg.solve((x1 * (weight * p * (1 - p))[:, None]).T @ x1 + keep + 1e-9 * np.eye(len(beta)), x1.T @ (weight * (y - p)) - keep @ beta)
        beta += step * min(1.0, 4 / max(np.abs(step).max(), 1e-12))
        if np.abs(step).max() < 1e-8:
            break
    return tuple(beta[:-1].tolist()), float(beta[-1])


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", per_class: int = SAMPLE_PER_CLASS, folds: int = 5,
          held_fold: int = 0, text: str = "text", doc_id: str = "doc_id") -> Model:
    """Fit dictionaries, threshold and scale on a bounded sample of labelled documents outside the held-out fold.

    The sample is the ``per_class`` documents of each class with the least hashes; three quarters train the dictionaries,
    the rest calibrates. Null ids, labels other than 0 and 1 and texts that are missing teach nothing; of repeated
    labels the largest counts. Without documents of both classes every score is the share of the one there is.
    """
    open_ids = (labels.filter(F.col(doc_id).isNotNull() & F.col(label).isin(0, 1) & (crc_mod(F.col(doc_id), folds) != held_fold))
                .groupBy(doc_id).agg(F.max(label).cast("int").alias("_label")))
    labelled = {r["_label"]: r["count"] for r in open_ids.groupBy("_label").count().collect()}  # two classes
    order = F.xxhash64(doc_id, F.lit(17))
    sample = None
    for value in (0, 1):
        part = open_ids.filter(F.col("_label") == value).orderBy(order, doc_id).limit(per_class)
        sample = part if sample is None else sample.unionByName(part)
    chosen = docs.select(doc_id, text).join(F.broadcast(sample), doc_id).withColumn("_part", F.pmod(F.xxhash64(doc_id, F.lit(29)), F.lit(4)))

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash
        for batch in pieces_of(batches, text):
            out = []
            for value in batch.column(text).to_pylist():
                held = set(windows(value))
                if len(held) > SAMPLE_WORDS:
                    held = sorted(held, key=xxhash.xxh64_intdigest)[:SAMPLE_WORDS]
                out.append(b" ".join(sorted(held)))
            yield pa.RecordBatch.from_arrays([batch.column("_label"), pa.array(out, pa.binary())], ["label", "words"])

    rows = chosen.filter("_part > 0").select("_label", text).mapInArrow(words, "label int, words binary").toArrow()
    by_class: dict[int, list[set[bytes]]] = {0: [], 1: []}
    for value, held in sorted(zip(rows.column("label").to_pylist(), rows.column("words").to_pylist(), strict=True)):
        by_class[value].append(set(held.split()))
    by_class = {value: without_copies(documents) for value, documents in by_class.items()}  # a copied text is told once
    if not by_class[0] or not by_class[1]:
        return Model(b"", b"", constant=1.0 if by_class[1] else 0.0)
    counts: Counter = Counter()
    for held in by_class[0]:
        counts.update(held)
    spread = [w for n in range(8) for w in sorted(counts) if counts[w] > n]  # a word as often as it has documents, 8 times at most
    ordinary = _dictionary(spread, ORDINARY_BYTES, 24)
    toxic = _dictionary(toxic_samples(by_class[1], by_class[0]), TOXIC_BYTES, 16)
    model = Model(ordinary, toxic)

    def differences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces_of(batches, text):
            found = [np.bincount(np.clip(window_differences(v, model), 0, 31), minlength=32).tolist() for v in batch.column(text).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("_label"), pa.array(found, pa.list_(pa.int64()))], ["label", "found"])

    got = chosen.filter("_part = 0").select("_label", text).mapInArrow(differences, "label int, found array<long>").toArrow()
    y = np.array(got.column("label").to_pylist(), dtype=np.float64)
    counts_of = np.array(got.column("found").to_pylist(), dtype=np.int64).reshape(-1, 32)
    if not len(y) or y.min() == y.max():
        return Model(b"", b"", constant=float(y.mean()) if len(y) else 0.0)
    best = np.where(counts_of.any(axis=1), 31 - (counts_of[:, ::-1] > 0).argmax(axis=1), 0)
    threshold = next((t for t in range(2, 32) if (best[y == 0] >= t).mean() <= MAX_FALSE), 31)
    x = np.array([features(np.repeat(np.arange(32), c), threshold) for c in counts_of])
    weights, bias = _logistic(x, y, labelled.get(1, 0) / sum(labelled.values()))
    return Model(ordinary, toxic, threshold, weights, bias)


def toxicity(docs: DataFrame, model: Model, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, score (0 to 1), predicted (1 from 0.5 on), best_difference and toxic_windows of every whole text.

    Null and empty texts have no windows and score by the bias. A null doc_id and repeated rows keep their rows; only
    doc_id and text are read; an empty table gives an empty result.
    """
    schema = T.StructType([*fields(docs, doc_id), T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType()),
                           T.StructField("best_difference", T.LongType()), T.StructField("toxic_windows", T.LongType())])
    arrow = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces_of(batches, text):
            out: list[list] = [[], [], [], []]
            for value in batch.column(text).to_pylist():
                found = window_differences(value, model) if model.constant is None else np.zeros(0, dtype=np.int64)
                x = np.dot(features(found, model.threshold), model.weights) + model.bias
                p = model.constant if model.constant is not None else float(1 / (1 + np.exp(-np.clip(x, -35, 35))))
                row = (p, int(p >= 0.5), int(found.max(initial=0)), int((found >= model.threshold).sum()))
                for column, v in zip(out, row, strict=True):
                    column.append(v)
            yield batch_of(arrow, {doc_id: batch.column(doc_id), **dict(zip(arrow.names[1:], out, strict=True))})

    return docs.select(doc_id, text).mapInArrow(run, schema)
