"""Quality rules with adaptive thresholds from mergeable quantile sketches per language and source.

One pass measures every whole text. A KLL sketch per language, source and measure is combined before the shuffle; sketches
of small groups are replaced by the merged sketch of their language, and that of a small language by the merged sketch
of all. Every tail has a fence where its own decline, carried on, would leave ``TAIL_SHARE`` of the documents beyond: the
quantiles of the outer quarter give the scale, the widest of them counts, so a heavy tail moves its fence out. Where the tail
has a gap that stands out before that (wide against its other steps and against its distance from the median), the fence
lies in the gap instead. The fences are joined back to the measures as a small table.
"""

from __future__ import annotations

from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_schema, batch_of, checked_broadcast, pieces_of, written

SYMBOLS = b"#*$%&|<>"
WINDOW = 8
#: The fixed base rule: fewest words, and the highest percentage of words in repeated windows.
MIN_WORDS, MAX_REPEAT_PERCENT = 20, 30
#: Measures and the sides that have a fence (low, high).
MEASURES = {
    "word_length": (True, True),   # mean code points of a word
    "symbols": (False, True),      # symbols per word
    "dup_lines": (False, True),    # repeated lines among lines with a word
    "repeats": (False, True),      # words in repeated windows per word
    "echoes": (False, True),       # words equal to the one before per word
    "capitals": (False, True),     # ASCII capitals per code point of the words
}
#: A gap stands out from so many times the tail's median step and its own distance from the median on; least gap at all.
GAP_STEPS, GAP_REACH, LEAST_GAP = 8.0, 1.0, 0.01
#: Ranks of the upper quarter at which a sketch is read (mirrored for the lower quarter).
TAIL = (*(0.75 + i / 400 for i in range(100)), 0.999, 0.9995, 0.9999, 1.0)
#: The share of documents that a fence is laid to leave beyond it, and the ranks from whose distance a tail's scale is read.
TAIL_SHARE, SCALE_RANKS = 1e-4, (0.95, 0.99, 0.999)
#: Documents under which a group uses the wider group's sketch. A gap must be wider by (1 + FEW / documents): few steps prove little.
MIN_GROUP, FEW = 200, 50
#: Sketch size, and rows of the fence table up to which it is broadcast.
SKETCH_K, MAX_BROADCAST_ROWS = 400, 50_000

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_capitals", "n_echoes")


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words that lie in a window of ``window`` words found twice or more in the text."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    number: dict[bytes, int] = {}
    ids = np.array([number.setdefault(w, len(number)) for w in words], dtype=np.uint64)
    with np.errstate(over="ignore"):
        mixed = (ids + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
        mixed *= np.uint64(0xBF58476D1CE4E5B9)
        mixed ^= mixed >> np.uint64(32)
        key = np.zeros(n, dtype=np.uint64)
        for i in range(window):  # a 64-bit hash of each window
            key = key * np.uint64(0x94D049BB133111EB) + mixed[i:i + n]
    ranked = np.sort(key)
    twice = ranked[1:][ranked[1:] == ranked[:-1]]
    if not len(twice):
        return 0
    hit = np.isin(key, twice).astype(np.int64)
    edge = np.zeros(len(words) + 1, dtype=np.int64)
    edge[:n] += hit
    edge[window:window + n] -= hit
    return int((np.cumsum(edge) > 0).sum())


def counts_of(text: str | None) -> tuple[int, ...]:
    """The ``COUNTS`` of a whole text; null and empty texts have none of anything."""
    raw = (text or "").encode()
    words = raw.split()
    lines = [line for line in raw.split(b"\n") if line and not line.isspace()] if words else []
    return (len(words), len(text or "") - sum(raw.count(c) for c in (b" ", b"\t", b"\n", b"\v", b"\f", b"\r")),
            sum(raw.count(SYMBOLS[i:i + 1]) for i in range(len(SYMBOLS))), len(lines) - len(set(lines)), repeated_words(words),
            len(lines), len(raw) - len(raw.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ")), sum(map(eq, words, words[1:])))


def measured(docs: DataFrame, keep: list[str], text: str = "text", name: str = "measured") -> DataFrame:
    """``keep`` columns of every row and the struct ``name`` of its counts."""
    schema = T.StructType([*(docs.schema[c] for c in keep), T.StructField(name, T.StructType([T.StructField(c, T.LongType()) for c in COUNTS]))])
    arrow = arrow_schema(schema)
    needed = list(dict.fromkeys([*keep, text]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces_of(batches, text):
            rows = [counts_of(v) for v in batch.column(text).to_pylist()]
            columns = [pa.array(c, pa.int64()) for c in zip(*rows, strict=True)]
            struct = pa.StructArray.from_arrays(columns, fields=list(arrow.field(name).type))
            yield pa.RecordBatch.from_arrays([*(batch.column(c).cast(arrow.field(c).type) for c in keep), struct], schema=arrow)

    return docs.select(*needed).mapInArrow(run, schema)


def measures(counts: str = "measured") -> dict:
    """The measures as columns over the struct ``counts``; null where a text has no words."""
    c = lambda n: F.col(f"{counts}.{n}")
    words, chars, lines = (F.when(c(n) > 0, c(n)) for n in ("n_words", "word_chars", "n_lines"))
    return {"word_length": c("word_chars") / words, "symbols": c("n_symbols") / words, "dup_lines": c("n_dup_lines") / lines,
            "repeats": c("n_repeat_words") / words, "echoes": c("n_echoes") / words, "capitals": c("n_capitals") / chars}


def base_failed(counts: str = "measured"):
    """The fixed base rule as a column over the struct ``counts``."""
    words, repeats = F.col(f"{counts}.n_words"), F.col(f"{counts}.n_repeat_words")
    return (words < MIN_WORDS) | (100 * repeats > MAX_REPEAT_PERCENT * words)


def gap_of(tail: np.ndarray, middle: float, n: float = np.inf) -> float | None:
    """The middle of the lowest gap between successive values of ``tail`` that stands out; None where none does."""
    steps = np.diff(tail)
    rising = np.sort(steps[steps > 0])
    typical = rising[(len(rising) - 1) // 2] if len(rising) > 1 else 0.0
    need = np.maximum(GAP_REACH * (tail[:-1] - middle), max(GAP_STEPS * typical, LEAST_GAP)) * (1 + FEW / max(n, 1.0))
    wide = np.flatnonzero(steps >= need)
    return float(tail[wide[0]] + tail[wide[0] + 1]) / 2 if len(wide) else None


def fence_of(tail: np.ndarray, middle: float, n: float = np.inf) -> float:
    """The high fence of a tail read at the ranks ``TAIL`` (falling tails come mirrored): its gap, or the decline carried on.

    Beyond the upper quartile the share of documents falls like exp(-(x − quartile) / scale), the scale by the distance to each
    of ``SCALE_RANKS``; the largest counts, ``LEAST_GAP`` at least.
    """
    first = 1 - TAIL[0]
    ranks = np.array(TAIL)
    scale = max(float(np.interp(r, ranks, tail) - tail[0]) / np.log(first / (1 - r)) for r in SCALE_RANKS)
    decline = float(tail[0]) + max(scale * np.log(first / TAIL_SHARE), LEAST_GAP)
    gap = gap_of(tail, middle, n)
    return decline if gap is None else min(gap, decline)


def fences(rows: DataFrame, lang: str = "lang", source: str = "source", counts: str = "measured") -> DataFrame:
    """group_lang, group_source, and a low and a high fence of each measure: one row per language and source.

    The sketches hold the documents that pass the base rule. A null fence rejects nothing: it stands where no document of the
    whole table has the measure.
    """
    names = list(MEASURES)
    own = (rows.select(F.col(lang).alias("group_lang"), F.col(source).alias("group_source"), *(F.when(~base_failed(counts), v).alias(k) for k, v in measures(counts).items()))
           .groupBy("group_lang", "group_source")
           .agg(F.count("word_length").alias("n"), *(F.kll_sketch_agg_double(k, F.lit(SKETCH_K)).alias(k) for k in names)))
    own = written(own, "quality-sketches")
    wide = lambda *keys: own.groupBy(*keys).agg(
        F.sum("n").alias("n"), *(F.kll_merge_agg_double(k, F.lit(SKETCH_K)).alias(k) for k in names))
    by_lang = wide("group_lang").select(F.col("group_lang").alias("l"), F.col("n").alias("n1"), *(F.col(k).alias(f"{k}1") for k in names))
    overall = wide().select(*(F.col(k).alias(f"{k}2") for k in names))  # one row
    table = (own.join(by_lang, F.col("group_lang").eqNullSafe(F.col("l"))).join(F.broadcast(overall)))
    ranks = F.array(*(F.lit(p) for p in TAIL), F.lit(0.5), *(F.lit(1 - p) for p in TAIL))
    read = []
    for k in names:
        sketch = F.when(F.col("n") >= MIN_GROUP, F.col(k)).when(F.col("n1") >= MIN_GROUP, F.col(f"{k}1")).otherwise(F.col(f"{k}2"))
        held = F.kll_sketch_get_n_double(sketch)
        read.append(F.when(held > 0, F.struct(F.kll_sketch_get_quantile_double(sketch, ranks).alias("q"), held.alias("n"))).alias(k))
    sides = [(k, side) for k, (low, high) in MEASURES.items() for side in ("low",) * low + ("high",) * high]
    schema = T.StructType([*(T.StructField(c, T.StringType()) for c in ("group_lang", "group_source")),
                           *(T.StructField(f"{k}_{side}", T.DoubleType()) for k, side in sides)])
    arrow, m = arrow_schema(schema), len(TAIL)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = {c: batch.column(c).to_pylist() for c in ("group_lang", "group_source")}
            for k, side in sides:
                tails = [None if v is None else (np.array(v["q"]), v["n"]) for v in batch.column(k).to_pylist()]
                columns[f"{k}_{side}"] = [None if v is None else fence_of(v[0][:m], v[0][m], v[1]) if side == "high"
                                          else -fence_of(-v[0][m + 1:], -v[0][m], v[1]) for v in tails]
            yield batch_of(arrow, columns)

    return written(table.select("group_lang", "group_source", *read).mapInArrow(cut, schema), "quality-fences")


def _judged(rows: DataFrame, fence_table: DataFrame, lang: str, source: str, counts: str) -> DataFrame:
    """``rows`` with base_failed and kept; groups are matched null-safely."""
    small = checked_broadcast(fence_table, fence_table.count(), MAX_BROADCAST_ROWS)
    fenced = [c for c in fence_table.columns if c not in ("group_lang", "group_source")]
    own = small.select(F.struct(*fenced).alias("_fences"), F.coalesce(F.col("group_lang"), F.lit("")).alias("_l"), F.col("group_lang").isNull().alias("_ln"),
                       F.coalesce(F.col("group_source"), F.lit("")).alias("_s"), F.col("group_source").isNull().alias("_sn"))
    joined = rows.join(own, (F.coalesce(F.col(lang), F.lit("")) == F.col("_l")) & (F.col(lang).isNull() == F.col("_ln"))
                       & (F.coalesce(F.col(source), F.lit("")) == F.col("_s")) & (F.col(source).isNull() == F.col("_sn")), "left")
    failed, inside = base_failed(counts), F.lit(True)
    for k, value in measures(counts).items():
        low, high = MEASURES[k]
        if low:
            inside = inside & F.coalesce(value >= F.col(f"_fences.{k}_low"), F.lit(True))
        if high:
            inside = inside & F.coalesce(value <= F.col(f"_fences.{k}_high"), F.lit(True))
    return joined.withColumn("_failed", failed).withColumn("_kept", ~failed & inside)


def verdicts(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", lang: str = "lang", source: str = "source") -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept of every row.

    A null or empty text has zero counts and fails the base rule. A null language or source is a group of its own; a null
    doc_id and repeated rows keep their rows. Other columns are not read; an empty table gives an empty result. Fences
    are fixed in a written table, so a recomputed task judges alike; a document on a fence is kept.
    """
    plain = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.col(lang).cast("string").alias("lang"), F.col(source).cast("string").alias("source"))
    rows = written(measured(plain, ["doc_id", "lang", "source"]), "quality-measures")
    judged = _judged(rows, fences(rows), "lang", "source", "measured")
    return judged.select(F.col("doc_id").alias(doc_id), *(F.col(f"measured.{n}").alias(n) for n in COUNTS[:5]),
                         F.col("_failed").alias("base_failed"), F.col("_kept").alias("kept"))


def kept_documents(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """The rows of ``docs`` that pass, with all their columns. Texts are measured twice rather than shuffled once."""
    plain = docs.select(F.col(text).alias("text"), F.col(lang).cast("string").alias("lang"), F.col(source).cast("string").alias("source"))
    rows = written(measured(plain, ["lang", "source"]), "quality-measures")
    name = "measured"
    while name in docs.columns:
        name += "_"
    judged = _judged(measured(docs, docs.columns, text, name), fences(rows), lang, source, name)
    return judged.filter("_kept").select(*docs.columns)
