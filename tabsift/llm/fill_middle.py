"""Fill-in-middle: a document is cut at two places and its parts change order, marked by three sentinels.

A wavelet matrix over the character classes of a batch's UTF-8 bytes finds the places: ranks of the classes that begin
(or end) a unit add up to the number of units before a byte, and bisection on these counts gives the byte of a cut. Units
are characters (code points), words, tokens (words, signs and line feeds) or lines; the same ranks give code points.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_schema, fields, pieces_of
from .wavelet import WaveletMatrix

#: Classes of bytes: inside a character, blank, line feed, sign, first and further characters of a word.
INSIDE, BLANK, NEWLINE, SIGN, FIRST, FURTHER = range(6)
STARTS = (BLANK, NEWLINE, SIGN, FIRST, FURTHER)
#: The classes counted for each unit, and whether they end the unit (else they begin it).
UNITS = {"char": (STARTS, False), "word": ((FIRST,), False), "token": ((NEWLINE, SIGN, FIRST), False), "line": ((NEWLINE,), True)}
SENTINELS = ("<P>", "<S>", "<M>")


def _kinds() -> np.ndarray:
    """The class of each byte, every character of a word as a further one."""
    kind = np.full(256, SIGN, dtype=np.uint8)
    kind[0x80:0xC0] = INSIDE
    kind[0xC0:] = FURTHER  # any character beyond ASCII belongs to a word
    for b in range(128):
        if chr(b).isalnum() or b == ord("_"):
            kind[b] = FURTHER
    kind[[9, 11, 12, 13, 32]] = BLANK
    kind[10] = NEWLINE
    return kind


KIND = _kinds()


def character_classes(raw: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The class of every byte of joined texts, of which ``starts`` are the first bytes."""
    kind = KIND[raw]
    worded = (kind == FURTHER) | (kind == INSIDE)
    after = np.r_[False, worded[:-1]]
    after[starts[starts < len(raw)]] = False
    kind[(kind == FURTHER) & ~after] = FIRST
    return kind


class Cuts:
    """Unit counts and cut places of the texts in one buffer: text i is ``raw[bounds[i]:bounds[i + 1]]``."""

    def __init__(self, raw: np.ndarray, bounds: np.ndarray, unit: str = "char"):
        self.low, self.high = bounds[:-1], bounds[1:]
        self.classes, self.ends = UNITS[unit]
        self.matrix = WaveletMatrix(character_classes(raw, self.low), 3)
        self.before = self.matrix.count(self.classes, self.low)
        marks = self.matrix.count(self.classes, self.high) - self.before
        if self.ends:  # what follows the last line feed is a unit too
            last = self.high > self.low
            last[last] = raw[self.high[last] - 1] != 10
            marks = marks + last
        self.units = marks

    def after(self, units: np.ndarray) -> np.ndarray:
        """The byte behind the first ``units`` units of each text."""
        if self.ends:
            place = self.matrix.bisect(self.classes, self.low, self.high, self.before + units - 1)
            return np.where(units == 0, self.low, np.minimum(place + 1, self.high))
        place = self.matrix.bisect(self.classes, self.low, self.high, self.before + units)
        return np.where(units == 0, self.low, place)

    def characters(self, at: np.ndarray) -> np.ndarray:
        """Code points of each text before the byte ``at``."""
        return self.matrix.count(STARTS, at) - self.matrix.count(STARTS, self.low)


def draws(seed: str, doc_id) -> list[int]:
    """The first four 32-bit numbers of sha256(``seed:doc_id``); a null id counts as the word null."""
    said = hashlib.sha256(f"{seed}:{'null' if doc_id is None else doc_id}".encode()).digest()
    return [int.from_bytes(said[i:i + 4], "big") for i in (0, 4, 8, 12)]


def fill_in_middle(docs: DataFrame, unit: str = "char", seed: str = "1", transformed_percent: int = 90, spm_percent: int = 20,
                   sentinels: tuple[str, str, str] = SENTINELS, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, n (units), form (plain, psm or spm), prefix_chars and middle_chars (code points; null if plain), output.

    The cuts lie after h1 % (n + 1) and h2 % (n + 1) units, the smaller first. psm is prefix, suffix, middle; spm is
    suffix, prefix, middle, each part behind its sentinel. Plain stay empty and null texts, texts that hold a sentinel,
    and those with h3 % 100 from ``transformed_percent`` on. A word or token unit reaches to the next one's start; what
    precedes the first belongs to it. Every row gives one row, repeated ones the same; a null doc_id draws like the word
    null. Columns other than doc_id and text are not read; an empty table gives an empty result. A task holds a few
    megabytes of text at a time, or one text.
    """
    if unit not in UNITS:
        raise ValueError(f"unit {unit!r}: one of {sorted(UNITS)}")
    schema = T.StructType([*fields(docs, doc_id), T.StructField("n", T.LongType()), T.StructField("form", T.StringType()),
                           T.StructField("prefix_chars", T.LongType()), T.StructField("middle_chars", T.LongType()),
                           T.StructField("output", T.StringType())])
    arrow = arrow_schema(schema)
    marks = [s.encode() for s in sentinels]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces_of(batches, text):
            column = pc.fill_null(batch.column(text), "").cast(pa.large_binary())
            _, places, data = column.buffers()
            bounds = np.frombuffer(places, np.int64)[column.offset:column.offset + len(column) + 1]
            raw = np.frombuffer(data, np.uint8)[bounds[0]:bounds[-1]] if data is not None else np.zeros(0, np.uint8)
            bounds = bounds - bounds[0]
            cuts = Cuts(raw, bounds, unit)
            h = np.array([draws(seed, v) for v in batch.column(doc_id).to_pylist()], dtype=np.int64).reshape(-1, 4)
            held = np.zeros(len(column), dtype=bool)
            for s in marks:
                held |= pc.match_substring(column, s).to_numpy(zero_copy_only=False)
            plain = (bounds[1:] == bounds[:-1]) | held | (h[:, 2] % 100 >= transformed_percent)
            spm = h[:, 3] % 100 < spm_percent
            one, two = h[:, 0] % (cuts.units + 1), h[:, 1] % (cuts.units + 1)
            first, second = cuts.after(np.minimum(one, two)), cuts.after(np.maximum(one, two))
            prefix = cuts.characters(first)
            middle = cuts.characters(second) - prefix
            whole, out = raw.tobytes(), []
            for a, p, q, b, stays, swapped in zip(bounds[:-1].tolist(), first.tolist(), second.tolist(), bounds[1:].tolist(),
                                                  plain.tolist(), spm.tolist(), strict=True):
                if stays:
                    out.append(whole[a:b])
                elif swapped:
                    out.append(b"".join((marks[1], whole[q:b], marks[0], whole[a:p], marks[2], whole[p:q])))
                else:
                    out.append(b"".join((marks[0], whole[a:p], marks[1], whole[q:b], marks[2], whole[p:q])))
            form = np.where(plain, "plain", np.where(spm, "spm", "psm"))
            yield pa.RecordBatch.from_arrays(
                [batch.column(doc_id).cast(arrow.field(0).type), pa.array(cuts.units), pa.array(form, type=pa.string()),
                 pa.array(prefix, mask=plain), pa.array(middle, mask=plain), pa.array(out, type=pa.binary()).cast(pa.string())],
                schema=arrow)

    return docs.select(doc_id, text).mapInArrow(run, schema)


def restored(form, output, sentinels: tuple[str, str, str] = SENTINELS):
    """The exact text as a column, rebuilt from the columns ``form`` and ``output`` alone."""
    import re
    parts = F.split(output, "|".join(re.escape(s) for s in sentinels), -1)  # the first part, before any sentinel, is empty
    return (F.when(form == "plain", output).when(form == "psm", F.concat(parts[1], parts[3], parts[2]))
            .otherwise(F.concat(parts[2], parts[3], parts[1])))
