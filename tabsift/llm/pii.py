"""Personal data by a linear-chain conditional random field over word shapes, beside four exact patterns.

The model is trained on the small labelled table of ``pii_table`` and is a few thousand numbers. A word (run without
ASCII white space) is known by its shape alone: kinds of characters, first and last character, lengths; the shapes of its
neighbours count too. Texts are measured as arrays of code points, so no Python runs per word. Decoding is Viterbi in
numpy over many runs of words at once. It is exact: words that no span on a best path could hold (by the leads of "no
data" over them and the range of the transitions) are left out, and the chain falls into independent short runs.
"""

from __future__ import annotations

import functools
import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import arrow_schema, batch_of, fields, pieces_of
from .pii_table import KINDS, labelled_table

#: The exact patterns (fixed), leftmost and non-overlapping for each kind.
#: email [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+ and ip [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+) are found from their @ and
#: from whole chains of numbers, so that no run is read twice; the others are read as they stand.
LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
NUMBERS = re.compile(r"[0-9]++(?:\.[0-9]++)*+")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
BASE_KINDS = ("email", "ip", "card", "phone")

#: Training: steps, step size and weight decay.
STEPS, RATE, DECAY = 250, 0.15, 1e-4
LABELS = 1 + 2 * len(KINDS)  # 0: none; 1 + 2k begins kind k; 2 + 2k continues it
_EDGES_DIGITS = (0, 1, 2, 3, 4, 6, 8, 12, 19)
_EDGES_LENGTH = (1, 2, 3, 5, 8, 12, 16, 20, 39)


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost non-overlapping addresses: each @ with the whole run before it (behind the last address) and its domain."""
    low, at = 0, text.find("@")
    while at >= 0:
        start = low + len(text[low:at].rstrip(LOCAL))
        domain = DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            yield start, domain.end()
        low = domain.end() if domain else at + 1
        at = text.find("@", low)


def addresses(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost non-overlapping runs of four numbers joined by dots, each at most 255: a chain is cut into fours from its start."""
    for chain in NUMBERS.finditer(text):
        if chain.group().count(".") < 3:
            continue
        numbers, at = chain.group().split("."), chain.start()
        for i in range(0, len(numbers) - 3, 4):
            four = numbers[i:i + 4]
            end = at + sum(map(len, four)) + 3
            if all(len(n := v.lstrip("0")) <= 3 and int(n or "0") <= 255 for v in four):
                yield at, end
            at = end + 1


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """The spans of the exact patterns, by kind as listed, then by start."""
    out = [("email", *span) for span in emails(text)]
    if "." in text:
        out += [("ip", *span) for span in addresses(text)]
    for m in CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", *m.span()))
    if "+" in text:
        out += [("phone", *m.span()) for m in PHONE.finditer(text) if 9 <= sum(c.isdigit() for c in m.group()) <= 15]
    return out


def _classes() -> np.ndarray:
    """Kind of character for the code points under 128: 0 lower case, 1 upper case, 2 digit, 3 to 13 a sign each, 14 other signs, 16 white space."""
    table = np.full(129, 14, dtype=np.uint8)
    for c in range(128):
        ch = chr(c)
        if "a" <= ch <= "z":
            table[c] = 0
        elif "A" <= ch <= "Z":
            table[c] = 1
        elif "0" <= ch <= "9":
            table[c] = 2
        elif ch in "@.-_+()=:\"/":
            table[c] = 3 + "@.-_+()=:\"/".index(ch)
        elif c == 32 or 9 <= c <= 13:
            table[c] = 16
    table[128] = 15  # everything beyond ASCII
    return table


CLASSES = _classes()


@dataclass
class Words:
    """The words of a text: start and end code points, and shape signatures."""

    starts: np.ndarray
    ends: np.ndarray
    shapes: np.ndarray


def shaped_words(text: str) -> Words:
    kinds = CLASSES[np.minimum(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4"), 128)]
    inside = np.zeros(len(kinds) + 2, dtype=bool)
    inside[1:-1] = kinds != 16
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[::2], edges[1::2]
    if not len(starts):
        return Words(starts, ends, np.zeros(0, dtype=np.int64))
    bits = np.left_shift(np.uint32(1), kinds.astype(np.uint32))
    bits[kinds == 16] = 0
    present = np.bitwise_or.reduceat(bits, starts).astype(np.int64)
    digits = np.add.reduceat((kinds == 2).astype(np.int32), starts)
    dots = np.minimum(np.add.reduceat((kinds == 4).astype(np.int32), starts), 3)
    shapes = (present | kinds[starts].astype(np.int64) << 16 | kinds[ends - 1].astype(np.int64) << 20
              | np.searchsorted(_EDGES_DIGITS, digits).astype(np.int64) << 24
              | np.searchsorted(_EDGES_LENGTH, ends - starts).astype(np.int64) << 28 | dots.astype(np.int64) << 32)
    return Words(starts, ends, shapes)


WIDTH = 16 + 16 + 16 + 10 + 10 + 4


def shape_features(shapes: np.ndarray) -> np.ndarray:
    """One row of zeros and ones per shape signature."""
    out = np.zeros((len(shapes), WIDTH), dtype=np.float64)
    out[:, :16] = (shapes[:, None] >> np.arange(16)) & 1
    row = np.arange(len(shapes))
    for at, shift, mask in ((16, 16, 15), (32, 20, 15), (48, 24, 15), (58, 28, 15), (68, 32, 3)):
        out[row, at + ((shapes >> shift) & mask)] = 1
    return out


@dataclass(frozen=True)
class Model:
    """Weights of a word's own, previous and next shape; transitions; first and last label scores."""

    weights: np.ndarray  # 3 x WIDTH x LABELS
    transitions: np.ndarray
    first: np.ndarray
    last: np.ndarray


def _labels(words: Words, spans: list[tuple[str, int, int]]) -> np.ndarray:
    y = np.zeros(len(words.starts), dtype=np.int64)
    for kind, a, b in spans:
        begun = False
        for i in np.flatnonzero((words.starts < b) & (words.ends > a)):
            y[i] = 1 + 2 * KINDS.index(kind) + begun
            begun = True
    return y


def forbidden() -> np.ndarray:
    """Transitions that cannot be: a kind continued that was not begun."""
    bad = np.zeros((LABELS, LABELS), dtype=bool)
    for k in range(len(KINDS)):
        bad[:, 2 + 2 * k] = True
        bad[[1 + 2 * k, 2 + 2 * k], 2 + 2 * k] = False
    return bad


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)


@functools.lru_cache(maxsize=1)
def trained() -> Model:
    """Maximum likelihood on the labelled table by forward-backward and Adam, sentences padded to one array."""
    rows = [(shaped_words(text), spans) for text, spans in labelled_table()]
    n, longest = len(rows), max(len(w.starts) for w, _ in rows)
    shapes = np.zeros((n, longest), dtype=np.int64)
    y = np.zeros((n, longest), dtype=np.int64)
    live = np.zeros((n, longest), dtype=bool)
    for i, (w, spans) in enumerate(rows):
        m = len(w.starts)
        shapes[i, :m], y[i, :m], live[i, :m] = w.shapes, _labels(w, spans), True
    known, back = np.unique(shapes, return_inverse=True)
    back = back.reshape(shapes.shape)
    feats = shape_features(known)
    lengths = live.sum(axis=1)
    row = np.arange(n)
    bad = forbidden()
    weights, trans = np.zeros((3, WIDTH, LABELS)), np.zeros((LABELS, LABELS))
    first, last = np.zeros(LABELS), np.zeros(LABELS)
    params = [weights, trans, first, last]
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
    for step in range(1, STEPS + 1):
        tables = [feats @ weights[o] for o in range(3)]
        emit = tables[0][back]
        emit[:, 1:] += tables[1][back[:, :-1]] * live[:, 1:, None]
        emit[:, :-1] += tables[2][back[:, 1:]] * live[:, 1:, None]
        t = np.where(bad, -30.0, trans)
        alpha = np.zeros((n, longest, LABELS))
        beta = np.zeros((n, longest, LABELS))
        alpha[:, 0] = emit[:, 0] + first
        for i in range(1, longest):
            moved = _lse(alpha[:, i - 1, :, None] + t, 1) + emit[:, i]
            alpha[:, i] = np.where(live[:, i, None], moved, alpha[:, i - 1])
        total = _lse(alpha[:, -1] + last, 1)
        beta[row, lengths - 1] = last
        for i in range(longest - 2, -1, -1):
            moved = _lse(t + (emit[:, i + 1] + beta[:, i + 1])[:, None, :], 2)
            beta[:, i] = np.where(live[:, i + 1, None], moved, np.where((lengths - 1 == i)[:, None], last, 0.0))
        node = np.exp(alpha + beta - total[:, None, None]) * live[..., None]
        delta = -node
        delta[row[:, None].repeat(longest, 1)[live], np.arange(longest)[None].repeat(n, 0)[live], y[live]] += 1
        grads = [np.zeros_like(weights), np.zeros_like(trans), None, None]
        for o, (mine, other) in enumerate(((slice(None), slice(None)), (slice(1, None), slice(None, -1)), (slice(None, -1), slice(1, None)))):
            pushed = np.zeros((len(known), LABELS))
            mask = live[:, 1:] if o else live
            np.add.at(pushed, back[:, other][mask], delta[:, mine][mask])
            grads[0][o] = feats.T @ pushed
        for i in range(1, longest):
            on = live[:, i]
            if on.any():
                edge = np.exp(alpha[on, i - 1, :, None] + t + (emit[on, i] + beta[on, i])[:, None, :] - total[on, None, None])
                grads[1] -= edge.sum(axis=0)
                np.add.at(grads[1], (y[on, i - 1], y[on, i]), 1)
        grads[2] = delta[:, 0].sum(axis=0)
        end = -np.exp(alpha[:, -1] + last - total[:, None])
        end[row, y[row, lengths - 1]] += 1
        grads[3] = end.sum(axis=0)
        for p, g, (m, v) in zip(params, grads, moments, strict=True):
            g = g / n - DECAY * p
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            p += RATE * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.99 ** step)) + 1e-8)
    return Model(weights, np.where(bad, -1e4, trans), np.where(bad[0], -1e4, first), last)


def _run_viterbi(emit: np.ndarray, live: np.ndarray, t: np.ndarray, enter: np.ndarray, leave: np.ndarray) -> np.ndarray:
    """Best labels of many runs at once: emit is runs x steps x LABELS; enter and leave are the scores at either end."""
    runs, steps, _ = emit.shape
    score = emit[:, 0] + enter
    back = np.zeros((runs, steps, LABELS), dtype=np.int8)
    for i in range(1, steps):
        moved = score[:, :, None] + t
        best = moved.argmax(axis=1)
        on = live[:, i, None]
        back[:, i] = np.where(on, best, np.arange(LABELS))
        score = np.where(on, np.take_along_axis(moved, best[:, None], 1)[:, 0] + emit[:, i], score)
    out = np.zeros((runs, steps), dtype=np.int64)
    out[:, -1] = (score + leave).argmax(axis=1)
    for i in range(steps - 1, 0, -1):
        out[:, i - 1] = np.take_along_axis(back[:, i], out[:, i, None], 1)[:, 0]
    return out


def decode(docs: list[Words], model: Model) -> list[np.ndarray]:
    """The best label sequence of every text."""
    sizes = [len(w.starts) for w in docs]
    n = sum(sizes)
    if not n:
        return [np.zeros(0, dtype=np.int64) for _ in docs]
    known, back = np.unique(np.concatenate([w.shapes for w in docs]), return_inverse=True)
    tables = [shape_features(known) @ model.weights[o] for o in range(3)]
    ends = np.cumsum(sizes)
    held = np.array(sizes) > 0
    opens, closes = np.zeros(n, dtype=bool), np.zeros(n, dtype=bool)
    opens[(ends - sizes)[held]], closes[(ends - 1)[held]] = True, True
    emit = tables[0][back]
    emit[1:] += np.where(opens[1:, None], 0.0, tables[1][back[:-1]])
    emit[:-1] += np.where(closes[:-1, None], 0.0, tables[2][back[1:]])
    t = model.transitions
    # Turning a whole marked span into 0 changes each transition by ``swing`` at most, so a span can only be on the best
    # path if the leads of 0 over its words, less a swing each, add up to a swing at most. Words in no such span are 0.
    allowed = t[t > -1e3]
    least = min(t[:, 0].min(), t[0][t[0] > -1e3].min(), model.first[0], model.last[0])
    swing = max(allowed.max(), model.first.max(), model.last.max()) - least
    gain = swing - (emit[:, 0] - emit[:, 1:].max(axis=1))
    wall = np.cumsum(opens) * 1e6  # no span crosses texts
    before = np.cumsum(gain) - wall
    left = before - gain - np.minimum.accumulate(before - gain)
    after = np.cumsum(gain[::-1]) - (np.cumsum(closes[::-1]) * 1e6)
    right = (after - gain[::-1] - np.minimum.accumulate(after - gain[::-1]))[::-1]
    safe = left + gain + right < -swing
    labels = np.zeros(n, dtype=np.int64)
    open_words = np.flatnonzero(~safe)
    if len(open_words):
        cut = np.r_[True, (np.diff(open_words) > 1) | closes[open_words[:-1]]]
        starts = open_words[cut]
        lengths = np.diff(np.r_[np.flatnonzero(cut), len(open_words)])
        order = np.argsort(lengths, kind="stable")
        at = 0
        while at < len(order):
            size = lengths[order[at]]
            upto = at + int(np.searchsorted(lengths[order[at:]], 2 * size, side="right"))
            upto = min(upto, at + max(1, (1 << 19) // int(lengths[order[upto - 1]])))
            group = order[at:upto]
            steps = int(lengths[group].max())
            index = starts[group][:, None] + np.arange(steps)
            live = np.arange(steps) < lengths[group][:, None]
            index = np.where(live, index, starts[group][:, None])
            last = starts[group] + lengths[group] - 1
            enter = np.where(opens[starts[group]][:, None], model.first, t[0])
            leave = np.where(closes[last][:, None], model.last, t[:, 0])
            found = _run_viterbi(emit[index], live, t, enter, leave)
            labels[index[live]] = found[live]
            at = upto
    return np.split(labels, ends[:-1])


def model_spans(text: str, words: Words, labels: np.ndarray) -> list[tuple[str, int, int]]:
    """Labelled words as spans, without the quotes, brackets and stops around them."""
    out: list[tuple[str, int, int]] = []
    for i in np.flatnonzero(labels):
        kind, begins = KINDS[(labels[i] - 1) // 2], labels[i] % 2 == 1
        if begins or not out:
            out.append((kind, int(words.starts[i]), int(words.ends[i])))
        else:
            out[-1] = (out[-1][0], out[-1][1], int(words.ends[i]))
    trimmed = []
    for kind, a, b in out:
        while b > a and text[b - 1] in ".,;:!?\"')>]":
            b -= 1
        while a < b and text[a] in "\"'<[":
            a += 1
        if b > a:
            trimmed.append((kind, a, b))
    return trimmed


def all_spans(texts: list[str | None], model: Model | None = None) -> list[tuple[list[tuple], list[tuple]]]:
    """(base spans, all spans) of whole texts; model spans that touch a base span are left to the pattern."""
    model = model or trained()
    texts = [t or "" for t in texts]
    words = [shaped_words(t) for t in texts]
    out = []
    for text, held, labels in zip(texts, words, decode(words, model), strict=True):
        base = base_spans(text)
        added = []
        if labels.any():
            added = [s for s in model_spans(text, held, labels) if not any(s[1] < b and a < s[2] for _, a, b in base)]
        order = {k: i for i, k in enumerate(KINDS)}
        out.append((base, sorted({*base, *added}, key=lambda s: (order[s[0]], s[1], s[2]))))
    return out


def spans(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, base and spans (arrays of kind, start, end in code points) of every whole text.

    Null and empty texts have none. Base spans are those of the exact patterns; the model's come beside them. A null
    doc_id and repeated rows keep their rows; only doc_id and text are read; an empty table gives an empty result.
    """
    one = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
    schema = T.StructType([*fields(docs, doc_id), T.StructField("base", T.ArrayType(one)), T.StructField("spans", T.ArrayType(one))])
    arrow, model = arrow_schema(schema), trained()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces_of(batches, text, 2 << 20):
            found = all_spans(batch.column(text).to_pylist(), model)
            rows = [[[dict(zip(("kind", "start", "end"), s, strict=True)) for s in part] for part in pair] for pair in found]
            yield batch_of(arrow, {doc_id: batch.column(doc_id), "base": [r[0] for r in rows], "spans": [r[1] for r in rows]})

    return docs.select(doc_id, text).mapInArrow(run, schema)


def digest(parts: list[tuple]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in parts)


def reports(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256 and spans (kind:start:end, comma-joined) of every whole text."""
    schema = T.StructType([*fields(docs, doc_id), *(T.StructField(f"n_{k}", T.LongType()) for k in BASE_KINDS),
                           T.StructField("base_sha256", T.StringType()), T.StructField("spans", T.StringType())])
    arrow, model = arrow_schema(schema), trained()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces_of(batches, text, 2 << 20):
            found = all_spans(batch.column(text).to_pylist(), model)
            columns = {f"n_{k}": [sum(s[0] == k for s in base) for base, _ in found] for k in BASE_KINDS}
            yield batch_of(arrow, {doc_id: batch.column(doc_id), **columns,
                                   "base_sha256": [hashlib.sha256(digest(base).encode()).hexdigest() for base, _ in found],
                                   "spans": [digest(every) for _, every in found]})

    return docs.select(doc_id, text).mapInArrow(run, schema)


def masked(text: str, found: list[tuple]) -> str:
    """``text`` with every span, or run of overlapping spans, replaced by its (first) kind in brackets."""
    out, at = [], 0
    for kind, a, b in sorted(found, key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += [text[at:a], f"[{kind.upper()}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def redacted(docs: DataFrame, text: str = "text", length: str | None = "n_chars") -> DataFrame:
    """``docs`` with personal data in ``text`` replaced, all other columns as they are (``length``, where there is one, follows the text)."""
    arrow, model = arrow_schema(docs.schema), trained()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces_of(batches, text, 2 << 20):
            texts = batch.column(text).to_pylist()
            clean = [t if t is None or not every else masked(t, every) for t, (_, every) in zip(texts, all_spans(texts, model), strict=True)]
            columns = {f.name: batch.column(f.name) for f in arrow}
            if length in columns:
                held = batch.column(length).to_pylist()
                columns[length] = pa.array([n if c is t else len(c) for n, c, t in zip(held, clean, texts, strict=True)], arrow.field(length).type)
            columns[text] = pa.array(clean, arrow.field(text).type)
            yield pa.RecordBatch.from_arrays([columns[f.name].cast(f.type) for f in arrow], schema=arrow)

    return docs.mapInArrow(run, docs.schema)
