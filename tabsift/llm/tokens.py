"""Token ids of whole texts by the tokenizers library, encoded word by word with a memo per worker.

The vocabulary's normaliser and splitter never look across white space, so the ids of a text are the ids of its
white-space-separated chunks in turn. A batch of texts is split and numbered by Arrow, so Python sees each
different chunk of a batch once; each worker keeps the ids of chunks it has met (as little-endian 32-bit bytes), up to
``MEMO_CHUNKS`` of them. The memo only saves time.
"""

from __future__ import annotations

import functools
import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: The end id that follows every document.
END_ID = 2
#: Chunks kept by a worker before it starts afresh; longer chunks than MEMO_BYTES are encoded each time.
MEMO_CHUNKS, MEMO_BYTES = 500_000, 48

#: Signs cut from a word's end on their own: after a letter, a run of them is one token word.
_SIGNS = b".,!&%$*#|;:?\""
#: Words whose normal form is plain lower-casing: no character of theirs is changed by NFC.
_PLAIN = re.compile("[A-Za-zÀ-ÖØ-öø-ÿ]+")


def _byte_letters() -> dict[int, str]:
    """The byte-level alphabet: printable Latin-1 bytes stand for themselves, the others for characters from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}

#: Characters that NFC may join with an ASCII letter before lower-casing.
_JOINING = re.compile("[̀-ͯ]")


class WordIds(dict):
    """chunk (bytes) → ids as little-endian uint32 bytes."""

    def __init__(self, path: str):
        super().__init__()
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.letters = _byte_letters()

    def whole(self, text: str) -> bytes:
        ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        return np.asarray(ids, dtype="<u4").tobytes()

    def __missing__(self, chunk: bytes) -> bytes:
        if len(chunk) > MEMO_BYTES:
            return self.whole(chunk.decode())
        ids = self._encoded(chunk)
        if len(self) >= MEMO_CHUNKS:
            self.clear()
        self[chunk] = ids
        return ids

    def _encoded(self, chunk: bytes) -> bytes:
        if chunk.isalpha():  # ASCII letters are their own byte-level units
            return self._one(chunk.lower().decode())
        core = chunk.rstrip(_SIGNS)
        if len(core) < len(chunk) and core[-1:].isalpha():
            return self[core] + self[chunk[len(core):]]
        text = chunk.decode()
        if _PLAIN.fullmatch(text):
            return self._one(text.lower().encode().decode("latin-1").translate(self.letters))
        return self.whole(text)

    def _one(self, units: str) -> bytes:
        """Ids of one token word, given as byte-level units: the vocabulary's model alone decides."""
        return b"".join([t.id.to_bytes(4, "little") for t in self.model.tokenize(units)])

    def text(self, text: str | None, end_id: int = END_ID) -> bytes:
        """All ids of a text (null: none) and the end id."""
        end = end_id.to_bytes(4, "little")
        if not text:
            return end
        raw = text.encode()
        if b"<|" not in raw and not _JOINING.search(text):
            raw = raw.lower()  # ASCII letters only, which the vocabulary lower-cases anyhow
        return b"".join(map(self.__getitem__, raw.split())) + end


    def texts(self, column: pa.Array, end_id: int = END_ID) -> list[np.ndarray]:
        """The ids of every text of a string column (null: none), each with its end id."""
        column = pc.fill_null(column, "")
        if not len(column):
            return []
        odd = pc.or_(pc.match_substring(column, "<|"), pc.match_substring_regex(column, "[\\x{0300}-\\x{036f}]"))
        if pc.any(odd).as_py():  # ASCII letters cannot be lower-cased beforehand: text by text
            return [np.frombuffer(self.text(t, end_id), "<u4") for t in column.to_pylist()]
        lists = pc.ascii_split_whitespace(pc.ascii_lower(column))
        per_text = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
        numbered = lists.flatten().cast(pa.binary()).dictionary_encode()
        chunks = [self[c] for c in numbered.dictionary.to_pylist()] + [end_id.to_bytes(4, "little")]
        # places fit 32 bits: Arrow's strings of one column do
        sizes = np.fromiter(map(len, chunks), dtype=np.int32, count=len(chunks)) // 4
        starts, table = np.cumsum(sizes, dtype=np.int32) - sizes, np.frombuffer(b"".join(chunks), "<u4")
        # the chunks of all texts in a row, the end after each text's last
        ends = np.cumsum(per_text + 1) - 1
        row = np.full(len(numbered) + len(column), len(chunks) - 1, dtype=np.int32)
        inner = np.ones(len(row), dtype=bool)
        inner[ends] = False
        row[inner] = numbered.indices.to_numpy(zero_copy_only=False)
        count = sizes[row]
        upto = np.cumsum(count, dtype=np.int32)
        place = np.repeat(starts[row] - (upto - count), count)
        place += np.arange(upto[-1], dtype=np.int32)
        flat = table[place]
        return np.split(flat, upto[ends][:-1])


@functools.lru_cache(maxsize=2)
def word_ids(path: str) -> WordIds:
    """One memo per worker process and vocabulary."""
    return WordIds(path)


def vocabulary_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers
    return public_tokenizers.path(name)
