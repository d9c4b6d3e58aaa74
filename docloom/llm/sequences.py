"""Packing of tokenised documents into training sequences of several lengths.

Documents are routed to tiers of context sizes. Each tier places its documents in
windows of its own size and fills what is left with shorter tiers' documents, the
largest that fits first, cutting one where none fits. Windows that are full need no
padding, whatever their tier; only the last window of a group (some megabytes of text) can
be partly filled.
"""

from __future__ import annotations

import array
import os
import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from docloom.llm import blocks as B
from docloom.llm import words as W

TIERS = (2048, 1024, 512, 256)
END_ID = 1
#: Tokens of one training step; windows are dealt to steps so that all hold as many.
STEP_TOKENS = 16 * 2048
#: Texts packed together in a task, in bytes.
GROUP_BYTES = 4 << 20
#: Texts encoded at a time.
ENCODED_BYTES = 1 << 20
CACHED_WORDS = 400_000
#: ASCII marks but the apostrophe, which starts tokens of its own.
MARKS = ~W.byte_class([c for c in range(0x21, 0x7F) if not chr(c).isalnum() and c != 0x27])
LETTERS = ~W.byte_class([*range(0x61, 0x7B)])
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20
#: Letters whose lower case and normal form are plain.
PLAIN = re.compile("[a-zA-Z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+")
_SHOWN = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
#: How byte-level vocabularies write the bytes that are not shown: from U+0100 on.
BYTE_LEVEL = {b: 0x100 + k for k, b in enumerate(b for b in range(256) if b not in _SHOWN)}

PIECE = (
    ("start", T.LongType()),
    ("length", T.LongType()),
    ("ids", T.BinaryType()),
    ("doc_tokens", T.LongType()),
    ("sequence_id", T.LongType()),
    ("offset", T.LongType()),
    ("tier", T.IntegerType()),
    ("step_id", T.LongType()),
)

Placed = list[tuple[int, int, int]]  # (document, start, length) in order


def _units(raw: W.Text) -> W.Words:
    """Words between white space; a run of ASCII marks that ends a word of letters is a
    unit of its own. No token of the vocabulary reaches across such a border."""
    words = W.split_words(raw)
    marks = MARKS[raw.data]
    last = np.maximum.accumulate(np.where(marks, -1, np.arange(len(raw.data))))[words.end - 1]
    letter = LETTERS[raw.data[last]] & (last >= words.start) & (last < words.end - 1)
    cut = np.flatnonzero(letter)
    start, end = np.insert(words.start, cut + 1, last[cut] + 1), np.insert(words.end, cut, last[cut] + 1)
    text = np.insert(words.text, cut, words.text[cut])
    return W.Words(start, end, text, np.searchsorted(text, np.arange(len(words.first))))


class Encoder:
    """Token ids of whole texts; the ids of words are remembered.

    The tokenizer's pre-tokenizer drops white space and never joins across it, and it
    lower-cases. So a text's ids are those of its words, one after the other, and ASCII
    capitals may be lower-cased before. Words of plain Latin letters are one
    pre-token as they are and go straight to the tokenizer's model; all others go
    through the whole tokenizer. So do texts that could hold a special token's string.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.known: dict[int, bytes] = {}

    def _encode(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, keys: list[int], words: list[bytes]) -> None:
        rest = []
        for key, word in zip(keys, words, strict=True):
            text = word.decode()
            if PLAIN.fullmatch(text):
                mapped = text.lower().encode().decode("latin-1").translate(BYTE_LEVEL)
                self.known[key] = array.array("I", [t.id for t in self.model.tokenize(mapped)]).tobytes()
            else:
                rest.append((key, text))
        for low in range(0, len(rest), 10_000):
            part = rest[low : low + 10_000]
            self.known.update(zip([k for k, _ in part], self._encode([t for _, t in part]), strict=True))

    def ids(self, column: pa.Array) -> list[bytes]:
        """Little-endian 32-bit ids of every text; none for NULL."""
        raw = W.text_bytes(column)
        raw = W.Text(LOWER[raw.data], raw.offsets)
        units = _units(raw)
        keys, at, which = np.unique(W.hash_spans(raw.data, units.start, units.end), return_index=True, return_inverse=True)
        keys = keys.tolist()
        if len(self.known) > CACHED_WORDS:
            self.known.clear()
        new = [k for k, key in enumerate(keys) if key not in self.known]
        starts, ends = units.start[at[new]].tolist(), units.end[at[new]].tolist()
        self._learn([keys[k] for k in new], [raw.data[a:b].tobytes() for a, b in zip(starts, ends, strict=True)])
        parts = [self.known[k] for k in keys]
        flat = np.frombuffer(b"".join(parts), "<u4")
        sizes = np.array([len(x) // 4 for x in parts], np.int64)
        places = np.cumsum(sizes) - sizes
        size, place = sizes[which], places[which]
        ends = np.cumsum(size)
        out = flat[np.repeat(place - (ends - size), size) + np.arange(int(ends[-1]) if len(ends) else 0)]
        cuts = np.concatenate([[0], ends])[units.first].tolist()
        result = [out[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        for k in range(len(column)):
            if b"<|" in raw.data[raw.offsets[k] : raw.offsets[k + 1]].tobytes():
                result[k] = self._encode([column[k].as_py()])[0]
        return result


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


class _Shelf:
    """Pieces of documents by length, with the largest that fits found by a bit mask."""

    def __init__(self):
        self.by_length: dict[int, list[tuple[int, int]]] = {}
        self.mask = 0

    def add(self, length: int, piece: tuple[int, int]) -> None:
        self.by_length.setdefault(length, []).append(piece)
        self.mask |= 1 << length

    def take(self, length: int) -> tuple[int, int]:
        pieces = self.by_length[length]
        piece = pieces.pop()
        if not pieces:
            del self.by_length[length]
            self.mask &= ~(1 << length)
        return piece

    def largest_to(self, most: int) -> int:
        """0 if none."""
        return max(0, (self.mask & ((2 << most) - 1)).bit_length() - 1)

    def smallest_over(self, least: int) -> int:
        rest = self.mask >> (least + 1)
        return (rest & -rest).bit_length() + least if rest else 0


def arrange(sizes: list[int], tiers: tuple[int, ...] = TIERS) -> list[tuple[int, Placed]]:
    """Windows (tier, pieces in order) that hold all documents of these token counts."""
    longest = tiers[0]
    windows: list[tuple[int, Placed]] = []
    shelf = _Shelf()
    for doc, size in enumerate(sizes):
        whole = size - size % longest
        windows.extend((longest, [(doc, at, longest)]) for at in range(0, whole, longest))
        if size > whole:
            shelf.add(size - whole, (doc, whole))
    while shelf.mask:
        # the largest piece opens a window of the smallest tier that holds it
        length = shelf.largest_to(longest)
        tier = min(t for t in tiers if t >= length)
        doc, at = shelf.take(length)
        window, room = [(doc, at, length)], tier - length
        while room and shelf.mask:
            fits = shelf.largest_to(room)
            if fits:
                doc, at = shelf.take(fits)
                window.append((doc, at, fits))
                room -= fits
            else:
                size = shelf.smallest_over(room)
                doc, at = shelf.take(size)
                window.append((doc, at, room))
                shelf.add(size - room, (doc, at + room))
                room = 0
        # what a shorter window could not fill is padded to the longest
        windows.append((tier if not room or tier - room in tiers else longest, window))
    return windows


def pack_sequences(
    docs: DataFrame,
    tokenizer: Callable[[], str],
    tiers: tuple[int, ...] = TIERS,
    end_id: int = END_ID,
    step_tokens: int = STEP_TOKENS,
    id: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """Pack all documents into windows of the sizes ``tiers`` (powers of two, longest
    first), with ``end_id`` after each document.

    ``tokenizer`` gives the path of the vocabulary file where a task runs. One row per
    piece: the id, ``start`` (ids of its document before it), ``length``, ``ids`` (binary,
    little-endian 32 bit), ``doc_tokens``, ``sequence_id``, ``offset`` in the sequence,
    ``tier`` (its context size) and ``step_id``. Steps hold windows of ``step_tokens`` (a multiple of
    the longest tier) each, apart from the last of a task. Each scan task packs its own documents, so nothing is shuffled.

    NULL and empty texts are the end id alone; repeated rows are packed once each; an
    empty table gives an empty table. Other columns are not carried over.
    """
    fields = [f for f in docs.schema.fields if f.name == id]
    schema = T.StructType([*fields, *(T.StructField(n, k) for n, k in PIECE)])
    end = np.array([end_id], "<u4").tobytes()

    def run(batches):
        encode = encoder(tokenizer()).ids
        base = TaskContext.get().partitionId() << 36
        sequence = filled = 0
        held: list[tuple[int, list[tuple]]] = []

        def numbered(windows):
            """Pieces of windows, longest window first, as rows."""
            nonlocal sequence, filled
            rows = []
            for tier, pieces in windows:
                at = 0
                for name, start, length, ids, size in pieces:
                    rows.append((name, start, length, ids, size, base + sequence, at, tier, base + filled // step_tokens))
                    at += length
                filled += tier
                sequence += 1
            for low in range(0, len(rows), 10_000):
                columns = zip(*rows[low : low + 10_000], strict=True)
                kinds = [id_type, pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=schema.fieldNames())

        for batch in B.cut_batches(batches, text, GROUP_BYTES):
            id_type, names = batch.column(id).type, batch.column(id).to_pylist()
            ids = [x + end for part in B.cut_batches([batch], text, ENCODED_BYTES) for x in encode(part.column(text))]
            sizes = [len(x) // 4 for x in ids]
            windows = [
                (tier, [(names[d], start, n, ids[d][4 * start : 4 * (start + n)], sizes[d]) for d, start, n in pieces])
                for tier, pieces in arrange(sizes, tiers)
            ]
            windows = sorted(held + windows, key=lambda w: -w[0])
            # short windows that do not make up a long one wait for the next group's, so
            # that no window lies across two steps
            total = sum(tier for tier, _ in windows)
            cut, spare = len(windows), total % tiers[0]
            while spare > 0:
                cut -= 1
                spare -= windows[cut][0]
            held = windows[cut:]
            yield from numbered(windows[:cut])
        if held:
            yield from numbered(held)

    return docs.select(id, text).mapInArrow(run, schema)
