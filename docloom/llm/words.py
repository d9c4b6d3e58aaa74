"""Words, hashes of words and hashes of word windows over whole Arrow batches of texts.

Everything works on the UTF-8 bytes of a batch with numpy, so that no Python object is
made per word. Word sequences are compared by 64-bit polynomial hashes whose byte
values come from a fixed random table and which are mixed at the end.
"""

from __future__ import annotations

from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa

#: Bytes that separate words: space and U+0009 to U+000D.
SPACES = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)
_PIECE = 1 << 18
_FACTOR = 0x9E3779B97F4A7C15
_INVERSE = pow(_FACTOR, -1, 1 << 64)
_WINDOW = np.uint64(0xD1342543DE82EF95)


def byte_class(separators) -> np.ndarray:
    """Table of 256: is this byte part of a word?"""
    table = np.ones(256, bool)
    table[list(separators)] = False
    return table


WORD_BYTES = byte_class(SPACES)


class Text(NamedTuple):
    """The bytes of a batch of texts; text ``i`` is ``data[offsets[i]:offsets[i + 1]]``."""

    data: np.ndarray
    offsets: np.ndarray


class Words(NamedTuple):
    """Words of a batch: byte spans, the text of each, and the first word of each text."""

    start: np.ndarray
    end: np.ndarray
    text: np.ndarray
    first: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)


def text_bytes(texts: pa.Array) -> Text:
    """Bytes of a string column; a NULL is an empty text."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks() if texts.num_chunks != 1 else texts.chunk(0)
    if texts.null_count:
        texts = texts.fill_null("")
    if len(texts) == 0:
        return Text(np.empty(0, np.uint8), np.zeros(1, np.int64))
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    _, places, data = texts.buffers()
    offsets = np.frombuffer(places, kind, len(texts) + 1, texts.offset * kind().itemsize).astype(np.int64)
    low, high = int(offsets[0]), int(offsets[-1])
    whole = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return Text(whole[low:high], offsets - low)


def string_array(text: Text) -> pa.Array:
    """The inverse of ``text_bytes``."""
    if len(text.data) >= 2**31:
        return pa.Array.from_buffers(
            pa.large_string(), len(text.offsets) - 1, [None, pa.py_buffer(text.offsets.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(text.data))]
        )
    return pa.Array.from_buffers(
        pa.string(), len(text.offsets) - 1, [None, pa.py_buffer(text.offsets.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(text.data))]
    )


def runs(text: Text, inside: np.ndarray) -> Words:
    """Maximal runs of bytes for which ``inside`` holds; no run crosses two texts."""
    size = len(text.data)
    before = np.zeros(size + 1, bool)
    before[1:] = inside
    opens, closes = inside & ~before[:size], np.zeros(size, bool)
    closes[:-1] = inside[:-1] & ~inside[1:]
    if size:
        closes[-1] = inside[-1]
    edges = text.offsets[(text.offsets > 0) & (text.offsets < size)]
    opens[edges] = inside[edges]
    closes[edges - 1] = inside[edges - 1]
    start = np.flatnonzero(opens)
    first = np.searchsorted(start, text.offsets)
    return Words(start, np.flatnonzero(closes) + 1, np.repeat(np.arange(len(first) - 1), np.diff(first)), first)


def split_words(text: Text, table: np.ndarray = WORD_BYTES) -> Words:
    return runs(text, table[text.data])


@lru_cache(maxsize=1)
def _byte_values() -> np.ndarray:
    return np.random.default_rng(20240117).integers(1, 2**64, 256, dtype=np.uint64)


@lru_cache(maxsize=1)
def _small_powers() -> tuple[np.ndarray, np.ndarray]:
    return _powers(_PIECE)


def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the factor and of its inverse, modulo 2^64."""
    up, down = np.full(size, _FACTOR, np.uint64), np.full(size, _INVERSE, np.uint64)
    up[:1] = down[:1] = 1
    return np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)


def mix(values: np.ndarray, salt: int = 0) -> np.ndarray:
    """Spread every bit of 64-bit values over the whole word."""
    x = values + np.uint64((salt * _FACTOR + _FACTOR) % 2**64)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def hash_spans(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of the bytes of every span (sorted, not overlapping)."""
    out = np.empty(len(start), np.uint64)
    low = 0
    while low < len(start):
        base = int(start[low])
        high = max(low + 1, int(np.searchsorted(end, base + _PIECE, side="right")))
        size = int(end[high - 1]) - base
        up, down = _small_powers() if size <= _PIECE else _powers(size)
        sums = np.zeros(size + 1, np.uint64)
        np.cumsum(_byte_values()[data[base : base + size]] * up[:size], out=sums[1:])
        left, right = start[low:high] - base, end[low:high] - base
        # an empty span may begin at the end of the piece; its sum is zero anyway
        out[low:high] = (sums[right] - sums[left]) * down[np.minimum(left, size - 1)] if size else 0
        low = high
    return mix(out ^ (end - start).astype(np.uint64))


def window_hashes(words: np.ndarray, length: int) -> np.ndarray:
    """Hash of every ``length`` consecutive word hashes, also across texts."""
    size = max(0, len(words) - length + 1)
    out = words[:size].copy()
    for k in range(1, length):
        out *= _WINDOW
        out += words[k : k + size]
    return mix(out)


def inside_text(words: Words, length: int) -> np.ndarray:
    """For every window of ``window_hashes``: does it lie in one text?"""
    size = max(0, len(words.text) - length + 1)
    return words.text[:size] == words.text[len(words.text) - size :]


def cover(size: int, starts: np.ndarray, length: int) -> np.ndarray:
    """Which of ``size`` positions lie in a window of ``length`` from one of ``starts``."""
    steps = np.bincount(starts, minlength=size + 1) - np.bincount(starts + length, minlength=size + 1)[: size + 1]
    return np.cumsum(steps[:size]) > 0


def member(values: np.ndarray, sorted_set: np.ndarray) -> np.ndarray:
    if not len(sorted_set) or not len(values):
        return np.zeros(len(values), bool)
    place = np.searchsorted(sorted_set, values)
    place[place == len(sorted_set)] = 0
    return sorted_set[place] == values


def group_edges(sorted_keys: np.ndarray) -> np.ndarray:
    """First position of every run of equal keys."""
    if not len(sorted_keys):
        return np.empty(0, np.int64)
    return np.flatnonzero(np.concatenate([[True], sorted_keys[1:] != sorted_keys[:-1]]))
