"""Quality rules from repetition: how much of a text lies in repeated n-grams and lines."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from docloom.llm import blocks as B
from docloom.llm import words as W

#: Percent of a text's word characters that may lie in repeated n-grams of that many words.
#: All occurrences count, so a short text that ends with its first line is within them.
LIMITS = {5: 40, 7: 38, 10: 35}
#: Percent of word characters that may lie in lines that occurred before.
LINE_LIMIT = 30
MIN_WORDS = 50
#: Percent of words that may lie in repeated windows of three words.
TRIPLE_LIMIT = 50
SYMBOLS = b"#*$%&|<>"
_PIECE = 2 << 20


def _per_text(values: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Sums of the values between the edges of each text."""
    total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return total[edges[1:]] - total[edges[:-1]]


def _repeated(keys: np.ndarray) -> np.ndarray:
    """Which values occur twice or more."""
    order = np.argsort(keys)
    edges = W.group_edges(keys[order])
    counts = np.diff(np.append(edges, len(keys)))
    out = np.empty(len(keys), bool)
    out[order] = np.repeat(counts > 1, counts)
    return out


def covered_words(words: W.Words, hashes: np.ndarray, length: int) -> np.ndarray:
    """Words that lie in a window of ``length`` words found twice or more in their text."""
    values = W.window_hashes(hashes, length)
    place = np.flatnonzero(W.inside_text(words, length))
    keys = values[place] ^ W.mix(words.text[place].astype(np.uint64), length)
    return W.cover(len(hashes), place[_repeated(keys)], length)


def repeated_lines(raw: W.Text, words: W.Words) -> tuple[np.ndarray, np.ndarray, W.Words]:
    """Lines with a word (as positions among all lines that are not empty), and which of
    them equal an earlier one of their text."""
    lines = W.runs(raw, raw.data != 0x0A)
    kept = np.flatnonzero(np.searchsorted(words.start, lines.end) > np.searchsorted(words.start, lines.start))
    keys = W.hash_spans(raw.data, lines.start[kept], lines.end[kept]) ^ W.mix(lines.text[kept].astype(np.uint64), 1)
    order = np.argsort(keys, kind="stable")
    later = np.zeros(len(kept), bool)
    later[order[1:]] = keys[order[1:]] == keys[order[:-1]]
    return kept, later, lines


def measures(column: pa.Array) -> dict[str, np.ndarray]:
    """All counts of a batch of texts."""
    raw = W.text_bytes(column)
    words = W.split_words(raw)
    hashes = W.hash_spans(raw.data, words.start, words.end)
    points = np.concatenate([[0], np.cumsum((raw.data & 0xC0) != 0x80, dtype=np.int64)])
    chars = points[words.end] - points[words.start]
    kept, later, lines = repeated_lines(raw, words)
    again = kept[later]
    char_sum = np.concatenate([[0], np.cumsum(chars)])
    first, last = np.searchsorted(words.start, lines.start[again]), np.searchsorted(words.start, lines.end[again])
    symbols = np.zeros(256, bool)
    symbols[list(SYMBOLS)] = True
    out = {
        "n_words": words.counts.astype(np.int64),
        "word_chars": _per_text(chars, words.first),
        "n_symbols": _per_text(symbols[raw.data], raw.offsets),
        "n_dup_lines": np.bincount(lines.text[again], minlength=len(column)).astype(np.int64),
        "dup_line_chars": np.bincount(lines.text[again], char_sum[last] - char_sum[first], len(column)).astype(np.int64),
        "n_repeat_words": _per_text(covered_words(words, hashes, 3), words.first),
    }
    for length in LIMITS:
        out[f"dup_chars_{length}"] = _per_text(chars * covered_words(words, hashes, length), words.first)
    return out


COLUMNS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "dup_line_chars", "n_repeat_words", *(f"dup_chars_{n}" for n in LIMITS)]


def judge(docs: DataFrame, text: str = "text") -> DataFrame:
    """Repetition counts of every text and the verdict ``kept``.

    Adds ``n_words, word_chars, n_symbols, n_dup_lines, dup_line_chars, n_repeat_words,
    dup_chars_5, dup_chars_7, dup_chars_10`` (long), ``base_failed`` and ``kept``
    (boolean); input columns with these names are replaced. A text is rejected with fewer
    than 50 words, with over half of its words in repeated three-word windows, with
    more than the limit of its word characters in repeated n-grams, or with over 30 % of
    them in lines that occurred before.

    NULL and empty texts count nothing and are rejected. Rows are judged one by one, so
    repeated rows get the same verdict; an empty table gives an empty table.
    """
    schema = B.added(docs.schema, *((c, T.LongType()) for c in COLUMNS), ("base_failed", T.BooleanType()), ("kept", T.BooleanType()))
    names = schema.fieldNames()

    def run(batches):
        for batch in B.cut_batches(batches, text, _PIECE):
            found = measures(batch.column(text))
            n, chars = found["n_words"], found["word_chars"]
            failed = (n < MIN_WORDS) | (100 * found["n_repeat_words"] > TRIPLE_LIMIT * n)
            poor = 100 * found["dup_line_chars"] > LINE_LIMIT * chars
            for length, limit in LIMITS.items():
                poor |= 100 * found[f"dup_chars_{length}"] > limit * chars
            columns = {k: pa.array(v) for k, v in found.items()} | {"base_failed": pa.array(failed), "kept": pa.array(~failed & ~poor)}
            yield B.with_columns(batch, columns, names)

    return docs.mapInArrow(run, schema)
