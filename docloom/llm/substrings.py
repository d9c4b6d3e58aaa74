"""Removal of passages that repeat across documents, found by difference-cover anchors.

Word positions are taken modulo a period of 7; {1, 2, 4} is a difference cover of 7, so
for any two positions there is a shift below 7 that puts both on the cover. Only the
windows of ``window - 6`` words at cover positions are hashed and compared: two equal
windows of ``window`` words always share one such anchor at the same distance from
their starts. Where an anchor occurs in two documents, it is extended to the full
windows around it, and only those are compared once more, by their owner.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.llm import blocks as B
from docloom.llm import words as W

PERIOD = 7
COVER = np.array([0, 1, 1, 0, 1, 0, 0], bool)


def _anchors(words: W.Words, hashes: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Cover positions (counted inside each text) that start a whole anchor, and its hash."""
    values = W.window_hashes(hashes, length)
    inside = np.arange(len(values)) - words.first[words.text[: len(values)]]
    place = np.flatnonzero(W.inside_text(words, length) & COVER[inside % PERIOD])
    return place, values[place]


def _anchor_keys(values: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and 32-bit key, also as one number that sorts by both."""
    bucket = values % np.uint64(buckets)
    return bucket, (bucket << np.uint64(32)) | (values >> np.uint64(32))


def _shared_here(keys: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """For each key: does it occur with two different owners?"""
    order = np.argsort(keys, kind="stable")
    edges = W.group_edges(keys[order])
    low, high = np.minimum.reduceat(owner[order], edges), np.maximum.reduceat(owner[order], edges)
    out = np.empty(len(keys), bool)
    out[order] = np.repeat(low != high, np.diff(np.append(edges, len(keys))))
    return out


def _least_owner(keys: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """For each key the smallest owner that has it."""
    order = np.argsort(keys, kind="stable")
    edges = W.group_edges(keys[order])
    out = np.empty(len(keys), owner.dtype)
    out[order] = np.repeat(np.minimum.reduceat(owner[order], edges), np.diff(np.append(edges, len(keys))))
    return out


def remove_repeats(docs: DataFrame, window: int = 13, id: str = "doc_id", text: str = "text", block_bytes: int = B.BLOCK_BYTES // 2) -> DataFrame:
    """Cut every word covered by a window of ``window`` words that also starts in a
    document with a smaller id. Windows are judged on the input texts.

    Returns all columns with ``text`` cut, and ``n_words`` (before the cut) and
    ``n_removed``. Words are separated by space and U+0009 to U+000D; a removed word
    takes the white space before it along; a text that loses nothing stays as it is.

    NULL texts stay NULL and count no words, texts shorter than a window lose nothing. Repeats inside one document, or
    between rows with the same id, are not removed. A NULL id counts as larger than all
    others. Input columns named ``n_words`` or ``n_removed`` are replaced. An empty
    table gives an empty table.
    """
    if window < PERIOD:
        raise ValueError(f"a window has {PERIOD} words at least")
    length = window - PERIOD + 1
    packed = B.pack(docs, text, block_bytes)
    buckets = B.bucket_count(packed, 0.08)
    schema = B.added(docs.schema, ("n_words", T.LongType()), ("n_removed", T.LongType()))
    names = schema.fieldNames()

    def prepared(batch):
        raw = W.text_bytes(batch.column(text))
        words = W.split_words(raw)
        return raw, words, W.hash_spans(raw.data, words.start, words.end)

    def ask_anchors(block, batch):
        _, words, hashes = prepared(batch)
        keys = np.unique(_anchor_keys(_anchors(words, hashes, length)[1], buckets)[1])
        return B.requests(block, keys >> np.uint64(32), (keys & np.uint64(0xFFFFFFFF)).astype(np.uint32))

    def shared_anchors(table):
        keys, row = B.arrays(table.column("keys"), np.uint32)
        order = np.argsort(keys, kind="stable")
        edges = W.group_edges(keys[order])
        counts = np.diff(np.append(edges, len(keys)))
        shared = np.zeros(len(keys), bool)
        shared[order] = np.repeat(counts > 1, counts)
        return _replies(table, row, keys, shared)

    def ask_windows(block, batch, replies):
        _, words, hashes = prepared(batch)
        owner = B.document_ids(batch, id)[words.text]
        place, values = _anchors(words, hashes, length)
        _, keys = _anchor_keys(values, buckets)
        known, row = B.arrays(replies.column("keys"), np.uint32)
        bucket = replies.column("bucket").to_numpy().astype(np.uint64)
        known = np.sort((bucket[row] << np.uint64(32)) | known.astype(np.uint64))
        hit = place[W.member(keys, known) | _shared_here(keys, owner[place])] if len(place) else place
        full = W.window_hashes(hashes, window)
        marked = np.zeros(len(hashes) + PERIOD, bool)
        # window i contains the anchors at i .. i + 6, so an anchor at p marks p - 6 .. p
        marked = W.cover(len(hashes) + PERIOD, hit, PERIOD)[PERIOD - 1 :] if len(hit) else marked
        candidates = np.flatnonzero(marked[: len(full)] & W.inside_text(words, window))
        return _window_requests(block, full[candidates], owner[candidates], buckets)

    def older_windows(table):
        keys, row = B.arrays(table.column("keys"), np.uint64)
        owner, _ = B.arrays(table.column("data"), np.int64)
        return _replies(table, row, keys, _least_owner(keys, owner) < owner) if len(keys) else _replies(table, row, keys, np.zeros(0, bool))

    def cut(block, batch, replies):
        raw, words, hashes = prepared(batch)
        owner = B.document_ids(batch, id)[words.text]
        full = W.window_hashes(hashes, window)
        place = np.flatnonzero(W.inside_text(words, window))
        values = full[place]
        gone = np.zeros(len(hashes), bool)
        if len(place):
            keys, row = B.arrays(replies.column("keys"), np.uint64)
            bucket = replies.column("bucket").to_numpy()[row] if len(keys) else np.empty(0, np.int32)
            order = np.argsort(keys)
            keys, bucket = keys[order], bucket[order]
            repeated = _least_owner(values, owner[place]) < owner[place]
            if len(keys):
                at = np.minimum(np.searchsorted(keys, values), len(keys) - 1)
                repeated |= (keys[at] == values) & (bucket[at] == _window_bucket(values, buckets))
            gone = W.cover(len(hashes), place[repeated], window)
        removed = np.bincount(words.text[gone], minlength=batch.num_rows)
        columns = {
            text: _cut_texts(batch.column(text), raw, words, gone, removed),
            "n_words": pa.array(words.counts.astype(np.int64)),
            "n_removed": pa.array(removed.astype(np.int64)),
        }
        return B.with_columns(batch, columns, names)

    anchors = B.answer(B.ask(packed, ask_anchors), shared_anchors)
    windows = B.answer(B.revisit(packed, anchors, ask_windows, B.REQUEST), older_windows)
    return B.revisit(packed, windows, cut, schema)


def _window_bucket(values: np.ndarray, buckets: int) -> np.ndarray:
    return (W.mix(values, 7) % np.uint64(buckets)).astype(np.int32)


def _window_requests(block: int, values: np.ndarray, owner: np.ndarray, buckets: int) -> pa.RecordBatch:
    """Each distinct window of the block with the smallest owner it has there."""
    bucket = _window_bucket(values, buckets)
    order = np.lexsort((owner, values, bucket))
    values, owner, bucket = values[order], owner[order], bucket[order]
    edges = W.group_edges(values)
    return B.requests(block, bucket[edges], values[edges], owner[edges])


def _replies(table: pa.Table, row: np.ndarray, keys: np.ndarray, wanted: np.ndarray) -> pa.Table:
    """To every block those of its keys that are wanted; nothing where there are none."""
    row, keys = row[wanted], keys[wanted]
    edges = W.group_edges(row)
    cuts = np.append(edges, len(row))
    asked = row[edges]
    blocks, bucket = table.column("block").to_numpy()[asked], table.column("bucket").to_numpy()[asked]
    return pa.table(
        {
            "bucket": pa.array(bucket, pa.int32()),
            "block": pa.array(blocks, pa.int64()),
            "keys": pa.array([keys[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)], pa.binary()),
            "data": pa.nulls(len(edges), pa.binary()),
        }
    )


def _cut_texts(column: pa.Array, raw: W.Text, words: W.Words, gone: np.ndarray, removed: np.ndarray) -> pa.Array:
    """Texts without the words that are gone and the white space before each of them."""
    if not gone.any():
        return column
    # from the end of the word before, or from the start of the text
    left = np.where(np.arange(len(words.start)) == words.first[words.text], raw.offsets[words.text], np.concatenate([[0], words.end[:-1]]))
    steps = np.zeros(len(raw.data) + 1, np.int8)
    # the end of one gone word may be where the next begins, so both steps are added
    np.add.at(steps, left[gone], 1)
    np.add.at(steps, words.end[gone], -1)
    kept = np.cumsum(steps[:-1], dtype=np.int8) == 0
    # what is left must not begin with the white space before its first word
    kept_words = np.flatnonzero(~gone)
    leading = kept_words[W.group_edges(words.text[kept_words])]
    lost = np.bincount(words.text[gone], (words.end - left)[gone], len(column)).astype(np.int64)
    for k in leading[removed[words.text[leading]] > 0].tolist():
        kept[left[k] : words.start[k]] = False
        lost[words.text[k]] += words.start[k] - left[k]
    sizes = np.diff(raw.offsets) - lost
    out = W.string_array(W.Text(raw.data[kept], np.concatenate([[0], np.cumsum(sizes)])))
    if not column.null_count:
        return out
    import pyarrow.compute as pc

    return pc.if_else(column.is_valid(), out, pa.scalar(None, out.type))


def kept_words(text):
    """The words of a column, joined by one space."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " "))
