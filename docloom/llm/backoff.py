"""Stupid-backoff scores of documents under the rest of the corpus.

The n-gram count tables are partitioned by hash: each block of documents sends its
distinct n-grams with their counts to hash buckets, a bucket adds them up and answers
with the totals, the block joins these to its n-grams and sums up each document. This
is done order by order. An n-gram is only asked for if both n-grams of one word less in it
are found in other documents, since no other can be.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.llm import blocks as B
from docloom.llm import words as W

ORDER = 3
ALPHA = 0.4
#: Bits of a key inside its bucket.
_KEY_BITS = 44


class Grams(NamedTuple):
    """N-grams of one order in a block. ``place``: the positions (of first words) taken part;
    ``which``: the distinct n-gram of each; ``own``: how often its document has it."""

    place: np.ndarray
    keys: np.ndarray
    which: np.ndarray
    own: np.ndarray
    counts: np.ndarray


def _grams(values: np.ndarray, place: np.ndarray, text: np.ndarray, buckets: int) -> Grams:
    """``text`` is sorted, so a stable sort by n-gram also brings its documents together."""
    bits = min(_KEY_BITS, 64 - (buckets - 1).bit_length())
    values = values[place]
    keys = ((W.mix(values, 11) % np.uint64(buckets)) << np.uint64(bits)) | (values >> np.uint64(64 - bits))
    order = np.argsort(keys, kind="stable")
    keys, owner = keys[order], text[place][order]
    edges = W.group_edges(keys)
    runs = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]) | (owner[1:] != owner[:-1])])) if len(keys) else edges
    sizes, counts = np.diff(np.append(runs, len(keys))), np.diff(np.append(edges, len(keys)))
    which, own = np.empty(len(keys), np.int64), np.empty(len(keys), np.int64)
    which[order], own[order] = np.repeat(np.arange(len(edges)), counts), np.repeat(sizes, sizes)
    return Grams(place, keys[edges], which, own, counts)


def _request(block: int, grams: Grams, buckets: int) -> pa.RecordBatch:
    bits = min(_KEY_BITS, 64 - (buckets - 1).bit_length())
    short = grams.keys & np.uint64((1 << bits) - 1)
    return B.requests(block, grams.keys >> np.uint64(bits), short, grams.counts.astype(np.int64), B.squeeze_sorted, B.squeeze)


def _carried(block: int, order: int, totals: np.ndarray, buckets: int) -> pa.RecordBatch:
    """A row that passes its bucket unchanged: totals of an order known already."""
    return pa.RecordBatch.from_arrays(
        [pa.array([block % buckets], pa.int32()), pa.array([block], pa.int64()), pa.array([bytes([order])], pa.binary()), pa.array([B.squeeze(totals)], pa.binary())],
        names=["bucket", "block", "keys", "data"],
    )


def _is_carried(table: pa.Table) -> np.ndarray:
    return pc.equal(pc.fill_null(pc.binary_length(table.column("keys")), 0), 1).to_numpy(zero_copy_only=False)


def _add_up(table: pa.Table) -> pa.Table:
    """Totals of a bucket, to each block in the order of the keys it sent."""
    carried = _is_carried(table)
    asked = table.filter(pa.array(~carried))
    keys, row = B.arrays(asked.column("keys"), np.uint64, B.unsqueeze_sorted)
    counts, _ = B.arrays(asked.column("data"), np.int64, B.unsqueeze)
    _, which = np.unique(keys, return_inverse=True)
    totals = np.bincount(which, counts, minlength=0).astype(np.int64)[which] if len(which) else np.empty(0, np.int64)
    cuts = np.searchsorted(row, np.arange(asked.num_rows + 1))
    data = pa.array([B.squeeze(totals[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)], pa.binary())
    out = pa.table({"bucket": asked.column("bucket"), "block": asked.column("block"), "keys": pa.nulls(asked.num_rows, pa.binary()), "data": data})
    return pa.concat_tables([out, table.filter(pa.array(carried)).cast(out.schema)])


class _Block:
    """N-grams of a block, as far as the answers to it reach."""

    def __init__(self, batch: pa.RecordBatch, text: str, answers: pa.Table, buckets: int):
        raw = W.text_bytes(batch.column(text))
        self.words = W.split_words(raw)
        hashes = W.hash_spans(raw.data, self.words.start, self.words.end)
        carried = {}
        if answers is not None and answers.num_rows:
            is_carried = _is_carried(answers)
            for key, data in zip(answers.column("keys").filter(pa.array(is_carried)), answers.column("data").filter(pa.array(is_carried)), strict=True):
                carried[key.as_py()[0]] = B.unsqueeze(data.as_buffer(), np.int64)
            fresh = answers.filter(pa.array(~is_carried)).sort_by("bucket")
            carried[max(carried, default=0) + 1] = B.arrays(fresh.column("data"), np.int64, B.unsqueeze)[0]
        self.totals = [carried[k] for k in sorted(carried)]
        self.grams: list[Grams] = []
        place = np.arange(len(hashes))
        for order in range(1, len(self.totals) + 2):
            if order > ORDER:
                break
            values = W.window_hashes(hashes, order)
            if order > 1:
                seen = self.elsewhere(order - 1) > 0
                inside = np.flatnonzero(W.inside_text(self.words, order))
                place = inside[seen[inside] & seen[inside + 1]]
            self.grams.append(_grams(values, place, self.words.text, buckets))

    def elsewhere(self, order: int) -> np.ndarray:
        """At each position, how often the n-gram from there is in other documents."""
        grams, totals = self.grams[order - 1], self.totals[order - 1]
        out = np.zeros(len(self.words.text) + 1, np.int64)
        out[grams.place] = totals[grams.which] - grams.own
        return out


def _scores(found: list[np.ndarray], words: W.Words, total: int) -> tuple[np.ndarray, np.ndarray]:
    """Log score of every word and the order it was found in (0: in no other document)."""
    size = len(words.text)
    inside = np.arange(size) - words.first[words.text]
    rest = total - words.counts[words.text]
    one = found[0][:size]
    order = np.where(one > 0, 1, 0)
    score = np.where(one > 0, one, 1) / np.where(one > 0, rest, rest + 1)
    for n in range(2, len(found) + 1):
        start = np.maximum(np.arange(size) - n + 1, 0)
        fits = inside >= n - 1
        hits = np.where(fits, found[n - 1][start], 0)
        # the n-gram begins at start; so does its history, which is one word shorter
        ratio = hits / np.maximum(1, found[n - 2][start])
        score = np.where(hits > 0, ratio, np.where(fits, ALPHA * score, score))
        order = np.where(hits > 0, n, order)
    return np.log(score), order


def score_documents(docs: DataFrame, text: str = "text", block_bytes: int = B.BLOCK_BYTES) -> DataFrame:
    """Score every text by the trigram counts of all other rows.

    Adds ``n_words``, ``n_order_3, n_order_2, n_order_1, n_order_0`` (long: words found after
    their two, one, no words before them, or in no other row), ``log_score`` (sum of the
    natural logs) and ``mean_log_score``; columns with these names are replaced. A word's
    score is the count of its n-gram by that of the n-gram without it; where there is
    none it is 0.4 times the score of one word less, down to the word's share of all words;
    a new word counts as one among one more.

    Rows are documents: repeated rows find each other. NULL and empty texts have no words and
    score 0. An empty table gives an empty table. N-grams are told apart by 64-bit hashes,
    of which a bucket (of about a million n-grams) keeps 44 bits, fewer beyond a million
    buckets. Two n-grams of a bucket are taken for one in one of some ten million cases.
    """
    packed = B.pack(docs, text, block_bytes, lambda batch: len(W.split_words(W.text_bytes(batch.column(text))).start))
    total = int(packed.agg(F.sum("n_units")).first()[0] or 0)
    buckets = B.bucket_count(packed, 0.15)
    orders = [f"n_order_{k}" for k in range(ORDER, -1, -1)]
    schema = B.added(docs.schema, *((n, T.LongType()) for n in ("n_words", *orders)), ("log_score", T.DoubleType()), ("mean_log_score", T.DoubleType()))
    names = schema.fieldNames()

    def first(block, batch):
        return _request(block, _Block(batch, text, None, buckets).grams[0], buckets)

    def further(block, batch, answers):
        own = _Block(batch, text, answers, buckets)
        rows = [_request(block, own.grams[-1], buckets), *(_carried(block, k + 1, t, buckets) for k, t in enumerate(own.totals))]
        return pa.Table.from_batches(rows).combine_chunks().to_batches()[0]

    def score(block, batch, answers):
        own = _Block(batch, text, answers, buckets)
        n, rows = own.words.counts, batch.num_rows
        logs, order = np.empty(0), np.empty(0, np.int64)
        if len(own.words.text):
            found = [own.elsewhere(k + 1) for k in range(ORDER)]
            logs, order = _scores(found, own.words, total)
        sums = np.bincount(own.words.text, logs, rows)
        columns = {"n_words": pa.array(n.astype(np.int64)), "log_score": pa.array(sums), "mean_log_score": pa.array(sums / np.maximum(1, n))}
        for k in range(ORDER + 1):
            columns[f"n_order_{k}"] = pa.array(np.bincount(own.words.text[order == k], minlength=rows).astype(np.int64))
        return B.with_columns(batch, columns, names)

    answers = B.answer(B.ask(packed, first), _add_up)
    for _ in range(ORDER - 1):
        answers = B.answer(B.revisit(packed, answers, further, B.REQUEST), _add_up)
    return B.revisit(packed, answers, score, schema)
