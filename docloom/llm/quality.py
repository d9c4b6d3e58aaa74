"""Quality of texts by a regularised quadratic discriminant on document statistics."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.llm import blocks as B
from docloom.llm import repetition as R
from docloom.llm import words as W
from docloom.session import materialise

FEATURES = (
    "words", "word_length", "capitals", "digits", "symbols", "bars", "marks", "stops", "breaks", "beyond_ascii", "short_words", "distinct_words", "repeated_words", "repeated_lines",
)
CLASSES = {
    "capitals": range(0x41, 0x5B),
    "digits": range(0x30, 0x3A),
    "symbols": b"#*$%&<>",
    "bars": b"|",
    "marks": b"!?",
    "stops": b".,;:",
    "breaks": b"\n",
    "beyond_ascii": range(0x80, 0x100),
}
#: Share of the pooled covariance, and of a multiple of the identity, in each class's.
POOLED, ROUND = 0.1, 0.05
_PIECE = 4 << 20


def _share(part: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """Smoothed log odds of a share."""
    part = np.minimum(part, whole)
    return np.log((part + 0.5) / (whole - part + 0.5))


def statistics(column: pa.Array) -> np.ndarray:
    """Transformed statistics of every text, one row each."""
    raw = W.text_bytes(column)
    words = W.split_words(raw)
    hashes = W.hash_spans(raw.data, words.start, words.end)
    n, size = words.counts.astype(np.int64), np.diff(raw.offsets)
    lengths = words.end - words.start
    out = {"words": np.log1p(n), "word_length": np.log1p(R._per_text(lengths, words.first) / np.maximum(1, n))}
    for name, values in CLASSES.items():
        table = np.zeros(256, bool)
        table[list(values)] = True
        out[name] = _share(R._per_text(table[raw.data], raw.offsets), size)
    keys = hashes ^ W.mix(words.text.astype(np.uint64), 3)
    order = np.argsort(keys)
    firsts = np.zeros(len(keys), bool)
    firsts[order[W.group_edges(keys[order])]] = True
    out["short_words"] = _share(R._per_text(lengths <= 3, words.first), n)
    out["distinct_words"] = _share(R._per_text(firsts, words.first), n)
    out["repeated_words"] = _share(R._per_text(R.covered_words(words, hashes, 3), words.first), n)
    kept, later, lines = R.repeated_lines(raw, words)
    count = lambda x: np.bincount(lines.text[x], minlength=len(n))
    out["repeated_lines"] = _share(count(kept[later]), count(kept))
    return np.stack([out[k] for k in FEATURES], axis=1)


class Discriminant:
    """Class means and Cholesky factors of shrunk covariances."""

    def __init__(self, moments: dict[int, tuple[float, np.ndarray, np.ndarray]]):
        """``moments``: for class 0 and 1 the count, the sums and the sums of products."""
        total = sum(m[0] for m in moments.values())
        self.prior = (moments[1][0] + 1) / (total + 2) if 1 in moments else 1 / (total + 2)
        self.parts = []
        if not all(k in moments and moments[k][0] > 1 for k in (0, 1)):
            return  # one class alone: every score is the prior
        size = len(FEATURES)
        covariances = {k: p / n - np.outer(s / n, s / n) for k, (n, s, p) in moments.items()}
        pooled = sum(moments[k][0] * covariances[k] for k in (0, 1)) / total
        self.scale = np.sqrt(np.maximum(np.diag(pooled), 1e-6))
        pooled = pooled / np.outer(self.scale, self.scale)
        for k in (0, 1):
            n, s, _ = moments[k]
            own = covariances[k] / np.outer(self.scale, self.scale)
            own = (1 - POOLED) * own + POOLED * pooled
            own = (1 - ROUND) * own + ROUND * max(np.trace(own) / size, 1e-3) * np.eye(size)
            factor = np.linalg.cholesky(own)
            self.parts.append((s / n / self.scale, np.linalg.inv(factor), np.log(np.diag(factor)).sum()))

    def scores(self, values: np.ndarray) -> np.ndarray:
        """Probability of class 1, from the difference of the log densities."""
        if not self.parts:
            return np.full(len(values), self.prior)
        z = values / self.scale
        logs = [-0.5 * np.square((z - mean) @ inverse.T).sum(axis=1) - volume for mean, inverse, volume in self.parts]
        margin = logs[1] - logs[0] + np.log(self.prior / (1 - self.prior))
        return 1 / (1 + np.exp(-np.clip(margin, -500, 500)))


def measure(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """``id`` and ``features`` (array of double) of every row, written to the shared folder."""
    schema = T.StructType([T.StructField(id, docs.schema[id].dataType), T.StructField("features", T.ArrayType(T.DoubleType()))])

    def run(batches):
        for batch in B.cut_batches(batches, text, _PIECE):
            values = statistics(batch.column(text))
            flat = pa.ListArray.from_arrays(pa.array(np.arange(len(values) + 1, dtype=np.int32) * len(FEATURES)), pa.array(values.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(id), flat], names=[id, "features"])

    return materialise(docs.select(id, text).mapInArrow(run, schema), "features")


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, len(FEATURES))


def fit(labelled: DataFrame) -> Discriminant:
    """Fit on all rows of ``label, features``: each task sums its rows, Spark adds the
    sums up, and only one row per moment and class reaches the driver."""

    def run(batches):
        for batch in batches:
            values, label = _matrix(batch.column("features")), batch.column("label").to_numpy(zero_copy_only=False)
            for k in (0, 1):
                own = values[label == k]
                flat = np.concatenate([[len(own)], own.sum(axis=0), (own.T @ own).ravel()])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(flat), k, np.int32)), pa.array(np.arange(len(flat), dtype=np.int32)), pa.array(flat)], names=["label", "place", "value"])

    sums = labelled.select("label", "features").mapInArrow(run, "label int, place int, value double").groupBy("label", "place").agg(F.sum("value"))
    size = len(FEATURES)
    flat = np.zeros((2, 1 + size + size * size))
    for label, place, value in sums.collect():
        flat[label, place] = value
    return Discriminant({k: (f[0], f[1 : 1 + size], f[1 + size :].reshape(size, size)) for k, f in enumerate(flat) if f[0]})


def score_quality(docs: DataFrame, labels: DataFrame, train: Column, id: str = "doc_id", text: str = "text", label: str = "quality") -> DataFrame:
    """``id`` and ``score`` (probability of label 1) of every document.

    The model is fitted on all labelled rows for which ``train``, a condition on ``id``,
    holds. Only the text is an input. NULL and empty texts are scored from their (zero)
    statistics. Labels that are not 0 or 1, or whose id is NULL or unknown, are not used;
    repeated rows count each. Without labels of both classes every score is the share
    of label 1 (with one row added to either). An empty table gives an empty table.
    """
    features = measure(docs, id, text)
    known = labels.where(train & F.col(label).isin(0, 1)).select(F.col(id).alias("_id"), F.col(label).cast("int").alias("label"))
    model = fit(features.join(known, features[id] == known["_id"]))
    schema = T.StructType([features.schema[id], T.StructField("score", T.DoubleType())])

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(id), pa.array(model.scores(_matrix(batch.column("features"))))], names=[id, "score"])

    return features.mapInArrow(run, schema)
