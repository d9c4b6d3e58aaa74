"""Caller-supplied models over tables: extraction, embedding, generation.

Models stay outside the library. Each operator takes functions, or a factory that makes
them once per task, and runs them over batches; one bad row never fails its neighbours.
"""

from __future__ import annotations

import collections
import hashlib
import queue
import threading
import time
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom import fixed_values as fv
from docloom.functions.files import extractor_route
from docloom.operators import blocks
from docloom.session import once

Extractor = Callable[[bytes], list]
Extractors = dict[str, Extractor] | Callable[[], dict[str, Extractor]]
Generator = Callable[[list[str]], list]
Generators = dict[str, Generator] | Callable[[], dict[str, Generator]]
Fetch = Callable[[str, str], bytes]
# Texts leave an extraction in pieces of so many characters.
EXTRACTED_CHARS = 2_000_000


def _made(functions):
    """The functions themselves; a factory is called where they are needed."""
    return functions() if callable(functions) else functions


# ------------------------------------------------------------------ extraction
def _joined(route: str, result: list) -> str:
    if route == "ocr":
        return " ".join(word for line in result for word in line)
    return "\n".join(str(element) for element in result)


def extract_text(
    files: DataFrame,
    extractors: Extractors,
    *,
    fetch: Fetch | None = None,
    content: str = "content",
    ocr_extensions: tuple[str, ...] = fv.OCR_EXTENSIONS,
) -> DataFrame:
    """Add ``extracted_text`` and ``error`` to rows with ``filename`` and ``bucket``.

    ``extractors["ocr"]`` maps bytes to lines of words and serves the image and PDF
    extensions; ``extractors["text"]`` maps bytes to elements and serves the rest.
    Bytes come from the ``content`` column or, so that they never pass through a
    shuffle, from ``fetch(bucket, filename)`` inside the task. A failure becomes the
    text ``ERROR: …`` and also fills ``error``, which no document text can imitate.
    """
    kept = [column for column in files.columns if column != content]
    schema = T.StructType(
        [files.schema[c] for c in kept]
        + [T.StructField("extracted_text", T.StringType()), T.StructField("error", T.StringType())]
    )

    def one(made: dict[str, Extractor], filename: str, bucket: str, route: str, data: bytes | None) -> tuple[str, str | None]:
        try:
            if filename is None:
                raise ValueError("no file name")
            body = fetch(bucket, filename) if fetch else data
            if body is None:
                raise ValueError("no content")
            return _joined(route, made[route](bytes(body))).strip(), None
        except Exception as error:  # noqa: BLE001 - every failure becomes a row
            return f"{fv.ERROR_PREFIX}{error}", str(error)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = _made(extractors)

        def rows(batch: pa.RecordBatch, done: list[tuple[str, str | None]], start: int) -> pa.RecordBatch:
            texts, errors = (pa.array(column, pa.string()) for column in zip(*done, strict=True))
            return pa.RecordBatch.from_arrays([*batch.select(kept).slice(start, len(done)).columns, texts, errors], names=schema.fieldNames())

        for batch in batches:  # one file at a time is a Python object, and a few megabytes of texts
            inputs = [batch[c] for c in ("filename", "bucket", "_route", content) if c in batch.schema.names]
            done, size, start = [], 0, 0
            for row in range(batch.num_rows):
                values = [column[row].as_py() for column in inputs]
                done.append(one(made, *values[:3], values[3] if len(values) > 3 else None))
                size += len(done[-1][0])
                if size >= EXTRACTED_CHARS or row == batch.num_rows - 1:
                    yield rows(batch, done, start)
                    done, size, start = [], 0, row + 1

    routed = files.withColumn("_route", extractor_route(F.col("filename"), ocr_extensions))
    return routed.mapInArrow(run, schema)


def decode_lines(data: bytes) -> list[str]:
    """Plain text extractor: the lines of a UTF-8 file."""
    return data.decode("utf-8").split("\n")


def decode_words(data: bytes) -> list[list[str]]:
    """Stand-in for a character recogniser: the words of a UTF-8 file by line."""
    return [line.split(" ") for line in data.decode("utf-8").split("\n")]


PLAIN_EXTRACTORS: dict[str, Extractor] = {"ocr": decode_words, "text": decode_lines}


# ------------------------------------------------------------------- embedding
def embed(
    table: DataFrame,
    model_factory: Callable[[], Callable[[list[str]], np.ndarray]],
    *,
    text: str = "text",
    vector: str = "vector",
    dim: int,
    batch_size: int = fv.EMBED_BATCH,
    error: str | None = None,
) -> DataFrame:
    """Add a ``vector`` column; the model is made once per task and fed in batches.

    With ``error``, a column of that name tells why a text got no vector (NULL, if it got one). A
    batch that fails is halved until the bad text is alone, so its neighbours keep their
    vectors; a model that cannot be made fails every text. Without ``error`` the first failure ends the job.
    """
    kind = "array<float>" if error is None else "vector array<float>, error string"

    def checked(model: Callable[[list[str]], np.ndarray], texts: list[str]) -> np.ndarray:
        part = np.asarray(model(texts), dtype=np.float32)
        if part.shape != (len(texts), dim):
            raise ValueError(f"the model must return vectors of dimension {dim}")
        return part

    def halved(model: Callable[[list[str]], np.ndarray], texts: list[str]) -> list[tuple[np.ndarray | None, str | None]]:
        try:
            return [(row, None) for row in checked(model, texts)]
        except Exception as problem:  # noqa: BLE001 - every failure belongs to a row
            if len(texts) == 1:
                return [(None, str(problem) or type(problem).__name__)]
            middle = len(texts) // 2
            return halved(model, texts[:middle]) + halved(model, texts[middle:])

    def unmade(problem: Exception) -> Callable[[list[str]], np.ndarray]:
        def fail(texts: list[str]) -> np.ndarray:
            raise problem

        return fail

    @F.arrow_udf(kind)
    def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        try:
            model = model_factory()
        except Exception as problem:  # noqa: BLE001
            if error is None:
                raise
            model = unmade(problem)
        for batch in batches:
            starts = range(0, len(batch), batch_size)
            texts = (batch.slice(k, batch_size).fill_null("").to_pylist() for k in starts)  # one batch of the model at a time
            if error is None:
                vectors = np.empty((len(batch), dim), np.float32)
                for k, part in zip(starts, texts, strict=True):
                    vectors[k : k + batch_size] = checked(model, part)
                yield blocks.list_array(vectors, np.float32)
                continue
            done = [row for part in texts for row in halved(model, part)]
            vectors = pa.array([v for v, _ in done], pa.list_(pa.float32()))
            yield pa.StructArray.from_arrays([vectors, pa.array([e for _, e in done], pa.string())], names=["vector", "error"])

    if error is None:
        return table.withColumn(vector, once(encode)(text))
    kept = [c for c in table.columns if c not in (vector, error)]
    both = table.select(*kept, once(encode)(text).alias("_embedded"))
    return both.select(*kept, F.col("_embedded.vector").alias(vector), F.col("_embedded.error").alias(error))


def hashed_tokens(dim: int = 64) -> Callable[[], Callable[[list[str]], np.ndarray]]:
    """Test stand-in for an embedding model: unit-length counts of hashed words.

    It carries no meaning; it exists so that the jobs around a model can be run
    and checked without one.
    """

    def factory() -> Callable[[list[str]], np.ndarray]:
        def encode(texts: list[str]) -> np.ndarray:
            words = [[w for w in text.lower().split(" ") if w] for text in texts]
            counts = np.zeros((len(texts), dim))
            flat = [w for row in words for w in row]
            if flat:
                codes, unique = pd.factorize(np.array(flat, dtype=object))
                slots = np.array([int(hashlib.md5(w.encode()).hexdigest()[:4], 16) % dim for w in unique])
                owner = np.repeat(np.arange(len(texts)), [len(row) for row in words])
                np.add.at(counts, (owner, slots[codes]), 1.0)
            norm = np.sqrt((counts * counts).sum(axis=1, keepdims=True))
            return (counts / np.where(norm == 0, 1.0, norm)).astype(np.float32)

        return encode

    return factory


# ------------------------------------------------------------------ generation
class _Calls:
    """At most ``limit`` calls at a time, each with its own time limit.

    A call that is late is given up: its place is free at once, and what it may return
    later is not looked at. Calls wait for a free place, so a slow model holds back its
    task instead of piling up work.
    """

    def __init__(self, limit: int, seconds: float):
        self.limit, self.seconds = limit, seconds

    def run(self, calls: list[Callable[[], str]]) -> list[str | Exception]:
        results: list[str | Exception] = [TimeoutError()] * len(calls)
        done: queue.SimpleQueue = queue.SimpleQueue()
        due: dict[int, float] = {}
        waiting = collections.deque(range(len(calls)))

        def work(number: int) -> None:
            try:
                done.put((number, calls[number]()))
            except Exception as error:  # noqa: BLE001
                done.put((number, error))

        while waiting or due:
            while waiting and len(due) < self.limit:
                number = waiting.popleft()
                due[number] = time.monotonic() + self.seconds
                threading.Thread(target=work, args=(number,), daemon=True).start()
            try:
                number, result = done.get(timeout=max(0.0, min(due.values()) - time.monotonic()))
                if due.pop(number, None) is not None:
                    results[number] = result
            except queue.Empty:
                for number in [n for n, at in due.items() if at <= time.monotonic()]:
                    del due[number]
                    results[number] = TimeoutError(f"no answer within {self.seconds:g} s")
        return results


def generate(
    prompts: DataFrame,
    models: Generators,
    *,
    key_required: tuple[str, ...] = ("google",),
    batch_size: int = fv.EMBED_BATCH,
    seconds: float | None = None,
    in_flight: int = 8,
) -> DataFrame:
    """Add ``answer`` to rows with ``prompt``, ``provider`` and ``has_key``.

    A model takes a list of prompts. If it fails on a batch, each prompt of it is tried
    alone, so that failures and missing keys become answers one row at a time.

    With ``seconds``, every call is one prompt and may take so long; a task has ``in_flight`` calls under
    way, and models have to stand that. A late call gives the fixed error text and delays
    nothing beyond its limit.
    """
    schema = T.StructType([*prompts.schema.fields, T.StructField("answer", T.StringType())])

    def called(made: dict[str, Generator], provider: str, texts: list[str]) -> list[str]:
        found = list(made[provider](texts))
        if len(found) != len(texts):
            raise ValueError(f"{len(found)} answers for {len(texts)} prompts")
        return [fv.NO_MODEL_ANSWER if answer is None else answer for answer in found]

    def failed(provider: str, error: Exception) -> str:
        return fv.GENERATION_FAILED.format(provider=provider, error=error)

    def ask(made: dict[str, Generator], provider: str, texts: list[str]) -> list[str]:
        try:
            return called(made, provider, texts)
        except Exception as error:  # noqa: BLE001 - every failure becomes an answer
            if len(texts) > 1:
                return [answer for text in texts for answer in ask(made, provider, [text])]
            return [failed(provider, error)]

    def ask_in_time(made: dict[str, Generator], jobs: list[tuple[str, str]]) -> list[str]:
        calls = [lambda p=provider, t=text: called(made, p, [t])[0] for provider, text in jobs]
        found = _Calls(in_flight, seconds).run(calls)
        return [failed(p, x) if isinstance(x, Exception) else x for (p, _), x in zip(jobs, found, strict=True)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        made = _made(models)
        for batch in batches:
            answers: list = [None] * len(batch)
            waiting: dict[str, list[int]] = {}
            for row, (provider, has_key) in enumerate(zip(batch["provider"], batch["has_key"], strict=True)):
                if provider in key_required and not has_key:
                    answers[row] = fv.MISSING_KEY
                else:
                    waiting.setdefault(provider, []).append(row)
            texts = batch["prompt"].tolist()
            if seconds is not None:
                jobs = [(provider, row) for provider, places in waiting.items() for row in places]
                for (_, row), answer in zip(jobs, ask_in_time(made, [(p, texts[row]) for p, row in jobs]), strict=True):
                    answers[row] = answer
                waiting = {}
            for provider, places in waiting.items():
                for start in range(0, len(places), batch_size):
                    part = places[start : start + batch_size]
                    for row, answer in zip(part, ask(made, provider, [texts[k] for k in part]), strict=True):
                        answers[row] = answer
            yield batch.assign(answer=answers)

    return prompts.mapInPandas(run, schema)
