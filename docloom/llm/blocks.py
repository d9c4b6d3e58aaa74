"""Documents in packed blocks, and questions from blocks to hash buckets.

Several operators have to look up hashes of all documents against hashes of all
others. They move packed arrays instead of a row per hash: documents are packed once
into blocks of a few megabytes (compressed Arrow), each block sends the distinct
hashes it holds to hash buckets, a bucket compares what all blocks sent and answers
each block. A hash that is very frequent reaches its bucket once per block, not once
per document, and the number of buckets grows with the corpus, so that neither a block
nor a bucket grows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.llm.words import group_edges
from docloom.session import materialise

BLOCK_BYTES = 8 << 20
#: Hashes that a bucket should hold.
BUCKET_KEYS = 1 << 20
REQUEST = "bucket int, block long, keys binary, data binary"
NO_ID = np.iinfo(np.int64).max


def added(schema: T.StructType, *fields: tuple[str, T.DataType]) -> T.StructType:
    """The schema with further fields; a column of the same name (Spark does not
    distinguish case) is replaced."""
    names = {name.lower() for name, _ in fields}
    return T.StructType([f for f in schema.fields if f.name.lower() not in names] + [T.StructField(n, k, True) for n, k in fields])


def with_columns(batch: pa.RecordBatch | pa.Table, columns: dict[str, pa.Array], names: Iterable[str]) -> pa.RecordBatch:
    """The columns ``names`` in order, from ``columns`` if there, else from the batch."""
    picked = {n: columns[n] if n in columns else batch.column(n) for n in names}
    return pa.RecordBatch.from_arrays([c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in picked.values()], names=list(picked))


def text_sizes(column: pa.Array) -> np.ndarray:
    import pyarrow.compute as pc

    return pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def cut_batches(batches: Iterable[pa.RecordBatch], text: str, most: int) -> Iterator[pa.RecordBatch]:
    """Batches of about ``most`` bytes of text; one longer text is a batch of its own."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        sizes = text_sizes(batch.column(text))
        low = 0
        for row, bytes_ in enumerate(sizes.tolist()):
            if size and size + bytes_ > most:
                if row > low:
                    held.append(batch.slice(low, row - low))
                yield _joined(held)
                held, size, low = [], 0, row
            size += bytes_ + 64
        if batch.num_rows > low:
            held.append(batch.slice(low))
    if held:
        yield _joined(held)


def _joined(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    if len(batches) == 1:
        return batches[0]
    return pa.Table.from_batches(batches).combine_chunks().to_batches()[0]


def dump(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", 3))) as writer:
        writer.write_batch(batch)
    return sink.getvalue().to_pybytes()


def load(payload) -> pa.RecordBatch:
    reader = pa.ipc.open_stream(payload.as_buffer() if isinstance(payload, pa.Scalar) else payload)
    return _joined([*reader])


def pack(docs: DataFrame, text: str = "text", block_bytes: int = BLOCK_BYTES, count: Callable[[pa.RecordBatch], int] | None = None) -> DataFrame:
    """Documents as blocks (``block, n_bytes, n_units, payload``), written to the shared
    folder; ``count`` gives the units of a block.

    No row moves: each scan task packs what it reads. Since the blocks are written,
    every later step and every repeated task sees the same ones.
    """

    def blocks(batches):
        base = TaskContext.get().partitionId() << 32
        for number, batch in enumerate(cut_batches(batches, text, block_bytes)):
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([base + number]),
                    pa.array([int(text_sizes(batch.column(text)).sum()) + batch.num_rows]),
                    pa.array([count(batch) if count else 0]),
                    pa.array([dump(batch)], pa.binary()),
                ],
                names=["block", "n_bytes", "n_units", "payload"],
            )

    return materialise(docs.mapInArrow(blocks, "block long, n_bytes long, n_units long, payload binary"), "blocks")


def bucket_count(blocks: DataFrame, keys_per_byte: float) -> int:
    """Buckets for the hashes of all blocks; a plain count, which grows with the corpus."""
    size = blocks.agg(F.sum("n_bytes")).first()[0] or 0
    return max(8, int(size * keys_per_byte / BUCKET_KEYS) + 1)


def squeeze(values: np.ndarray) -> bytes:
    """Numbers as compressed byte planes: bytes that are mostly zero take next to nothing."""
    planes = np.ascontiguousarray(values.view(np.uint8).reshape(len(values), values.dtype.itemsize).T)
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unsqueeze(data, kind) -> np.ndarray:
    raw, size = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8), np.dtype(kind).itemsize
    planes = raw.reshape(size, len(raw) // size)
    return np.ascontiguousarray(planes.T).view(kind).ravel()


def squeeze_sorted(values: np.ndarray) -> bytes:
    return squeeze(np.diff(values, prepend=values.dtype.type(0)))


def unsqueeze_sorted(data, kind) -> np.ndarray:
    return np.cumsum(unsqueeze(data, kind), dtype=kind)


def requests(
    block: int,
    buckets: np.ndarray,
    keys: np.ndarray,
    data: np.ndarray | None = None,
    pack_keys: Callable[[np.ndarray], bytes] = np.ndarray.tobytes,
    pack_data: Callable[[np.ndarray], bytes] = np.ndarray.tobytes,
) -> pa.RecordBatch:
    """Rows for the buckets. ``buckets`` is sorted; keys (and data) go along with it."""
    edges = group_edges(buckets)
    cuts = np.append(edges, len(buckets))
    pieces = [(pack_keys(keys[a:b]), None if data is None else pack_data(data[a:b])) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    return pa.RecordBatch.from_arrays(
        [
            pa.array(buckets[edges].astype(np.int32)),
            pa.array(np.full(len(edges), block, np.int64)),
            pa.array([p[0] for p in pieces], pa.binary()),
            pa.array([p[1] for p in pieces], pa.binary()),
        ],
        names=["bucket", "block", "keys", "data"],
    )


def arrays(column: pa.ChunkedArray | pa.Array, kind, unpack: Callable = np.frombuffer) -> tuple[np.ndarray, np.ndarray]:
    """Packed arrays of all rows, one after the other, and the row of each value."""
    parts = [unpack(x.as_buffer(), kind) if x.is_valid else np.empty(0, kind) for x in column]
    sizes = np.array([len(p) for p in parts], np.int64)
    return (np.concatenate(parts) if parts else np.empty(0, kind)), np.repeat(np.arange(len(parts)), sizes)


def ask(blocks: DataFrame, function: Callable[[int, pa.RecordBatch], pa.RecordBatch]) -> DataFrame:
    """Requests of every block by itself."""

    def run(batches):
        for batch in batches:
            for block, payload in zip(batch.column("block").to_pylist(), batch.column("payload"), strict=True):
                yield function(block, load(payload))
                pa.default_memory_pool().release_unused()

    return blocks.select("block", "payload").mapInArrow(run, REQUEST)


def answer(asked: DataFrame, function: Callable[[pa.Table], pa.Table]) -> DataFrame:
    """What the buckets say: ``function`` gets all requests of one bucket and returns
    rows of the same form, addressed by ``block``."""
    return asked.groupBy("bucket").applyInArrow(lambda table: function(table).select(["bucket", "block", "keys", "data"]), REQUEST)


def revisit(blocks: DataFrame, answers: DataFrame, function: Callable, schema) -> DataFrame:
    """``function(block, documents, answers to the block)`` for every block."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        for block, payload in zip(left.column("block").to_pylist(), left.column("payload"), strict=True):
            out.append(function(block, load(payload), right))
            pa.default_memory_pool().release_unused()
        return pa.Table.from_batches(out)

    left = blocks.select("block", "payload").groupBy("block")
    return left.cogroup(answers.groupBy("block")).applyInArrow(run, schema)


def document_ids(batch: pa.RecordBatch, column: str) -> np.ndarray:
    """Ids as 64-bit integers; NULL counts as larger than every id."""
    ids = batch.column(column)
    return ids.cast(pa.int64()).fill_null(int(NO_ID)).to_numpy(zero_copy_only=False)
