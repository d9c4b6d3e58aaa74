"""Whitening components of embeddings by shifted CholeskyQR.

The distinct vectors, centred, are the rows of a tall matrix A that is never
held anywhere. A pass sends every row through triangular solves with the factors found so
far and adds up the Gram matrix of the results; its Cholesky factor is the next one. The first Gram
matrix is shifted, so that the factor exists whatever the condition of A; after two
or three passes the rows are orthonormal to double precision and A = Q R with R
the product of the factors. The singular values and right vectors of R are those of A. Only
d x d matrices (d: the dimension) reach the driver.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.session import materialise

SCALE = 256
#: Larger entries are clamped, so that they fit a long.
_MOST = 2.0**62
_CHUNK = 1 << 20
_KINDS = (np.int16, np.int32, np.int64)
_UNIT = np.finfo(np.float64).eps / 2
_PASSES = 5


def integers(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows whose vector has ``dim`` finite entries, and those vectors in steps of 1/256."""
    lengths = np.asarray(column.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False))
    rows = np.flatnonzero(lengths == dim)
    flat = column.take(pa.array(rows)).flatten().cast(pa.float64())
    values = flat.to_numpy(zero_copy_only=False).reshape(len(rows), dim)  # NULL entries are NaN
    fine = np.isfinite(values).all(axis=1)
    with np.errstate(over="ignore"):
        steps = np.floor(np.clip(values[fine] * SCALE, -_MOST, _MOST))
    return rows[fine], steps.astype(np.int64)


def pack(matrix: np.ndarray) -> list[pa.Array]:
    """Vectors as bytes, each in the smallest of three widths; equal vectors have equal bytes."""
    out, most = [], np.maximum(matrix.max(axis=1), ~matrix.min(axis=1)) if matrix.size else np.empty(0, np.int64)
    low = -1
    for kind in _KINDS:
        high = np.iinfo(kind).max
        part = np.ascontiguousarray(matrix[(most > low) & (most <= high)].astype(kind))
        low = high
        if len(part):
            places = np.arange(len(part) + 1, dtype=np.int32) * (part.shape[1] * part.itemsize)
            out.append(pa.Array.from_buffers(pa.binary(), len(part), [None, pa.py_buffer(places), pa.py_buffer(part)]))
    return out


def unpack(column: pa.Array, dim: int) -> np.ndarray:
    """The inverse of ``pack``, in any order of rows."""
    sizes = np.asarray(pa.compute.binary_length(column).to_numpy(zero_copy_only=False))
    parts = []
    for kind in _KINDS:
        rows = np.flatnonzero(sizes == dim * np.dtype(kind).itemsize)
        if len(rows):
            whole = column.take(pa.array(rows))
            start = int(np.frombuffer(whole.buffers()[1], np.int32, 1, whole.offset * 4)[0])
            data = np.frombuffer(whole.buffers()[2], np.uint8)[start : start + len(rows) * dim * np.dtype(kind).itemsize]
            parts.append(data.view(kind).reshape(len(rows), dim).astype(np.int64))
    return np.concatenate(parts) if parts else np.empty((0, dim), np.int64)


class Centre:
    """Count and sums of the fit list; differences are exact as long as they fit a long."""

    def __init__(self, n: int, sums: list[int]):
        self.n, self.sums = n, sums

    def differences(self, x: np.ndarray) -> np.ndarray:
        """n x - S, as longs or else as Python's integers."""
        most = self.n * int(np.abs(x).max(initial=0)) + max((abs(s) for s in self.sums), default=0)
        if most < 2**62:
            return self.n * x - np.array(self.sums, np.int64)
        return self.n * x.astype(object) - np.array(self.sums, object)

    def centred(self, x: np.ndarray) -> np.ndarray:
        return self.differences(x).astype(np.float64) / self.n

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sum of squares of n x - S; None where it does not fit a long."""
        parts = self.differences(x)
        most = int(np.abs(parts).max(initial=0))
        if parts.dtype != object and most * most * max(1, parts.shape[1]) < 2**63:
            return (parts * parts).sum(axis=1).tolist()
        sums = [sum(v * v for v in row) for row in parts.tolist()]
        return [s if s < 2**63 else None for s in sums]


def solve(rows: np.ndarray, factor: np.ndarray) -> np.ndarray:
    """Rows times the inverse of an upper triangular factor, by forward substitution."""
    out = np.empty_like(rows)
    for k in range(factor.shape[0]):
        out[:, k] = (rows[:, k] - out[:, :k] @ factor[:k, k]) / factor[k, k]
    return out


def _chunks(batches, dim: int):
    most = max(1, _CHUNK // dim)
    for batch in batches:
        for low in range(0, batch.num_rows, most):
            yield unpack(batch.column(0).slice(low, most), dim)


def _gram(fit: DataFrame, dim: int, width: int, change: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """Sum over the fit list of the outer products of changed rows. Every task adds up its own
    rows; the sums meet entry by entry."""
    i, j = np.triu_indices(width)

    def partial(batches):
        total = np.zeros((width, width))
        for x in _chunks(batches, dim):
            rows = change(x)
            total += rows.T @ rows
        yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(total[i, j])], names=["i", "j", "v"])

    out = np.zeros((width, width))
    for row in fit.mapInArrow(partial, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect():
        out[row.i, row.j] = out[row.j, row.i] = row.v
    return out


def _centre(fit: DataFrame, dim: int) -> Centre:
    """Exact count (as entry ``dim``) and sums of the fit list."""

    def partial(batches):
        sums, n = [0] * dim, 0
        for x in _chunks(batches, dim):
            small = int(np.abs(x).max(initial=0)) * max(1, len(x)) < 2**62
            found = (x if small else x.astype(object)).sum(axis=0)
            sums, n = [a + int(b) for a, b in zip(sums, found, strict=True)], n + len(x)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(dim + 1, dtype=np.int32)), pa.array([*sums, n], pa.decimal128(38, 0))], names=["i", "v"])

    rows = fit.mapInArrow(partial, "i int, v decimal(38,0)").groupBy("i").agg(F.sum("v").alias("v")).collect()
    found = {r.i: int(r.v) for r in rows}
    return Centre(found.get(dim, 0), [found.get(k, 0) for k in range(dim)])


def cholesky(gram: np.ndarray, shift: float = 0.0) -> np.ndarray:
    """Upper factor of the Gram matrix; the shift grows until there is one."""
    step = max(shift, np.trace(gram) * len(gram) * _UNIT, np.finfo(np.float64).tiny * 2**60)
    while True:
        try:
            return np.linalg.cholesky(gram + shift * np.eye(len(gram))).T
        except np.linalg.LinAlgError:
            shift, step = step, step * 10


def triangular_factor(fit: DataFrame, dim: int, centre: Centre) -> np.ndarray | None:
    """R of the centred fit list, from repeated passes; None if all vectors are equal."""
    factors: list[np.ndarray] = []
    product = np.eye(dim)
    for nth in range(_PASSES):
        held = list(factors)

        def change(x, held=held):
            rows = centre.centred(x)
            for factor in held:
                rows = solve(rows, factor)
            return rows

        gram = _gram(fit, dim, dim, change)
        if not factors and not gram.any():
            return None
        shift = 11 * (centre.n * dim + dim * (dim + 1)) * _UNIT * np.trace(gram) if nth == 0 else 0.0
        factors.append(cholesky(gram, shift))
        product = factors[-1] @ product
        # directions without any spread stay near zero; all others are orthonormal in the end
        spread = np.flatnonzero(np.diag(gram) > 0.5)
        off = np.abs(gram[np.ix_(spread, spread)] - np.eye(len(spread))).max(initial=0)
        if nth and off < 100 * dim * _UNIT:
            break
    return product


def whiten(vectors: DataFrame, components: int = 4, id: str = "vec_id", column: str = "embedding") -> DataFrame:
    """Whitened coordinates of every vector along the first ``components`` directions.

    An entry c becomes the integer x = floor(256 c). The covariance is that of the distinct
    x vectors (the fit list, n of them), with divisor n. Returns one row per
    remaining row and component: ``vec_id`` (the id), ``component`` (1: the largest eigenvalue),
    ``n``, ``deviation`` (exact sum of the squares of n x - S; NULL if it does not fit a long),
    ``whitened, explained`` (share of the trace), ``identity_error`` (largest entry of the
    whitened fit list's covariance minus the identity).

    Rows with a NULL vector, a NULL, NaN or infinite entry, or another length than the most
    frequent one (of equally frequent ones the shorter) are left out. Repeated vectors count once and give
    equal rows. With fewer dimensions there are fewer components. A component without
    spread (fewer distinct vectors than components, constant entries) has ``whitened`` NULL
    and ``explained`` 0, and the error is that of the others (NULL without any). Entries beyond 2^62
    are clamped. Ids may be NULL or repeated. An empty table gives an empty table; other columns are not read.
    """
    base = vectors.select(F.col(id).alias("vec_id"), F.col(column).alias("vector"))
    schema = T.StructType(
        [
            T.StructField("vec_id", base.schema["vec_id"].dataType),
            T.StructField("component", T.IntegerType()),
            T.StructField("n", T.LongType()),
            T.StructField("deviation", T.LongType()),
            T.StructField("whitened", T.DoubleType()),
            T.StructField("explained", T.DoubleType()),
            T.StructField("identity_error", T.DoubleType()),
        ]
    )
    sized = base.where("size(vector) > 0").groupBy(F.size("vector").alias("dim")).count()
    first = sized.orderBy(F.desc("count"), "dim").first()
    if first is None:
        return base.sparkSession.createDataFrame([], schema)
    dim = first.dim
    components = min(components, dim)

    def packed(batches):
        for batch in batches:
            for array in pack(integers(batch.column(0), dim)[1]):
                yield pa.RecordBatch.from_arrays([array], names=["x"])

    fit = materialise(base.select("vector").mapInArrow(packed, "x binary").distinct(), "fit")
    centre = _centre(fit, dim)
    if not centre.n:
        return base.sparkSession.createDataFrame([], schema)
    factor = triangular_factor(fit, dim, centre)
    _, spreads, right = np.linalg.svd(np.zeros((dim, dim)) if factor is None else factor)
    live = spreads[:components] > spreads[0] * dim * 64 * _UNIT
    signs = np.sign(right[np.arange(components), np.abs(right[:components]).argmax(axis=1)])
    directions = (right[:components] * signs[:, None])[live].T * (np.sqrt(centre.n) / spreads[:components][live])
    explained = np.where(live, spreads[:components] ** 2 / max(float((spreads**2).sum()), np.finfo(np.float64).tiny), 0.0)

    error = None
    if live.any():
        width = int(live.sum())
        sums = _gram(fit, dim, width + 1, lambda x: np.hstack([centre.centred(x) @ directions, np.ones((len(x), 1))])) / centre.n
        covariance = sums[:width, :width] - np.outer(sums[width, :width], sums[width, :width])
        error = float(np.abs(covariance - np.eye(width)).max())

    def project(batches):
        most = max(1, _CHUNK // dim)
        for whole in batches:
            for low in range(0, whole.num_rows, most):
                batch = whole.slice(low, most)
                rows, x = integers(batch.column(1), dim)
                whitened = np.full((len(rows), components), np.nan)
                whitened[:, live] = centre.centred(x) @ directions
                deviation = np.repeat(np.array(centre.deviations(x), object), components)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(pa.array(np.repeat(rows, components))),
                        pa.array(np.tile(np.arange(1, components + 1, dtype=np.int32), len(rows))),
                        pa.array(np.full(len(rows) * components, centre.n)),
                        pa.array(deviation, pa.int64()),
                        pa.array(whitened.ravel(), mask=np.tile(~live, len(rows))),
                        pa.array(np.tile(explained, len(rows))),
                        pa.array([error] * (len(rows) * components), pa.float64()),
                    ],
                    names=schema.fieldNames(),
                )

    return base.mapInArrow(project, schema)
