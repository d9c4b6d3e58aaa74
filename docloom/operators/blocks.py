"""Arrow and numpy helpers for one block of vectors inside a Spark task."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa

# Distances are compared at this many decimals, so that the order in which floats
# happen to be summed never decides between equally near rows; the id does.
DECIMALS = 9
_CELLS = 2_000_000
# A search holds a few arrays of so many numbers at a time, however many rows are equally near.
_COMPARED = 500_000


def matrix(column: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    """Arrow list column -> (rows, dim) doubles; NULL or wrong-sized vectors raise."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if len(column) == 0:
        return np.empty((0, dim))
    sizes = column.value_lengths()
    if column.null_count or not (sizes.to_numpy(zero_copy_only=False) == dim).all():
        raise ValueError(f"every vector must have dimension {dim}")
    values = column.flatten()
    if values.null_count:
        raise ValueError("vectors must not hold NULL values")
    return values.to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def ids(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    return column.to_numpy() if isinstance(column, pa.ChunkedArray) else column.to_numpy(zero_copy_only=False)


def list_array(rows: list[np.ndarray] | np.ndarray, dtype: type) -> pa.ListArray:
    """Rows of numbers -> Arrow list column, without a Python object per number."""
    sizes = np.full(len(rows), rows.shape[1]) if isinstance(rows, np.ndarray) else np.array([len(r) for r in rows], int)
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    flat = rows.ravel() if isinstance(rows, np.ndarray) else np.concatenate([np.empty(0, dtype), *rows])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.ascontiguousarray(flat, dtype=dtype)))


def ranks(values: np.ndarray) -> np.ndarray:
    return np.unique(values, return_inverse=True)[1]


def first_copies(row_ids: np.ndarray, vectors: np.ndarray, keep: int) -> np.ndarray:
    """Positions of the ``keep`` smallest ids of every set of identical vectors.

    No question can use more of them, so dropping the rest of the block changes no
    result, however many copies a vector has.
    """
    order = np.argsort(row_ids, kind="stable")
    rows = np.ascontiguousarray(vectors[order])
    as_bytes = rows.view(np.dtype((np.void, rows.dtype.itemsize * rows.shape[1]))).ravel()
    group = np.unique(as_bytes, return_inverse=True)[1]
    by_group = np.argsort(group, kind="stable")
    return order[by_group[_position_in_group(group[by_group]) < keep]]


def _position_in_group(sorted_keys: np.ndarray) -> np.ndarray:
    return np.arange(len(sorted_keys)) - np.searchsorted(sorted_keys, sorted_keys, side="left")


def best(question: np.ndarray, row_ids: np.ndarray, distance: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k smallest (distance, id) of every question."""
    order = np.lexsort((ranks(row_ids), distance, question))
    return order[_position_in_group(question[order]) < k]


def squared_distances(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """All squared distances by matrix product; exact to about 1e-14 of the norms."""
    return (
        np.einsum("ij,ij->i", left, left)[:, None]
        + np.einsum("ij,ij->i", right, right)[None, :]
        - 2.0 * (left @ right.T)
    )


def by_slices(
    points: np.ndarray, centroids: np.ndarray, function: Callable[[slice, np.ndarray], list | np.ndarray]
) -> list:
    """``function(rows, distances to all centroids)`` for slices of the points, so that
    many lists do not make a batch's distance matrix large. Results are concatenated."""
    step = max(1, _CELLS // max(1, len(centroids)))
    out: list = []
    for start in range(0, len(points), step):
        part = slice(start, start + step)
        out.extend(function(part, squared_distances(points[part], centroids)))
    return out


def nearest_in_block(
    question_ids: np.ndarray,
    questions: np.ndarray,
    row_ids: np.ndarray,
    rows: np.ndarray,
    k: int,
    exclude_same_id: bool,
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(question position, row position, distance) of each question's k best rows.

    The matrix product only picks candidates, with slack for its rounding error;
    the distances that count are summed from differences.
    """
    wanted = k + 1 if exclude_same_id else k
    kept = first_copies(row_ids, rows, wanted)
    row_ids, rows = row_ids[kept], rows[kept]
    if len(rows) == 0 or len(questions) == 0:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
    row_norm = float(np.einsum("ij,ij->i", rows, rows).max())
    out_q, out_r, out_d = [], [], []
    step = max(1, _COMPARED // len(rows))
    for start in range(0, len(questions), step):
        block = questions[start : start + step]
        rough = squared_distances(block, rows)
        nth = min(wanted, len(rows)) - 1
        limit = np.partition(rough, nth, axis=1)[:, nth]
        slack = 4 * 10.0**-DECIMALS + 1e-12 * (np.einsum("ij,ij->i", block, block) + row_norm)
        q, r = np.nonzero(rough <= (limit + slack)[:, None])
        if exclude_same_id:
            other = question_ids[start + q] != row_ids[r]
            q, r = q[other], r[other]
        d = np.empty(len(q))
        part = max(1, _COMPARED // rows.shape[1])
        for low in range(0, len(q), part):
            cut = slice(low, low + part)
            difference = block[q[cut]] - rows[r[cut]]
            d[cut] = np.round((difference * difference).sum(axis=1), DECIMALS)
        top = best(q, row_ids[r], d, k)
        out_q.append(q[top] + start)
        out_r.append(kept[r[top]])
        out_d.append(d[top])
    return np.concatenate(out_q), np.concatenate(out_r), np.concatenate(out_d)
