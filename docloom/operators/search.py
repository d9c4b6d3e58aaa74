"""Nearest-neighbour search: exact, by index lists, and within one document.

Questions carry ``qid`` and ``vector``; rows carry ``id`` and ``vector``; hits are
``qid, id, l2_sq, rank`` (rank starts at 1, ties go to the smaller id). Searches in an
index also tell the ``list_id`` of every hit, which later narrows the read of its text.

Searches write the questions first, so that a model behind their vectors runs once, and
fetch them; the search itself runs when its result is used, unless the questions have to
be taken in several turns.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401 - used as pa.compute
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom import fixed_values as fv
from docloom.operators import blocks
from docloom.operators.index import IvfIndex, build_index, suggested_nlist
from docloom.session import cut_before_shuffle, materialise, once

# So many questions are sent to the tasks at a time.
MAX_BROADCAST_QUESTIONS = 10_000
MAX_BROADCAST_FLOATS = 16_000_000
# Rows and questions are copied to each other's blocks, so equal sizes copy least.
ROWS_PER_BLOCK = 20_000
QUESTIONS_PER_BLOCK = 20_000
BLOCK_FLOATS = 16_000_000
MAX_PENDING_HITS = 2_000_000


def _hit_schema(questions: DataFrame, rows: DataFrame, list_column: str | None = None) -> T.StructType:
    fields = [
        T.StructField("qid", questions.schema["qid"].dataType),
        T.StructField("id", rows.schema["id"].dataType),
        T.StructField("l2_sq", T.DoubleType()),
    ]
    if list_column is not None:
        fields.append(T.StructField("list_id", rows.schema[list_column].dataType))
    return T.StructType(fields)


def _arrow(columns: tuple[np.ndarray, ...], schema: T.StructType) -> pa.RecordBatch:
    names = schema.fieldNames()
    arrays = [
        pa.array(column, _arrow_type(field)) for column, field in zip(columns[: len(names)], schema, strict=True)
    ]
    return pa.RecordBatch.from_arrays(arrays, names=names)


def _arrow_type(field: T.StructField) -> pa.DataType:
    known = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string(), "double": pa.float64()}
    kind = field.dataType.simpleString()
    if kind not in known:
        raise TypeError(f"{field.name} must be bigint, int or string, not {kind}")
    return known[kind]


def keep_nearest(hits: DataFrame, k: int) -> DataFrame:
    """Rank the hits of each question and keep k.

    The ``rank <= k`` filter lets Spark cut every question to k rows before the
    shuffle as well as after it.
    """
    cut_before_shuffle(hits.sparkSession, k)
    order = Window.partitionBy("qid").orderBy("l2_sq", "id")
    return hits.withColumn("rank", F.row_number().over(order).cast("bigint")).where(F.col("rank") <= k)


def nearest(
    questions: DataFrame,
    rows: DataFrame,
    k: int = fv.TOP_K,
    *,
    dim: int,
    exclude_same_id: bool = False,
    max_broadcast_questions: int = MAX_BROADCAST_QUESTIONS,
) -> DataFrame:
    """Exact k nearest rows of every question: every question meets every row.

    Questions are sent to the tasks and the rows are scanned, with no shuffle of
    vectors. More than ``max_broadcast_questions`` are taken in turns of that many, each
    with a scan of its own, so the cost is that of all comparisons; for very many
    questions probe an index (``nearest_by_lists``) instead.
    """
    asked = materialise(questions.select("qid", "vector"), "questions")
    rows, schema = rows.select("id", "vector"), _hit_schema(questions, rows)
    fetched = _fetch(asked, _most(max_broadcast_questions, dim))
    if fetched is not None:
        return _scan(fetched, rows, k, dim, exclude_same_id, schema)
    return _in_turns(asked, rows, k, dim, exclude_same_id, schema, max_broadcast_questions)


def _most(limit: int, dim: int) -> int:
    return max(1, min(limit, MAX_BROADCAST_FLOATS // dim))


def _fetch(asked: DataFrame, most: int) -> pa.Table | None:
    """The (written) questions, if there are no more than ``most``: counted and read in one job."""
    found = asked.limit(most + 1).toArrow()
    return found if found.num_rows <= most else None


def _in_turns(
    asked: DataFrame,
    rows: DataFrame,
    k: int,
    dim: int,
    exclude_same_id: bool,
    schema: T.StructType,
    limit: int,
    list_column: str | None = None,
) -> DataFrame:
    """Scan ``rows`` once for every ``limit`` of the (written) questions."""
    turns = -(-asked.count() // _most(limit, dim))
    if turns <= 1:
        return _scan(asked.toArrow(), rows, k, dim, exclude_same_id, schema, list_column)
    held = materialise(rows, "rows")
    turn = F.pmod(F.xxhash64("qid"), F.lit(turns))
    parts = [
        materialise(_scan(asked.where(turn == number).toArrow(), held, k, dim, exclude_same_id, schema, list_column), "hits")
        for number in range(turns)
    ]
    return reduce(DataFrame.unionByName, parts)


def _scan(
    questions: pa.Table,
    rows: DataFrame,
    k: int,
    dim: int,
    exclude_same_id: bool,
    schema: T.StructType,
    list_column: str | None = None,
) -> DataFrame:
    """One pass over ``rows`` with all questions at hand.

    With ``list_column``, the questions' ``lists`` say which values of it each of them
    may search; other rows are filtered out at the scan.
    """
    for field in schema:
        _arrow_type(field)
    columns = ["id", "vector"]
    if questions.num_rows == 0:
        rows = rows.where(F.lit(False))
    askers: dict | None = None
    if list_column is not None:
        askers = {}
        for position, lists in enumerate(questions["lists"].to_pylist()):
            for value in lists:
                askers.setdefault(value, []).append(position)
        rows = rows.where(F.col(list_column).isin(list(askers)))
        columns.append(list_column)
    sent = rows.sparkSession.sparkContext.broadcast(
        (blocks.ids(questions["qid"]), blocks.matrix(questions["vector"], dim), askers)
    )

    def parts(homes: np.ndarray | None, n_rows: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(question positions, row positions) to be compared."""
        qids, _, by_list = sent.value
        if homes is None:
            yield np.arange(len(qids)), np.arange(n_rows)
            return
        values, group = np.unique(homes, return_inverse=True)
        for number, value in enumerate(values.tolist()):
            yield np.array(by_list[value]), np.flatnonzero(group == number)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        qids, vectors, _ = sent.value
        found: list[tuple[np.ndarray, ...]] = []
        pending = 0

        def reduce_found() -> None:
            joined = tuple(np.concatenate(parts) for parts in zip(*found, strict=True))
            top = blocks.best(*joined[:3], k)
            found[:] = [tuple(part[top] for part in joined)]

        for batch in batches:
            row_ids, matrix = blocks.ids(batch.column("id")), blocks.matrix(batch.column("vector"), dim)
            homes = None if list_column is None else blocks.ids(batch.column(list_column))
            for asking, held in parts(homes, len(row_ids)):
                q, r, d = blocks.nearest_in_block(
                    qids[asking], vectors[asking], row_ids[held], matrix[held], k, exclude_same_id
                )
                found.append((asking[q], row_ids[held][r], d, (row_ids if homes is None else homes)[held][r]))
                pending += len(q)
                if pending > MAX_PENDING_HITS:
                    reduce_found()
                    pending = 0
            if len(found) > 1:
                reduce_found()
                pending = 0
        if found:
            reduce_found()
            yield _arrow((qids[found[0][0]], *found[0][1:]), schema)

    return keep_nearest(rows.select(*columns).mapInArrow(search, schema), k)


def search_probes(
    probes: DataFrame, rows: DataFrame, sizes: DataFrame, k: int, dim: int, exclude_same_id: bool
) -> DataFrame:
    """Best rows of every probe (``qid, list_id, vector``) inside its list.

    A list is cut by hash into blocks of rows, and the probes of a list into blocks
    of questions; a task sees one block of each and returns at most k rows per
    question. A hot list, or a list everybody asks for, only means more blocks.

    The table of block counts has one row per list that is both held and asked for.
    It is written first, so Spark knows its real size when it joins it.
    """
    fitting = max(1, BLOCK_FLOATS // dim)
    per_question_block, per_row_block = min(QUESTIONS_PER_BLOCK, fitting), min(ROWS_PER_BLOCK, fitting)
    asked = probes.groupBy("list_id").agg(F.ceil(F.count("*") / per_question_block).alias("question_blocks"))
    held = sizes.select("list_id", F.ceil(F.col("n_rows") / per_row_block).alias("row_blocks"))
    counts = materialise(held.join(asked, "list_id"), "block-counts")

    def block_of(key: str, blocks_column: str):
        return F.pmod(F.xxhash64(key), F.col(blocks_column))

    def every_block(blocks_column: str):
        return F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(blocks_column) - 1))

    left = (
        probes.join(counts, "list_id")
        .withColumn("question_block", block_of("qid", "question_blocks"))
        .select(
            "list_id",
            "question_block",
            every_block("row_blocks").alias("row_block"),
            "qid",
            # Renamed, because questions and rows may come from one table.
            F.col("vector").alias("question_vector"),
        )
    )
    right = (
        rows.join(counts, "list_id")
        .withColumn("row_block", block_of("id", "row_blocks"))
        .select("list_id", every_block("question_blocks").alias("question_block"), "row_block", "id", "vector")
    )
    schema = _hit_schema(probes, rows, "list_id")
    for field in schema:
        _arrow_type(field)

    def search(questions: pa.Table, candidates: pa.Table) -> pa.Table:
        qids, row_ids = blocks.ids(questions["qid"]), blocks.ids(candidates["id"])
        q, r, d = blocks.nearest_in_block(
            qids,
            blocks.matrix(questions["question_vector"], dim),
            row_ids,
            blocks.matrix(candidates["vector"], dim),
            k,
            exclude_same_id,
        )
        homes = blocks.ids(candidates["list_id"])
        return pa.Table.from_batches([_arrow((qids[q], row_ids[r], d, homes[r]), schema)])

    key = ["list_id", "row_block", "question_block"]
    return left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(search, schema)


def choose_lists(questions: DataFrame, index: IvfIndex, nprobe: int = fv.NPROBE) -> DataFrame:
    """``qid, vector, lists``: per question the ``nprobe`` lists with the nearest centroids."""
    if nprobe < 1:
        raise ValueError("nprobe must be at least 1")
    centroids, dim = index.centroids, index.dim

    @F.arrow_udf("array<int>")
    def nearest_lists(vectors: pa.Array) -> pa.Array:
        def first(_: slice, squared: np.ndarray) -> np.ndarray:
            return np.argsort(np.round(squared, blocks.DECIMALS), axis=1, kind="stable")[:, :nprobe]

        return blocks.list_array(blocks.by_slices(blocks.matrix(vectors, dim), centroids, first), np.int32)

    return questions.select("qid", "vector", once(nearest_lists)("vector").alias("lists"))


def _one_row_per_list(chosen: DataFrame) -> DataFrame:
    return chosen.select("qid", "vector", F.explode("lists").alias("list_id"))


def nearest_by_lists(
    questions: DataFrame,
    index: IvfIndex,
    k: int = fv.TOP_K,
    nprobe: int = fv.NPROBE,
    *,
    exclude_same_id: bool = False,
    max_broadcast_questions: int = MAX_BROADCAST_QUESTIONS,
) -> DataFrame:
    """k nearest rows among the ``nprobe`` nearest lists; exact when all are probed.

    A moderate number of questions reads just the folders of their lists. More
    questions meet the lists in a shuffle.
    """
    chosen = materialise(choose_lists(questions, index, nprobe), "chosen")
    if chosen.count() <= _most(max_broadcast_questions, index.dim):
        schema = _hit_schema(questions, index.rows, "list_id")
        return _scan(chosen.toArrow(), index.rows, k, index.dim, exclude_same_id, schema, "list_id")
    hits = search_probes(_one_row_per_list(chosen), index.rows, index.sizes, k, index.dim, exclude_same_id)
    return keep_nearest(hits, k)


def nearest_pruned(
    questions: DataFrame,
    rows: DataFrame,
    k: int = fv.TOP_K,
    *,
    dim: int,
    exclude_same_id: bool = False,
    nlist: int | None = None,
    nprobe: int = fv.NPROBE,
    index: IvfIndex | None = None,
) -> DataFrame:
    """Exact search through an index, for rows that lie in clusters.

    The nearest lists are searched first. The k-th distance found there bounds the
    answer, and a further list can only matter if the distance to its centroid
    minus its radius is within that bound (triangle inequality). Only those lists
    are searched in the second pass. Where rows do not lie in clusters the bound
    excludes little, each question is shuffled to nearly every list, and ``nearest`` is
    the better way. Questions are stored once each, with the lists they still need.
    """
    if index is None:
        rows = materialise(rows.select("id", "vector"), "rows")
        n_rows = rows.count()
        if not n_rows:
            return nearest(questions, rows, k, dim=dim).withColumn("list_id", F.lit(None).cast("int"))
        index = build_index(rows, dim=dim, nlist=nlist or suggested_nlist(n_rows, dim), written=True)
    asked = materialise(choose_lists(questions, index, nprobe), "asked")
    first = materialise(
        search_probes(_one_row_per_list(asked), index.rows, index.sizes, k, dim, exclude_same_id), "first-hits"
    )
    bounds = (
        keep_nearest(first, k)
        .groupBy("qid")
        .agg(F.max("l2_sq").alias("bound"), F.count("*").alias("n"))
        .select("qid", F.when(F.col("n") >= k, F.col("bound")).alias("bound"))
    )
    centroids, radii = index.centroids, index.radii

    @F.arrow_udf("array<int>")
    def open_lists(vectors: pa.Array, searched: pa.Array, bound: pa.Array) -> pa.Array:
        reach = np.sqrt(bound.fill_null(np.inf).to_numpy(zero_copy_only=False))
        done = blocks.matrix(searched, len(searched[0]) if len(searched) else 0).astype(int)

        def still_open(part: slice, squared: np.ndarray) -> list[np.ndarray]:
            lowest = np.maximum(0.0, np.sqrt(np.maximum(squared, 0.0)) - radii[None, :])
            # The slack covers rounding in centroid distances and in the bound itself.
            within = lowest <= (reach[part] * (1 + 1e-6) + 1e-4)[:, None]
            np.put_along_axis(within, done[part], False, axis=1)
            return [np.flatnonzero(row) for row in within]

        return blocks.list_array(blocks.by_slices(blocks.matrix(vectors, dim), centroids, still_open), np.int32)

    left_over = asked.join(bounds, "qid", "left").select(
        "qid", "vector", once(open_lists)("vector", "lists", "bound").alias("lists")
    )
    second = search_probes(_one_row_per_list(materialise(left_over, "further")), index.rows, index.sizes, k, dim, exclude_same_id)
    return keep_nearest(first.unionByName(second), k)


def nearest_within(
    questions: DataFrame,
    rows: DataFrame,
    key: str,
    k: int = fv.TOP_K,
    *,
    dim: int,
    exclude_same_id: bool = False,
    max_broadcast_questions: int = MAX_BROADCAST_QUESTIONS,
) -> DataFrame:
    """Exact search restricted, per question, to rows with the same ``key``.

    Questions whose ``key`` is NULL search everything. The restriction comes before
    the top-k, as a filter at the scan or an equi-join on the key, so other documents
    are never compared.
    """
    schema = _hit_schema(questions, rows)
    questions = materialise(questions.select("qid", "vector", key), "questions")
    fetched = _fetch(questions, _most(max_broadcast_questions, dim))
    if fetched is not None:
        free = pa.compute.is_null(fetched[key])
        bound = fetched.filter(pa.compute.invert(free))
        lists = pa.array([[value] for value in bound[key].to_pylist()], pa.list_(fetched.schema.field(key).type))
        bound = pa.table({"qid": bound["qid"], "vector": bound["vector"], "lists": lists})
        keyed = rows.where(F.col(key).isNotNull()).select("id", "vector", F.col(key).alias("list_id"))
        within = _scan(bound, keyed, k, dim, exclude_same_id, schema, "list_id")
        if not pa.compute.any(free).as_py():
            return within
        return within.unionByName(_scan(fetched.filter(free), rows.select("id", "vector"), k, dim, exclude_same_id, schema))
    limited = questions.where(F.col(key).isNotNull()).select("qid", "vector", F.array(key).alias("lists"))
    keyed = rows.where(F.col(key).isNotNull()).select("id", "vector", F.col(key).alias("list_id"))
    if limited.count() <= _most(max_broadcast_questions, dim):
        within = _scan(limited.toArrow(), keyed, k, dim, exclude_same_id, schema, "list_id")
    else:
        sizes = keyed.groupBy("list_id").agg(F.count("*").alias("n_rows"))
        hits = search_probes(_one_row_per_list(limited), keyed, sizes, k, dim, exclude_same_id)
        within = keep_nearest(hits.drop("list_id"), k)
    everywhere = nearest(
        questions.where(F.col(key).isNull()),
        rows,
        k,
        dim=dim,
        exclude_same_id=exclude_same_id,
        max_broadcast_questions=max_broadcast_questions,
    )
    return within.unionByName(everywhere)


def hydrate(hits: DataFrame, texts: DataFrame, id_column: str = "id") -> DataFrame:
    """Bring ``filename`` and ``text`` to the hits; hits without text are dropped.

    The drop comes after the top-k, so a question may end with fewer than k hits.
    The hits are written first: the search then runs once, and Spark knows their real
    size when it decides whether they may be broadcast to the texts. If both sides have
    ``list_id``, only the lists that hold hits are read.
    """
    keys = ["id"] + [c for c in ("list_id",) if c in hits.columns and c in texts.columns]
    named = texts.select(F.col(id_column).alias("id"), *keys[1:], "filename", "text")
    # Every hit has a rank; Spark prunes partitions by a join only if the pruning side
    # looks filtered.
    ranked = materialise(hits, "hits").where(F.col("rank") > 0)
    return ranked.join(named, keys).where(F.length("text") > 0)
