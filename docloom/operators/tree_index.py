"""Vector index with two levels of centroids, for more lists than fit into a task.

Cells are few and known everywhere; every cell has lists of its own, whose centroids are a
table that is only ever joined by cell. Cells are fitted on a bounded sample of rows, the lists of
a cell on a bounded sample of its rows; every row is indexed. A question goes to the nearest cells (the beam),
meets their lists, and searches the nearest of those.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom import fixed_values as fv
from docloom.operators import blocks
from docloom.operators.index import assign_lists
from docloom.operators.search import keep_nearest, search_probes
from docloom.session import cut_before_shuffle, materialise, once, work_path
from docloom.sources import commits

#: Rows that a cell's lists, or the cells themselves, are fitted on, for each of them.
SAMPLE_PER_CENTRE = 64
#: Sample and centres of one fit, in floats.
FIT_FLOATS = 32_000_000
ROUNDS = 8
ROWS_PER_BLOCK = 20_000
BLOCK_FLOATS = 16_000_000


@dataclass
class TreeIndex:
    """``rows`` is ``id, vector, …, list_id, cell`` partitioned by cell; ``lists`` is ``cell, list_id, n_rows,
    centroid``; ``cells`` has one centroid per cell."""

    rows: DataFrame
    lists: DataFrame
    cells: np.ndarray
    dim: int
    version: commits.Version


def branches(nlist: int, dim: int) -> int:
    """Cells, and lists per cell, for so many lists."""
    if nlist < 1:
        raise ValueError("an index has one list at least")
    branch = int(np.ceil(np.sqrt(nlist)))
    if branch * dim > FIT_FLOATS:
        raise ValueError(f"{nlist} lists of dimension {dim} need a third level")
    return branch


def fit(points: np.ndarray, k: int, seed: int) -> np.ndarray:
    """k-means of a bounded number of points; fewer different points give fewer centres."""
    rng = np.random.default_rng(seed)
    different = np.unique(points, axis=0)
    centres = different[rng.permutation(len(different))[:k]]
    for _ in range(ROUNDS):
        home = np.array(blocks.by_slices(points, centres, lambda _, squared: squared.argmin(axis=1)), int)
        sums = np.zeros_like(centres)
        np.add.at(sums, home, points)
        held = np.bincount(home, minlength=len(centres))
        centres = np.where(held[:, None] > 0, sums / np.maximum(held, 1)[:, None], centres)
    return centres


def _sample(rows: DataFrame, key: list[str], most: int) -> DataFrame:
    """At most so many rows of every key, chosen by a hash of the id and cut before the shuffle."""
    cut_before_shuffle(rows.sparkSession, most)
    place = F.row_number().over(Window.partitionBy(*key).orderBy(F.xxhash64("id"), "id"))
    return rows.withColumn("_place", place).where(F.col("_place") <= most).drop("_place")


def _most(branch: int, dim: int) -> int:
    return max(branch, min(SAMPLE_PER_CENTRE * branch, FIT_FLOATS // dim))


def _fit_lists(celled: DataFrame, branch: int, target: float, dim: int, seed: int) -> DataFrame:
    """``cell, place, centroid``: the lists of every cell, no more than its rows call for."""
    sizes = celled.groupBy("cell").agg(F.least(F.lit(branch), F.ceil(F.count("*") / F.lit(target))).cast("int").alias("k"))
    sample = _sample(celled.select("id", "cell", "vector"), ["cell"], _most(branch, dim)).join(F.broadcast(sizes), "cell")

    def lists(table: pa.Table) -> pa.Table:
        cell, k = table["cell"][0].as_py(), table["k"][0].as_py()
        centres = fit(blocks.matrix(table["vector"], dim), k, seed + cell)
        places = pa.array(np.arange(len(centres)), pa.int32())
        return pa.table({"cell": pa.array([cell] * len(centres), pa.int32()), "place": places, "centroid": blocks.list_array(centres, np.float64)})

    return sample.groupBy("cell").applyInArrow(lists, "cell int, place int, centroid array<double>")


def _blocked(rows: DataFrame, lists: DataFrame, dim: int) -> tuple[DataFrame, DataFrame]:
    """Rows (or questions) with a block of their cell, and the cell's lists once for each of its blocks."""
    per_block = max(1, min(ROWS_PER_BLOCK, BLOCK_FLOATS // dim))
    counts = materialise(rows.groupBy("cell").agg(F.ceil(F.count("*") / per_block).alias("blocks")), "cell-blocks")
    left = rows.join(F.broadcast(counts), "cell").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks"))).drop("blocks")
    every = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)).alias("block")
    return left, lists.join(F.broadcast(counts), "cell").select("cell", every, "list_id", "centroid")


def _assign(celled: DataFrame, lists: DataFrame, dim: int) -> DataFrame:
    """Add ``list_id``, the nearest list of the row's cell (ties to the smaller one)."""
    left, right = _blocked(celled, lists, dim)
    schema = T.StructType([*celled.schema.fields, T.StructField("list_id", T.LongType())])
    names = schema.fieldNames()

    def nearest(rows: pa.Table, centres: pa.Table) -> pa.Table:
        if not rows.num_rows:
            return rows.select([n for n in names if n != "list_id"]).append_column("list_id", pa.array([], pa.int64()))
        centres = centres.sort_by("list_id")
        points = blocks.matrix(rows["vector"], dim)
        known = blocks.matrix(centres["centroid"], dim)
        home = blocks.by_slices(points, known, lambda _, squared: np.round(squared, blocks.DECIMALS).argmin(axis=1))
        found = pa.array(blocks.ids(centres["list_id"])[np.array(home, int)], pa.int64())
        return rows.select([n for n in names if n != "list_id"]).append_column("list_id", found)

    return left.groupBy("cell", "block").cogroup(right.groupBy("cell", "block")).applyInArrow(nearest, schema)


def _in_cells(rows: DataFrame, cells: np.ndarray, dim: int) -> DataFrame:
    return assign_lists(rows, cells, dim).withColumnRenamed("list_id", "cell").drop("to_centroid")


def build_tree_index(
    rows: DataFrame, *, dim: int, nlist: int, path: str | None = None, seed: int = 42, written: bool = False
) -> TreeIndex:
    """Index ``rows`` (``id, vector`` and any other columns) in about ``nlist`` lists.

    Cells and lists are fitted on at most ``SAMPLE_PER_CENTRE`` rows for each centre, chosen by
    a hash of the id; all rows are indexed. A cell has at most as many lists as there are cells, so
    one that holds much more than its share has longer lists, which are searched in blocks.
    """
    spark = rows.sparkSession
    path = path or work_path(spark, "tree-index")
    before = commits.read_version(spark, f"{path}/commits")
    if before.parts:
        raise ValueError(f"there is an index at {path} already; append to it")
    rows = rows if written else materialise(rows, "index-rows")
    branch, total = branches(nlist, dim), rows.count()
    if not total:
        raise ValueError("an index needs rows to be fitted on")
    share = min(1.0, 2.0 * _most(branch, dim) / total)
    sample = rows.select("id", "vector") if share == 1.0 else rows.select("id", "vector").where(F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1 << 30)) < int(share * (1 << 30)))
    # one fit, of a bounded number of rows
    points = blocks.matrix(sample.orderBy(F.xxhash64("id"), "id").limit(_most(branch, dim)).toArrow()["vector"], dim)
    cells = fit(points, branch, seed)
    celled = materialise(_in_cells(rows, cells, dim), "celled")
    found = _fit_lists(celled, branch, total / nlist, dim, seed)
    lists = found.select("cell", (F.col("cell").cast("long") * branch + F.col("place")).alias("list_id"), "centroid")
    centres = commits.new_part("centroids")
    table = pa.table({"cell": pa.array(np.arange(len(cells)), pa.int32()), "centroid": blocks.list_array(cells, np.float64)})
    spark.createDataFrame(table).coalesce(1).write.parquet(f"{path}/cells/{centres}")
    lists.write.parquet(f"{path}/lists/{centres}")
    _add(celled, spark.read.parquet(f"{path}/lists/{centres}"), path, "build", before, dim, {"centroids": centres, "dim": str(dim)})
    return open_tree_index(spark, path)


def _add(celled: DataFrame, lists: DataFrame, path: str, commit_id: str, before: commits.Version, dim: int, facts: dict | None = None) -> None:
    spark, part = celled.sparkSession, commits.new_part(commit_id)
    placed = _assign(celled, lists, dim)
    placed.hint("rebalance", "cell").sortWithinPartitions("cell", "list_id").write.partitionBy("cell").parquet(f"{path}/rows/part={part}")
    written = commits.read_or_none(spark, f"{path}/rows/part={part}")
    counted = spark.createDataFrame([], "list_id long, n_rows long") if written is None else written.groupBy("list_id").agg(F.count("*").alias("n_rows"))
    counted.write.parquet(f"{path}/sizes/part={part}")
    commits.commit(spark, f"{path}/commits", commit_id, part, after=before, facts=facts)


def open_tree_index(spark: SparkSession, path: str, version: commits.Version | None = None) -> TreeIndex:
    version = version or commits.read_version(spark, f"{path}/commits")
    if not version.parts:
        raise ValueError(f"there is no index at {path}")
    dim, centres = int(version.facts["dim"]), version.facts["centroids"]
    cells = spark.read.parquet(f"{path}/cells/{centres}").orderBy("cell").toArrow()
    sizes = commits.read_parts(spark, f"{path}/sizes", version).groupBy("list_id").agg(F.sum("n_rows").alias("n_rows"))
    lists = spark.read.parquet(f"{path}/lists/{centres}").join(sizes, "list_id")
    rows = commits.read_parts(spark, f"{path}/rows", version)
    return TreeIndex(rows, lists, blocks.matrix(cells["centroid"], dim), dim, version)


def append_to_tree_index(rows: DataFrame, path: str, append_id: str | None = None) -> TreeIndex:
    """Add rows without refitting; as with ``append_to_index`` an id makes it repeatable."""
    spark = rows.sparkSession
    index = open_tree_index(spark, path)
    if append_id is not None and append_id in index.version.commit_ids:
        return index
    celled = materialise(_in_cells(rows, index.cells, index.dim), "celled")
    lists = spark.read.parquet(f"{path}/lists/{index.version.facts['centroids']}")
    _add(celled, lists, path, append_id or commits.new_part("append"), index.version, index.dim)
    return open_tree_index(spark, path)


def choose_tree_lists(questions: DataFrame, index: TreeIndex, nprobe: int, beam: int) -> DataFrame:
    """``qid, vector, list_id, cell``: the ``nprobe`` nearest lists of the ``beam`` nearest cells."""
    if nprobe < 1 or beam < 1:
        raise ValueError("nprobe and beam must be at least 1")
    cells, dim = index.cells, index.dim

    @F.arrow_udf("array<int>")
    def nearest_cells(vectors: pa.Array) -> pa.Array:
        def first(_: slice, squared: np.ndarray) -> np.ndarray:
            return np.argsort(np.round(squared, blocks.DECIMALS), axis=1, kind="stable")[:, :beam]

        return blocks.list_array(blocks.by_slices(blocks.matrix(vectors, dim), cells, first), np.int32)

    asked = questions.select("qid", "vector").withColumn("cells", once(nearest_cells)("vector"))
    asked = materialise(asked.select("qid", "vector", F.explode("cells").alias("cell")), "beams")
    left, right = _blocked(asked.withColumnRenamed("qid", "id"), index.lists, dim)
    kind = questions.schema["qid"].dataType
    schema = T.StructType([T.StructField("qid", kind), T.StructField("id", T.LongType()), T.StructField("l2_sq", T.DoubleType()), T.StructField("cell", T.IntegerType())])

    def nearest(table: pa.Table, lists: pa.Table) -> pa.Table:
        empty = pa.table({"qid": table["id"].slice(0, 0), "id": pa.array([], pa.int64()), "l2_sq": pa.array([], pa.float64()), "cell": pa.array([], pa.int32())})
        if not table.num_rows or not lists.num_rows:
            return empty
        found = blocks.nearest_in_block(
            blocks.ids(table["id"]), blocks.matrix(table["vector"], dim), blocks.ids(lists["list_id"]), blocks.matrix(lists["centroid"], dim), nprobe, False
        )
        q, r, d = found
        cell = pa.array([lists["cell"][0].as_py()] * len(q), pa.int32())
        return pa.table({"qid": table["id"].take(pa.array(q)), "id": lists["list_id"].take(pa.array(r)), "l2_sq": pa.array(d), "cell": cell})

    hits = left.groupBy("cell", "block").cogroup(right.groupBy("cell", "block")).applyInArrow(nearest, schema)
    chosen = keep_nearest(hits, nprobe).select("qid", F.col("id").alias("list_id"), "cell")
    return chosen.join(asked.select("qid", "vector").dropDuplicates(["qid"]), "qid")


def nearest_by_tree(questions: DataFrame, index: TreeIndex, k: int = fv.TOP_K, nprobe: int = fv.NPROBE, beam: int = 4, *, exclude_same_id: bool = False) -> DataFrame:
    """k nearest rows among the probed lists. Only the folders of their cells are read; lists and
    questions meet in bounded blocks."""
    probes = materialise(choose_tree_lists(questions, index, nprobe, beam), "probes")
    cells = [r.cell for r in probes.select("cell").distinct().collect()]  # no more than there are cells
    rows = index.rows.where(F.col("cell").isin(cells)).select("id", "vector", "list_id")
    hits = search_probes(probes.select("qid", "vector", "list_id"), rows, index.lists.select("list_id", "n_rows"), k, index.dim, exclude_same_id)
    return keep_nearest(hits, k)
