"""Inverted-list vector index as a partitioned table with atomic appends.

An index is three folders: ``rows`` and ``lists`` (rows and radius of every list), each
with one sub-folder per append, and ``commits``, which says which of them count.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom import fixed_values as fv
from docloom.operators import blocks
from docloom.session import materialise, once, work_path
from docloom.sources import commits

MAX_CENTROID_FLOATS = 32_000_000


@dataclass
class IvfIndex:
    """``rows`` is ``id, vector, …, list_id`` partitioned by list; ``sizes`` is
    ``list_id, n_rows``. ``centroids`` and ``radii`` have one entry per list; their size
    is checked when the index is made."""

    rows: DataFrame
    sizes: DataFrame
    centroids: np.ndarray
    radii: np.ndarray
    dim: int
    version: commits.Version = commits.Version()


def suggested_nlist(n_rows: int, dim: int) -> int:
    """About the square root of the row count, and no more than ``train_centroids`` takes."""
    return max(1, min(int(n_rows**0.5), MAX_CENTROID_FLOATS // dim))


def train_centroids(rows: DataFrame, dim: int, nlist: int = fv.NLIST, seed: int = 42, sample: float | None = None) -> np.ndarray:
    """k-means centres of all rows, from randomly chosen first centres; the mean if there
    is one list. Fewer distinct rows than lists give fewer lists.

    ``sample``, a share of the rows, restricts the fit on request. It decides where the
    lists lie, never which rows are indexed. Centroids are sent to all tasks, so
    ``nlist * dim`` is limited, and more is an error.
    """
    if nlist < 1 or nlist * dim > MAX_CENTROID_FLOATS:
        raise ValueError(f"nlist must be positive and nlist * dim must not exceed {MAX_CENTROID_FLOATS}")
    if sample is not None:
        rows = rows.sample(sample, seed)
    if nlist == 1:
        means = rows.select(F.posexplode("vector")).groupBy("pos").agg(F.avg(F.col("col").cast("double")).alias("x")).collect()
        centre = np.zeros((1, dim))
        for pos, x in means:
            centre[0, pos] = x
        return centre
    training = rows.select(array_to_vector(F.col("vector").cast("array<double>")).alias("features"))
    model = KMeans(k=nlist, seed=seed, maxIter=10, initMode="random").fit(training)
    return np.array(model.clusterCenters(), dtype=np.float64).reshape(-1, dim)


def assign_lists(rows: DataFrame, centroids: np.ndarray, dim: int) -> DataFrame:
    """Add ``list_id`` (nearest centroid, ties to the smaller list) and ``to_centroid``."""

    @F.arrow_udf("list_id int, to_centroid double")
    def nearest_list(vectors: pa.Array) -> pa.Array:
        points = blocks.matrix(vectors, dim)
        chosen = np.array(
            blocks.by_slices(points, centroids, lambda _, squared: np.round(squared, blocks.DECIMALS).argmin(axis=1)), int
        )
        distance = np.sqrt(((points - centroids[chosen]) ** 2).sum(axis=1))
        columns = [pa.array(chosen.astype(np.int32)), pa.array(distance)]
        return pa.StructArray.from_arrays(columns, names=["list_id", "to_centroid"])

    return rows.withColumn("_list", once(nearest_list)("vector")).select(
        *rows.columns, F.col("_list.list_id").alias("list_id"), F.col("_list.to_centroid").alias("to_centroid")
    )


def write_rows(assigned: DataFrame, path: str) -> None:
    """Write index rows, one folder per list.

    The rebalance hint groups rows by list so that a list is a few good-sized
    files, and splits a list that is much larger than the others.
    """
    assigned.hint("rebalance", "list_id").write.mode("error").partitionBy("list_id").parquet(path)


def build_index(
    rows: DataFrame,
    *,
    dim: int,
    nlist: int = fv.NLIST,
    path: str | None = None,
    seed: int = 42,
    centroids: np.ndarray | None = None,
    sample: float | None = None,
    written: bool = False,
) -> IvfIndex:
    """Fit (unless ``centroids`` are given), assign and write a new index.

    ``rows`` are read more than once, so they are written first, unless they are a
    ``written`` table already. An index that exists is not built again; see
    ``append_to_index``. A build that was interrupted has committed nothing and may be repeated.
    """
    spark = rows.sparkSession
    path = path or work_path(spark, "index")
    before = commits.read_version(spark, f"{path}/commits")
    if before.parts:
        raise ValueError(f"there is an index at {path} already; append to it")
    rows = rows if written else materialise(rows, "index-rows")
    if centroids is None:
        centroids = train_centroids(rows, dim, nlist, seed, sample)
    table = pa.table({"list_id": pa.array(np.arange(len(centroids)), pa.int32()), "centroid": blocks.list_array(centroids, np.float64)})
    folder = commits.new_part("centroids")
    spark.createDataFrame(table).coalesce(1).write.parquet(f"{path}/centroids/{folder}")
    version = _add(assign_lists(rows, centroids, dim), path, "build", before, facts={"centroids": folder, "dim": str(dim)})
    if version.facts["centroids"] != folder:  # another build was first, and its lists are the index
        return open_index(spark, path, version)
    return _opened(spark, path, version, centroids, dim)


def _add(
    assigned: DataFrame,
    path: str,
    commit_id: str,
    before: commits.Version,
    replaces: tuple[str, ...] = (),
    facts: dict[str, str] | None = None,
) -> commits.Version:
    """Write rows once, in their final place, then what they add to rows and radius of every list,
    and commit both together. Whatever stops before the commit changes nothing."""
    spark = assigned.sparkSession
    part = commits.new_part(commit_id)
    write_rows(assigned, f"{path}/rows/part={part}")
    there = commits.read_or_none(spark, f"{path}/rows/part={part}", schema=T.StructType([assigned.schema["to_centroid"], assigned.schema["list_id"]]))
    if there is None:  # no rows, no files
        there = spark.createDataFrame([], "to_centroid double, list_id int")
    summary = there.groupBy("list_id").agg(F.count("*").alias("n_rows"), F.max("to_centroid").alias("radius"))
    summary.coalesce(1).write.mode("error").parquet(f"{path}/lists/part={part}")
    return commits.commit(spark, f"{path}/commits", commit_id, part, after=before, replaces=replaces, facts=facts)


def open_index(spark: SparkSession, path: str, version: commits.Version | None = None) -> IvfIndex:
    """Open a written index at its current version, or at one that was read before. It goes on
    to show that version, whatever is appended. Only one row per list and commit reaches the driver."""
    version = version or commits.read_version(spark, f"{path}/commits")
    if not version.parts:
        raise ValueError(f"there is no index at {path}")
    dim = int(version.facts["dim"])
    table = spark.read.parquet(f"{path}/centroids/{version.facts['centroids']}").orderBy("list_id").toArrow()
    return _opened(spark, path, version, blocks.matrix(table["centroid"], dim), dim)


def _opened(spark: SparkSession, path: str, version: commits.Version, centroids: np.ndarray, dim: int) -> IvfIndex:
    added = commits.read_parts(spark, f"{path}/lists", version)
    lists = added.groupBy("list_id").agg(F.sum("n_rows").alias("n_rows"), F.max("radius").alias("radius"))
    spread = lists.toArrow()
    radii = np.zeros(len(centroids))
    radii[spread["list_id"].to_numpy()] = spread["radius"].to_numpy()
    rows = commits.read_parts(spark, f"{path}/rows", version)
    return IvfIndex(rows, lists.select("list_id", "n_rows"), centroids, radii, dim, version)


def append_to_index(rows: DataFrame, path: str, append_id: str | None = None) -> IvfIndex:
    """Add rows to an index without refitting it.

    Rows become visible all at once or not at all. An append with an ``append_id`` that was committed
    before changes nothing, so a job that does not know whether it got through may
    simply be repeated. Appends at the same time do not disturb each other.
    """
    spark = rows.sparkSession
    index = open_index(spark, path)
    if append_id is not None and append_id in index.version.commit_ids:
        return index
    assigned = assign_lists(rows, index.centroids, index.dim)
    have, want = ({(f.name, f.dataType.simpleString()) for f in schema} for schema in (index.rows.schema, assigned.schema))
    if have != want:
        raise ValueError("index rows do not match the schema of the existing index")
    version = _add(assigned, path, append_id or commits.new_part("append"), index.version)
    return _opened(spark, path, version, index.centroids, index.dim)


def compact_index(spark: SparkSession, path: str, min_parts: int = 2) -> IvfIndex:
    """The parts of many appends as one; nothing is computed anew.

    Readers of an older version keep its files. If another compaction of the same parts
    was first, this one has no effect; appends of the meantime stay.
    """
    index = open_index(spark, path)
    if len(index.version.parts) < min_parts:
        return index
    version = _add(index.rows, path, commits.new_part("compact"), index.version, replaces=index.version.parts)
    return _opened(spark, path, version, index.centroids, index.dim)


def index_size(index: IvfIndex) -> DataFrame:
    """Rows per list; lists nothing fell into are reported with 0."""
    spark = index.rows.sparkSession
    lists = spark.range(len(index.centroids)).select(F.col("id").cast("int").alias("list_id"))
    return lists.join(index.sizes, "list_id", "left").select("list_id", F.coalesce("n_rows", F.lit(0)).alias("n_rows"))
