"""The registry and counters of it, kept by streams.

What a stream has to remember per key is in Spark's state store: RocksDB files
with Bloom filters that are merged in the background, of which a micro-batch opens those that may hold its
keys. The tables themselves are written only, one part per micro-batch, and never read by
the stream; readers see a part once its batch has been committed.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from docloom.operators.registry import registry_rows
from docloom.session import materialise
from docloom.sources import commits


def first_seen(uploads: DataFrame, order: list[str], known: DataFrame | None = None) -> DataFrame:
    """Stream of the rows whose ``filename`` comes for the first time; of equal names in a micro-batch
    the first by ``order``, then by the other columns.

    ``known`` is a stream of names that are registered already. A file without a name is left out.
    """
    stamp = F.current_timestamp()  # one value for a micro-batch, also when it is run again
    rest = [c for c in uploads.columns if c != "filename" and c not in order]
    rows = uploads.where(F.col("filename").isNotNull()).select("filename", F.lit(True).alias("is_new"), F.struct(*order, *rest).alias("row"))
    if known is not None:
        empty = F.lit(None).cast(rows.schema["row"].dataType)
        rows = rows.unionByName(known.select("filename", F.lit(False).alias("is_new"), empty.alias("row")))
    first = F.min(F.struct("stamp", "is_new", "row")).alias("first")
    seen = rows.withColumn("stamp", stamp).groupBy("filename").agg(first, F.max("stamp").alias("last"))
    # every name that a batch touches has the batch's stamp as its last one
    new = seen.where((F.col("first.stamp") == F.col("last")) & F.col("first.is_new"))
    return new.select("filename", "first.row.*").select(*uploads.columns)


def query_id(batch: DataFrame) -> str:
    """The streaming query a micro-batch belongs to; it lives as long as its checkpoint."""
    return batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId") or "stream"


def add_batch(batch: DataFrame, batch_id: int, path: str) -> None:
    """One micro-batch as one part. A batch that is run again has the same id, so it counts once."""
    commits.add_rows(batch, path, f"{query_id(batch)}-{batch_id}", batch_id)


def start_registry(
    uploads: DataFrame,
    order: list[str],
    path: str,
    checkpoint: str,
    *,
    known: DataFrame | None = None,
    available_now: bool = True,
) -> StreamingQuery:
    """Insert unknown files into the registry at ``path``.

    What is known is in the state, which goes with the checkpoint; a new checkpoint for a registry
    that exists needs its names as ``known`` (see ``known_files``).
    """
    rows = registry_rows(first_seen(uploads, order, known))
    writer = rows.writeStream.outputMode("update").foreachBatch(partial(add_batch, path=path)).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def read_registry(spark: SparkSession, path: str) -> DataFrame:
    found = commits.read_rows(spark, path)
    if found is None:
        raise ValueError(f"there is no registry at {path}")
    return found


def compact_registry(spark: SparkSession, path: str) -> None:
    """Merge the parts of many micro-batches into one, while the stream goes on."""
    commits.compact_rows(spark, path)


def known_files(spark: SparkSession, path: str) -> DataFrame:
    """The names of a registry as a stream, to start a new checkpoint from."""
    names = read_registry(spark, path).select("filename")
    folder = materialise(names, "known").inputFiles()[0].rsplit("/", 1)[0]
    return spark.readStream.schema(names.schema).parquet(folder)


def start_counters(events: DataFrame, by: str, path: str, checkpoint: str, *, available_now: bool = True) -> StreamingQuery:
    """Count events per value of ``by`` as they come. A batch writes the new totals of the values
    it touched, so a batch that is run again changes nothing. ``path`` belongs to the checkpoint."""
    counted = events.groupBy(F.col(by).alias("status")).agg(F.count("*").alias("n"))

    def add(batch: DataFrame, batch_id: int) -> None:
        add_batch(batch.withColumn("batch_id", F.lit(batch_id).cast("bigint")), batch_id, path)

    writer = counted.writeStream.outputMode("update").foreachBatch(add).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


COUNTERS = T.StructType([T.StructField("status", T.StringType()), T.StructField("n", T.LongType())])


def read_counters(spark: SparkSession, path: str) -> DataFrame:
    """``status, n``: the last total of every value."""
    found = commits.read_rows(spark, path)
    if found is None:
        return spark.createDataFrame([], COUNTERS)
    return found.groupBy("status").agg(F.max_by("n", "batch_id").alias("n"))
