"""File listings, the HTML corpus and windows over it."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docloom import fixed_values as fv
from docloom.functions.files import relative_path
from docloom.session import materialise

CORPUS_COLUMNS = ("id", "content_html")
_LISTING_TASKS = "spark.sql.sources.parallelPartitionDiscovery.parallelism"


def scan_files(spark: SparkSession, root: str, glob: str = fv.SCAN_GLOB, content: bool = False) -> DataFrame:
    """``filename, path, length, modified`` of all files below ``root`` matching ``glob``.

    ``filename`` is relative to ``root``. Contents are not selected, so they are not
    read; with ``content`` they come in a column of that name, by the same listing.
    """
    found = _binary_files(spark, root, glob)
    plain = F.regexp_replace("path", "^file:/+", "/")
    return found.select(
        relative_path(plain, root.removeprefix("file://")).alias("filename"),
        "path",
        "length",
        F.col("modificationTime").alias("modified"),
        *(["content"] if content else []),
    )


def read_objects(spark: SparkSession, root: str, glob: str = "*") -> DataFrame:
    """``filename, content`` of all files below ``root``."""
    plain = F.regexp_replace("path", "^file:/+", "/")
    return _binary_files(spark, root, glob).select(
        relative_path(plain, root.removeprefix("file://")).alias("filename"), "content"
    )


def _binary_files(spark: SparkSession, root: str, glob: str) -> DataFrame:
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob)
    # folders are listed as the reader is made, by default in a task each up to 10,000
    before = spark.conf.get(_LISTING_TASKS)
    spark.conf.set(_LISTING_TASKS, str(min(int(before), 4 * spark.sparkContext.defaultParallelism)))
    try:
        return reader.load(root)
    finally:
        spark.conf.set(_LISTING_TASKS, before)


def read_corpus(spark: SparkSession, candidates: list[str], columns: dict[str, str] | None = None) -> DataFrame:
    """``id, content_html`` from the first candidate path that exists.

    ``columns`` maps the two names to the table's own. A table without them is an
    error; so is a list without any existing path.
    """
    columns = columns or {name: name for name in CORPUS_COLUMNS}
    for path in candidates:
        try:
            table = spark.read.parquet(path)
        except AnalysisException as error:
            if error.getCondition() == "PATH_NOT_FOUND":
                continue
            raise
        missing = [columns[name] for name in CORPUS_COLUMNS if columns[name] not in table.columns]
        if missing:
            raise ValueError(f"corpus lacks the required columns: {', '.join(missing)}")
        return table.select(
            F.col(columns["id"]).cast("string").alias("id"), F.col(columns["content_html"]).alias("content_html")
        )
    raise FileNotFoundError("no corpus found at any of the given paths")


def corpus_window(corpus: DataFrame, key: str, limit: int, offset: int = 0) -> DataFrame:
    """Rows ``offset`` … ``offset + limit`` in order of the unique ``key``.

    Only keys are sorted, into ranges; the ranges are counted, and just those that hold
    the window's ends are numbered. So neither keys nor texts meet in one task, however
    deep the window lies. The rows are then picked by key range.
    """
    if limit < 1 or offset < 0:
        raise ValueError("limit must be positive and offset must not be negative")
    keys = corpus.select(key).where(F.col(key).isNotNull())
    ranged = materialise(keys.repartitionByRange(key).withColumn("_range", F.spark_partition_id()), "window-keys")
    sizes = ranged.groupBy("_range").count()
    before = F.sum("count").over(Window.orderBy("_range")) - F.col("count")
    places = sizes.select("_range", before.alias("_before")).where(
        (F.col("_before") < offset + limit) & (F.col("_before") + F.col("count") > offset)
    )
    within = ranged.join(F.broadcast(places), "_range")
    at = F.row_number().over(Window.partitionBy("_range").orderBy(key)) + F.col("_before") - 1
    ends = within.select(key, at.alias("_at")).where(F.col("_at").between(offset, offset + limit - 1)).agg(F.min(key).alias("low"), F.max(key).alias("high"))
    return corpus.where(F.col(key).between(ends.select("low").scalar(), ends.select("high").scalar()))
