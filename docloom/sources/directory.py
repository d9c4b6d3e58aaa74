"""A stored directory of a table's order, for many windows over it.

Keys are sorted once into ranges of a stated size and written; beside them one
row per range tells its bounds, its rows and how many rows come before it. The number of ranges
grows with the table, their size does not. A window is found from that small table and
the keys of the one or two ranges at its ends, and read as a range of keys.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

ROWS_PER_RANGE = 1_000_000


@dataclass
class PageDirectory:
    """``keys`` is ``key, range``; ``ranges`` is ``range, low, high, n_rows, start``."""

    keys: DataFrame
    ranges: DataFrame


def build_directory(table: DataFrame, key: str, path: str, rows_per_range: int = ROWS_PER_RANGE) -> PageDirectory:
    """Write the directory of ``table`` by its unique ``key``. Rows without a key have no place.

    It shows the table as it is now; after a change build another one at a new path.
    """
    if rows_per_range < 1:
        raise ValueError("a range has one row at least")
    keys = table.select(F.col(key).alias("key")).where("key IS NOT NULL")
    ranges = max(1, -(-keys.count() // rows_per_range))
    ranged = keys.repartitionByRange(ranges, "key").sortWithinPartitions("key")
    ranged.withColumn("range", F.spark_partition_id()).write.mode("error").parquet(f"{path}/keys")
    stored = table.sparkSession.read.parquet(f"{path}/keys")
    bounds = stored.groupBy("range").agg(F.min("key").alias("low"), F.max("key").alias("high"), F.count("*").alias("n_rows"))
    # a million rows of the table are one row here
    before = F.sum("n_rows").over(Window.partitionBy(F.lit(0)).orderBy("range")) - F.col("n_rows")
    bounds.withColumn("start", before).coalesce(1).write.mode("error").parquet(f"{path}/ranges")
    return open_directory(table.sparkSession, path)


def open_directory(spark: SparkSession, path: str) -> PageDirectory:
    return PageDirectory(spark.read.parquet(f"{path}/keys"), spark.read.parquet(f"{path}/ranges"))


def read_window(directory: PageDirectory, table: DataFrame, key: str, limit: int, offset: int = 0) -> DataFrame:
    """Rows ``offset`` … ``offset + limit`` of ``table`` in order of ``key``, not sorted.

    Two keys reach the driver; the rows are read with a filter on the key that
    reaches the scan. A window beyond the end is empty.
    """
    if limit < 1 or offset < 0:
        raise ValueError("limit must be positive and offset must not be negative")
    met = (F.col("start") < offset + limit) & (F.col("start") + F.col("n_rows") > offset)
    ends = directory.ranges.where(met).agg(F.min("range").alias("first"), F.max("range").alias("last")).first()
    if ends is None or ends["first"] is None:
        return table.where(F.lit(False))
    outer = directory.ranges.where(F.col("range").isin([ends["first"], ends["last"]]))
    starts = {r.range: r.start for r in outer.select("range", "start").collect()}
    start = F.when(F.col("range") == ends["first"], starts[ends["first"]]).otherwise(starts[ends["last"]])
    at = F.row_number().over(Window.partitionBy("range").orderBy("key")) - 1 + start
    inside = directory.keys.where(F.col("range").isin(list(starts))).select("key", at.alias("at")).where(F.col("at").between(offset, offset + limit - 1))
    bounds = inside.agg(F.min("key").alias("low"), F.max("key").alias("high")).first()
    return table.where(F.col(key).between(F.lit(bounds.low), F.lit(bounds.high)))
