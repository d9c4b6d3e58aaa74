"""Session settings, table access and the shared work folder."""

from __future__ import annotations

import contextlib
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.optimizeSkewsInRebalancePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    STATE_STORE: "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    # a micro-batch writes what it changed, not the files of the whole state
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


def build_session(app_name: str, master: str | None = None, **extra: str) -> SparkSession:
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def read_table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{directory}/{name}.parquet")


def spread(table: DataFrame, key: str) -> DataFrame:
    """Spread a table that comes in fewer splits than there are cores, such as one
    small file, before heavy work on its rows. A large table is left as it is.

    ``table`` has to be a plain scan (with narrow changes at most), because its splits
    are counted; on a shuffled table the count would run it. Rows move by the hash of
    ``key``, so a task that is run again sees the same rows.
    """
    cores = table.sparkSession.sparkContext.defaultParallelism
    return table.repartition(cores, key) if table.rdd.getNumPartitions() < cores else table


WORK_FOLDER = "spark.checkpoint.dir"


def use_work_folder(spark: SparkSession, folder: str) -> None:
    """Name the work folder of a local session that has none; on a cluster the session
    itself has to name a folder that all executors reach."""
    if not spark.conf.get(WORK_FOLDER, None):
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise RuntimeError(f"set {WORK_FOLDER} to a folder all executors can reach")
        spark.conf.set(WORK_FOLDER, folder)


def work_path(spark: SparkSession, label: str) -> str:
    """A fresh folder below the shared folder named by ``spark.checkpoint.dir``."""
    base = spark.conf.get(WORK_FOLDER, None)
    if not base:
        raise RuntimeError(f"set {WORK_FOLDER} to a folder all executors can reach")
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Used where a result feeds several later stages, so that it is computed once
    and a lost executor costs a re-read instead of a recomputation.
    """
    spark = df.sparkSession
    path = work_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def cut_before_shuffle(spark: SparkSession, n: int) -> None:
    """Let Spark cut ranked groups to ``n`` rows before the shuffle, also for large ``n``."""
    setting = "spark.sql.optimizer.windowGroupLimitThreshold"
    if 0 <= int(spark.conf.get(setting)) < n:
        spark.conf.set(setting, str(n))


@contextlib.contextmanager
def keyed_state(spark: SparkSession) -> Iterator[None]:
    """Streams that start meanwhile can hold lists and timers per key: Spark's default store cannot.

    A stream copies the session's settings as it starts and keeps the store of its checkpoint, so the
    session gets its own setting back.
    """
    before = spark.conf.get(STATE_STORE)
    spark.conf.set(STATE_STORE, SETTINGS[STATE_STORE])
    try:
        yield
    finally:
        spark.conf.set(STATE_STORE, before)


def once(udf):
    """Keep the optimizer from copying an expensive function into a filter, which
    would run it twice per row."""
    return udf.asNondeterministic()
