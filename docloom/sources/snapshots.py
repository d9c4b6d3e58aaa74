"""Snapshots of processed tables: whole, or of the files that changed.

An incremental snapshot store keeps the files of a table one by one, each under the hash of its rows. A
snapshot is a manifest (which file, how many rows, which hashes, where its copy lies);
files that an earlier snapshot has are not copied again. A restored table is a part that a
commit makes current, so until then, and if it is never reached, readers see the old one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.session import materialise
from docloom.sources import commits


def _totals(code: Column) -> list[Column]:
    """The sum notices repeated rows, which cancel out in the xor."""
    return [
        F.count("*").alias("n_rows"),
        F.coalesce(F.bit_xor(code), F.lit(0)).cast("bigint").alias("hash_xor"),
        F.coalesce(F.sum(code.cast("decimal(38,0)")), F.lit(0)).cast("decimal(38,0)").alias("hash_sum"),
    ]


def fingerprint(table: DataFrame) -> DataFrame:
    """One row: ``n_rows`` and two hash totals that do not depend on row order."""
    return table.agg(*_totals(F.xxhash64(*sorted(table.columns))))


def write_snapshot(tables: dict[str, DataFrame], path: str) -> None:
    """Copy tables below a new folder, each with its manifest."""
    for name, table in tables.items():
        table.write.mode("error").parquet(f"{path}/{name}/data")
        written = table.sparkSession.read.parquet(f"{path}/{name}/data")
        fingerprint(written).coalesce(1).write.mode("error").parquet(f"{path}/{name}/manifest")


def restore_snapshot(spark: SparkSession, path: str, name: str, target: str) -> DataFrame:
    """Make the snapshot the current table at ``target``, if it is intact (see ``open_restored``)."""
    saved = spark.read.parquet(f"{path}/{name}/data")
    promised = spark.read.parquet(f"{path}/{name}/manifest")
    if fingerprint(saved).exceptAll(promised).head(1):
        raise ValueError(f"snapshot of {name} does not match its manifest")
    return _switch(spark, saved, target)


def _switch(spark: SparkSession, rows: DataFrame, target: str) -> DataFrame:
    """Write rows beside what is there, then commit them in its place."""
    before = commits.read_version(spark, f"{target}/commits")
    part = commits.new_part("restored")
    rows.write.mode("error").parquet(f"{target}/rows/part={part}")
    commits.commit(spark, f"{target}/commits", part, part, after=before, replaces=before.parts)
    return open_restored(spark, target)


def open_restored(spark: SparkSession, target: str) -> DataFrame:
    """The current rows of a table that was restored."""
    rows = commits.read_rows(spark, target)
    if rows is None:
        raise ValueError(f"nothing has been restored at {target}")
    return rows


# ----------------------------------------------------------------- by changed files
def _file_totals(table: DataFrame, columns: list[str]) -> DataFrame:
    """``file, n_rows, hash_xor, hash_sum`` for every file of a table that was read from files."""
    name = F.col("_metadata.file_path").alias("file")
    return table.select(name, F.xxhash64(*sorted(columns)).alias("code")).groupBy("file").agg(*_totals(F.col("code")))


def save_changed(spark: SparkSession, source: str, store: str, snapshot_id: str) -> dict[str, int]:
    """Snapshot the Parquet table at ``source`` into ``store``; returns how many files it has and how many
    of them had to be copied.

    A file is known by the hashes of its rows, whatever it is called. Files are read to be
    hashed and only changed ones are written, each into a folder of its own. A snapshot that stops half-way
    has no commit and is not there; one that is repeated under its id changes nothing.
    """
    before = commits.read_version(spark, f"{store}/commits")
    if snapshot_id in before.commit_ids:
        held = manifest(spark, store, snapshot_id).count()
        return {"files": held, "copied": 0}
    table = spark.read.parquet(source)
    key = F.concat_ws("-", "n_rows", F.hex("hash_xor"), F.col("hash_sum").cast("string"))
    now = materialise(_file_totals(table, table.columns).withColumn("content", key), "files")
    held = commits.read_rows(spark, store, before)
    fresh = now if held is None else now.join(held.select("content").distinct(), "content", "left_anti")
    fresh = materialise(fresh.groupBy("content").agg(F.min("file").alias("file")), "fresh")
    part = commits.new_part(snapshot_id)
    copied = fresh.count()
    if copied:
        named = table.select("*", F.col("_metadata.file_path").alias("_file"))
        chosen = named.join(fresh.select(F.col("file").alias("_file"), F.col("content").alias("_content")), "_file").drop("_file")
        # one folder per file of the source; a large file may become several in it
        chosen.write.mode("error").partitionBy("_content").parquet(f"{store}/data/part={part}")
    places = fresh.select("content", F.lit(part).alias("place"))
    if held is not None:
        places = places.unionByName(held.select("content", "place")).groupBy("content").agg(F.min("place").alias("place"))
    listed = now.join(places, "content").select("file", "n_rows", "hash_xor", "hash_sum", "content", "place", F.lit(snapshot_id).alias("snapshot_id"))
    listed.write.mode("error").parquet(f"{store}/rows/part={part}")
    commits.record(spark, f"{store}/commits", snapshot_id, before.number + 1, part, facts={f"schema:{snapshot_id}": table.schema.json()})
    return {"files": now.count(), "copied": copied}


def manifest(spark: SparkSession, store: str, snapshot_id: str) -> DataFrame:
    """The files of one snapshot."""
    rows = commits.read_rows(spark, store)
    found = None if rows is None else rows.where(F.col("snapshot_id") == snapshot_id).drop("snapshot_id")
    if found is None or not found.head(1):
        raise ValueError(f"there is no snapshot {snapshot_id}")
    return found


def restore_saved(spark: SparkSession, store: str, snapshot_id: str, target: str) -> DataFrame:
    """Make a snapshot the current table at ``target``, once every file of it has been found
    as the manifest promises."""
    files = materialise(manifest(spark, store, snapshot_id), "manifest")
    places = [row.place for row in files.select("place").distinct().collect()]
    data = commits.read_or_none(spark, *[f"{store}/data/part={p}" for p in places], base=f"{store}/data")
    wanted = files.groupBy("content", "place").agg(F.count("*").alias("times"), F.first("n_rows").alias("n_rows"), F.first("hash_xor").alias("hash_xor"), F.first("hash_sum").alias("hash_sum"))
    wanted = materialise(wanted, "wanted")
    columns = [c for c in data.columns if c not in ("_content", "part")]
    stored = data.join(wanted.select(F.col("content").alias("_content"), F.col("place").alias("part"), "times"), ["_content", "part"])
    found = stored.groupBy("_content").agg(*_totals(F.xxhash64(*sorted(columns))))
    promised = wanted.where("n_rows > 0").select(F.col("content").alias("_content"), "n_rows", "hash_xor", "hash_sum")
    if promised.exceptAll(found).head(1):
        raise ValueError(f"snapshot {snapshot_id} does not match its manifest")
    # files of equal content were copied once
    rows = stored.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("times")))).select(*columns)
    return _switch(spark, rows, target)
