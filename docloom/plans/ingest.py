"""Batch ingest and retry as jobs: what they decide is written once, then applied."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom import fixed_values as fv
from docloom.operators.models import Extractors, Fetch, extract_text
from docloom.operators.registry import insert_if_absent, last_per_key, registry_rows
from docloom.operators.reports import ingest_report
from docloom.session import materialise
from docloom.sources.corpus import scan_files
from docloom.sources.events import publish


@dataclass
class Ingested:
    inserted: DataFrame
    events: DataFrame
    report: DataFrame


def ingest_batch(items: DataFrame, registry: DataFrame, order: list[str], failed: Column) -> Ingested:
    """Registry rows to append, upload events to send, and the report.

    ``items`` has ``filename`` and whatever ``failed`` tests. A failed item is
    counted and otherwise left out. A file the registry already knows is not
    inserted again, but counts as a success and is announced. ``items`` may come from
    an upload that can fail; its outcome is written first and looked at from there.
    """
    kept = [c for c in ("filename", *order) if c in items.columns]
    outcome = materialise(items.select(*dict.fromkeys(kept), failed.alias("_failed")), "outcome")
    stored = outcome.where("NOT _failed")
    inserted = registry_rows(insert_if_absent(stored.drop("_failed"), registry, order))
    return Ingested(
        inserted=materialise(inserted.select("filename", "bucket", "status", "created_at"), "inserted"),
        events=publish(stored.withColumn("status", F.lit(fv.STATUS_UPLOADED)), "filename", ["filename", "status"]),
        report=ingest_report(outcome, F.col("_failed")),
    )


def ingest_folder(
    registry_path: str,
    root: str,
    upload: Callable[[DataFrame], DataFrame],
    announce: Callable[[DataFrame], None],
    spark,
    glob: str = fv.SCAN_GLOB,
) -> DataFrame:
    """The whole job: scan, upload, insert what is new, announce, report.

    ``upload`` gets the found files (``filename, path, length, modified``) and adds
    ``error`` (NULL where it went well); ``announce`` sends the envelopes. New rows are
    appended to the registry before files are announced. Returns the one-row report.
    """
    items = upload(scan_files(spark, root, glob)).select("filename", "error")
    known = spark.read.parquet(registry_path)
    done = ingest_batch(items, known, ["filename"], F.col("error").isNotNull())
    done.inserted.write.mode("append").parquet(registry_path)
    announce(done.events)
    return done.report


def failed_files(extracted: DataFrame, order: list[str], key: str = "filename") -> DataFrame:
    """``key``, order and error of files whose latest extraction is an error; texts are
    not read for it."""
    narrow = extracted.select(*dict.fromkeys([key, *order, "error"]))
    return last_per_key(narrow, key, order).where(F.col("error").isNotNull())


def retry_failed(
    extracted: DataFrame, order: list[str], extractors: Extractors, fetch: Fetch, key: str = "filename"
) -> DataFrame:
    """Extract the failed files again: rows to append to the same table."""
    failed = failed_files(extracted, order, key).select(key, *[c for c in order if c != key])
    again = extracted.drop("extracted_text", "error").join(failed, [key, *[c for c in order if c != key]], "left_semi")
    return extract_text(last_per_key(again, key, order), extractors, fetch=fetch)


def retry_table(
    spark, path: str, order: list[str], extractors: Extractors, fetch: Fetch, attempt: Callable[[DataFrame], DataFrame]
) -> DataFrame:
    """The whole job on a table of extractions: select, extract again, append.

    ``attempt`` gives the new rows their place in ``order``, after the tries before. The
    new rows are written before they are appended, since they come from the same table.
    Returns the table with the new tries.
    """
    table = spark.read.parquet(path)
    again = attempt(retry_failed(table, order, extractors, fetch)).select(table.columns)
    materialise(again, "retried").write.mode("append").parquet(path)
    return spark.read.schema(table.schema).parquet(path)
