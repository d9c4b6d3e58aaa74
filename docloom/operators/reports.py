"""Counts and sentences about documents, events, logs and the index."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom import fixed_values as fv

def document_count(documents: DataFrame) -> DataFrame:
    return documents.agg(F.count("*").alias("n"))


def count_sentence(documents: DataFrame) -> DataFrame:
    before, after = fv.COUNT_SENTENCE.split("%s")
    return document_count(documents).select(
        F.concat(F.lit(before), F.format_number("n", 0), F.lit(after)).alias("answer")
    )


def status_counts(rows: DataFrame, status: str = "status") -> DataFrame:
    return rows.groupBy(F.col(status).alias("status")).agg(F.count("*").alias("n"))


def status_sentence(rows: DataFrame, status: str = "status") -> DataFrame:
    """One sentence with all counts, statuses in order; it is as long as there are
    distinct statuses."""
    return sentence_of_counts(status_counts(rows, status))


def sentence_of_counts(counts: DataFrame) -> DataFrame:
    """The same from ``status, n``, such as counters that a stream keeps."""
    part = F.concat(F.coalesce("status", F.lit("None")), F.lit(": "), F.format_number("n", 0))
    listed = counts.agg(F.array_sort(F.collect_list(F.struct("status", part.alias("part")))).alias("rows"))
    return listed.select(F.concat(F.lit(fv.STATUS_SENTENCE), F.array_join(F.col("rows.part"), ", ")).alias("answer"))


def ingest_report(items: DataFrame, failed: Column) -> DataFrame:
    """``found, succeeded, failed`` in one pass."""
    broken = F.count_if(failed)
    return items.agg(
        F.count("*").alias("found"), (F.count("*") - broken).alias("succeeded"), broken.alias("failed")
    )


def log_index(timestamp: Column) -> Column:
    """Name of the daily log index an event belongs to."""
    return F.concat(F.lit(fv.LOG_INDEX_PREFIX), F.date_format(timestamp, "yyyy.MM.dd"))


def write_daily_log(records: DataFrame, timestamp: str, path: str) -> None:
    """Append log records, one folder per day index.

    The rebalance hint makes a few good-sized files per day and splits a day that
    holds far more records than others.
    """
    indexed = records.withColumn("log_index", log_index(F.col(timestamp)))
    indexed.hint("rebalance", "log_index").write.mode("append").partitionBy("log_index").parquet(path)


def error_report(events: DataFrame, timestamp: str, failed: Column) -> DataFrame:
    """``day, n, n_errors``."""
    return events.groupBy(F.to_date(timestamp).alias("day")).agg(
        F.count("*").alias("n"), F.count_if(failed).alias("n_errors")
    )


def index_stats(documents: DataFrame, chunks: Column) -> DataFrame:
    """``n_documents, n_chunks, mean_chars`` from one array of chunks per document.

    Counting inside the row needs no explode and no distinct count.
    """
    lengths = documents.select(F.transform(chunks, lambda c: F.length(c).cast("bigint")).alias("lengths"))
    per_document = lengths.select(
        F.size("lengths").cast("bigint").alias("n"),
        F.aggregate("lengths", F.lit(0).cast("bigint"), lambda acc, x: acc + x).alias("chars"),
    )
    return per_document.agg(
        F.count_if(F.col("n") > 0).alias("n_documents"),
        F.sum("n").alias("n_chunks"),
        (F.sum("chars") / F.sum("n")).alias("mean_chars"),
    )
