"""Streaming jobs run over whole tables, read back from their sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom import fixed_values as fv
from docloom.catalog import query
from docloom.catalog.models import extracted_sql
from docloom.catalog.tables import LAST_SQL, STATUS_SENTENCE_SQL
from docloom.operators import reports
from docloom.operators.models import PLAIN_EXTRACTORS
from docloom.session import materialise, read_table, work_path
from docloom.sources import events
from docloom.streaming import history, jobs
from docloom.streaming import registry as kept


def _finish(job) -> None:
    job.awaitTermination()


def _in_batches(spark: SparkSession, directory: str, name: str, batches: int = 3, order: str | None = None) -> DataFrame:
    """The whole table as a file stream of several micro-batches, in ``order`` if given.

    A micro-batch is as many files as its share of the table has splits, so no task gets more than
    about a split however large the table is."""
    path = work_path(spark, name)
    table = read_table(spark, directory, name)
    files = -(-table.rdd.getNumPartitions() // batches)
    if order:
        ranged = materialise(table.repartitionByRange(batches * files, order).withColumn("_part", F.spark_partition_id()), "ranged")
        parts = (ranged.agg(F.max("_part")).first()[0] or 0) + 1
        for number in range(batches):  # a file source takes files by their time
            first, end = (-(-parts * k // batches) for k in (number, number + 1))
            held = ranged.where(F.col("_part").between(first, end - 1))
            held.drop("_part").repartition(files).write.mode("append").parquet(path)
    else:
        table.repartition(batches * files).write.parquet(path)
    return spark.readStream.schema(table.schema).option("maxFilesPerTrigger", files).parquet(path)


def _uploads(spark: SparkSession, directory: str) -> DataFrame:
    """Documents as upload envelopes with their bytes; short ones come with a broken
    envelope beside their own."""
    kinds = F.array(*[F.lit(kind) for kind in (".PDF", ".txt", ".docx", ".png")])
    named = _in_batches(spark, directory, "documents").select(
        F.concat(
            F.lit("doc-"), F.col("doc_id").cast("string"), F.element_at(kinds, (F.col("doc_id") % 4 + 1).cast("int"))
        ).alias("filename"),
        F.when(F.col("lang") == "en", "english").alias("bucket"),
        F.col("n_chars").alias("size"),
        F.lit("text/plain").alias("content_type"),
        F.lit(fv.STATUS_UPLOADED).alias("status"),
        F.encode("text", "UTF-8").alias("content"),
    )
    fields = events.UPLOAD_EVENT.fieldNames()
    own = F.to_json(F.struct(*fields))
    values = F.when(F.length("content") < 100, F.array(own, F.lit("not json"))).otherwise(F.array(own))
    return named.select(F.col("filename").alias("key"), F.explode(values).alias("value"), "content")


_UPLOADS = """(SELECT CASE WHEN NOT broken THEN 'doc-' || doc_id || CASE doc_id % 4 WHEN 0 THEN '.PDF' WHEN 1 THEN '.txt'
      WHEN 2 THEN '.docx' ELSE '.png' END END AS filename,
    CASE WHEN lang = 'en' AND NOT broken THEN 'english' ELSE 'documents' END AS bucket,
    CASE WHEN NOT broken THEN n_chars END AS size, broken, text
    FROM (SELECT *, false AS broken FROM documents
      UNION ALL SELECT *, true FROM documents WHERE octet_length(encode(text)) < 100))"""
_TEXT = f"CASE WHEN broken THEN 'ERROR: no file name' ELSE {extracted_sql('filename', 'text')} END"


@query(
    f"""SELECT filename, bucket, size, broken AS is_malformed, {_TEXT} AS extracted_text,
    CASE WHEN broken THEN 'no file name' END AS error FROM {_UPLOADS}"""
)
def stream_extract(spark: SparkSession, directory: str) -> DataFrame:
    path = work_path(spark, "extract")
    _finish(jobs.start_extraction(_uploads(spark, directory), PLAIN_EXTRACTORS, f"{path}/rows", f"{path}/state"))
    return spark.read.parquet(f"{path}/rows").select(
        "filename", "bucket", "size", "is_malformed", "extracted_text", "error"
    )


@query(
    f"""SELECT CASE WHEN lower(split_part(filename, '.', -1)) IN ('png', 'pdf') THEN 'ocr' ELSE 'text' END AS route,
    'text-extracted' AS topic, filename AS key, {_TEXT} AS text FROM {_UPLOADS}"""
)
def stream_route(spark: SparkSession, directory: str) -> DataFrame:
    path = work_path(spark, "route")
    _finish(jobs.start_routing(_uploads(spark, directory), PLAIN_EXTRACTORS, f"{path}/rows", f"{path}/state"))
    return spark.read.parquet(f"{path}/rows").select(
        "route", "topic", "key", F.get_json_object("value", "$.extracted_text").alias("text")
    )


@query(
    """SELECT 'file-' || user_id AS filename, NULL::VARCHAR AS bucket, (props::JSON ->> 'k')::BIGINT AS size,
    event_type AS status, false AS is_malformed FROM events"""
)
def stream_events(spark: SparkSession, directory: str) -> DataFrame:
    """Short events (fields missing) through an envelope stream into a table."""
    path = work_path(spark, "events")
    source = _in_batches(spark, directory, "events").select(
        F.concat(F.lit("file-"), F.col("user_id").cast("string")).alias("filename"),
        F.get_json_object("props", "$.k").cast("bigint").alias("size"),
        F.col("event_type").alias("status"),
    )
    parsed = events.parse(events.publish(source, "filename", ["filename", "size", "status"]))
    _finish(jobs.append_to(parsed, f"{path}/rows", f"{path}/state"))
    return spark.read.parquet(f"{path}/rows").select("filename", "bucket", "size", "status", "is_malformed")


@query("SELECT 'file-' || user_id AS filename, min(event_id) AS event_id, 'documents' AS bucket, 'PENDING_OCR' AS status FROM events GROUP BY user_id")
def stream_registry(spark: SparkSession, directory: str) -> DataFrame:
    path = work_path(spark, "registry")
    uploads = _in_batches(spark, directory, "events", order="event_id").select(
        F.concat(F.lit("file-"), F.col("user_id").cast("string")).alias("filename"), "event_id"
    )
    _finish(kept.start_registry(uploads, ["event_id"], f"{path}/table", f"{path}/state"))
    kept.compact_registry(spark, f"{path}/table")
    return kept.read_registry(spark, f"{path}/table").select("filename", "event_id", "bucket", "status")


@query(STATUS_SENTENCE_SQL)
def stream_status_summary(spark: SparkSession, directory: str) -> DataFrame:
    """The sentence of all statuses from counters that a stream keeps."""
    path = work_path(spark, "counters")
    changes = _in_batches(spark, directory, "events").select("event_type")
    _finish(kept.start_counters(changes, "event_type", f"{path}/table", f"{path}/state"))
    return reports.sentence_of_counts(kept.read_counters(spark, f"{path}/table"))


@query(LAST_SQL.format(n=4))
def stream_history(spark: SparkSession, directory: str) -> DataFrame:
    path = work_path(spark, "history")
    messages = _in_batches(spark, directory, "conversations").select(
        F.col("conv_id").alias("session_id"), F.col("turn").alias("seq"), "role", F.col("text").alias("content")
    )
    _finish(jobs.start_history(messages, f"{path}/rows", f"{path}/state", 4))
    return jobs.current_history(spark.read.parquet(f"{path}/rows"), 4)


@query(LAST_SQL.format(n=4))
def stream_sessions(spark: SparkSession, directory: str) -> DataFrame:
    """The same as keyed state, read from the state."""
    path = work_path(spark, "sessions")
    messages = _in_batches(spark, directory, "conversations").select(
        F.col("conv_id").alias("session_id"), F.col("turn").alias("seq"), "role", F.col("text").alias("content")
    )
    _finish(history.start_sessions(messages, f"{path}/state", 4))
    return history.histories(spark, f"{path}/state")


LOG_RECORD = T.StructType([T.StructField("event_id", T.LongType()), T.StructField("ts", T.StringType())])


@query(
    """SELECT event_id, ts::VARCHAR AS ts, user_id, event_type, value, props, 'document-system-logs-' || strftime(ts, '%Y.%m.%d') AS log_index
    FROM events"""
)
def stream_log_daily(spark: SparkSession, directory: str) -> DataFrame:
    """Records with more fields than are declared; the rest is read from the raw record."""
    path = work_path(spark, "logs")
    rows = _in_batches(spark, directory, "events").withColumn("ts", F.col("ts").cast("string"))
    records = events.parse(events.publish(rows, "event_id", rows.columns), LOG_RECORD, raw="record")
    _finish(jobs.start_daily_log(records, F.to_timestamp_ntz("ts"), f"{path}/rows", f"{path}/state"))
    field = lambda name: F.get_json_object("record", f"$.{name}")
    return spark.read.parquet(f"{path}/rows").select(
        "event_id",
        "ts",
        field("user_id").cast("bigint").alias("user_id"),
        field("event_type").alias("event_type"),
        field("value").cast("double").alias("value"),
        field("props").alias("props"),
        "log_index",
    )
