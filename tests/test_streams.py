"""Streams in two runs with a restart from the checkpoint, against the batch result."""

import pytest
from pyspark.sql import functions as F

from docloom.catalog import streams
from docloom.operators import models, sessions
from docloom.sources import events
from docloom.streaming import jobs


@pytest.fixture
def folder(tmp_path):
    return str(tmp_path)


def write(table, folder):
    table.coalesce(1).write.mode("append").parquet(f"{folder}/in")


def read(spark, table, folder):
    return spark.readStream.schema(table.schema).parquet(f"{folder}/in")


def test_extraction_restarts_where_it_stopped(spark, folder):
    files = spark.range(40).select(
        F.concat(F.lit("f"), "id", F.lit(".txt")).alias("filename"), F.lit("UPLOADED").alias("status"), "id"
    )
    envelopes = events.publish(files, "filename", ["filename", "status"]).withColumn(
        "content", F.encode(F.concat(F.lit("text of "), "key"), "UTF-8")
    )
    for part in (envelopes.where("key < 'f2'"), envelopes.where("key >= 'f2'")):
        write(part, folder)
        for _ in range(2):  # the second start of each pair has nothing left to do
            stream = read(spark, envelopes, folder)
            jobs.start_extraction(stream, models.PLAIN_EXTRACTORS, f"{folder}/out", f"{folder}/state").awaitTermination()
    rows = spark.read.parquet(f"{folder}/out").collect()
    assert sorted(r.extracted_text for r in rows) == sorted(f"text of f{i}.txt" for i in range(40))
    assert {r.bucket for r in rows} == {"documents"}


def test_history_over_batches_equals_batch(spark, folder):
    rows = [(s, i, "user" if i % 2 == 0 else "assistant", f"{s}-{i}") for s, n in {1: 40, 2: 24, 3: 5}.items() for i in range(n)]
    rows += [(3, 99, "system", "hidden")]
    messages = spark.createDataFrame(rows, "session_id bigint, seq bigint, role string, content string")
    for part in (messages.where("seq >= 10 and seq < 30"), messages.where("seq < 10"), messages.where("seq >= 30")):
        write(part, folder)
        jobs.start_history(read(spark, messages, folder), f"{folder}/out", f"{folder}/state").awaitTermination()
    got = jobs.current_history(spark.read.parquet(f"{folder}/out"))
    want = sessions.last_messages(messages)
    assert sorted(map(tuple, got.select(*want.columns).collect())) == sorted(map(tuple, want.collect()))


def test_busy_session_is_cut_before_the_shuffle(spark, folder):
    """A third of all messages belongs to one session."""
    messages = spark.range(9_000).select(
        F.when(F.col("id") % 3 == 0, F.lit(-1)).otherwise(F.col("id")).cast("bigint").alias("session_id"),
        F.col("id").alias("seq"),
        F.lit("user").alias("role"),
        F.concat(F.lit("m"), "id").alias("content"),
    )
    write(messages, folder)
    jobs.start_history(read(spark, messages, folder), f"{folder}/out", f"{folder}/state", 5).awaitTermination()
    got = jobs.current_history(spark.read.parquet(f"{folder}/out"), 5)
    assert got.count() == 6_000 + 5
    assert sorted(r.seq for r in got.where("session_id = -1").collect()) == [8985, 8988, 8991, 8994, 8997]
    written = spark.read.parquet(f"{folder}/out")
    assert written.where("session_id = -1").count() < 100
    jobs.compact_history(written, f"{folder}/compact", 5)
    assert spark.read.parquet(f"{folder}/compact").count() == got.count()


def test_routes_and_daily_logs(spark, folder):
    files = spark.createDataFrame([("a.png",), ("b.txt",), ("c.PDF",)], "filename string")
    envelopes = events.publish(files, "filename", ["filename"]).withColumn("content", F.encode("key", "UTF-8"))
    write(envelopes, folder)
    jobs.start_routing(read(spark, envelopes, folder), models.PLAIN_EXTRACTORS, f"{folder}/out", f"{folder}/state").awaitTermination()
    routed = spark.read.parquet(f"{folder}/out")
    assert sorted((r.route, r.key) for r in routed.collect()) == [("ocr", "a.png"), ("ocr", "c.PDF"), ("text", "b.txt")]
    assert {r.topic for r in routed.collect()} == {"text-extracted"}

    logs = spark.createDataFrame([(1, "2024-01-31 23:59:59"), (2, "2024-02-01 00:00:00")], "n int, at string").select(
        "n", F.to_timestamp("at").alias("at")
    )
    logs.coalesce(1).write.parquet(f"{folder}/logs")
    stream = spark.readStream.schema(logs.schema).parquet(f"{folder}/logs")
    jobs.start_daily_log(stream, F.col("at"), f"{folder}/days", f"{folder}/log-state").awaitTermination()
    days = {r.log_index: r.n for r in spark.read.parquet(f"{folder}/days").collect()}
    assert days == {"document-system-logs-2024.01.31": 1, "document-system-logs-2024.02.01": 2}


@pytest.mark.parametrize("order", [None, "event_id"])
def test_micro_batches_of_a_table_are_many_files(spark, directory, tmp_path, monkeypatch, order):
    spark.read.parquet(f"{directory}/events.parquet").repartition(12).write.parquet(f"{tmp_path}/events.parquet")
    monkeypatch.setattr(streams, "work_path", lambda _, name: f"{tmp_path}/work-{name}")
    held = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")  # every file is a split or more
    batches = []

    def note(batch, _):
        batches.append(tuple(batch.agg(F.count("*"), F.min("event_id"), F.max("event_id")).first()))

    try:
        stream = streams._in_batches(spark, str(tmp_path), "events", order=order)
        stream.writeStream.foreachBatch(note).option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start().awaitTermination()
        sizes = [r.n for r in spark.read.parquet(f"{tmp_path}/work-events").groupBy(F.input_file_name()).agg(F.count("*").alias("n")).collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", held)
    rows = spark.read.parquet(f"{directory}/events.parquet").count()
    assert len(batches) == 3 and sum(n for n, _, _ in batches) == rows
    assert len(sizes) >= 12 and max(sizes) <= rows / 6
    if order:
        assert all(left[2] < right[1] for left, right in zip(batches, batches[1:]))
