"""Streams that keep keyed state: sessions, the registry, counters."""

import os

import pytest
from pyspark.sql import functions as F

from docloom.operators import reports, sessions
from docloom.sources import commits
from docloom.streaming import history
from docloom.streaming import registry as kept


@pytest.fixture
def folder(tmp_path):
    return str(tmp_path)


def write(table, folder, name="in"):
    table.coalesce(1).write.mode("append").parquet(f"{folder}/{name}")


def read(spark, table, folder, name="in"):
    return spark.readStream.schema(table.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/{name}")


CHAT = "session_id bigint, seq bigint, role string, content string"


def test_sessions_keep_their_last_messages_across_restarts(spark, folder):
    rows = [(s, i, "user" if i % 2 == 0 else "assistant", f"{s}-{i}") for s, n in {1: 60, 2: 24, 3: 5}.items() for i in range(n)]
    rows += [(3, 99, "system", "hidden"), (None, 1, "user", "nobody"), (3, None, "user", "no place")]
    messages = spark.createDataFrame(rows, CHAT)
    for part in ("seq >= 10 and seq < 30", "seq < 10", "seq >= 30 or seq is null"):
        write(messages.where(part), folder)
        history.start_sessions(read(spark, messages, folder), f"{folder}/state", path=f"{folder}/out").awaitTermination()
        state = history.histories(spark, f"{folder}/state")
        assert state.groupBy("session_id").count().agg(F.max("count")).first()[0] <= 24
    want = sessions.last_messages(messages.where("session_id IS NOT NULL AND seq IS NOT NULL"))
    got = history.histories(spark, f"{folder}/state")
    assert sorted(map(tuple, got.select(*want.columns).collect())) == sorted(map(tuple, want.collect()))
    # a start without anything new changes nothing, and no message is told twice
    history.start_sessions(read(spark, messages, folder), f"{folder}/state", path=f"{folder}/out").awaitTermination()
    told = spark.read.parquet(f"{folder}/out")
    assert told.count() == told.select("session_id", "seq").distinct().count()
    assert got.select("session_id", "seq").exceptAll(told.select("session_id", "seq")).count() == 0


def test_sessions_run_in_a_session_with_sparks_own_state_store(spark, folder):
    setting = "spark.sql.streaming.stateStore.providerClass"
    kept_setting, plain = spark.conf.get(setting), "org.apache.spark.sql.execution.streaming.state.HDFSBackedStateStoreProvider"
    messages = spark.createDataFrame([(s, i, "user", f"{s}-{i}") for s in (1, 2) for i in range(30)], CHAT)
    try:
        spark.conf.set(setting, plain)
        for part in ("seq < 15", "seq >= 15"):
            write(messages.where(part), folder)
            history.start_sessions(read(spark, messages, folder), f"{folder}/state", 4).awaitTermination()
            assert spark.conf.get(setting) == plain
        got = history.histories(spark, f"{folder}/state")
        assert sorted((r.session_id, r.seq) for r in got.collect()) == [(s, i) for s in (1, 2) for i in range(26, 30)]
    finally:
        spark.conf.set(setting, kept_setting)


def test_idle_sessions_end(spark, folder):
    rows = [(1, 0, 0), (2, 0, 60), (1, 1, 600), (2, 1, 7200), (1, 2, 14_000), (3, 0, 20_000)]
    messages = spark.createDataFrame(
        [(s, q, "user", f"{s}-{q}", t) for s, q, t in rows], CHAT + ", t bigint"
    ).select("session_id", "seq", "role", "content", F.timestamp_seconds("t").alias("at"))
    for low, high in ((0, 1000), (1000, 8000), (8000, 15_000), (15_000, 21_000)):
        write(messages.where(F.col("at").between(F.timestamp_seconds(F.lit(low)), F.timestamp_seconds(F.lit(high)))), folder)
        stream = read(spark, messages, folder).withWatermark("at", "1 minute")
        history.start_sessions(stream, f"{folder}/state", 5, path=f"{folder}/out", at="at", idle="1 hour").awaitTermination()
    told = spark.read.parquet(f"{folder}/out")
    assert sorted(r.session_id for r in told.where("ended").collect()) == [1, 1, 2]
    left = {(r.session_id, r.seq) for r in history.histories(spark, f"{folder}/state").collect()}
    assert left == {(3, 0)}
    with pytest.raises(ValueError, match="idle"):
        history.session_state(messages, at="at")


def test_a_busy_session_is_cut_before_the_shuffle(spark, folder):
    messages = spark.range(6_000).select(
        F.when(F.col("id") % 3 == 0, F.lit(-1)).otherwise(F.col("id") % 50).cast("bigint").alias("session_id"),
        F.col("id").alias("seq"),
        F.lit("user").alias("role"),
        F.concat(F.lit("m"), "id").alias("content"),
    )
    write(messages, folder)
    history.start_sessions(read(spark, messages, folder), f"{folder}/state", 5).awaitTermination()
    got = history.histories(spark, f"{folder}/state")
    assert sorted(r.seq for r in got.where("session_id = -1").collect()) == [5985, 5988, 5991, 5994, 5997]
    assert got.count() == 51 * 5


def uploads_of(spark, rows):
    return spark.createDataFrame(rows, "filename string, seq int")


def run_registry(spark, uploads, folder, **more):
    kept.start_registry(read(spark, uploads, folder), ["seq"], f"{folder}/reg", f"{folder}/state", **more).awaitTermination()
    return sorted((r.filename, r.seq) for r in kept.read_registry(spark, f"{folder}/reg").collect())


def test_registry_over_batches_and_compaction(spark, folder):
    uploads = uploads_of(spark, [("a", 1), ("b", 3), ("b", 2), ("a", 4), ("c", 5), ("b", 0), (None, 9)])
    write(uploads.where("seq in (1, 2, 3)"), folder)
    assert run_registry(spark, uploads, folder) == [("a", 1), ("b", 2)]
    write(uploads.where("seq in (0, 4, 5, 9)"), folder)
    want = [("a", 1), ("b", 2), ("c", 5)]
    assert run_registry(spark, uploads, folder) == want
    first = kept.read_registry(spark, f"{folder}/reg")
    kept.compact_registry(spark, f"{folder}/reg")
    write(uploads_of(spark, [("d", 7), ("a", 8)]), folder)
    assert run_registry(spark, uploads, folder) == [*want, ("d", 7)]
    assert first.count() == 3
    assert {(r.bucket, r.status) for r in first.collect()} == {("documents", "PENDING_OCR")}
    assert len(commits.read_version(spark, f"{folder}/reg/commits").parts) == 2


def test_a_replayed_batch_changes_nothing(spark, folder):
    batch = uploads_of(spark, [("a", 1), ("b", 2)])
    for _ in range(2):
        kept.add_batch(batch, 0, f"{folder}/reg")
    kept.add_batch(uploads_of(spark, [("c", 3)]), 1, f"{folder}/reg")
    assert kept.read_registry(spark, f"{folder}/reg").count() == 3
    kept.compact_registry(spark, f"{folder}/reg")
    kept.add_batch(batch, 0, f"{folder}/reg")
    assert kept.read_registry(spark, f"{folder}/reg").count() == 3


def test_a_new_checkpoint_starts_from_the_names_there_are(spark, folder):
    uploads = uploads_of(spark, [("a", 1), ("b", 2)])
    write(uploads, folder)
    run_registry(spark, uploads, folder)
    more = uploads_of(spark, [("a", 5), ("c", 6)])
    write(more, folder, "new")
    kept.start_registry(
        read(spark, uploads, folder, "new"), ["seq"], f"{folder}/reg", f"{folder}/state-2", known=kept.known_files(spark, f"{folder}/reg")
    ).awaitTermination()
    found = kept.read_registry(spark, f"{folder}/reg")
    assert sorted((r.filename, r.seq) for r in found.collect()) == [("a", 1), ("b", 2), ("c", 6)]


def bytes_below(path):
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, files in os.walk(path) for f in files)


def test_batches_do_not_read_the_registry_and_write_no_more_as_it_grows(spark, folder):
    """Each batch offers 200 known names and 50 new ones."""
    batches = 12
    schema = "filename string, seq int"
    for k in range(batches):
        rows = [(f"file-{n}", k) for n in range(max(0, k * 50 - 200), k * 50 + 50)]
        write(spark.createDataFrame(rows, schema), folder)
    stream = read(spark, spark.createDataFrame([], schema), folder)
    sizes = []

    query = kept.start_registry(stream, ["seq"], f"{folder}/reg", f"{folder}/state")
    query.awaitTermination()
    progress = [p for p in query.recentProgress if p["numInputRows"]]
    assert len(progress) == batches
    sizes = [p["stateOperators"][0]["numRowsUpdated"] for p in progress]
    assert max(sizes) <= 250 and progress[-1]["stateOperators"][0]["numRowsTotal"] == batches * 50
    assert kept.read_registry(spark, f"{folder}/reg").count() == batches * 50
    per_part = [bytes_below(f"{folder}/reg/rows/part={p}") for p in commits.read_version(spark, f"{folder}/reg/commits").parts]
    assert max(per_part) < 3 * min(per_part)


def test_counters_equal_the_count_after_replays(spark, folder):
    events = spark.range(300).select(F.concat(F.lit("s"), F.col("id") % 4).alias("kind"), "id")
    for low in (0, 100, 200):
        write(events.where(F.col("id").between(low, low + 99)), folder)
        kept.start_counters(read(spark, events, folder), "kind", f"{folder}/n", f"{folder}/state").awaitTermination()
    want = reports.status_sentence(events, "kind").first().answer
    assert reports.sentence_of_counts(kept.read_counters(spark, f"{folder}/n")).first().answer == want
    last = kept.read_counters(spark, f"{folder}/n").withColumn("batch_id", F.lit(2).cast("bigint"))
    kept.add_batch(last, 2, f"{folder}/n")  # a batch that is written again, under another id
    assert reports.sentence_of_counts(kept.read_counters(spark, f"{folder}/n")).first().answer == want
    assert kept.read_counters(spark, f"{folder}/none").count() == 0
