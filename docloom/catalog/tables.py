"""Queries over the registry, events, sessions and reports."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom import fixed_values as fv
from docloom.catalog import query
from docloom.catalog.text import WS_LIST, documents
from docloom.functions.files import short_id
from docloom.operators import answers, registry, reports, sessions
from docloom.operators.models import PLAIN_EXTRACTORS
from docloom.plans import answer_cache, ingest
from docloom.session import materialise, read_table, work_path
from docloom.sources import corpus, events, snapshots
from docloom.sources import directory as order


# --------------------------------------------------------------------- sources
@query(
    """SELECT 'kind-' || page_id % 3 || '/page-' || page_id || '.txt' AS filename, strlen(html) + 1 AS length, html AS content FROM pages"""
)
def scan_files(spark: SparkSession, directory: str) -> DataFrame:
    """Pages written as files in three folders, found again by a scan and read back."""
    path = work_path(spark, "files")
    table = read_table(spark, directory, "pages")
    # files cost by their number, so tasks get even shares of them
    tasks = max(table.rdd.getNumPartitions(), 4 * spark.sparkContext.defaultParallelism)
    rows = table.select(F.concat(F.lit("kind-"), F.col("page_id") % 3).alias("kind"), "page_id", "html").repartition(tasks, "page_id")
    # one text file per page: its folder says which, and a line end closes it
    rows.select("kind", F.concat(F.lit("page-"), "page_id").alias("page"), F.col("html").alias("value")).write.partitionBy("kind", "page").text(path)
    name = F.regexp_replace(F.regexp_replace("filename", "kind=", ""), "/page=([^/]+)/.*$", "/$1.txt")
    found = corpus.scan_files(spark, path, "part-*", content=True)
    return found.select(name.alias("filename"), "length", F.regexp_replace(F.decode("content", "UTF-8"), "\n$", "").alias("content"))


@query("SELECT page_id::VARCHAR AS id, html AS content_html FROM pages")
def read_corpus(spark: SparkSession, directory: str) -> DataFrame:
    paths = [f"{directory}/no-such-table.parquet", f"{directory}/pages.parquet"]
    return corpus.read_corpus(spark, paths, {"id": "page_id", "content_html": "html"})


@query("SELECT doc_id, text FROM documents ORDER BY doc_id LIMIT 100 OFFSET 50")
def corpus_window(spark: SparkSession, directory: str) -> DataFrame:
    documents = read_table(spark, directory, "documents").select("doc_id", "text")
    return corpus.corpus_window(documents, "doc_id", limit=100, offset=50)


@query(
    """SELECT first_row, event_id, event_type FROM (SELECT *, row_number() OVER (ORDER BY event_id) - 1 AS place FROM events)
    JOIN (VALUES (0), (777), (1990), (50000)) w(first_row) ON place >= first_row AND place < first_row + 25"""
)
def directory_windows(spark: SparkSession, directory: str) -> DataFrame:
    """Several windows found through one stored directory."""
    events_table = read_table(spark, directory, "events").select("event_id", "event_type")
    pages = order.build_directory(events_table, "event_id", work_path(spark, "directory"), rows_per_range=500)
    parts = [order.read_window(pages, events_table, "event_id", 25, at).withColumn("first_row", F.lit(at)) for at in (0, 777, 1990, 50_000)]
    return functools.reduce(DataFrame.unionByName, parts)


@query("SELECT event_id, (props::JSON ->> 'k')::BIGINT AS k, false AS is_malformed FROM events")
def parse_event(spark: SparkSession, directory: str) -> DataFrame:
    schema = T.StructType([T.StructField("k", T.LongType())])
    envelopes = read_table(spark, directory, "events").select("event_id", F.col("props").alias("value"))
    return events.parse(envelopes, schema, keep=["event_id"])


@query(
    """SELECT url AS filename, 'documents' AS bucket, length(html)::BIGINT AS size, 'text/html' AS content_type,
    'UPLOADED' AS status, false AS is_malformed FROM pages"""
)
def publish_events(spark: SparkSession, directory: str) -> DataFrame:
    uploads = read_table(spark, directory, "pages").select(
        F.col("url").alias("filename"),
        F.lit(fv.DEFAULT_BUCKET).alias("bucket"),
        F.length("html").alias("size"),
        F.lit("text/html").alias("content_type"),
        F.lit(fv.STATUS_UPLOADED).alias("status"),
    )
    return events.parse(events.publish(uploads, "filename", uploads.columns))


@query(
    """SELECT user_id, event_id, ts::VARCHAR AS ts, event_type, value, props FROM events
    QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1"""
)
def put_latest(spark: SparkSession, directory: str) -> DataFrame:
    puts = read_table(spark, directory, "events")
    last = registry.last_per_key(puts, "user_id", ["ts", "event_id"])
    return last.withColumn("ts", F.col("ts").cast("string"))


@query("SELECT vec_id, label, unnest(range(len(embedding)))::INT AS slot, round(unnest(embedding)::DOUBLE, 6) AS x FROM embeddings")
def snapshot_roundtrip(spark: SparkSession, directory: str) -> DataFrame:
    path = work_path(spark, "snapshot")
    snapshots.write_snapshot({"embeddings": read_table(spark, directory, "embeddings")}, path)
    target = work_path(spark, "restored")
    snapshots.restore_snapshot(spark, path, "embeddings", target)
    restored = snapshots.open_restored(spark, target)
    slots = restored.select("vec_id", "label", F.posexplode("embedding").alias("slot", "x"))
    return slots.withColumn("x", F.round(F.col("x").cast("double"), 6))


@query(
    """SELECT event_id, ts::VARCHAR AS ts, user_id, event_type, value, props, version FROM events, (VALUES (1), (2)) v(version)
    WHERE version = 2 OR event_id % 4 < 3"""
)
def snapshot_changes(spark: SparkSession, directory: str) -> DataFrame:
    """A table that grows between two snapshots; both are restored, one after the other."""
    path, target = work_path(spark, "saved"), work_path(spark, "restored")
    table = read_table(spark, directory, "events")
    table.where("event_id % 4 < 3").write.parquet(f"{path}/live")
    snapshots.save_changed(spark, f"{path}/live", f"{path}/store", "first")
    table.where("event_id % 4 = 3").write.mode("append").parquet(f"{path}/live")
    snapshots.save_changed(spark, f"{path}/live", f"{path}/store", "second")
    found = [snapshots.restore_saved(spark, f"{path}/store", name, target).withColumn("version", F.lit(k)) for k, name in ((1, "first"), (2, "second"))]
    return found[0].unionByName(found[1]).withColumn("ts", F.col("ts").cast("string"))


# -------------------------------------------------------------------- registry
@query(
    """SELECT url AS filename, min(page_id) AS page_id FROM pages
    WHERE url NOT LIKE 'http://%' GROUP BY url"""
)
def insert_if_absent(spark: SparkSession, directory: str) -> DataFrame:
    """Every page is offered twice; those with a plain-http address are registered already."""
    pages = read_table(spark, directory, "pages").select(F.col("url").alias("filename"), "page_id")
    offered = pages.unionByName(pages.withColumn("page_id", F.col("page_id") + 1_000_000))
    known = pages.where(F.col("filename").startswith("http://"))
    return registry.insert_if_absent(offered, known, ["page_id"])


@query(
    """SELECT url AS filename, CASE WHEN page_id % 2 = 0 THEN 'raw' ELSE 'documents' END AS bucket,
    'PENDING_OCR' AS status, 'Guest' AS uploader, 'default' AS session_id, substr(sha256(url), 1, 8) AS doc_id
    FROM pages"""
)
def registry_defaults(spark: SparkSession, directory: str) -> DataFrame:
    rows = read_table(spark, directory, "pages").select(
        F.col("url").alias("filename"), F.when(F.col("page_id") % 2 == 0, "raw").alias("bucket")
    )
    filled = registry.with_defaults(
        registry.registry_rows(rows),
        {
            "uploader": F.lit(fv.DEFAULT_UPLOADER),
            "session_id": F.lit(fv.DEFAULT_SESSION),
            "doc_id": short_id(F.col("filename")),
        },
    )
    return filled.drop("created_at")


@query("SELECT user_id, arg_max(event_type, (ts, event_id)) AS status FROM events GROUP BY user_id")
def latest_status(spark: SparkSession, directory: str) -> DataFrame:
    return registry.latest_status(read_table(spark, directory, "events"), "user_id", "event_type", ["ts", "event_id"])


@query(
    """SELECT substr(sha256(user_id::VARCHAR), 1, 8) AS doc_id, user_id::VARCHAR AS filename,
    arg_max(event_type, (ts, event_id)) AS status, 'Guest' AS uploader FROM events GROUP BY user_id"""
)
def document_statuses(spark: SparkSession, directory: str) -> DataFrame:
    return registry.document_statuses(latest_status(spark, directory), "user_id")


_TRIES = """(SELECT user_id::VARCHAR AS filename, 'k' AS bucket, event_id AS attempt,
    CASE WHEN event_type = 'error' THEN 'ERROR: failed' ELSE props END AS extracted_text,
    CASE WHEN event_type = 'error' THEN 'failed' END AS error FROM events)"""


@query(
    f"""SELECT * FROM {_TRIES} UNION ALL
    SELECT filename, bucket, attempt + 1000000, CASE WHEN filename LIKE '%7' THEN 'ERROR: gone' ELSE bucket || '/' || filename END,
      CASE WHEN filename LIKE '%7' THEN 'gone' END
    FROM (SELECT * FROM {_TRIES} QUALIFY row_number() OVER (PARTITION BY filename ORDER BY attempt DESC) = 1) WHERE error IS NOT NULL"""
)
def retry_failed(spark: SparkSession, directory: str) -> DataFrame:
    """Files whose last try failed are extracted again; the table then has both tries."""
    wrong = F.col("event_type") == "error"
    tries = read_table(spark, directory, "events").select(
        F.col("user_id").cast("string").alias("filename"),
        F.lit("k").alias("bucket"),
        F.col("event_id").alias("attempt"),
        F.when(wrong, F.lit("ERROR: failed")).otherwise(F.col("props")).alias("extracted_text"),
        F.when(wrong, F.lit("failed")).alias("error"),
    )
    path = work_path(spark, "tries")
    tries.write.parquet(path)

    def fetch(bucket: str, name: str) -> bytes:
        if name.endswith("7"):
            raise FileNotFoundError("gone")
        return f"{bucket}/{name}".encode()

    return ingest.retry_table(
        spark, path, ["attempt"], PLAIN_EXTRACTORS, fetch, lambda again: again.withColumn("attempt", F.col("attempt") + 1_000_000)
    )


_OFFERED = """(SELECT url AS filename, page_id, NULL AS error FROM pages
    UNION ALL SELECT 'lost-' || page_id, page_id, 'broken' FROM pages WHERE page_id % 10 = 0)"""


@query(
    f"""SELECT 'registry' AS kind, filename, 'documents' AS bucket, 'PENDING_OCR' AS status, NULL::BIGINT AS n FROM (
      SELECT DISTINCT filename FROM {_OFFERED} WHERE error IS NULL AND filename NOT LIKE 'http://%')
    UNION ALL SELECT 'event', filename, NULL, 'UPLOADED', NULL FROM {_OFFERED} WHERE error IS NULL
    UNION ALL SELECT 'report', 'found', NULL, NULL, count(*) FROM {_OFFERED}
    UNION ALL SELECT 'report', 'succeeded', NULL, NULL, count(*) FROM {_OFFERED} WHERE error IS NULL
    UNION ALL SELECT 'report', 'failed', NULL, NULL, count(*) FROM {_OFFERED} WHERE error IS NOT NULL"""
)
def ingest_batch(spark: SparkSession, directory: str) -> DataFrame:
    """Pages are uploaded, those with a plain-http address are known, some files fail.
    Rows to insert, events and report in one table."""
    pages = read_table(spark, directory, "pages").select(F.col("url").alias("filename"), "page_id")
    lost = pages.where(F.col("page_id") % 10 == 0).withColumn("filename", F.concat(F.lit("lost-"), F.col("page_id").cast("string")))
    items = pages.withColumn("error", F.lit(None).cast("string")).unionByName(lost.withColumn("error", F.lit("broken")))
    known = pages.where(F.col("filename").startswith("http://"))
    done = ingest.ingest_batch(items, known, ["page_id"], F.col("error").isNotNull())
    none, no_count = F.lit(None).cast("string"), F.lit(None).cast("bigint")
    inserted = done.inserted.select(F.lit("registry").alias("kind"), "filename", "bucket", "status", no_count.alias("n"))
    announced = events.parse(done.events).select(F.lit("event").alias("kind"), "filename", none.alias("bucket"), "status", no_count.alias("n"))
    report = done.report.unpivot([], ["found", "succeeded", "failed"], "filename", "n")
    counted = report.select(F.lit("report").alias("kind"), "filename", none.alias("bucket"), none.alias("status"), "n")
    return inserted.unionByName(announced).unionByName(counted)


# --------------------------------------------------------------------- reports
@query("SELECT count(*) AS n FROM documents")
def document_count(spark: SparkSession, directory: str) -> DataFrame:
    return reports.document_count(read_table(spark, directory, "documents"))


@query("SELECT event_type AS status, count(*) AS n FROM events GROUP BY event_type")
def status_counts(spark: SparkSession, directory: str) -> DataFrame:
    return reports.status_counts(read_table(spark, directory, "events"), "event_type")


STATUS_SENTENCE_SQL = """SELECT 'Trạng thái hệ thống: ' || string_agg(format('{}: {:,}', s, n), ', ' ORDER BY s) AS answer
    FROM (SELECT event_type AS s, count(*) AS n FROM events GROUP BY event_type)"""
COUNT_SENTENCE_SQL = """SELECT format('Hiện tại hệ thống đã nạp được {:,} tài liệu vào kho lưu trữ.', count(*)) AS answer
    FROM documents"""


@query(STATUS_SENTENCE_SQL)
def status_summary(spark: SparkSession, directory: str) -> DataFrame:
    return reports.status_sentence(read_table(spark, directory, "events"), "event_type")


@query(COUNT_SENTENCE_SQL)
def count_summary(spark: SparkSession, directory: str) -> DataFrame:
    return reports.count_sentence(read_table(spark, directory, "documents"))


@query(
    """SELECT count(*) AS found, count(*) FILTER (event_type <> 'error') AS succeeded,
    count(*) FILTER (event_type = 'error') AS failed FROM events"""
)
def ingest_report(spark: SparkSession, directory: str) -> DataFrame:
    return reports.ingest_report(read_table(spark, directory, "events"), F.col("event_type") == "error")


@query(
    """SELECT event_id, ts::VARCHAR AS ts, user_id, event_type, value, props, 'document-system-logs-' || strftime(ts, '%Y.%m.%d') AS log_index
    FROM events"""
)
def log_daily_index(spark: SparkSession, directory: str) -> DataFrame:
    path = work_path(spark, "daily")
    reports.write_daily_log(read_table(spark, directory, "events"), "ts", path)
    return spark.read.parquet(path).withColumn("ts", F.col("ts").cast("string"))


@query(
    """SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS n, count(*) FILTER (event_type = 'error') AS n_errors
    FROM events GROUP BY 1"""
)
def error_report(spark: SparkSession, directory: str) -> DataFrame:
    report = reports.error_report(read_table(spark, directory, "events"), "ts", F.col("event_type") == "error")
    return report.withColumn("day", F.col("day").cast("string"))


# -------------------------------------------------------------------- sessions
def messages(spark: SparkSession, directory: str) -> DataFrame:
    return read_table(spark, directory, "conversations").select(
        F.col("conv_id").alias("session_id"), F.col("turn").alias("seq"), "role", F.col("text").alias("content")
    )


_MESSAGES = "(SELECT conv_id AS session_id, turn AS seq, role, text AS content FROM conversations)"
_CHAT = f"(SELECT * FROM {_MESSAGES} WHERE role IN ('user', 'assistant'))"
LAST_SQL = f"""SELECT session_id, seq, role, content FROM {_CHAT}
    QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY seq DESC) <= {{n}}"""


@query(LAST_SQL.format(n=4))
def last_turns(spark: SparkSession, directory: str) -> DataFrame:
    return sessions.last_messages(messages(spark, directory), 4)


@query(
    f"""WITH asked AS (SELECT DISTINCT session_id * 2 AS session_id FROM {_MESSAGES}),
    kept AS ({LAST_SQL.format(n=4)})
    SELECT asked.session_id, count(kept.seq) AS count FROM asked LEFT JOIN kept USING (session_id) GROUP BY 1"""
)
def history_counts(spark: SparkSession, directory: str) -> DataFrame:
    """Asks for every second session id, up to twice the largest, so many are unknown."""
    rows = messages(spark, directory)
    requested = rows.select((F.col("session_id") * 2).alias("session_id")).distinct()
    return sessions.history_counts(requested, rows, 4)


_TURNS = f"""SELECT session_id, arg_min(content, seq) AS question FROM {_MESSAGES} WHERE role = 'user' GROUP BY 1"""


@query(
    f"""WITH turns AS ({_TURNS}), ends AS (SELECT session_id, max(seq) AS e FROM {_MESSAGES} GROUP BY 1),
    merged AS (SELECT * FROM {_CHAT}
      UNION ALL SELECT session_id, e + 1 + 2 * nth, 'user', question FROM turns JOIN ends USING (session_id), range(2) t(nth)
      UNION ALL SELECT session_id, e + 2 + 2 * nth, 'assistant',
        CASE WHEN session_id % 4 = 0 THEN 'No response' ELSE 'Re ' || nth || ': ' || question END
        FROM turns JOIN ends USING (session_id), range(2) t(nth))
    SELECT session_id, seq, role, content FROM merged
    QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY seq DESC) <= 5"""
)
def append_turns(spark: SparkSession, directory: str) -> DataFrame:
    """Every session asks its first question twice more; a quarter gets no reply."""
    rows = messages(spark, directory)
    turns = sessions.session_titles(rows).select(
        F.col("id").alias("session_id"),
        F.col("title").alias("question"),
        F.explode(F.sequence(F.lit(0), F.lit(1))).alias("nth"),
    )
    reply = F.when(F.col("session_id") % 4 != 0, F.concat(F.lit("Re "), F.col("nth").cast("string"), F.lit(": "), "question"))
    return sessions.append_turns(rows, turns.withColumn("answer", reply), 5, order=["nth"])


@query(
    f"""WITH first AS (SELECT session_id, arg_min(role, seq) AS label FROM {_MESSAGES} GROUP BY 1), titles AS ({_TURNS})
    SELECT label, session_id AS id, question AS title, session_id // 10 AS page
    FROM first JOIN titles USING (session_id)"""
)
def session_groups(spark: SparkSession, directory: str) -> DataFrame:
    """Sessions under the role that opened them."""
    rows = messages(spark, directory)
    labels = rows.groupBy(F.col("session_id").alias("id")).agg(F.min_by("role", "seq").alias("label"))
    groups = sessions.session_groups(sessions.session_titles(rows).join(labels, "id"), per_page=10)
    return groups.select("label", "page", F.inline("chats"))


@query(
    f"""SELECT conv_id, turn, CASE WHEN length(trim(t, {WS_LIST})) > 0 THEN NULL ELSE 'No message provided' END AS error
    FROM (SELECT conv_id, turn, text AS t FROM conversations
      UNION ALL SELECT conv_id, turn + 1000, CASE WHEN conv_id % 2 = 0 THEN chr(160) || ' ' END FROM conversations WHERE turn = 1)"""
)
def valid_questions(spark: SparkSession, directory: str) -> DataFrame:
    """All messages, and added blank and missing ones, as the table has none."""
    asked = read_table(spark, directory, "conversations").select("conv_id", "turn", F.col("text").alias("question"))
    added = asked.where("turn = 1").select(
        "conv_id", (F.col("turn") + 1000).alias("turn"), F.when(F.col("conv_id") % 2 == 0, "\xa0 ").alias("question")
    )
    valid, rejected = answers.split_questions(asked.unionByName(added))
    return valid.withColumn("error", F.lit(None).cast("string")).unionByName(rejected).drop("question")


@query(
    f"""WITH q AS (SELECT doc_id AS qid, trim(lower(text), {WS_LIST}) AS k FROM documents),
    d AS (SELECT k, min(qid) AS first_qid, count(*) AS n_asked FROM q GROUP BY k)
    SELECT qid, first_qid, n_asked, 'answer ' || first_qid AS answer FROM q JOIN d USING (k)"""
)
def dedup_questions(spark: SparkSession, directory: str) -> DataFrame:
    """Documents, many of them copies, stand in for questions."""
    questions = documents(spark, directory).select(
        F.col("doc_id").alias("qid"), F.col("text").alias("question")
    )
    answered = answers.distinct_questions(questions).select(
        "question_key",
        F.col("qid").alias("first_qid"),
        "n_asked",
        F.concat(F.lit("answer "), F.col("qid").cast("string")).alias("answer"),
    )
    return answers.share_answers(questions, materialise(answered, "answered")).select("qid", "first_qid", "n_asked", "answer")


@query(
    f"""WITH q AS (SELECT doc_id AS qid, trim(lower(text), {WS_LIST}) AS k FROM documents),
    d AS (SELECT k, min(qid) FILTER (qid % 3 < 2) AS early, min(qid) AS first_qid FROM q GROUP BY k)
    SELECT qid, CASE WHEN early IS NOT NULL THEN 'first' ELSE 'second' END AS author,
    CASE WHEN early IS NOT NULL THEN 'first answer ' || early ELSE 'second answer ' || first_qid END AS answer FROM q JOIN d USING (k)"""
)
def kept_answers(spark: SparkSession, directory: str) -> DataFrame:
    """Two thirds of the questions are asked first; when all are, the model is only called for new ones."""
    questions = documents(spark, directory).select(F.col("doc_id").alias("qid"), F.col("text").alias("question"))
    path = work_path(spark, "answers")

    def model(name: str):
        return lambda new: new.select("qid", F.concat(F.lit(f"{name} answer "), F.col("qid").cast("string")).alias("answer"))

    answer_cache.answer_once(questions.where("qid % 3 < 2"), path, model("first"), run_id="first")
    return answer_cache.answer_once(questions, path, model("second"), run_id="second").select("qid", "author", "answer")
