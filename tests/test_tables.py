"""Events, registry, sessions, answers, reports and sources on hand-made rows."""

import pytest
from pyspark.sql import functions as F

from docloom import fixed_values as fv
from docloom.operators import answers, registry, reports, sessions
from docloom.plans import ingest
from docloom.session import work_path
from docloom.sources import corpus, directory, events, snapshots


# ---------------------------------------------------------------------- events
def test_parsing(spark):
    values = [
        '{"filename":"a","bucket":"b","size":1,"content_type":"c","status":"UPLOADED"}',
        '{"filename":"a","status":"UPLOADED"}',
        "not json",
        "[]",
        None,
        '{"filename":"big","size":3000000000}',
        '{"filename":"text","size":"12"}',
        '{"filename":"half"',
        "{}",
        "17",
    ]
    table = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, value string")
    rows = events.parse(table, keep=["i"]).orderBy("i").collect()
    assert tuple(rows[0])[1:] == ("a", "b", 1, "c", "UPLOADED", False)
    assert (rows[1].filename, rows[1].bucket, rows[1].is_malformed) == ("a", None, False)
    assert [r.is_malformed for r in rows] == [False, False, True, True, True, False, False, True, False, True]
    assert rows[5].size == 3_000_000_000
    assert (rows[6].filename, rows[6].size) == ("text", None)
    assert all(r.filename is None for r in rows[2:5])


def test_binary_envelopes_and_publish(spark):
    rows = spark.createDataFrame([("x", "né", 5)], "filename string, status string, size bigint")
    sent = events.publish(rows, "filename", ["filename", "status", "size"])
    assert sent.head().key == "x"
    back = events.parse(sent.withColumn("value", F.encode("value", "UTF-8"))).head()
    assert (back.filename, back.status, back.size, back.bucket) == ("x", "né", 5, None)


# -------------------------------------------------------------------- registry
def test_insert_if_absent(spark):
    known = spark.createDataFrame([("a",)], "filename string")
    new = spark.createDataFrame([("a", 1, "x"), ("b", 3, "late"), ("b", 2, "first"), ("c", 4, None)], "filename string, seq int, note string")
    got = registry.insert_if_absent(new, known, ["seq"])
    assert sorted(map(tuple, got.collect())) == [("b", 2, "first"), ("c", 4, None)]
    assert registry.insert_if_absent(new.limit(0), known, ["seq"]).count() == 0


def test_last_put_wins_for_a_hot_key(spark):
    puts = spark.range(30_000).select(
        F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("id")).cast("string").alias("filename"),
        F.col("id").alias("seq"),
        F.concat(F.lit("v"), "id").alias("body"),
    )
    last = registry.last_per_key(puts, "filename", ["seq"])
    assert last.count() == puts.select("filename").distinct().count()
    assert last.where("filename = '0'").head().body == "v29997"


def test_statuses_and_defaults(spark):
    log = spark.createDataFrame(
        [("f", 1, 1, "Pending"), ("f", 2, 1, "Error"), ("g", 2, 2, "Error"), ("g", 2, 3, "Completed")],
        "filename string, ts int, seq int, s string",
    )
    latest = registry.latest_status(log, "filename", "s", ["ts", "seq"])
    assert dict(map(tuple, latest.collect())) == {"f": "Error", "g": "Completed"}
    listed = registry.document_statuses(latest).collect()
    assert {r.uploader for r in listed} == {"Guest"} and {len(r.doc_id) for r in listed} == {8}
    row = registry.registry_rows(spark.createDataFrame([("f", None)], "filename string, bucket string")).head()
    assert (row.bucket, row.status) == ("documents", "PENDING_OCR") and row.created_at is not None


def test_ingest_batch(spark):
    items = spark.createDataFrame([("a", 1, None), ("b", 2, None), ("b", 3, None), ("c", 4, "disk error")], "filename string, seq int, error string")
    known = spark.createDataFrame([("a",)], "filename string")
    done = ingest.ingest_batch(items, known, ["seq"], F.col("error").isNotNull())
    assert tuple(done.report.head()) == (4, 3, 1)
    assert [r.filename for r in done.inserted.collect()] == ["b"]
    sent = events.parse(done.events).collect()
    assert sorted(r.filename for r in sent) == ["a", "b", "b"] and {r.status for r in sent} == {"UPLOADED"}


def test_ingest_runs_the_upload_once(spark, tmp_path):
    for name in ("a.tif", "b.tif", "sub/c.tif", "d.txt"):
        (tmp_path / "in" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "in" / name).write_bytes(b"x")
    registry_path = str(tmp_path / "registry")
    registry.registry_rows(spark.createDataFrame([("a.tif",)], "filename string")).select("filename", "bucket", "status", "created_at").write.parquet(registry_path)
    calls = spark.sparkContext.accumulator(0)

    def upload(found):
        @F.udf("string")
        def put(name):
            calls.add(1)
            return "full" if name.startswith("b") else None

        return found.withColumn("error", put.asNondeterministic()("filename"))

    sent = str(tmp_path / "sent")
    report = ingest.ingest_folder(registry_path, str(tmp_path / "in"), upload, lambda e: events.send(e, "parquet", path=sent), spark)
    assert tuple(report.head()) == (3, 2, 1) and calls.value == 3
    assert sorted(r.filename for r in spark.read.parquet(registry_path).collect()) == ["a.tif", "sub/c.tif"]
    assert sorted(r.key for r in spark.read.parquet(sent).collect()) == ["a.tif", "sub/c.tif"]


def test_texts_are_not_read_to_find_failures(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.createDataFrame([("a", 1, "text", None)], "filename string, seq int, extracted_text string, error string").write.parquet(path)
    plan = ingest.failed_files(spark.read.parquet(path), ["seq"])._jdf.queryExecution().executedPlan().toString()
    assert "extracted_text" not in plan


def test_retry_picks_only_files_whose_last_try_failed(spark):
    rows = spark.createDataFrame(
        [("a", "k", 1, "ERROR: x", "x"), ("a", "k", 2, "fine", None), ("b", "k", 1, "fine", None), ("b", "k", 2, "ERROR: y", "y"), ("c", "k", 1, "ERROR: in the text", None)],
        "filename string, bucket string, seq int, extracted_text string, error string",
    )
    again = ingest.retry_failed(rows, ["seq"], {"text": lambda b: [b.decode()]}, lambda bucket, name: f"{bucket}/{name}".encode())
    assert [(r.filename, r.extracted_text, r.error) for r in again.collect()] == [("b", "k/b", None)]


# -------------------------------------------------------------------- sessions
def chat(spark, counts):
    rows = [(s, i, "user" if i % 2 == 0 else "assistant", f"m{i}") for s, n in counts.items() for i in range(n)]
    return spark.createDataFrame(rows, "session_id bigint, seq bigint, role string, content string")


def test_history_bound(spark):
    rows = chat(spark, {1: 24, 2: 25, 3: 40, 4: 1})
    system = spark.createDataFrame([(4, 99, "system", "s")], rows.schema)
    kept = sessions.last_messages(rows.unionByName(system))
    seqs = {}
    for r in kept.collect():
        seqs.setdefault(r.session_id, []).append(r.seq)
    assert {s: sorted(v) for s, v in seqs.items()} == {1: list(range(24)), 2: list(range(1, 25)), 3: list(range(16, 40)), 4: [0]}
    asked = spark.createDataFrame([(3,), (4,), (77,)], "session_id bigint")
    assert dict(map(tuple, sessions.history_counts(asked, rows).collect())) == {3: 24, 4: 1, 77: 0}


def test_history_cut_happens_before_the_shuffle(spark):
    for n in (24, 5_000):
        plan = sessions.last_messages(chat(spark, {1: 3}), n)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("WindowGroupLimit") == 2


def test_append_turns(spark):
    turns = spark.createDataFrame([(1, "q", "a"), (9, "new", None)], "session_id bigint, question string, answer string")
    got = sessions.append_turns(chat(spark, {1: 24}), turns)
    rows = sorted((r.session_id, r.seq, r.role, r.content) for r in got.collect())
    assert len(rows) == 26 and rows[0][1] == 2
    assert rows[22:] == [(1, 24, "user", "q"), (1, 25, "assistant", "a"), (9, 0, "user", "new"), (9, 1, "assistant", "No response")]


def test_several_turns_of_a_session(spark):
    turns = spark.createDataFrame([(1, f"q{i}", f"a{i}", i) for i in range(30)], "session_id bigint, question string, answer string, turn int")
    got = sessions.append_turns(chat(spark, {1: 3}), turns, 6, order=["turn"])
    rows = sorted((r.seq, r.role, r.content) for r in got.collect())
    assert [r[0] for r in rows] == list(range(57, 63))
    assert [r[2] for r in rows] == ["q27", "a27", "q28", "a28", "q29", "a29"]


def test_failed_turns_get_an_error_reply(spark):
    turns = spark.createDataFrame([(1, "q", None, "timeout"), (2, "q", "a", None)], "session_id bigint, question string, answer string, error string")
    rows = {r.session_id: r.content for r in sessions.append_turns(chat(spark, {}), turns).where("role = 'assistant'").collect()}
    assert rows == {1: "[Error] AI Engine communication failed: timeout", 2: "a"}


def test_request_defaults(spark):
    row = answers.request_defaults(spark.createDataFrame([(1, None)], "qid bigint, session_id string")).head()
    assert (row.session_id, row.provider, row.retrieve_only) == ("default", "local", False)


def test_session_pages_hold_everything(spark):
    table = spark.range(-25, 2_500).select("id", F.concat(F.lit("t"), "id").alias("title"), F.lit("Today").alias("label"))
    pages = sessions.session_groups(table, per_page=100).collect()
    assert max(len(p.chats) for p in pages) <= 100
    listed = [c.id for p in sorted(pages, key=lambda p: p.page) for c in p.chats]
    assert listed == list(range(-25, 2_500))


# --------------------------------------------------------------------- answers
@pytest.fixture
def hits(spark):
    return spark.createDataFrame(
        [(1, 10, 0.25, 1, "a#chunk-0", "alpha"), (1, 11, 0.5, 2, "b#chunk-1", "beta"), (1, 12, 1.0, 3, "a#chunk-7", "x" * 4000)],
        "qid bigint, id bigint, l2_sq double, rank bigint, filename string, text string",
    )


def test_context_and_replies(spark, hits):
    questions = spark.createDataFrame([(1, "what?"), (2, "nothing?"), (3, "broken?")], "qid bigint, question string")
    context = answers.build_context(hits)
    row = context.head()
    assert row.context.startswith("[Source: a#chunk-0 | score=0.2500]\nalpha\n\n[Source: b#chunk-1 | score=0.5000]\nbeta\n\n")
    assert [s.filename for s in row.sources] == ["a#chunk-0", "b#chunk-1", "a#chunk-7"] and len(row.sources[2].preview) == 300
    assert answers.build_context(hits, with_score=False).head().context.startswith(
        "\n[Source: a#chunk-0]\nalpha\n\n[Source: b#chunk-1]\nbeta\n\n[Source"
    )
    failed = spark.createDataFrame([(3, "no connection")], "qid bigint, error string")
    replies = {r.qid: r for r in answers.retrieve_only(questions, context, failed).collect()}
    assert replies[1].answer == fv.RETRIEVE_ONLY % 3 and len(replies[1].used_context) == 3000
    assert [s.filename for s in replies[1].sources] == ["a#chunk-0", "b#chunk-1", "a#chunk-7"] and replies[2].sources == []
    assert (replies[2].answer, replies[2].n_sources, replies[2].used_context) == (fv.NO_CONTEXT, 0, "")
    assert replies[3].answer == "[Error] Milvus retrieval failed: no connection"
    prompts = {r.qid: r.prompt for r in answers.build_prompt(questions, context).collect()}
    assert "QUESTION: nothing?" in prompts[2] and "CONTEXT:\n\n\nQUESTION" in prompts[2]


def test_citations_number_sources_by_first_rank(hits):
    assert sorted(map(tuple, answers.citations(hits).collect())) == [(1, 1, "a", None), (1, 2, "b", None)]


def test_identical_questions_share_one_answer(spark):
    """A third of all rows asks the same thing."""
    questions = spark.range(9_000).select(
        F.col("id").alias("qid"),
        F.when(F.col("id") % 3 == 0, F.lit(" What IS it? ")).otherwise(F.concat(F.lit("q"), "id")).alias("question"),
    )
    groups = answers.distinct_questions(questions)
    assert groups.count() == 6_001 and groups.agg(F.max("n_asked")).head()[0] == 3_000
    path = work_path(spark, "answers")
    groups.select("question_key", "n_asked", F.concat(F.lit("to "), "qid").alias("answer")).write.parquet(path)
    shared = answers.share_answers(questions, spark.read.parquet(path))
    assert shared.count() == 9_000
    assert shared.where("qid % 3 = 0 and answer = 'to 0'").count() == 3_000
    assert shared.where("answer = concat('to ', qid)").count() == 6_001


def test_unanswered_questions_are_kept(spark):
    questions = spark.createDataFrame([(1, "a"), (2, None)], "qid bigint, question string")
    none = spark.createDataFrame([], "question_key string, n_asked bigint, answer string")
    assert answers.share_answers(questions, none).count() == 2


def test_router_messages(spark):
    questions = spark.createDataFrame(
        [(1, "bao nhiêu?"), (2, "trạng thái"), (3, "blank"), (4, "missing"), (5, "fine")], "qid bigint, question string"
    )
    one = spark.createDataFrame([("n",)], "answer string")
    two = spark.createDataFrame([("s",)], "answer string")
    retrieved = spark.createDataFrame([(3, "  "), (5, "ok")], "qid bigint, answer string")
    got = {r.qid: (r.intent, r.answer) for r in answers.route_and_answer(questions, one, two, retrieved).collect()}
    assert got == {
        1: ("count", "n"),
        2: ("status", "s"),
        3: ("retrieve", fv.BLANK_ANSWER),
        4: ("retrieve", fv.BASIC_MODE),
        5: ("retrieve", "ok"),
    }


def test_rejected_questions(spark):
    table = spark.createDataFrame([(1, ""), (2, None), (3, " "), (4, "q")], "qid bigint, question string")
    valid, rejected = answers.split_questions(table)
    assert [r.qid for r in valid.collect()] == [4]
    assert {r.error for r in rejected.collect()} == {"No message provided"} and rejected.count() == 3


# --------------------------------------------------------------------- reports
def test_sentences(spark):
    table = spark.range(1_234).select(F.when(F.col("id") < 1_200, "done").alias("status"))
    assert reports.status_sentence(table).head()[0] == "Trạng thái hệ thống: None: 34, done: 1,200"
    assert "1,234 tài liệu" in reports.count_sentence(table).head()[0]
    many = reports.status_sentence(spark.range(1_500).select(F.col("id").cast("string").alias("status"))).head()[0]
    assert many.count(": 1") == 1_500


# --------------------------------------------------------------------- sources
def test_file_scan(spark, tmp_path):
    for name in ("x/a.tif", "x/y/b.tif", "x/c.TIF", "x/d.txt"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(b"data")
    found = corpus.scan_files(spark, str(tmp_path / "x"))
    assert sorted((r.filename, r.length) for r in found.collect()) == [("a.tif", 4), ("y/b.tif", 4)]
    objects = corpus.read_objects(spark, str(tmp_path / "x"), "*.t*")
    assert sorted((r.filename, bytes(r.content)) for r in objects.collect())[0] == ("a.tif", b"data")


def test_file_scan_lists_once_in_bounded_tasks(spark, tmp_path):
    setting = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    kept, cores = spark.conf.get(setting), spark.sparkContext.defaultParallelism
    for n in range(8 * cores):
        (tmp_path / f"x/{n}").mkdir(parents=True)
        (tmp_path / f"x/{n}/a.tif").write_bytes(f"data {n}".encode())
    spark.sparkContext.setJobGroup("listing", "listing")
    try:
        found = corpus.scan_files(spark, str(tmp_path / "x"), content=True)
    finally:
        spark.sparkContext._jsc.clearJobGroup()
    status = spark.sparkContext.statusTracker()
    jobs = [status.getJobInfo(j) for j in status.getJobIdsForGroup("listing")]
    tasks = [status.getStageInfo(s).numTasks for job in jobs for s in job.stageIds]
    assert tasks and max(tasks) <= 4 * cores and spark.conf.get(setting) == kept
    rows = found.collect()
    assert {(r.filename, bytes(r.content)) for r in rows} == {(f"{n}/a.tif", f"data {n}".encode()) for n in range(8 * cores)}
    assert all(r.length == len(r.content) for r in rows)


def test_corpus_checks(spark, tmp_path):
    spark.range(3).write.parquet(str(tmp_path / "bad"))
    with pytest.raises(ValueError, match="content_html"):
        corpus.read_corpus(spark, [str(tmp_path / "bad")])
    with pytest.raises(FileNotFoundError):
        corpus.read_corpus(spark, [str(tmp_path / "none")])


def test_corpus_window(spark):
    table = spark.range(100).select(F.col("id").alias("k"), F.lit("text").alias("t")).repartition(5)
    assert sorted(r.k for r in corpus.corpus_window(table, "k", 10, 95).collect()) == [95, 96, 97, 98, 99]
    assert sorted(r.k for r in corpus.corpus_window(table, "k", 3).collect()) == [0, 1, 2]
    assert corpus.corpus_window(table, "k", 3, 100).count() == 0
    assert sorted(r.k for r in corpus.corpus_window(table, "k", 40, 30).collect()) == list(range(30, 70))
    with pytest.raises(ValueError):
        corpus.corpus_window(table, "k", 0)


def test_deep_windows_are_cut_by_range(spark):
    plan = corpus.corpus_window(spark.range(1000).repartition(4), "id", 5, 900)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrdered" not in plan and "GlobalLimit" not in plan


def test_windows_from_a_directory_of_a_thousand_ranges(spark, tmp_path):
    path = str(tmp_path / "rows")
    spark.range(20_000).select((F.col("id") * 3).alias("k"), F.lit("text").alias("t")).repartition(4).write.parquet(path)
    table = spark.read.parquet(path)
    pages = directory.build_directory(table, "k", str(tmp_path / "order"), rows_per_range=20)
    assert pages.ranges.count() == 1000 and pages.ranges.agg(F.max("n_rows")).first()[0] < 200
    again = directory.open_directory(spark, str(tmp_path / "order"))
    for offset, limit in ((0, 1), (7, 30), (9_990, 500), (19_999, 5), (20_000, 5)):
        rows = directory.read_window(again, table, "k", limit, offset)
        assert sorted(r.k for r in rows.collect()) == [3 * n for n in range(offset, min(20_000, offset + limit))]
    plan = directory.read_window(again, table, "k", 5, 100)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(k,300)" in plan and "LessThanOrEqual(k,312)" in plan and "Exchange" not in plan
    with pytest.raises(ValueError):
        directory.read_window(again, table, "k", 0)


def test_directory_of_an_empty_table_and_of_rows_without_keys(spark, tmp_path):
    table = spark.createDataFrame([(None, "a"), (2, "b"), (1, "c")], "k int, t string")
    pages = directory.build_directory(table, "k", str(tmp_path / "one"))
    assert [r.t for r in directory.read_window(pages, table, "k", 9, 1).collect()] == ["b"]
    empty = directory.build_directory(table.limit(0), "k", str(tmp_path / "none"))
    assert directory.read_window(empty, table, "k", 9).count() == 0


def test_snapshot(spark, tmp_path):
    table = spark.range(50).select("id", F.array(F.col("id").cast("float")).alias("v")).repartition(3)
    path, target = str(tmp_path / "s"), str(tmp_path / "t")
    snapshots.write_snapshot({"a": table}, path)
    snapshots.write_snapshot({"a": spark.range(5).select("id", F.array(F.col("id").cast("float")).alias("v"))}, f"{path}-old")
    assert snapshots.restore_snapshot(spark, f"{path}-old", "a", target).count() == 5
    assert snapshots.restore_snapshot(spark, path, "a", target).count() == 50
    table.limit(2).write.mode("append").parquet(f"{path}/a/data")
    with pytest.raises(ValueError, match="manifest"):
        snapshots.restore_snapshot(spark, path, "a", target)
    assert snapshots.open_restored(spark, target).count() == 50


def test_fingerprint_ignores_order_and_sees_copies(spark):
    table = spark.range(20)
    one = snapshots.fingerprint(table).head()
    assert one == snapshots.fingerprint(table.orderBy(F.desc("id")).repartition(4)).head()
    doubled = snapshots.fingerprint(table.union(table)).head()
    assert doubled.hash_xor == 0 and doubled.hash_sum == 2 * one.hash_sum


def test_work_path_uses_the_shared_folder(spark):
    base = spark.conf.get("spark.checkpoint.dir")
    assert work_path(spark, "a").startswith(base) and work_path(spark, "a") != work_path(spark, "a")
