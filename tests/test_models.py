"""Extraction, embedding and generation with stand-in models."""

import sys

import numpy as np
import pytest
from pyspark.sql import functions as F

from docloom import fixed_values as fv
from docloom.functions.text import chunk_text
from docloom.operators import models, search
from docloom.plans.corpus_index import index_corpus
from docloom.plans.requests import answer_requests


def test_extraction_isolates_failures(spark):
    files = spark.createDataFrame(
        [("a.PNG", "b", bytearray(b"one two\nthree ")), ("b.txt", "b", bytearray(b"l1\nl2\n")), ("c.txt", "b", bytearray(b"\xff")), ("d.pdf", "b", None), (None, "b", bytearray(b"x"))],
        "filename string, bucket string, content binary",
    )
    rows = {r.filename: (r.extracted_text, r.error) for r in models.extract_text(files, models.PLAIN_EXTRACTORS).collect()}
    assert rows["a.PNG"] == ("one two three", None)
    assert rows["b.txt"] == ("l1\nl2", None)
    assert rows["c.txt"][0].startswith("ERROR: ") and rows["c.txt"][1] in rows["c.txt"][0]
    assert rows["d.pdf"] == ("ERROR: no content", "no content")
    assert rows[None] == ("ERROR: no file name", "no file name")


def test_extraction_fetches_in_the_task(spark):
    files = spark.createDataFrame([("a.txt", "k"), ("gone.txt", "k")], "filename string, bucket string")

    def fetch(bucket, filename):
        if filename == "gone.txt":
            raise FileNotFoundError(filename)
        return f"{bucket}:{filename}".encode()

    rows = {r.filename: r.extracted_text for r in models.extract_text(files, models.PLAIN_EXTRACTORS, fetch=fetch).collect()}
    assert rows == {"a.txt": "k:a.txt", "gone.txt": "ERROR: gone.txt"}


def test_embedding_batches_and_tail(spark):
    def factory():
        def encode(texts):
            assert 0 < len(texts) <= 4
            return np.array([[len(t), len(texts)] for t in texts], dtype=np.float32)

        return encode

    table = spark.createDataFrame([(i, "x" * i if i else None) for i in range(10)], "id int, text string").coalesce(1)
    rows = models.embed(table, factory, dim=2, batch_size=4).orderBy("id").collect()
    assert [r.vector[0] for r in rows] == [float(i) for i in range(10)]
    assert sorted(r.vector[1] for r in rows) == [2.0] * 2 + [4.0] * 8


@pytest.mark.parametrize("error", [None, "error"])
def test_embedding_makes_strings_of_one_batch_at_a_time(spark, error):
    def factory():
        before = sys.getallocatedblocks()

        def encode(texts):
            return np.array([[len(t), sys.getallocatedblocks() - before] for t in texts], dtype=np.float32)

        return encode

    table = spark.range(0, 20_000, 1, 1).select("id", F.concat(F.lit("text "), "id").alias("text"))
    rows = models.embed(table, factory, dim=2, error=error).collect()
    assert sorted(r.id for r in rows) == list(range(20_000))
    assert all(r.vector[0] == len(r.text) for r in rows)
    held = [r.vector[1] for r in rows if r.id < 32]  # nothing has been made of the others yet
    assert max(held) < 5_000


def test_embedding_dimension_is_checked(spark):
    table = spark.createDataFrame([("a",)], "text string")
    with pytest.raises(Exception, match="dimension 3"):
        models.embed(table, models.hashed_tokens(4), dim=3).collect()


def test_model_runs_once_per_row(spark):
    """Filters on the vector must not make Spark run the model again."""
    embedded = models.embed(spark.range(5).select(F.lit("a b").alias("text")), models.hashed_tokens(4), dim=4)
    plan = embedded.select(F.explode("vector").alias("x")).where("x > 0")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1


def test_generation(spark):
    prompts = spark.createDataFrame(
        [(1, "p", "local", False), (2, "p", "google", False), (3, "p", "google", True), (4, "boom", "local", False), (5, "none", "local", False), (6, "p", "else", True)],
        "qid int, prompt string, provider string, has_key boolean",
    )

    def local(texts):
        if "boom" in texts:
            raise RuntimeError("down")
        return [None if text == "none" else text.upper() for text in texts]

    rows = {r.qid: r.answer for r in models.generate(prompts, lambda: {"local": local, "google": local}).collect()}
    assert rows[1] == "P" and rows[3] == "P" and rows[2] == fv.MISSING_KEY and rows[5] == fv.NO_MODEL_ANSWER
    assert rows[4] == "[Error] local LLM inference failed: down"
    assert rows[6].startswith("[Error] else LLM inference failed: ")


def test_index_job_drops_empty_documents(spark, tmp_path):
    body = "<p>" + "word and more " * 200 + "</p>"
    corpus = spark.createDataFrame([("1", body), ("2", "<br/>"), ("3", None), ("4", body)], "id string, content_html string")
    built = index_corpus(corpus, models.hashed_tokens(8), str(tmp_path / "job"), dim=8, source="pages", nlist=2)
    rows = built.rows.collect()
    assert {r.doc_id for r in rows} == {"1", "4"}
    want = spark.createDataFrame([("word and more " * 200,)], "t string").select(F.size(chunk_text(F.trim("t")))).head()[0]
    assert len(rows) == 2 * want
    assert {r.filename for r in rows if r.doc_id == "1"} == {f"pages:1#chunk-{i}" for i in range(want)}


def test_long_names_give_ids_of_their_own(spark, tmp_path):
    body = "<p>" + "word and more " * 300 + "</p>"
    corpus = spark.createDataFrame([("n" * 260 + str(i), body) for i in range(2)], "id string, content_html string")
    built = index_corpus(corpus, models.hashed_tokens(8), str(tmp_path / "job"), dim=8, source="pages", nlist=1)
    rows = built.rows
    assert rows.count() == rows.select("id").distinct().count() > 4 and rows.select("filename").distinct().count() == 1
    questions = models.embed(spark.createDataFrame([(0, "word and more")], "qid long, text string"), models.hashed_tokens(8), dim=8)
    hits = search.hydrate(search.nearest(questions, rows, 5, dim=8), rows.select("id", "filename", "text"))
    assert hits.count() == 5


def test_requests_without_context_reach_no_model(spark):
    calls = spark.sparkContext.accumulator(0)
    texts = spark.createDataFrame([("c1", "f", "alpha beta", "d1"), ("c2", "f", "gamma", "d2")], "id string, filename string, text string, doc_id string")
    rows = models.embed(texts, models.hashed_tokens(8), dim=8)
    requests = spark.createDataFrame(
        [(1, "alpha", None, "local", False), (2, "alpha", "none", "local", False), (3, "gamma", "d2", "google", None), (4, "alpha", None, "local", True), (5, "x", "d1", "broken", None)],
        "qid long, question string, doc_id string, provider string, retrieve_only boolean",
    )

    def local(prompts):
        calls.add(len(prompts))
        return ["yes"] * len(prompts)

    replies = answer_requests(requests, models.hashed_tokens(8), lambda asked: search.nearest_within(asked, rows, "doc_id", dim=8), texts, {"local": local}, dim=8)
    got = {r.qid: r for r in replies.collect()}
    assert calls.value == 1 and got[1].answer == "yes" and len(got[1].sources) == 2
    assert (got[2].answer, got[2].sources, got[2].used_context) == (fv.NO_CONTEXT, [], "")
    assert got[3].answer == fv.MISSING_KEY and [s.filename for s in got[3].sources] == ["f"] and got[3].used_context
    assert got[4].answer == fv.RETRIEVE_ONLY % 2 and got[5].answer.startswith("[Error] broken LLM")


def test_extraction_holds_a_piece_of_its_texts(spark):
    def grow(_):
        pages = int(open("/proc/self/statm").read().split()[1])
        return [f"{pages * 4096 // 1_000_000}:" + "x" * 40_000]

    files = spark.range(0, 4_000, 1, 1).select(
        F.concat(F.lit("f"), "id", F.lit(".txt")).alias("filename"), F.lit("b").alias("bucket"), "id", F.encode(F.lit("-"), "UTF-8").alias("content")
    )
    done = models.extract_text(files, {"text": grow})
    found = done.select("id", "error", F.length("extracted_text").alias("n"), F.substring_index("extracted_text", ":", 1).cast("int").alias("mb")).collect()
    assert sorted(r.id for r in found) == list(range(4_000)) and all(r.n > 40_000 and r.error is None for r in found)
    assert max(r.mb for r in found) - min(r.mb for r in found) < 80  # 160 MB of texts
