"""Failing vectors and late models, answers kept between runs, incremental snapshots."""

import time
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from docloom import fixed_values as fv
from docloom.operators import models, search
from docloom.plans import answer_cache
from docloom.plans.requests import answer_requests
from docloom.sources import commits, snapshots


def _local():
    """Functions made inside a function are sent to workers as they are."""

    def picky():
        def encode(texts):
            if any("bad" in t for t in texts):
                raise ValueError("bad text")
            return np.array([[len(t), 1.0] for t in texts], np.float32)

        return encode

    def sleepy(prompts):
        if "hang" in prompts[0]:
            time.sleep(30)
        if "slow" in prompts[0]:
            time.sleep(0.3)
        if "fail" in prompts[0]:
            raise RuntimeError("broken")
        return [p.upper() for p in prompts]

    return picky, sleepy


picky, sleepy = _local()


def test_a_failing_batch_is_halved_until_the_bad_text_is_alone(spark):
    texts = [f"text {k}" if k % 17 else f"bad {k}" for k in range(100)]
    table = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "id int, text string").coalesce(1)
    rows = models.embed(table, picky, dim=2, error="error").collect()
    for row in rows:
        if "bad" in row.text:
            assert row.vector is None and row.error == "bad text"
        else:
            assert row.vector == [len(row.text), 1.0] and row.error is None
    with pytest.raises(Exception, match="bad text"):
        models.embed(table, picky, dim=2).collect()


def test_wrong_vectors_and_models_that_cannot_be_made(spark):
    table = spark.createDataFrame([("a",), ("b",)], "text string")

    def broken():
        raise OSError("no model")

    assert {r.error for r in models.embed(table, broken, dim=2, error="error").collect()} == {"no model"}
    wrong = models.embed(table, lambda: lambda texts: np.zeros((len(texts), 3)), dim=2, error="error").collect()
    assert all(r.vector is None and "dimension 2" in r.error for r in wrong)
    assert models.embed(table.limit(0), picky, dim=2, error="error").collect() == []
    again = models.embed(table.withColumn("error", F.lit(1)).withColumn("vector", F.lit(2)), picky, dim=2, error="error")
    assert again.columns == ["text", "vector", "error"]


def answered(spark, find, questions, **more):
    texts = spark.createDataFrame([(1, "f1", "one"), (2, "f2", "two")], "id bigint, filename string, text string")
    replies = answer_requests(questions, picky, find, texts, {"local": lambda p: ["yes"] * len(p)}, dim=2, **more)
    return {r.qid: r for r in replies.collect()}


def test_requests_whose_retrieval_fails_are_answered_with_the_error(spark):
    rows = spark.createDataFrame([(1, [5.0, 1.0]), (2, [9.0, 1.0])], "id bigint, vector array<float>")
    questions = spark.createDataFrame(
        [(1, "hello", "local", False), (2, "bad one", "local", False), (3, "more", "local", True), (4, "bad two", "local", True)],
        "qid int, question string, provider string, retrieve_only boolean",
    )
    found = answered(spark, lambda asked: search.nearest(asked, rows, 1, dim=2), questions)
    for qid in (2, 4):
        assert (found[qid].answer, found[qid].n_sources, found[qid].sources, found[qid].used_context) == (fv.RETRIEVAL_FAILED + "bad text", 0, [], "")
        assert found[qid].retrieval_error == "bad text"
    assert found[1].answer == "yes" and found[3].answer == fv.RETRIEVE_ONLY % 1 and found[1].retrieval_error is None

    def find(asked):
        broken = asked.where("qid = 1").select("qid", F.lit("index is away").alias("error"))
        return search.nearest(asked.where("qid != 1"), rows, 1, dim=2), broken

    found = answered(spark, find, questions)
    assert found[1].answer == fv.RETRIEVAL_FAILED + "index is away" and found[1].sources == []
    assert found[2].answer == fv.RETRIEVAL_FAILED + "bad text" and found[3].n_sources == 1


def test_a_hanging_call_delays_nothing_beyond_its_limit(spark):
    prompts = ["a", "hang", "b", "slow", "fail", "hang too", *[f"slow {k}" for k in range(20)]]
    table = spark.createDataFrame([(k, p, "local", True) for k, p in enumerate(prompts)], "qid int, prompt string, provider string, has_key boolean").coalesce(1)
    start = time.monotonic()
    found = {r.qid: r.answer for r in models.generate(table, {"local": sleepy}, seconds=2.0, in_flight=4).collect()}
    assert time.monotonic() - start < 12
    late = fv.GENERATION_FAILED.format(provider="local", error="no answer within 2 s")
    assert found[1] == found[5] == late
    assert found[4] == fv.GENERATION_FAILED.format(provider="local", error="broken")
    assert all(found[k] == p.upper() for k, p in enumerate(prompts) if k not in (1, 4, 5))


def test_calls_wait_for_a_free_place():
    now, most = [0], [0]

    def call(k):
        now[0] += 1
        most[0] = max(most[0], now[0])
        time.sleep(0.02)
        now[0] -= 1
        return str(k)

    assert models._Calls(3, 5.0).run([lambda k=k: call(k) for k in range(12)]) == [str(k) for k in range(12)]
    assert most[0] <= 3
    assert models._Calls(3, 5.0).run([]) == []


# -------------------------------------------------------------------- kept answers
AT = datetime(2024, 1, 1, 12)


@pytest.fixture
def model(tmp_path):
    """Answers, and a file per call that tells what was asked."""
    folder = tmp_path / "calls"
    folder.mkdir()

    def make(name, error=""):
        def answer_new(new):
            def run(batches):
                for batch in batches:
                    for qid in batch["qid"]:
                        (folder / f"{name}-{qid}").touch()
                    yield batch.assign(answer=[f"{error}{name}: {q}" for q in batch["question"]])[["qid", "answer"]]

            return new.mapInPandas(run, "qid bigint, answer string")

        return answer_new

    make.calls = lambda: sorted(p.name for p in folder.iterdir())
    return make


def ask(spark, rows, path, function, run_id, at=AT, **more):
    questions = spark.createDataFrame(rows, "qid bigint, question string")
    return {r.qid: (r.answer, r.author) for r in answer_cache.answer_once(questions, path, function, run_id=run_id, at=at, **more).collect()}


def test_second_run_calls_the_model_for_new_questions_only(spark, tmp_path, model):
    path = str(tmp_path / "kept")
    first = ask(spark, [(1, "Why?"), (2, " why? "), (3, "How?"), (9, None)], path, model("a"), "a")
    assert first == {1: ("a: Why?", "a"), 2: ("a: Why?", "a"), 3: ("a: How?", "a"), 9: (None, None)}
    second = ask(spark, [(5, "why?"), (6, "Who?"), (7, "")], path, model("b"), "b")
    assert second == {5: ("a: Why?", "a"), 6: ("b: Who?", "b"), 7: ("b: ", "b")}
    assert model.calls() == ["a-1", "a-3", "b-6", "b-7"]
    assert ask(spark, [(1, "Why?")], path, model("c"), "c", scope="other model") == {1: ("c: Why?", "c")}


def test_answers_expire(spark, tmp_path, model):
    path = str(tmp_path / "kept")
    ask(spark, [(1, "Why?")], path, model("a"), "a", keep_for=timedelta(hours=1))
    assert ask(spark, [(1, "Why?")], path, model("b"), "b", at=AT + timedelta(minutes=59))[1][1] == "a"
    assert ask(spark, [(1, "Why?"), (2, "How?")], path, model("c"), "c", at=AT + timedelta(minutes=61))[1] == ("c: Why?", "c")
    answer_cache.drop_expired(spark, path, AT + timedelta(hours=2))
    assert commits.read_rows(spark, path).count() == 2
    assert ask(spark, [(1, "Why?")], path, model("d"), "d", at=AT + timedelta(hours=2))[1][1] == "c"


def test_the_first_writer_wins_and_errors_are_not_kept(spark, tmp_path, model):
    path = str(tmp_path / "kept")

    def late(new):
        """While this one thinks, another job answers the same question."""
        ask(spark, [(1, "Why?")], path, model("quick"), "quick")
        return model("slow")(new)

    assert ask(spark, [(8, "Why?"), (9, "How?")], path, late, "slow") == {8: ("quick: Why?", "quick"), 9: ("slow: How?", "slow")}
    assert ask(spark, [(1, "Where?")], path, model("x", "[Error] "), "x") == {1: ("[Error] x: Where?", "x")}
    assert ask(spark, [(1, "Where?")], path, model("y"), "y") == {1: ("y: Where?", "y")}
    # a run that is repeated under its id adds nothing
    rows = commits.read_rows(spark, path).count()
    ask(spark, [(1, "Where?")], path, model("y"), "y")
    assert commits.read_rows(spark, path).count() == rows


# ------------------------------------------------------------------------ snapshots
def live(spark, tmp_path):
    path = str(tmp_path / "live")
    spark.range(90).select("id", F.concat(F.lit("v"), "id").alias("v")).repartition(3, "id").write.parquet(path)
    return path


def test_unchanged_files_are_not_copied(spark, tmp_path):
    path, store, target = live(spark, tmp_path), str(tmp_path / "store"), str(tmp_path / "target")
    files = len(spark.read.parquet(path).inputFiles())
    assert snapshots.save_changed(spark, path, store, "one") == {"files": files, "copied": files}
    assert snapshots.save_changed(spark, path, store, "one") == {"files": files, "copied": 0}
    spark.range(90, 95).select("id", F.lit("new").alias("v")).coalesce(1).write.mode("append").parquet(path)
    assert snapshots.save_changed(spark, path, store, "two") == {"files": files + 1, "copied": 1}
    spark.range(90, 95).select("id", F.lit("new").alias("v")).coalesce(1).write.mode("append").parquet(path)
    assert snapshots.save_changed(spark, path, store, "three") == {"files": files + 2, "copied": 0}
    for name, n in (("one", 90), ("three", 100), ("two", 95)):
        restored = snapshots.restore_saved(spark, store, name, target)
        assert restored.count() == n == snapshots.open_restored(spark, target).count()
    assert snapshots.fingerprint(restored).first() == snapshots.fingerprint(spark.read.parquet(path).where("id < 90").union(spark.range(90, 95).select("id", F.lit("new")))).first()
    with pytest.raises(ValueError, match="no snapshot"):
        snapshots.restore_saved(spark, store, "four", target)


def test_a_restore_that_stops_leaves_the_old_table(spark, tmp_path, monkeypatch):
    path, store, target = live(spark, tmp_path), str(tmp_path / "store"), str(tmp_path / "target")
    snapshots.save_changed(spark, path, store, "one")
    held = snapshots.restore_saved(spark, store, "one", target)
    spark.range(5).select("id", F.lit("x").alias("v")).write.mode("append").parquet(path)
    snapshots.save_changed(spark, path, store, "two")

    def stop(*args, **kwargs):
        raise InterruptedError

    with monkeypatch.context() as patch:
        patch.setattr(commits, "commit", stop)
        with pytest.raises(InterruptedError):
            snapshots.restore_saved(spark, store, "two", target)
    assert snapshots.open_restored(spark, target).count() == 90 == held.count()
    assert snapshots.restore_saved(spark, store, "two", target).count() == 95
    assert held.count() == 90


def test_a_damaged_store_is_not_restored(spark, tmp_path):
    path, store, target = live(spark, tmp_path), str(tmp_path / "store"), str(tmp_path / "target")
    snapshots.save_changed(spark, path, store, "one")
    place = snapshots.manifest(spark, store, "one").first()
    folder = f"{store}/data/part={place.place}/_content={place.content}"
    spark.range(1).select("id", F.lit("more").alias("v")).write.mode("append").parquet(folder)
    with pytest.raises(ValueError, match="manifest"):
        snapshots.restore_saved(spark, store, "one", target)
