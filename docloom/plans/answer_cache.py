"""Answers that are kept between runs and given again until they expire.

Answers are a table of committed parts. Whoever commits an answer to a question first is its author;
an answer that another job found at the same time is not used, also not by that job, so
everyone gives the same one.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import UTC, datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.operators.answers import distinct_questions, share_answers
from docloom.session import materialise
from docloom.sources import commits


def kept_answers(spark: SparkSession, path: str, scope: str, at: datetime) -> DataFrame | None:
    """``question_key, answer`` valid at a moment: of every question the first that was committed
    among those that have not expired. None if nothing was ever kept."""
    stored = commits.read_rows(spark, path)
    if stored is None:
        return None
    valid = stored.where((F.col("scope") == scope) & (F.col("written_at") <= F.lit(at)) & (F.col("expires_at") > F.lit(at)))
    first = F.min(F.struct("number", "written_at", "author", "answer")).alias("first")
    return valid.groupBy("question_key").agg(first).select("question_key", "first.answer", "first.author")


def answer_once(
    questions: DataFrame,
    path: str,
    answer_new: Callable[[DataFrame], DataFrame],
    *,
    run_id: str,
    keep_for: timedelta = timedelta(days=1),
    scope: str = "",
    at: datetime | None = None,
    keep: Callable[[Column], Column] = lambda answer: ~answer.startswith("[Error]"),
) -> DataFrame:
    """``qid, question_key, answer, author`` for every question of ``questions`` (``qid, question``).

    Only questions without a kept answer go to ``answer_new``, one per identical question; it takes
    ``qid, question`` and returns ``qid, answer``. New answers for which ``keep`` holds are
    kept for ``keep_for``, the others (errors) are given once. ``scope`` separates answers that
    must not be mixed, such as those of two models. A run that is repeated under its ``run_id`` does not add
    its answers twice. A NULL question gets a NULL answer; an empty one is a question like any other.
    """
    spark, at = questions.sparkSession, at or datetime.now(UTC).replace(tzinfo=None)
    asked = materialise(distinct_questions(questions).where(F.col("question_key").isNotNull()), "asked")
    kept = kept_answers(spark, path, scope, at)
    missing = asked if kept is None else asked.join(kept, "question_key", "left_anti")
    fresh = missing.select("question_key", "qid").join(questions.select("qid", "question").dropDuplicates(["qid"]), "qid")
    fresh = materialise(fresh, "missing")
    answered = answer_new(fresh.select("qid", "question")).select("qid", "answer")
    added = materialise(fresh.select("qid", "question_key").join(answered, "qid", "left"), "new-answers")

    before = commits.read_version(spark, f"{path}/commits")
    number = before.number + 1
    rows = added.where(keep(F.col("answer")) & F.col("answer").isNotNull()).select(
        F.lit(scope).alias("scope"),
        "question_key",
        "answer",
        F.lit(run_id).alias("author"),
        F.lit(at).cast("timestamp_ntz").alias("written_at"),
        F.lit(at + keep_for).cast("timestamp_ntz").alias("expires_at"),
        F.lit(number).cast("bigint").alias("number"),
    )
    if run_id not in before.commit_ids:
        commits.add_rows(rows, path, run_id, number)
    # another job may have been first with some of them
    settled = kept_answers(spark, path, scope, at)
    own = added.select("question_key", F.col("answer").alias("own_answer"))
    final = asked.join(settled, "question_key", "left").join(own, "question_key", "left").select(
        "question_key", "n_asked", F.coalesce("answer", "own_answer").alias("answer"), F.coalesce("author", F.lit(run_id)).alias("author")
    )
    return share_answers(questions.select("qid", "question"), materialise(final, "answers")).select("qid", "question_key", "answer", "author")


def drop_expired(spark: SparkSession, path: str, at: datetime | None = None) -> None:
    """Compact the table to what is still valid, while others add to it."""
    at = at or datetime.now(UTC).replace(tzinfo=None)
    version = commits.read_version(spark, f"{path}/commits")
    stored = commits.read_rows(spark, path, version)
    if stored is None:
        return
    part = commits.new_part("compact")
    stored.where(F.col("expires_at") > F.lit(at)).write.mode("error").parquet(f"{path}/rows/part={part}")
    commits.commit(spark, f"{path}/commits", part, part, after=version, replaces=version.parts)
