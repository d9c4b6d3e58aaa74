"""Chat sessions: bounded history, appended turns, session lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docloom import fixed_values as fv
from docloom.functions.chat import is_chat_role
from docloom.session import cut_before_shuffle

SESSIONS_PER_PAGE = 1_000


def last_messages(messages: DataFrame, n: int = fv.HISTORY_MESSAGES) -> DataFrame:
    """The last ``n`` user/assistant messages of every session.

    Messages are ``session_id, seq, role, content``. The ranking filter is applied
    inside every input partition as well, so a session with very many messages
    sends at most ``n`` per partition through the shuffle.
    """
    cut_before_shuffle(messages.sparkSession, n)
    newest = Window.partitionBy("session_id").orderBy(F.col("seq").desc())
    return (
        messages.where(is_chat_role(F.col("role")))
        .withColumn("_back", F.row_number().over(newest))
        .where(F.col("_back") <= n)
        .drop("_back")
    )


def replies(turns: DataFrame) -> DataFrame:
    """Add ``reply`` to turns with ``answer`` and, where the engine may fail, ``error``.

    A failure becomes an error reply; a missing answer has a fixed text.
    """
    failure = F.concat(F.lit(fv.ENGINE_FAILED), "error") if "error" in turns.columns else F.lit(None)
    return turns.withColumn("reply", F.coalesce(failure, "answer", F.lit(fv.NO_REPLY)))


def append_turns(messages: DataFrame, turns: DataFrame, n: int = fv.HISTORY_MESSAGES, order: list[str] | None = None) -> DataFrame:
    """History after further turns of every session.

    ``turns`` is ``session_id, question, answer`` and optionally ``error``: the user
    message and the reply become two messages after the session's last one. Several
    turns of a session follow one another by ``order`` (default: all their columns).
    """
    kept = last_messages(messages, n)
    ends = messages.groupBy("session_id").agg(F.max("seq").alias("last_seq"))
    sizes = turns.groupBy("session_id").agg(F.count("*").alias("n_turns"))
    latest = Window.partitionBy("session_id").orderBy(*[F.col(c).desc() for c in order or turns.columns])
    # only a session's last turns can stay, so turns are numbered from the end and cut
    numbered = replies(turns).withColumn("_back", F.row_number().over(latest)).where(F.col("_back") <= (n + 1) // 2)
    pair = F.array(
        F.struct(F.lit(1).cast("bigint").alias("step"), F.lit("user").alias("role"), F.col("question").alias("content")),
        F.struct(
            F.lit(2).cast("bigint").alias("step"),
            F.lit("assistant").alias("role"),
            F.col("reply").alias("content"),
        ),
    )
    before = F.coalesce("last_seq", F.lit(-1)) + 2 * (F.col("n_turns") - F.col("_back"))
    added = (
        numbered.join(sizes, "session_id")
        .join(ends, "session_id", "left")
        .select("session_id", before.alias("before"), F.explode(pair).alias("m"))
        .select("session_id", (F.col("before") + F.col("m.step")).alias("seq"), "m.role", "m.content")
    )
    return last_messages(kept.select("session_id", "seq", "role", "content").unionByName(added), n)


def history_counts(requested: DataFrame, messages: DataFrame, n: int = fv.HISTORY_MESSAGES) -> DataFrame:
    """``session_id, count`` for the requested sessions; unknown ones count 0."""
    counted = last_messages(messages, n).groupBy("session_id").agg(F.count("*").alias("count"))
    return requested.join(counted, "session_id", "left").select(
        "session_id", F.coalesce("count", F.lit(0)).alias("count")
    )


def session_titles(messages: DataFrame) -> DataFrame:
    """``id, title``: every session is titled by its first user message."""
    asked = messages.where(F.col("role") == "user")
    return asked.groupBy(F.col("session_id").alias("id")).agg(F.min_by("content", "seq").alias("title"))


def session_groups(sessions: DataFrame, per_page: int = SESSIONS_PER_PAGE) -> DataFrame:
    """``label, page, chats``: sessions listed under their label, in id order.

    A label may hold any number of sessions, so the list comes in pages of an id
    range each: a page never has more than ``per_page`` entries, and all pages of a
    label together are the whole list.
    """
    page = F.expr(f"(id - pmod(id, {per_page})) div {per_page}").alias("page")
    return sessions.groupBy("label", page).agg(F.array_sort(F.collect_list(F.struct("id", "title"))).alias("chats"))
