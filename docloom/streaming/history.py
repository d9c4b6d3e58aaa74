"""Bounded chat history as keyed state.

The state of a session is a list of its last messages and nothing else, so it
stays the same size however long the session goes on. It survives restarts in the
query's checkpoint, and can be read from there like a table.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from docloom import fixed_values as fv
from docloom.functions.chat import is_chat_role
from docloom.session import keyed_state
from docloom.streaming.jobs import append_to

STATE = "messages"
_MESSAGE = T.StructType([T.StructField("seq", T.LongType()), T.StructField("role", T.StringType()), T.StructField("content", T.StringType())])


class LastMessages(StatefulProcessor):
    """Keeps the last ``n`` messages of a session, one per ``seq``; the first one that came stays.

    With ``idle_ms`` a session ends when the watermark has passed its last message by that
    much: its state is cleared and a row tells so.
    """

    def __init__(self, n: int, idle_ms: int | None):
        self.n, self.idle_ms = n, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.messages = handle.getListState(STATE, _MESSAGE)
        self.latest = handle.getValueState("latest", "at_ms long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = {int(seq): (role, content) for seq, role, content in self.messages.get()} if self.messages.exists() else {}
        known, last = set(held), None
        for batch in rows:
            for seq, role, content in batch[["seq", "role", "content"]].itertuples(index=False, name=None):
                held.setdefault(int(seq), (role, content))
            if len(held) > 4 * self.n:
                held = {seq: held[seq] for seq in heapq.nlargest(self.n, held)}
            if self.idle_ms is not None:
                last = max([x for x in (last, batch["at_ms"].max()) if x is not None])
        held = {seq: held[seq] for seq in sorted(heapq.nlargest(self.n, held))}
        self.messages.put([(seq, *held[seq]) for seq in held])
        if self.idle_ms is not None:
            before = self.latest.get()[0] if self.latest.exists() else None
            last = int(last) if before is None else max(int(last), int(before))
            self.latest.update((last,))
            if before is None or last > before:
                for timer in list(self.handle.listTimers()):
                    self.handle.deleteTimer(timer)
                self.handle.registerTimer(last + self.idle_ms)
        added = [seq for seq in held if seq not in known]
        if added:
            yield pd.DataFrame(
                {
                    "session_id": [key[0]] * len(added),
                    "seq": added,
                    "role": [held[seq][0] for seq in added],
                    "content": [held[seq][1] for seq in added],
                    "ended": [False] * len(added),
                }
            )

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.messages.clear()
        self.latest.clear()
        yield pd.DataFrame({"session_id": [key[0]], "seq": [None], "role": [None], "content": [None], "ended": [True]}).astype({"seq": "Int64"})

    def close(self) -> None:
        pass


def _cut(batches: Iterator[pd.DataFrame], n: int) -> Iterator[pd.DataFrame]:
    for batch in batches:
        yield batch.sort_values("seq", kind="stable").groupby("session_id", sort=False).tail(n)


def session_state(messages: DataFrame, n: int = fv.HISTORY_MESSAGES, *, at: str | None = None, idle: str | None = None) -> DataFrame:
    """Stream of messages that entered a session's last ``n``, and of sessions that ended.

    ``messages`` is ``session_id, seq, role, content``. With ``at``, a timestamp column under a
    watermark, and ``idle``, an interval such as "30 minutes", a session without messages for that
    long ends: it gives a row with ``ended`` true, and starts anew with its next message. Messages without
    session, ``seq`` or chat role are left out. A busy session is cut inside every Arrow batch
    before the shuffle; its state never holds more than ``n`` messages.
    """
    if (at is None) != (idle is None):
        raise ValueError("an idle time needs the messages' time, and the other way round")
    idle_ms = None if idle is None else int(pd.Timedelta(idle).total_seconds() * 1000)
    named = [F.col("session_id"), F.col("seq").cast("long").alias("seq"), F.col("role").cast("string").alias("role"), F.col("content").cast("string").alias("content")]
    if at is not None:
        named += [F.col(at), F.unix_millis(F.col(at)).alias("at_ms")]
    chat = messages.where(is_chat_role(F.col("role")) & F.col("session_id").isNotNull() & F.col("seq").isNotNull()).select(*named)
    if at is None:  # a watermark does not pass a function in Python
        chat = chat.mapInPandas(lambda batches: _cut(batches, n), chat.schema)
    out = T.StructType([T.StructField("session_id", chat.schema["session_id"].dataType), *_MESSAGE.fields, T.StructField("ended", T.BooleanType())])
    return chat.groupBy("session_id").transformWithStateInPandas(
        LastMessages(n, idle_ms), out, "Append", "None" if at is None else "EventTime"
    )


def start_sessions(
    messages: DataFrame, checkpoint: str, n: int = fv.HISTORY_MESSAGES, *, path: str | None = None, at: str | None = None, idle: str | None = None, **sink: object
) -> StreamingQuery:
    """Keep the histories of a message stream in its state; changes are appended to ``path``, or
    to nothing if only the state is wanted."""
    if path is None:
        sink.setdefault("table_format", "noop")
    with keyed_state(messages.sparkSession):
        return append_to(session_state(messages, n, at=at, idle=idle), path, checkpoint, **sink)


def histories(spark: SparkSession, checkpoint: str) -> DataFrame:
    """``session_id, seq, role, content``: the last messages of every session, from the state as of
    the last batch that was completed."""
    state = spark.read.format("statestore").option("stateVarName", STATE).load(checkpoint)
    return state.select(F.col("key.session_id").alias("session_id"), "list_element.*")
