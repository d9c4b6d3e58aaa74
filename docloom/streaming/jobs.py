"""Extraction, chat history and log streams."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from docloom import fixed_values as fv
from docloom.functions.chat import is_chat_role
from docloom.functions.files import extractor_route
from docloom.operators.models import Extractors, Fetch, extract_text
from docloom.operators.registry import with_defaults
from docloom.operators.reports import log_index
from docloom.operators.sessions import last_messages
from docloom.sources.events import parse


def append_to(
    stream: DataFrame,
    path: str | None,
    checkpoint: str,
    *,
    table_format: str = "parquet",
    partition_by: list[str] | None = None,
    available_now: bool = True,
    options: dict[str, str] | None = None,
) -> StreamingQuery:
    """Append a stream to a sink: a table at ``path``, exactly once per checkpoint, or any
    other format with its ``options`` and no path (such as a broker)."""
    writer = stream.writeStream.format(table_format).outputMode("append").option("checkpointLocation", checkpoint)
    writer = writer.options(**options or {})
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start(path)


def extracted(envelopes: DataFrame, extractors: Extractors, fetch: Fetch | None = None) -> DataFrame:
    """Upload envelopes -> event columns, ``extracted_text`` and ``error``.

    Malformed envelopes have no file name and end as error rows, not as losses.
    """
    kept = [c for c in envelopes.columns if c == "content"]
    events = with_defaults(parse(envelopes, keep=kept), {"bucket": F.lit(fv.DEFAULT_BUCKET)})
    return extract_text(events, extractors, fetch=fetch)


def start_extraction(
    envelopes: DataFrame,
    extractors: Extractors,
    path: str,
    checkpoint: str,
    *,
    fetch: Fetch | None = None,
    **sink: object,
) -> StreamingQuery:
    return append_to(extracted(envelopes, extractors, fetch), path, checkpoint, **sink)


def start_routing(
    envelopes: DataFrame,
    extractors: Extractors,
    path: str,
    checkpoint: str,
    *,
    fetch: Fetch | None = None,
    **sink: object,
) -> StreamingQuery:
    """Extracted text handed on as ``topic, key, value``, one folder per route.

    One pass and one exactly-once sink serve all routes. A Kafka sink reads the same
    three columns.
    """
    done = extracted(envelopes, extractors, fetch)
    return append_to(
        done.select(
            extractor_route(F.col("filename")).alias("route"),
            F.lit(fv.EXTRACTED_TOPIC).alias("topic"),
            F.col("filename").alias("key"),
            F.to_json(F.struct("filename", "extracted_text", "error")).alias("value"),
        ),
        path,
        checkpoint,
        partition_by=["route"],
        **sink,
    )


# --------------------------------------------------------------------- history
def _trim_batches(batches: Iterator[pd.DataFrame], n: int) -> Iterator[pd.DataFrame]:
    for batch in batches:
        yield batch.sort_values("seq", kind="stable").groupby("session_id", sort=False, dropna=False).tail(n)


def history_updates(messages: DataFrame, n: int = fv.HISTORY_MESSAGES) -> DataFrame:
    """Chat messages that can still be among a session's last ``n``.

    What a session said before is not needed for that, so the stream keeps no state and
    writes every message once at most; a very busy session is cut inside every Arrow batch.
    """
    chat = messages.where(is_chat_role(F.col("role"))).select("session_id", "seq", "role", "content")
    return chat.mapInPandas(partial(_trim_batches, n=n), chat.schema)


def start_history(
    messages: DataFrame, path: str, checkpoint: str, n: int = fv.HISTORY_MESSAGES, **sink: object
) -> StreamingQuery:
    return append_to(history_updates(messages, n), path, checkpoint, **sink)


def current_history(updates: DataFrame, n: int = fv.HISTORY_MESSAGES) -> DataFrame:
    """The last ``n`` messages of every session from the table of updates."""
    return last_messages(updates.select("session_id", "seq", "role", "content"), n)


def compact_history(updates: DataFrame, target: str, n: int = fv.HISTORY_MESSAGES) -> None:
    """Current histories as a new table, in place of one that has grown."""
    current_history(updates, n).write.parquet(target)


# ------------------------------------------------------------------------ logs
def start_daily_log(
    records: DataFrame,
    timestamp: Column,
    path: str,
    checkpoint: str,
    **sink: object,
) -> StreamingQuery:
    """Log records appended to one folder per day index, with all their columns (see
    ``raw`` of ``events.parse`` for records of any shape)."""
    return append_to(records.withColumn("log_index", log_index(timestamp)), path, checkpoint, partition_by=["log_index"], **sink)
