"""From documents to training sequences in five stages, each written and read again.

A stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; all but the last return
the columns of ``documents``. ``run`` applies them in order. Every stage works on all that
the one before kept.
"""

from __future__ import annotations

import functools
import os
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm import contamination, neardup, repetition, sequences, substrings
from docloom.llm.queries import vocabulary
from docloom.session import materialise, read_table, use_work_folder


BATCH_SIZE = "spark.sql.execution.arrow.maxRecordsPerBatch"
#: Rows that go to Python at a time, as they are whole texts on both sides.
BATCH_ROWS = 2_000


def stage(function):
    """A stage that names the work folder of a local session without one, as in tests, and
    sends texts to Python in small batches (a setting of the session, lowered where it is higher)."""

    @functools.wraps(function)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        use_work_folder(spark, os.path.join(tempfile.gettempdir(), f"docloom-work-{os.getpid()}"))
        if not 0 < int(spark.conf.get(BATCH_SIZE)) <= BATCH_ROWS:
            spark.conf.set(BATCH_SIZE, str(BATCH_ROWS))
        return function(spark, docs, sf_dir)

    return run_stage


def renamed(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``text``, and all other columns under names that no operator uses."""
    return docs.select(*[F.col(f"`{c}`").alias(c if c in ("doc_id", "text") else f"given_{k}") for k, c in enumerate(docs.columns)])


def back(found: DataFrame, docs: DataFrame, **changed: Column) -> DataFrame:
    """The columns of ``docs`` under their own names; those in ``changed`` have a new value."""
    names = [c if c in ("doc_id", "text") else f"given_{k}" for k, c in enumerate(docs.columns)]
    return found.select(*[changed.get(c, F.col(name)).alias(c) for c, name in zip(docs.columns, names, strict=True)])


@stage
def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the repetition rules keep.

    NULL and empty texts have too few words and go; repeated rows stay or go alike. All columns
    come back as they were, whatever their names; an empty table stays empty.
    """
    return back(repetition.judge(renamed(docs)).where("kept"), docs)


def _without(docs: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not in the (written) list; a short list is sent to all tasks."""
    if gone.count() <= neardup.BROADCAST_IDS:
        gone = F.broadcast(gone)
    return docs.join(gone, key, "left_anti")


@stage
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one with the smallest id.

    Every row is a document, also without an id or with that of another: where there are such, rows get keys of
    their own and are written with them. An id goes before none, and the first written row before
    others. Equal texts are one group, NULL and empty texts together. All columns come back as they
    were; an empty table stays empty.
    """
    named = renamed(docs)
    shared = docs.groupBy("doc_id").count().where("count > 1 OR doc_id IS NULL")
    if not shared.limit(1).count():
        grouped = neardup.near_duplicates(named.select("doc_id", "text"))
        gone = materialise(grouped.where("doc_id != class_id").select("doc_id"), "gone")
        return back(_without(named, gone, "doc_id"), docs)
    keyed = materialise(named.withColumn("row_key", F.monotonically_increasing_id()), "keyed")
    grouped = neardup.near_duplicates(keyed.select(F.col("row_key").alias("doc_id"), "text"))
    ids = keyed.select("row_key", "doc_id")
    members = materialise(grouped.select(F.col("doc_id").alias("row_key"), "class_id").join(ids, "row_key"), "members")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row_key")).alias("first")
    stays = members.groupBy("class_id").agg(first).select("first.row_key")
    gone = materialise(members.select("row_key").join(stays, "row_key", "left_anti"), "gone")
    return back(_without(keyed, gone, "row_key"), docs)


@stage
def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that an earlier document has; no document goes. A column ``n_chars``
    follows the text; all others come back as they were, whatever their names."""
    cut = substrings.remove_repeats(renamed(docs))
    changed = {}
    if "n_chars" in docs.columns:
        given = F.col(f"given_{docs.columns.index('n_chars')}")
        changed["n_chars"] = F.when(F.col("n_removed") > 0, F.length("text")).otherwise(given).cast(docs.schema["n_chars"].dataType)
    return back(cut, docs, **changed)


@stage
def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated by the benchmark. NULL and empty texts have no words and
    stay; repeated rows stay or go alike. All columns come back as they were; an empty table stays empty."""
    found = contamination.find_contamination(renamed(docs), read_table(spark, sf_dir, "benchmark"))
    return back(found.where("NOT contaminated"), docs)


@stage
def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece of every document in sequences of up to 2048 tokens. NULL and empty texts are
    their end token; repeated rows are packed once each; columns other than the id are left out."""
    return sequences.pack_sequences(docs, vocabulary)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("substring_dedup", substring_dedup),
    ("decontamination", decontamination),
    ("packing", packing),
]

#: Tokens are not a matter of SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, function in STAGES[:-1]:
        docs = materialise(function(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
