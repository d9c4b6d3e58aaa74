"""A table of parts, made visible by a log of commits.

A part is a folder written by one job; nobody sees it before a commit names it. A commit
is one small file, which appears as a whole or not at all. So a job that dies leaves
parts nobody reads, and a job that is repeated under the same id finds that its commit
is there. A commit may also replace parts, as compaction does; a reader takes the parts
of one moment and keeps them, as no file is ever changed or overwritten.
"""

from __future__ import annotations

import re
import uuid
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

RECORD = T.StructType(
    [
        T.StructField("commit_id", T.StringType()),
        T.StructField("number", T.LongType()),
        T.StructField("part", T.StringType()),
        T.StructField("replaces", T.ArrayType(T.StringType())),
        T.StructField("facts", T.MapType(T.StringType(), T.StringType())),
    ]
)


@dataclass(frozen=True)
class Version:
    """What was visible when the log was read: parts, the ids of all commits, their facts."""

    number: int = -1
    parts: tuple[str, ...] = ()
    commit_ids: frozenset[str] = frozenset()
    facts: dict[str, str] = field(default_factory=dict)


def new_part(label: str = "part") -> str:
    """A folder name of its own for every attempt."""
    return f"{re.sub(r'[^A-Za-z0-9_-]', '-', label)}-{uuid.uuid4().hex}"


def read_or_none(spark: SparkSession, *paths: str, schema: T.StructType | None = None, base: str | None = None) -> DataFrame | None:
    """A Parquet table, or None where nothing has been written."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    if base is not None:
        reader = reader.option("basePath", base)
    try:
        return reader.parquet(*paths)
    except AnalysisException as error:
        if error.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def read_version(spark: SparkSession, path: str) -> Version:
    """The current version of the log at ``path``: one row per commit reaches the driver.

    Of several commits with one id the first counts: they come from attempts at the same work. A commit
    that replaces parts counts only while all of them are visible, so that of two
    compactions of the same parts one takes effect.
    """
    log = read_or_none(spark, path, schema=RECORD)
    records = [] if log is None else sorted(log.collect(), key=lambda r: (r.number, r.part))
    parts: dict[str, None] = {}
    seen: set[str] = set()
    facts: dict[str, str] = {}
    for record in records:
        if record.commit_id in seen or not all(p in parts for p in record.replaces or []):
            continue
        seen.add(record.commit_id)
        for old in record.replaces or []:
            del parts[old]
        parts[record.part] = None
        facts |= record.facts or {}
    return Version(max((r.number for r in records), default=-1), tuple(parts), frozenset(seen), facts)


def record(
    spark: SparkSession,
    path: str,
    commit_id: str,
    number: int,
    part: str,
    *,
    replaces: tuple[str, ...] = (),
    facts: dict[str, str] | None = None,
) -> None:
    """Make ``part`` visible. The record is one file of one row in a folder of its own, as jobs
    that write to one folder at a time remove each other's unfinished files."""
    known = [F.lit(x) for pair in (facts or {}).items() for x in pair]
    values = {
        "commit_id": F.lit(commit_id),
        "number": F.lit(number),
        "part": F.lit(part),
        "replaces": F.array(*[F.lit(p) for p in replaces]),
        "facts": F.create_map(*known),
    }
    row = spark.range(1).coalesce(1).select(*[values[f.name].cast(f.dataType).alias(f.name) for f in RECORD])
    row.write.mode("error").parquet(f"{path}/commit={part}")


def commit(spark: SparkSession, path: str, commit_id: str, part: str, *, after: Version, **more: object) -> Version:
    """Make ``part`` visible after the version that was read, and read the new one."""
    record(spark, path, commit_id, after.number + 1, part, **more)
    return read_version(spark, path)


def read_parts(spark: SparkSession, path: str, version: Version) -> DataFrame | None:
    """The rows of a version from ``path/part=…``, with the folder columns below it."""
    if not version.parts:
        return None
    found = read_or_none(spark, *[f"{path}/part={p}" for p in version.parts], base=path)
    return None if found is None else found.drop("part")


def add_rows(rows: DataFrame, path: str, commit_id: str, number: int) -> None:
    """Write rows as a part below ``path/rows`` and commit it below ``path/commits``, without reading the
    log. A repeated call under the same id adds nothing that is visible."""
    part = new_part(commit_id)
    rows.write.mode("error").parquet(f"{path}/rows/part={part}")
    record(rows.sparkSession, f"{path}/commits", commit_id, number, part)


def read_rows(spark: SparkSession, path: str, version: Version | None = None) -> DataFrame | None:
    """All visible rows of a table written by ``add_rows``."""
    return read_parts(spark, f"{path}/rows", version or read_version(spark, f"{path}/commits"))


def compact_rows(spark: SparkSession, path: str, min_parts: int = 2) -> Version:
    """The parts of a table written by ``add_rows`` as one, while others add to it."""
    version = read_version(spark, f"{path}/commits")
    if len(version.parts) < min_parts:
        return version
    part = new_part("compact")
    read_rows(spark, path, version).write.mode("error").parquet(f"{path}/rows/part={part}")
    return commit(spark, f"{path}/commits", part, part, after=version, replaces=version.parts)
