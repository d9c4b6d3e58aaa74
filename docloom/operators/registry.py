"""The document registry: one row per file name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom import fixed_values as fv
from docloom.functions.files import short_id


def first_per_key(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The first row of every key by ``order``."""
    return _extreme(rows, key, order, newest=False)


def last_per_key(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The last row of every key by ``order``: a put replaces the put before it."""
    return _extreme(rows, key, order, newest=True)


def _extreme(rows: DataFrame, key: str, order: list[str], newest: bool) -> DataFrame:
    """Rank by key and order, the rest of a row breaks ties.

    The ``= 1`` filter on the rank is applied inside every input partition as well,
    so that a hot key sends one row per partition through the shuffle, and wide
    columns are sorted along but never compared unless the order ties.
    """
    rest = [c for c in rows.columns if c != key and c not in order]
    turned = [F.col(c).desc() if newest else F.col(c).asc() for c in [*order, *rest]]
    place = F.row_number().over(Window.partitionBy(key).orderBy(*turned))
    return rows.withColumn("_place", place).where("_place = 1").drop("_place")


def insert_if_absent(new_rows: DataFrame, registry: DataFrame, order: list[str], key: str = "filename") -> DataFrame:
    """Rows to append: keys the registry does not hold, the first of equal new keys."""
    return first_per_key(new_rows, key, order).join(registry.select(key), key, "left_anti")


def latest_status(events: DataFrame, key: str, status: str, order: list[str]) -> DataFrame:
    """Current state of every file: the status of its last event."""
    return events.groupBy(key).agg(F.max_by(status, F.struct(*order)).alias("status"))


def with_defaults(rows: DataFrame, defaults: dict[str, Column]) -> DataFrame:
    """Fill NULL columns, and add missing ones, from ``defaults``."""
    present = set(rows.columns)
    return rows.withColumns(
        {name: F.coalesce(F.col(name), value) if name in present else value for name, value in defaults.items()}
    )


def registry_rows(rows: DataFrame) -> DataFrame:
    """Rows as the registry stores them."""
    return with_defaults(
        rows,
        {
            "bucket": F.lit(fv.DEFAULT_BUCKET),
            "status": F.lit(fv.STATUS_PENDING_OCR),
            "created_at": F.current_timestamp(),
        },
    )


def document_statuses(statuses: DataFrame, key: str = "filename") -> DataFrame:
    """Status list for an operator screen: ``doc_id, filename, status, uploader``."""
    named = statuses.withColumn("filename", F.col(key).cast("string"))
    filled = with_defaults(
        named,
        {
            "doc_id": short_id(F.col("filename")),
            "status": F.lit(fv.STATUS_PENDING),
            "uploader": F.lit(fv.DEFAULT_UPLOADER),
        },
    )
    return filled.select("doc_id", "filename", "status", "uploader")

