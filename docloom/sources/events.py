"""Upload events and their envelopes (``key``, ``value`` as JSON)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom import fixed_values as fv

UPLOAD_EVENT = T.StructType(
    [
        T.StructField("filename", T.StringType()),
        T.StructField("bucket", T.StringType()),
        T.StructField("size", T.LongType()),
        T.StructField("content_type", T.StringType()),
        T.StructField("status", T.StringType()),
    ]
)

_CORRUPT = "_corrupt"


def publish(rows: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Envelopes of ``rows``, ready for any sink that takes key and value."""
    return rows.select(F.col(key).cast("string").alias("key"), F.to_json(F.struct(*fields)).alias("value"))


def send(envelopes: DataFrame, sink: str, **options: str) -> None:
    """Write envelopes to a broker or table: ``sink`` is a Spark data source that takes
    ``key`` and ``value`` (such as ``kafka`` with its servers and topic as options)."""
    envelopes.write.format(sink).options(**options).mode("append").save()


def parse(
    envelopes: DataFrame, schema: T.StructType = UPLOAD_EVENT, keep: list[str] | None = None, raw: str | None = None
) -> DataFrame:
    """Event columns plus ``is_malformed``; ``raw`` names a column for the record as it came,
    which keeps fields that the schema does not declare.

    A value that is not a JSON object gives NULL columns and is flagged; a field the
    event does not carry, or of the wrong type, is NULL.
    """
    text = F.col("value").cast("string")
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _CORRUPT}
    event = F.from_json(text, T.StructType([*schema.fields, T.StructField(_CORRUPT, T.StringType())]), options)
    # Only a record that did not fit the schema is looked at a second time.
    fits = F.col("_event").isNotNull() & F.col("_event")[_CORRUPT].isNull()
    shown = F.when(fits, F.ltrim(text)).otherwise(F.get_json_object(text, "$"))
    is_object = F.coalesce(F.startswith(shown, F.lit("{")), F.lit(False))
    kept = keep or []
    return envelopes.select(*kept, "value", event.alias("_event")).select(
        *kept, *[F.col("_event")[f.name].alias(f.name) for f in schema], (~is_object).alias("is_malformed"), *([text.alias(raw)] if raw else [])
    )


def kafka_events(
    spark: SparkSession, servers: str, topic: str = fv.UPLOADED_TOPIC, starting_offsets: str = "earliest", **options: str
) -> DataFrame:
    """Envelopes of a Kafka topic as a stream; needs Spark's Kafka package."""
    reader = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic)
    return reader.option("startingOffsets", starting_offsets).options(**options).load()
