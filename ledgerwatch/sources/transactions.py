"""Transaction events on a topic or in files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerwatch.config import TRANSACTION_TOPIC
from ledgerwatch.operators.intake import columns_to_wire, wire_to_columns
from ledgerwatch.schemas import TRANSACTION, TRANSACTION_JSON

_POSITION = T.StructType(
    [
        T.StructField("topic", T.StringType()),
        T.StructField("partition_no", T.IntegerType()),
        T.StructField("offset_no", T.LongType()),
    ]
)
_WIRE_FILE = T.StructType([T.StructField("value", T.StringType()), *_POSITION.fields])


def read_raw_stream(
    spark: SparkSession, fmt: str, options: dict[str, str], path: str | None = None
) -> DataFrame:
    """(topic, partition_no, offset_no, value) as a stream.

    ``kafka`` reads the topic from the earliest offset unless told otherwise; ``json`` and
    ``parquet`` read a folder whose files carry the same columns.
    """
    if fmt == "kafka":
        settings = {"subscribe": TRANSACTION_TOPIC, "startingOffsets": "earliest", **options}
        source = spark.readStream.format("kafka").options(**settings).load()
        return source.select(
            "topic",
            F.col("partition").alias("partition_no"),
            F.col("offset").alias("offset_no"),
            F.col("value").cast("string").alias("value"),
        )
    reader = spark.readStream.format(fmt).schema(_WIRE_FILE).options(**options)
    return reader.load(path).select("topic", "partition_no", "offset_no", "value")


def read_transaction_stream(
    spark: SparkSession, fmt: str, options: dict[str, str], path: str | None = None
) -> DataFrame:
    """Parsed transaction rows with their source position. Payloads that do not parse come
    out with NULL fields; use ``parse_guard`` on the raw stream to route them."""
    raw = read_raw_stream(spark, fmt, options, path)
    parsed = raw.withColumn("__event", F.from_json("value", TRANSACTION_JSON))
    return parsed.select(
        "topic", "partition_no", "offset_no", *wire_to_columns(F.col("__event"))
    )


def read_row_stream(
    spark: SparkSession, path: str, options: dict[str, str] | None = None
) -> DataFrame:
    """Parquet files of already typed transaction rows, as a stream."""
    schema = T.StructType([*_POSITION.fields, *TRANSACTION.fields])
    return spark.readStream.schema(schema).options(**(options or {})).parquet(path)


def to_messages(df: DataFrame) -> DataFrame:
    """(key, value): keyed by user, so that one user stays in one ordered partition."""
    return df.select(
        F.col("user_id").alias("key"), F.to_json(columns_to_wire()).alias("value")
    )


def write_transactions(
    df: DataFrame,
    fmt: str,
    target: str,
    options: dict[str, str] | None = None,
    mode: str = "append",
) -> None:
    """Publish a batch. Kafka partitions by key itself. Files keep each user's rows together
    and time-ordered inside a file; a hot user is spread over files by hour, so no task
    writes all rows of one user."""
    if fmt == "kafka":
        settings = {"topic": target, **(options or {})}
        to_messages(df).write.format("kafka").options(**settings).save()
        return
    hour = F.date_trunc("hour", F.col("event_time"))
    (
        df.withColumn("__hour", hour)
        .repartition("user_id", "__hour")
        .sortWithinPartitions("user_id", "event_time")
        .drop("__hour")
        .write.format(fmt)
        .options(**(options or {}))
        .mode(mode)
        .save(target)
    )
