"""Intake: validate requests, bound event time, stamp the transaction event."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ledgerwatch.config import (
    CURRENCY,
    EVENT_TYPES,
    MAX_FUTURE_MINUTES,
    SCHEMA_VERSION,
)
from ledgerwatch.functions.numbers import is_decimal_text, plain_decimal
from ledgerwatch.functions.text import blank_to, is_blank, joined
from ledgerwatch.schemas import TRANSACTION_JSON, TRANSACTION_NAMES


def _violations() -> list[tuple[Column, str]]:
    checks = [
        (is_blank(F.col("event_id")), "eventId must not be blank"),
        (is_blank(F.col("user_id")), "userId must not be blank"),
        (is_blank(F.col("account_id")), "accountId must not be blank"),
        (F.col("event_type").isNull(), "eventType must not be null"),
        (
            ~F.col("event_type").isin(*EVENT_TYPES),
            "eventType must be one of " + ",".join(EVENT_TYPES),
        ),
        (F.col("amount").isNull(), "amount must not be null"),
        (F.col("amount") <= 0, "amount must be greater than 0.0"),
        (is_blank(F.col("currency")), "currency must not be blank"),
        (F.col("currency") != CURRENCY, f"currency must be {CURRENCY}"),
        (F.col("event_time").isNull(), "eventTime must not be null"),
    ]
    return sorted(checks, key=lambda check: check[1])


def with_violations(df: DataFrame) -> DataFrame:
    """``violations``: every broken rule as ``field message``, sorted, joined by ``; ``.
    Empty text means the request is acceptable."""
    return df.withColumn("violations", joined("; ", _violations()))


def validate_intake(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected). Both are filters of one projection."""
    checked = with_violations(df)
    return (
        checked.filter("violations = ''").drop("violations"),
        checked.filter("violations <> ''"),
    )


def is_future(skew_minutes: int = MAX_FUTURE_MINUTES) -> Column:
    limit = F.col("received_at") + F.expr(f"INTERVAL {int(skew_minutes)} MINUTES")
    return F.coalesce(F.col("event_time") > limit, F.lit(False))


def reject_future_events(
    df: DataFrame, skew_minutes: int = MAX_FUTURE_MINUTES
) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected): an event strictly more than ``skew_minutes`` ahead of its
    receipt is rejected."""
    future = is_future(skew_minutes)
    reason = F.lit(f"eventTime must not be more than {skew_minutes} minutes in the future")
    return df.filter(~future), df.filter(future).withColumn("violations", reason)


def to_transaction_event(df: DataFrame, received_at: Column | None = None) -> DataFrame:
    """Stamp receipt time, schema version and trace id; anything else passes through.

    Without a ``received_at`` column the given time (default: now) is stamped. A blank trace
    id becomes ``trace-<uuid>``.
    """
    if "received_at" not in df.columns:
        df = df.withColumn("received_at", received_at or F.current_timestamp())
    for name in ("schema_version", "trace_id", "merchant_id", "device_id", "location"):
        if name not in df.columns:
            df = df.withColumn(name, F.lit(None).cast("string"))
    fresh = F.concat(F.lit("trace-"), F.expr("uuid()"))
    return df.withColumns(
        {
            "schema_version": blank_to(F.col("schema_version"), SCHEMA_VERSION),
            "trace_id": blank_to(F.col("trace_id"), fresh),
        }
    )


def wire_to_columns(event: Column) -> list[Column]:
    """Columns of a parsed wire event, times parsed to UTC timestamps."""
    out = []
    for wire, name in TRANSACTION_NAMES:
        value = event[wire]
        if wire in ("eventTime", "receivedAt"):
            value = F.try_to_timestamp(value)
        out.append(value.alias(name))
    return out


def columns_to_wire() -> Column:
    """The wire struct of a transaction row."""
    iso = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"
    return F.struct(
        *[
            (
                F.date_format(F.col(name), iso)
                if wire in ("eventTime", "receivedAt")
                else F.col(name)
            ).alias(wire)
            for wire, name in TRANSACTION_NAMES
        ]
    )


def _exact_amount(payload: Column, amount: Column) -> Column:
    """The parsed amount is the number in the payload, not one rounded to its scale."""
    text = F.regexp_extract(payload, r'"amount"\s*:\s*"?\s*([^",}\s]*)', 1)
    shown = plain_decimal(text)

    def bare(number: Column) -> Column:
        number = F.regexp_replace(number, r"(\.\d*?)0+$", "$1")
        return F.regexp_replace(F.regexp_replace(number, r"\.$", ""), r"^-0$", "0")

    same = bare(shown) == bare(amount.cast("string"))
    return F.coalesce(~is_decimal_text(text) | same, F.lit(True))


def parse_guard(
    df: DataFrame, value: str = "value", supported: tuple[str, ...] = (SCHEMA_VERSION,)
) -> tuple[DataFrame, DataFrame]:
    """Split raw JSON payloads into (transaction rows, dead letters).

    Unparseable payloads, unsupported schema versions and missing required fields are never
    coerced: they keep their payload and get ``error_type`` and ``error_message``.
    """
    schema = StructType(
        [*TRANSACTION_JSON.fields, StructField("_corrupt_record", StringType())]
    )
    parsed = df.withColumn(
        "__event",
        F.from_json(
            F.col(value),
            schema,
            {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"},
        ),
    )
    event = F.col("__event")
    required = ("eventId", "userId", "accountId", "eventType", "currency", "eventTime")
    missing = [(is_blank(event[f]), f) for f in required]
    missing.append((event["amount"].isNull(), "amount"))
    missing_text = joined(",", sorted(missing, key=lambda m: m[1]))
    version = blank_to(event["schemaVersion"], SCHEMA_VERSION)
    error = (
        F.when(
            event.isNull() | event["_corrupt_record"].isNotNull(),
            F.struct(
                F.lit("UNPARSEABLE_PAYLOAD").alias("error_type"),
                F.lit("payload is not a transaction event").alias("error_message"),
            ),
        )
        .when(
            ~version.isin(*supported),
            F.struct(
                F.lit("UNSUPPORTED_SCHEMA_VERSION").alias("error_type"),
                F.concat(F.lit("schemaVersion "), version).alias("error_message"),
            ),
        )
        .when(
            missing_text != "",
            F.struct(
                F.lit("MISSING_FIELD").alias("error_type"), missing_text.alias("error_message")
            ),
        )
        .when(
            ~_exact_amount(F.col(value), event["amount"]),
            F.struct(
                F.lit("UNSUPPORTED_AMOUNT").alias("error_type"),
                F.lit("amount has more digits than an amount can hold").alias("error_message"),
            ),
        )
        .when(
            F.try_to_timestamp(event["eventTime"]).isNull(),
            F.struct(
                F.lit("INVALID_EVENT_TIME").alias("error_type"),
                F.lit("eventTime is not an ISO time").alias("error_message"),
            ),
        )
    )
    tagged = parsed.withColumn("__error", error)
    rest = [c for c in df.columns if c != value]
    ok = tagged.filter(F.col("__error").isNull()).select(*rest, *wire_to_columns(event))
    ok = ok.withColumn("schema_version", blank_to(F.col("schema_version"), SCHEMA_VERSION))
    dlq = tagged.filter(F.col("__error").isNotNull()).select(
        *rest,
        event["eventId"].alias("event_id"),
        event["traceId"].alias("trace_id"),
        event["userId"].alias("user_id"),
        F.col(value).alias("payload_json"),
        "__error.error_type",
        "__error.error_message",
    )
    return ok, dlq
