"""Time helpers. Timestamps are UTC; window arithmetic is in whole milliseconds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def epoch_ms(value: Column) -> Column:
    return F.unix_millis(value.cast("timestamp"))


def iso_seconds(value: Column) -> Column:
    return F.date_format(value, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def iso_millis(value: Column) -> Column:
    return F.date_format(value, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def hour_in(value: Column, zone: str) -> Column:
    """Hour of day in a named zone, whatever the session zone is."""
    local = F.convert_timezone(
        F.current_timezone(), F.lit(zone), value.cast("timestamp_ntz")
    )
    return F.hour(local)


def hour_of_iso_text(value: Column) -> Column:
    """Hour as written in an ISO text, that is in the event's own offset."""
    return F.regexp_extract(value, r"T(\d{2})", 1).try_cast("int")


def is_utc_iso(value: Column) -> Column:
    """ISO-8601 text that ends in Z and parses."""
    parsed = F.try_to_timestamp(value)
    return F.coalesce(value.endswith("Z") & parsed.isNotNull(), F.lit(False))
