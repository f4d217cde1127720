"""Event-time windows over streams: alerts, rates, bounded duplicate removal."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ledgerwatch.operators.operations import alert_windows, held_alerts, rates


def alert_stream(results: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Sliding alert windows; a window is final once the watermark passes its end."""
    return alert_windows(results.withWatermark("detected_at", late))


def held_alert_stream(results: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Alerts that hold, each once: in append mode, when the watermark passes their window."""
    return held_alerts(results.withWatermark("detected_at", late))


def rate_stream(
    df: DataFrame, at: str, late: str = "10 minutes", interval: str = "1 minute"
) -> DataFrame:
    return rates(df.withWatermark(at, late), at, interval)


def dedup_within_watermark(
    df: DataFrame, key: str = "event_id", at: str = "event_time", late: str = "10 minutes"
) -> DataFrame:
    """Duplicate removal with bounded state. Unlike the state of the detection stream it also
    drops events later than the watermark; choose it only where that is wanted."""
    return df.withWatermark(at, late).dropDuplicatesWithinWatermark([key])
