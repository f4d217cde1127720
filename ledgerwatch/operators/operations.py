"""Operational aggregates over receipts, logs, results and dead letters."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerwatch.config import SLO_TARGETS
from ledgerwatch.operators.results import latency_columns
from ledgerwatch.operators.typemap import inline_table


def reconcile(
    receipts: DataFrame, logs: DataFrame, results: DataFrame, dlq: DataFrame
) -> DataFrame:
    """Per event: was it published, consumed, scored exactly once, dead-lettered?

    The four tables are stacked as tagged counts and summed per event in one shuffle with
    map-side combining, instead of a chain of full joins; an event known to only one of them
    still appears, and an event with very many copies is a few partial sums.
    """

    def part(df: DataFrame, **flags: Column | int) -> DataFrame:
        names = ("n_receipts", "n_published", "n_logs", "n_results", "n_dlq")
        return df.select(
            "event_id",
            *[
                (flags[n] if isinstance(flags.get(n), Column) else F.lit(flags.get(n, 0)))
                .cast("int")
                .alias(n)
                for n in names
            ],
        )

    published = (F.col("status") == "PUBLISHED").cast("int")
    parts = [
        part(receipts, n_receipts=1, n_published=published),
        part(logs, n_logs=1),
        part(results, n_results=1),
        part(dlq, n_dlq=1),
    ]
    stacked = reduce(lambda a, b: a.unionByName(b), parts)
    sums = stacked.groupBy("event_id").agg(
        *[
            F.sum(n).alias(n)
            for n in ("n_receipts", "n_published", "n_logs", "n_results", "n_dlq")
        ]
    )
    status = (
        F.when(F.col("n_results") > 1, F.lit("DUPLICATE_RESULT"))
        .when(F.col("n_results") == 1, F.lit("OK"))
        .when(F.col("n_dlq") > 0, F.lit("IN_DLQ"))
        .when((F.col("n_published") == 0) & (F.col("n_logs") == 0), F.lit("NOT_PUBLISHED"))
        .otherwise(F.lit("MISSING_RESULT"))
    )
    return sums.select(
        "event_id",
        (F.col("n_published") > 0).alias("published"),
        (F.col("n_logs") > 0).alias("consumed"),
        "n_results",
        (F.col("n_dlq") > 0).alias("in_dlq"),
        status.alias("status"),
    )


def reconcile_summary(reconciled: DataFrame) -> DataFrame:
    return reconciled.groupBy("status").agg(F.count("*").alias("n"))


def operations_summary(
    receipts: DataFrame,
    logs: DataFrame,
    results: DataFrame,
    dlq: DataFrame,
    time_from: str,
    time_to: str,
) -> DataFrame:
    """One row with six counts for ``[time_from, time_to]``. Each table is filtered and
    counted where it lies; only one-row partial counts are stacked and summed."""
    low, high = F.to_timestamp(F.lit(time_from)), F.to_timestamp(F.lit(time_to))
    names = (
        "acceptedEventCount",
        "fraudResultCount",
        "highRiskCount",
        "dlqPendingCount",
        "degradedResultCount",
        "duplicateSkippedCount",
    )

    def part(df: DataFrame, at: str, **counts: Column) -> DataFrame:
        inside = df.filter(F.col(at).between(low, high))
        return inside.agg(
            *[
                F.count(F.when(counts[n], 1)).alias(n) if n in counts else F.lit(0).alias(n)
                for n in names
            ]
        ).select(*[F.col(n).cast("long").alias(n) for n in names])

    parts = [
        part(receipts, "received_at", acceptedEventCount=F.lit(True)),
        part(
            results,
            "detected_at",
            fraudResultCount=F.lit(True),
            highRiskCount=F.col("risk_level") == "HIGH",
            degradedResultCount=F.col("degraded"),
        ),
        part(dlq, "created_at", dlqPendingCount=F.col("status") == "PENDING"),
        part(
            logs, "processed_at", duplicateSkippedCount=F.col("status") == "DUPLICATE_SKIPPED"
        ),
    ]
    stacked = reduce(lambda a, b: a.unionByName(b), parts)
    return stacked.agg(*[F.sum(n).alias(n) for n in names]).select(
        F.lit(time_from).alias("from"), F.lit(time_to).alias("to"), *names
    )


def operation_counters(results: DataFrame, dlq: DataFrame, audit: DataFrame) -> DataFrame:
    """(counter, tag, n). ``results`` must be the newly stored ones: duplicates are not
    counted again."""
    none = F.lit("")
    degraded = results.filter("degraded").select(
        F.lit("detection_degraded").alias("counter"), none.alias("tag")
    )
    skipped = results.select(
        F.lit("rule_skipped").alias("counter"), F.explode("skipped_rules").alias("tag")
    )
    published = dlq.select(F.lit("dlt_published").alias("counter"), none.alias("tag"))
    commands = audit.select(
        F.when(F.col("action") == "DLT_REPROCESS", F.lit("dlt_reprocess_requested"))
        .otherwise(F.lit("dlt_discarded"))
        .alias("counter"),
        F.lower("result").alias("tag"),
    )
    parts = (degraded, skipped, published, commands)
    stacked = reduce(lambda a, b: a.unionByName(b), parts)
    return stacked.groupBy("counter", "tag").agg(F.count("*").alias("n"))


def latency_percentiles(
    results: DataFrame, by: list[str] | None = None, approximate: bool = False
) -> DataFrame:
    """(latency, by..., n, p50, p95, p99, max) of ingest, detection and end-to-end latency.

    Exact by default: values are whole milliseconds, so they are first reduced to a histogram
    (value, frequency), and the percentile runs over distinct values with frequencies.
    """
    by = by or []
    timed = latency_columns(results)
    long = timed.select(
        *by,
        F.expr(
            "stack(3, 'ingest', ingest_ms, 'detection', detection_ms, "
            "'end_to_end', end_to_end_ms) AS (latency, ms)"
        ),
    ).filter("ms IS NOT NULL")
    points = (0.5, 0.95, 0.99)
    if approximate:
        wanted = F.percentile_approx("ms", list(points), 10_000)
        out = long.groupBy("latency", *by).agg(
            F.count("*").alias("n"), wanted.alias("p"), F.max("ms").alias("max_ms")
        )
    else:
        histogram = long.groupBy("latency", *by, "ms").agg(F.count("*").alias("freq"))
        wanted = F.percentile("ms", list(points), F.col("freq"))
        out = histogram.groupBy("latency", *by).agg(
            F.sum("freq").alias("n"), wanted.alias("p"), F.max("ms").alias("max_ms")
        )
    return out.select(
        "latency",
        *by,
        "n",
        *[F.col("p")[i].cast("double").alias(f"p{int(q * 100)}") for i, q in enumerate(points)],
        "max_ms",
    )


def slo_check(measured: DataFrame) -> DataFrame:
    """``measured`` has (metric, value). Compared with the target table: (metric, value,
    target, ok); a metric that was not measured has a NULL value and NULL ok."""
    targets = inline_table(
        measured.sparkSession, SLO_TARGETS, "metric string, op string, target double"
    )
    value = F.col("value")
    ok = F.when(F.col("op") == "<=", value <= F.col("target")).otherwise(
        value >= F.col("target")
    )
    return targets.join(measured, "metric", "left").select(
        "metric", "value", "target", ok.alias("ok")
    )


def consumer_lag(end_offsets: DataFrame, logs: DataFrame) -> DataFrame:
    """Per topic and partition: last offset, last processed offset, lag, rows processed.
    ``end_offsets`` has (topic, partition_no, end_offset), the last offset that exists."""
    keys = ["topic", "partition_no"]
    done = logs.groupBy(*keys).agg(
        F.max("offset_no").alias("processed_offset"), F.count("*").alias("processed_rows")
    )
    ends = end_offsets.groupBy(*keys).agg(F.max("end_offset").alias("end_offset"))
    lag = F.col("end_offset") - F.coalesce("processed_offset", F.lit(-1))
    return ends.join(done, keys, "left").select(
        *keys,
        "end_offset",
        "processed_offset",
        F.greatest(lag, F.lit(0)).cast("long").alias("lag"),
        F.coalesce("processed_rows", F.lit(0)).cast("long").alias("processed_rows"),
    )


def lag_by_topic(lags: DataFrame) -> DataFrame:
    """Total lag per topic and how much the busiest partition exceeds the average."""
    rows = F.col("processed_rows")
    return lags.groupBy("topic").agg(
        F.sum("lag").alias("lag"),
        F.max("lag").alias("max_partition_lag"),
        F.try_divide(F.max(rows).cast("double"), F.avg(rows)).alias("hot_partition_ratio"),
    )


def dlq_backlog(dlq: DataFrame) -> DataFrame:
    return dlq.groupBy("status", "failure_stage").agg(F.count("*").alias("n"))


def _alert_marks() -> Column:
    """Names of the alerts a result counts for, once for each skipped rule."""
    return F.concat(
        F.when(F.col("degraded"), F.array(F.lit("FraudRedisDegradedIncreased"))).otherwise(
            F.array().cast("array<string>")
        ),
        F.transform("skipped_rules", lambda _: F.lit("FraudRuleSkippedIncreased")),
    )


def alert_windows(
    results: DataFrame, length: str = "5 minutes", slide: str = "1 minute"
) -> DataFrame:
    """(alert, window_start, window_end, n): sliding windows in which degraded results, or
    skipped rules, increased. Works on a table and on a stream (give the stream a watermark
    on ``detected_at`` first)."""
    return (
        results.select("detected_at", F.explode(_alert_marks()).alias("alert"))
        .groupBy(F.window("detected_at", length, slide).alias("w"), "alert")
        .agg(F.count("*").alias("n"))
        .select(
            "alert",
            F.col("w.start").alias("window_start"),
            F.col("w.end").alias("window_end"),
            "n",
        )
    )


def held_alerts(
    results: DataFrame, length_s: int = 300, slide_s: int = 60, hold_s: int = 60
) -> DataFrame:
    """What ``firing_alerts`` finds in ``alert_windows``, straight from the results, on a table
    or a stream with a watermark.

    A window longer by the hold covers both the alert's window and the one that ended a hold
    before it, so one windowed count answers for both and a stream needs no second state: the
    alert fires if either part holds a mark. The hold is a multiple of the slide.
    """
    if hold_s % slide_s:
        raise ValueError("the hold must be a multiple of the slide")
    both = F.window("detected_at", f"{length_s + hold_s} seconds", f"{slide_s} seconds")
    marks = results.select("detected_at", F.explode(_alert_marks()).alias("alert"))
    # Marks may lie in both parts; a window function gives every mark its windows.
    own = marks.withColumn("w", both)
    start = F.timestamp_micros(F.unix_micros("w.start") + F.lit(hold_s * 1_000_000))
    held = F.timestamp_micros(F.unix_micros("w.end") - F.lit(hold_s * 1_000_000))
    return (
        own.groupBy("w", "alert")
        .agg(
            F.count(F.when(F.col("detected_at") >= start, 1)).alias("n"),
            F.count(F.when(F.col("detected_at") < held, 1)).alias("earlier"),
        )
        .filter("n > 0 AND earlier > 0")
        .select("alert", start.alias("window_start"), F.col("w.end").alias("window_end"), "n")
    )


def firing_alerts(windows: DataFrame, hold_ms: int = 60_000) -> DataFrame:
    """Alert windows whose condition already held ``hold_ms`` before: the window that ended
    then was active too. An equality on shifted end times, so a plain hash join."""
    earlier = windows.select(
        "alert",
        F.timestamp_millis(F.unix_millis("window_end") + F.lit(hold_ms)).alias("window_end"),
    )
    return windows.join(earlier, ["alert", "window_end"], "left_semi").select(
        *windows.columns
    )


def rates(
    df: DataFrame, at: str, interval: str = "1 minute", by: list[str] | None = None
) -> DataFrame:
    """(window_start, by..., n, per_second) in tumbling windows."""
    by = by or []
    out = df.groupBy(F.window(at, interval).alias("w"), *by).agg(F.count("*").alias("n"))
    seconds = (F.unix_millis("w.end") - F.unix_millis("w.start")) / F.lit(1000.0)
    return out.select(
        F.col("w.start").alias("window_start"),
        *by,
        "n",
        (F.col("n") / seconds).alias("per_second"),
    )


def totals(df: DataFrame, by: list[str]) -> DataFrame:
    """Total and share per group. Shares come from group counts, not from the rows."""
    counts = df.groupBy(*by).agg(F.count("*").alias("n"))
    everything = Window.partitionBy(F.lit(1))
    return counts.withColumn(
        "share", F.col("n").cast("double") / F.sum("n").over(everything)
    )
