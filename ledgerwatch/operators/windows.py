"""Event-time windows per key that stay bounded when one key is hot.

A plain ``Window.partitionBy(user)`` puts all rows of a user in one task. The helpers here cut
time into buckets, aggregate to distinct instants before any window runs, and use only running
(linear) frames, so the largest window group is the number of distinct milliseconds in a
bucket, whatever the number of rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerwatch.config import WINDOW_MS
from ledgerwatch.functions.times import epoch_ms
from ledgerwatch.schemas import AMOUNT, WINDOW_SUM


def _bucket_start(instant: Column, width: int) -> Column:
    return instant - F.pmod(instant, F.lit(width))


def trailing_totals(
    df: DataFrame,
    keys: list[str],
    at: str,
    window_ms: int,
    measures: dict[str, Column],
    before_only: bool = False,
) -> DataFrame:
    """Sum of each measure over the rows of the same keys in ``[at - window_ms, at]``.

    Both ends are inclusive, at millisecond precision; rows at the same instant see each
    other. ``before_only`` counts strictly earlier instants instead.

    How: (1) rows are pre-aggregated to one row per (keys, instant), with map-side partial
    sums. (2) Each instant becomes an *enter* at ``t`` and an *exit* at ``t + window_ms + 1``;
    a running sum of signed values over (keys, time bucket) is the window total, so the cost
    is linear however dense the window is. Instants that still count in the next bucket are
    repeated there. (3) Totals are joined back by (keys, instant); only totals, never rows,
    pass through a window.
    """
    width = window_ms + 1
    names = list(measures)
    instants = df.groupBy(*keys, at).agg(
        *[F.sum(measures[n]).alias(n) for n in names]
    )
    t = F.col(at)
    leave = t + F.lit(window_ms + 1)
    here = _bucket_start(t, width)
    there = _bucket_start(t + F.lit(window_ms), width)

    def mark(bucket: Column, moment: Column, sign: int, asks: bool) -> Column:
        return F.struct(
            bucket.alias("__bucket"),
            moment.alias("__moment"),
            F.lit(sign).alias("__sign"),
            F.lit(asks).alias("__asks"),
        )

    # With the bucket one millisecond wider than the window, an exit falls into the next
    # bucket, or at its first instant; it never stays in its own.
    own = F.array(mark(here, t, 1, True))
    carried = F.array(mark(there, t, 1, False), mark(there, leave, -1, False))
    marks = F.when(there > here, F.concat(own, carried)).otherwise(own)
    stream = instants.select(
        *keys, F.explode(marks).alias("__mark"), *names
    ).select(
        *keys,
        "__mark.*",
        *[
            F.when(F.col("__mark.__sign") < 0, -F.col(n)).otherwise(F.col(n)).alias(n)
            for n in names
        ],
    )
    upper = -1 if before_only else Window.currentRow
    frame = (
        Window.partitionBy(*keys, "__bucket")
        .orderBy("__moment")
        .rangeBetween(Window.unboundedPreceding, upper)
    )
    if before_only:
        # An exit at this very instant concerns rows older than the window: it must count.
        stream = stream.withColumn(
            "__moment",
            F.when(F.col("__sign") < 0, F.col("__moment") - 1).otherwise(
                F.col("__moment")
            ),
        )
    totals = (
        stream.select(
            *keys,
            "__moment",
            "__asks",
            *[F.coalesce(F.sum(n).over(frame), F.lit(0)).alias(n) for n in names],
        )
        .filter("__asks")
        .select(*keys, F.col("__moment").alias(at), *names)
    )
    return df.join(totals, [*keys, at], "left")


def trailing_window(
    df: DataFrame,
    window_ms: int = WINDOW_MS,
    user: str = "user_id",
    event_time: str = "event_time",
    amount: str = "amount",
) -> DataFrame:
    """Per user: ``window_count`` and ``window_sum`` over the last ``window_ms`` of event
    time, the current event included. Rows without an amount count for nothing."""
    timed = df.withColumn("__ms", epoch_ms(F.col(event_time)))
    out = trailing_totals(
        timed,
        [user],
        "__ms",
        window_ms,
        {
            "window_count": F.when(F.col(amount).isNotNull(), 1).otherwise(0),
            "window_sum": F.coalesce(F.col(amount), F.lit(0)).cast(AMOUNT),
        },
    )
    return out.withColumn(
        "window_sum", F.col("window_sum").cast(WINDOW_SUM)
    ).select(*df.columns, "window_count", "window_sum")


def previous_in_time(
    df: DataFrame,
    keys: list[str],
    at: str,
    tie: str,
    payload: list[str],
    bucket_ms: int = 60_000,
) -> DataFrame:
    """``prev_<name>`` of the row just before each row, in (``at``, ``tie``) order per keys.

    The lag runs inside (keys, time bucket). The first row of a bucket takes the last row of
    the previous non-empty bucket, from a summary with one row per bucket, so its size grows
    with the time span and not with the rows.
    """
    names = [at, *[c for c in payload if c != at]]
    bucketed = df.withColumn("__bucket", _bucket_start(F.col(at), bucket_ms))
    order = F.struct(at, tie)
    last = bucketed.groupBy(*keys, "__bucket").agg(
        F.max_by(F.struct(*names), order).alias("__last")
    )
    by_bucket = Window.partitionBy(*keys).orderBy("__bucket")
    before = last.select(
        *keys, "__bucket", F.lag("__last").over(by_bucket).alias("__before")
    )
    inside = Window.partitionBy(*keys, "__bucket").orderBy(at, tie)
    lagged = bucketed.withColumn("__prev", F.lag(F.struct(*names)).over(inside))
    prev = F.coalesce(F.col("__prev"), F.col("__before"))
    return lagged.join(before, [*keys, "__bucket"], "left").select(
        *df.columns, *[prev[n].alias(f"prev_{n}") for n in names]
    )


def first_wins(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """First row per key in ``order``. Spark turns ``row_number() = 1`` into a group limit
    that runs before the shuffle too, so copies of one key collapse on the map side."""
    ranked = Window.partitionBy(*keys).orderBy(*order)
    return (
        df.withColumn("__rn", F.row_number().over(ranked))
        .filter("__rn = 1")
        .drop("__rn")
    )


def latest_logs(logs: DataFrame, newest: int | None = None) -> DataFrame:
    """Logs with ``recency`` 1 for the newest per event (``processed_at`` descending).
    ``newest`` keeps that many per event."""
    ranked = Window.partitionBy("event_id").orderBy(
        F.desc("processed_at"), F.desc("partition_no"), F.desc("offset_no")
    )
    out = logs.withColumn("recency", F.row_number().over(ranked))
    return out if newest is None else out.filter(F.col("recency") <= newest)


def new_device(
    df: DataFrame,
    days: int = 30,
    user: str = "user_id",
    device: str = "device_id",
    event_time: str = "event_time",
) -> DataFrame:
    """``new_device``: the device was not used by the user in the ``days`` before. Only
    strictly earlier instants are history; rows without a device are not new."""
    timed = df.withColumn("__ms", epoch_ms(F.col(event_time)))
    uses = timed.filter(F.col(device).isNotNull()).select(user, device, "__ms").distinct()
    seen = previous_in_time(
        uses, [user, device], "__ms", "__ms", [], bucket_ms=3_600_000
    ).select(user, device, "__ms", "prev___ms")
    age = F.col("__ms") - F.col("prev___ms")
    fresh = F.col(device).isNotNull() & F.coalesce(
        age > F.lit(days * 86_400_000), F.lit(True)
    )
    return timed.join(seen, [user, device, "__ms"], "left").select(
        *df.columns, fresh.alias("new_device")
    )


def location_change(
    df: DataFrame,
    within_ms: int = 30 * 60 * 1000,
    user: str = "user_id",
    event_time: str = "event_time",
    location: str = "location",
    tie: str = "offset_no",
) -> DataFrame:
    """``location_change``: the previous transaction of the user was in another place at most
    ``within_ms`` ago. A missing location on either side is no change."""
    timed = df.withColumn("__ms", epoch_ms(F.col(event_time)))
    lagged = previous_in_time(timed, [user], "__ms", tie, [location])
    moved = (
        (F.upper(F.trim(location)) != F.upper(F.trim(F.col(f"prev_{location}"))))
        & (F.col("__ms") - F.col("prev___ms") <= within_ms)
    )
    return lagged.select(
        *df.columns, F.coalesce(moved, F.lit(False)).alias("location_change")
    )


def failed_then_success(
    df: DataFrame,
    failed: Column,
    window_ms: int = WINDOW_MS,
    min_failures: int = 3,
    user: str = "user_id",
    event_time: str = "event_time",
) -> DataFrame:
    """``failed_then_success``: a success after at least ``min_failures`` failures of the user
    in the window before it."""
    timed = df.select(
        "*",
        epoch_ms(F.col(event_time)).alias("__ms"),
        F.coalesce(failed, F.lit(False)).alias("__failed"),
    )
    counted = trailing_totals(
        timed,
        [user],
        "__ms",
        window_ms,
        {"recent_failures": F.col("__failed").cast("int")},
        before_only=True,
    )
    return counted.select(
        *df.columns,
        "recent_failures",
        (~F.col("__failed") & (F.col("recent_failures") >= min_failures)).alias(
            "failed_then_success"
        ),
    )


def class_rank(
    df: DataFrame, label: str, order: str, bucket_width: int = 1 << 20
) -> DataFrame:
    """``class_rank``: 1-based position inside each class of ``label``, in ``order``.

    A class can hold nearly all rows, so positions are counted inside fixed ranges of the
    (unique, whole-number) order key and shifted by the sizes of the earlier ranges.
    """
    ranged = df.withColumn(
        "__range", F.floor(F.col(order) / F.lit(bucket_width)).cast("long")
    )
    sizes = ranged.groupBy(label, "__range").agg(F.count("*").alias("__n"))
    earlier = Window.partitionBy(label).orderBy("__range").rowsBetween(
        Window.unboundedPreceding, -1
    )
    shift = sizes.select(
        label, "__range", F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__shift")
    )
    inside = Window.partitionBy(label, "__range").orderBy(order)
    return (
        ranged.withColumn("__pos", F.row_number().over(inside))
        .join(shift, [label, "__range"])
        .select(*df.columns, (F.col("__pos") + F.col("__shift")).alias("class_rank"))
    )
