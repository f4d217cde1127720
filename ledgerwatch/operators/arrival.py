"""Arrival-order window over a table: what the stateful stream operator would have answered.

Events of a user are taken in the order they arrived (partition, offset), not in event time.
Each event is added, everything older than its own window start is dropped for good, and the
entries in ``[t - window, t]`` are counted. A later-timestamped event that is already there is
not counted; a future event evicts entries that an older event after it no longer sees.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from decimal import Decimal, getcontext

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerwatch.config import WINDOW_MS
from ledgerwatch.functions.times import epoch_ms
from ledgerwatch.schemas import AMOUNT


class RecentEntries:
    """Live entries of one user, ordered by time. Appending in time order is O(1)."""

    def __init__(self, window_ms: int) -> None:
        self.window_ms = window_ms
        getcontext().prec = 60  # sums of 38-digit amounts stay exact
        self.times: list[int] = []
        self.items: list[tuple[str, Decimal]] = []
        self.total = Decimal(0)
        self.head = 0

    def add(self, entry_id: str, at: int, amount: Decimal) -> None:
        place = bisect_right(self.times, at, self.head)
        self.times.insert(place, at)
        self.items.insert(place, (entry_id, amount))
        self.total += amount

    def remove(self, entry_id: str, at: int) -> None:
        place = bisect_left(self.times, at, self.head)
        while self.items[place][0] != entry_id:
            place += 1
        self.total -= self.items[place][1]
        del self.times[place], self.items[place]

    def evict_before(self, start: int) -> list[str]:
        cut = bisect_left(self.times, start, self.head)
        gone = [entry_id for entry_id, _ in self.items[self.head : cut]]
        for _, amount in self.items[self.head : cut]:
            self.total -= amount
        self.head = cut
        if self.head > 4096 and self.head * 2 > len(self.times):
            del self.times[: self.head], self.items[: self.head]
            self.head = 0
        return gone

    def up_to(self, at: int) -> tuple[int, Decimal]:
        """Count and sum of live entries not later than ``at``."""
        place = bisect_right(self.times, at, self.head)
        later = sum((amount for _, amount in self.items[place:]), Decimal(0))
        return place - self.head, self.total - later


def _segments(rows: DataFrame, user: str, width: int) -> DataFrame:
    """Per (user, time bucket): which independent segment it belongs to, and which
    neighbouring segments also need some of its rows.

    A cut after bucket b is allowed when every row of the buckets up to b arrived before every
    row two or more buckets ahead. Then the segment up to b is decided by its own rows, the
    last window of rows before it, and those rows of bucket b + 1 that arrived before the
    segment's last row. Where rows are so late that no cut is allowed, buckets stay together,
    so the answer is exact for any disorder.
    """
    summary = rows.groupBy(user, "__bucket").agg(
        F.min("__arrival").alias("__first"), F.max("__arrival").alias("__last")
    )
    forward = Window.partitionBy(user).orderBy("__bucket")
    so_far = forward.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # Descending buckets as ascending negatives: a running frame instead of a growing one.
    ahead = (
        Window.partitionBy(user)
        .orderBy("__negative")
        .rangeBetween(Window.unboundedPreceding, -2 * width)
    )
    bounds = summary.select(
        "*",
        (-F.col("__bucket")).alias("__negative"),
    ).select(
        user,
        "__bucket",
        F.max("__last").over(so_far).alias("__last_so_far"),
        F.min("__first").over(ahead).alias("__first_ahead"),
    )
    cut = F.col("__first_ahead").isNull() | (
        F.col("__last_so_far") < F.col("__first_ahead")
    )
    before = forward.rowsBetween(Window.unboundedPreceding, -1)
    numbered = bounds.withColumn("__cut", cut.cast("int")).withColumn(
        "__segment", F.coalesce(F.sum("__cut").over(before), F.lit(0))
    )
    follows = F.lead("__bucket").over(forward) == F.col("__bucket") + width
    preceded = F.lag("__bucket").over(forward) == F.col("__bucket") - width
    next_segment = F.lead("__segment").over(forward)
    prev_segment = F.lag("__segment").over(forward)
    return numbered.select(
        user,
        "__bucket",
        "__segment",
        F.when(follows & (next_segment != F.col("__segment")), next_segment).alias(
            "__feeds"
        ),
        F.when(preceded & (prev_segment != F.col("__segment")), prev_segment).alias(
            "__evicts"
        ),
        F.lag("__last_so_far").over(forward).alias("__evicts_until"),
    )


def arrival_window(
    df: DataFrame,
    window_ms: int = WINDOW_MS,
    user: str = "user_id",
    event_time: str = "event_time",
    amount: str = "amount",
    position: tuple[str, str] = ("partition_no", "offset_no"),
    bucket_windows: int = 4,
) -> DataFrame:
    """Add ``window_count`` and ``window_sum`` in arrival-order semantics.

    Rows need a unique position and each event id once (``first_wins`` before this, as the
    stream skips already scored ids). A user's rows are split by time into segments that can
    be answered on their own, so a hot user is many tasks; a task walks its rows once, in
    Arrow batches, holding only the live entries of one user.
    """
    width = window_ms * bucket_windows
    part, off = position
    ms = epoch_ms(F.col(event_time))
    rows = df.select(
        F.col(user).alias(user),
        F.col(part).cast("long").alias("__part"),
        F.col(off).cast("long").alias("__off"),
        ms.alias("__ms"),
        F.col(amount).cast(AMOUNT).alias("__amount"),
    ).select(
        "*",
        (F.col("__ms") - F.pmod("__ms", F.lit(width))).alias("__bucket"),
        F.struct("__part", "__off").alias("__arrival"),
    )
    duties = rows.join(_segments(rows, user, width), [user, "__bucket"])
    own = F.struct(F.col("__segment").alias("segment"), F.lit("own").alias("role"))
    feed = F.struct(F.col("__feeds").alias("segment"), F.lit("feed").alias("role"))
    evict = F.struct(F.col("__evicts").alias("segment"), F.lit("evict").alias("role"))
    near_end = F.col("__ms") >= F.col("__bucket") + F.lit(width - window_ms)
    early = F.col("__arrival") < F.col("__evicts_until")
    roles = F.array_compact(
        F.array(
            own,
            F.when(F.col("__feeds").isNotNull() & near_end, feed),
            F.when(F.col("__evicts").isNotNull() & early, evict),
        )
    )
    walked = (
        duties.select(
            user, "__part", "__off", "__ms", "__amount", F.explode(roles).alias("__duty")
        )
        .select(user, "__duty.segment", "__duty.role", "__part", "__off", "__ms", "__amount")
        .repartition(user, "segment")
        .sortWithinPartitions(user, "segment", "__part", "__off")
    )

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        group: tuple | None = None
        entries = RecentEntries(window_ms)
        for batch in batches:
            out = []
            for who, segment, role, p, o, at, value in batch.itertuples(
                index=False, name=None
            ):
                if (who, segment) != group:
                    group = (who, segment)
                    entries = RecentEntries(window_ms)
                if role != "evict" and value is not None:
                    entries.add("", at, value)
                entries.evict_before(at - window_ms)
                if role == "own":
                    out.append((who, p, o, *entries.up_to(at)))
            yield pd.DataFrame(
                out, columns=[user, "__part", "__off", "window_count", "window_sum"]
            )

    user_type = dict(df.dtypes)[user]
    answers = walked.mapInPandas(
        walk,
        f"{user} {user_type}, __part long, __off long, "
        "window_count long, window_sum decimal(38,12)",
    )
    keyed = df.withColumns(
        {"__part": F.col(part).cast("long"), "__off": F.col(off).cast("long")}
    )
    return keyed.join(answers, [user, "__part", "__off"], "left").select(
        *df.columns, "window_count", "window_sum"
    )
