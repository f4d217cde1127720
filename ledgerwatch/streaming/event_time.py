"""Trailing windows of a stream in event time, with a policy for late events.

With a watermark an event waits until nothing earlier is to be expected, and is then answered
like a row of a table: all events of its user in ``[t - window, t]``, whatever their order of
arrival. A timer at the earliest waiting instant wakes the user. An event that comes behind the
watermark is late; it is dropped, or answered at once from what is still held.
"""

from __future__ import annotations

import json
import sys
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from decimal import Decimal, getcontext
from typing import Any

from pyspark import cloudpickle
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.stateful_processor import ListState

from ledgerwatch.functions.times import epoch_ms
from ledgerwatch.schemas import AMOUNT
from ledgerwatch.streaming.arrival_state import (
    OUT_ROW,
    OUT_SCHEMA,
    PAYLOAD_TIMES,
    StateConfig,
    in_order,
)

cloudpickle.register_pickle_by_value(sys.modules[__name__])

LATE = ("emit", "drop")
# Events to a value of the state.
PACK = 512


class EventTimeProcessor(StatefulProcessor):
    """Per user: events that wait, and events already answered that a window may still reach.
    An id is remembered as long as it is in either. ``late`` says what becomes of events behind
    the watermark.

    State is kept in packs of many events, and the user's one timer stands at the earliest
    waiting instant: when it fires, all events that the watermark has passed are answered in
    one pass. So a micro-batch costs a user a few calls to the state, however many events it
    has, and time in proportion to what is held.
    """

    def __init__(self, config: StateConfig, late: str) -> None:
        self.config = config
        self.late = late

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        # Packs of (event_id, ms, amount), and of the payloads in the same order.
        self.waiting = handle.getListState("waiting", "pack string")
        self.payloads = handle.getListState("payloads", "pack string")
        self.answered = handle.getListState("answered", "pack string")

    def handleInputRows(
        self, key: Any, rows: Iterator[Row], timerValues: Any
    ) -> Iterator[Row]:
        watermark = timerValues.getCurrentWatermarkInMs()
        waiting = self._read(self.waiting)
        known = self._read(self.answered)
        seen = {event_id for event_id, _, _ in waiting + known}
        known = sorted((ms, event_id, amount) for event_id, ms, amount in known)
        fresh, late, payloads = [], [], []
        out = []
        for row in in_order(rows):
            event_id, ms, amount, payload = row.event_id, row.ms, row.amount, row.payload
            if event_id in seen:
                out.append(OUT_ROW(key[0], event_id, payload, None, None, True))
                continue
            if ms >= watermark:
                seen.add(event_id)
                fresh.append((event_id, ms, amount))
                payloads.append(payload)
            elif self.late == "emit":
                seen.add(event_id)
                late.append((event_id, ms, amount))
                known.insert(bisect_right(known, ms, key=_at), (ms, event_id, amount))
                out.append(OUT_ROW(key[0], event_id, payload, *self._window(known, ms), False))
        self._append(self.waiting, fresh)
        self._append(self.payloads, payloads)
        self._append(self.answered, late)
        first = min((ms for _, ms, _ in fresh), default=None)
        if first is not None and all(first < ms for _, ms, _ in waiting):
            self.handle.registerTimer(first)
        yield from out

    def handleExpiredTimer(
        self, key: Any, timerValues: Any, expiredTimerInfo: Any
    ) -> Iterator[Row]:
        end = max(timerValues.getCurrentWatermarkInMs() - 1, expiredTimerInfo.getExpiryTimeInMs())
        waiting = self._read(self.waiting)
        if not any(ms <= end for _, ms, _ in waiting):
            return  # an earlier timer of this micro-batch has answered them
        both = list(zip(waiting, self._read(self.payloads), strict=True))
        due = sorted((row for row in both if row[0][1] <= end), key=lambda row: row[0][1])
        rest = [row for row in both if row[0][1] > end]
        held = self._read(self.answered) + [own for own, _ in due]
        out = [
            OUT_ROW(key[0], event_id, payload, *window, False)
            for ((event_id, _, _), payload), window in zip(due, self._windows(held, due), strict=True)
        ]
        # Whoever waits is not earlier than the last instant, and late ones see what is left.
        horizon = due[-1][0][1] - self.config.window_ms
        for state, values in (
            (self.waiting, [own for own, _ in rest]),
            (self.payloads, [payload for _, payload in rest]),
            (self.answered, [own for own in held if own[1] >= horizon]),
        ):
            state.clear()
            self._append(state, values)
        if rest:
            self.handle.registerTimer(min(ms for (_, ms, _), _ in rest))
        yield from out

    def _read(self, state: ListState) -> list:
        values = [value for (pack,) in state.get() for value in json.loads(pack)]
        if values and isinstance(values[0], list):
            return [
                (event_id, ms, None if amount is None else Decimal(amount))
                for event_id, ms, amount in values
            ]
        return values

    def _append(self, state: ListState, values: list) -> None:
        for start in range(0, len(values), PACK):
            state.appendValue((json.dumps(values[start : start + PACK], default=str),))

    def _window(self, known: list[tuple[int, str, Decimal]], at: int) -> tuple[int, Decimal]:
        low = bisect_left(known, at - self.config.window_ms, key=_at)
        high = bisect_right(known, at, key=_at)
        amounts = [amount for _, _, amount in known[low:high] if amount is not None]
        return len(amounts), sum(amounts, Decimal(0))

    def _windows(self, held: list, due: list) -> Iterator[tuple[int, Decimal]]:
        """Count and sum of the held events in the window that ends at each due one."""
        getcontext().prec = 60  # sums of 38-digit amounts stay exact
        held = sorted((ms, amount) for _, ms, amount in held if amount is not None)
        low = high = 0
        total = Decimal(0)
        for (_, at, _), _ in due:
            while high < len(held) and held[high][0] <= at:
                total += held[high][1]
                high += 1
            while low < high and held[low][0] < at - self.config.window_ms:
                total -= held[low][1]
                low += 1
            yield high - low, total

    def close(self) -> None:
        pass


def _at(entry: tuple) -> int:
    return entry[0]


def event_time_window_stream(
    events: DataFrame, watermark: str, late: str = "emit", config: StateConfig | None = None
) -> DataFrame:
    """Window columns and the duplicate flag per event, in event time.

    ``watermark`` is how far behind the latest event time another event may come. Later ones
    are answered at once from what is held (``emit``), or left out (``drop``). Rows of a user
    in an instant are answered together when the watermark passes it.
    """
    if late not in LATE:
        raise ValueError(f"late must be one of {', '.join(LATE)}")
    marked = events.withWatermark("event_time", watermark)
    narrow = marked.select(
        "user_id",
        "event_id",
        F.col("partition_no").cast("long").alias("partition_no"),
        F.col("offset_no").cast("long").alias("offset_no"),
        epoch_ms(F.col("event_time")).alias("ms"),
        F.col("amount").cast(AMOUNT).alias("amount"),
        F.to_json(F.struct(*events.columns), PAYLOAD_TIMES).alias("payload"),
    )
    answered = narrow.groupBy("user_id").transformWithState(
        statefulProcessor=EventTimeProcessor(config or StateConfig(), late),
        outputStructType=OUT_SCHEMA,
        outputMode="Append",
        timeMode="EventTime",
    )
    row = F.from_json("payload", events.schema, PAYLOAD_TIMES)
    return answered.select(
        row.alias("__row"), "window_count", "window_sum", "duplicate"
    ).select("__row.*", "window_count", "window_sum", "duplicate")
