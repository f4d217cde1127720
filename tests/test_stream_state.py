"""The keyed-state processors alone: few calls to the state, right windows."""

import random
from collections import Counter
from decimal import Decimal
from types import SimpleNamespace

from pyspark.sql import Row
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, TimerValues

from ledgerwatch.streaming.arrival_state import MOST_PACK, MOST_PACKS, ArrivalWindowProcessor, StateConfig
from ledgerwatch.streaming.event_time import EventTimeProcessor

WINDOW = 300_000


class Handle:
    """State of one user in lists and dicts; counts the calls."""

    def __init__(self):
        self.calls = Counter()
        self.timers = set()

    def registerTimer(self, at):
        self.calls["timer"] += 1
        self.timers.add(at)

    def getListState(self, name, schema, ttl=None):
        values = []

        def append(value):
            self.calls[name] += 1
            values.append(value)

        def get():
            self.calls[name] += 1
            return iter(list(values))

        return SimpleNamespace(get=get, appendValue=append, clear=values.clear)

    def getMapState(self, name, key, value, ttl=None):
        values = {}

        def counted(call):
            def run(*given):
                self.calls[name] += 1
                return call(*given)

            return run

        return SimpleNamespace(
            iterator=counted(lambda: iter(list(values.items()))),
            exists=counted(lambda: bool(values)),
            containsKey=counted(values.__contains__),
            updateValue=counted(values.__setitem__),
            removeKey=counted(values.pop),
        )


def feed(processor, handle, rows, watermark):
    """One micro-batch of one user: rows, then the timers that the watermark has passed."""
    names = ["partition_no", "offset_no", "event_id", "ms", "amount", "payload"]
    times = TimerValues(-1, watermark)
    if rows:
        given = (Row(**dict(zip(names, row, strict=True))) for row in rows)
        yield from processor.handleInputRows(("u",), given, times)
    for at in sorted(t for t in handle.timers if t < watermark):
        yield from processor.handleExpiredTimer(("u",), times, ExpiredTimerInfo(at))
        handle.timers.remove(at)


def test_an_events_answer_takes_no_call_of_its_own():
    rng = random.Random(4)
    events = [(0, n, f"e{n}", rng.randrange(3_000_000), Decimal(n) + Decimal("0.01"), f"p{n}") for n in range(4000)]
    handle = Handle()
    processor = EventTimeProcessor(StateConfig(window_ms=WINDOW), "emit")
    processor.init(handle)
    found = []
    for part, watermark in ((events[:2500], 0), (events[2500:] + events[:9], 0), ([], 2_000_000), ([], 9_000_000)):
        found += feed(processor, handle, part, watermark)
    assert not handle.timers and sum(handle.calls.values()) < 100
    again = [row for row in found if row[5]]
    assert {row[1] for row in again} == {f"e{n}" for n in range(9)} and len(again) == 9
    got = {row[1]: row[2:5] for row in found if not row[5]}
    assert len(got) == len(found) - 9 == 4000
    for _, _, own, at, _, payload in events[::97]:
        seen = [amount for *_, ms, amount, _ in events if at - WINDOW <= ms <= at]
        assert got[own] == (payload, len(seen), sum(seen, Decimal(0)))


def test_ids_of_a_large_micro_batch_are_remembered_in_packs():
    rows = [(0, n, f"e{n}", 60_000 * n, Decimal(1), f"p{n}") for n in range(MOST_PACK * MOST_PACKS + 700)]
    handle = Handle()
    processor = ArrivalWindowProcessor(StateConfig(window_ms=WINDOW))
    processor.init(handle)
    found = list(feed(processor, handle, rows[:3000], 0))
    assert not any(row[5] for row in found) and sum(handle.calls.values()) < 50
    # Packs are bounded: what no longer fits is looked up singly, and is remembered as well.
    for part in (rows[2990:], rows[:20], rows[-20:], rows[3000:3004]):
        found = list(feed(processor, handle, part, 0))
        again = [row[1] for row in found if row[5]]
        assert again == ([f"e{n}" for n in range(2990, 3000)] if len(part) > 20 else [row[2] for row in part])
    assert 600 < handle.calls["seen"] < 800
