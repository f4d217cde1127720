import random
from datetime import datetime, timedelta
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from ledgerwatch.operators.arrival import arrival_window
from ledgerwatch.operators.windows import (
    class_rank,
    failed_then_success,
    first_wins,
    latest_logs,
    location_change,
    new_device,
    trailing_window,
)

T0 = datetime(2026, 1, 1, 10)
SCHEMA = (
    "event_id string, user_id string, event_time timestamp, amount decimal(19,2), "
    "partition_no int, offset_no long"
)


def row(event_id, ms, amount, offset, user="u"):
    value = None if amount is None else Decimal(amount)
    return (event_id, user, T0 + timedelta(milliseconds=ms), value, 0, offset)


def answers(df):
    return {
        r["event_id"]: (r["window_count"], int(r["window_sum"]))
        for r in df.select("event_id", "window_count", "window_sum").collect()
    }


def brute_trailing(rows, w):
    out = {}
    for e, u, t, *_ in rows:
        hit = [
            a
            for _, u2, t2, a, *_ in rows
            if u2 == u and a is not None and t - timedelta(milliseconds=w) <= t2 <= t
        ]
        out[e] = (len(hit), int(sum(hit)))
    return out


def brute_arrival(rows, w):
    out, state = {}, {}
    for e, u, t, a, _, _ in sorted(rows, key=lambda r: r[5]):
        live = state.setdefault(u, {})
        if a is not None:
            live[e] = (t, a)
        for gone in [k for k, (t2, _) in live.items() if t2 < t - timedelta(milliseconds=w)]:
            del live[gone]
        hit = [a2 for t2, a2 in live.values() if t2 <= t]
        out[e] = (len(hit), int(sum(hit)))
    return out


def random_rows(seed, n, disorder, span_ms, users=("u", "v")):
    """Two thirds of the rows belong to one user; ties and missing amounts occur."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        at = rng.randrange(span_ms) // 7 * 7
        amount = None if rng.random() < 0.05 else rng.randrange(1, 1000)
        user = users[0] if rng.random() < 0.66 else rng.choice(users)
        rows.append((at, amount, user))
    rows.sort(key=lambda r: r[0] + rng.randrange(-disorder, disorder + 1))
    return [row(f"e{i}", at, a, i, u) for i, (at, a, u) in enumerate(rows)]


def test_window_bounds(spark):
    rows = [
        row("a", 0, 1, 1),
        row("b", 300_000, 2, 2),  # exactly five minutes after a: a is in
        row("c", 600_001, 4, 3),  # five minutes and a millisecond after b: b is out
        row("tie", 600_001, 8, 4),
        row("none", 600_002, None, 5),
    ]
    got = answers(trailing_window(spark.createDataFrame(rows, SCHEMA)))
    assert got == {"a": (1, 1), "b": (2, 3), "c": (2, 12), "tie": (2, 12), "none": (2, 12)}


@pytest.mark.parametrize("window_ms", [7, 1000, 50_000])
def test_trailing_window_matches_brute_force(spark, window_ms):
    rows = random_rows(1, 400, 0, 60_000)
    got = answers(trailing_window(spark.createDataFrame(rows, SCHEMA), window_ms))
    assert got == brute_trailing(rows, window_ms)


def test_no_window_group_is_a_whole_user(spark):
    df = spark.createDataFrame(random_rows(2, 50, 0, 1000), SCHEMA)
    plan = trailing_window(df)._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.splitlines() if "Window [" in line]
    assert windows and all("__bucket" in line for line in windows)


ARRIVALS = [
    ([("a", 0, 1_200_000)], (1, 1_200_000)),
    ([("old", -301_000, 900_000), ("new", 0, 100_000)], (1, 100_000)),
    ([("future", 600_000, 500_000), ("current", 0, 100_000)], (1, 100_000)),
    # The future event evicts the first one, so the late third one sees only itself.
    ([("first", 0, 1), ("future", 600_000, 2), ("third", 1000, 4)], (1, 4)),
    ([("a", 0, 1), ("b", 300_000, 2)], (2, 3)),
    ([("a", 0, 1), ("b", 300_001, 2)], (1, 2)),
    ([("a", 0, 1), ("b", 0, 2)], (2, 3)),
]


@pytest.mark.parametrize("case", range(len(ARRIVALS)))
def test_arrival_golden(spark, case):
    arrivals, last = ARRIVALS[case]
    rows = [row(e, ms, a, i) for i, (e, ms, a) in enumerate(arrivals)]
    got = answers(arrival_window(spark.createDataFrame(rows, SCHEMA)))
    assert got[arrivals[-1][0]] == last


@pytest.mark.parametrize(
    ("disorder", "buckets"), [(0, 1), (300, 1), (2500, 1), (2500, 4), (60_000, 1)]
)
def test_arrival_window_matches_brute_force(spark, disorder, buckets):
    rows = random_rows(disorder + buckets, 500, disorder, 60_000)
    df = spark.createDataFrame(rows, SCHEMA)
    got = answers(arrival_window(df, 1000, bucket_windows=buckets))
    assert got == brute_arrival(rows, 1000)


def test_arrival_equals_trailing_when_in_order(spark):
    rows = [row(f"e{i}", i * 11, i + 1, i, "u" if i % 3 else "v") for i in range(300)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert answers(arrival_window(df, 500, bucket_windows=1)) == answers(
        trailing_window(df, 500)
    )


def test_first_wins_collapses_copies_before_the_shuffle(spark):
    rows = [row("copy", 0, 1, i) for i in range(50)] + [row("one", 0, 1, 99)]
    kept = first_wins(
        spark.createDataFrame(rows, SCHEMA), ["event_id"], ["partition_no", "offset_no"]
    )
    assert {(r["event_id"], r["offset_no"]) for r in kept.collect()} == {("copy", 0), ("one", 99)}
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_latest_logs(spark):
    rows = [("e", T0, 0, 1), ("e", T0 + timedelta(1), 0, 2), ("f", T0, 0, 3)]
    df = spark.createDataFrame(
        rows, "event_id string, processed_at timestamp, partition_no int, offset_no long"
    )
    newest = latest_logs(df, newest=1).select("event_id", "offset_no").collect()
    assert {tuple(r) for r in newest} == {("e", 2), ("f", 3)}


def test_behaviour_windows(spark):
    hour = 3_600_000
    rows = [
        ("a", 0, "d1", "KR", False),
        ("b", 10_000, "d1", "US", True),
        ("c", 20_000, "d2", "US", True),
        ("d", 30_000, "d1", None, True),
        ("e", 40_000, "d1", "KR", False),
        ("f", 40 * 24 * hour, "d1", "KR", False),
    ]
    df = spark.createDataFrame(
        [("u", e, T0 + timedelta(milliseconds=ms), d, loc, f, i) for i, (e, ms, d, loc, f) in
         enumerate(rows)],
        "user_id string, event_id string, event_time timestamp, device_id string, "
        "location string, failed boolean, offset_no long",
    )
    device = {r["event_id"] for r in new_device(df).filter("new_device").collect()}
    assert device == {"a", "c", "f"}
    moved = {r["event_id"] for r in location_change(df).filter("location_change").collect()}
    assert moved == {"b"}
    found = failed_then_success(df, F.col("failed")).filter("failed_then_success").collect()
    assert {r["event_id"] for r in found} == {"e"}


def test_class_rank_spans_ranges(spark):
    df = spark.range(1, 101).select(
        F.col("id").alias("row_number"), (F.col("id") % 5 == 0).alias("isFraud")
    )
    got = class_rank(df, "isFraud", "row_number", bucket_width=7).collect()
    for r in got:
        before = [n for n in range(1, r["row_number"] + 1) if (n % 5 == 0) == r["isFraud"]]
        assert r["class_rank"] == len(before)
