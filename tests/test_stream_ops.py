"""Counters without a second read, paced replay, alerts that hold, rates."""

import random
import time
from collections import Counter
from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from checks import tables
from ledgerwatch.operators.operations import alert_windows, firing_alerts, held_alerts, rates
from ledgerwatch.operators.replay import validate_replay
from ledgerwatch.sources.idempotent import append_counted
from ledgerwatch.streaming import detect
from ledgerwatch.streaming.detect import Sinks, detect_stream, stored_counters
from ledgerwatch.streaming.replay import ReplayProgress, replay_paced, stage_replay
from ledgerwatch.streaming.windows import held_alert_stream, rate_stream
from tests.test_pipeline import T0, frame, read_row_stream, tx

SF = "/root/testdata/sf0.001"


def counts_of(batch, target):
    counts = {"rows": F.lit(True), "large": F.col("amount") >= 1_000_000}
    return append_counted(batch, target, ["event_id"], ["partition_no", "offset_no"], counts)


def test_counts_of_a_batch_stay_what_they_are(spark, folder):
    first = frame(spark, tx(1), tx(2, amount="2000000"), tx(3, event_id="e1", amount="2000000"))
    second = frame(spark, tx(11, event_id="e2", amount="2000000"), tx(12), tx(13, amount="1000000"))
    for _ in range(2):
        assert counts_of(first, f"{folder}/t") == {"rows": 2, "large": 1}
    for _ in range(2):
        assert counts_of(second, f"{folder}/t") == {"rows": 2, "large": 1}
    assert counts_of(first.where("false"), f"{folder}/t") == {"rows": 0, "large": 0}
    assert spark.read.parquet(f"{folder}/t").count() == 4


def test_stream_counters_after_a_micro_batch_that_failed_late(spark, folder, monkeypatch):
    """The first attempt stores its results and dies before its counters; the repeated one
    stores nothing new and counts the same."""
    rows = [tx(i, f"u{i % 3}", i, "2000000") for i in range(12)] + [tx(50, "u1", 1, None)]
    frame(spark, *rows).coalesce(1).write.parquet(f"{folder}/in")
    sinks = Sinks.under(f"{folder}/out")
    start = lambda: detect_stream(read_row_stream(spark, f"{folder}/in"), sinks, available_now=True)
    with monkeypatch.context() as broken:
        broken.setattr(detect.Sinks, "add_counts", lambda *_: (_ for _ in ()).throw(OSError("full")))
        with pytest.raises(Exception, match="full"):
            start().awaitTermination()
    assert spark.read.parquet(sinks.results).count() == 12
    assert stored_counters(spark, sinks.counters).count() == 0
    start().awaitTermination()
    frame(spark, tx(60, "u1", 5, "10"), tx(61, "u1", 1, event_id="e1")).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    start().awaitTermination()
    found = {r.metric: r.n for r in stored_counters(spark, sinks.counters).collect()}
    results = spark.read.parquet(sinks.results)
    assert found["results"] == results.count() == 13 and found["dlq_published"] == 1
    assert found["high_risk"] == results.where("risk_level = 'HIGH'").count() > 0
    assert found["degraded"] == found["skipped:WINDOW_AMOUNT_SUM"] == 0


def test_replay_in_order_bounded_and_paced(spark, folder):
    events = tables.replay_input(spark, SF)
    total = events.count()
    assert total > 700
    staged = stage_replay(events, f"{folder}/staged", 250, max_events=700)
    assert staged.batches == 3
    watch = ReplayProgress("replayed")
    spark.streams.addListener(watch)
    began = time.time()
    try:
        query = replay_paced(spark, staged, f"{folder}/sent", f"{folder}/c", "rp", every="2 seconds", name="replayed")
        # A paced query runs until it is stopped; it is idle after the last staged event.
        query.processAllAvailable()
        took = time.time() - began
        query.stop()
        deadline = time.time() + 20
        while not watch.ended and time.time() < deadline:
            time.sleep(0.1)
    finally:
        spark.streams.removeListener(watch)
    assert list(watch.rows.values()) == [250, 250, 200] and list(watch.rows) == [0, 1, 2]
    assert took >= 4  # three micro-batches start two seconds apart
    sent = spark.read.schema("eventId string, batch long").json(f"{folder}/sent").collect()
    checked = validate_replay(events).select("eventId", "row_number", "replay_reason").orderBy("row_number")
    first = enumerate(checked.limit(700).collect())
    wanted = {("rp-" + r.eventId, k // 250) for k, r in first if r.replay_reason is None}
    assert {(r.eventId, r.batch) for r in sent} == wanted and len(sent) == len(wanted)
    # A restart has nothing left to send.
    again = replay_paced(spark, staged, f"{folder}/sent", f"{folder}/c", "rp")
    again.awaitTermination()
    assert spark.read.json(f"{folder}/sent").count() == len(wanted)
    with pytest.raises(ValueError, match="row"):
        stage_replay(events, f"{folder}/none", 0)


RESULT = "event_id string, detected_at timestamp, degraded boolean, skipped_rules array<string>"


def result_rows(seed, n=120):
    rng = random.Random(seed)
    at = [T0 + timedelta(seconds=rng.choice([60, 90, 1000]) * k + rng.random()) for k in range(n)]
    return [(f"e{k}", t, rng.random() < 0.2, ["R"] * rng.choice([0, 0, 0, 1, 2])) for k, t in enumerate(at)]


@pytest.mark.parametrize("seed", [1, 2])
def test_held_alerts_are_firing_alerts(spark, seed):
    table = spark.createDataFrame(result_rows(seed), RESULT)
    wanted = firing_alerts(alert_windows(table)).collect()
    assert sorted(held_alerts(table).collect()) == sorted(wanted) and wanted
    slow = firing_alerts(alert_windows(table), 180_000).collect()
    assert sorted(held_alerts(table, hold_s=180).collect()) == sorted(slow)
    with pytest.raises(ValueError, match="multiple"):
        held_alerts(table, hold_s=90)


def test_held_alerts_and_rates_of_a_stream(spark, folder):
    rows = sorted(result_rows(3), key=lambda r: r[1])
    end = ("end", rows[-1][1] + timedelta(days=1), False, [])
    for n, part in enumerate((rows[:50], rows[50:], [end])):
        spark.createDataFrame(part, RESULT).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        stream = spark.readStream.schema(RESULT).parquet(f"{folder}/in")
        for name, df in (("held", held_alert_stream(stream)), ("rates", rate_stream(stream, "detected_at"))):
            writer = df.writeStream.format("parquet").option("path", f"{folder}/{name}")
            writer = writer.option("checkpointLocation", f"{folder}/c_{name}").outputMode("append")
            writer.trigger(availableNow=True).start().awaitTermination()
    table = spark.createDataFrame(rows, RESULT)
    held = spark.read.parquet(f"{folder}/held")
    assert sorted(held.collect()) == sorted(firing_alerts(alert_windows(table)).select(held.columns).collect())
    live = spark.read.parquet(f"{folder}/rates")
    wanted = rates(table, "detected_at").select(live.columns).collect()
    assert Counter(live.collect()) == Counter(wanted) and len(wanted) > 20
