"""Intake, dead letters, idempotent sinks, streaming."""

import json
from datetime import datetime, timedelta
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from ledgerwatch.operators.deadletter import discard, reprocess, to_dead_letters
from ledgerwatch.operators.intake import parse_guard
from ledgerwatch.operators.operations import alert_windows
from ledgerwatch.operators.results import page
from ledgerwatch.plans.detection import detect_batch, take_in
from ledgerwatch.schemas import DEAD_LETTER, TRANSACTION
from ledgerwatch.sources.idempotent import append_once
from ledgerwatch.sources.transactions import (
    read_row_stream,
    read_transaction_stream,
    to_messages,
    write_transactions,
)
from ledgerwatch.streaming.arrival_state import StateConfig
from ledgerwatch.streaming.detect import Sinks, detect_stream
from ledgerwatch.streaming.windows import alert_stream, dedup_within_watermark

T0 = datetime(2026, 1, 1, 10)
POSITION = "topic string, partition_no int, offset_no long, "
ROW = POSITION + ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in TRANSACTION.fields)


def tx(i, user="u1", seconds=0, amount="10000", event_id=None, location="KR"):
    at = T0 + timedelta(seconds=seconds)
    value = None if amount is None else Decimal(amount)
    return ("t", 0, i, "v1", event_id or f"e{i}", user, f"a-{user}", "PAYMENT", value, "KRW",
            None, None, location, at, at, f"trace-{i}")


def frame(spark, *rows):
    return spark.createDataFrame(rows, ROW)


def test_intake(spark):
    df = frame(spark, tx(1), tx(2, amount="-1"), tx(3, user=" "), tx(4, seconds=0), tx(5))
    late = F.when(F.col("offset_no") == 4, F.col("event_time") + F.expr("INTERVAL 301 SECONDS"))
    edge = F.when(F.col("offset_no") == 5, F.col("event_time") + F.expr("INTERVAL 5 MINUTES"))
    taken = take_in(df.withColumn("event_time", F.coalesce(late, edge, "event_time")))
    assert {r["offset_no"] for r in taken.accepted.collect()} == {1, 5}
    why = {r["offset_no"]: r["violations"] for r in taken.rejected.collect()}
    assert why[2] == "amount must be greater than 0.0" and why[3] == "userId must not be blank"
    assert why[4].startswith("eventTime must not be more than 5 minutes")


def test_parse_guard_never_coerces(spark):
    good = to_messages(frame(spark, tx(1))).first()["value"]
    texts = [good, "{", "[]", good.replace('"v1"', '"v2"'), good.replace('"e1"', '""'),
             good.replace("10000.00", '"many"')]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, value string")
    ok, dead = parse_guard(df)
    assert [r["i"] for r in ok.collect()] == [0]
    kinds = {r["i"]: r["error_type"] for r in dead.collect()}
    assert kinds[1] == kinds[2] == "UNPARSEABLE_PAYLOAD"
    assert kinds[3] == "UNSUPPORTED_SCHEMA_VERSION" and kinds[4] == "MISSING_FIELD"
    assert kinds[5] in ("UNPARSEABLE_PAYLOAD", "MISSING_FIELD")


def letters(spark, *rows):
    """(dlq_id, status, attempts, payload)"""
    now = F.lit(T0)
    failed = frame(spark, *[tx(i) for i, *_ in rows]).withColumns(
        {"error_type": F.lit("Oops"), "error_message": F.lit(" ")}
    )
    base = to_dead_letters(failed, "RULE_ENGINE_ERROR", now)
    state = spark.createDataFrame(rows, "dlq_id long, s string, a int, p string")
    return base.join(state, F.col("source_offset") == F.col("dlq_id")).select(
        "dlq_id",
        *[
            {"status": F.col("s"), "reprocess_attempts": F.col("a"),
             "payload_json": F.coalesce("p", "payload_json")}.get(c, F.col(c)).alias(c)
            for c in DEAD_LETTER.fieldNames()
        ],
    )


def commands(spark, *rows):
    ddl = ("command_id long, dlq_id long, actor string, reason string, trace_id string, "
           "publish_failed boolean")
    return spark.createDataFrame([(i, d, a, r, "t", p) for i, (d, a, r, p) in
                                  enumerate(rows)], ddl)


def test_reprocess_states(spark):
    dlq = letters(spark, (1, "PENDING", 0, None), (2, "PENDING", 3, None),
                  (3, "REPROCESSED", 1, None), (4, "PENDING", 0, "{"),
                  (5, "REPROCESS_FAILED", 1, None), (6, "DISCARDED", 5, None))
    ask = commands(spark, *[(i, " ", "x" * 600, i == 5) for i in range(1, 8)], (1, "b", "r", False))
    done = reprocess(dlq, ask)
    state = {r["dlq_id"]: (r["status"], r["reprocess_attempts"]) for r in done.dlq.collect()}
    assert state == {1: ("REPROCESSED", 1), 2: ("PENDING", 3), 3: ("REPROCESSED", 1),
                     4: ("REPROCESSING", 1), 5: ("REPROCESS_FAILED", 2), 6: ("DISCARDED", 5)}
    assert [r["event_id"] for r in done.republished.collect()] == ["e1"]
    assert [r["dlq_id"] for r in done.not_found.collect()] == [7]
    audit = {r["target_id"]: r for r in done.audit.collect()}
    assert set(audit) == {"1", "2", "3", "4", "5", "6"}
    assert audit["1"]["actor"] == "admin-api" and len(audit["1"]["reason"]) == 500
    why = {k: json.loads(r["metadata_json"])["resultReason"] for k, r in audit.items()}
    assert why == {"1": "reprocessed", "2": "MAX_REPROCESS_ATTEMPTS_EXCEEDED",
                   "3": "DLT_STATE_CONFLICT", "4": "DLT_STATE_CONFLICT", "5": "publish_failed",
                   "6": "MAX_REPROCESS_ATTEMPTS_EXCEEDED"}


def test_discard(spark):
    dlq = letters(spark, (1, "PENDING", 0, None), (2, "DISCARDED", 0, None),
                  (3, "PENDING", 0, None))
    done = discard(dlq, commands(spark, (1, "op", "why", False), (2, "op", "why", False),
                                 (3, "op", " ", False)))
    got = {r["dlq_id"]: (r["status"], r["discard_reason"]) for r in done.dlq.collect()}
    assert got == {1: ("DISCARDED", "why"), 2: ("DISCARDED", None), 3: ("PENDING", None)}
    assert {r["target_id"]: r["result"] for r in done.audit.collect()} == {
        "1": "SUCCESS", "2": "FAILED", "3": "FAILED"}


def test_error_message_is_bounded(spark):
    failed = frame(spark, tx(1)).withColumns(
        {"error_type": F.lit("Oops"), "error_message": F.lit("m" * 900)})
    assert len(to_dead_letters(failed, "S").first()["error_message"]) == 500
    assert letters(spark, (1, "PENDING", 0, None)).first()["error_message"] == "Oops"


def test_append_once_is_idempotent(spark, folder):
    batch = frame(spark, tx(1), tx(2), tx(3, event_id="e1"))
    order = ["partition_no", "offset_no"]
    for _ in range(2):
        append_once(batch, f"{folder}/t", ["event_id"], order)
        stored = spark.read.parquet(f"{folder}/t").collect()
        assert sorted(r["offset_no"] for r in stored) == [1, 2]
    append_once(frame(spark, tx(2), tx(9)), f"{folder}/t", ["event_id"], order)
    assert spark.read.parquet(f"{folder}/t").count() == 3


def test_page(spark):
    df = spark.range(95).select(F.col("id").alias("event_id"), F.lit(T0).alias("created_at"))
    items, total = page(df, 2, 20)
    assert [r["event_id"] for r in items.collect()] == list(range(40, 60))
    assert total.first()["total"] == 95


def test_pages_by_key_walk_the_whole_table(spark):
    from ledgerwatch.operators.results import page_after

    rows = [(f"e{i:03}", T0 + timedelta(seconds=i // 4) if i % 9 else None) for i in range(95)]
    df = spark.createDataFrame(rows, "event_id string, created_at timestamp")
    seen, last = [], None
    while shown := page_after(df, 20, last).collect():
        seen += [r["event_id"] for r in shown]
        last = shown[-1]
    wanted = sorted((r for r in rows if r[1]), key=lambda r: (-r[1].timestamp(), r[0]))
    assert seen == [r[0] for r in wanted]


def run_stream(spark, source, out, **options):
    events = read_row_stream(spark, source, {"maxFilesPerTrigger": "1"})
    query = detect_stream(events, Sinks.under(out), available_now=True, **options)
    query.awaitTermination()
    return Sinks.under(out)


def test_stream_matches_batch_and_repeats_safely(spark, folder):
    rows = [tx(i, f"u{i % 3}", i * 20, "700000") for i in range(40)]
    first = [*rows[:25], tx(100, "u0", 0, None)]
    second = [*rows[20:], tx(101, "u1", 1, event_id="e1")]  # e20..e24 and e1 come again
    for n, part in enumerate((first, second)):
        shifted = [(*r[:2], r[2] + 1000 * n, *r[3:]) for r in part]
        frame(spark, *shifted).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    sinks = run_stream(spark, f"{folder}/in", f"{folder}/out", final_status=True)
    stored = {r["event_id"]: r for r in spark.read.parquet(sinks.results).collect()}
    assert len(stored) == 40
    batch = detect_batch(frame(spark, *rows), order="arrival").collect()
    for r in batch:
        assert stored[r["event_id"]]["matched_rules"] == r["matched_rules"]
        assert stored[r["event_id"]]["risk_score"] == r["risk_score"]
    assert any("WINDOW_AMOUNT_SUM" in r["matched_rules"] for r in batch)
    log = spark.read.parquet(sinks.logs)
    counts = {r["status"]: r["count"] for r in log.groupBy("status").count().collect()}
    assert counts == {"PROCESSED": 40, "DUPLICATE_SKIPPED": 6, "FAILED": 1}
    dead = spark.read.parquet(sinks.dead_letters).collect()
    assert [(r["event_id"], r["failure_stage"]) for r in dead] == [("e100", "RULE_ENGINE_ERROR")]
    # The same input again, with a lost checkpoint: nothing is stored twice.
    again = Sinks(sinks.logs, sinks.results, sinks.dead_letters, f"{folder}/other")
    events = read_row_stream(spark, f"{folder}/in")
    detect_stream(events, again, available_now=True).awaitTermination()
    assert spark.read.parquet(sinks.results).count() == 40
    assert spark.read.parquet(sinks.logs).count() == 47


def test_stateless_stream_is_degraded(spark, folder):
    # First delivery means order of micro-batches, and of offsets within one: here both
    # copies of the event are in one.
    both = frame(spark, tx(2, event_id="e1"), tx(1, amount="1000000"))
    both.coalesce(1).write.parquet(f"{folder}/in")
    sinks = run_stream(spark, f"{folder}/in", f"{folder}/out", stateful=False)
    (only,) = spark.read.parquet(sinks.results).collect()
    assert only["offset_no"] == 1
    assert only["degraded"] and only["risk_score"] == 50
    assert only["skipped_rules"] == ["RAPID_TRANSACTION_COUNT", "WINDOW_AMOUNT_SUM"]
    assert StateConfig().ttl_ms == 600_000 and StateConfig().window_ms == 300_000


def test_topic_files_round_trip(spark, folder):
    rows = frame(spark, *[tx(i, f"u{i % 4}", i) for i in range(20)])
    wire = rows.select("topic", "partition_no", "offset_no", to_value().alias("value"))
    wire.write.json(f"{folder}/topic")
    stream = read_transaction_stream(spark, "json", {}, f"{folder}/topic")
    query = stream.writeStream.format("parquet").option("path", f"{folder}/out")
    query.option("checkpointLocation", f"{folder}/c").trigger(availableNow=True).start(
    ).awaitTermination()
    back = spark.read.parquet(f"{folder}/out")
    assert back.select(*rows.columns).exceptAll(rows).count() == 0 and back.count() == 20
    write_transactions(rows, "parquet", f"{folder}/tx")
    assert spark.read.parquet(f"{folder}/tx").count() == 20


def to_value():
    from ledgerwatch.operators.intake import columns_to_wire

    return F.to_json(columns_to_wire())


def test_stream_windows(spark, folder):
    rows = [(f"e{i % 50}", T0 + timedelta(seconds=i), i % 2 == 0, ["R"] * (i % 2 == 0))
            for i in range(60)]
    ddl = "event_id string, detected_at timestamp, degraded boolean, skipped_rules array<string>"
    table = spark.createDataFrame(rows, ddl)
    table.write.parquet(f"{folder}/in")
    stream = spark.readStream.schema(ddl).parquet(f"{folder}/in")

    def drain(df, name, mode):
        df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(
            availableNow=True).start().awaitTermination()
        return spark.table(name)

    live = drain(alert_stream(stream), "alerts", "update")
    assert sorted(live.collect()) == sorted(alert_windows(table).collect())
    once = drain(dedup_within_watermark(stream, at="detected_at"), "once", "append")
    assert once.count() == 50


@pytest.mark.parametrize("order", ["event_time", "arrival"])
def test_batch_plan(spark, order):
    found = detect_batch(frame(spark, tx(1), tx(2, seconds=1), tx(3, event_id="e1")), order=order)
    got = {r["event_id"]: r["window_count"] for r in found.collect()}
    assert got == {"e1": 1, "e2": 2}


def wire(rows):
    """Payload rows of transaction rows."""
    return rows.select("topic", "partition_no", "offset_no", to_value().alias("value"))


def test_repaired_events_are_scored_and_nothing_stops_the_stream(spark, folder):
    """Raw payloads in three micro-batches: one that cannot be read, one without time, one
    without amount; then the repaired ones, duplicates, and a broken copy of a scored one."""
    from ledgerwatch.streaming.detect import detect_payloads

    good = wire(frame(spark, tx(1), tx(2, amount="2000000"), tx(3)))
    broken = good.withColumn(
        "value",
        F.when(F.col("offset_no") == 2, F.regexp_replace("value", '"amount":[^,]*,', ""))
        .when(F.col("offset_no") == 3, F.regexp_replace("value", '"eventTime":"[^"]*"', '"eventTime":"soon"'))
        .otherwise(F.col("value")),
    )
    junk = spark.createDataFrame([("t", 0, 4, "{")], "topic string, partition_no int, offset_no long, value string")
    huge = wire(frame(spark, tx(5))).withColumn("value", F.regexp_replace("value", '"amount":[^,]*', '"amount":999999.995'))
    tiny = wire(frame(spark, tx(6))).withColumn("value", F.regexp_replace("value", '"amount":[^,]*', '"amount":1e-19'))
    parts = [broken.unionByName(junk), huge.unionByName(tiny)]
    parts.append(good.withColumn("offset_no", F.col("offset_no") + 10))
    # The last part is a broken copy of the scored first event: a duplicate, as its result is there.
    lost = good.where("offset_no = 1").withColumn("value", F.regexp_replace("value", '"amount":[^,]*,', ""))
    parts.append(lost.withColumn("offset_no", F.lit(40).cast("long")))
    schema = good.schema
    sinks = Sinks.under(f"{folder}/out")
    for i, part in enumerate(parts):
        part.coalesce(1).write.mode("append").json(f"{folder}/in")
        raw = spark.readStream.schema(schema).json(f"{folder}/in")
        detect_payloads(raw, sinks, available_now=True, final_status=True).awaitTermination()
    results = {r["event_id"]: r["matched_rules"] for r in spark.read.parquet(sinks.results).collect()}
    assert set(results) == {"e1", "e2", "e3", "e5"}
    assert "AMOUNT_THRESHOLD" in results["e2"] and "AMOUNT_THRESHOLD" not in results["e5"]
    dead = {r["source_offset"]: r["error_type"] for r in spark.read.parquet(sinks.dead_letters).collect()}
    assert dead == {2: "MISSING_FIELD", 3: "INVALID_EVENT_TIME", 4: "UNPARSEABLE_PAYLOAD",
                    6: "UNSUPPORTED_AMOUNT"}
    sent = spark.read.parquet(sinks.envelopes).collect()
    assert {r["source_offset"] for r in sent} == set(dead)
    assert json.loads(next(r["value"] for r in sent if r["source_offset"] == 2))["eventId"] == "e2"
    log = spark.read.parquet(sinks.logs).groupBy("status").count()
    counts = {r["status"]: r["count"] for r in log.collect()}
    assert counts["FAILED"] == 4 and counts["DUPLICATE_SKIPPED"] == 2


def test_rows_without_rule_input_pass_beside_the_state(spark, folder):
    rows = frame(spark, tx(1, amount=None), tx(2)).withColumn(
        "event_time", F.when(F.col("offset_no") == 2, F.lit(None)).otherwise(F.col("event_time")))
    rows.coalesce(1).write.parquet(f"{folder}/in")
    sinks = run_stream(spark, f"{folder}/in", f"{folder}/out")
    assert spark.read.schema("event_id string").parquet(sinks.results).count() == 0
    assert spark.read.parquet(sinks.dead_letters).count() == 2
    frame(spark, tx(21, event_id="e1"), tx(22, event_id="e2")).write.mode("append").parquet(f"{folder}/in")
    run_stream(spark, f"{folder}/in", f"{folder}/out")
    assert {r["event_id"] for r in spark.read.parquet(sinks.results).collect()} == {"e1", "e2"}


def test_append_once_reads_only_the_batch_partitions(spark, folder):
    from ledgerwatch.sources.idempotent import in_partitions

    rows = frame(spark, *[tx(i, seconds=i * 3600) for i in range(96)]).withColumn("day", F.to_date("event_time"))
    order = ["partition_no", "offset_no"]
    for _ in range(2):
        append_once(rows, f"{folder}/t", ["event_id"], order, ["day"])
    target = spark.read.parquet(f"{folder}/t")
    assert target.count() == 96
    pruned = in_partitions(target, rows.where("offset_no < 3"), ["day"])
    plan = pruned._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [day" in plan or "PartitionFilters: [isnotnull(day" in plan
    assert len(pruned.inputFiles()) <= len(target.inputFiles())
    append_once(rows.where("offset_no < 3"), f"{folder}/t", ["event_id"], order, ["day"])
    assert spark.read.parquet(f"{folder}/t").count() == 96
