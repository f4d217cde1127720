"""Detection as a stream: window state, rules, idempotent sinks."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ledgerwatch.operators.deadletter import to_dead_letters, to_envelopes
from ledgerwatch.operators.intake import columns_to_wire, parse_guard
from ledgerwatch.operators.replay import to_replay_request, validate_replay
from ledgerwatch.operators.rules import RuleSet, baseline_rules, score_events
from ledgerwatch.operators.sampling import limit_rows
from ledgerwatch.schemas import FRAUD_RESULT, PROCESSING_LOG, SOURCE_POSITION, WINDOW_SUM
from ledgerwatch.session import keyed_state_settings, ship_package
from ledgerwatch.sources.idempotent import append_counted, append_once, in_partitions, stored
from ledgerwatch.sources.shared import SharedTable
from ledgerwatch.streaming.arrival_state import StateConfig, arrival_window_stream
from ledgerwatch.streaming.event_time import event_time_window_stream

RULE_STAGE = "RULE_ENGINE_ERROR"
PARSE_STAGE = "PAYLOAD_ERROR"
_EMPTY_WINDOW = {"window_count": "long", "window_sum": WINDOW_SUM}
_FAULT = ("failure_stage", "error_type", "error_message", "payload_json")
COUNTERS = "batch_id long, metric string, n long"
# Offsets of one block share a partition of the log and of the dead letters.
OFFSET_BLOCK = 1_000_000


@dataclass(frozen=True)
class Sinks:
    """Parquet folders; the checkpoint must outlive the query and be shared.

    Results are partitioned by event date, the others by blocks of offsets, so that a
    micro-batch reads only the partitions its own rows fall into. An event id belongs to one
    event time: a redelivery under another date would be another event.

    ``counters`` names a table of what each micro-batch added (``stored_counters``).
    ``shared`` makes the sinks tables that several streams may write to (``SharedTable``);
    each still needs a checkpoint of its own."""

    logs: str
    results: str
    dead_letters: str
    checkpoint: str
    envelopes: str | None = None
    shared: bool = False
    counters: str | None = None

    @classmethod
    def under(cls, folder: str, shared: bool = False) -> Sinks:
        base = folder.rstrip("/")
        return cls(
            f"{base}/logs",
            f"{base}/results",
            f"{base}/dead_letters",
            f"{base}/checkpoint",
            f"{base}/envelopes",
            shared,
            f"{base}/counters",
        )

    def stored_results(self, spark: SparkSession) -> DataFrame | None:
        """(event_id, event_date) of all stored results, or None before the first."""
        keys = "event_id string, event_date date"
        if self.shared:
            return SharedTable(spark, self.results, StructType.fromDDL(keys), ["event_id"], "event_date").rows()
        return stored(spark, self.results, keys)

    def append(
        self, rows: DataFrame, target: str, keys: list[str], order: list[str], partition: str
    ) -> None:
        if self.shared:
            table = SharedTable(rows.sparkSession, target, rows.schema, keys, partition)
            table.append(rows, order)
        else:
            append_once(rows, target, keys, order, [partition])

    def append_counted(
        self,
        rows: DataFrame,
        target: str,
        keys: list[str],
        order: list[str],
        partition: str,
        counts: dict[str, Column],
    ) -> dict[str, int]:
        """Counts are taken where one stream writes; a shared table has no batches."""
        if self.shared or not self.counters:
            self.append(rows, target, keys, order, partition)
            return {}
        return append_counted(rows, target, keys, order, counts, [partition])

    def add_counts(self, spark: SparkSession, batch_id: int | None, counts: dict[str, int]) -> None:
        if not counts or batch_id is None:
            return
        rows = spark.createDataFrame([(batch_id, k, n) for k, n in counts.items()], COUNTERS)
        append_once(rows, self.counters, ["batch_id", "metric"], ["metric"])


def stored_counters(spark: SparkSession, path: str) -> DataFrame:
    """(metric, n) over all micro-batches of a stream."""
    rows = stored(spark, path, COUNTERS)
    rows = spark.createDataFrame([], COUNTERS) if rows is None else rows
    return rows.groupBy("metric").agg(F.sum("n").alias("n"))


def rule_failure() -> Column:
    """Rows no rule can be evaluated on."""
    return F.col("amount").isNull() | F.col("event_time").isNull()


def route_failures(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows to score, failed rows with error_type and error_message). Storage failures are
    not routed: they fail the micro-batch, which Spark runs again."""
    bad = rule_failure()
    failed = df.filter(bad).withColumns(
        {
            "error_type": F.lit("MissingRuleInput"),
            "error_message": F.concat_ws(
                ",",
                F.when(F.col("amount").isNull(), F.lit("amount")),
                F.when(F.col("event_time").isNull(), F.lit("event_time")),
            ),
        }
    )
    return df.filter(~bad), failed


def processing_logs(
    batch: DataFrame, group: str, final_status: bool, now: Column
) -> DataFrame:
    """Log rows. By default every consumed row is PROCESSED, before any rule ran;
    ``final_status`` writes what really became of it."""
    status = F.lit("PROCESSED")
    if final_status:
        failed = rule_failure()
        if "error_type" in batch.columns:
            failed = failed | F.col("error_type").isNotNull()
        status = (
            F.when(F.col("duplicate"), F.lit("DUPLICATE_SKIPPED"))
            .when(failed, F.lit("FAILED"))
            .otherwise(status)
        )
    return batch.withColumns(
        {"consumer_group_id": F.lit(group), "status": status, "processed_at": now}
    ).select(*PROCESSING_LOG.fieldNames())


def _already_scored(batch: DataFrame, sinks: Sinks) -> DataFrame:
    """Failed rows become duplicates where their event has a result: stored by an earlier
    batch, or to be stored from an earlier row of this one. Other rows pass unchanged.

    A batch without failed rows, as most are, is handed back after one look. Of the stored
    results only the failed rows' dates are read; a failed row without event time has no
    date, and only then all dates are.
    """
    failed = batch.filter(F.col("error_type").isNotNull())
    if failed.isEmpty():
        return batch
    position = F.struct("partition_no", "offset_no")
    scored = batch.filter(F.col("error_type").isNull() & ~F.col("duplicate"))
    scored = scored.groupBy("event_id").agg(F.min(position).alias("__scored_at"))
    results = sinks.stored_results(batch.sparkSession)
    columns = batch.columns
    dated = failed.withColumn("event_date", F.to_date("event_time"))
    failed = failed.join(scored, "event_id", "left")
    before = F.coalesce(F.col("__scored_at") < position, F.lit(False))
    if results is not None:
        if dated.filter("event_date IS NULL").isEmpty():
            results = in_partitions(results, dated, ["event_date"])
        wanted = dated.select("event_id").distinct()
        old = results.select("event_id").join(wanted, "event_id", "left_semi").distinct()
        old = old.withColumn("__stored", F.lit(True))
        failed = failed.join(old, "event_id", "left")
        before = before | F.col("__stored").isNotNull()
    failed = failed.withColumn("duplicate", before).select(*columns)
    return batch.filter(F.col("error_type").isNull()).unionByName(failed)


def store_batch(
    batch: DataFrame,
    sinks: Sinks,
    rule_set: RuleSet,
    stateful: bool,
    group: str = "fraud-consumer",
    final_status: bool = False,
    batch_id: int | None = None,
) -> None:
    """Write one micro-batch: log, dead letters with their envelopes, results, in that order.

    Every write is idempotent, so a repeated batch converges to the same tables. Results come
    last: what a repeated batch finds stored then decides nothing that was not yet written.
    Times of writing differ between the parts of a repeated batch, as each keeps its own.
    """
    now = F.current_timestamp()
    position = list(SOURCE_POSITION)
    block = F.floor(F.col("offset_no") / OFFSET_BLOCK)
    if "error_type" not in batch.columns:
        batch = _with_faults(batch)
    given = batch.persist()
    try:
        batch = _already_scored(given, sinks)
        logs = processing_logs(batch, group, final_status, now).withColumn("offset_block", block)
        sinks.append(logs, sinks.logs, position, position, "offset_block")
        fresh = batch.filter(~F.col("duplicate"))
        failed = fresh.filter(F.col("error_type").isNotNull())
        dead = to_dead_letters(failed, F.col("failure_stage"), now)
        keys = ["source_topic", "source_partition", "source_offset"]
        dead = dead.withColumn("offset_block", F.floor(F.col("source_offset") / OFFSET_BLOCK))
        counts = sinks.append_counted(
            dead, sinks.dead_letters, keys, keys, "offset_block", {"dlq_published": F.lit(True)}
        )
        if sinks.envelopes:
            sent = to_envelopes(dead, *keys, "offset_block")
            sinks.append(sent, sinks.envelopes, keys, keys, "offset_block")
        good = fresh.filter(F.col("error_type").isNull())
        scored = score_events(good, rule_set, stateful=stateful).withColumn(
            "detected_at", now
        )
        results = scored.select(
            *FRAUD_RESULT.fieldNames(), *position[1:], F.to_date("event_time").alias("event_date")
        )
        tests = {
            "results": F.lit(True),
            "degraded": F.col("degraded"),
            "high_risk": F.col("risk_level") == rule_set.bands[-1][1],
            **{
                f"skipped:{code}": F.array_contains("skipped_rules", code)
                for code in rule_set.skippable()
            },
        }
        counts |= sinks.append_counted(
            results, sinks.results, ["event_id"], position[1:], "event_date", tests
        )
        sinks.add_counts(given.sparkSession, batch_id, counts)
    finally:
        given.unpersist()


def _with_faults(events: DataFrame) -> DataFrame:
    """The fault columns of every row: NULL where it can be scored."""
    good, failed = route_failures(events)
    text = F.lit(None).cast("string")
    payload = F.to_json(columns_to_wire())
    good = good.withColumns(dict.fromkeys(_FAULT, text))
    failed = failed.withColumns({"failure_stage": F.lit(RULE_STAGE), "payload_json": payload})
    return good.unionByName(failed.select(*good.columns))


def detect(
    events: DataFrame,
    stateful: bool = True,
    config: StateConfig | None = None,
    unreadable: DataFrame | None = None,
    watermark: str | None = None,
    late: str = "emit",
) -> DataFrame:
    """Events with window columns, the duplicate flag, and the fault columns.

    Rows that no rule can be evaluated on, and the ``unreadable`` ones of ``parse_guard``,
    pass beside the state: they are in no window and no id is remembered for them, so a
    repaired event that comes again is scored. Without state there is no window and no
    in-stream duplicate check; the idempotent sink still stores each event once.

    Windows are in order of arrival. A ``watermark`` makes them event-time windows: an event
    is answered when the watermark has passed it, and ``late`` ones are answered at once
    (``emit``) or left out (``drop``).
    """
    good, failed = route_failures(events)
    if stateful and watermark:
        answered = event_time_window_stream(good, watermark, late, config)
    elif stateful:
        answered = arrival_window_stream(good, config)
    else:
        answered = good.withColumns(_unanswered())
    text = F.lit(None).cast("string")
    answered = answered.withColumns(dict.fromkeys(_FAULT, text))
    failed = failed.withColumns(
        {
            "failure_stage": F.lit(RULE_STAGE),
            "payload_json": F.to_json(columns_to_wire()),
            **_unanswered(),
        }
    )
    out = answered.unionByName(failed.select(*answered.columns))
    if unreadable is not None:
        rest = unreadable.withColumns({"failure_stage": F.lit(PARSE_STAGE), **_unanswered()})
        missing = {
            f.name: F.lit(None).cast(f.dataType)
            for f in answered.schema.fields
            if f.name not in rest.columns
        }
        out = out.unionByName(rest.withColumns(missing).select(*answered.columns))
    return out


def _unanswered() -> dict[str, Column]:
    columns = {name: F.lit(None).cast(kind) for name, kind in _EMPTY_WINDOW.items()}
    return {**columns, "duplicate": F.lit(False)}


def detect_stream(
    events: DataFrame,
    sinks: Sinks,
    rule_set: RuleSet | None = None,
    stateful: bool = True,
    config: StateConfig | None = None,
    final_status: bool = False,
    available_now: bool = False,
    unreadable: DataFrame | None = None,
    watermark: str | None = None,
    late: str = "emit",
) -> StreamingQuery:
    """Start detection on a stream of transaction rows with source positions.

    Offsets are committed after the batch function returns, that is after all sinks accepted
    the batch: at least once, made effectively once by the sinks.
    """
    rule_set = rule_set or baseline_rules()
    ship_package(events.sparkSession)
    answered = detect(events, stateful, config, unreadable, watermark, late)

    def store(batch: DataFrame, batch_id: int) -> None:
        store_batch(
            batch, sinks, rule_set, stateful, final_status=final_status, batch_id=batch_id
        )

    writer = (
        answered.writeStream.outputMode("append")
        .option("checkpointLocation", sinks.checkpoint)
        .foreachBatch(store)
    )
    if available_now:
        writer = writer.trigger(availableNow=True)
    with keyed_state_settings(events.sparkSession, event_time=watermark is not None):
        return writer.start()


def detect_payloads(raw: DataFrame, sinks: Sinks, **options) -> StreamingQuery:
    """Detection from raw payloads (topic, partition_no, offset_no, value) to results:
    payloads that do not parse become dead letters, all others are events."""
    events, unreadable = parse_guard(raw)
    return detect_stream(events, sinks, unreadable=unreadable, **options)


def replay_stream(
    spark: SparkSession,
    events: DataFrame,
    target: str,
    checkpoint: str,
    max_events: int | None = None,
    prefix: str | None = None,
) -> StreamingQuery:
    """Send prepared events (a stream with ``row_number``) once, in bounded micro-batches:
    check, shape to requests, append as JSON. Pace with the source's per-trigger limit."""
    source = events if max_events is None else limit_rows(events, max_events, at_least=1)
    accepted = validate_replay(source).filter("replay_reason IS NULL")
    return (
        to_replay_request(accepted, prefix)
        .writeStream.format("json")
        .option("path", target)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
