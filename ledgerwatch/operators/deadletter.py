"""Dead letters: recording, operator commands, audit."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerwatch.config import (
    AUDIT_TARGET_TYPE,
    DEAD_LETTER_TOPIC,
    DEFAULT_ACTOR,
    MAX_ACTOR_CHARS,
    MAX_MESSAGE_CHARS,
    MAX_REPROCESS_ATTEMPTS,
    RETRYABLE_STATUSES,
)
from ledgerwatch.functions.text import blank_to, is_blank
from ledgerwatch.operators.intake import columns_to_wire
from ledgerwatch.schemas import DEAD_LETTER, TRANSACTION_JSON


@dataclass(frozen=True)
class CommandOutcome:
    """``dlq`` after the commands, payloads to send again (empty for discard), audit rows,
    and commands whose id does not exist."""

    dlq: DataFrame
    republished: DataFrame
    audit: DataFrame
    not_found: DataFrame


def sanitized_message(message: Column, error_type: Column) -> Column:
    return F.substring(blank_to(message, error_type), 1, MAX_MESSAGE_CHARS)


def to_dead_letters(
    failed: DataFrame, stage: str | Column, now: Column | None = None
) -> DataFrame:
    """PENDING rows from failed events.

    ``failed`` carries the source position (topic, partition_no, offset_no), error_type,
    error_message, and either ``payload_json`` or the transaction columns.
    """
    now = F.current_timestamp() if now is None else now
    columns = failed.columns
    if "payload_json" not in columns:
        failed = failed.withColumn("payload_json", F.to_json(columns_to_wire()))
    rows = failed.select(
        "event_id",
        "trace_id",
        "user_id",
        F.col("topic").alias("source_topic"),
        F.col("partition_no").cast("int").alias("source_partition"),
        F.col("offset_no").cast("long").alias("source_offset"),
        F.lit(DEAD_LETTER_TOPIC).alias("dlt_topic"),
        (F.lit(stage) if isinstance(stage, str) else stage).alias("failure_stage"),
        F.col("error_type"),
        sanitized_message(F.col("error_message"), F.col("error_type")).alias("error_message"),
        "payload_json",
        F.lit("PENDING").alias("status"),
        F.lit(0).alias("reprocess_attempts"),
        F.lit(None).cast("timestamp").alias("last_reprocessed_at"),
        F.lit(None).cast("timestamp").alias("discarded_at"),
        F.lit(None).cast("string").alias("discard_reason"),
        now.alias("created_at"),
        now.alias("updated_at"),
    )
    return rows.select(*DEAD_LETTER.fieldNames())


def to_envelopes(dlq: DataFrame, *keep: str) -> DataFrame:
    """(key, value) rows for the dead-letter topic, with the columns named in ``keep``; the
    payload is a nested object again."""
    value = F.struct(
        F.col("event_id").alias("eventId"),
        F.col("trace_id").alias("traceId"),
        F.col("user_id").alias("userId"),
        F.col("source_topic").alias("sourceTopic"),
        F.col("source_partition").alias("sourcePartition"),
        F.col("source_offset").alias("sourceOffset"),
        F.col("failure_stage").alias("failureStage"),
        F.col("error_type").alias("errorType"),
        F.col("error_message").alias("errorMessage"),
        F.from_json("payload_json", TRANSACTION_JSON).alias("payload"),
        F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("failedAt"),
    )
    return dlq.select(*keep, F.col("user_id").alias("key"), F.to_json(value).alias("value"))


def union_rejects(*streams: DataFrame) -> DataFrame:
    """One dead-letter input from several reject streams, missing columns filled with NULL."""
    out = streams[0]
    for stream in streams[1:]:
        out = out.unionByName(stream, allowMissingColumns=True)
    return out


def apply_commands(dlq: DataFrame, commands: DataFrame) -> DataFrame:
    """Commands with the row they name (``found`` is false for an unknown id). Commands of
    one batch apply to a row once: the first by ``command_id`` is taken, later ones see
    whatever state the first left in the next batch and come back as ``superseded``."""
    first = commands.groupBy("dlq_id").agg(F.min("command_id").alias("__first"))
    ranked = (
        commands.join(first, "dlq_id")
        .withColumn("superseded", F.col("command_id") > F.col("__first"))
        .drop("__first")
    )
    row = dlq.select("dlq_id", F.struct("*").alias("row"))
    return ranked.join(row, "dlq_id", "left").withColumn(
        "found", F.col("row").isNotNull()
    )


def _payload_readable(payload: Column) -> Column:
    """The payload is a JSON object that still names its event."""
    return F.coalesce(F.from_json(payload, TRANSACTION_JSON)["eventId"].isNotNull(), F.lit(False))


def _finish(
    dlq: DataFrame,
    decided: DataFrame,
    action: str,
    metadata: Column,
    now: Column,
    republish: bool,
) -> CommandOutcome:
    known = decided.filter("found AND NOT superseded")
    changed = known.filter("changes").select("dlq_id", "after.*")
    state = ("status", "reprocess_attempts", "last_reprocessed_at", "discarded_at")
    moved = [*state, "discard_reason", "updated_at"]
    renamed = changed.select(
        "dlq_id", *[F.col(c).alias(f"new_{c}") for c in moved], F.lit(True).alias("hit")
    )
    updated = dlq.join(renamed, "dlq_id", "left").select(
        *[
            F.when(F.col("hit"), F.col(f"new_{c}")).otherwise(F.col(c)).alias(c)
            if c in moved
            else F.col(c)
            for c in dlq.columns
        ]
    )
    audit = known.select(
        F.col("actor"),
        F.lit(action).alias("action"),
        F.lit(AUDIT_TARGET_TYPE).alias("target_type"),
        F.col("dlq_id").cast("string").alias("target_id"),
        F.col("trace_id"),
        F.when(F.col("outcome").isin("reprocessed", "discarded"), F.lit("SUCCESS"))
        .otherwise(F.lit("FAILED"))
        .alias("result"),
        F.col("reason"),
        metadata.alias("metadata"),
        now.alias("created_at"),
    )
    sent = known.filter("outcome = 'reprocessed'") if republish else known.filter("false")
    republished = sent.select(
        "dlq_id",
        F.col("row.event_id").alias("event_id"),
        F.col("row.user_id").alias("key"),
        F.col("row.payload_json").alias("value"),
    )
    not_found = decided.filter("NOT found").select("command_id", "dlq_id")
    return CommandOutcome(updated, republished, audit_rows(audit), not_found)


def reprocess(
    dlq: DataFrame,
    commands: DataFrame,
    max_attempts: int = MAX_REPROCESS_ATTEMPTS,
    now: Column | None = None,
) -> CommandOutcome:
    """Send dead letters again.

    ``commands``: command_id, dlq_id, actor, reason, trace_id and optionally
    ``publish_failed`` (the sink refused this payload). The attempt limit is checked before
    the state; an unreadable payload uses up an attempt and leaves the row REPROCESSING, as
    the state machine never gets to the next step.
    """
    now = F.current_timestamp() if now is None else now
    if "publish_failed" not in commands.columns:
        commands = commands.withColumn("publish_failed", F.lit(False))
    joined = apply_commands(dlq, commands)
    row = F.col("row")
    outcome = (
        F.when(
            row["reprocess_attempts"] >= max_attempts,
            F.lit("MAX_REPROCESS_ATTEMPTS_EXCEEDED"),
        )
        .when(~row["status"].isin(*RETRYABLE_STATUSES), F.lit("DLT_STATE_CONFLICT"))
        .when(~_payload_readable(row["payload_json"]), F.lit("DLT_STATE_CONFLICT"))
        .when(F.col("publish_failed"), F.lit("publish_failed"))
        .otherwise(F.lit("reprocessed"))
    )
    started = (row["reprocess_attempts"] < max_attempts) & row["status"].isin(
        *RETRYABLE_STATUSES
    )
    status = (
        F.when(F.col("outcome") == "reprocessed", F.lit("REPROCESSED"))
        .when(F.col("outcome") == "publish_failed", F.lit("REPROCESS_FAILED"))
        .when(F.col("changes"), F.lit("REPROCESSING"))
        .otherwise(row["status"])
    )
    decided = joined.withColumns({"outcome": outcome, "changes": started}).withColumn(
        "after",
        F.struct(
            status.alias("status"),
            (row["reprocess_attempts"] + F.col("changes").cast("int")).alias(
                "reprocess_attempts"
            ),
            now.alias("last_reprocessed_at"),
            row["discarded_at"].alias("discarded_at"),
            row["discard_reason"].alias("discard_reason"),
            now.alias("updated_at"),
        ),
    )
    metadata = F.create_map(
        F.lit("eventId"),
        row["event_id"],
        F.lit("status"),
        F.col("after.status"),
        F.lit("reprocessAttempts"),
        F.col("after.reprocess_attempts").cast("string"),
        F.lit("maxAttempts"),
        F.lit(str(max_attempts)),
        F.lit("resultReason"),
        F.col("outcome"),
    )
    return _finish(dlq, decided, "DLT_REPROCESS", metadata, now, republish=True)


def discard(dlq: DataFrame, commands: DataFrame, now: Column | None = None) -> CommandOutcome:
    """Discard dead letters. Same allowed states as reprocessing; a reason is required."""
    now = F.current_timestamp() if now is None else now
    joined = apply_commands(dlq, commands)
    row = F.col("row")
    outcome = (
        F.when(~row["status"].isin(*RETRYABLE_STATUSES), F.lit("DLT_STATE_CONFLICT"))
        .when(is_blank(F.col("reason")), F.lit("DISCARD_REASON_REQUIRED"))
        .otherwise(F.lit("discarded"))
    )
    decided = joined.withColumn("outcome", outcome).withColumn(
        "changes", F.col("outcome") == "discarded"
    )
    decided = decided.withColumn(
        "after",
        F.struct(
            F.when(F.col("changes"), F.lit("DISCARDED"))
            .otherwise(row["status"])
            .alias("status"),
            row["reprocess_attempts"].alias("reprocess_attempts"),
            row["last_reprocessed_at"].alias("last_reprocessed_at"),
            F.when(F.col("changes"), now).alias("discarded_at"),
            F.when(F.col("changes"), F.col("reason")).alias("discard_reason"),
            now.alias("updated_at"),
        ),
    )
    metadata = F.create_map(
        F.lit("eventId"),
        row["event_id"],
        F.lit("status"),
        F.col("after.status"),
        F.lit("resultReason"),
        F.col("outcome"),
    )
    return _finish(dlq, decided, "DLT_DISCARD", metadata, now, republish=False)


def audit_rows(outcome: DataFrame) -> DataFrame:
    """Bounded audit rows; ``metadata`` (a map) becomes JSON, NULL when it is empty."""
    metadata = F.col("metadata")
    return outcome.select(
        F.substring(blank_to(F.col("actor"), DEFAULT_ACTOR), 1, MAX_ACTOR_CHARS).alias("actor"),
        "action",
        "target_type",
        "target_id",
        "trace_id",
        "result",
        F.substring("reason", 1, MAX_MESSAGE_CHARS).alias("reason"),
        F.when(F.size(metadata) > 0, F.to_json(metadata)).alias("metadata_json"),
        "created_at",
    )
