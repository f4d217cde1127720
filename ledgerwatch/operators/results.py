"""Queries and derived rows over stored fraud results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from ledgerwatch.config import ACTION_POLICY, CASE_LEVELS, SCHEMA_VERSION
from ledgerwatch.functions.text import is_blank, strip
from ledgerwatch.functions.times import epoch_ms
from ledgerwatch.operators.typemap import inline_table


def latency_columns(df: DataFrame) -> DataFrame:
    """Add ingest_ms, detection_ms, end_to_end_ms. Negative values are NULL: the recorder
    ignores them."""

    def between(later: str, earlier: str) -> Column:
        ms = epoch_ms(F.col(later)) - epoch_ms(F.col(earlier))
        return F.when(ms >= 0, ms)

    return df.withColumns(
        {
            "ingest_ms": between("received_at", "event_time"),
            "detection_ms": between("detected_at", "received_at"),
            "end_to_end_ms": between("detected_at", "event_time"),
        }
    )


def to_risk_events(results: DataFrame) -> DataFrame:
    return results.select(
        F.lit(SCHEMA_VERSION).alias("schemaVersion"),
        F.col("event_id").alias("eventId"),
        F.col("user_id").alias("userId"),
        F.col("risk_level").alias("riskLevel"),
        F.col("risk_score").alias("riskScore"),
        F.col("matched_rules").alias("matchedRuleCodes"),
        F.col("skipped_rules").alias("skippedRuleCodes"),
        "degraded",
        F.col("detected_at").alias("detectedAt"),
        F.col("trace_id").alias("traceId"),
    )


def to_alert_events(
    results: DataFrame,
    created_at: Column | None = None,
    levels: tuple[str, ...] = ("HIGH",),
) -> DataFrame:
    """Alert rows for the alerting levels, stamped with their creation time."""
    return results.filter(F.col("risk_level").isin(*levels)).select(
        F.lit(SCHEMA_VERSION).alias("schemaVersion"),
        F.col("event_id").alias("eventId"),
        F.col("user_id").alias("userId"),
        F.col("risk_level").alias("riskLevel"),
        F.col("risk_score").alias("riskScore"),
        F.col("matched_rules").alias("matchedRuleCodes"),
        F.col("detected_at").alias("detectedAt"),
        (F.current_timestamp() if created_at is None else created_at).alias("alertCreatedAt"),
        F.col("trace_id").alias("traceId"),
    )


def filter_results(
    results: DataFrame,
    risk_level: str | None = None,
    degraded: bool | None = None,
    rule_code: str | None = None,
    time_from: str | None = None,
    time_to: str | None = None,
) -> DataFrame:
    """Optional filters; ``rule_code`` matches a matched or a skipped rule."""
    out = results
    if risk_level is not None:
        out = out.filter(F.col("risk_level") == risk_level)
    if degraded is not None:
        out = out.filter(F.col("degraded") == F.lit(degraded))
    if time_from is not None:
        out = out.filter(F.col("detected_at") >= F.to_timestamp(F.lit(time_from)))
    if time_to is not None:
        out = out.filter(F.col("detected_at") <= F.to_timestamp(F.lit(time_to)))
    if rule_code is not None:
        out = out.filter(
            F.array_contains("matched_rules", rule_code)
            | F.array_contains("skipped_rules", rule_code)
        )
    return out


def by_event_id(df: DataFrame, event_id: str) -> DataFrame:
    """Point lookup of a receipt, a result or the logs of an event. The equality reaches the
    parquet scan; an unknown id gives no rows."""
    return df.filter(F.col("event_id") == event_id)


def by_event_ids(df: DataFrame, ids: DataFrame) -> DataFrame:
    """Bulk lookup by a table of ids."""
    return df.join(ids.select("event_id"), "event_id", "left_semi")


def page(
    df: DataFrame,
    page_index: int,
    size: int,
    newest: str = "created_at",
    tie: str = "event_id",
) -> tuple[DataFrame, DataFrame]:
    """(items, total): one page, newest first, and the count of all rows. Sorting for a page
    is a top-n: every task keeps only the first ``(page_index + 1) * size`` rows."""
    items = df.orderBy(F.desc(newest), F.asc(tie)).offset(page_index * size).limit(size)
    return items, df.agg(F.count("*").alias("total"))


def page_after(
    df: DataFrame, size: int = 20, last: Row | None = None, order: str = "created_at", key: str = "event_id"
) -> DataFrame:
    """The page behind the ``last`` row of the one before (the first page without it), newest
    first, ties by key. However deep, a page costs a filter that reaches the scan and a top-n
    of ``size`` rows; ``page`` has to bring all rows of the pages before it together. Rows
    without a time are left out: they have no place in the order."""
    rows = df.filter(F.col(order).isNotNull())
    if last is not None:
        at = F.lit(last[order])
        rows = rows.filter(
            (F.col(order) < at) | ((F.col(order) == at) & (F.col(key) > F.lit(last[key])))
        )
    return rows.orderBy(F.desc(order), key).limit(size)


def rule_version_summary(results: DataFrame) -> DataFrame:
    """(rule_version, n); NULL stands for results stored without a version."""
    version = F.when(~is_blank(F.col("rule_version")), F.col("rule_version"))
    return results.groupBy(version.alias("rule_version")).agg(F.count("*").alias("n"))


def action_policy(results: DataFrame) -> DataFrame:
    """Follow-up action rows: one per result, two for CRITICAL. Unique per (event_id,
    action_type). The policy table has five rows, so broadcasting it is always safe."""
    table = inline_table(
        results.sparkSession,
        ACTION_POLICY,
        "policy_level string, action_type string, action_status string",
    )
    return results.join(
        F.broadcast(table), F.col("risk_level") == F.col("policy_level")
    ).select(
        "event_id",
        "risk_level",
        F.col("decision").alias("detection_decision"),
        "action_type",
        "action_status",
        "reason",
    )


def open_cases(results: DataFrame) -> DataFrame:
    """One OPEN case per HIGH or CRITICAL event."""
    return (
        results.filter(F.col("risk_level").isin(*CASE_LEVELS))
        .select(
            "event_id",
            "user_id",
            "risk_level",
            F.lit("OPEN").alias("case_status"),
            F.col("reason").alias("review_reason"),
        )
        .dropDuplicates(["event_id"])
    )


def action_summary(actions: DataFrame) -> DataFrame:
    return actions.groupBy("action_type", "action_status").agg(F.count("*").alias("n"))


def case_summary(cases: DataFrame) -> DataFrame:
    return cases.groupBy("case_status").agg(F.count("*").alias("n"))


def evidence_summary(results: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """(artifact, item, n): level and rule counts and, with labels, the rule-label matrix.
    Aggregates only, no ids."""
    levels = F.array(
        F.struct(F.lit("risk_level").alias("artifact"), F.col("risk_level").alias("item"))
    )
    rules = F.transform(
        "matched_rules",
        lambda code: F.struct(F.lit("rule_match").alias("artifact"), code.alias("item")),
    )
    marks = F.concat(levels, rules)
    if labels is not None:
        flags = labels.select(F.col("eventId").alias("event_id"), "isFraud")
        results = results.join(flags, "event_id", "left")
        positive = F.col("risk_level") != "LOW"
        cell = (
            F.when(F.col("isFraud") & positive, F.lit("TP"))
            .when(~F.col("isFraud") & positive, F.lit("FP"))
            .when(F.col("isFraud"), F.lit("FN"))
            .when(~F.col("isFraud"), F.lit("TN"))
        )
        matrix = F.struct(F.lit("rule_label").alias("artifact"), cell.alias("item"))
        marks = F.concat(marks, F.array(matrix))
    return (
        results.select(F.explode(marks).alias("mark"))
        .filter("mark.item IS NOT NULL")
        .groupBy("mark.artifact", "mark.item")
        .agg(F.count("*").alias("n"))
    )


def rules_from_text(results: DataFrame, column: str = "matched_rules") -> DataFrame:
    """Read a comma-joined rule column of an imported table as an array."""
    items = F.transform(F.split(F.coalesce(F.col(column), F.lit("")), ","), strip)
    return results.withColumn(column, F.filter(items, lambda item: item != ""))
