"""Queries over transactions: intake, windows, rules, results, streaming."""

from __future__ import annotations

import uuid
from dataclasses import replace

from pyspark.sql import functions as F

from checks import tables
from checks.base_sql import DAY, windowed
from checks.registry import check
from ledgerwatch.config import MAX_FUTURE_MINUTES
from ledgerwatch.operators import intake, results, rules, sets, windows
from ledgerwatch.operators.arrival import arrival_window
from ledgerwatch.operators.deadletter import (
    to_dead_letters,
    to_envelopes,
    union_rejects,
)
from ledgerwatch.plans.detection import detect_batch, take_in
from ledgerwatch.session import ensure_checkpoint_dir
from ledgerwatch.sources.files import number_rows
from ledgerwatch.sources.idempotent import append_once as append_to
from ledgerwatch.sources.idempotent import new_rows, repeated_rows
from ledgerwatch.sources.shared import SharedTable
from ledgerwatch.streaming.detect import (
    Sinks,
    detect_payloads,
    detect_stream,
    route_failures,
    stored_counters,
)

FLAGSHIP_COLUMNS = (
    "event_id",
    "user_id",
    "window_count",
    "window_sum",
    "risk_score",
    "risk_level",
    "decision",
    "matched_rules",
    "skipped_rules",
    "degraded",
    "reason",
)


@check(
    "detect_flagship",
    ("flagship",),
    """SELECT event_id, user_id, window_count, CAST(window_sum AS DOUBLE) AS window_sum,
         risk_score, risk_level, decision, matched_rules, skipped_rules, degraded, reason
       FROM flagship""",
)
def detect_flagship(spark, sf_dir):
    found = detect_batch(tables.deliveries(spark, sf_dir), window_ms=tables.DAY_MS)
    return found.select(*FLAGSHIP_COLUMNS)


@check(
    "intake_validate",
    ("tx",),
    """SELECT n, concat_ws('; ',
         CASE WHEN amt <= 0 THEN 'amount must be greater than 0.0' END,
         CASE WHEN amt IS NULL THEN 'amount must not be null' END,
         CASE WHEN cur <> 'KRW' THEN 'currency must be KRW' END,
         CASE WHEN trim(cur) = '' THEN 'currency must not be blank' END,
         CASE WHEN et IS NULL THEN 'eventTime must not be null' END,
         CASE WHEN kind NOT IN ('PAYMENT','TRANSFER','WITHDRAWAL','DEPOSIT')
           THEN 'eventType must be one of PAYMENT,TRANSFER,WITHDRAWAL,DEPOSIT' END,
         CASE WHEN kind IS NULL THEN 'eventType must not be null' END,
         CASE WHEN trim(usr) = '' THEN 'userId must not be blank' END) AS violations
       FROM (SELECT n, CASE WHEN n % 53 = 0 THEN ' ' ELSE user_id END AS usr,
               CASE WHEN n % 59 = 0 THEN '' WHEN n % 61 = 0 THEN 'USD' ELSE currency END AS cur,
               CASE WHEN n % 67 = 0 THEN NULL ELSE amount END AS amt,
               CASE WHEN n % 71 = 0 THEN NULL ELSE event_time END AS et,
               CASE WHEN n % 73 = 0 THEN NULL ELSE event_type END AS kind FROM tx)""",
)
def intake_validate(spark, sf_dir):
    return intake.with_violations(tables.requests(spark, sf_dir)).select("n", "violations")


@check(
    "intake_outcome_counts",
    ("tx", "accepted"),
    """SELECT 'accepted' AS outcome, count(*) AS rows_seen FROM accepted
       UNION ALL SELECT 'rejected', (SELECT count(*) FROM tx) - (SELECT count(*) FROM accepted)""",
)
def intake_outcome_counts(spark, sf_dir):
    taken = take_in(tables.tx(spark, sf_dir))
    both = taken.accepted.select(F.lit("accepted").alias("outcome")).unionByName(
        taken.rejected.select(F.lit("rejected").alias("outcome"))
    )
    return both.groupBy("outcome").agg(F.count("*").alias("rows_seen"))


@check(
    "future_events",
    ("tx",),
    """SELECT event_id, (epoch_us(event_time) // 1000) AS event_time, (epoch_us(received_at) // 1000) AS received_at
       FROM tx WHERE event_time > received_at + INTERVAL 5 MINUTE""",
)
def future_events(spark, sf_dir):
    _, late = intake.reject_future_events(tables.tx(spark, sf_dir), MAX_FUTURE_MINUTES)
    return late.select("event_id", "event_time", "received_at")


@check(
    "tx_project",
    ("tx",),
    """SELECT event_id, 'v1' AS schema_version, (epoch_us(received_at) // 1000) AS received_at,
         CASE WHEN trim(trace_id) = '' THEN 'fresh' ELSE trace_id END AS trace FROM tx""",
)
def tx_project(spark, sf_dir):
    stamped = intake.to_transaction_event(tables.tx(spark, sf_dir))
    fresh = F.col("trace_id").rlike("^trace-[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}$")
    return stamped.select(
        "event_id",
        "schema_version",
        "received_at",
        F.when(fresh, F.lit("fresh")).otherwise(F.col("trace_id")).alias("trace"),
    )


def _rule_query(name: str, code: str) -> None:
    @check(
        name,
        ("flagship",),
        f"""SELECT event_id, user_id, risk_score FROM flagship
            WHERE list_contains(string_split(matched_rules, ','), '{code}')""",
    )
    def run(spark, sf_dir):
        found = detect_batch(tables.deliveries(spark, sf_dir), window_ms=tables.DAY_MS)
        return found.filter(F.array_contains("matched_rules", code)).select(
            "event_id", "user_id", "risk_score"
        )


for _name, _code in (
    ("rule_amount", "AMOUNT_THRESHOLD"),
    ("rule_night", "NIGHT_TIME_TRANSACTION"),
    ("rule_location", "SUSPICIOUS_LOCATION"),
    ("rule_rapid", "RAPID_TRANSACTION_COUNT"),
    ("rule_window_sum", "WINDOW_AMOUNT_SUM"),
):
    _rule_query(_name, _code)


@check(
    "risk_level_counts",
    ("flagship",),
    "SELECT risk_level, count(*) AS n FROM flagship GROUP BY risk_level",
)
def risk_level_counts(spark, sf_dir):
    found = detect_batch(tables.deliveries(spark, sf_dir), window_ms=tables.DAY_MS)
    return found.groupBy("risk_level").agg(F.count("*").alias("n"))


@check(
    "decision_counts",
    ("flagship",),
    "SELECT decision, count(*) AS n FROM flagship GROUP BY decision",
)
def decision_counts(spark, sf_dir):
    found = detect_batch(tables.deliveries(spark, sf_dir), window_ms=tables.DAY_MS)
    return found.groupBy("decision").agg(F.count("*").alias("n"))


@check(
    "matched_rule_counts",
    ("flagship",),
    """SELECT rule_code, count(*) AS n FROM (
         SELECT unnest(string_split(matched_rules, ',')) AS rule_code FROM flagship
         WHERE matched_rules <> '') GROUP BY rule_code""",
)
def matched_rule_counts(spark, sf_dir):
    found = detect_batch(tables.deliveries(spark, sf_dir), window_ms=tables.DAY_MS)
    return (
        found.select(F.explode("matched_rules").alias("rule_code"))
        .groupBy("rule_code")
        .agg(F.count("*").alias("n"))
    )


@check(
    "degraded_detect",
    ("stateless",),
    """SELECT event_id, risk_score, risk_level, decision, matched_rules, skipped_rules, degraded,
         reason FROM stateless""",
)
def degraded_detect(spark, sf_dir):
    scored = rules.score_events(tables.accepted(spark, sf_dir), stateful=False)
    return scored.select(
        "event_id",
        "risk_score",
        "risk_level",
        "decision",
        "matched_rules",
        "skipped_rules",
        "degraded",
        "reason",
    )


@check(
    "trailing_window_5m",
    ("once",),
    "SELECT event_id, window_count, CAST(window_sum AS DOUBLE) AS window_sum FROM ("
    + windowed("once", 300_000)
    + ")",
)
def trailing_window_5m(spark, sf_dir):
    once = windows.first_wins(
        tables.deliveries(spark, sf_dir), ["event_id"], ["partition_no", "offset_no"]
    )
    return windows.trailing_window(once).select("event_id", "window_count", "window_sum")


@check(
    "arrival_window_day",
    ("accepted",),
    f"""SELECT i.event_id, count(j.event_id) AS window_count,
          CAST(sum(j.amount) AS DOUBLE) AS window_sum
        FROM (SELECT *, (epoch_us(event_time) // 1000) AS ms,
                n + CASE WHEN n % 6 = 0 THEN 900 WHEN n % 41 = 0 THEN 4000 ELSE 0 END AS seq
              FROM accepted) i
        JOIN (SELECT *, (epoch_us(event_time) // 1000) AS ms,
                n + CASE WHEN n % 6 = 0 THEN 900 WHEN n % 41 = 0 THEN 4000 ELSE 0 END AS seq
              FROM accepted) j
          ON i.user_id = j.user_id AND (j.seq, j.n) <= (i.seq, i.n)
          AND j.ms BETWEEN i.ms - {DAY} AND i.ms
        WHERE NOT EXISTS (SELECT 1 FROM (SELECT *, (epoch_us(event_time) // 1000) AS ms,
                n + CASE WHEN n % 6 = 0 THEN 900 WHEN n % 41 = 0 THEN 4000 ELSE 0 END AS seq
              FROM accepted) k
          WHERE k.user_id = j.user_id AND (k.seq, k.n) > (j.seq, j.n)
            AND (k.seq, k.n) <= (i.seq, i.n) AND k.ms > j.ms + {DAY})
        GROUP BY i.event_id""",
)
def arrival_window_day(spark, sf_dir):
    """Arrival order differs from event order: some events come 900 or 4000 events late."""
    n = F.col("n")
    seq = n + F.when(n % 6 == 0, 900).when(n % 41 == 0, 4000).otherwise(0)
    # (sequence, n) is the arrival position; n breaks ties as a later offset would.
    shuffled = tables.accepted(spark, sf_dir).withColumns(
        {"partition_no": seq, "offset_no": n}
    )
    return arrival_window(shuffled, tables.DAY_MS, bucket_windows=1).select(
        "event_id", "window_count", "window_sum"
    )


@check(
    "first_wins",
    ("once",),
    "SELECT event_id, offset_no, (epoch_us(received_at) // 1000) AS received_at FROM once",
)
def first_wins(spark, sf_dir):
    return windows.first_wins(
        tables.deliveries(spark, sf_dir), ["event_id"], ["partition_no", "offset_no"]
    ).select("event_id", "offset_no", "received_at")


@check(
    "latest_logs",
    ("logs",),
    """SELECT event_id, offset_no, status, row_number() OVER (PARTITION BY event_id
         ORDER BY processed_at DESC, partition_no DESC, offset_no DESC) AS recency FROM logs""",
)
def latest_logs(spark, sf_dir):
    return windows.latest_logs(tables.logs(spark, sf_dir)).select(
        "event_id", "offset_no", "status", "recency"
    )


_STORED = "SELECT event_id FROM accepted WHERE user_id LIKE '%3'"


@check(
    "append_once",
    ("accepted", "deliveries", "once"),
    f"SELECT event_id, offset_no FROM once WHERE event_id NOT IN ({_STORED})",
)
def append_once(spark, sf_dir):
    target = tables.accepted(spark, sf_dir).filter(F.col("user_id").endswith("3"))
    fresh = new_rows(
        tables.deliveries(spark, sf_dir), target, ["event_id"], ["partition_no", "offset_no"]
    )
    return fresh.select("event_id", "offset_no")


@check(
    "existing_duplicates",
    ("accepted", "deliveries"),
    f"SELECT event_id, offset_no FROM deliveries WHERE event_id IN ({_STORED})",
)
def existing_duplicates(spark, sf_dir):
    target = tables.accepted(spark, sf_dir).filter(F.col("user_id").endswith("3"))
    return repeated_rows(tables.deliveries(spark, sf_dir), target, ["event_id"]).select(
        "event_id", "offset_no"
    )


@check(
    "number_rows",
    ("accepted",),
    "SELECT row_number() OVER (ORDER BY n) AS row_number, event_id FROM accepted",
)
def numbered(spark, sf_dir):
    return number_rows(tables.accepted(spark, sf_dir), "n", bucket_width=512).select(
        "row_number", "event_id"
    )


@check(
    "new_device",
    ("accepted",),
    """SELECT event_id, max((epoch_us(event_time) // 1000)) OVER (PARTITION BY user_id, device_id
         ORDER BY (epoch_us(event_time) // 1000) RANGE BETWEEN 432000000 PRECEDING AND 1 PRECEDING)
         IS NULL AS new_device FROM accepted""",
)
def new_device(spark, sf_dir):
    found = windows.new_device(tables.accepted(spark, sf_dir), days=5)
    return found.select("event_id", "new_device")


@check(
    "location_change",
    ("accepted",),
    """SELECT event_id, coalesce(upper(trim(location)) <> upper(trim(prev)) AND
         (epoch_us(event_time) // 1000) - prev_ms <= 14400000, false) AS location_change
       FROM (SELECT *, lag(location) OVER w AS prev, lag((epoch_us(event_time) // 1000)) OVER w AS prev_ms
             FROM accepted
             WINDOW w AS (PARTITION BY user_id ORDER BY (epoch_us(event_time) // 1000), offset_no))""",
)
def location_change(spark, sf_dir):
    found = windows.location_change(tables.accepted(spark, sf_dir), within_ms=14_400_000)
    return found.select("event_id", "location_change")


@check(
    "failed_then_success",
    ("tx",),
    f"""SELECT event_id, recent_failures, event_type <> 'DEBIT' AND recent_failures >= 3
          AS failed_then_success
        FROM (SELECT *, count(*) FILTER (WHERE event_type = 'DEBIT') OVER (PARTITION BY user_id
                ORDER BY (epoch_us(event_time) // 1000) RANGE BETWEEN {3 * DAY} PRECEDING AND 1 PRECEDING)
                AS recent_failures FROM tx)""",
)
def failed_then_success(spark, sf_dir):
    failed = F.col("event_type") == "DEBIT"
    found = windows.failed_then_success(
        tables.tx(spark, sf_dir), failed, window_ms=3 * tables.DAY_MS
    )
    return found.select("event_id", "recent_failures", "failed_then_success")


# ---------------------------------------------------------------- stored results


@check(
    "risk_events",
    ("results",),
    """SELECT 'v1' AS schemaVersion, event_id AS eventId, user_id AS userId,
         risk_level AS riskLevel, risk_score AS riskScore, matched_rules AS matchedRuleCodes,
         skipped_rules AS skippedRuleCodes, degraded, (epoch_us(detected_at) // 1000) AS detectedAt
       FROM results""",
)
def risk_events(spark, sf_dir):
    return results.to_risk_events(tables.results(spark, sf_dir)).drop("traceId")


@check(
    "alert_events",
    ("results",),
    """SELECT 'v1' AS schemaVersion, event_id AS eventId, user_id AS userId,
         risk_level AS riskLevel, risk_score AS riskScore, matched_rules AS matchedRuleCodes,
         (epoch_us(detected_at) // 1000) AS detectedAt, (epoch_us(detected_at) // 1000) + 1000 AS alertCreatedAt
       FROM results WHERE risk_level = 'HIGH'""",
)
def alert_events(spark, sf_dir):
    created = F.col("detected_at") + F.expr("INTERVAL 1 SECOND")
    return results.to_alert_events(tables.results(spark, sf_dir), created).drop("traceId")


@check(
    "filter_results",
    ("results",),
    """SELECT event_id, risk_score, (epoch_us(detected_at) // 1000) AS detected_at FROM results
       WHERE risk_level = 'LOW' AND degraded
         AND detected_at BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-20'
         AND (matched_rules LIKE '%RAPID_TRANSACTION_COUNT%'
              OR skipped_rules LIKE '%RAPID_TRANSACTION_COUNT%')""",
)
def filter_results(spark, sf_dir):
    found = results.filter_results(
        tables.results(spark, sf_dir),
        risk_level="LOW",
        degraded=True,
        rule_code="RAPID_TRANSACTION_COUNT",
        time_from="2024-01-05T00:00:00Z",
        time_to="2024-01-20T00:00:00Z",
    )
    return found.select("event_id", "risk_score", "detected_at")


@check(
    "latency_columns",
    ("results",),
    """SELECT event_id,
         CASE WHEN a >= 0 THEN a END AS ingest_ms, CASE WHEN b >= 0 THEN b END AS detection_ms,
         CASE WHEN c >= 0 THEN c END AS end_to_end_ms
       FROM (SELECT event_id, (epoch_us(received_at) // 1000) - (epoch_us(event_time) // 1000) AS a,
               (epoch_us(detected_at) // 1000) - (epoch_us(received_at) // 1000) AS b,
               (epoch_us(detected_at) // 1000) - (epoch_us(event_time) // 1000) AS c FROM results)""",
)
def latency_columns(spark, sf_dir):
    return results.latency_columns(tables.results(spark, sf_dir)).select(
        "event_id", "ingest_ms", "detection_ms", "end_to_end_ms"
    )


@check(
    "result_by_event_id",
    ("results",),
    "SELECT event_id, risk_score, reason FROM results WHERE event_id = 'evt-500'",
)
def result_by_event_id(spark, sf_dir):
    return results.by_event_id(tables.results(spark, sf_dir), "evt-500").select(
        "event_id", "risk_score", "reason"
    )


@check(
    "receipts_by_event_ids",
    ("receipts", "dlq"),
    """SELECT event_id, status FROM receipts WHERE event_id IN (SELECT event_id FROM dlq)""",
)
def receipts_by_event_ids(spark, sf_dir):
    ids = tables.dlq(spark, sf_dir).select("event_id")
    return results.by_event_ids(tables.receipts(spark, sf_dir), ids).select(
        "event_id", "status"
    )


@check(
    "rule_version_summary",
    ("results",),
    """SELECT nullif(trim(rule_version), '') AS rule_version, count(*) AS n
       FROM results GROUP BY 1""",
)
def rule_version_summary(spark, sf_dir):
    return results.rule_version_summary(tables.results(spark, sf_dir))


@check(
    "rules_from_text",
    ("results",),
    "SELECT event_id, matched_rules FROM results",
)
def rules_from_text(spark, sf_dir):
    stored = tables.results(spark, sf_dir).withColumn(
        "matched_rules", F.concat_ws(" ,", "matched_rules")
    )
    return results.rules_from_text(stored).select("event_id", "matched_rules")


@check(
    "id_sets",
    ("receipts", "stored_results"),
    """SELECT event_id, 'first' AS side FROM (SELECT event_id FROM receipts
         EXCEPT SELECT event_id FROM stored_results)
       UNION ALL SELECT event_id, 'second' FROM (SELECT event_id FROM stored_results
         EXCEPT SELECT event_id FROM receipts)""",
)
def id_sets(spark, sf_dir):
    return sets.ids_difference(
        tables.receipts(spark, sf_dir), tables.stored_results(spark, sf_dir), "event_id"
    )


@check(
    "id_intersection",
    ("dlq", "stored_results", "logs"),
    """SELECT event_id FROM logs INTERSECT SELECT event_id FROM stored_results""",
)
def id_intersection(spark, sf_dir):
    return sets.ids_in_both(
        tables.logs(spark, sf_dir), tables.stored_results(spark, sf_dir), "event_id"
    )


@check(
    "missing_keys",
    (),
    """SELECT event_id, CASE WHEN props LIKE '%"k"%' THEN 'v' ELSE 'k,v' END AS missing
       FROM events""",
)
def missing_keys(spark, sf_dir):
    events = tables.read(spark, sf_dir, "events")
    keys = F.json_object_keys("props")
    return events.select("event_id", sets.missing_keys(keys, ("v", "k")).alias("missing"))


# ---------------------------------------------------------------- failures


def _payloads(spark, sf_dir):
    """Wire payloads of the transactions, some of them damaged."""
    sent = intake.to_transaction_event(tables.tx(spark, sf_dir))
    n = F.col("n")
    text = F.to_json(intake.columns_to_wire())
    damaged = (
        F.when(n % 79 == 0, F.lit("{broken"))
        .when(n % 83 == 0, F.replace(text, F.lit('"v1"'), F.lit('"v9"')))
        .when(n % 89 == 0, F.replace(text, F.lit('"currency":"KRW"'), F.lit('"currency":""')))
        .otherwise(text)
    )
    return sent.select("topic", "partition_no", "offset_no", "n", damaged.alias("value"))


@check(
    "parse_guard",
    ("tx",),
    """SELECT n, CASE WHEN n % 79 = 0 THEN 'UNPARSEABLE_PAYLOAD'
         WHEN n % 83 = 0 THEN 'UNSUPPORTED_SCHEMA_VERSION'
         WHEN n % 89 = 0 THEN 'MISSING_FIELD' ELSE 'ok' END AS outcome,
         CASE WHEN n % 79 = 0 THEN 'payload is not a transaction event'
         WHEN n % 83 = 0 THEN 'schemaVersion v9' WHEN n % 89 = 0 THEN 'currency'
         ELSE event_id END AS detail FROM tx""",
)
def parse_guard(spark, sf_dir):
    ok, dead = intake.parse_guard(_payloads(spark, sf_dir))
    return ok.select("n", F.lit("ok").alias("outcome"), F.col("event_id").alias("detail")).union(
        dead.select("n", "error_type", "error_message")
    )


@check(
    "dead_letters",
    ("tx",),
    """SELECT offset_no AS source_offset, 'PARSE_ERROR' AS failure_stage,
         CASE WHEN n % 79 = 0 THEN 'UNPARSEABLE_PAYLOAD'
           WHEN n % 83 = 0 THEN 'UNSUPPORTED_SCHEMA_VERSION' ELSE 'MISSING_FIELD' END
           AS error_type, 'PENDING' AS status, 0 AS reprocess_attempts
       FROM tx WHERE n % 79 = 0 OR n % 83 = 0 OR n % 89 = 0
       UNION ALL
       SELECT offset_no, 'INTAKE', 'INVALID_TRANSACTION_EVENT', 'PENDING', 0
       FROM tx WHERE event_type = 'DEBIT' OR amount <= 0
         OR event_time > received_at + INTERVAL 5 MINUTE""",
)
def dead_letters(spark, sf_dir):
    """Reject streams of two stages in one dead-letter table."""
    _, unparsed = intake.parse_guard(_payloads(spark, sf_dir))
    refused = take_in(tables.tx(spark, sf_dir)).rejected.select(
        "topic",
        "partition_no",
        "offset_no",
        "event_id",
        "trace_id",
        "user_id",
        F.lit("INVALID_TRANSACTION_EVENT").alias("error_type"),
        F.col("violations").alias("error_message"),
        F.lit("{}").alias("payload_json"),
    )
    both = union_rejects(
        to_dead_letters(unparsed, "PARSE_ERROR"), to_dead_letters(refused, "INTAKE")
    )
    return both.select(
        "source_offset", "failure_stage", "error_type", "status", "reprocess_attempts"
    )


@check(
    "dead_letter_envelopes",
    ("dlq",),
    """SELECT user_id AS key, event_id, source_offset,
         CASE WHEN readable THEN event_id END AS payload_event_id FROM dlq""",
)
def dead_letter_envelopes(spark, sf_dir):
    sent = to_envelopes(tables.dlq(spark, sf_dir))
    return sent.select(
        "key",
        F.get_json_object("value", "$.eventId").alias("event_id"),
        F.get_json_object("value", "$.sourceOffset").cast("long").alias("source_offset"),
        F.get_json_object("value", "$.payload.eventId").alias("payload_event_id"),
    )


@check(
    "route_failures",
    ("tx",),
    """SELECT n, CASE WHEN n % 67 = 0 OR n % 71 = 0 THEN 'dead' ELSE 'score' END AS route,
         concat_ws(',', CASE WHEN n % 67 = 0 THEN 'amount' END,
                        CASE WHEN n % 71 = 0 THEN 'event_time' END) AS missing FROM tx""",
)
def routed(spark, sf_dir):
    good, failed = route_failures(tables.requests(spark, sf_dir))
    none = F.lit("").alias("missing")
    return good.select("n", F.lit("score").alias("route"), none).union(
        failed.select("n", F.lit("dead"), "error_message")
    )


@check(
    "stream_detect",
    ("streamed",),
    """SELECT event_id, user_id, risk_score, risk_level, matched_rules,
         'rule-v2-baseline-v1' AS rule_version FROM streamed""",
)
def stream_detect(spark, sf_dir):
    """The detection stream over all transactions, run to the end; returns stored results."""
    folder = f"{ensure_checkpoint_dir(spark)}/stream_detect-{uuid.uuid4().hex}"
    source = tables.read(spark, sf_dir, "events").schema
    # A stream source reads a folder; the pattern names the one file of this table.
    stream = spark.readStream.schema(source).parquet(f"{sf_dir}/events.parque[t]")
    events = take_in(tables.tx_of(stream)).accepted
    sinks = Sinks.under(folder)
    detect_stream(events, sinks, available_now=True).awaitTermination()
    return spark.read.parquet(sinks.results).select(
        "event_id", "user_id", "risk_score", "risk_level", "matched_rules", "rule_version"
    )


def payloads(spark, sf_dir):
    """Raw payloads of all transactions in two deliveries. In the first, some have no amount,
    a time that is none, an amount that does not fit, or are no JSON; the second repairs half
    of these and repeats others."""
    n = F.col("n")
    tx = tables.tx(spark, sf_dir).withColumn("schema_version", F.lit("v1"))
    whole = F.to_json(intake.columns_to_wire())
    rows = tx.select("n", "topic", "partition_no", "offset_no", whole.alias("value"))
    broken = (
        F.when(n % 67 == 0, F.regexp_replace("value", '"amount":[^,]*,', ""))
        .when(n % 71 == 0, F.regexp_replace("value", '"eventTime":"[^"]*"', '"eventTime":"soon"'))
        .when(n % 73 == 0, F.regexp_replace("value", '"amount":[^,]*', '"amount":1e-19'))
        .when(n % 79 == 0, F.lit("{"))
        .otherwise(F.col("value"))
    )
    first = rows.withColumn("value", broken)
    again = rows.where((_is_broken(n) & (n % 2 == 0)) | (n % 10 == 0))
    second = again.withColumn("offset_no", F.col("offset_no") + 10_000_000_000)
    return first.drop("n"), second.drop("n")


def _is_broken(n):
    return (n % 67 == 0) | (n % 71 == 0) | (n % 73 == 0) | (n % 79 == 0)


def _recovered(spark, sf_dir) -> Sinks:
    """The payload stream over both deliveries, each its own micro-batch, with restarts."""
    folder = f"{ensure_checkpoint_dir(spark)}/stream_recover-{uuid.uuid4().hex}"
    sinks = Sinks.under(folder)
    for part in payloads(spark, sf_dir):
        part.write.mode("append").parquet(f"{folder}/topic")
        raw = spark.readStream.schema(part.schema).parquet(f"{folder}/topic")
        detect_payloads(raw, sinks, available_now=True).awaitTermination()
    return sinks


_BROKEN = "(n % 67 = 0 OR n % 71 = 0 OR n % 73 = 0 OR n % 79 = 0)"


@check(
    "stream_recover",
    ("tx",),
    f"""SELECT event_id, user_id, amount >= 1000000 AS large FROM tx
        WHERE NOT {_BROKEN} OR n % 2 = 0""",
)
def stream_recover(spark, sf_dir):
    """Results of the payload stream: every readable event once, repaired ones included."""
    found = spark.read.parquet(_recovered(spark, sf_dir).results)
    large = F.array_contains("matched_rules", "AMOUNT_THRESHOLD").alias("large")
    return found.select("event_id", "user_id", large)


@check(
    "stream_dead_letters",
    ("tx",),
    f"""SELECT n AS source_offset, 'PAYLOAD_ERROR' AS failure_stage,
          CASE WHEN n % 67 = 0 THEN 'MISSING_FIELD' WHEN n % 71 = 0 THEN 'INVALID_EVENT_TIME'
               WHEN n % 73 = 0 THEN 'UNSUPPORTED_AMOUNT' ELSE 'UNPARSEABLE_PAYLOAD' END
            AS error_type,
          CASE WHEN n % 67 <> 0 AND n % 71 <> 0 AND n % 73 <> 0 THEN NULL ELSE event_id END
            AS sent_event_id
        FROM tx WHERE {_BROKEN}""",
)
def stream_dead_letters(spark, sf_dir):
    """Dead letters of the payload stream with the event their envelope names."""
    sinks = _recovered(spark, sf_dir)
    keys = ["source_topic", "source_partition", "source_offset"]
    dead = spark.read.parquet(sinks.dead_letters)
    sent = spark.read.parquet(sinks.envelopes).select(
        *keys, F.get_json_object("value", "$.eventId").alias("sent_event_id")
    )
    return dead.join(sent, keys).select(
        "source_offset", "failure_stage", "error_type", "sent_event_id"
    )


@check(
    "append_once_sink",
    ("deliveries",),
    """SELECT event_id, min(offset_no) AS offset_no, CAST(event_time AS DATE)::VARCHAR AS day
       FROM deliveries GROUP BY event_id, 3""",
)
def append_once_sink(spark, sf_dir):
    """The sink itself: all deliveries appended twice to a table with a partition per day."""
    target = f"{ensure_checkpoint_dir(spark)}/append_once-{uuid.uuid4().hex}"
    rows = tables.deliveries(spark, sf_dir).withColumn("day", F.to_date("event_time"))
    rows = rows.select("event_id", "partition_no", "offset_no", "day")
    for _ in range(2):
        append_to(rows, target, ["event_id"], ["partition_no", "offset_no"], ["day"])
    return spark.read.parquet(target).select("event_id", "offset_no", F.col("day").cast("string"))


@check(
    "append_shared",
    ("deliveries",),
    """SELECT event_id, CAST(event_time AS DATE)::VARCHAR AS day,
         coalesce(min(offset_no) FILTER (offset_no >= 10000000000 OR n % 3 = 0), min(offset_no))
           AS offset_no
       FROM deliveries GROUP BY event_id, 2""",
)
def append_shared(spark, sf_dir):
    """Two writers of one table, each looking before the other has committed: one has the late
    copies and a third of the originals, the other all originals. Then everything again."""
    rows = tables.deliveries(spark, sf_dir).withColumn("day", F.to_date("event_time"))
    late = (F.col("offset_no") >= 10_000_000_000) | (F.col("n") % 3 == 0)
    first, second = rows.where(late), rows.where(F.col("offset_no") < 10_000_000_000)
    names = ["event_id", "partition_no", "offset_no", "day"]
    target = f"{ensure_checkpoint_dir(spark)}/append_shared-{uuid.uuid4().hex}"
    schema = rows.select(names).schema
    one, two = (SharedTable(spark, target, schema, ["event_id"], "day") for _ in range(2))
    order = ["partition_no", "offset_no"]
    ahead, behind = one.prepare(first.select(names), order), two.prepare(second.select(names), order)
    one.commit(ahead)
    two.commit(behind)
    one.append(rows.select(names), order)
    return one.rows().select("event_id", "offset_no", F.col("day").cast("string"))


@check(
    "stream_event_time",
    ("streamed",),
    """SELECT event_id, risk_score, matched_rules FROM streamed WHERE epoch_us(event_time) // 1000
         < (SELECT max(epoch_us(event_time)) // 1000 - 600000 FROM streamed)""",
)
def stream_event_time(spark, sf_dir):
    """The detection stream in event time: what the watermark has passed, as in a table."""
    folder = f"{ensure_checkpoint_dir(spark)}/stream_event_time-{uuid.uuid4().hex}"
    source = tables.read(spark, sf_dir, "events").schema
    stream = spark.readStream.schema(source).parquet(f"{sf_dir}/events.parque[t]")
    events = take_in(tables.tx_of(stream)).accepted
    sinks = Sinks.under(folder)
    detect_stream(events, sinks, available_now=True, watermark="10 minutes").awaitTermination()
    return spark.read.parquet(sinks.results).select("event_id", "risk_score", "matched_rules")


@check(
    "stream_counters",
    ("streamed",),
    """SELECT metric, n FROM (
         SELECT 'results' AS metric, count(*) AS n FROM streamed UNION ALL
         SELECT 'high_risk', count(*) FILTER (risk_level = 'HIGH') FROM streamed UNION ALL
         SELECT unnest(['degraded', 'dlq_published', 'skipped:RAPID_TRANSACTION_COUNT',
                        'skipped:WINDOW_AMOUNT_SUM']), 0)""",
)
def stream_counters(spark, sf_dir):
    """Counters of the detection stream, run a second time from a lost checkpoint: the repeated
    micro-batch stores and counts nothing anew."""
    folder = f"{ensure_checkpoint_dir(spark)}/stream_counters-{uuid.uuid4().hex}"
    source = tables.read(spark, sf_dir, "events").schema
    stream = spark.readStream.schema(source).parquet(f"{sf_dir}/events.parque[t]")
    events = take_in(tables.tx_of(stream)).accepted
    sinks = Sinks.under(folder)
    for run in range(2):
        own = replace(sinks, checkpoint=f"{sinks.checkpoint}-{run}")
        detect_stream(events, own, available_now=True).awaitTermination()
    return stored_counters(spark, sinks.counters)
