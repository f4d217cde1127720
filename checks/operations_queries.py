"""Queries over logs, dead letters and operational tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from checks import tables
from checks.registry import check
from ledgerwatch.operators import deadletter, operations, results
from ledgerwatch.session import ensure_checkpoint_dir
from ledgerwatch.streaming.windows import held_alert_stream


@check(
    "page_dlq",
    ("dlq",),
    """SELECT event_id, status, (epoch_us(created_at) // 1000) AS created_at FROM dlq
       WHERE status = 'PENDING' ORDER BY created_at DESC, event_id LIMIT 20 OFFSET 40""",
)
def page_dlq(spark, sf_dir):
    pending = tables.dlq(spark, sf_dir).filter("status = 'PENDING'")
    items, _ = results.page(pending, page_index=2, size=20)
    return items.select("event_id", "status", "created_at")


@check(
    "page_dlq_by_key",
    ("dlq",),
    """SELECT event_id, status, (epoch_us(created_at) // 1000) AS created_at FROM dlq
       WHERE status = 'PENDING' ORDER BY created_at DESC, event_id LIMIT 20 OFFSET 40""",
)
def page_dlq_by_key(spark, sf_dir):
    """The third page, reached by the last rows of the two before."""
    pending = tables.dlq(spark, sf_dir).filter("status = 'PENDING'")
    pending = pending.select("event_id", "status", "created_at")
    last = None
    for _ in range(2):
        shown = results.page_after(pending, 20, last).collect()
        last = shown[-1] if shown else last
    return results.page_after(pending, 20, last)


@check(
    "page_dlq_total",
    ("dlq",),
    "SELECT count(*) AS total FROM dlq WHERE status = 'PENDING'",
)
def page_dlq_total(spark, sf_dir):
    pending = tables.dlq(spark, sf_dir).filter("status = 'PENDING'")
    return results.page(pending, page_index=0, size=20)[1]


def _reprocess(spark, sf_dir):
    return deadletter.reprocess(tables.dlq(spark, sf_dir), tables.commands(spark, sf_dir))


def _discard(spark, sf_dir):
    return deadletter.discard(tables.dlq(spark, sf_dir), tables.commands(spark, sf_dir))


@check(
    "reprocess",
    ("dlq", "reprocessed"),
    """SELECT d.dlq_id, coalesce(r.new_status, d.status) AS status,
         coalesce(r.new_attempts, d.reprocess_attempts) AS reprocess_attempts
       FROM dlq d LEFT JOIN reprocessed r ON d.dlq_id = r.dlq_id AND r.changes""",
)
def reprocess(spark, sf_dir):
    return _reprocess(spark, sf_dir).dlq.select("dlq_id", "status", "reprocess_attempts")


@check(
    "republished",
    ("reprocessed",),
    """SELECT event_id, user_id AS key, payload_json AS value FROM reprocessed
       WHERE outcome = 'reprocessed'""",
)
def republished(spark, sf_dir):
    return _reprocess(spark, sf_dir).republished.select("event_id", "key", "value")


@check(
    "reprocess_audit",
    ("reprocessed",),
    """SELECT CAST(dlq_id AS VARCHAR) AS target_id, actor, 'DLT_REPROCESS' AS action,
         CASE WHEN outcome = 'reprocessed' THEN 'SUCCESS' ELSE 'FAILED' END AS result, reason,
         trace_id, '{"eventId":"' || event_id || '","status":"' || new_status ||
           '","reprocessAttempts":"' || new_attempts ||
           '","maxAttempts":"3","resultReason":"' || outcome || '"}' AS metadata_json
       FROM reprocessed""",
)
def reprocess_audit(spark, sf_dir):
    return _reprocess(spark, sf_dir).audit.select(
        "target_id", "actor", "action", "result", "reason", "trace_id", "metadata_json"
    )


@check(
    "commands_not_found",
    ("dlq", "all_commands"),
    """SELECT command_id, dlq_id FROM all_commands
       WHERE dlq_id NOT IN (SELECT dlq_id FROM dlq)""",
)
def commands_not_found(spark, sf_dir):
    return _reprocess(spark, sf_dir).not_found


@check(
    "discard",
    ("dlq", "discarded"),
    """SELECT d.dlq_id, coalesce(r.new_status, d.status) AS status,
         CASE WHEN r.outcome = 'discarded' THEN r.reason END AS discard_reason
       FROM dlq d LEFT JOIN discarded r ON d.dlq_id = r.dlq_id""",
)
def discard(spark, sf_dir):
    return _discard(spark, sf_dir).dlq.select("dlq_id", "status", "discard_reason")


@check(
    "discard_audit",
    ("discarded",),
    """SELECT CAST(dlq_id AS VARCHAR) AS target_id, actor, 'DLT_DISCARD' AS action,
         CASE WHEN outcome = 'discarded' THEN 'SUCCESS' ELSE 'FAILED' END AS result,
         '{"eventId":"' || event_id || '","status":"' || new_status ||
           '","resultReason":"' || outcome || '"}' AS metadata_json FROM discarded""",
)
def discard_audit(spark, sf_dir):
    return _discard(spark, sf_dir).audit.select(
        "target_id", "actor", "action", "result", "metadata_json"
    )


_SIDES = """SELECT coalesce(a.event_id, l.event_id, r.event_id, d.event_id) AS event_id,
    coalesce(published, false) AS published, l.event_id IS NOT NULL AS consumed,
    coalesce(n_results, 0) AS n_results, d.event_id IS NOT NULL AS in_dlq
  FROM (SELECT event_id, bool_or(status = 'PUBLISHED') AS published FROM receipts GROUP BY 1) a
  FULL JOIN (SELECT DISTINCT event_id FROM logs) l ON a.event_id = l.event_id
  FULL JOIN (SELECT event_id, count(*) AS n_results FROM stored_results GROUP BY 1) r
    ON coalesce(a.event_id, l.event_id) = r.event_id
  FULL JOIN (SELECT DISTINCT event_id FROM dlq) d
    ON coalesce(a.event_id, l.event_id, r.event_id) = d.event_id"""
_STATUS = """CASE WHEN n_results > 1 THEN 'DUPLICATE_RESULT' WHEN n_results = 1 THEN 'OK'
  WHEN in_dlq THEN 'IN_DLQ' WHEN NOT published AND NOT consumed THEN 'NOT_PUBLISHED'
  ELSE 'MISSING_RESULT' END"""


def _reconciled(spark, sf_dir):
    return operations.reconcile(
        tables.receipts(spark, sf_dir),
        tables.logs(spark, sf_dir),
        tables.stored_results(spark, sf_dir),
        tables.dlq(spark, sf_dir),
    )


@check(
    "reconcile",
    ("receipts", "logs", "stored_results", "dlq"),
    f"SELECT *, {_STATUS} AS status FROM ({_SIDES})",
)
def reconcile(spark, sf_dir):
    return _reconciled(spark, sf_dir)


@check(
    "reconcile_summary",
    ("receipts", "logs", "stored_results", "dlq"),
    f"SELECT {_STATUS} AS status, count(*) AS n FROM ({_SIDES}) GROUP BY 1",
)
def reconcile_summary(spark, sf_dir):
    return operations.reconcile_summary(_reconciled(spark, sf_dir))


_FROM, _TO = "2024-01-05T00:00:00Z", "2024-01-20T00:00:00Z"
_RANGE = "BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-20'"


@check(
    "operations_summary",
    ("receipts", "logs", "stored_results", "dlq"),
    f"""SELECT '{_FROM}' AS "from", '{_TO}' AS "to",
          (SELECT count(*) FROM receipts WHERE received_at {_RANGE}) AS acceptedEventCount,
          (SELECT count(*) FROM stored_results WHERE detected_at {_RANGE}) AS fraudResultCount,
          (SELECT count(*) FROM stored_results WHERE detected_at {_RANGE}
             AND risk_level = 'HIGH') AS highRiskCount,
          (SELECT count(*) FROM dlq WHERE created_at {_RANGE} AND status = 'PENDING')
             AS dlqPendingCount,
          (SELECT count(*) FROM stored_results WHERE detected_at {_RANGE} AND degraded)
             AS degradedResultCount,
          (SELECT count(*) FROM logs WHERE processed_at {_RANGE}
             AND status = 'DUPLICATE_SKIPPED') AS duplicateSkippedCount""",
)
def operations_summary(spark, sf_dir):
    return operations.operations_summary(
        tables.receipts(spark, sf_dir),
        tables.logs(spark, sf_dir),
        tables.stored_results(spark, sf_dir),
        tables.dlq(spark, sf_dir),
        _FROM,
        _TO,
    )


@check(
    "counters",
    ("results", "dlq", "reprocessed", "discarded"),
    """SELECT counter, tag, count(*) AS n FROM (
         SELECT 'detection_degraded' AS counter, '' AS tag FROM results WHERE degraded
         UNION ALL SELECT 'rule_skipped', unnest(string_split(skipped_rules, ','))
           FROM results WHERE degraded
         UNION ALL SELECT 'dlt_published', '' FROM dlq
         UNION ALL SELECT 'dlt_reprocess_requested',
           CASE WHEN outcome = 'reprocessed' THEN 'success' ELSE 'failed' END FROM reprocessed
         UNION ALL SELECT 'dlt_discarded',
           CASE WHEN outcome = 'discarded' THEN 'success' ELSE 'failed' END FROM discarded)
       GROUP BY counter, tag""",
)
def counters(spark, sf_dir):
    audit = _reprocess(spark, sf_dir).audit.unionByName(_discard(spark, sf_dir).audit)
    return operations.operation_counters(
        tables.results(spark, sf_dir), tables.dlq(spark, sf_dir), audit
    )


_LATENCIES = """SELECT latency, ms, risk_level FROM (
    SELECT risk_level, (epoch_us(received_at) // 1000) - (epoch_us(event_time) // 1000) AS ingest,
      (epoch_us(detected_at) // 1000) - (epoch_us(received_at) // 1000) AS detection,
      (epoch_us(detected_at) // 1000) - (epoch_us(event_time) // 1000) AS end_to_end FROM results),
  LATERAL (VALUES ('ingest', ingest), ('detection', detection), ('end_to_end', end_to_end))
    v(latency, ms) WHERE ms >= 0"""
_POINTS = """count(*) AS n, quantile_cont(ms, 0.5) AS p50, quantile_cont(ms, 0.95) AS p95,
  quantile_cont(ms, 0.99) AS p99, max(ms) AS max_ms"""


@check(
    "latency_percentiles",
    ("results",),
    f"SELECT latency, {_POINTS} FROM ({_LATENCIES}) GROUP BY latency",
)
def latency_percentiles(spark, sf_dir):
    return operations.latency_percentiles(tables.results(spark, sf_dir))


@check(
    "latency_percentiles_by_level",
    ("results",),
    f"SELECT latency, risk_level, {_POINTS} FROM ({_LATENCIES}) GROUP BY latency, risk_level",
)
def latency_percentiles_by_level(spark, sf_dir):
    return operations.latency_percentiles(tables.results(spark, sf_dir), ["risk_level"])


@check(
    "slo_check",
    ("results", "stored_results"),
    """SELECT t.metric, m.value, t.target,
         CASE WHEN t.metric = 'publish_success_rate' THEN m.value >= t.target
              ELSE m.value <= t.target END AS ok
       FROM (VALUES ('api_p95_ms', 300.0), ('api_p99_ms', 800.0),
               ('publish_success_rate', 0.995), ('processing_p95_ms', 1000.0),
               ('detection_p95_ms', 2000.0), ('lag_recovery_ms', 180000.0), ('dlq_loss', 0.0),
               ('duplicate_results', 0.0)) t(metric, target)
       LEFT JOIN (
         SELECT 'detection_p95_ms' AS metric, quantile_cont(
             (epoch_us(detected_at) // 1000) - (epoch_us(received_at) // 1000), 0.95) AS value FROM results
         UNION ALL SELECT 'duplicate_results', CAST(count(*) AS DOUBLE) FROM (
             SELECT event_id FROM stored_results GROUP BY 1 HAVING count(*) > 1)) m
         ON t.metric = m.metric""",
)
def slo_check(spark, sf_dir):
    p95 = (
        operations.latency_percentiles(tables.results(spark, sf_dir))
        .filter("latency = 'detection'")
        .select(F.lit("detection_p95_ms").alias("metric"), F.col("p95").alias("value"))
    )
    repeated = (
        tables.stored_results(spark, sf_dir)
        .groupBy("event_id")
        .agg(F.count("*").alias("n"))
        .agg(F.count(F.when(F.col("n") > 1, 1)).cast("double").alias("value"))
        .select(F.lit("duplicate_results").alias("metric"), "value")
    )
    return operations.slo_check(p95.unionByName(repeated))


def _lags(spark, sf_dir):
    ends = (
        tables.tx(spark, sf_dir)
        .groupBy("topic", "partition_no")
        .agg(F.max("offset_no").alias("end_offset"))
    )
    done = tables.logs(spark, sf_dir).filter("status = 'PROCESSED'")
    return operations.consumer_lag(ends, done)


_LAG = """SELECT e.topic, e.partition_no, end_offset, processed_offset,
    greatest(end_offset - coalesce(processed_offset, -1), 0) AS lag,
    coalesce(processed_rows, 0) AS processed_rows
  FROM (SELECT topic, partition_no, max(offset_no) AS end_offset FROM tx GROUP BY 1, 2) e
  LEFT JOIN (SELECT topic, partition_no, max(offset_no) AS processed_offset,
      count(*) AS processed_rows FROM logs WHERE status = 'PROCESSED' GROUP BY 1, 2) d
    ON e.topic = d.topic AND e.partition_no = d.partition_no"""


@check("consumer_lag", ("tx", "logs"), _LAG)
def consumer_lag(spark, sf_dir):
    return _lags(spark, sf_dir)


@check(
    "lag_by_topic",
    ("tx", "logs"),
    f"""SELECT topic, CAST(sum(lag) AS BIGINT) AS lag, max(lag) AS max_partition_lag,
          max(processed_rows) / avg(processed_rows) AS hot_partition_ratio
        FROM ({_LAG}) GROUP BY topic""",
)
def lag_by_topic(spark, sf_dir):
    return operations.lag_by_topic(_lags(spark, sf_dir))


@check(
    "dlq_backlog",
    ("dlq",),
    "SELECT status, failure_stage, count(*) AS n FROM dlq GROUP BY status, failure_stage",
)
def dlq_backlog(spark, sf_dir):
    return operations.dlq_backlog(tables.dlq(spark, sf_dir))


_WINDOWS = """SELECT alert, window_start, window_start + 300000 AS window_end, count(*) AS n
  FROM (SELECT alert, ((epoch_us(detected_at) // 1000) // 60000 - s) * 60000 AS window_start
        FROM (SELECT 'FraudRedisDegradedIncreased' AS alert, detected_at FROM results
                WHERE degraded
              UNION ALL SELECT 'FraudRuleSkippedIncreased', detected_at
                FROM results, (VALUES (0), (1)) r(x) WHERE degraded),
             (VALUES (0), (1), (2), (3), (4)) w(s)) GROUP BY 1, 2"""


@check("alert_windows", ("results",), _WINDOWS)
def alert_windows(spark, sf_dir):
    return operations.alert_windows(tables.results(spark, sf_dir))


@check(
    "firing_alerts",
    ("results",),
    f"""SELECT a.* FROM ({_WINDOWS}) a WHERE EXISTS (SELECT 1 FROM ({_WINDOWS}) b
          WHERE b.alert = a.alert AND b.window_end = a.window_end - 60000)""",
)
def firing_alerts(spark, sf_dir):
    return operations.firing_alerts(
        operations.alert_windows(tables.results(spark, sf_dir))
    )


@check(
    "held_alerts",
    ("results",),
    f"""SELECT a.* FROM ({_WINDOWS}) a WHERE EXISTS (SELECT 1 FROM ({_WINDOWS}) b
          WHERE b.alert = a.alert AND b.window_end = a.window_end - 60000)""",
)
def held_alerts(spark, sf_dir):
    return operations.held_alerts(tables.results(spark, sf_dir))


@check(
    "held_alerts_stream",
    ("results",),
    f"""SELECT a.* FROM ({_WINDOWS}) a WHERE EXISTS (SELECT 1 FROM ({_WINDOWS}) b
          WHERE b.alert = a.alert AND b.window_end = a.window_end - 60000)
        AND a.window_end <= (SELECT max(epoch_us(detected_at)) // 1000 - 600000 FROM results)""",
)
def held_alerts_stream(spark, sf_dir):
    """The same from a stream of the results, each alert once, as far as the watermark has
    come. The later half arrives after a restart."""
    folder = f"{ensure_checkpoint_dir(spark)}/held_alerts-{uuid.uuid4().hex}"
    rows = tables.results(spark, sf_dir).select("detected_at", "degraded", "skipped_rules")
    middle = rows.agg(F.expr("percentile_approx(unix_millis(detected_at), 0.5)")).first()[0] or 0
    later = F.unix_millis("detected_at") >= middle
    for part in (rows.where(~later), rows.where(later)):
        part.write.mode("append").parquet(f"{folder}/in")
        source = spark.readStream.schema(rows.schema).parquet(f"{folder}/in")
        found = held_alert_stream(source, "10 minutes")
        writer = found.writeStream.format("parquet").outputMode("append")
        writer = writer.option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/c")
        writer.trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(found.schema).parquet(f"{folder}/out")


@check(
    "per_minute_rates",
    ("receipts",),
    """SELECT (epoch_us(received_at) // 1000) // 60000 * 60000 AS window_start, status, count(*) AS n,
         count(*) / 60.0 AS per_second FROM receipts GROUP BY 1, 2""",
)
def per_minute_rates(spark, sf_dir):
    return operations.rates(tables.receipts(spark, sf_dir), "received_at", by=["status"])


@check(
    "status_totals",
    ("receipts",),
    """SELECT status, count(*) AS n, count(*) / sum(count(*)) OVER () AS share
       FROM receipts GROUP BY status""",
)
def status_totals(spark, sf_dir):
    return operations.totals(tables.receipts(spark, sf_dir), ["status"])
