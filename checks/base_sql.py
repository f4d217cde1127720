"""The views of ``checks/tables.py`` as SQL common table expressions."""

from __future__ import annotations

from ledgerwatch.config import LOCAL_SALT, RAW_ID_PATTERN

DAY = 24 * 60 * 60 * 1000
RAW_ID = RAW_ID_PATTERN.replace("'", "''")


def _pad(byte: int) -> str:
    return bytes(b ^ byte for b in LOCAL_SALT.encode().ljust(64, b"\0")).hex()


def hmac(text: str) -> str:
    inner = f"sha256(unhex('{_pad(0x36)}') || encode({text}))"
    return f"substr(sha256(unhex('{_pad(0x5C)}') || unhex({inner})), 1, 16)"


_TYPES = "('PAYMENT','TRANSFER','WITHDRAWAL','DEPOSIT')"
_NUM = r"^[+-]?([0-9]+([.][0-9]*)?|[.][0-9]+)$"


def _num(column: str) -> str:
    return f"coalesce(regexp_matches({column}, '{_NUM}'), false)"


def _rule(test: str, value: str) -> str:
    return f"CASE WHEN {test} THEN {value} END"


# code -> (test, score, reason), in evaluation order
RULES = {
    "AMOUNT_THRESHOLD": ("amount >= 1000000", 50, "amount >= 1000000 KRW"),
    "NIGHT_TIME_TRANSACTION": (
        "hour(event_time) BETWEEN 0 AND 5",
        20,
        "eventTime hour between 0 and 5",
    ),
    "SUSPICIOUS_LOCATION": (
        "coalesce(upper(trim(location)) IN ('UNKNOWN','FOREIGN','HIGH_RISK'), false)",
        30,
        "location is UNKNOWN, FOREIGN, or HIGH_RISK",
    ),
    "RAPID_TRANSACTION_COUNT": (
        "window_count >= 5 AND NOT degraded",
        30,
        "transaction count in sliding window >= 5",
    ),
    "WINDOW_AMOUNT_SUM": (
        "window_sum >= 3000000 AND NOT degraded",
        40,
        "amount sum in sliding window >= 3000000",
    ),
}
BALANCE_RULES = {
    "BALANCE_DRAIN": ("old > 0 AND amt > 0 AND amt * 10 >= old * 8", 40),
    "HIGH_AMOUNT": ("amt >= 1000000", 30),
    "TRANSFER_CASHOUT_PATTERN": (
        "nativeEventType IN ('TRANSFER','CASH_OUT') AND amt >= 200000",
        25,
    ),
    "ZERO_BALANCE_AFTER_TRANSFER": (
        "nativeEventType IN ('TRANSFER','CASH_OUT') AND old > 0 AND new = 0",
        35,
    ),
}


def _score(source: str, stateful: bool = True) -> str:
    rules = {
        c: r
        for c, r in RULES.items()
        if stateful or c not in ("RAPID_TRANSACTION_COUNT", "WINDOW_AMOUNT_SUM")
    }
    total = " + ".join(_rule(t, str(s))[:-4] + " ELSE 0 END" for t, s, _ in rules.values())
    codes = ", ".join(_rule(t, f"'{c}'") for c, (t, _, _) in rules.items())
    reasons = ", ".join(_rule(t, f"'{r}'") for t, _, r in rules.values())
    return f"""
      SELECT s.*, CASE WHEN risk_score <= 29 THEN 'LOW' WHEN risk_score <= 69 THEN 'MEDIUM'
                       ELSE 'HIGH' END AS risk_level,
             CASE WHEN risk_score <= 29 THEN 'APPROVE' WHEN risk_score <= 69 THEN 'REVIEW'
                  ELSE 'BLOCK' END AS decision
      FROM (
        SELECT *, CAST(least(100, {total}) AS BIGINT) AS risk_score,
          concat_ws(',', {codes}) AS matched_rules,
          CASE WHEN degraded THEN 'RAPID_TRANSACTION_COUNT,WINDOW_AMOUNT_SUM' ELSE '' END
            AS skipped_rules,
          coalesce(nullif(concat_ws('; ', {reasons}), ''), 'No fraud rule matched') ||
          CASE WHEN degraded THEN '; Redis degraded mode: Redis sliding window unavailable'
               ELSE '' END AS reason
        FROM {source}) s"""


_DETECTED = "received_at + to_milliseconds(n % 50 * 40) AS detected_at"
_VERSION = """CASE WHEN n % 23 = 0 THEN NULL WHEN n % 29 = 0 THEN ' '
                   ELSE 'rule-v2-baseline-v1' END AS rule_version"""

CTES: dict[str, tuple[tuple[str, ...], str]] = {}


def _cte(name: str, needs: tuple[str, ...], body: str) -> None:
    CTES[name] = (needs, body)


_cte(
    "tx",
    (),
    """
  SELECT 'evt-' || event_id AS event_id, 'user-' || user_id AS user_id,
    'acc-' || user_id AS account_id,
    CASE event_type WHEN 'purchase' THEN 'PAYMENT' WHEN 'view' THEN 'TRANSFER'
      WHEN 'click' THEN 'DEPOSIT' WHEN 'signup' THEN 'WITHDRAWAL' ELSE 'DEBIT' END AS event_type,
    CAST(CAST(value AS DECIMAL(10,2)) * 10000 AS DECIMAL(19,2)) AS amount,
    'KRW' AS currency, 'm-' || (event_id % 50) AS merchant_id,
    'dev-' || (CAST(props ->> '$.k' AS INT) % 7) AS device_id,
    CASE CAST(props ->> '$.k' AS INT) % 20 WHEN 0 THEN 'UNKNOWN' WHEN 1 THEN ' foreign '
      WHEN 2 THEN 'HIGH_RISK' WHEN 3 THEN NULL ELSE 'KR' END AS location,
    ts AS event_time,
    CASE WHEN event_id % 97 = 0 THEN ts - INTERVAL 6 MINUTE
      ELSE ts + to_milliseconds(event_id % 7 * 100) END AS received_at,
    CASE WHEN event_id % 3 = 0 THEN ' ' ELSE 'trace-evt-' || event_id END AS trace_id,
    'transaction-events' AS topic, user_id % 6 AS partition_no, event_id AS offset_no,
    event_id AS n
  FROM events""",
)
_cte(
    "accepted",
    ("tx",),
    f"""SELECT * FROM tx WHERE event_type IN {_TYPES} AND amount > 0
        AND NOT event_time > received_at + INTERVAL 5 MINUTE""",
)
_cte(
    "deliveries",
    ("accepted",),
    """SELECT * FROM accepted UNION ALL
       SELECT * REPLACE (offset_no + 10000000000 AS offset_no,
                         received_at + INTERVAL 1 SECOND AS received_at)
       FROM accepted WHERE n % 10 = 0""",
)
_cte(
    "once",
    ("deliveries",),
    """SELECT * FROM deliveries
       QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY partition_no, offset_no) = 1""",
)


def windowed(source: str, window_ms: int = DAY) -> str:
    frame = (
        "PARTITION BY user_id ORDER BY (epoch_us(event_time) // 1000) "
        f"RANGE BETWEEN {window_ms} PRECEDING AND CURRENT ROW"
    )
    return f"""SELECT *, count(amount) OVER ({frame}) AS window_count,
                      sum(amount) OVER ({frame}) AS window_sum FROM {source}"""


_cte("plain_windowed", ("once",), "SELECT *, false AS degraded FROM (" + windowed("once") + ")")
_cte("flagship", ("plain_windowed",), _score("plain_windowed"))
# ``events`` arrives in event-time order, so the stream's arrival window is the trailing one.
_cte(
    "streamed_marked",
    ("accepted",),
    "SELECT *, false AS degraded FROM (" + windowed("accepted", 300_000) + ")",
)
_cte("streamed", ("streamed_marked",), _score("streamed_marked"))
_cte(
    "marked",
    ("once",),
    f"SELECT *, n % 19 = 0 AS degraded, {_DETECTED} FROM ({windowed('once')})",
)
_cte("results", ("marked",), f"SELECT *, {_VERSION} FROM ({_score('marked')})")
_cte("stateless_marked", ("accepted",), "SELECT *, true AS degraded FROM accepted")
_cte("stateless", ("stateless_marked",), _score("stateless_marked", stateful=False))
_cte(
    "receipts",
    ("accepted",),
    """SELECT *, CASE WHEN n % 31 = 0 THEN 'PUBLISH_FAILED' ELSE 'PUBLISHED' END AS status
       FROM accepted""",
)
_cte(
    "logs",
    ("deliveries",),
    """SELECT *, CASE WHEN offset_no >= 10000000000 THEN 'DUPLICATE_SKIPPED'
         ELSE 'PROCESSED' END AS status,
         received_at + to_milliseconds(n % 50 * 40) AS processed_at
       FROM deliveries WHERE n % 31 <> 0""",
)
_FAILED = "(event_type = 'DEPOSIT' OR location IS NULL)"
_cte(
    "stored_results",
    ("results",),
    f"""SELECT * FROM results WHERE n % 31 <> 0 AND NOT {_FAILED}
          AND NOT (event_type = 'WITHDRAWAL' AND device_id = 'dev-6')
        UNION ALL
        SELECT * FROM results WHERE n % 31 <> 0 AND NOT {_FAILED}
          AND event_type = 'WITHDRAWAL' AND device_id = 'dev-5'""",
)
_cte(
    "dlq",
    ("accepted",),
    f"""SELECT n AS dlq_id, event_id, trace_id, user_id, topic AS source_topic,
          partition_no AS source_partition, offset_no AS source_offset,
          CASE WHEN n % 3 = 0 THEN 'UNKNOWN_ERROR' ELSE 'RULE_ENGINE_ERROR' END
            AS failure_stage,
          CASE n % 5 WHEN 0 THEN 'REPROCESSED' WHEN 1 THEN 'REPROCESS_FAILED'
            WHEN 2 THEN 'DISCARDED' ELSE 'PENDING' END AS status,
          n % 4 AS reprocess_attempts, n % 7 <> 0 AS readable,
          CASE WHEN n % 7 = 0 THEN 'not json' ELSE
            '{{"schemaVersion":"v1","eventId":"' || event_id || '","userId":"' || user_id || '"}}'
            END AS payload_json,
          received_at AS created_at
        FROM accepted WHERE n % 31 <> 0 AND {_FAILED}""",
)
_cte(
    "all_commands",
    ("tx",),
    """SELECT n * 2 + c AS command_id, n AS dlq_id,
         CASE WHEN n % 4 = 0 THEN 'admin-api' ELSE 'op-' || (n % 9) END AS actor,
         CASE WHEN n % 13 = 0 THEN '' ELSE 'checked by hand' END AS reason,
         'trace-cmd-' || n AS trace_id, n % 11 = 0 AS publish_failed
       FROM tx, (VALUES (0), (1)) v(c) WHERE c = 0 OR n % 17 = 0""",
)
_cte(
    "reprocessed",
    ("dlq", "all_commands"),
    """SELECT *,
         CASE WHEN outcome = 'reprocessed' THEN 'REPROCESSED'
              WHEN outcome = 'publish_failed' THEN 'REPROCESS_FAILED'
              WHEN changes THEN 'REPROCESSING' ELSE old_status END AS new_status,
         attempts + CASE WHEN changes THEN 1 ELSE 0 END AS new_attempts
       FROM (SELECT c.*, d.event_id, d.user_id, d.payload_json, d.status AS old_status,
               d.reprocess_attempts AS attempts,
               d.reprocess_attempts < 3 AND d.status IN ('PENDING','REPROCESS_FAILED') AS changes,
               CASE WHEN d.reprocess_attempts >= 3 THEN 'MAX_REPROCESS_ATTEMPTS_EXCEEDED'
                    WHEN d.status NOT IN ('PENDING','REPROCESS_FAILED') THEN 'DLT_STATE_CONFLICT'
                    WHEN NOT d.readable THEN 'DLT_STATE_CONFLICT'
                    WHEN c.publish_failed THEN 'publish_failed'
                    ELSE 'reprocessed' END AS outcome
             FROM all_commands c JOIN dlq d USING (dlq_id)
             QUALIFY row_number() OVER (PARTITION BY dlq_id ORDER BY command_id) = 1)""",
)
_cte(
    "discarded",
    ("dlq", "all_commands"),
    """SELECT *, CASE WHEN outcome = 'discarded' THEN 'DISCARDED' ELSE old_status END
         AS new_status
       FROM (SELECT c.*, d.event_id, d.status AS old_status,
               CASE WHEN d.status NOT IN ('PENDING','REPROCESS_FAILED') THEN 'DLT_STATE_CONFLICT'
                    WHEN trim(c.reason) = '' THEN 'DISCARD_REASON_REQUIRED'
                    ELSE 'discarded' END AS outcome
             FROM all_commands c JOIN dlq d USING (dlq_id)
             QUALIFY row_number() OVER (PARTITION BY dlq_id ORDER BY command_id) = 1)""",
)

# ---------------------------------------------------------------- simulation

_cte(
    "paysim_base",
    (),
    """SELECT o_orderkey AS k, o_custkey, o_orderstatus,
         CAST(o_totalprice AS DECIMAL(18,2)) AS money,
         CAST(CAST(c_acctbal AS DECIMAL(18,2)) * 40 AS DECIMAL(18,2)) AS old,
         date_diff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) * 24 AS hours,
         CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'TRANSFER' WHEN '2' THEN 'CASH_OUT'
           WHEN '3' THEN 'PAYMENT' WHEN '4' THEN 'CASH_IN' ELSE 'DEBIT' END AS native
       FROM orders JOIN customer ON o_custkey = c_custkey""",
)
_cte(
    "paysim_raw",
    ("paysim_base",),
    """SELECT k + 1 AS row_number,
         CASE WHEN k % 211 = 0 THEN 'x' WHEN k % 223 = 0 THEN '-1'
           ELSE CAST(hours AS VARCHAR) END AS step,
         CASE WHEN k % 227 = 0 THEN 'REFUND' ELSE native END AS type,
         CASE WHEN k % 229 = 0 THEN 'NaN' WHEN k % 233 = 0 THEN '-5.00'
           WHEN k % 199 = 0 THEN '0.00' ELSE CAST(money AS VARCHAR) END AS amount,
         CASE WHEN k % 239 = 0 THEN '  '
           ELSE 'C' || lpad(CAST(o_custkey AS VARCHAR), 9, '0') END AS nameOrig,
         CASE WHEN k % 241 = 0 THEN 'abc' ELSE CAST(old AS VARCHAR) END AS oldbalanceOrg,
         CAST(CAST(greatest(old - money, 0) AS DECIMAL(18,2)) AS VARCHAR) AS newbalanceOrig,
         CASE WHEN k % 2 = 0 THEN 'M' ELSE 'C' END ||
           lpad(CAST(k * 7 % 1000003 AS VARCHAR), 9, '0') AS nameDest,
         '0.00' AS oldbalanceDest,
         CASE WHEN k % 251 = 0 THEN 'Infinity' ELSE CAST(money AS VARCHAR) END AS newbalanceDest,
         CASE WHEN k % 257 = 0 THEN '2'
           WHEN native IN ('TRANSFER','CASH_OUT') AND o_orderstatus = 'F' THEN '1' ELSE '0' END
           AS isFraud,
         CASE WHEN k % 263 = 0 THEN '' WHEN native = 'TRANSFER' AND money > 400000 THEN '1'
           ELSE '0' END AS isFlaggedFraud
       FROM paysim_base""",
)
_cte(
    "tagged",
    ("paysim_raw",),
    rf"""SELECT *,
         CASE type WHEN 'CASH_OUT' THEN 'WITHDRAWAL' WHEN 'CASH_IN' THEN 'DEPOSIT'
           WHEN 'PAYMENT' THEN 'PAYMENT' WHEN 'TRANSFER' THEN 'TRANSFER' END AS normalized,
         CASE WHEN type IN ('CASH_OUT','CASH_IN') THEN 'replay-supported'
           WHEN type IN ('PAYMENT','TRANSFER') THEN 'production-supported'
           ELSE 'unsupported' END AS support,
         split_part(problem, '|', 1) AS reject_reason,
         split_part(problem, '|', 2) AS reject_message
       FROM (SELECT *, CASE
         WHEN NOT regexp_matches(step, '^[+-]?[0-9]+$') THEN 'INVALID_STEP|step must be an integer'
         WHEN CAST(step AS INT) < 0 THEN 'INVALID_STEP|step must be >= 0'
         WHEN type NOT IN ('PAYMENT','TRANSFER','CASH_OUT','CASH_IN','DEBIT')
           THEN 'INVALID_TYPE|type is not supported'
         WHEN type = 'DEBIT' THEN 'UNSUPPORTED_NATIVE_TYPE:DEBIT|native type is not supported '
           || 'by replay mapping policy'
         WHEN NOT {_num("amount")} THEN 'INVALID_AMOUNT|amount must be a finite decimal'
         WHEN CAST(amount AS DECIMAL(18,2)) < 0 THEN 'INVALID_AMOUNT|amount must be >= 0'
         WHEN NOT {_num("oldbalanceOrg")}
           THEN 'INVALID_BALANCE|oldbalanceOrg must be a finite decimal'
         WHEN NOT {_num("newbalanceOrig")}
           THEN 'INVALID_BALANCE|newbalanceOrig must be a finite decimal'
         WHEN NOT {_num("oldbalanceDest")}
           THEN 'INVALID_BALANCE|oldbalanceDest must be a finite decimal'
         WHEN NOT {_num("newbalanceDest")}
           THEN 'INVALID_BALANCE|newbalanceDest must be a finite decimal'
         WHEN trim(nameOrig) = '' OR trim(nameDest) = ''
           THEN 'UNSUPPORTED_ROW|nameOrig and nameDest must not be blank'
         WHEN isFraud NOT IN ('0','1') THEN 'INVALID_LABEL|isFraud must be 0 or 1'
         WHEN isFlaggedFraud NOT IN ('0','1') THEN 'INVALID_LABEL|isFlaggedFraud must be 0 or 1'
         END AS problem FROM paysim_raw)""",
)
_cte(
    "good",
    ("tagged",),
    f"""SELECT *, 'paysim-' || lpad(CAST(row_number AS VARCHAR), 9, '0') AS eventId,
          {hmac("nameOrig")} AS origin, {hmac("nameDest")} AS destination
        FROM tagged WHERE problem IS NULL""",
)
_cte(
    "sim_events",
    ("good",),
    """SELECT row_number, eventId, 'U-' || origin AS userId, 'A-' || origin AS accountId,
         'D-' || destination AS destinationAccountId, normalized AS eventType,
         type AS nativeEventType, normalized AS normalizedEventType,
         support AS typeSupportLevel, 'paysim-native-mapping-v1' AS typeMappingPolicyVersion,
         amount, 'KRW' AS currency,
         strftime(TIMESTAMP '2026-01-01 00:00:00' + to_hours(CAST(step AS INT)),
                  '%Y-%m-%dT%H:%M:%SZ') AS eventTime,
         'trace-' || eventId AS traceId, 'v2-paysim' AS schemaVersion, 'PAYSIM' AS source,
         CAST(step AS BIGINT) AS sourceStep, oldbalanceOrg AS oldBalanceOrig,
         newbalanceOrig AS newBalanceOrig, oldbalanceDest AS oldBalanceDest,
         newbalanceDest AS newBalanceDest
       FROM good""",
)
_cte(
    "sim_labels",
    ("good",),
    """SELECT row_number, eventId, isFraud = '1' AS isFraud,
         isFlaggedFraud = '1' AS sourceFlaggedFraud, CAST(step AS BIGINT) AS sourceStep,
         type AS sourceType, normalized AS normalizedType, support AS typeSupportLevel,
         'paysim-native-mapping-v1' AS typeMappingPolicyVersion
       FROM good""",
)
_b_total = " + ".join(f"CASE WHEN {t} THEN {s} ELSE 0 END" for t, s in BALANCE_RULES.values())
_b_codes = ", ".join(f"CASE WHEN {t} THEN '{c}' END" for c, (t, _) in BALANCE_RULES.items())
_cte(
    "balance_scored",
    ("sim_events",),
    f"""SELECT *, CASE WHEN risk_score <= 29 THEN 'LOW' WHEN risk_score <= 59 THEN 'MEDIUM'
          WHEN risk_score <= 79 THEN 'HIGH' ELSE 'CRITICAL' END AS risk_level
        FROM (SELECT *, CAST(least(100, {_b_total}) AS BIGINT) AS risk_score,
                concat_ws(',', {_b_codes}) AS rule_codes
              FROM (SELECT *, CAST(amount AS DECIMAL(18,2)) AS amt,
                      CAST(oldBalanceOrig AS DECIMAL(18,2)) AS old,
                      CAST(newBalanceOrig AS DECIMAL(18,2)) AS new FROM sim_events))""",
)
_cte(
    "kept_results",
    ("balance_scored",),
    """SELECT *, row_number AS n FROM balance_scored WHERE row_number % 13 <> 0""",
)
_cte(
    "sim_results",
    ("kept_results",),
    """SELECT exported AS eventId, base AS event_id, risk_level,
         CASE WHEN n % 5 <> 0 THEN CAST(risk_score AS DOUBLE) END AS risk_score,
         CASE WHEN n % 11 <> 0 THEN 'rule-v2-baseline-v1' END AS rule_version, rule_codes
       FROM (SELECT *, CASE WHEN n % 2 = 0 THEN 'rp-' ELSE '' END || eventId AS exported,
               eventId AS base FROM kept_results
             UNION ALL
             SELECT *, 'other-' || eventId, 'other-' || eventId FROM kept_results
             WHERE n % 37 = 0)""",
)
_cte(
    "sim_rejects",
    ("sim_events",),
    """SELECT 'rp-' || eventId AS eventId, eventId AS event_id,
         CASE row_number % 3 WHEN 0 THEN 'HTTP_503' WHEN 1 THEN 'INVALID_AMOUNT'
           ELSE 'MISSING_FIELD:traceId' END AS reason
       FROM sim_events WHERE row_number % 17 = 0""",
)
_cte(
    "joined",
    ("sim_labels", "sim_results", "sim_rejects"),
    """SELECT coalesce(l.eventId, r.event_id) AS event_id, l.eventId IS NOT NULL AS has_label,
         r.event_id IS NOT NULL AS has_result,
         l.eventId IS NOT NULL AND x.event_id IS NOT NULL AS excluded,
         l.isFraud AS is_fraud, l.sourceType AS source_type, l.normalizedType AS normalized_type,
         r.risk_level, r.risk_score, r.rule_version, r.rule_codes
       FROM sim_labels l FULL JOIN sim_results r ON l.eventId = r.event_id
       LEFT JOIN (SELECT DISTINCT event_id FROM sim_rejects WHERE reason NOT LIKE 'HTTP%') x
         ON coalesce(l.eventId, r.event_id) = x.event_id""",
)
_RANK = "CASE {} WHEN 'LOW' THEN 0 WHEN 'MEDIUM' THEN 1 WHEN 'HIGH' THEN 2 ELSE 3 END"
_cte(
    "decided",
    ("joined",),
    f"""SELECT j.*, p.version, p.max_review, p.max_block,
          CASE WHEN has_result THEN CASE WHEN risk_score IS NOT NULL THEN risk_score >= p.medium
            ELSE {_RANK.format("risk_level")} >= p.positive END END AS predicted,
          CASE WHEN has_result THEN CASE
            WHEN risk_score IS NOT NULL THEN CASE WHEN risk_score >= p.high THEN 'BLOCK'
              WHEN risk_score >= p.medium THEN 'REVIEW' ELSE 'ALLOW' END
            WHEN {_RANK.format("risk_level")} >= p.block THEN 'BLOCK'
            WHEN {_RANK.format("risk_level")} >= p.positive THEN 'REVIEW'
            ELSE 'ALLOW' END END AS action
        FROM joined j, (VALUES ('threshold-v1', 50, 80, 1, 2, 0.3, 0.1),
                               ('threshold-strict-v1', 70, 90, 2, 3, 0.2, 0.05))
          p(version, medium, high, positive, block, max_review, max_block)""",
)


def matrix(include_missing: bool) -> str:
    inc = "true" if include_missing else "false"
    opened = "has_label AND NOT excluded"
    scored = f"{opened} AND has_result"
    miss = f"{opened} AND NOT has_result"

    def c(test: str) -> str:
        return f"count(*) FILTER (WHERE {test})"

    return f"""SELECT version AS threshold_version, {c("has_label")} AS totalLabels,
      {c("has_label AND is_fraud")} AS totalFraudLabels,
      {c("has_label AND NOT is_fraud")} AS totalNonFraudLabels,
      {c("has_result")} AS totalResults, {c("has_label AND has_result")} AS matchedResults,
      {c("NOT has_label AND has_result")} AS unmatchedResults,
      {c("excluded")} AS excludedReplayRejected, {c(miss)} AS missingResults,
      {c(miss + " AND is_fraud")} AS missingFraudLabels,
      {c(miss + " AND NOT is_fraud")} AS missingNonFraudLabels,
      {c(f"({scored}) OR ({miss} AND {inc})")} AS evaluatedEvents,
      {c(scored + " AND is_fraud AND predicted")} AS truePositive,
      {c(scored + " AND NOT is_fraud AND predicted")} AS falsePositive,
      {c(f"({scored} AND NOT is_fraud AND NOT predicted) OR ({miss} AND NOT is_fraud AND {inc})")}
        AS trueNegative,
      {c(f"({scored} AND is_fraud AND NOT predicted) OR ({miss} AND is_fraud AND {inc})")}
        AS falseNegative,
      {c(scored + " AND action IN ('REVIEW','BLOCK')")} AS reviewCandidateEvents,
      {c(scored + " AND action = 'BLOCK'")} AS blockedCandidateEvents,
      {c(scored + " AND risk_score IS NOT NULL")} AS resultsWithRiskScore,
      {c(scored + " AND risk_score IS NULL")} AS resultsWithoutRiskScore,
      {c(scored + " AND rule_version IS NOT NULL")} AS resultsWithRuleVersion,
      {c(scored + " AND rule_version IS NULL")} AS resultsWithoutRuleVersion,
      any_value(max_review) AS max_review, any_value(max_block) AS max_block
    FROM decided GROUP BY version"""


_cte("matrix", ("decided",), matrix(False))
_cte("matrix_missing", ("decided",), matrix(True))
_cte(
    "summary",
    ("matrix",),
    """SELECT *, 2 * precision * recall / nullif(precision + recall, 0) AS f1Score FROM (
         SELECT *, truePositive / nullif(truePositive + falsePositive, 0) AS precision,
           truePositive / nullif(truePositive + falseNegative, 0) AS recall,
           falsePositive / nullif(falsePositive + trueNegative, 0) AS falsePositiveRate,
           falseNegative / nullif(falseNegative + truePositive, 0) AS falseNegativeRate,
           (truePositive + trueNegative) / nullif(evaluatedEvents, 0) AS accuracy,
           reviewCandidateEvents / nullif(evaluatedEvents, 0) AS reviewCandidateRate,
           blockedCandidateEvents / nullif(evaluatedEvents, 0) AS blockedCandidateRate,
           resultsWithRiskScore / nullif(resultsWithRiskScore + resultsWithoutRiskScore, 0)
             AS riskScoreCoverageRate,
           resultsWithRuleVersion / nullif(resultsWithRuleVersion + resultsWithoutRuleVersion, 0)
             AS ruleVersionCoverageRate
         FROM matrix)""",
)


def _broken(name: str, every: int, value: str) -> str:
    return f"CASE WHEN row_number % {every} = 0 THEN {value} ELSE {name} END AS {name}"


_cte(
    "replay_input",
    ("sim_events",),
    f"""SELECT * REPLACE (
          CASE WHEN row_number % 149 = 0 THEN NULL ELSE nativeEventType END AS nativeEventType,
          CASE WHEN row_number % 149 = 0 THEN NULL ELSE normalizedEventType END
            AS normalizedEventType,
          CASE WHEN row_number % 149 = 0 THEN NULL ELSE typeSupportLevel END AS typeSupportLevel,
          CASE WHEN row_number % 149 = 0 THEN NULL ELSE typeMappingPolicyVersion END
            AS typeMappingPolicyVersion,
          CASE WHEN row_number % 149 = 0 AND row_number % 2 = 0 THEN 'REFUND' ELSE eventType END
            AS eventType)
        FROM (SELECT * REPLACE (
            CASE WHEN row_number % 83 = 0 THEN 'U-XYZ'
              WHEN row_number % 89 = 0 THEN 'seen with C123456 today' ELSE userId END AS userId,
            {_broken("eventId", 97, "''")},
            CASE WHEN row_number % 101 = 0 THEN '' WHEN row_number % 103 = 0 THEN NULL
              ELSE traceId END AS traceId,
            {_broken("typeMappingPolicyVersion", 107, "'old-v0'")},
            {_broken("nativeEventType", 109, "'DEBIT'")},
            {_broken("eventType", 113, "'DEPOSIT'")},
            {_broken("normalizedEventType", 127, "'PAYMENT'")},
            {_broken("typeSupportLevel", 131, "'unsupported'")},
            {_broken("currency", 137, "'USD'")},
            {_broken("eventTime", 139, "''")}),
          row_number % 151 = 0 AS labelled, row_number % 157 = 0 AS named,
          row_number % 163 = 0 AS received
        FROM sim_events)""",
)
_EXPECTED = """CASE nativeEventType WHEN 'CASH_OUT' THEN 'WITHDRAWAL' WHEN 'CASH_IN' THEN 'DEPOSIT'
  WHEN 'PAYMENT' THEN 'PAYMENT' WHEN 'TRANSFER' THEN 'TRANSFER' END"""
_LEVEL = """CASE WHEN nativeEventType IN ('CASH_OUT','CASH_IN') THEN 'replay-supported'
  WHEN nativeEventType IN ('PAYMENT','TRANSFER') THEN 'production-supported'
  ELSE 'unsupported' END"""
MAPPING_REASON = f"""CASE
  WHEN coalesce(nativeEventType, normalizedEventType, typeSupportLevel, typeMappingPolicyVersion)
    IS NULL THEN NULL
  WHEN typeMappingPolicyVersion IS DISTINCT FROM 'paysim-native-mapping-v1'
    THEN 'UNSUPPORTED_MAPPING_POLICY_VERSION:' || coalesce(typeMappingPolicyVersion, 'None')
  WHEN coalesce(nativeEventType, '') = '' THEN 'INVALID_NATIVE_EVENT_TYPE'
  WHEN {_EXPECTED} IS NULL THEN 'UNSUPPORTED_NATIVE_TYPE:' || nativeEventType
  WHEN eventType IS DISTINCT FROM {_EXPECTED}
    THEN 'NATIVE_MAPPING_MISMATCH:' || nativeEventType || '->' || eventType
  WHEN normalizedEventType IS DISTINCT FROM {_EXPECTED}
    THEN 'NORMALIZED_EVENT_TYPE_MISMATCH:' || nativeEventType
  WHEN typeSupportLevel IS DISTINCT FROM {_LEVEL}
    THEN 'TYPE_SUPPORT_LEVEL_MISMATCH:' || nativeEventType END"""
_cte(
    "replay_checked",
    ("replay_input",),
    f"""SELECT *, {MAPPING_REASON} AS mapping_reason, CASE
          WHEN regexp_matches(userId, '{RAW_ID}') THEN 'RAW_IDENTIFIER_VALUE'
          WHEN labelled THEN 'LABEL_FIELD:isFraud'
          WHEN named THEN 'RAW_IDENTIFIER_FIELD:nameOrig'
          WHEN traceId IS NULL THEN 'MISSING_FIELD:traceId'
          WHEN received THEN 'RECEIVED_AT_PRESENT'
          WHEN NOT regexp_matches(userId, '^U-[0-9a-f]{{16}}$') THEN 'INVALID_HASH_ID:userId'
          WHEN eventId = '' THEN 'INVALID_EVENT_ID'
          WHEN traceId = '' THEN 'INVALID_TRACE_ID'
          WHEN {MAPPING_REASON} IS NOT NULL THEN {MAPPING_REASON}
          WHEN eventType NOT IN {_TYPES}
            THEN 'UNSUPPORTED_EVENT_TYPE_FOR_CURRENT_API:' || eventType
          WHEN currency <> 'KRW' THEN 'INVALID_CURRENCY'
          WHEN CAST(amount AS DECIMAL(18,2)) <= 0 THEN 'INVALID_AMOUNT'
          WHEN eventTime = '' THEN 'INVALID_EVENT_TIME' END AS replay_reason
        FROM replay_input""",
)
_cte(
    "ds_events",
    ("replay_input",),
    """SELECT * FROM replay_input WHERE row_number % 173 <> 0 UNION ALL
       SELECT * FROM replay_input WHERE row_number % 173 <> 0 AND row_number % 167 = 0""",
)
_cte(
    "ds_labels",
    ("sim_labels",),
    """SELECT l.* REPLACE (CASE WHEN row_number % 181 = 0 THEN 'REFUND' ELSE sourceType END
         AS sourceType)
       FROM sim_labels l, (VALUES (0), (1)) v(c)
       WHERE row_number % 179 <> 0 AND (c = 0 OR row_number % 191 = 0)""",
)


def query(needs: tuple[str, ...], body: str) -> str:
    """SQL with the named views, and what they need, in front."""
    order: list[str] = []

    def visit(name: str) -> None:
        if name in order:
            return
        for inner in CTES[name][0]:
            visit(inner)
        order.append(name)

    for name in needs:
        visit(name)
    if not order:
        return body
    heads = ",\n".join(f"{name} AS ({CTES[name][1]})" for name in order)
    return f"WITH {heads}\n{body}"
