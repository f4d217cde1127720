"""Schemas of the stored tables and wire formats."""

from __future__ import annotations

from pyspark.sql import types as T

from ledgerwatch.config import PAYSIM_COLUMNS

# Wide enough that amounts are compared and summed as they came; what does not fit is refused
# by ``parse_guard``, never rounded.
AMOUNT = T.DecimalType(38, 12)
WINDOW_SUM = "decimal(38,12)"


def _struct(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(n, t, True) for n, t in fields])


_S, _L, _I, _B, _TS = (
    T.StringType(),
    T.LongType(),
    T.IntegerType(),
    T.BooleanType(),
    T.TimestampType(),
)

# Wire form of a transaction event: JSON names, times as ISO text.
TRANSACTION_JSON = _struct(
    ("schemaVersion", _S),
    ("eventId", _S),
    ("userId", _S),
    ("accountId", _S),
    ("eventType", _S),
    ("amount", AMOUNT),
    ("currency", _S),
    ("merchantId", _S),
    ("deviceId", _S),
    ("location", _S),
    ("eventTime", _S),
    ("receivedAt", _S),
    ("traceId", _S),
)

# The same event as a table row.
TRANSACTION = _struct(
    ("schema_version", _S),
    ("event_id", _S),
    ("user_id", _S),
    ("account_id", _S),
    ("event_type", _S),
    ("amount", AMOUNT),
    ("currency", _S),
    ("merchant_id", _S),
    ("device_id", _S),
    ("location", _S),
    ("event_time", _TS),
    ("received_at", _TS),
    ("trace_id", _S),
)

# (wire name, column name) in wire order.
TRANSACTION_NAMES = tuple(
    zip(TRANSACTION_JSON.fieldNames(), TRANSACTION.fieldNames(), strict=True)
)

SOURCE_POSITION = ("topic", "partition_no", "offset_no")

PROCESSING_LOG = _struct(
    ("event_id", _S),
    ("trace_id", _S),
    ("user_id", _S),
    ("topic", _S),
    ("partition_no", _I),
    ("offset_no", _L),
    ("consumer_group_id", _S),
    ("status", _S),
    ("received_at", _TS),
    ("processed_at", _TS),
)

FRAUD_RESULT = _struct(
    ("event_id", _S),
    ("trace_id", _S),
    ("user_id", _S),
    ("account_id", _S),
    ("event_time", _TS),
    ("received_at", _TS),
    ("risk_score", _I),
    ("risk_level", _S),
    ("decision", _S),
    ("matched_rules", T.ArrayType(_S)),
    ("skipped_rules", T.ArrayType(_S)),
    ("degraded", _B),
    ("reason", _S),
    ("rule_version", _S),
    ("detected_at", _TS),
)

DEAD_LETTER = _struct(
    ("event_id", _S),
    ("trace_id", _S),
    ("user_id", _S),
    ("source_topic", _S),
    ("source_partition", _I),
    ("source_offset", _L),
    ("dlt_topic", _S),
    ("failure_stage", _S),
    ("error_type", _S),
    ("error_message", _S),
    ("payload_json", _S),
    ("status", _S),
    ("reprocess_attempts", _I),
    ("last_reprocessed_at", _TS),
    ("discarded_at", _TS),
    ("discard_reason", _S),
    ("created_at", _TS),
    ("updated_at", _TS),
)

# Every field of a raw simulation row is text until it is checked.
PAYSIM_RAW = _struct(*[(name, _S) for name in PAYSIM_COLUMNS])

PAYSIM_EVENT = _struct(
    ("eventId", _S),
    ("userId", _S),
    ("accountId", _S),
    ("destinationAccountId", _S),
    ("eventType", _S),
    ("nativeEventType", _S),
    ("normalizedEventType", _S),
    ("typeSupportLevel", _S),
    ("typeMappingPolicyVersion", _S),
    ("amount", _S),
    ("currency", _S),
    ("eventTime", _S),
    ("traceId", _S),
    ("schemaVersion", _S),
    ("source", _S),
    (
        "balanceFeatures",
        _struct(
            ("sourceStep", _I),
            ("oldBalanceOrig", _S),
            ("newBalanceOrig", _S),
            ("oldBalanceDest", _S),
            ("newBalanceDest", _S),
        ),
    ),
)

PAYSIM_LABEL = _struct(
    ("eventId", _S),
    ("isFraud", _B),
    ("sourceFlaggedFraud", _B),
    ("sourceStep", _I),
    ("sourceType", _S),
    ("normalizedType", _S),
    ("typeSupportLevel", _S),
    ("typeMappingPolicyVersion", _S),
)

PAYSIM_REJECT = _struct(
    ("rowNumber", _L), ("reason", _S), ("rawType", _S), ("message", _S)
)

DETECTION_RESULT = _struct(
    ("eventId", _S),
    ("riskLevel", _S),
    ("riskScore", T.DoubleType()),
    ("ruleVersion", _S),
    ("ruleCodes", T.ArrayType(_S)),
    ("matchedRules", _S),
)
