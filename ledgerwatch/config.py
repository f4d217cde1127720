"""Fixed values of the data contract and the policies built on them.

Everything here is a constant that stored data depends on: enum members, scores, thresholds,
reject reasons, formats. They are stated as plain values, in their natural order.
"""

from __future__ import annotations

from dataclasses import dataclass

# Transaction contract.
EVENT_TYPES = ("PAYMENT", "TRANSFER", "WITHDRAWAL", "DEPOSIT")
CURRENCY = "KRW"
SCHEMA_VERSION = "v1"
MAX_FUTURE_MINUTES = 5
SUSPICIOUS_LOCATIONS = ("UNKNOWN", "FOREIGN", "HIGH_RISK")
TRANSACTION_TOPIC = "transaction-events"
DEAD_LETTER_TOPIC = "transaction-events-dlt"

# Detection.
RULE_VERSION = "rule-v2-baseline-v1"
KNOWN_RULE_VERSIONS = (RULE_VERSION,)
WINDOW_MS = 5 * 60 * 1000
STATE_TTL_MS = 10 * 60 * 1000
RAPID_COUNT = 5
WINDOW_AMOUNT = 3_000_000
DEGRADED_REASON = "Redis sliding window unavailable"
RISK_LEVELS = ("LOW", "MEDIUM", "HIGH", "CRITICAL")

# Dead letters.
MAX_MESSAGE_CHARS = 500
MAX_ACTOR_CHARS = 100
MAX_REPROCESS_ATTEMPTS = 3
RETRYABLE_STATUSES = ("PENDING", "REPROCESS_FAILED")
DEFAULT_ACTOR = "admin-api"
AUDIT_TARGET_TYPE = "DLT_EVENT"

# Simulation data set.
PAYSIM_COLUMNS = (
    "step",
    "type",
    "amount",
    "nameOrig",
    "oldbalanceOrg",
    "newbalanceOrig",
    "nameDest",
    "oldbalanceDest",
    "newbalanceDest",
    "isFraud",
    "isFlaggedFraud",
)
NATIVE_TYPES = ("CASH_IN", "CASH_OUT", "DEBIT", "PAYMENT", "TRANSFER")
BASE_TIME = "2026-01-01T00:00:00Z"
DATASET_SLUG = "ealaxi/paysim1"
RAW_FILE_NAME = "PS_20174392719_1491204439457_log.csv"
PAYSIM_SCHEMA_VERSION = "v2-paysim"
PAYSIM_SOURCE = "PAYSIM"
HASH_ALGORITHM = "HMAC-SHA256"
HASH_CHARS = 16
SALT_ENV = "PAYSIM_HASH_SALT"
LOCAL_SALT = "local-dev-paysim-salt"
MAPPING_VERSION = "paysim-native-mapping-v1"
MAX_REJECT_RATIO = "0.01"
MAX_SAMPLE_ROWS = 1000
EVIDENCE_IDS = 10
FAILURE_ROWS = 50

# Native type -> (normalized type, support level, denominator, excluded reason,
# semantic loss risk).
TYPE_MAPPING = (
    ("PAYMENT", "PAYMENT", "production-supported", "included", None, "low"),
    ("TRANSFER", "TRANSFER", "production-supported", "included", None, "low"),
    ("CASH_OUT", "WITHDRAWAL", "replay-supported", "included", None, "high"),
    ("CASH_IN", "DEPOSIT", "replay-supported", "included", None, "medium"),
    ("DEBIT", None, "unsupported", "excluded", "UNSUPPORTED_NATIVE_TYPE:DEBIT", "high"),
)

# Leak rules.
RAW_ID_FIELDS = ("nameOrig", "nameDest")
LABEL_FIELDS = ("isFraud", "isFlaggedFraud", "sourceFlaggedFraud")
REPORT_FORBIDDEN_FIELDS = (
    "requestBody",
    "responseBody",
    "token",
    "authToken",
    "authorization",
)
SALT_FIELDS = ("hashSaltValue", "saltValue", "salt", "rawSalt")
SALT_SOURCE_FIELD = "hashSaltSource"
HASH_ID_FIELDS = (("userId", "U"), ("accountId", "A"), ("destinationAccountId", "D"))
# A customer or merchant number as a whole word, Unicode-aware on both sides. Written without
# \b so that the same text means the same thing to every regular-expression engine.
RAW_ID_PATTERN = r"(?:^|[^\p{L}\p{N}_])[CM]\p{Nd}{3,}(?:\z|[^\p{L}\p{N}_])"

# Replay contract.
REPLAY_REQUIRED_FIELDS = (
    "accountId",
    "amount",
    "currency",
    "destinationAccountId",
    "eventId",
    "eventTime",
    "eventType",
    "traceId",
    "userId",
)
REQUEST_FIELDS = (
    "eventId",
    "userId",
    "accountId",
    "eventType",
    "amount",
    "currency",
    "merchantId",
    "deviceId",
    "location",
    "eventTime",
)
MAPPING_FIELDS = (
    "nativeEventType",
    "normalizedEventType",
    "typeSupportLevel",
    "typeMappingPolicyVersion",
)
REPLAY_REJECT_PREFIXES = (
    "UNSUPPORTED_EVENT_TYPE_FOR_CURRENT_API",
    "LABEL_FIELD",
    "RAW_IDENTIFIER_FIELD",
    "RAW_IDENTIFIER_VALUE",
    "RECEIVED_AT_PRESENT",
    "MISSING_FIELD",
    "INVALID_HASH_ID",
    "INVALID_EVENT_ID",
    "INVALID_TRACE_ID",
    "INVALID_EVENT_TYPE",
    "INVALID_NATIVE_EVENT_TYPE",
    "UNSUPPORTED_NATIVE_TYPE",
    "UNSUPPORTED_MAPPING_POLICY_VERSION",
    "NATIVE_MAPPING_MISMATCH",
    "NORMALIZED_EVENT_TYPE_MISMATCH",
    "TYPE_SUPPORT_LEVEL_MISMATCH",
    "INVALID_CURRENCY",
    "INVALID_AMOUNT",
    "INVALID_EVENT_TIME",
)

# Dataset validation.
EVENT_REQUIRED_FIELDS = (
    "accountId",
    "amount",
    "balanceFeatures",
    "currency",
    "destinationAccountId",
    "eventId",
    "eventTime",
    "eventType",
    "schemaVersion",
    "source",
    "traceId",
    "userId",
)
BALANCE_FIELDS = (
    "oldBalanceOrig",
    "newBalanceOrig",
    "oldBalanceDest",
    "newBalanceDest",
)
LABEL_REQUIRED_FIELDS = (
    "eventId",
    "isFraud",
    "sourceFlaggedFraud",
    "sourceStep",
    "sourceType",
)
REJECT_REASONS = (
    "MISSING_REQUIRED_COLUMN",
    "INVALID_STEP",
    "INVALID_TYPE",
    "INVALID_AMOUNT",
    "INVALID_BALANCE",
    "INVALID_LABEL",
    "UNSUPPORTED_ROW",
)
UNSUPPORTED_PREFIX = "UNSUPPORTED_NATIVE_TYPE:"

# Evaluation contract.
EVALUATION_CONTRACT_VERSION = "v2-phase9-evaluation-contract-v1"
EVALUATION_POLICY_VERSION = "evaluation-policy-v1"
DEFAULT_THRESHOLD_VERSION = "threshold-v1"


@dataclass(frozen=True)
class ThresholdPolicy:
    """Score thresholds, level fallbacks and workload budget of one threshold version."""

    version: str
    medium: int
    high: int
    positive_level: str
    review_levels: tuple[str, ...]
    block_levels: tuple[str, ...]
    max_review_rate: float
    max_block_rate: float


# Threshold policies.
THRESHOLD_POLICIES = {
    "threshold-v1": ThresholdPolicy(
        "threshold-v1",
        50,
        80,
        "MEDIUM",
        ("MEDIUM", "HIGH", "CRITICAL"),
        ("HIGH", "CRITICAL"),
        0.30,
        0.10,
    ),
    "threshold-strict-v1": ThresholdPolicy(
        "threshold-strict-v1",
        70,
        90,
        "HIGH",
        ("HIGH", "CRITICAL"),
        ("CRITICAL",),
        0.20,
        0.05,
    ),
}

# Follow-up actions per risk level (CRITICAL has two).
ACTION_POLICY = (
    ("LOW", "NO_ACTION", "APPLIED"),
    ("MEDIUM", "REVIEW_CANDIDATE", "PENDING"),
    ("HIGH", "HOLD_TRANSACTION_CANDIDATE", "REQUIRES_MANUAL_REVIEW"),
    ("CRITICAL", "BLOCK_TRANSACTION_CANDIDATE", "REQUIRES_MANUAL_APPROVAL"),
    ("CRITICAL", "ACCOUNT_RISK_FLAG", "PENDING"),
)
CASE_LEVELS = ("HIGH", "CRITICAL")

# Service targets, (metric, comparison, target).
SLO_TARGETS = (
    ("api_p95_ms", "<=", 300.0),
    ("api_p99_ms", "<=", 800.0),
    ("publish_success_rate", ">=", 0.995),
    ("processing_p95_ms", "<=", 1000.0),
    ("detection_p95_ms", "<=", 2000.0),
    ("lag_recovery_ms", "<=", 180000.0),
    ("dlq_loss", "<=", 0.0),
    ("duplicate_results", "<=", 0.0),
)


def threshold_policy(version: str) -> ThresholdPolicy:
    if version not in THRESHOLD_POLICIES:
        raise ValueError(f"unsupported thresholdVersion: {version}")
    return THRESHOLD_POLICIES[version]
