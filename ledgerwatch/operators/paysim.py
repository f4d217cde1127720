"""Normalize raw simulation rows into events, labels and rejects."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerwatch.config import (
    BASE_TIME,
    CURRENCY,
    LOCAL_SALT,
    MAPPING_VERSION,
    NATIVE_TYPES,
    PAYSIM_SCHEMA_VERSION,
    PAYSIM_SOURCE,
)
from ledgerwatch.functions.digest import pseudonym
from ledgerwatch.functions.numbers import (
    is_decimal_text,
    is_negative_text,
    plain_decimal,
    strict_flag,
    strict_int,
)
from ledgerwatch.functions.text import first_reason, is_blank
from ledgerwatch.functions.times import iso_seconds
from ledgerwatch.operators.typemap import map_native_type
from ledgerwatch.schemas import AMOUNT

# (raw column, output field)
BALANCES = (
    ("oldbalanceOrg", "oldBalanceOrig"),
    ("newbalanceOrig", "newBalanceOrig"),
    ("oldbalanceDest", "oldBalanceDest"),
    ("newbalanceDest", "newBalanceDest"),
)


@dataclass(frozen=True)
class Prepared:
    """Three filters of one tagged plan, each built when it is first asked for."""

    tagged: DataFrame
    base_time: str = BASE_TIME
    salt: str = LOCAL_SALT

    @cached_property
    def events(self) -> DataFrame:
        return events_of(self.tagged, self.base_time, self.salt)

    @cached_property
    def labels(self) -> DataFrame:
        return labels_of(self.tagged)

    @cached_property
    def rejected(self) -> DataFrame:
        return rejects_of(self.tagged)

    @cached_property
    def lines(self) -> DataFrame:
        return lines_of(self.tagged, self.base_time, self.salt)


def _checks() -> list[tuple[Column, Column | str, Column | str]]:
    """(failed, reason, message), in order; the first failure wins."""
    native = F.col("type")
    step = strict_int(F.col("step"))
    checks: list[tuple[Column, Column | str, Column | str]] = [
        (step.isNull(), "INVALID_STEP", "step must be an integer"),
        (is_negative_text(F.col("step")), "INVALID_STEP", "step must be >= 0"),
        (
            ~F.coalesce(native.isin(*NATIVE_TYPES), F.lit(False)),
            "INVALID_TYPE",
            "type is not supported",
        ),
        (
            F.col("normalized_type").isNull(),
            F.col("excluded_reason"),
            "native type is not supported by replay mapping policy",
        ),
        (
            ~is_decimal_text(F.col("amount")),
            "INVALID_AMOUNT",
            "amount must be a finite decimal",
        ),
        (is_negative_text(F.col("amount")), "INVALID_AMOUNT", "amount must be >= 0"),
    ]
    for raw, _ in BALANCES:
        checks.append(
            (
                ~is_decimal_text(F.col(raw)),
                "INVALID_BALANCE",
                f"{raw} must be a finite decimal",
            )
        )
    checks.append(
        (
            is_blank(F.col("nameOrig")) | is_blank(F.col("nameDest")),
            "UNSUPPORTED_ROW",
            "nameOrig and nameDest must not be blank",
        )
    )
    for raw in ("isFraud", "isFlaggedFraud"):
        checks.append(
            (strict_flag(F.col(raw)).isNull(), "INVALID_LABEL", f"{raw} must be 0 or 1")
        )
    return checks


def normalize_paysim(raw: DataFrame, fail_fast: bool = False) -> DataFrame:
    """Tagged plan: the raw row (with ``row_number``), its type mapping, and
    ``reject_position`` / ``reject_reason`` / ``reject_message``, all NULL for an acceptable
    row. ``fail_fast`` fails the job on a rejected row instead of keeping it.

    The checks are one CASE that yields the position of the first failure; reason and message
    are looked up by it, so each row is checked once.
    """
    mapped = map_native_type(raw, "type")
    checks = _checks()
    fault = first_reason(*[(f, F.lit(i)) for i, (f, _, _) in enumerate(checks, start=1)])
    reasons = F.array(*[_as_column(r) for _, r, _ in checks])
    messages = F.array(*[_as_column(m) for _, _, m in checks])
    position = F.col("reject_position")
    tagged = mapped.withColumn("reject_position", fault).withColumns(
        {
            "reject_reason": F.get(reasons, position - 1),
            "reject_message": F.get(messages, position - 1),
        }
    )
    if fail_fast:
        message = F.concat_ws(
            ": ",
            F.concat(F.lit("row "), F.col("row_number").cast("string")),
            F.col("reject_reason"),
            F.col("reject_message"),
        )
        tagged = tagged.filter(
            F.when(F.col("reject_reason").isNull(), F.lit(True)).otherwise(
                F.raise_error(message).cast("boolean")
            )
        )
    return tagged


def _as_column(value: Column | str) -> Column:
    return F.lit(value) if isinstance(value, str) else value


def _sequence() -> Column:
    number = F.col("row_number").cast("string")
    return F.when(F.length(number) >= 9, number).otherwise(F.lpad(number, 9, "0"))


def _event_columns(base_time: str) -> list[Column]:
    """Of an acceptable row with its pseudonyms."""
    step = strict_int(F.col("step"))
    event_time = F.timestamp_add("HOUR", step, F.to_timestamp(F.lit(base_time)))
    normalized = F.col("normalized_type")
    return [
        F.concat(F.lit("paysim-"), _sequence()).alias("eventId"),
        F.concat(F.lit("U-"), F.col("__origin")).alias("userId"),
        F.concat(F.lit("A-"), F.col("__origin")).alias("accountId"),
        F.concat(F.lit("D-"), F.col("__destination")).alias("destinationAccountId"),
        normalized.alias("eventType"),
        F.col("type").alias("nativeEventType"),
        normalized.alias("normalizedEventType"),
        F.col("support_level").alias("typeSupportLevel"),
        F.lit(MAPPING_VERSION).alias("typeMappingPolicyVersion"),
        plain_decimal(F.col("amount")).alias("amount"),
        F.lit(CURRENCY).alias("currency"),
        iso_seconds(event_time).alias("eventTime"),
        F.concat(F.lit("trace-paysim-"), _sequence()).alias("traceId"),
        F.lit(PAYSIM_SCHEMA_VERSION).alias("schemaVersion"),
        F.lit(PAYSIM_SOURCE).alias("source"),
        F.struct(
            step.alias("sourceStep"),
            *[plain_decimal(F.col(rawname)).alias(out) for rawname, out in BALANCES],
        ).alias("balanceFeatures"),
    ]


def _label_columns() -> list[Column]:
    return [
        F.concat(F.lit("paysim-"), _sequence()).alias("eventId"),
        strict_flag(F.col("isFraud")).alias("isFraud"),
        strict_flag(F.col("isFlaggedFraud")).alias("sourceFlaggedFraud"),
        strict_int(F.col("step")).alias("sourceStep"),
        F.col("type").alias("sourceType"),
        F.col("normalized_type").alias("normalizedType"),
        F.col("support_level").alias("typeSupportLevel"),
        F.lit(MAPPING_VERSION).alias("typeMappingPolicyVersion"),
    ]


def _reject_columns() -> list[Column]:
    return [
        F.col("row_number").alias("rowNumber"),
        F.col("reject_reason").alias("reason"),
        F.col("type").alias("rawType"),
        F.col("reject_message").alias("message"),
    ]


def _pseudonyms(salt: str) -> list[Column]:
    return [
        pseudonym(F.col("nameOrig"), salt).alias("__origin"),
        pseudonym(F.col("nameDest"), salt).alias("__destination"),
    ]


def events_of(
    tagged: DataFrame, base_time: str = BASE_TIME, salt: str = LOCAL_SALT
) -> DataFrame:
    """Events of the acceptable rows. Names only leave as keyed pseudonyms."""
    good = tagged.filter(F.col("reject_position").isNull()).select("*", *_pseudonyms(salt))
    return good.select("row_number", *_event_columns(base_time))


def labels_of(tagged: DataFrame) -> DataFrame:
    """Label sidecar of the acceptable rows."""
    good = tagged.filter(F.col("reject_position").isNull())
    return good.select("row_number", *_label_columns())


def rejects_of(tagged: DataFrame) -> DataFrame:
    """Reject records. They never carry raw identifiers."""
    return tagged.filter(F.col("reject_position").isNotNull()).select(*_reject_columns())


def lines_of(
    tagged: DataFrame, base_time: str = BASE_TIME, salt: str = LOCAL_SALT
) -> DataFrame:
    """(kind, value): all three outputs as JSON lines, from one pass over the tagged rows. An
    acceptable row gives a line of ``events`` and one of ``labels``, another row a line of
    ``rejected``."""

    def line(kind: str, columns: list[Column]) -> Column:
        value = F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})
        return F.struct(F.lit(kind).alias("kind"), value.alias("value"))

    good = F.col("reject_position").isNull()
    accepted = F.array(line("events", _event_columns(base_time)), line("labels", _label_columns()))
    rejected = F.array(line("rejected", _reject_columns()))
    named = tagged.select("*", *[F.when(good, p).alias(n) for p, n in zip(
        _pseudonyms(salt), ("__origin", "__destination"), strict=True
    )])
    # Outer, as the planner would test an inner one's array a second time below it.
    lines = named.select(F.explode_outer(F.when(good, accepted).otherwise(rejected)).alias("line"))
    return lines.select("line.kind", "line.value")


def scoring_columns(events: DataFrame) -> DataFrame:
    """Typed inputs of the balance rules, taken from prepared events. Amounts hold 26 whole
    digits and twelve decimals; larger ones count as 10^25, which no threshold tells apart.

    Kept short: the planner copies these expressions into every rule that reads them."""

    def exact(value: str) -> Column:
        text = F.col(value)
        huge = F.signum(text.try_cast("double")) * 1e25
        return F.coalesce(text.try_cast(AMOUNT), huge.try_cast(AMOUNT))

    return events.select(
        F.col("eventId").alias("event_id"),
        F.col("userId").alias("user_id"),
        F.col("nativeEventType").alias("native_type"),
        exact("amount").alias("amount"),
        exact("balanceFeatures.oldBalanceOrig").alias("old_balance"),
        exact("balanceFeatures.newBalanceOrig").alias("new_balance"),
        F.try_to_timestamp("eventTime").alias("event_time"),
    )
