"""Data-contract checks: duplicates, references, versions, results, whole data sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerwatch.config import (
    BALANCE_FIELDS,
    CURRENCY,
    EVENT_REQUIRED_FIELDS,
    EVENT_TYPES,
    HASH_CHARS,
    HASH_ID_FIELDS,
    KNOWN_RULE_VERSIONS,
    LABEL_REQUIRED_FIELDS,
    MAX_REJECT_RATIO,
    NATIVE_TYPES,
    PAYSIM_SCHEMA_VERSION,
    PAYSIM_SOURCE,
    REJECT_REASONS,
    RISK_LEVELS,
    RULE_VERSION,
    UNSUPPORTED_PREFIX,
)
from ledgerwatch.functions.numbers import is_decimal_text, is_negative_text, ratio
from ledgerwatch.functions.times import is_utc_iso
from ledgerwatch.operators.leaks import leaf_checks
from ledgerwatch.operators.replay import (
    column_or_null,
    present,
    strip_event_id_prefix,
)


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys seen more than once, with ``n``. Counting combines on the map side, so a key with
    very many copies is one small row per task when it is shuffled."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")


def referential_check(events: DataFrame, labels: DataFrame) -> DataFrame:
    """(eventId, problem): ids with an event but no label, or a label but no event."""
    left = events.select("eventId", F.lit(True).alias("in_events")).distinct()
    right = labels.select("eventId", F.lit(True).alias("in_labels")).distinct()
    both = left.join(right, "eventId", "full")
    return both.filter("in_events IS NULL OR in_labels IS NULL").select(
        "eventId",
        F.when(F.col("in_events").isNull(), F.lit("LABEL_WITHOUT_EVENT"))
        .otherwise(F.lit("EVENT_WITHOUT_LABEL"))
        .alias("problem"),
    )


def _collect(df: DataFrame, checks: list[tuple[Column, str]], name: str) -> DataFrame:
    codes = F.array(*[F.when(test, F.lit(code)) for test, code in checks])
    return df.withColumn(name, F.array_distinct(F.array_compact(codes)))


def _absent(df: DataFrame, names: tuple[str, ...]) -> list[tuple[Column, str]]:
    return [(~present(df, n), f"MISSING_FIELD:{n}") for n in names]


def event_violations(events: DataFrame) -> DataFrame:
    """Add ``violations`` (array of codes) to prepared events; empty means sound."""

    def value(name: str) -> Column:
        return column_or_null(events, name)

    def not_equal(name: str, expected: str) -> Column:
        return ~value(name).eqNullSafe(F.lit(expected))

    checks = _absent(events, EVENT_REQUIRED_FIELDS)
    checks += leaf_checks(events.schema, forbid_labels=True, skip=("row_number",))
    for name in ("eventId", "traceId"):
        checks.append((value(name) == "", f"BLANK:{name}"))
    for name, letter in HASH_ID_FIELDS:
        shape = value(name).rlike(f"^{letter}-[0-9a-f]{{{HASH_CHARS}}}\\z")
        checks.append((value(name).isNotNull() & ~shape, f"HASH_FORMAT:{name}"))
    amount = value("amount").cast("string")
    checks += [
        (~value("eventType").isin(*EVENT_TYPES), "EVENT_TYPE"),
        (amount.isNotNull() & ~is_decimal_text(amount), "AMOUNT_FORMAT"),
        (is_negative_text(amount), "AMOUNT_NEGATIVE"),
        (not_equal("currency", CURRENCY), "CURRENCY"),
        (not_equal("source", PAYSIM_SOURCE), "SOURCE"),
        (not_equal("schemaVersion", PAYSIM_SCHEMA_VERSION), "SCHEMA_VERSION"),
        (present(events, "receivedAt"), "RECEIVED_AT_PRESENT"),
        (value("eventTime").isNotNull() & ~is_utc_iso(value("eventTime")), "EVENT_TIME"),
    ]
    if "balanceFeatures" in events.columns:
        balances = F.col("balanceFeatures")
        given = balances.isNotNull()
        step = balances["sourceStep"]
        checks.append((given & F.coalesce(step < 0, F.lit(True)), "SOURCE_STEP"))
        for name in BALANCE_FIELDS:
            checks.append((given & ~is_decimal_text(balances[name]), f"BALANCE:{name}"))
    return _collect(events, checks, "violations")


def label_violations(labels: DataFrame, strict: bool = True) -> DataFrame:
    """Add ``violations`` to label rows. ``strict`` also asks for the source fields."""
    required = LABEL_REQUIRED_FIELDS if strict else ("eventId", "isFraud")
    checks = _absent(labels, required)
    checks += leaf_checks(labels.schema, skip=("row_number",))
    checks.append((column_or_null(labels, "eventId") == "", "BLANK:eventId"))
    if strict:
        checks += [
            (column_or_null(labels, "sourceStep") < 0, "SOURCE_STEP"),
            (~column_or_null(labels, "sourceType").isin(*NATIVE_TYPES), "SOURCE_TYPE"),
        ]
    return _collect(labels, checks, "violations")


def reject_violations(rejected: DataFrame) -> DataFrame:
    """Add ``violations`` to reject records; unsupported native types are a known reason."""
    reason = F.col("reason")
    known = reason.isin(*REJECT_REASONS) | reason.startswith(UNSUPPORTED_PREFIX)
    checks = [(~present(rejected, n), f"MISSING_FIELD:{n}") for n in ("rowNumber", "reason")]
    checks += leaf_checks(rejected.schema)
    checks.append((reason.isNotNull() & ~known, "REJECT_REASON"))
    return _collect(rejected, checks, "violations")


def validate_dataset(
    events: DataFrame,
    labels: DataFrame,
    rejected: DataFrame,
    report: DataFrame | None = None,
    max_reject_ratio: str = MAX_REJECT_RATIO,
    fail_fast: bool = False,
) -> DataFrame:
    """(part, code, n): how often each rule is broken anywhere in the data set. No rows means
    it is sound. ``report`` is a prepare report row to reconcile against."""
    parts = [
        ("events", event_violations(events)),
        ("labels", label_violations(labels)),
        ("rejected", reject_violations(rejected)),
    ]
    found = None
    for part, checked in parts:
        counts = (
            checked.select(F.explode_outer("violations").alias("code"))
            .filter("code IS NOT NULL")
            .groupBy("code")
            .agg(F.count("*").alias("n"))
            .select(F.lit(part).alias("part"), "code", "n")
        )
        found = counts if found is None else found.unionByName(counts)
    for part, df, key in (
        ("events", events, "eventId"),
        ("events", events, "traceId"),
        ("labels", labels, "eventId"),
    ):
        repeated = duplicate_keys(df.filter(F.col(key).isNotNull()), [key]).agg(
            F.count("*").alias("n")
        )
        found = found.unionByName(
            repeated.filter("n > 0").select(
                F.lit(part).alias("part"), F.lit(f"DUPLICATE:{key}").alias("code"), "n"
            )
        )
    links = (
        referential_check(events, labels)
        .groupBy(F.col("problem").alias("code"))
        .agg(F.count("*").alias("n"))
        .select(F.lit("links").alias("part"), "code", "n")
    )
    found = found.unionByName(links)
    if report is not None:
        checks = validation_summary(events, labels, rejected, report, max_reject_ratio)
        found = found.unionByName(
            checks.filter("NOT ok").select(
                F.lit("report").alias("part"),
                F.col("check_name").alias("code"),
                F.lit(1).cast("long").alias("n"),
            )
        )
    if fail_fast:
        text = F.concat_ws(" ", "part", "code", F.col("n").cast("string"))
        found = found.filter(F.raise_error(text).cast("boolean"))
    return found


def dataset_counts(events: DataFrame, labels: DataFrame, rejected: DataFrame) -> DataFrame:
    """(item, n): row, fraud, flag and native-type counts, each table read once."""
    per_event = F.array(
        F.lit("events"),
        F.concat(F.lit("type:"), F.coalesce("nativeEventType", "eventType")),
    )
    per_label = F.array_compact(
        F.array(
            F.lit("labels"),
            F.when(F.col("isFraud"), F.lit("fraud")),
            F.when(F.col("sourceFlaggedFraud"), F.lit("flagged")),
        )
    )
    marks = (
        events.select(F.explode(per_event).alias("item"))
        .unionByName(labels.select(F.explode(per_label).alias("item")))
        .unionByName(rejected.select(F.lit("rejected").alias("item")))
    )
    return marks.groupBy("item").agg(F.count("*").alias("n"))


def validation_summary(
    events: DataFrame,
    labels: DataFrame,
    rejected: DataFrame,
    report: DataFrame,
    max_reject_ratio: str = MAX_REJECT_RATIO,
) -> DataFrame:
    """(check_name, expected, actual, ok): the counts of a prepare report against the data,
    plus the reject ratio against its limit."""
    counts = dataset_counts(events, labels, rejected)
    actual = counts.agg(
        *[
            F.coalesce(F.sum(F.when(F.col("item") == item, F.col("n"))), F.lit(0)).alias(name)
            for item, name in (
                ("events", "n_events"),
                ("labels", "n_labels"),
                ("rejected", "n_rejected"),
                ("fraud", "n_fraud"),
                ("flagged", "n_flagged"),
                *[(f"type:{t}", f"n_{t}") for t in NATIVE_TYPES],
            )
        ]
    )
    one = F.lit(1)
    row = report.withColumn("__one", one).join(actual.withColumn("__one", one), "__one")
    accepted, total = F.col("acceptedRows"), F.col("totalRows")

    def type_count(name: str) -> Column:
        return F.coalesce(F.try_element_at("eventTypeCounts", F.lit(name)), F.lit(0))

    type_sum = type_count(NATIVE_TYPES[0])
    for name in NATIVE_TYPES[1:]:
        type_sum = type_sum + type_count(name)
    pairs = [
        ("TOTAL_NOT_EMPTY", F.lit(True), total > 0),
        ("ACCEPTED_EVENTS", accepted, F.col("n_events")),
        ("ACCEPTED_LABELS", accepted, F.col("n_labels")),
        ("REJECTED_ROWS", F.col("rejectedRows"), F.col("n_rejected")),
        ("TOTAL_ROWS", total, accepted + F.col("rejectedRows")),
        ("FRAUD_ROWS", F.col("fraudRows"), F.col("n_fraud")),
        ("FLAGGED_ROWS", F.col("flaggedFraudRows"), F.col("n_flagged")),
        *[(f"TYPE_COUNT:{t}", type_count(t), F.col(f"n_{t}")) for t in NATIVE_TYPES],
        ("TYPE_SUM", accepted, type_sum),
    ]
    reject_ratio = ratio(F.col("rejectedRows"), total)
    rows = [
        F.struct(
            F.lit(name).alias("check_name"),
            expected.cast("string").alias("expected"),
            found.cast("string").alias("actual"),
            expected.eqNullSafe(found).alias("ok"),
        )
        for name, expected, found in pairs
    ]
    rows.append(
        F.struct(
            F.lit("REJECT_RATIO").alias("check_name"),
            F.lit(str(max_reject_ratio)).alias("expected"),
            F.round(reject_ratio, 6).cast("string").alias("actual"),
            F.coalesce(
                reject_ratio <= F.lit(float(max_reject_ratio)), F.lit(False)
            ).alias("ok"),
        )
    )
    return row.select(F.explode(F.array(*rows)).alias("check")).select("check.*")


def check_rule_version(results: DataFrame, expected: str = RULE_VERSION) -> DataFrame:
    """Results whose version is present but blank or not the expected one. No rows is good."""
    if expected not in KNOWN_RULE_VERSIONS:
        raise ValueError(f"unsupported ruleVersion: {expected}")
    version = F.col("ruleVersion")
    return results.filter(version.isNotNull() & (version != expected)).withColumn(
        "problem",
        F.when(version == "", F.lit("BLANK_RULE_VERSION")).otherwise(
            F.lit("RULE_VERSION_MISMATCH")
        ),
    )


def check_results(results: DataFrame, prefix: str | None = None) -> DataFrame:
    """(event_id, problem) for results with a blank id, an unknown level, a score outside
    0..100, a leak, or an id repeated after the replay prefix is removed."""
    score = F.col("riskScore")
    checks = [
        (F.coalesce(F.col("eventId"), F.lit("")) == "", "BLANK_EVENT_ID"),
        (~F.coalesce(F.col("riskLevel").isin(*RISK_LEVELS), F.lit(False)), "RISK_LEVEL"),
        ((score < 0) | (score > 100), "RISK_SCORE_RANGE"),
        *leaf_checks(results.schema, forbid_labels=True, forbid_report=True),
    ]
    checked = _collect(results, checks, "problems").select(
        strip_event_id_prefix(F.col("eventId"), prefix).alias("event_id"), "problems"
    )
    repeated = duplicate_keys(checked, ["event_id"])
    # An inner explode would have the planner test the array below the scan as well, with all
    # its checks written out a second time.
    broken = checked.select("event_id", F.explode_outer("problems").alias("problem"))
    return broken.filter("problem IS NOT NULL").unionByName(
        repeated.select("event_id", F.lit("DUPLICATE_RESULT").alias("problem"))
    )
