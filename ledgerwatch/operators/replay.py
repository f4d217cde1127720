"""Pre-send checks of prepared events, and what a replay would send."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerwatch.config import (
    CURRENCY,
    EVENT_TYPES,
    HASH_CHARS,
    HASH_ID_FIELDS,
    MAPPING_FIELDS,
    MAPPING_VERSION,
    PAYSIM_SCHEMA_VERSION,
    PAYSIM_SOURCE,
    REPLAY_REQUIRED_FIELDS,
    REQUEST_FIELDS,
    UNSUPPORTED_PREFIX,
)
from ledgerwatch.functions.numbers import (
    is_decimal_text,
    is_negative_text,
    is_zero_text,
)
from ledgerwatch.functions.text import any_of, first_reason, joined
from ledgerwatch.operators.leaks import leaf_checks
from ledgerwatch.operators.typemap import map_native_type

KEYS = "__keys"
API_TYPE_PREFIX = "UNSUPPORTED_EVENT_TYPE_FOR_CURRENT_API:"


def events_from_json(
    df: DataFrame, schema: T.StructType, payload: str = "value"
) -> DataFrame:
    """Parse JSON texts to event columns and keep which top-level keys each one has, so that
    an absent field and a JSON null stay different."""
    return df.select(
        *[c for c in df.columns if c != payload],
        F.from_json(F.col(payload), schema).alias("__event"),
        F.json_object_keys(F.col(payload)).alias(KEYS),
    ).select("*", "__event.*").drop("__event")


def present(df: DataFrame, name: str) -> Column:
    """The event has this field. Without recorded keys, NULL means absent."""
    if KEYS in df.columns:
        return F.coalesce(F.array_contains(F.col(KEYS), name), F.lit(False))
    if name not in df.columns:
        return F.lit(False)
    return F.col(f"`{name}`").isNotNull()


def column_or_null(df: DataFrame, name: str) -> Column:
    return F.col(f"`{name}`") if name in df.columns else F.lit(None).cast("string")


def has_mapping_metadata(df: DataFrame) -> Column:
    return any_of([present(df, name) for name in MAPPING_FIELDS])


def mapping_checks(df: DataFrame) -> list[tuple[Column, Column | str]]:
    """Checks of the type-mapping fields; ``df`` must already carry the mapping of its
    native type. They apply only when any mapping field is there."""
    applies = has_mapping_metadata(df)
    version = column_or_null(df, "typeMappingPolicyVersion")
    native = column_or_null(df, "nativeEventType")
    event_type = column_or_null(df, "eventType")
    expected = F.col("normalized_type")

    def differs(value: Column, other: Column) -> Column:
        return ~value.eqNullSafe(other)

    def text(value: Column) -> Column:
        return F.coalesce(value, F.lit("None"))

    return [
        (
            applies & differs(version, F.lit(MAPPING_VERSION)),
            F.concat(F.lit("UNSUPPORTED_MAPPING_POLICY_VERSION:"), text(version)),
        ),
        (applies & (F.coalesce(native, F.lit("")) == ""), "INVALID_NATIVE_EVENT_TYPE"),
        (applies & expected.isNull(), F.col("excluded_reason")),
        (
            applies & differs(event_type, expected),
            F.concat(F.lit("NATIVE_MAPPING_MISMATCH:"), native, F.lit("->"), text(event_type)),
        ),
        (
            applies & differs(column_or_null(df, "normalizedEventType"), expected),
            F.concat(F.lit("NORMALIZED_EVENT_TYPE_MISMATCH:"), native),
        ),
        (
            applies
            & differs(column_or_null(df, "typeSupportLevel"), F.col("support_level")),
            F.concat(F.lit("TYPE_SUPPORT_LEVEL_MISMATCH:"), native),
        ),
    ]


def validate_native_mapping(df: DataFrame) -> DataFrame:
    """Add ``mapping_reason``: the first broken mapping check, NULL when there is none."""
    columns = df.columns
    mapped = map_native_type(df, "nativeEventType")
    return mapped.select(
        *columns, first_reason(*mapping_checks(mapped)).alias("mapping_reason")
    )


def validate_replay(df: DataFrame, type_policy: str = "current-api") -> DataFrame:
    """Add ``replay_reason``: why the event would not be sent, NULL when it would.

    The first failing check wins. ``type_policy="preserve"`` leaves out the check that the
    API knows the event type.
    """
    if type_policy not in ("current-api", "preserve"):
        raise ValueError(f"unknown type policy: {type_policy}")
    columns = df.columns
    if "nativeEventType" not in columns:
        df = df.withColumn("nativeEventType", F.lit(None).cast("string"))
    mapped = map_native_type(df, "nativeEventType")
    internal = ("row_number", KEYS)
    source = T.StructType(
        [f for f in df.schema.fields if f.name in columns and f.name not in internal]
    )
    checks: list[tuple[Column, Column | str]] = list(
        leaf_checks(source, forbid_labels=True)
    )

    missing = [(~present(df, name), name) for name in REPLAY_REQUIRED_FIELDS]
    missing_text = joined(",", missing)
    checks.append(
        (missing_text != "", F.concat(F.lit("MISSING_FIELD:"), missing_text))
    )
    checks.append((present(df, "receivedAt"), "RECEIVED_AT_PRESENT"))
    for name, letter in HASH_ID_FIELDS:
        shape = column_or_null(df, name).rlike(f"^{letter}-[0-9a-f]{{{HASH_CHARS}}}\\z")
        checks.append((~F.coalesce(shape, F.lit(False)), f"INVALID_HASH_ID:{name}"))
    for name, reason in (
        ("eventId", "INVALID_EVENT_ID"),
        ("traceId", "INVALID_TRACE_ID"),
        ("eventType", "INVALID_EVENT_TYPE"),
    ):
        checks.append((F.coalesce(column_or_null(df, name), F.lit("")) == "", reason))
    checks += mapping_checks(mapped)
    if type_policy == "current-api":
        event_type = column_or_null(df, "eventType")
        checks.append(
            (
                ~event_type.isin(*EVENT_TYPES),
                F.concat(F.lit(API_TYPE_PREFIX), event_type),
            )
        )
    amount = column_or_null(df, "amount").cast("string")
    checks += [
        (~column_or_null(df, "currency").eqNullSafe(F.lit(CURRENCY)), "INVALID_CURRENCY"),
        (
            ~is_decimal_text(amount) | is_negative_text(amount) | is_zero_text(amount),
            "INVALID_AMOUNT",
        ),
        (
            F.coalesce(column_or_null(df, "eventTime"), F.lit("")) == "",
            "INVALID_EVENT_TIME",
        ),
    ]
    return mapped.select(*columns, first_reason(*checks).alias("replay_reason"))


def prefix_event_id(event_id: Column, prefix: str | None) -> Column:
    return F.concat(F.lit(f"{prefix}-"), event_id) if prefix else event_id


def strip_event_id_prefix(event_id: Column, prefix: str | None) -> Column:
    if not prefix:
        return event_id
    mark = f"{prefix}-"
    return F.when(
        event_id.startswith(mark), F.substr(event_id, F.lit(len(mark) + 1))
    ).otherwise(event_id)


def to_replay_request(
    accepted: DataFrame, prefix: str | None = None, *beside: str
) -> DataFrame:
    """The request columns of accepted events, the trace id and the columns ``beside`` them."""
    kept = [c for c in REQUEST_FIELDS if c in accepted.columns and c != "eventId"]
    return accepted.select(
        prefix_event_id(F.col("eventId"), prefix).alias("eventId"),
        *kept,
        "traceId",
        *beside,
    )


def dropped_field_counts(accepted: DataFrame) -> DataFrame:
    """(field, n) of every field of accepted events that a request does not carry.

    One aggregation over all columns, then an unpivot of its single row.
    """
    skip = (*REQUEST_FIELDS, "traceId", "row_number", "replay_reason", KEYS)
    names = [c for c in accepted.columns if c not in skip]
    if not names:
        return accepted.sparkSession.createDataFrame([], "field string, n long")
    if KEYS in accepted.columns:
        return (
            accepted.select(F.explode(KEYS).alias("field"))
            .filter(~F.col("field").isin(*skip))
            .groupBy("field")
            .agg(F.count("*").alias("n"))
        )
    one = accepted.agg(*[F.count(F.col(f"`{c}`")).alias(c) for c in names])
    pairs = ", ".join(f"'{c}', `{c}`" for c in names)
    return one.select(F.expr(f"stack({len(names)}, {pairs}) AS (field, n)")).filter("n > 0")


def replay_counts(tagged: DataFrame) -> DataFrame:
    """(section, item, n): every count of the replay report, from one aggregation.

    ``tagged`` is the output of ``validate_replay``. Each event contributes a handful of
    (section, item) marks which are combined on the map side.
    """
    accepted = F.col("replay_reason").isNull()
    native = F.coalesce(column_or_null(tagged, "nativeEventType"), F.col("eventType"))
    normal = F.coalesce(column_or_null(tagged, "normalizedEventType"), F.col("eventType"))
    support = column_or_null(tagged, "typeSupportLevel")
    version = column_or_null(tagged, "typeMappingPolicyVersion")
    reason = F.col("replay_reason")
    is_paysim = (column_or_null(tagged, "source") == PAYSIM_SOURCE) | (
        column_or_null(tagged, "schemaVersion") == PAYSIM_SCHEMA_VERSION
    )
    excluded = F.when(
        reason.startswith(API_TYPE_PREFIX) | reason.startswith(UNSUPPORTED_PREFIX),
        F.regexp_replace(reason, "^[^:]*:", ""),
    )

    def mark(section: str, item: Column, when: Column | None = None) -> Column:
        ok = item.isNotNull() & (item != "")
        ok = ok if when is None else ok & when
        return F.when(ok, F.struct(F.lit(section).alias("section"), item.alias("item")))

    everything = F.lit("rows")
    marks = [
        mark("totalRead", everything),
        mark("payloadAccepted", everything, accepted),
        mark("payloadRejected", everything, ~accepted),
        mark(
            "missingMappingMetadata",
            everything,
            F.coalesce(is_paysim, F.lit(False)) & ~has_mapping_metadata(tagged),
        ),
        mark("mappingPolicyVersions", version),
        mark("excludedByType", excluded),
    ]
    for name, value in (
        ("NativeTypeDistribution", native),
        ("NormalizedTypeDistribution", normal),
        ("TypeSupportLevelDistribution", support),
    ):
        marks += [
            mark(f"input{name}", value),
            mark(f"accepted{name}", value, accepted),
            mark(f"rejected{name}", value, ~accepted),
        ]
    return (
        tagged.select(F.explode(F.array(*marks)).alias("mark"))
        .filter("mark IS NOT NULL")
        .groupBy("mark.section", "mark.item")
        .agg(F.count("*").alias("n"))
    )


def replay_report(tagged: DataFrame, prefix: str | None = None) -> DataFrame:
    """One row: totals as numbers, distributions as maps, dropped fields, policy."""
    counts = replay_counts(tagged).unionByName(
        dropped_field_counts(tagged.filter("replay_reason IS NULL")).select(
            F.lit("droppedFields").alias("section"), F.col("field").alias("item"), "n"
        )
    )

    def total(name: str) -> Column:
        return F.coalesce(F.sum(F.when(F.col("section") == name, F.col("n"))), F.lit(0))

    def spread(name: str) -> Column:
        entry = F.when(F.col("section") == name, F.struct("item", "n"))
        return F.map_from_entries(F.array_sort(F.collect_list(entry)))

    totals = (
        "totalRead",
        "payloadAccepted",
        "payloadRejected",
        "missingMappingMetadata",
    )
    maps = [
        "mappingPolicyVersions",
        "excludedByType",
        "droppedFields",
        *[
            f"{scope}{name}"
            for scope in ("input", "accepted", "rejected")
            for name in (
                "NativeTypeDistribution",
                "NormalizedTypeDistribution",
                "TypeSupportLevelDistribution",
            )
        ],
    ]
    return counts.agg(
        *[total(n).alias(n) for n in totals], *[spread(n).alias(n) for n in maps]
    ).select(
        F.lit(MAPPING_VERSION).alias("mappingPolicyVersion"),
        F.lit(prefix).cast("string").alias("eventIdPrefix"),
        "*",
    )
