"""Report of a preparation run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerwatch.config import (
    BASE_TIME,
    DATASET_SLUG,
    HASH_ALGORITHM,
    HASH_CHARS,
    MAPPING_VERSION,
    NATIVE_TYPES,
    RAW_FILE_NAME,
    UNSUPPORTED_PREFIX,
)


def prepare_counts(tagged: DataFrame) -> DataFrame:
    """(section, item, n) of a tagged preparation plan, in one aggregation."""
    good = F.col("reject_position").isNull()
    reason = F.col("reject_reason")

    def mark(section: str, item: Column, when: Column | None = None) -> Column:
        shown = item.isNotNull() if when is None else when & item.isNotNull()
        return F.when(shown, F.struct(F.lit(section).alias("section"), item.alias("item")))

    rows = F.lit("rows")
    marks = F.array(
        mark("totalRows", rows),
        mark("acceptedRows", rows, good),
        mark("rejectedRows", rows, ~good),
        mark("fraudRows", rows, good & (F.col("isFraud") == "1")),
        mark("flaggedFraudRows", rows, good & (F.col("isFlaggedFraud") == "1")),
        mark("eventTypeCounts", F.col("type"), good),
        mark("normalizedTypeDistribution", F.col("normalized_type"), good),
        mark("typeSupportLevelDistribution", F.col("support_level"), good),
        mark(
            "excludedByType",
            F.regexp_replace(reason, "^[^:]*:", ""),
            reason.startswith(UNSUPPORTED_PREFIX),
        ),
        mark("rejectReasons", reason),
    )
    return (
        tagged.select(F.explode(marks).alias("mark"))
        .filter("mark IS NOT NULL")
        .groupBy("mark.section", "mark.item")
        .agg(F.count("*").alias("n"))
    )


def prepare_report(
    tagged: DataFrame,
    salt_source: str = "default-local",
    input_sha256: str | None = None,
    dataset_slug: str = DATASET_SLUG,
    raw_file_name: str = RAW_FILE_NAME,
    base_time: str = BASE_TIME,
) -> DataFrame:
    """One row: totals, distributions as maps (native types zero-filled), hash metadata.
    Only the source of the salt is recorded, never the salt."""
    counts = prepare_counts(tagged)

    def total(name: str) -> Column:
        found = F.sum(F.when(F.col("section") == name, F.col("n")))
        return F.coalesce(found, F.lit(0)).alias(name)

    def spread(name: str) -> Column:
        entry = F.when(F.col("section") == name, F.struct("item", "n"))
        return F.map_from_entries(F.array_sort(F.collect_list(entry))).alias(name)

    def native_count(name: str) -> Column:
        here = (F.col("section") == "eventTypeCounts") & (F.col("item") == name)
        return F.coalesce(F.sum(F.when(here, F.col("n"))), F.lit(0))

    filled = F.create_map(
        *[part for t in NATIVE_TYPES for part in (F.lit(t), native_count(t))]
    )
    return counts.agg(
        total("totalRows"),
        total("acceptedRows"),
        total("rejectedRows"),
        total("fraudRows"),
        total("flaggedFraudRows"),
        filled.alias("eventTypeCounts"),
        filled.alias("nativeTypeDistribution"),
        spread("normalizedTypeDistribution"),
        spread("typeSupportLevelDistribution"),
        spread("excludedByType"),
    ).select(
        F.lit(dataset_slug).alias("datasetSlug"),
        F.lit(raw_file_name).alias("rawFileName"),
        F.lit(input_sha256).cast("string").alias("inputSha256"),
        F.lit(base_time).alias("baseTime"),
        F.lit(MAPPING_VERSION).alias("mappingPolicyVersion"),
        F.lit(HASH_ALGORITHM).alias("hashAlgorithm"),
        F.lit(HASH_CHARS).alias("hashIdPrefixLength"),
        F.lit(salt_source).alias("hashSaltSource"),
        "*",
    )
