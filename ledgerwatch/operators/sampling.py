"""Row limits and samples in file order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerwatch.config import (
    FAILURE_ROWS,
    HASH_ALGORITHM,
    HASH_CHARS,
    MAX_SAMPLE_ROWS,
)


def _check_size(n: int) -> None:
    if not 1 <= n <= MAX_SAMPLE_ROWS:
        raise ValueError(f"sample size must be between 1 and {MAX_SAMPLE_ROWS}")


def limit_rows(df: DataFrame, n: int, at_least: int = 0) -> DataFrame:
    """The first ``n`` rows by ``row_number``; a filter, so it needs no sort."""
    if n < at_least:
        raise ValueError(f"row limit must be >= {at_least}")
    return df.filter(F.col("row_number") <= n)


def sample_head(events: DataFrame, n: int) -> DataFrame:
    """(eventId, position) of the first ``n`` events."""
    _check_size(n)
    top = events.select("eventId", "row_number").orderBy("row_number").limit(n)
    return _positions(top, ["row_number"])


def sample_balanced(labels: DataFrame, n: int) -> DataFrame:
    """(eventId, position): fraud ids first, up to ``n``, then non-fraud ids to fill up. The
    order (fraud first, then file order) makes it one top-n; no ranking of whole classes."""
    _check_size(n)
    top = (
        labels.filter(F.col("isFraud").isNotNull())
        .select("eventId", "row_number", (~F.col("isFraud")).cast("int").alias("__second"))
        .orderBy("__second", "row_number")
        .limit(n)
    )
    return _positions(top, ["__second", "row_number"])


def _positions(top: DataFrame, order: list[str]) -> DataFrame:
    """Number a sample; it has at most ``MAX_SAMPLE_ROWS`` rows by construction."""
    rows = top.agg(F.array_sort(F.collect_list(F.struct(*order, "eventId"))).alias("rows"))
    numbered = rows.select(F.posexplode("rows").alias("__at", "__row"))
    return numbered.select(
        F.col("__row.eventId").alias("eventId"),
        (F.col("__at") + 1).alias("position"),
    )


def select_sample(df: DataFrame, sample: DataFrame) -> DataFrame:
    """Rows of the sampled ids with their ``position``. The sample is at most
    ``MAX_SAMPLE_ROWS`` ids, so broadcasting it is safe."""
    return df.join(F.broadcast(sample), "eventId")


def failures(tagged: DataFrame, n: int = FAILURE_ROWS) -> DataFrame:
    """The first ``n`` failed rows of a replay in row order."""
    return (
        tagged.filter("replay_reason IS NOT NULL")
        .select(
            F.col("row_number").alias("rowNumber"),
            F.col("replay_reason").alias("reason"),
            "eventId",
        )
        .orderBy("rowNumber")
        .limit(n)
    )


def sample_manifest(
    sample_labels: DataFrame,
    sample_events: DataFrame,
    report: DataFrame,
    strategy: str,
    requested: int,
) -> DataFrame:
    """One row describing a sample, with the provenance fields of the prepare report."""
    one = F.lit(1).alias("__one")
    label_counts = sample_labels.agg(
        F.count("*").alias("sampleLabels"),
        F.count(F.when(F.col("isFraud"), 1)).alias("sampleFraudRows"),
        F.count(F.when(~F.col("isFraud"), 1)).alias("sampleNonFraudRows"),
    ).select("*", one)
    event_counts = sample_events.agg(F.count("*").alias("sampleEvents")).select("*", one)
    source = report.select(
        F.col("datasetSlug").alias("sourceDatasetSlug"),
        F.col("rawFileName").alias("sourceRawFileName"),
        F.col("inputSha256").alias("sourceInputSha256"),
        "hashSaltSource",
        one,
    )
    return (
        source.join(event_counts, "__one")
        .join(label_counts, "__one")
        .drop("__one")
        .select(
            "*",
            F.lit(strategy).alias("sampleStrategy"),
            F.lit(requested).alias("sampleSizeRequested"),
            F.lit(HASH_ALGORITHM).alias("hashAlgorithm"),
            F.lit(HASH_CHARS).alias("hashIdPrefixLength"),
            F.lit("row-number-deterministic").alias("eventIdPolicy"),
            F.lit(False).alias("containsRuntimeLabels"),
            F.lit(False).alias("containsRawIdentifiers"),
        )
    )
