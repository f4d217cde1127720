"""Native transaction types and what they map to."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerwatch.config import TYPE_MAPPING, UNSUPPORTED_PREFIX

_MAPPING_COLUMNS = (
    "map_native string, map_normalized string, map_support string, "
    "map_denominator string, map_excluded string, map_loss_risk string"
)


def inline_table(spark: SparkSession, rows: tuple, ddl: str) -> DataFrame:
    """A small fixed table as an inline relation of the plan (no Python at run time)."""

    def literal(value: object) -> str:
        if value is None:
            return "CAST(NULL AS STRING)"
        if isinstance(value, str):
            return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"
        return f"{value}D" if isinstance(value, float) else str(value)

    names = ", ".join(part.split()[0] for part in ddl.split(","))
    values = ", ".join("(" + ", ".join(literal(v) for v in row) + ")" for row in rows)
    return spark.sql(f"SELECT * FROM VALUES {values} AS t({names})")


def type_mapping_table(spark: SparkSession) -> DataFrame:
    return inline_table(spark, TYPE_MAPPING, _MAPPING_COLUMNS)


def map_native_type(df: DataFrame, native: str = "native_type") -> DataFrame:
    """Add normalized_type, support_level, evaluation_denominator, excluded_reason and
    semantic_loss_risk. A type outside the five-row table is unsupported, with itself in the
    reason. The table is fixed, so broadcasting it is safe at any data size."""
    table = type_mapping_table(df.sparkSession)
    joined = df.join(F.broadcast(table), F.col(native) == F.col("map_native"), "left")
    known = F.col("map_native").isNotNull()
    return joined.select(
        *[df[c] for c in df.columns],
        F.col("map_normalized").alias("normalized_type"),
        F.coalesce("map_support", F.lit("unsupported")).alias("support_level"),
        F.coalesce("map_denominator", F.lit("excluded")).alias("evaluation_denominator"),
        F.when(known, F.col("map_excluded"))
        .otherwise(F.concat(F.lit(UNSUPPORTED_PREFIX), F.coalesce(F.col(native), F.lit(""))))
        .alias("excluded_reason"),
        F.coalesce("map_loss_risk", F.lit("unknown")).alias("semantic_loss_risk"),
    )


def lookup(df: DataFrame, dim: DataFrame, key: str, how: str = "left") -> DataFrame:
    """Join a fixed dimension table (type mapping, threshold policies) by ``key``."""
    return df.join(F.broadcast(dim), key, how)
