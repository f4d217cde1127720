"""Set questions about ids and fields."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ids_in_both(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    return a.select(key).intersect(b.select(key))


def ids_only_in_first(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    return a.select(key).subtract(b.select(key))


def ids_difference(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """(key, side): ids on one side only. No rows means that the sets are equal.

    One shuffle with map-side combining, where two subtractions would need two.
    """
    both = a.select(key, F.lit(1).alias("side")).unionByName(
        b.select(key, F.lit(2).alias("side"))
    )
    sides = both.groupBy(key).agg(
        F.max((F.col("side") == 1).cast("int")).alias("a"),
        F.max((F.col("side") == 2).cast("int")).alias("b"),
    )
    return sides.filter("a <> b").select(
        key, F.when(F.col("a") == 1, F.lit("first")).otherwise(F.lit("second")).alias("side")
    )


def missing_columns(df: DataFrame, required: tuple[str, ...]) -> list[str]:
    """Required columns the table lacks, sorted; decided on the plan, no job runs."""
    return sorted(set(required) - set(df.columns))


def missing_keys(keys: Column, required: tuple[str, ...]) -> Column:
    """Required fields a row lacks, given the keys it has, sorted."""
    wanted = F.array(*[F.lit(r) for r in sorted(required)])
    return F.array_except(wanted, F.coalesce(keys, F.array().cast("array<string>")))
