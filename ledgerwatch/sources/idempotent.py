"""Append rows at most once per key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ledgerwatch.operators.windows import first_wins
from ledgerwatch.sources.files import path_exists


def stored(
    spark: SparkSession, target: str, schema: StructType | str
) -> DataFrame | None:
    """The rows already in the target, or None before the first append. A first batch may have
    had nothing to append, so the schema is given, not read."""
    return spark.read.schema(schema).parquet(target) if path_exists(spark, target) else None


def new_rows(
    batch: DataFrame, target: DataFrame | None, keys: list[str], order: list[str]
) -> DataFrame:
    """Rows of the batch that are not stored yet, one per key (the first in ``order``).

    The target is usually far larger than the batch. Only its key columns are read, and it is
    first reduced to keys that occur in the batch, so the target side of the anti join is
    never larger than the batch.
    """
    fresh = first_wins(batch, keys, order)
    if target is None:
        return fresh
    seen = target.select(*keys).join(batch.select(*keys).distinct(), keys, "left_semi")
    return fresh.join(seen, keys, "left_anti")


def repeated_rows(batch: DataFrame, target: DataFrame, keys: list[str]) -> DataFrame:
    """The complement: rows of the batch whose key is already stored."""
    seen = target.select(*keys).join(batch.select(*keys).distinct(), keys, "left_semi")
    return batch.join(seen, keys, "left_semi")


def in_partitions(target: DataFrame, batch: DataFrame, columns: list[str]) -> DataFrame:
    """The part of the target that lies in the partitions the batch falls into. Their values
    are read from the batch: one for each partition that the batch itself would write to."""
    for name in columns:
        values = [r[0] for r in batch.select(name).distinct().collect()]
        test = F.col(name).isin([v for v in values if v is not None])
        target = target.where(test | F.col(name).isNull() if None in values else test)
    return target


def append_once(
    batch: DataFrame,
    target: str,
    keys: list[str],
    order: list[str],
    partition_by: list[str] | None = None,
) -> None:
    """Append the new rows to a parquet target. Running the same batch again appends nothing.
    One writer per target; ``SharedTable`` takes several.

    ``partition_by`` names columns that a key determines (a date, a block of offsets): a
    repeated row lies in the same partition, so only the batch's partitions of the target are
    read. The appended rows are not handed back: a plan that reads the target sees the new
    files after the write. Take ``new_rows`` and checkpoint it where they are needed as well.
    """
    old = stored(batch.sparkSession, target, batch.schema)
    if old is not None and partition_by:
        old = in_partitions(old, batch, partition_by)
    fresh = new_rows(batch, old, keys, order)
    writer = fresh.write.mode("append")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(target)


def append_counted(
    batch: DataFrame,
    target: str,
    keys: list[str],
    order: list[str],
    counts: dict[str, Column],
    partition_by: list[str] | None = None,
) -> dict[str, int]:
    """``append_once`` that also counts, on the way to the sink, the rows each condition of
    ``counts`` holds for. Nothing is read a second time for it.

    Counted are the rows of this batch that the target holds in the end: new ones, and, when
    a batch is repeated, those it stored the first time (``order`` tells them from copies that
    another batch stored). So a batch has the same counts however often it was cut short.
    """
    old = stored(batch.sparkSession, target, batch.schema)
    if old is not None and partition_by:
        old = in_partitions(old, batch, partition_by)
    rows = first_wins(batch, keys, order).withColumn("__here", F.struct(*order))
    if old is None:
        rows = rows.withColumns({"__new": F.lit(True), "__own": F.lit(True)})
    else:
        wanted = batch.select(*keys).distinct()
        held = old.select(*keys, F.struct(*order).alias("__held")).join(wanted, keys, "left_semi")
        rows = rows.join(held, keys, "left").withColumns(
            {
                "__new": F.col("__held").isNull(),
                "__own": F.coalesce(F.col("__held") == F.col("__here"), F.lit(True)),
            }
        )
    observation = Observation()
    tests = [F.count(F.when(F.col("__own") & c, 1)).alias(name) for name, c in counts.items()]
    fresh = rows.observe(observation, *tests).filter("__new").select(*batch.columns)
    writer = fresh.write.mode("append")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(target)
    return {name: int(n) for name, n in observation.get.items()}
