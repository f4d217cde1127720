"""Reading, writing and cutting plans for the operators of this subpackage."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerwatch.session import ensure_checkpoint_dir, prepare_session, ship_package

# A batch of rows handed to Python holds at most so many rows and bytes, so that a task's
# memory does not grow with the length of the texts.
BATCH_ROWS = 512
BATCH_BYTES = 8 << 20


def ready(spark: SparkSession) -> SparkSession:
    """Session settings of the operators: UTC, bounded Arrow batches, package on the workers."""
    prepare_session(spark)
    ship_package(spark)
    for key, value in (
        ("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS),
        ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES),
    ):
        if spark.conf.get(key, None) != str(value):
            spark.conf.set(key, str(value))
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ready(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new folder below the shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows, written to the shared folder and read back: lineage ends there, every later
    use reads the file, and losing an executor loses nothing."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def wide_hash(*columns: Column) -> list[Column]:
    """Two independent 64-bit hashes: equal keys of unequal values are out of reach even with
    10^12 of them, which one 64-bit hash could not promise."""
    return [F.xxhash64(*columns), F.xxhash64(F.lit(0x5EED), *columns)]


def running_start(df: DataFrame, order: list[str], amount: str, into: str) -> DataFrame:
    """``into``: the sum of ``amount`` over all rows before this one in the given order.

    Range partitions are sorted and summed on their own; what is gathered is one sum per
    partition. Tied rows are told apart by their place, so give an order without ties if
    reruns must agree. The range-partitioned rows are written once, because a second
    sampling could cut the ranges elsewhere.
    """
    place = "__place"
    dealt = written(
        df.repartitionByRange(*order).withColumn(place, F.spark_partition_id()), "ranges"
    )
    sums = dealt.groupBy(place).agg(F.sum(amount).alias("__part"))
    before = F.sum("__part").over(
        Window.orderBy(place).rowsBetween(Window.unboundedPreceding, -1)
    )
    # One row per partition: a few thousand at most.
    sums = sums.select(place, F.coalesce(before, F.lit(0)).alias("__before"))
    within = F.sum(amount).over(
        Window.partitionBy(place).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    )
    return (
        dealt.withColumn("__within", F.coalesce(within, F.lit(0)))
        .join(F.broadcast(sums), place)
        .withColumn(into, (F.col("__before") + F.col("__within")).cast("long"))
        .drop(place, "__before", "__within")
    )
