"""Named queries with their SQL twins."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from checks.base_sql import query

QueryFn = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Check:
    name: str
    run: QueryFn
    sql: str | None


_CHECKS: dict[str, Check] = {}


def check(name: str, needs: tuple[str, ...] = (), sql: str | None = None):
    """Register a query. ``sql`` reads the named views of ``base_sql``; without it only the
    row count of the query is compared."""

    def register(fn: QueryFn) -> QueryFn:
        if name in _CHECKS:
            raise ValueError(f"two queries are named {name}")

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return portable(fn(spark, sf_dir))

        _CHECKS[name] = Check(name, run, query(needs, sql) if sql else None)
        return fn

    return register


def all_checks() -> dict[str, Check]:
    import checks.detection_queries  # noqa: F401
    import checks.operations_queries  # noqa: F401
    import checks.simulation_queries  # noqa: F401

    return dict(_CHECKS)


def portable(df: DataFrame) -> DataFrame:
    """Types both engines hand out alike: whole numbers as long, decimals as double, arrays
    as joined text, times as epoch milliseconds."""

    def convert(field: T.StructField):
        column, dtype = F.col(f"`{field.name}`"), field.dataType
        if isinstance(dtype, (T.IntegerType, T.ShortType, T.ByteType)):
            column = column.cast("long")
        elif isinstance(dtype, T.DecimalType):
            column = column.cast("double")
        elif isinstance(dtype, T.ArrayType):
            column = F.array_join(column, ",")
        elif isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
            column = F.unix_millis(column.cast("timestamp"))
        return column.alias(field.name)

    return df.select(*[convert(f) for f in df.schema.fields])
