"""Readers and writers for files."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerwatch.config import PAYSIM_COLUMNS
from ledgerwatch.operators.paysim import Prepared
from ledgerwatch.operators.sets import missing_columns
from ledgerwatch.session import ensure_checkpoint_dir

CORRUPT = "_corrupt_record"


def read_jsonl(
    spark: SparkSession,
    path: str | list[str],
    schema: T.StructType,
    mode: str = "FAILFAST",
) -> DataFrame:
    """JSON lines with a fixed schema; blank lines are skipped.

    FAILFAST fails the job on bad JSON or a row that is not an object. PERMISSIVE keeps such
    rows in ``_corrupt_record`` for a reject stream.
    """
    if mode == "PERMISSIVE" and CORRUPT not in schema.fieldNames():
        schema = T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())])
    reader = spark.read.schema(schema).option("mode", mode)
    return reader.option("columnNameOfCorruptRecord", CORRUPT).json(path)


def read_paysim_csv(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Raw simulation rows, every field a string, with no type inference pass.

    The header is required; a byte-order mark before it is accepted, extra columns are
    ignored, missing ones are listed and fatal.
    """
    raw = (
        spark.read.option("header", True)
        .option("encoding", "UTF-8")
        .option("enforceSchema", False)
        .option("nullValue", "\u0000")
        .option("emptyValue", "")
        .csv(path)
    )
    clean = raw.toDF(*[c.lstrip("﻿") for c in raw.columns])
    missing = missing_columns(clean, PAYSIM_COLUMNS)
    if missing:
        raise ValueError(f"missing required columns: {', '.join(missing)}")
    return clean.select(*PAYSIM_COLUMNS)


def number_rows(df: DataFrame, order_key: str, bucket_width: int = 1 << 20) -> DataFrame:
    """``row_number``: 1-based position in the order of a unique whole-number key.

    Positions are counted inside fixed key ranges of at most ``bucket_width`` keys and shifted
    by the sizes of the earlier ranges, so no task sorts the whole table; the only global
    window runs over one row per range.
    """
    ranged = df.withColumn(
        "__range", F.floor(F.col(order_key) / F.lit(bucket_width)).cast("long")
    )
    sizes = ranged.groupBy("__range").agg(F.count("*").alias("__n"))
    earlier = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    shift = sizes.select(
        "__range", F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__shift")
    )
    inside = Window.partitionBy("__range").orderBy(order_key)
    return (
        ranged.withColumn("__pos", F.row_number().over(inside))
        .join(shift, "__range")
        .select((F.col("__pos") + F.col("__shift")).alias("row_number"), *df.columns)
    )


def number_file_rows(df: DataFrame) -> DataFrame:
    """``row_number`` in file order for rows just read from files.

    A row's place is (file, split start, place in the split). Places are written to the
    shared checkpoint folder first, so that the counting pass and the numbering pass see the
    same splits whatever happens to executors in between.
    """
    ensure_checkpoint_dir(df.sparkSession)
    placed = df.select(
        "*",
        F.col("_metadata.file_path").alias("__file"),
        F.col("_metadata.file_block_start").alias("__start"),
        F.monotonically_increasing_id().alias("__id"),
    ).checkpoint(eager=True)
    splits = placed.groupBy("__file", "__start").agg(
        F.count("*").alias("__n"), F.min("__id").alias("__first")
    )
    earlier = Window.orderBy("__file", "__start").rowsBetween(
        Window.unboundedPreceding, -1
    )
    shift = splits.select(
        "__file",
        "__start",
        "__first",
        F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__shift"),
    )
    number = F.col("__shift") + F.col("__id") - F.col("__first") + 1
    return placed.join(shift, ["__file", "__start"]).select(
        number.alias("row_number"), *df.columns
    )


@dataclass(frozen=True)
class OutputPaths:
    events: str
    labels: str
    rejected: str
    report: str

    @classmethod
    def under(cls, folder: str) -> OutputPaths:
        base = folder.rstrip("/")
        return cls(
            f"{base}/paysim-events.jsonl",
            f"{base}/paysim-labels.jsonl",
            f"{base}/paysim-rejected.jsonl",
            f"{base}/paysim-validation-report.json",
        )


def _save_mode(force: bool) -> str:
    return "overwrite" if force else "errorifexists"


def file_system(spark: SparkSession, path: str):
    """The store that holds a path, and what makes its path objects."""
    of = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    return of(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), of


def path_exists(spark: SparkSession, path: str) -> bool:
    store, of = file_system(spark, path)
    return store.exists(of(path))


def write_paysim_outputs(prepared: Prepared, folder: str, force: bool = False) -> OutputPaths:
    """Events, labels and rejects as JSON lines, in one pass over the raw rows. Refuses to
    touch a folder where any output exists unless ``force``.

    One job writes all lines below a staging folder, by kind; the three folders then get their
    names by renaming. A job that fails leaves no output, nor does a failed renaming: what
    had been renamed is taken back, and outputs that were to be replaced are put back.
    """
    paths = OutputPaths.under(folder)
    spark = prepared.tagged.sparkSession
    targets = {"events": paths.events, "labels": paths.labels, "rejected": paths.rejected}
    taken = [p for p in targets.values() if path_exists(spark, p)]
    if taken and not force:
        raise FileExistsError(f"output already exists: {', '.join(taken)}")
    store, of = file_system(spark, folder)
    stage = f"{folder.rstrip('/')}/_staging-{uuid.uuid4().hex}"
    try:
        prepared.lines.write.partitionBy("kind").text(f"{stage}/new")
        for kind in targets:  # a kind without rows is an empty folder
            store.mkdirs(of(f"{stage}/new/kind={kind}"))
        store.mkdirs(of(f"{stage}/old"))
        moves = [(p, f"{stage}/old/{place}") for place, p in enumerate(taken)]
        moves += [(f"{stage}/new/kind={kind}", p) for kind, p in targets.items()]
        _rename_all(store, of, moves)
    finally:
        store.delete(of(stage), True)
    return paths


def _rename_all(store, of, moves: list[tuple[str, str]]) -> None:
    """All of the moves, or none."""
    done = []
    for source, target in moves:
        try:
            if not store.rename(of(source), of(target)):
                raise OSError(f"cannot rename {source} to {target}")
        except Exception:
            for back, gone in reversed(done):
                store.rename(of(gone), of(back))
            raise
        done.append((source, target))


def write_report(report: DataFrame, path: str, force: bool = False) -> None:
    """A one-row report as a single JSON document with sorted top-level keys."""
    ordered = report.select(*[f"`{c}`" for c in sorted(report.columns)])
    pretty = F.to_json(
        F.struct(*ordered.columns), {"pretty": "true", "ignoreNullFields": "false"}
    )
    ordered.select(pretty.alias("value")).coalesce(1).write.mode(_save_mode(force)).text(path)


def input_fingerprint(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(path, length, sha256), one row per file; each file is hashed by one task."""
    return (
        spark.read.format("binaryFile")
        .load(path)
        .select("path", "length", F.sha2("content", 256).alias("sha256"))
    )
