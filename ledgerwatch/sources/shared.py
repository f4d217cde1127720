"""A parquet table that several writers append to, each key once.

Every append writes a folder of its own and becomes visible by a commit file named by the next
version. A version can be created once only; whoever finds it taken looks at what was
committed meanwhile, drops the rows that lost the race, and tries the version after. Readers
see committed folders only, so a failed writer leaves nothing behind that counts.

Beside its rows an append stores bitmaps of its hashed keys, one set for each partition value.
A batch is first held against the bitmaps of the partitions it falls into: rows whose bit is
not set are new without a look at any stored row, the others are compared exactly.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ledgerwatch.operators.windows import first_wins
from ledgerwatch.sources.files import file_system, path_exists
from ledgerwatch.sources.idempotent import in_partitions

# Bits of one index row, as Spark's bitmap functions have it.
BUCKET_BITS = 32_768
_INDEX = "slot string, bucket long, bits binary"


@dataclass(frozen=True)
class Pending:
    """Rows written but not committed, checked against all versions up to ``base``."""

    folder: str
    base: int


class SharedTable:
    """``keys`` occur once in the table. ``partition_by`` names a column that a key
    determines. ``index_bits`` is the length of a partition's bitmap: a longer one lets fewer
    new keys through to the exact comparison and changes no result; a table keeps its own."""

    def __init__(
        self,
        spark: SparkSession,
        path: str,
        schema: StructType,
        keys: list[str],
        partition_by: str | None = None,
        index_bits: int = 1 << 20,
    ) -> None:
        self.spark = spark
        self.path = path.rstrip("/")
        self.schema = schema
        self.keys = keys
        self.partition_by = partition_by
        self.index_bits = index_bits

    # -- versions

    def commits(self, after: int = 0) -> dict[int, str]:
        """Folder of each committed version beyond ``after``. One short file a version."""
        folder = f"{self.path}/_commits"
        if not path_exists(self.spark, folder):
            return {}
        read = self.spark.read.schema("version long, folder string").json(folder)
        return {r["version"]: r["folder"] for r in read.where(F.col("version") > after).collect()}

    def _commit(self, version: int, folder: str) -> bool:
        """Creates the version's file, complete and only if it is not there."""
        fs, path = file_system(self.spark, self.path)
        jvm = self.spark._jvm
        commits = f"{self.path}/_commits"
        fs.mkdirs(path(commits))
        draft = path(f"{commits}/.{uuid.uuid4().hex}")
        stream = fs.create(draft, False)
        stream.write(bytearray(json.dumps({"version": version, "folder": folder}).encode()))
        stream.close()
        final = path(f"{commits}/{version:020d}.json")
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(
            fs.getUri(), self.spark.sparkContext._jsc.hadoopConfiguration()
        )
        options = self.spark.sparkContext._gateway.new_array(
            jvm.org.apache.hadoop.fs.Options.Rename, 0
        )
        try:
            # Renaming never overwrites here: the second writer of a version is refused.
            context.rename(draft, final, options)
        except Exception:
            if not fs.exists(final):
                raise
            fs.delete(draft, False)
            return False
        return True

    # -- reading

    def rows(self, folders: list[str] | None = None) -> DataFrame:
        """All committed rows, or those of some folders."""
        return self._read("rows", self.schema, folders)

    def _read(self, kind: str, schema: StructType | str, folders: list[str] | None) -> DataFrame:
        folders = list(self.commits().values()) if folders is None else folders
        if not folders:
            return self.spark.createDataFrame([], schema)
        reader = self.spark.read.schema(schema).option("basePath", f"{self.path}/{kind}")
        rows = reader.parquet(*[f"{self.path}/{kind}/{f}" for f in folders])
        # Without the column that the commit folders add.
        return rows.drop("commit")

    # -- membership

    def _slot(self) -> Column:
        """The partition a row's key belongs to, as text; one for all without partitions."""
        if not self.partition_by:
            return F.lit("all")
        return F.coalesce(F.concat(F.lit("="), F.col(self.partition_by).cast("string")), F.lit("null"))

    def _placed(self, df: DataFrame) -> DataFrame:
        place = F.pmod(F.xxhash64(*self.keys), F.lit(self.index_bits))
        return df.withColumns(
            {
                "__slot": self._slot(),
                "__bucket": F.floor(place / BUCKET_BITS),
                "__bit": (place % BUCKET_BITS).cast("int"),
            }
        )

    def bitmaps(self, df: DataFrame) -> DataFrame:
        """(slot, bucket, bits) of the rows' keys."""
        placed = self._placed(df).groupBy(F.col("__slot").alias("slot"), F.col("__bucket").alias("bucket"))
        return placed.agg(F.bitmap_construct_agg("__bit").alias("bits"))

    def perhaps_stored(self, fresh: DataFrame, folders: list[str]) -> DataFrame:
        """Rows whose bit is set in the folders' bitmaps: all stored ones, and few others."""
        placed = self._placed(fresh)
        index = self._read("index", _INDEX, folders)
        index = in_partitions(index, placed.select(F.col("__slot").alias("slot")), ["slot"])
        index = index.groupBy("slot", "bucket").agg(F.bitmap_or_agg("bits").alias("__bits"))
        index = index.withColumnsRenamed({"slot": "__slot", "bucket": "__bucket"})
        byte = F.expr("conv(hex(substring(__bits, __bit div 8 + 1, 1)), 16, 10)").cast("int")
        found = placed.join(index, ["__slot", "__bucket"]).withColumn("__byte", byte)
        found = found.where("(shiftright(__byte, __bit % 8) & 1) = 1")
        return found.select(fresh.columns)

    def _not_stored(self, fresh: DataFrame, folders: list[str]) -> DataFrame:
        """``fresh`` (few enough to keep, one row a key) without rows of the given folders."""
        if not folders:
            return fresh
        suspects = self.perhaps_stored(fresh, folders).persist()
        try:
            if suspects.isEmpty():
                return fresh
            held = self.rows(folders)
            if self.partition_by:
                held = in_partitions(held, suspects, [self.partition_by])
            known = held.select(*self.keys).join(suspects.select(*self.keys), self.keys, "left_semi")
            # One row for each key that is stored already.
            return fresh.join(known.distinct(), self.keys, "left_anti")
        finally:
            suspects.unpersist()

    # -- writing

    def prepare(self, batch: DataFrame, order: list[str]) -> Pending:
        """Writes the batch's new rows, one per key (the first in ``order``)."""
        commits = self.commits()
        fresh = first_wins(batch, self.keys, order).persist()
        try:
            return self._write(self._not_stored(fresh, list(commits.values())), max(commits, default=0))
        finally:
            fresh.unpersist()

    def _write(self, fresh: DataFrame, base: int) -> Pending:
        folder = f"commit={uuid.uuid4().hex}"
        fresh = fresh.select(self.schema.fieldNames())
        if self.partition_by:
            # A file or few for each partition, large ones cut.
            fresh = fresh.hint("rebalance", self.partition_by)
        writer = fresh.write.partitionBy(*[self.partition_by] if self.partition_by else [])
        writer.parquet(f"{self.path}/rows/{folder}")
        own = self.rows([folder])
        bitmaps = self.bitmaps(own).hint("rebalance", "slot")
        bitmaps.write.partitionBy("slot").parquet(f"{self.path}/index/{folder}")
        return Pending(folder, base)

    def commit(self, pending: Pending) -> int:
        """Makes the rows visible, less those whose keys others have committed since."""
        while not self.rows([pending.folder]).isEmpty():
            if self._commit(pending.base + 1, pending.folder):
                return pending.base + 1
            newer = self.commits(pending.base)
            own = self.rows([pending.folder])
            left = self._not_stored(own, list(newer.values()))
            base = max(newer)
            # A row that lost the race is a duplicate, not an error.
            lost = left is not own
            pending = self._write(left, base) if lost else Pending(pending.folder, base)
        return pending.base

    def append(self, batch: DataFrame, order: list[str]) -> int:
        """Appends the batch's new rows and returns the version that holds them; without new
        rows there is no new version. The same batch again, by this writer or another, adds
        nothing."""
        return self.commit(self.prepare(batch, order))
