"""Removal of lines that many sites share.

Each distinct line gets a HyperLogLog sketch of its sites, merged by aggregation; lines whose
estimate is near the threshold are counted exactly. Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerwatch.llm.common import ready, wide_hash, written

SITES = 10
# 2**12 registers: a relative error of 1.6 %. Estimates within six of them of the threshold
# (and within one, where sketches are small) are not trusted.
LOG_REGISTERS = 12
DOUBT = 0.1
BLANK = " \t\r"


def trimmed(line: Column) -> Column:
    return F.btrim(line, F.lit(BLANK))


def _line_key(line: Column) -> Column:
    first, second = wide_hash(trimmed(line))
    return F.struct(first.alias("l1"), second.alias("l2"))


def shared_lines(lines: DataFrame, sites: int = SITES) -> DataFrame:
    """(l1, l2) of the lines of ``lines(l1, l2, site)`` on at least ``sites`` distinct sites;
    rows without site count for none."""
    sketches = lines.groupBy("l1", "l2").agg(
        F.count("site").alias("n"), F.hll_sketch_agg("site", LOG_REGISTERS).alias("sketch")
    )
    # A line is on no more sites than it has rows.
    able = sketches.where(F.col("n") >= sites)
    spread = written(
        able.select("l1", "l2", F.hll_sketch_estimate("sketch").alias("spread")), "spread"
    )
    low, high = sites * (1 - DOUBT) - 1, sites * (1 + DOUBT) + 1
    near = spread.where(F.col("spread").between(low, high)).select("l1", "l2")
    exact = (
        lines.where("site is not null")
        .join(near, ["l1", "l2"], "left_semi")
        .select("l1", "l2", "site")
        .distinct()
        .groupBy("l1", "l2")
        .agg(F.count("*").alias("n"))
        .where(F.col("n") >= sites)
    )
    return spread.where(F.col("spread") > high).select("l1", "l2").union(exact.select("l1", "l2"))


def remove_shared_lines(docs: DataFrame, sites: int = SITES) -> DataFrame:
    """(doc_id, n_lines, n_removed, kept_text) for every row of ``docs(doc_id, text, source)``.

    A line ends at a line feed and is compared without blanks around it; blank lines count for
    nothing and stay. Lines on at least ``sites`` sources go wherever they stand; null sources
    count for none. A null text has no lines and stays null; an empty text stays empty.
    Repeated rows are judged alike. Further columns are ignored.
    """
    ready(docs.sparkSession)
    key1, key2 = wide_hash(F.col("text"))
    docs = docs.select(
        F.col("doc_id").cast("long"), F.col("text").cast("string"), F.col("source").cast("string")
    )
    rows = docs.where("text is not null").select(
        key1.alias("k1"), key2.alias("k2"), F.col("source").alias("site"),
        F.explode(F.split("text", "\n")).alias("line"),
    )
    rows = rows.where(F.length(trimmed(F.col("line"))) > 0)
    rows = rows.select("k1", "k2", "site", _line_key(F.col("line")).alias("l"))
    lines = written(rows.select("k1", "k2", "site", "l.l1", "l.l2"), "lines")
    shared = written(shared_lines(lines, sites), "shared")
    # What goes from a text depends on the text alone, so equal texts need it once.
    gone = (
        lines.select("k1", "k2", "l1", "l2")
        .join(shared, ["l1", "l2"])
        .groupBy("k1", "k2")
        .agg(F.collect_set(F.struct("l1", "l2")).alias("gone"))
    )
    gone = written(gone, "gone")
    marked = docs.withColumn("k1", key1).withColumn("k2", key2).join(gone, ["k1", "k2"], "left")
    lines_of = F.split("text", "\n")

    def stays(line: Column) -> Column:
        return ~F.array_contains(F.col("gone"), _line_key(line))

    kept = F.when(F.col("gone").isNull(), F.col("text")).otherwise(
        F.array_join(F.filter(lines_of, stays), "\n")
    )
    counted = F.size(F.filter(lines_of, lambda x: F.length(trimmed(x)) > 0))
    went = F.size(F.filter(lines_of, lambda x: ~stays(x)))
    return marked.select(
        "doc_id",
        F.when(F.col("text").isNull(), 0).otherwise(counted).cast("long").alias("n_lines"),
        F.when(F.col("gone").isNull() | F.col("text").isNull(), 0)
        .otherwise(went)
        .cast("long")
        .alias("n_removed"),
        kept.alias("kept_text"),
    )
