"""A corpus pipeline of five stages: language, near duplicates, contamination, mix, tokens."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerwatch.llm.common import ready, table, written
from ledgerwatch.llm.decontam import drop_contaminated
from ledgerwatch.llm.langid import drop_unidentified
from ledgerwatch.llm.minhash import near_duplicates
from ledgerwatch.llm.mixing import mix_sources
from ledgerwatch.llm.tokenstore import token_store

TOKENIZER = "word_bpe_49k.json"
END_ID = 1


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language; those without letters go."""
    return drop_unidentified(docs, docs)


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: the one of least doc_id, rows
    without id last. Every row is a document of its own, so rows that share an id but not
    their texts are told apart, and rows without id are compared like others."""
    spark = ready(spark)
    row = F.monotonically_increasing_id()
    numbered = written(docs.withColumn("__row", row), "numbered")
    found = near_duplicates(numbered.select(F.col("__row").alias("doc_id"), "text"))
    found = found.select(F.col("doc_id").alias("__row"), "component_id")
    first = F.struct(F.col("doc_id").isNull(), "doc_id", "__row")
    kept = numbered.select("__row", "doc_id").join(found, "__row").groupBy("component_id")
    kept = kept.agg(F.min(first).alias("first")).select(F.col("first.__row").alias("__row"))
    return numbered.join(kept, "__row", "left_semi").select(docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated by the benchmark."""
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it. Rows that repeat an id and a text share
    their copies evenly."""
    ready(spark)
    # Null ids need a key of their own to be joined on; texts tell them apart.
    key = [F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))).alias("id_key")]
    copies = mix_sources(docs).select(*key, "tie", "copies").groupBy("id_key", "tie")
    copies = copies.agg(F.sum("copies").alias("__copies"), F.count("*").alias("__rows"))
    copies = written(copies.where(F.col("__copies") > 0), "copies")
    marked = docs.withColumn("id_key", key[0]).withColumn("tie", F.xxhash64("text"))
    same = Window.partitionBy("id_key", "tie").orderBy("id_key")
    taken = marked.join(copies, ["id_key", "tie"]).withColumn("__k", F.row_number().over(same))
    times = F.expr("cast((__copies + __rows - __k) div __rows as int)")
    repeated = taken.withColumn("__times", F.explode(F.array_repeat(F.lit(0), times)))
    return repeated.select(docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) as read back from the written token store."""
    return token_store(docs, public_tokenizers.path(TOKENIZER), END_ID)


STAGES = [
    ("language", language),
    ("deduplicate", deduplicate),
    ("decontaminate", decontaminate),
    ("mix", mix),
    ("tokens", tokens),
]

# Token ids and drawn copies are beyond SQL; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
