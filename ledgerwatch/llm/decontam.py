"""Benchmark decontamination with one Aho-Corasick automaton over the benchmark's items.

A window is 13 consecutive words of an item. Every window holds one whole block of seven words
that begins at a multiple of seven, so the automaton needs only those blocks as patterns: the
size of the items, not thirteen times that. A text is normalised and scanned once; where a
block is found, the words around it are compared with the item's, and a common run of 13 words
or more is a run of windows. An item of fewer than 13 words is a pattern, and a window, itself.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache, reduce

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerwatch.llm.common import ready, wide_hash, written
from ledgerwatch.llm.textbatch import LOWER, PLAIN, Batch, batch_of, words_of

WINDOW = 13
SEED = 7
# Texts of so many bytes of items make one automaton (about 60 bytes of memory for each); a
# larger benchmark is split by a hash of its items, and the texts are scanned for each part.
PART_BYTES = 1 << 20

_NORMAL = bytes(np.where(PLAIN, LOWER, 32).astype(np.uint8)[LOWER])


def normal_words(text: str | None) -> list[bytes]:
    """Lower-cased words [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ as UTF-8."""
    return (text or "").encode().translate(_NORMAL).split()


def _line(words: list[bytes]) -> str:
    # One character per byte, so that places in the line are byte places.
    return (b" " + b" ".join(words) + b" ").decode("latin-1")


@lru_cache(maxsize=1)
def _automaton(items: tuple[tuple[int, str], ...]):
    """The automaton, and the items' words. A pattern's value lists (item, word place)."""
    found: dict[str, list[tuple[int, int]]] = {}
    words = []
    for index, (_, text) in enumerate(items):
        own = normal_words(text)
        words.append(own)
        if not own:
            continue
        if len(own) < WINDOW:
            found.setdefault(_line(own), []).append((index, 0))
            continue
        for at in range(0, len(own) - SEED + 1, SEED):
            found.setdefault(_line(own[at : at + SEED]), []).append((index, at))
    automaton = ahocorasick.Automaton()
    for pattern, places in found.items():
        automaton.add_word(pattern, (len(pattern), places))
    if found:
        automaton.make_automaton()
    return automaton if found else None, words


def _runs(line: str, words: list[bytes], automaton, items) -> list[tuple[int, int, int]]:
    """(item, first word, word after the last) of every run of windows."""
    hits = list(automaton.iter(line))
    if not hits:
        return []
    starts = np.cumsum([1] + [len(w) + 1 for w in words])
    reach: dict[tuple[int, int], int] = {}
    out = []
    for end, (length, places) in hits:
        at = int(np.searchsorted(starts, end - length + 2))
        for item, place in places:
            own = items[item]
            if len(own) < WINDOW:
                out.append((item, at, at + len(own)))
                continue
            diagonal = (item, at - place)
            if reach.get(diagonal, -1) >= at + SEED:
                continue
            low = 0
            while low < min(at, place) and words[at - low - 1] == own[place - low - 1]:
                low += 1
            high = SEED
            most = min(len(words) - at, len(own) - place)
            while high < most and words[at + high] == own[place + high]:
                high += 1
            reach[diagonal] = at + high
            if low + high >= WINDOW:
                out.append((item, at - low, at + high))
    return out


def _scanner(items: tuple[tuple[int, str], ...]):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton, words_of_items = _automaton(items)
        for batch in batches:
            texts = batch.column("text")
            bytes_of = batch_of(texts)
            raw = bytes_of.data.tobytes().translate(_NORMAL)
            counts, found = [], []
            for begin, end in zip(bytes_of.start.tolist(), bytes_of.end.tolist(), strict=True):
                words = raw[begin:end].split()
                counts.append(len(words))
                runs = _runs(_line(words), words, automaton, words_of_items) if automaton else []
                found.append(_placed(runs, bytes_of.data[begin:end], items) if runs else [])
            columns = [batch.column(c) for c in ("doc_id", "key1", "key2")]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(counts, pa.int64()), pa.array(found, _RUNS)],
                ["doc_id", "key1", "key2", "n_words", "runs"],
            )

    return scan


_RUNS = pa.list_(
    pa.struct(
        [(name, pa.int64()) for name in ("first", "last", "item_id", "start", "end")]
    )
)
_RUNS_SQL = "array<struct<first:long,last:long,item_id:long,start:long,end:long>>"


def _placed(runs, data: np.ndarray, items) -> list[dict]:
    """Runs with their code point range in the original text."""
    words = words_of(batch_of_bytes(data), PLAIN_ANY_CASE)
    points = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
    return [
        {
            "first": first,
            "last": last,
            "item_id": items[item][0],
            "start": int(points[words.start[first]]),
            "end": int(points[words.end[last - 1]]),
        }
        for item, first, last in sorted(set(runs))
    ]


PLAIN_ANY_CASE = PLAIN[LOWER]


def batch_of_bytes(data: np.ndarray) -> Batch:
    return Batch(data, np.array([0]), np.array([len(data)]))


def item_parts(benchmark: DataFrame) -> list[tuple[tuple[int, str], ...]]:
    """The items, in parts of about PART_BYTES at most: their number follows the measured
    size, so each part is small enough to be sent to all workers."""
    items = benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string"))
    items = items.where("text is not null").distinct()
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, -(-size // PART_BYTES))
    chosen = F.pmod(F.xxhash64("text"), F.lit(parts))
    return [
        tuple(sorted((tuple(r) for r in items.where(chosen == part).collect()), key=str))
        for part in range(parts)
    ]


def _scanned(docs: DataFrame, parts) -> DataFrame:
    """(doc_id, key1, key2, n_words, runs) for every row and each part where it has runs; the
    keys are those of ``document_keys``."""
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    key1, key2 = document_keys()
    docs = docs.withColumn("key1", key1).withColumn("key2", key2)
    schema = f"doc_id long, key1 long, key2 long, n_words long, runs {_RUNS_SQL}"
    found = [docs.mapInArrow(_scanner(own), schema) for own in parts]
    if len(found) == 1:
        return found[0]
    return reduce(DataFrame.union, [each.where(F.size("runs") > 0) for each in found])


def document_keys() -> list[Column]:
    """Hashes of doc_id and text, never null: rows with equal keys are judged alike."""
    return wide_hash(F.col("doc_id").cast("long"), F.col("text").cast("string"))


def contamination_runs(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, n_words, runs) for every row of ``docs(doc_id, text)``.

    ``runs`` are the common runs with items of ``benchmark(item_id, text)``: word range,
    item, and code point range in the original text; an end is exclusive. Null and empty
    texts have no words and no runs; so have items. Repeated rows are judged alike. An item
    without item_id is found like others, with a null id. Further columns are ignored.
    """
    ready(docs.sparkSession)
    parts = item_parts(benchmark)
    found = _scanned(docs, parts)
    if len(parts) == 1:
        return found.drop("key1", "key2")
    hits = found.groupBy("key1", "key2").agg(
        F.array_distinct(F.flatten(F.collect_set("runs"))).alias("all_runs")
    )
    counted = _scanned(docs, [()])
    return counted.join(hits, ["key1", "key2"], "left").select(
        "doc_id", "n_words", F.coalesce("all_runs", "runs").alias("runs")
    )


def hit_words(runs: str = "runs") -> Column:
    """Number of words inside any run: the union of the word ranges."""
    return F.aggregate(
        F.array_sort(runs),
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("upto")),
        lambda acc, run: F.struct(
            (
                acc["n"]
                + F.greatest(
                    F.lit(0).cast("long"), run["last"] - F.greatest(run["first"], acc["upto"])
                )
            ).alias("n"),
            F.greatest(acc["upto"], run["last"]).alias("upto"),
        ),
        lambda acc: acc["n"],
    )


def contaminated(n_hit: Column, n_words: Column) -> Column:
    return (n_hit > 0) & (20 * n_hit >= n_words)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are not contaminated, with all their columns."""
    parts = item_parts(benchmark)
    if len(parts) > 1:
        # By document, not by id: ids may be null, or stand for several texts.
        ready(docs.sparkSession)
        found = _scanned(docs, parts).groupBy("key1", "key2")
        found = found.agg(F.max("n_words").alias("n_words"), F.flatten(F.collect_set("runs")).alias("runs"))
        bad = found.where(contaminated(hit_words(), F.col("n_words")))
        bad = written(bad.select(F.col("key1").alias("__key1"), F.col("key2").alias("__key2")), "bad")
        key1, key2 = document_keys()
        keyed = docs.withColumn("__key1", key1).withColumn("__key2", key2)
        return keyed.join(bad, ["__key1", "__key2"], "left_anti").select(docs.columns)
    ready(docs.sparkSession)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton, words_of_items = _automaton(parts[0])
        for batch in batches:
            bytes_of = batch_of(batch.column("text"))
            raw = bytes_of.data.tobytes().translate(_NORMAL)
            clean = []
            for begin, end in zip(bytes_of.start.tolist(), bytes_of.end.tolist(), strict=True):
                words = raw[begin:end].split()
                runs = _runs(_line(words), words, automaton, words_of_items) if automaton else []
                hit = np.zeros(len(words), bool)
                for _, first, last in runs:
                    hit[first:last] = True
                n = int(hit.sum())
                clean.append(not (n > 0 and 20 * n >= len(words)))
            yield batch.filter(pa.array(clean, pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``contamination_runs`` with the judgement: a document is contaminated if words are hit
    and they are at least a twentieth of its words."""
    runs = contamination_runs(docs, benchmark)
    ids = F.array_sort(
        F.array_distinct(F.transform(F.expr("filter(runs, r -> r.item_id is not null)"), lambda r: r["item_id"].cast("string")))
    )
    judged = runs.select("doc_id", "n_words", hit_words().alias("n_hit"), ids.alias("items"), "runs")
    return judged.withColumn("contaminated", contaminated(F.col("n_hit"), F.col("n_words")))
