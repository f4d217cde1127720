"""Tables that several writers append to."""

import os
import random

import pytest
from pyspark.sql.types import StructType

from ledgerwatch.sources.shared import SharedTable
from ledgerwatch.sources.transactions import read_row_stream
from ledgerwatch.streaming.detect import Sinks, detect_stream
from tests.test_pipeline import frame, tx

ROW = "id long, day string, writer string, place long"


def table(spark, folder, **options):
    return SharedTable(spark, f"{folder}/t", StructType.fromDDL(ROW), ["id"], "day", **options)


def batch(spark, writer, ids, start=0):
    rows = [(i, None if i % 7 == 0 else f"d{i % 7}", writer, start + n) for n, i in enumerate(ids)]
    return spark.createDataFrame(rows, ROW)


def found(t):
    return sorted((r.id, r.writer) for r in t.rows().collect())


def test_second_writer_loses_the_race(spark, folder):
    one, two = table(spark, folder), table(spark, folder)
    first = one.prepare(batch(spark, "a", [1, 2, 3, 3, 7]), ["place"])
    second = two.prepare(batch(spark, "b", [3, 4, 7, 14]), ["place"])
    assert found(one) == []  # nothing is visible before its commit
    assert one.commit(first) == 1
    assert two.commit(second) == 2
    assert found(one) == [(1, "a"), (2, "a"), (3, "a"), (4, "b"), (7, "a"), (14, "b")]
    assert two.append(batch(spark, "b", [3, 4, 7, 14]), ["place"]) == 2  # repeated: no new version
    assert found(one) == [(1, "a"), (2, "a"), (3, "a"), (4, "b"), (7, "a"), (14, "b")]


def test_same_batch_by_two_writers_is_stored_once(spark, folder):
    one, two = table(spark, folder), table(spark, folder)
    rows = batch(spark, "a", range(40))
    first, second = one.prepare(rows, ["place"]), two.prepare(rows, ["place"])
    assert two.commit(second) == 1
    one.commit(first)
    assert found(one) == [(i, "a") for i in range(40)]
    assert list(one.commits()) == [1]


@pytest.mark.parametrize("bits", [1 << 24, 64])
def test_random_interleaving(spark, folder, bits):
    """A short bitmap lets nearly all keys through to the exact comparison: same rows."""
    rng = random.Random(bits)
    writers = [table(spark, folder, index_bits=bits) for _ in range(3)]
    open_ones, seen = [], set()
    for n in range(9):
        ids = [rng.randrange(60) for _ in range(12)]
        seen |= set(ids)
        open_ones.append((n % 3, writers[n % 3].prepare(batch(spark, f"w{n}", ids), ["place"])))
        while len(open_ones) > 2 or (n == 8 and open_ones):
            who, pending = open_ones.pop(rng.randrange(len(open_ones)))
            writers[who].commit(pending)
    ids = [i for i, _ in found(writers[0])]
    assert ids == sorted(seen)


def test_new_keys_open_no_data_file(spark, folder):
    t = table(spark, folder)
    t.append(batch(spark, "a", range(100)), ["place"])
    (kept,) = t.commits().values()
    os.rename(f"{folder}/t/rows/{kept}", f"{folder}/aside")
    t.append(batch(spark, "b", range(100, 160)), ["place"])  # no stored row can be read
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist"):
        t.append(batch(spark, "c", [5]), ["place"])
    os.rename(f"{folder}/aside", f"{folder}/t/rows/{kept}")
    t.append(batch(spark, "c", [5, 160]), ["place"])
    assert [i for i, _ in found(t)] == list(range(161))
    assert dict(found(t))[5] == "a"
    perhaps = t.perhaps_stored(batch(spark, "d", range(90, 400)), list(t.commits().values()))
    assert perhaps.count() == 71  # no false positive among 239 new keys in 2^24 bits


def test_failed_writer_leaves_nothing_visible(spark, folder):
    t = table(spark, folder)
    t.prepare(batch(spark, "lost", [1, 2]), ["place"])
    assert found(t) == [] and t.append(batch(spark, "a", [1]), ["place"]) == 1
    assert found(t) == [(1, "a")]
    assert t.append(batch(spark, "a", []), ["place"]) == 1


def test_two_streams_store_each_event_once(spark, folder):
    """Two streams with checkpoints of their own over overlapping input, one set of sinks."""
    for name, ids in (("one", range(30)), ("two", range(15, 45))):
        rows = frame(spark, *[tx(i, f"u{i % 3}", i) for i in ids])
        rows.coalesce(1).write.parquet(f"{folder}/{name}")
    sinks = Sinks.under(f"{folder}/out", shared=True)
    for name in ("one", "two", "one"):
        own = Sinks(sinks.logs, sinks.results, sinks.dead_letters, f"{folder}/c_{name}", None, True)
        detect_stream(read_row_stream(spark, f"{folder}/{name}"), own, available_now=True).awaitTermination()
    results = sinks.stored_results(spark)
    assert results.count() == results.select("event_id").distinct().count() == 45
