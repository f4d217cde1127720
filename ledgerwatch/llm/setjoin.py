"""Jaccard self-join of word-shingle sets, heavy and light sets apart, grouped by reachability.

Rows of equal sets are one class. Classes smaller than a boundary are light, others heavy.

* Light pairs: two sets of ``n`` and ``m`` shingles reach the threshold exactly if they share
  some subset of ``c(n, m)`` shingles. Each light set gives out all such subsets of itself,
  one hash each; sets that meet in a subset are linked without another look.
* Heavy sets are sought in inverted lists. A list holds the sets that have its shingle among
  their first ones, in an order of all shingles that puts frequent ones last: sets that reach
  the threshold share one of their ``n - ceil(0.9 n) + 1`` first. Lists hold light sets too,
  where these are large enough to be a heavy set's partner.
* The boundary is where the rows given out on both sides are fewest, from the sizes' counts.

Lists are scanned in steps. First each set is compared with the one of its lists' smallest
members that it meets most often; what these stars link is one group. Lists that still hold
several groups are then scanned in blocks, of neighbouring sizes only, in tasks of bounded
size. Sizes, places in the lists, and counts of shingles per hash cell (their differences are
at most the sets' difference) rule pairs out without losing a link. What is left connects sets
to clusters, whatever number of lists they meet in, and the full sets of each cluster are
compared once, again in blocks. A block gives back what joins sets or groups, never its pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerwatch.llm.common import ready, written
from ledgerwatch.llm.components import components
from ledgerwatch.llm.minhash import shingle_sets
from ledgerwatch.llm.textbatch import U64, mix

SHINGLE = 3
# Linked if 10 * shared >= 9 * united.
PART, WHOLE = 9, 10
# Counters of the sketch that tells frequent shingles; a longer sketch changes no result.
COUNTERS = 1 << 22
# Sizes a boundary is sought below: larger sets have too many subsets.
MOST_LIGHT = 32
# Hash cells in which a set's shingles are counted, one byte each.
CELLS = 64
# Members of a list that one task compares with as many others.
BLOCK = 512
# Length of the bitmap that spares a second pass most texts.
BITS = 1 << 23


def overlap(n: int, m: int) -> int:
    """Shingles that sets of ``n`` and ``m`` must share at least."""
    return -(-PART * (n + m) // (PART + WHOLE))


def prefix_length(n):
    """Of the first so many shingles a set shares one with each partner."""
    return n - -(-PART * n // WHOLE) + 1


def roles(size: int) -> list[tuple[int, int, int]]:
    """(n, m, shared) for all pairs of sizes n <= m with ``size`` among them that can reach the
    threshold without being equal sets."""
    pairs = {(min(size, x), max(size, x)) for x in range(-(-PART * size // WHOLE), WHOLE * size // PART + 1)}
    found = [(n, m, overlap(n, m)) for n, m in sorted(pairs)]
    return [(n, m, c) for n, m, c in found if c <= n and not c == n == m]


def subset_count(size: int) -> int:
    return sum(math.comb(size, c) for _, _, c in roles(size))


def boundary(counts: dict[int, int], list_length: float) -> int:
    """Smallest heavy size: light sets cost their subsets; sets in the lists cost their first
    shingles, once each and once for each other member that the scan meets there."""
    subsets = [counts.get(s, 0) * subset_count(s) if s < MOST_LIGHT else 0 for s in range(MOST_LIGHT + 1)]
    lists = [counts.get(s, 0) * prefix_length(s) * (1 + list_length) for s in range(MOST_LIGHT + 1)]

    def cost(x: int) -> float:
        return sum(subsets[:x]) + sum(lists[-(-PART * x // WHOLE) :])

    return min(range(1, MOST_LIGHT + 1), key=cost)


def similar(shared, left, right):
    """shared / united >= 9 / 10, from whole numbers."""
    return WHOLE * shared >= PART * (left + right - shared)


def close_sizes(low, high):
    return WHOLE * low >= PART * high


def _survey(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (kind, key, count) of a task: counts of small sizes, of shingles in all, and of
    hashed counters that stand out: above what shingles that occur once would do to them."""
    sketch, sizes, total = np.zeros(COUNTERS, np.int32), np.zeros(MOST_LIGHT, np.int64), 0
    for batch in batches:
        values, count = shingle_sets(batch.column("text"), SHINGLE)
        total += len(values)
        sizes += np.bincount(count[count < MOST_LIGHT], minlength=MOST_LIGHT)
        key, times = np.unique(values % U64(COUNTERS), return_counts=True)
        sketch[key.astype(np.int64)] += times.astype(np.int32)
    usual = total / COUNTERS
    key = np.flatnonzero(sketch > max(4.0, usual + 6.0 * math.sqrt(usual)))
    kinds = np.concatenate((np.zeros(len(key)), np.ones(MOST_LIGHT), [2])).astype(np.int32)
    keys = np.concatenate((key, np.arange(MOST_LIGHT), [0]))
    counts = np.concatenate((sketch[key], sizes, [total]))
    columns = [pa.array(kinds), pa.array(keys), pa.array(counts)]
    yield pa.RecordBatch.from_arrays(columns, ["kind", "key", "count"])


def survey(docs: DataFrame) -> tuple[np.ndarray, int]:
    """(level of each counter, boundary). A counter's level is the number of bits of its
    count, 0 where no task saw it stand out. At most COUNTERS + MOST_LIGHT + 1 rows are
    collected, as columns."""
    rows = docs.select("text").mapInArrow(_survey, "kind int, key long, count long")
    rows = rows.groupBy("kind", "key").agg(F.sum("count").alias("count")).toArrow()
    kind, key, count = (rows.column(c).to_numpy() for c in ("kind", "key", "count"))
    level = np.zeros(COUNTERS, np.uint8)
    often = count[kind == 0]
    level[key[kind == 0]] = 1 + np.log2(np.maximum(often, 1)).astype(np.uint8)
    total = int(count[kind == 2].sum())
    repeats = int(often.sum()) / total if total else 0.0
    sizes = dict(zip(key[kind == 1].tolist(), count[kind == 1].tolist(), strict=True))
    return level, boundary(sizes, repeats)


def _signer(level: np.ndarray, heavy: int):
    """Per text: set size, print of the set, cell counts, and its first shingles in the common
    order; of a light set all shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values, count = shingle_sets(batch.column("text"), SHINGLE)
            n = len(count)
            owner = np.repeat(np.arange(n), count)
            starts = np.concatenate(([0], np.cumsum(count)))
            prints = _prints(values, count)
            cells = np.bincount(owner * CELLS + (values >> U64(58)).astype(np.int64), minlength=n * CELLS)
            cells = np.minimum(cells, 255).astype(np.uint8)
            # The shingles come by hash; a stable sort puts frequent ones last.
            rank = level[(values % U64(COUNTERS)).astype(np.int64)]
            order = np.argsort(owner * 64 + rank, kind="stable")
            given = np.where(count < heavy, count, prefix_length(count))
            # Sets below nine shingles have no partner but their equals.
            given = np.where(count < PART, 0, given)
            place = np.arange(len(values)) - starts[owner]
            tokens = values[order][place < given[owner]]
            offsets = np.concatenate(([0], np.cumsum(given))).astype(np.int32)
            tokens = pa.ListArray.from_arrays(pa.array(offsets), pa.array(tokens.view(np.int64)))
            at = np.arange(n + 1, dtype=np.int32) * CELLS
            cells = pa.Array.from_buffers(
                pa.binary(), n, [None, pa.py_buffer(at), pa.py_buffer(cells)]
            )
            columns = [batch.column("doc_id"), pa.array(count.astype(np.int64))]
            columns += [pa.array(prints[:, 0]), pa.array(prints[:, 1]), cells, tokens]
            yield pa.RecordBatch.from_arrays(
                columns, ["doc_id", "n", "print1", "print2", "cells", "tokens"]
            )

    return run


def _prints(values: np.ndarray, count: np.ndarray) -> np.ndarray:
    """128 bits of each set, 0 for the empty one."""
    prints = np.zeros((len(count), 2), np.int64)
    full = count > 0
    if full.any():
        starts = np.concatenate(([0], np.cumsum(count)[:-1]))[full]
        sums = [np.add.reduceat(mix(values ^ U64(s)), starts) for s in (0x33, 0xB1)]
        prints[full] = np.stack(sums, axis=1).view(np.int64)
    return prints


_SIGNED = "doc_id long, n long, print1 long, print2 long, cells binary, tokens array<long>"


def _left_out(size: int, number: int) -> np.ndarray:
    """Places of all choices of so many elements, one choice a row."""
    chosen = np.array(list(combinations(range(size), number)), np.int64)
    return chosen.reshape(math.comb(size, number), number)


def _subsets(heavy: int):
    """(key1, key2, side, node) for every subset that two light sets must share to be linked.
    ``side`` tells the smaller of two sizes (0) from the larger (1); 2 stands for both."""
    chosen = {
        size: [
            (n, m, _left_out(size, size - c), mix(np.array([n << 32 | m], np.uint64)))
            for n, m, c in roles(size)
            if m < heavy
        ]
        for size in range(PART, heavy)
    }

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for node, tokens in zip(batch.column("node"), batch.column("tokens"), strict=True):
                token = np.asarray(tokens.values).view(np.uint64)
                two = [mix(token ^ U64(s)) for s in (0x6D, 0xE5)]
                for n, m, left_out, pair in chosen[len(token)]:
                    keys = [mix(x.sum() - x[left_out].sum(axis=1) + pair) for x in two]
                    size = len(left_out)
                    side = 2 if n == m else int(len(token) == m)
                    columns = [pa.array(k.view(np.int64)) for k in keys]
                    columns += [pa.array(np.full(size, side, np.int32)), pa.array(np.full(size, node.as_py(), np.int64))]
                    yield pa.RecordBatch.from_arrays(columns, ["key1", "key2", "side", "node"])

    return run


def light_links(classes: DataFrame, heavy: int) -> DataFrame:
    """(a, b): links that join all light sets that share a subset; as many as its members."""
    light = classes.where((F.col("n") >= PART) & (F.col("n") < heavy)).select("node", "tokens")
    rows = light.mapInArrow(_subsets(heavy), "key1 long, key2 long, side int, node long")
    rows = written(rows, "subsets")
    ends = rows.groupBy("key1", "key2").agg(
        F.min(F.when(F.col("side") != 1, F.col("node"))).alias("small"),
        F.min(F.when(F.col("side") != 0, F.col("node"))).alias("large"),
        F.count("*").alias("members"),
    )
    ends = ends.where("members > 1 and small is not null and large is not null")
    ends = ends.drop("members")
    # Each of the smaller sets is linked with every larger one, so with the first; likewise
    # the other way round.
    other = F.when(F.col("side") == 0, F.col("large")).otherwise(F.col("small"))
    found = rows.join(ends, ["key1", "key2"]).select(F.col("node").alias("a"), other.alias("b"))
    return found.where("a <> b").distinct()


def _differences(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Sums of the cells' differences, pair by pair, in slices of bounded size."""
    out = np.empty(len(left), np.int64)
    for at in range(0, len(left), 1 << 16):
        a, b = left[at : at + (1 << 16)].astype(np.int16), right[at : at + (1 << 16)]
        out[at : at + (1 << 16)] = np.abs(a - b).sum(axis=1)
    return out


def possible(n, m, differences):
    """Whether sets that differ in so many shingles at least may reach the threshold: shared is
    half of n + m - difference at most."""
    return WHOLE * (n + m - differences) >= PART * (n + m + differences)


def _cell_matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, CELLS)


def _possible_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n, m = batch.column("n").to_numpy(), batch.column("c_n").to_numpy()
        apart = _differences(_cell_matrix(batch.column("cells")), _cell_matrix(batch.column("c_cells")))
        ok = close_sizes(np.minimum(n, m), np.maximum(n, m)) & possible(n, m, apart)
        yield batch.select(["node", "center"]).filter(pa.array(ok))


def list_members(classes: DataFrame, heavy: int) -> DataFrame:
    """(list, node, n, place, center) of all lists with a heavy member and another one, less
    members that no size and place in the list can link.

    Most lists of unlike sets have two or three members; these fall if no two neighbours by
    size are close enough, or, of two, if what follows in either is too short.
    """
    able = classes.where(F.col("n") >= max(PART, -(-PART * heavy // WHOLE)))
    length = f"int(n - ({PART} * n + {WHOLE - 1}) div {WHOLE} + 1)"
    first = F.slice("tokens", 1, F.expr(length))
    rows = able.select("node", "n", F.posexplode(first).alias("place", "list"))
    rest = F.col("n") - F.col("place")
    lists = rows.groupBy("list").agg(
        F.min("node").alias("center"),
        F.count("*").alias("size"),
        F.min("n").alias("least"),
        F.max("n").alias("most"),
        F.sum("n").alias("sum"),
        F.min(rest).alias("rest"),
    )
    middle = F.col("sum") - F.col("least") - F.col("most")
    two = close_sizes(F.col("least"), F.col("most")) & (
        (PART + WHOLE) * F.col("rest") >= PART * F.col("sum")
    )
    three = close_sizes(F.col("least"), middle) | close_sizes(middle, F.col("most"))
    useful = F.when(F.col("size") == 2, two).when(F.col("size") == 3, three).otherwise(True)
    lists = lists.where((F.col("size") > 1) & (F.col("most") >= heavy) & useful)
    rows = rows.join(lists.select("list", "center", "least"), "list")
    # What a member shares from here on must do for a partner of the list's smallest size.
    rows = rows.where((PART + WHOLE) * rest >= PART * (F.col("n") + F.col("least")))
    return written(rows.drop("least"), "lists")


def star_links(docs: DataFrame, members: DataFrame, classes: DataFrame) -> DataFrame:
    """Confirmed links (a, b) of each set with the smallest member it meets in most lists."""
    meets = members.where("node <> center").groupBy("node", "center").agg(F.count("*").alias("k"))
    pairs = meets.groupBy("node").agg(F.max_by("center", F.struct("k", -F.col("center"))).alias("center"))
    facts = classes.select("node", "n", "cells")
    pairs = pairs.join(facts, "node").join(
        facts.select(*[F.col(c).alias(f"c_{c}") for c in facts.columns]),
        F.col("center") == F.col("c_node"),
    )
    pairs = pairs.select("node", "n", "cells", "center", "c_n", "c_cells")
    pairs = written(pairs.mapInArrow(_possible_pairs, "node long, center long"), "stars")
    wanted = pairs.select("node").union(pairs.select("center")).distinct()
    sets = full_sets(docs, wanted, classes)
    pairs = pairs.join(sets.select("node", F.col("shingles").alias("mine")), "node").join(
        sets.select(F.col("node").alias("center"), F.col("shingles").alias("other")), "center"
    )
    shared = F.size(F.array_intersect("mine", "other")).cast("long")
    return pairs.where(similar(shared, F.size("mine"), F.size("other"))).select(
        F.col("node").alias("a"), F.col("center").alias("b")
    )


def _bit(column: str) -> Column:
    return F.pmod(F.xxhash64(column), F.lit(BITS))


def _set_maker(marked: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pa.array(marked[batch.column("bit").to_numpy()]))
            values, count = shingle_sets(batch.column("text"), SHINGLE)
            prints = _prints(values, count)
            offsets = pa.array(np.concatenate(([0], np.cumsum(count))).astype(np.int32))
            sets = pa.ListArray.from_arrays(offsets, pa.array(values.view(np.int64)))
            columns = [batch.column("doc_id"), pa.array(prints[:, 0]), pa.array(prints[:, 1]), sets]
            yield pa.RecordBatch.from_arrays(columns, ["rep", "print1", "print2", "shingles"])

    return run


def full_sets(docs: DataFrame, wanted: DataFrame, classes: DataFrame) -> DataFrame:
    """(node, shingles) of the wanted classes, from another pass over the texts. A bitmap of
    hashed ids, of fixed length, lets most other texts pass by unread and keeps the texts out
    of the shuffle; the join then leaves exactly the wanted ones, once each."""
    reps = written(
        classes.join(wanted, "node", "left_semi").select("node", "rep", "print1", "print2"), "reps"
    )
    bit = _bit("rep")
    parts = reps.groupBy((bit / 32768).cast("int").alias("part")).agg(
        F.bitmap_construct_agg((bit % 32768).cast("long")).alias("bits")
    )
    marked = np.zeros(BITS, bool)
    # At most BITS / 32768 rows.
    for row in parts.collect():
        bits = np.unpackbits(np.frombuffer(row["bits"], np.uint8), bitorder="little")
        marked[row["part"] * 32768 : (row["part"] + 1) * 32768] = bits
    texts = docs.where("doc_id is not null").select("doc_id", "text", _bit("doc_id").alias("bit"))
    made = texts.mapInArrow(
        _set_maker(marked), "rep long, print1 long, print2 long, shingles array<long>"
    )
    made = made.join(reps, ["rep", "print1", "print2"]).groupBy("node")
    return written(made.agg(F.first("shingles").alias("shingles")), "sets")


def _size_class() -> Column:
    """Partners' classes are equal or neighbours; the base is a little above 10 / 9, so that
    rounding cannot put them further apart."""
    return F.floor(F.ln("n") / (math.log(WHOLE / PART) * 1.0001)).cast("long")


def in_blocks(members: DataFrame) -> DataFrame:
    """Rows (list, node, n, label, ...) of lists with several labels, dealt to parts (list,
    low, high) of bounded size.

    A list of at most BLOCK members is one part, side 2. Of a longer one, units are up to
    about BLOCK members of a size class, the largest group's members apart; a part is two
    units of equal or neighbouring classes (sides 0 and 1), or one unit with itself (side 2).
    Two units of the largest group make no part.
    """
    own = members.columns
    counts = members.groupBy("list", "label").agg(F.count("*").alias("k"))
    mixed = counts.groupBy("list").agg(
        F.count("*").alias("labels"),
        F.sum("k").alias("size"),
        F.max_by("label", F.struct("k", "label")).alias("most"),
    )
    rows = members.join(mixed.where("labels > 1").drop("labels"), "list")
    small = rows.where(F.col("size") <= BLOCK).select(
        *own,
        F.lit(-1).cast("long").alias("low"),
        F.lit(-1).cast("long").alias("high"),
        F.lit(2).alias("side"),
    )
    large = rows.where(F.col("size") > BLOCK).select(
        *own, _size_class().alias("cls"), (F.col("label") == F.col("most")).alias("main")
    )
    units = large.groupBy("list", "cls", "main").agg(F.ceil(F.count("*") / BLOCK).alias("units"))
    draw = F.pmod(F.xxhash64("node", "list"), F.col("units"))
    dealt = large.join(units, ["list", "cls", "main"]).withColumn("unit", draw)
    dealt = dealt.withColumn("p_cls", F.explode(F.array(*[F.col("cls") + d for d in (-1, 0, 1)])))
    partner = units.select(
        "list", F.col("cls").alias("p_cls"), F.col("main").alias("p_main"), F.col("units").alias("p_units")
    )
    dealt = dealt.join(partner, ["list", "p_cls"]).where("not (main and p_main)")
    every = F.sequence(F.lit(0).cast("long"), F.col("p_units") - 1)
    dealt = dealt.withColumn("p_unit", F.explode(every))

    def code(cls: str, main: str, unit: str) -> Column:
        return (F.col(cls) * 2 + F.col(main).cast("long")) * (1 << 40) + F.col(unit)

    mine, other = code("cls", "main", "unit"), code("p_cls", "p_main", "p_unit")
    dealt = dealt.select(
        *own,
        F.least(mine, other).alias("low"),
        F.greatest(mine, other).alias("high"),
        F.when(mine == other, 2).when(mine < other, 0).otherwise(1).alias("side"),
    )
    return small.union(dealt)


_PART = ["list", "low", "high"]


def _by_part(rows: DataFrame) -> DataFrame:
    return rows.repartition(*_PART).sortWithinPartitions(*_PART, "node", "side")


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Whole parts from batches sorted by them."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.stack([batch.column(c).to_numpy() for c in _PART])
        cuts = (np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1).tolist()
        if held:
            ends = [held[-1].column(c)[held[-1].num_rows - 1].as_py() for c in _PART]
            if ends != keys[:, 0].tolist():
                yield pa.Table.from_batches(held)
                held = []
        at = 0
        for cut in cuts:
            held.append(batch.slice(at, cut - at))
            yield pa.Table.from_batches(held)
            held, at = [], cut
        held.append(batch.slice(at))
    if held:
        yield pa.Table.from_batches(held)


def _candidates(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of a part that no exact test rules out."""
    side, node, label, n, place = (
        rows.column(c).to_numpy() for c in ("side", "node", "label", "n", "place")
    )
    left, right = np.flatnonzero(side != 1), np.flatnonzero(side != 0)
    a, b = n[left][:, None], n[right][None, :]
    ok = close_sizes(np.minimum(a, b), np.maximum(a, b))
    ok &= label[left][:, None] != label[right][None, :]
    both = (side[left] == 2)[:, None] & (side[right] == 2)[None, :]
    ok &= ~both | (left[:, None] < right[None, :])
    # In the first list that two sets share, what they share is this shingle and what follows.
    rest = np.minimum((n - place)[left][:, None], (n - place)[right][None, :])
    ok &= (PART + WHOLE) * rest >= PART * (a + b)
    i, j = np.nonzero(ok)
    i, j = left[i], right[j]
    if len(i):
        cells = _cell_matrix(rows.column("cells"))
        keep = possible(n[i], n[j], _differences(cells[i], cells[j]))
        i, j = i[keep], j[keep]
    return i, j


class Forest:
    """Joins that connect, of all that are tried."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}
        self.joins: list[tuple[int, int]] = []

    def top(self, x: int) -> int:
        up = self.up
        while up.setdefault(x, x) != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def join(self, x: int, y: int) -> None:
        a, b = self.top(x), self.top(y)
        if a != b:
            self.up[max(a, b)] = min(a, b)
            self.joins.append((x, y))

    def batches(self) -> Iterator[pa.RecordBatch]:
        if self.joins:
            a, b = (pa.array(x, pa.int64()) for x in zip(*self.joins, strict=True))
            yield pa.RecordBatch.from_arrays([a, b], ["a", "b"])


def _connect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sets of a part connected by pairs that must be looked at with their full sets."""
    for rows in _parts(batches):
        i, j = _candidates(rows)
        node, forest = rows.column("node").to_numpy(), Forest()
        for x, y in zip(node[i].tolist(), node[j].tolist(), strict=True):
            forest.join(x, y)
        yield from forest.batches()


def _confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What joins groups, from full sets. Pairs of groups already joined are skipped."""
    for rows in _parts(batches):
        i, j = _candidates(rows)
        label, forest = rows.column("label").to_pylist(), Forest()
        sets = [np.asarray(s.values) for s in rows.column("shingles")]
        for x, y in zip(i.tolist(), j.tolist(), strict=True):
            if forest.top(label[x]) != forest.top(label[y]):
                shared = len(np.intersect1d(sets[x], sets[y], assume_unique=True))
                if similar(shared, len(sets[x]), len(sets[y])):
                    forest.join(label[x], label[y])
        yield from forest.batches()


def cross_links(
    docs: DataFrame, members: DataFrame, classes: DataFrame, labels: DataFrame
) -> DataFrame:
    """(a, b): groups with a link between them, from lists that hold several groups."""
    facts = classes.select("node", "n", "cells")
    rows = members.select("list", "node", "n", "place").join(labels, "node", "left")
    rows = rows.withColumn("label", F.coalesce("label", "node"))
    blocks = in_blocks(written(rows, "labelled")).join(facts.drop("n"), "node")
    near = components(_by_part(blocks).mapInArrow(_connect, "a long, b long"))
    near = near.select(F.col("component").alias("list"), F.col("id").alias("node"))
    rows = near.join(facts, "node").join(labels, "node", "left")
    rows = rows.select(
        "list", "node", "n", F.coalesce("label", "node").alias("label"), F.lit(0).alias("place")
    )
    rows = written(rows, "clusters")
    sets = full_sets(docs, rows.select("node"), classes).join(facts.drop("n"), "node")
    return _by_part(in_blocks(rows).join(sets, "node")).mapInArrow(_confirm, "a long, b long")


def jaccard_groups(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of ``docs(doc_id, text)``.

    Words are ``[^\\x20\\x09-\\x0D]+`` of the text with A-Z lower-cased, a set is the text's
    distinct three-word shingles (with fewer words the whole sequence). Rows are linked if
    the sets' Jaccard similarity is 0.9 or more; ``component_id`` is the smallest doc_id
    reachable over links.

    Null, empty and blank texts have no shingles, link with nothing and keep their own id.
    Rows that repeat a doc_id stay rows and share that id's component, even if their texts
    differ. Rows without doc_id link with nothing and have no component. Further columns are
    ignored; an empty table gives an empty result.
    """
    ready(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    level, heavy = survey(docs)
    signed = written(docs.mapInArrow(_signer(level, heavy), _SIGNED), "signed")
    classes = (
        signed.where("n > 0 and doc_id is not null")
        .groupBy("print1", "print2")
        .agg(F.min("doc_id").alias("rep"), *[F.first(c).alias(c) for c in ("n", "cells", "tokens")])
    )
    # Written at once, so that a class keeps its number.
    classes = written(classes.withColumn("node", F.monotonically_increasing_id()), "classes")
    rows = signed.select("doc_id", F.col("n").alias("n_shingles"), "print1", "print2").join(
        classes.select("print1", "print2", "node"), ["print1", "print2"], "left"
    )
    rows = written(rows.drop("print1", "print2"), "rows")
    # An id that stands for several sets ties them together.
    repeated = rows.where("node is not null").groupBy("doc_id")
    repeated = repeated.agg(F.min("node").alias("a"), F.max("node").alias("most")).where("a <> most")
    ties = rows.join(repeated.select("doc_id", "a"), "doc_id").where("node <> a")
    links = light_links(classes, heavy).union(ties.select("a", F.col("node").alias("b")))
    members = list_members(classes, heavy)
    links = links.union(star_links(docs, members, classes))
    labels = components(links).select(
        F.col("id").alias("node"), F.col("component").alias("label")
    )
    joined = components(cross_links(docs, members, classes, labels))
    tops = (
        classes.select("node", "rep")
        .join(labels, "node", "left")
        .withColumn("label", F.coalesce("label", "node"))
        .join(joined.select(F.col("id").alias("label"), F.col("component").alias("top")), "label", "left")
        .select("node", "rep", F.coalesce("top", "label").alias("top"))
    )
    tops = written(tops, "tops")
    least = tops.groupBy("top").agg(F.min("rep").alias("component_id"))
    found = tops.join(least, "top").select("node", "component_id")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return rows.join(found, "node", "left").select(
        "doc_id", "n_shingles", component.alias("component_id")
    )
