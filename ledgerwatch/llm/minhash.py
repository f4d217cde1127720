"""Near duplicates by b-bit MinHash, confirmed on full shingle sets, grouped by reachability.

1. One pass over the texts gives each document its set size, a 128-bit print of its set, band
   keys over the full minima, and the low bits of all minima, packed.
2. Rows of equal sets are one class; from here on only class representatives count.
3. Each bucket of a band links its members to its smallest member. These stars are filtered by
   size and by the b-bit estimate, confirmed on full sets, and grouped.
4. Buckets that still hold members of different groups are compared in blocks, in tasks of
   bounded size: the pairs that size and b-bit estimate leave are confirmed on full sets, and
   a block gives back only what joins groups, never its pairs. So no link between different
   groups is lost, whatever the size of a bucket, and none is sought inside a group.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerwatch.llm.common import ready, written
from ledgerwatch.llm.components import components
from ledgerwatch.llm.textbatch import LOWER, SPACED, U64, batch_of, mix, word_hashes, words_of

SHINGLE = 5
# A pair at similarity 0.85 shares none of 30 bands of 6 rows with probability 7e-7.
BANDS = 30
ROWS = 6
# Low bits of each minimum that are kept. 180 minima estimate with a deviation of at most 0.04
# near 0.85; the margin is five of them, so that the estimate alone drops no linked pair.
BITS = 4
MARGIN = 0.16
LINK = (85, 100)
# Members of a bucket that one task compares with as many others.
BLOCK = 512


def shingle_sets(texts: pa.Array, width: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of every text, sorted, one after the other, and their counts.

    With fewer words than a shingle the whole sequence is one; without words the set is empty.
    """
    batch = batch_of(texts)
    data = LOWER[batch.data]
    words = words_of(batch, SPACED)
    hashes = word_hashes(data, words)
    n = words.last - words.first
    count = np.where(n == 0, 0, np.maximum(n - width + 1, 1))
    owner = np.repeat(np.arange(len(n)), count)
    total = int(count.sum())
    if not total:
        return np.zeros(0, np.uint64), count
    begin = np.repeat(words.first - np.concatenate(([0], np.cumsum(count)[:-1])), count)
    at = begin + np.arange(total)
    stop = words.last[owner]
    value = np.zeros(total, np.uint64)
    for j in range(width):
        here = at + j
        word = np.where(here < stop, hashes[np.minimum(here, len(hashes) - 1)], U64(j + 1))
        value = (value ^ word) * U64(0x9E6C63D0676A9A99) + U64(0x4F1BBCDC + j)
        value ^= value >> U64(32)
    value = mix(value)
    order = np.lexsort((value, owner))
    value, owner = value[order], owner[order]
    new = np.ones(total, bool)
    new[1:] = (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])
    return value[new], np.bincount(owner[new], minlength=len(n))


def _permutations() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(850)
    n = BANDS * ROWS
    return rng.integers(0, 2**32, n, dtype=np.uint32) | np.uint32(1), rng.integers(
        0, 2**32, n, dtype=np.uint32
    )


def minima(values: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Minima of each non-empty set under every permutation, as 32-bit numbers."""
    starts = np.concatenate(([0], np.cumsum(count)[:-1])).astype(np.int64)
    starts = starts[count > 0]
    a, b = _permutations()
    out = np.empty((len(starts), len(a)), np.uint32)
    if not len(starts):
        return out
    low = (values >> U64(32)).astype(np.uint32)
    for k in range(len(a)):
        out[:, k] = np.minimum.reduceat(low * a[k] + b[k], starts)
    return out


def pack_bits(found: np.ndarray) -> np.ndarray:
    """The low bits of the scrambled minima, two in a byte (the plain low bits of a linear
    permutation would depend on the low bits of its input alone)."""
    scrambled = mix(found.astype(np.uint64))
    low = (scrambled & U64((1 << BITS) - 1)).astype(np.uint8)
    return low[:, 0::2] | (low[:, 1::2] << np.uint8(BITS))


def band_keys(found: np.ndarray) -> np.ndarray:
    """One 64-bit key per band, of the full minima and the band's number."""
    keys = np.zeros((len(found), BANDS), np.uint64)
    for band in range(BANDS):
        key = np.full(len(found), band + 1, np.uint64)
        for row in range(ROWS):
            key = mix(key ^ found[:, band * ROWS + row].astype(np.uint64)) + U64(row)
        keys[:, band] = mix(key)
    return keys


def estimate(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Similarity of every packed signature of ``left`` with every one of ``right``: equal
    places by bit counts, corrected for places that are equal by chance."""
    n = BANDS * ROWS
    differ = np.zeros((len(left), len(right)), np.int32)
    low = np.uint64(0x1111111111111111)
    l64, r64 = _as_words(left), _as_words(right)
    for j in range(l64.shape[1]):
        x = l64[:, j, None] ^ r64[None, :, j]
        x |= x >> U64(2)
        x |= x >> U64(1)
        differ += np.bitwise_count(x & low)
    same = 1.0 - differ / n
    chance = 1.0 / (1 << BITS)
    return (same - chance) / (1.0 - chance)


def _as_words(signatures: np.ndarray) -> np.ndarray:
    width = signatures.shape[1]
    padded = np.zeros((len(signatures), -(-width // 8) * 8), np.uint8)
    padded[:, :width] = signatures
    return padded.view(np.uint64)


def _rows_of(flat: np.ndarray) -> pa.Array:
    """A fixed-width byte matrix as an array of binaries."""
    n, width = flat.shape
    offsets = np.arange(n + 1, dtype=np.int32) * width
    return pa.Array.from_buffers(
        pa.binary(), n, [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(flat))]
    )


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        values, count = shingle_sets(batch.column("text"))
        full = count > 0
        found = minima(values, count)
        prints = np.zeros((len(count), 2), np.int64)
        if len(found):
            starts = np.concatenate(([0], np.cumsum(count)[:-1]))[full]
            sums = [np.add.reduceat(mix(values ^ U64(s)), starts) for s in (0x51, 0xA7)]
            prints[full] = np.stack(sums, axis=1).view(np.int64)
        at = np.cumsum(full) - 1
        at[~full] = 0
        bits = pack_bits(found) if len(found) else np.zeros((1, BANDS * ROWS // 2), np.uint8)
        keys = band_keys(found) if len(found) else np.zeros((1, BANDS), np.uint64)
        keys = np.ascontiguousarray(keys)
        band = pa.ListArray.from_arrays(
            pa.array(np.arange(len(count) + 1, dtype=np.int32) * BANDS),
            pa.array(keys[at].view(np.int64).ravel()),
        )
        out = {
            "doc_id": batch.column("doc_id"),
            "n_shingles": pa.array(count.astype(np.int64)),
            "print1": pa.array(prints[:, 0], mask=~full),
            "print2": pa.array(prints[:, 1], mask=~full),
            "bits": _rows_of(bits[at]),
            "bands": band,
        }
        yield pa.RecordBatch.from_pydict(out)


_SIGNED = (
    "doc_id long, n_shingles long, print1 long, print2 long, bits binary, bands array<long>"
)


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        values, count = shingle_sets(batch.column("text"))
        offsets = np.concatenate(([0], np.cumsum(count))).astype(np.int32)
        sets = pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.view(np.int64)))
        yield pa.RecordBatch.from_arrays([batch.column("id"), sets], ["id", "shingles"])


def similar(shared, left, right):
    """100 * intersection >= 85 * union, from whole numbers."""
    return LINK[1] * shared >= LINK[0] * (left + right - shared)


def _survivors(group: dict[str, np.ndarray], side: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of a block that must be confirmed: of different groups, of close sizes, in
    no earlier band together, and above the estimate's margin."""
    left = np.flatnonzero(side != 1)
    right = np.flatnonzero(side != 0)
    n = group["n"]
    a, b = n[left][:, None], n[right][None, :]
    ok = LINK[1] * np.minimum(a, b) >= LINK[0] * np.maximum(a, b)
    ok &= group["label"][left][:, None] != group["label"][right][None, :]
    same = left[:, None] == right[None, :]
    ok &= ~same
    both = (side[left][:, None] == 2) & (side[right][None, :] == 2)
    ok &= ~both | (left[:, None] < right[None, :])
    if ok.any():
        ok &= estimate(group["bits"][left], group["bits"][right]) >= LINK[0] / LINK[1] - MARGIN
    if ok.any():
        bands = group["bands"]
        for k in range(BANDS):
            earlier = k < group["band"]
            if not earlier:
                break
            ok &= bands[left, k][:, None] != bands[right, k][None, :]
    i, j = np.nonzero(ok)
    return left[i], right[j]


def _joined(group: dict, i: np.ndarray, j: np.ndarray) -> list[tuple[int, int]]:
    """Confirms pairs on full sets until all groups that touch are joined."""
    up: dict[int, int] = {}

    def top(x: int) -> int:
        while up.setdefault(x, x) != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    out = []
    label, sets, n = group["label"], group["sets"], group["n"]
    for x in np.unique(i):
        mine = sets[x]
        for y in j[i == x]:
            a, b = top(int(label[x])), top(int(label[y]))
            if a == b:
                continue
            at = np.searchsorted(mine, sets[y])
            shared = int((mine[np.minimum(at, len(mine) - 1)] == sets[y]).sum())
            if similar(shared, int(n[x]), int(n[y])):
                up[max(a, b)] = min(a, b)
                out.append((int(label[x]), int(label[y])))
    return out


def _block_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Whole groups of (bucket, part) from batches sorted by them."""
    held: pa.Table | None = None
    for batch in batches:
        rows = pa.Table.from_batches([batch])
        rows = pa.concat_tables([held, rows]) if held is not None else rows
        key = [rows.column(c).to_numpy() for c in ("bucket", "part")]
        cut = np.flatnonzero((key[0][1:] != key[0][:-1]) | (key[1][1:] != key[1][:-1])) + 1
        at = 0
        for stop in cut:
            yield rows.slice(at, stop - at)
            at = int(stop)
        held = rows.slice(at).combine_chunks()
    if held is not None and held.num_rows:
        yield held


def _unpack(rows: pa.Table) -> dict:
    def fixed(name: str, kind) -> np.ndarray:
        flat = b"".join(rows.column(name).to_pylist())
        return np.frombuffer(flat, kind).reshape(rows.num_rows, -1)

    bands = rows.column("bands").combine_chunks()
    if isinstance(bands, pa.ChunkedArray):
        bands = pa.concat_arrays(bands.chunks)
    bands = np.asarray(bands.flatten()).reshape(rows.num_rows, BANDS)
    bucket = rows.column("bucket")[0].as_py()
    return {
        "id": rows.column("id").to_numpy(),
        "label": rows.column("label").to_numpy(),
        "n": rows.column("n").to_numpy(),
        "bits": fixed("bits", np.uint8),
        "bands": bands,
        "band": int(np.flatnonzero(bands[0] == bucket)[0]),
    }


def _flag(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Members of a block that some member of another group may be linked with."""
    for rows in _block_groups(batches):
        group = _unpack(rows)
        i, j = _survivors(group, rows.column("side").to_numpy())
        if len(i):
            needed = np.unique(np.concatenate((i, j)))
            for batch in rows.select(["bucket", "part", "id", "side"]).take(needed).to_batches():
                yield batch


def _confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows in _block_groups(batches):
        group = _unpack(rows)
        sets = rows.column("shingles").combine_chunks()
        if isinstance(sets, pa.ChunkedArray):
            sets = pa.concat_arrays(sets.chunks)
        flat, offsets = np.asarray(sets.flatten()).view(np.uint64), np.asarray(sets.offsets)
        offsets = offsets - offsets[0]
        group["sets"] = [flat[a:b] for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
        i, j = _survivors(group, rows.column("side").to_numpy())
        joined = _joined(group, i, j)
        if joined:
            a, b = zip(*joined, strict=True)
            yield pa.RecordBatch.from_pydict({"a": pa.array(a), "b": pa.array(b)})


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of ``docs(doc_id, text)``.

    Documents are linked if 100 * shared >= 85 * united shingles; ``component_id`` is the
    smallest doc_id reachable over links. Null and empty texts have no shingles and link with
    nothing. Rows that repeat a doc_id stay rows and share that id's component, even if their
    texts differ. Rows without doc_id are linked with nothing, have no component, and are
    kept. Further columns are ignored. An empty table gives an empty result.
    """
    spark = ready(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    signed = written(docs.mapInArrow(_sign, _SIGNED), "signed")
    able = signed.where("n_shingles > 0 and doc_id is not null")
    # One row per distinct set. Its signature is the same in all its rows.
    classes = written(
        able.groupBy("print1", "print2").agg(
            F.min("doc_id").alias("id"),
            F.first("n_shingles").alias("n"),
            F.first("bits").alias("bits"),
            F.first("bands").alias("bands"),
        ),
        "classes",
    )
    members = _bucket_members(classes)
    sets = _full_sets(docs, members)
    stars = _star_links(members, classes, sets)
    grouped = written(components(stars), "groups")
    more = _cross_links(members, classes, sets, grouped)
    joined = components(more)
    labels = classes.select("print1", "print2", "id")
    label = F.coalesce("label", "id")
    labels = (
        labels.join(grouped.withColumnRenamed("component", "label"), "id", "left")
        .withColumn("label", label)
        .join(joined.withColumnRenamed("id", "label"), "label", "left")
        .select("print1", "print2", "id", F.coalesce("component", "label").alias("component"))
    )
    return _per_row(spark, signed, labels)


def _per_row(spark, signed: DataFrame, labels: DataFrame) -> DataFrame:
    """Components of classes brought to rows. Ids that occur in several classes (rows that
    repeat an id with other texts) tie those classes together."""
    labels = written(labels, "labels")
    rows = written(
        signed.select("doc_id", "n_shingles", "print1", "print2").join(
            labels.select("print1", "print2", "component"), ["print1", "print2"], "left"
        ),
        "rows",
    )
    repeated = (
        rows.where("doc_id is not null and component is not null")
        .groupBy("doc_id")
        .agg(F.min("component").alias("a"), F.max("component").alias("b"))
    )
    ties = (
        rows.join(repeated.where("a <> b").select("doc_id", "a"), "doc_id")
        .select("a", F.col("component").alias("b"))
        .where("b is not null")
    )
    tied = components(ties)
    component = F.coalesce("top", "component", "doc_id")
    return (
        rows.join(
            tied.select(F.col("id").alias("component"), F.col("component").alias("top")),
            "component",
            "left",
        )
        .withColumn("component_id", F.when(F.col("doc_id").isNotNull(), component))
        .select(
            "doc_id",
            "n_shingles",
            "component_id",
            F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"),
        )
    )


def _bucket_members(classes: DataFrame) -> DataFrame:
    """(bucket, id, center) of all buckets with more than one member."""
    rows = classes.select("id", F.explode("bands").alias("bucket"))
    sizes = rows.groupBy("bucket").agg(
        F.min("id").alias("center"), F.max("id").alias("other"), F.count("*").alias("size")
    )
    sizes = sizes.where("size > 1 and center <> other").drop("other", "size")
    return written(rows.join(sizes, "bucket"), "members")


def _full_sets(docs: DataFrame, members: DataFrame) -> DataFrame:
    """(id, shingles) of the classes that share a bucket, from a second pass over their texts."""
    wanted = members.select(F.col("id").alias("doc_id")).distinct()
    texts = docs.join(wanted, "doc_id", "left_semi")
    texts = texts.select(F.col("doc_id").alias("id"), "text")
    return written(texts.mapInArrow(_sets, "id long, shingles array<long>"), "sets")


def _star_links(members: DataFrame, classes: DataFrame, sets: DataFrame) -> DataFrame:
    """Confirmed links (a, b) between the members of buckets and their smallest member."""
    pairs = members.where("id <> center").select("id", "center").distinct()
    signs = classes.select("id", "n", "bits")
    pairs = pairs.join(signs, "id").join(
        signs.select(*(F.col(c).alias(f"c_{c}") for c in signs.columns)),
        F.col("center") == F.col("c_id"),
    )
    lower, upper = F.least("n", "c_n"), F.greatest("n", "c_n")
    pairs = pairs.where(LINK[1] * lower >= LINK[0] * upper)
    pairs = pairs.where(_estimate_column("bits", "c_bits") >= LINK[0] / LINK[1] - MARGIN)
    left = sets.select("id", F.col("shingles").alias("mine"))
    right = sets.select(F.col("id").alias("center"), F.col("shingles").alias("other"))
    pairs = pairs.select("id", "center").join(left, "id").join(right, "center")
    shared = F.size(F.array_intersect("mine", "other")).cast("long")
    return pairs.where(similar(shared, F.size("mine"), F.size("other"))).select(
        F.col("id").alias("a"), F.col("center").alias("b")
    )


def _estimate_column(left: str, right: str):
    """The b-bit estimate of two packed signatures as a column: hexadecimal digits are the
    kept bits of one minimum each, so equal digits are equal places."""
    n = BANDS * ROWS
    equal = F.expr(
        f"aggregate(sequence(1, {n // 12}), 0L, (s, i) -> s + bit_count("
        f"{_folded(left, right)}))"
    )
    same = 1.0 - equal / n
    chance = 1.0 / (1 << BITS)
    return (same - chance) / (1.0 - chance)


def _folded(left: str, right: str) -> str:
    """Bits that mark the unequal places among the ``i``-th twelve."""
    part = "cast(conv(substr(hex({0}), (i - 1) * 12 + 1, 12), 16, 10) as long)"
    x = f"({part.format(left)} ^ {part.format(right)})"
    x = f"({x} | shiftright({x}, 2))"
    x = f"({x} | shiftright({x}, 1))"
    return f"({x} & {0x111111111111}L)"


def _cross_links(
    members: DataFrame, classes: DataFrame, sets: DataFrame, grouped: DataFrame
) -> DataFrame:
    """(a, b): groups with a link between them, sought in buckets that hold several groups."""
    labelled = members.select("bucket", "id").join(
        grouped.select("id", F.col("component").alias("label")), "id", "left"
    )
    labelled = written(
        labelled.select("bucket", "id", F.coalesce("label", "id").alias("label")), "labelled"
    )
    counts = labelled.groupBy("bucket", "label").agg(F.count("*").alias("k"))
    mixed = (
        counts.groupBy("bucket")
        .agg(
            F.count("*").alias("labels"),
            F.sum("k").alias("size"),
            F.max(F.struct("k", "label")).alias("most"),
        )
        .where("labels > 1")
        .select(
            "bucket",
            "size",
            F.col("most.label").alias("main"),
            F.greatest(F.lit(1), F.ceil((F.col("size") - F.col("most.k")) / BLOCK)).alias("rest"),
            F.greatest(F.lit(1), F.ceil(F.col("most.k") / BLOCK)).alias("mains"),
        )
    )
    rows = labelled.join(mixed, "bucket")
    # Blocks 0 .. rest-1 hold all but the largest group, the others hold that group. Two
    # blocks of the largest group are never compared. A small bucket is one part.
    in_main = F.col("label") == F.col("main")
    draw = F.pmod(F.xxhash64("id", "bucket"), F.when(in_main, F.col("mains")).otherwise(F.col("rest")))
    rows = rows.withColumn(
        "block", F.when(in_main, F.col("rest") + draw).otherwise(draw)
    ).withColumn(
        "partner",
        F.explode(
            F.when(F.col("size") <= BLOCK, F.array(F.lit(-1).cast("long")))
            .when(in_main, F.sequence(F.lit(0).cast("long"), F.col("rest") - 1))
            .otherwise(F.sequence(F.lit(0).cast("long"), F.col("rest") + F.col("mains") - 1))
        ),
    )
    low, high = F.least("block", "partner"), F.greatest("block", "partner")
    alone = F.col("partner") == -1
    rows = rows.select(
        "bucket",
        F.when(alone, 0).otherwise(low * (F.col("rest") + F.col("mains")) + high).alias("part"),
        "id",
        "label",
        # 0 and 1: the two blocks of a pair; 2: compared with all of the part
        F.when(alone | (low == high), 2).when(F.col("block") == low, 0).otherwise(1).alias("side"),
    )
    rows = rows.join(classes.select("id", "n", "bits", "bands"), "id")
    rows = written(rows, "blocks")
    flagged = _by_part(rows).mapInArrow(_flag, "bucket long, part long, id long, side int")
    flagged = written(flagged, "flagged")
    again = rows.join(flagged, ["bucket", "part", "id", "side"], "left_semi").join(sets, "id")
    return _by_part(again).mapInArrow(_confirm, "a long, b long")


def _by_part(rows: DataFrame) -> DataFrame:
    return rows.repartition("bucket", "part").sortWithinPartitions("bucket", "part", "id", "side")
