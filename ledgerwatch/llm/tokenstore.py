"""Token ids in frequency rank order, in a byte-aligned code with separate control bytes.

A store is a folder with two tables. ``ranks``: (rank, id, n), the ids by falling count.
``blocks``: runs of consecutive documents in ascending doc_id order, each with the documents'
ids and lengths, the number of ids of all documents before the block, one control byte for
every four values, and the values' bytes. A value is the rank of an id in one to four bytes,
least first; its control bits hold the number of bytes less one. Both are written and read by
Spark, so any store it can reach will do, and a repeated task replaces its own output.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerwatch.llm.common import ready, shared_path, wide_hash

# Distinct words whose ids a worker remembers; beyond it starts afresh.
REMEMBERED = 1 << 20
# A block ends with the document that takes it to so many values.
BLOCK_VALUES = 1 << 19


class WordEncoder:
    """Encodes texts with a tokenizer that drops white space, word by word, remembering words.

    Such a tokenizer never joins characters across a blank, so the ids of a text are those of
    its blank-separated pieces. Texts that may hold special tokens go to the library whole.
    """

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        vocabulary = self.tokenizer.get_vocab()
        # Whether an id ends a word; without word ends, words are encoded one by one.
        self.ends_word = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends_word[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.tails = (",", ".")
        self.forget()

    def forget(self) -> None:
        self.slots = _Slots()
        self.flat = np.zeros(1 << 16, np.uint32)
        self.start = np.zeros(1 << 15, np.int64)
        self.count = np.zeros(1 << 15, np.int32)
        self.known = self.used = 0

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts one after the other, and their numbers."""
        if len(self.slots) > REMEMBERED:
            self.forget()
        words: list[str] = []
        ends = [0]
        whole = {}
        for i, text in enumerate(texts):
            text = text or ""
            if any(s in text for s in self.special):
                whole[i] = np.array(
                    self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32
                )
            else:
                blank = text.replace("\n", " ").replace("\t", " ").replace("\r", " ")
                words += blank.split(" ")
            ends.append(len(words))
        at = np.fromiter(map(self.slots.__getitem__, words), np.int64, len(words))
        self._learn()
        count = self.count[at].astype(np.int64)
        total = np.concatenate(([0], np.cumsum(count)))
        base = np.repeat(self.start[at] - total[:-1], count)
        ids = self.flat[base + np.arange(total[-1])]
        lengths = np.diff(total[np.array(ends)])
        if whole:
            parts = np.split(ids, np.cumsum(lengths)[:-1])
            for i, own in whole.items():
                parts[i], lengths[i] = own, len(own)
            ids = np.concatenate(parts)
        return ids, lengths

    def _learn(self) -> None:
        """Ids of the words met since the last call. A word of letters is one piece to the
        tokenizer, so many of them are encoded as one text and cut where words end; a word
        with a comma or full stop behind it, or with ASCII capitals, has the ids of the plain
        word (and of the sign). All others are encoded one by one."""
        fresh, first = self.slots.fresh, self.known
        plain, single, composed = [], [], []
        i = 0
        while i < len(fresh):  # grows by plain words that were not met yet
            word = fresh[i]
            core, tail = (word[:-1], word[-1]) if word[-1:] in self.tails else (word, "")
            if core.isascii():
                core = core.lower()
            if not core.isalpha():
                single.append(i)
            elif core == word:
                plain.append(i)
            else:
                composed.append((first + i, self.slots[core], tail))
            i += 1
        self.slots.fresh = []
        self.known += len(fresh)
        self.start, self.count = _room(self.start, self.known), _room(self.count, self.known)
        for at in range(0, len(plain), 1000):
            own = plain[at : at + 1000]
            ids = self._ids(" ".join([fresh[i] for i in own]))
            ends = np.flatnonzero(self.ends_word[ids]) + 1
            if len(ends) == len(own):
                count = np.diff(np.concatenate(([0], ends)))
                self._keep(first + np.array(own), ids, count)
            else:
                single += own
        if single:
            found = self.tokenizer.encode_batch_fast(
                [fresh[i] for i in single], add_special_tokens=False
            )
            found = [e.ids for e in found]
            ids = np.array([x for own in found for x in own], np.uint32)
            self._keep(first + np.array(single), ids, np.array([len(x) for x in found]))
        for tail in ("", *self.tails):
            pairs = [(slot, core) for slot, core, t in composed if t == tail]
            if not pairs:
                continue
            slot, core = np.array(pairs).T
            if not tail:
                self.start[slot], self.count[slot] = self.start[core], self.count[core]
                continue
            more = self._ids(tail)
            count = self.count[core].astype(np.int64)
            stop = np.cumsum(count + len(more))
            begin = stop - count - len(more)
            ids = np.empty(int(stop[-1]), np.uint32)
            within = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            ids[np.repeat(begin, count) + within] = self.flat[
                np.repeat(self.start[core], count) + within
            ]
            for k, value in enumerate(more):
                ids[begin + count + k] = value
            self._keep(slot, ids, count + len(more))

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)

    def _keep(self, slots: np.ndarray, ids: np.ndarray, count: np.ndarray) -> None:
        self.flat = _room(self.flat, self.used + len(ids))
        self.flat[self.used : self.used + len(ids)] = ids
        self.start[slots] = self.used + np.cumsum(count) - count
        self.count[slots] = count
        self.used += len(ids)


class _Slots(dict):
    """Word to its place among the remembered; an unknown word gets the next place."""

    def __init__(self) -> None:
        self.fresh: list[str] = []

    def __missing__(self, word: str) -> int:
        place = self[word] = len(self)
        self.fresh.append(word)
        return place


def _room(array: np.ndarray, n: int) -> np.ndarray:
    if n <= len(array):
        return array
    larger = np.zeros(max(n, 2 * len(array)), array.dtype)
    larger[: len(array)] = array
    return larger


_ENCODERS: dict[str, WordEncoder] = {}


def _encoder(path: str) -> WordEncoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def _tokenise(path: str, end_id: int):
    """Sorted documents to their ids; each row knows its range, its place in it, and the
    number of ids before it there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(path)
        range_no, seq, before = TaskContext.get().partitionId(), 0, 0
        for batch in batches:
            ids, count = encoder.encode(batch.column("text").to_pylist())
            out = np.full(len(ids) + len(count), end_id, np.uint32)
            stop = np.cumsum(count + 1)
            out[np.arange(len(ids)) + np.repeat(np.arange(len(count)), count)] = ids
            n = len(count)
            start = stop - count - 1
            kind = np.uint16 if encoder.tokenizer.get_vocab_size() <= 1 << 16 else np.uint32
            data = out.astype(kind)
            offsets = (np.concatenate(([0], stop)) * data.itemsize).astype(np.int32)
            binary = pa.Array.from_buffers(
                pa.binary(), n, [None, pa.py_buffer(offsets), pa.py_buffer(data)]
            )
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(n, range_no, np.int64)),
                    pa.array(np.arange(seq, seq + n, dtype=np.int64)),
                    pa.array(before + start.astype(np.int64)),
                    batch.column("doc_id"),
                    pa.array((count + 1).astype(np.int64)),
                    pa.array(np.full(n, data.itemsize, np.int32)),
                    binary,
                ],
                ["range_no", "seq", "before", "doc_id", "n_tokens", "width", "ids"],
            )
            seq += n
            before += int(stop[-1]) if n else 0

    return run


_TOKENS = (
    "range_no long, seq long, before long, doc_id long, n_tokens long, width int, ids binary"
)


def _values(batch: pa.RecordBatch, name: str = "ids") -> np.ndarray:
    width = batch.column("width")[0].as_py()
    column = batch.column(name)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int32, len(column) + 1, column.offset * 4)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]].view(np.uint16 if width == 2 else np.uint32)


def _count_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(0, np.int64)
    for batch in batches:
        if not batch.num_rows:
            continue
        own = np.bincount(_values(batch))
        if len(own) > len(total):
            total, own = own, total
        total[: len(own)] += own
    used = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays(
        [pa.array(used.astype(np.int64)), pa.array(total[used].astype(np.int64))], ["id", "n"]
    )


def pack(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(control bytes, data bytes) of whole numbers below 2**32."""
    values = np.ascontiguousarray(values, "<u4")
    size = 1 + (values > 0xFF).astype(np.uint8) + (values > 0xFFFF) + (values > 0xFFFFFF)
    data = values.view(np.uint8).reshape(-1, 4)[np.arange(4) < size[:, None]]
    code = np.zeros(-(-len(values) // 4) * 4, np.uint8)
    code[: len(values)] = size - 1
    code = code.reshape(-1, 4)
    return code[:, 0] | code[:, 1] << 2 | code[:, 2] << 4 | code[:, 3] << 6, data


# Sizes of the four values of each control byte.
_SIZES = (np.arange(256)[:, None] >> np.array([0, 2, 4, 6]) & 3).astype(np.uint8) + 1
_MASKS = np.array([0, 0xFF, 0xFFFF, 0xFFFFFF, 0xFFFFFFFF], np.uint32)


def unpack(control: np.ndarray, data: np.ndarray, n: int) -> np.ndarray:
    """The ``n`` values of ``pack``: sizes by table lookup, then one gather of four bytes each
    that a mask cuts to size."""
    size = _SIZES[control].ravel()[:n]
    at = np.cumsum(size, dtype=np.int64) - size
    padded = np.concatenate((data, np.zeros(3, np.uint8)))
    out = padded[at].astype(np.uint32)
    for k in (1, 2, 3):
        longer = np.flatnonzero(size > k)
        if not len(longer):
            break
        out[longer] |= padded[at[longer] + k].astype(np.uint32) << np.uint32(8 * k)
    return out & _MASKS[size]


def _pack_blocks(rank_of: np.ndarray, base: dict[int, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        follow = None

        def block() -> pa.RecordBatch:
            range_no, seq, before = held[0][0]
            values = np.concatenate([v for _, _, v in held])
            control, data = pack(rank_of[values])
            row = {
                "range_no": [range_no],
                "seq": [seq],
                "start": [base[range_no] + before],
                "doc_ids": [[d for _, d, _ in held]],
                "counts": [[len(v) for _, _, v in held]],
                "control": [control.tobytes()],
                "data": [data.tobytes()],
            }
            held.clear()
            return pa.RecordBatch.from_pydict(row, schema=_BLOCK_SCHEMA)

        size = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            values = _values(batch)
            keys = list(zip(*(batch.column(c).to_pylist() for c in ("range_no", "seq", "before")), strict=True))
            stops = np.cumsum(batch.column("n_tokens").to_numpy())
            parts = np.split(values, stops[:-1])
            for key, doc, own in zip(keys, batch.column("doc_id").to_pylist(), parts, strict=True):
                # Rows of a file come in order; another file, or another part of it, begins
                # another block.
                if held and (size >= BLOCK_VALUES or (key[0], key[1]) != follow):
                    yield block()
                    size = 0
                held.append((key, doc, own))
                size += len(own)
                follow = (key[0], key[1] + 1)
        if held:
            yield block()

    return run


_BLOCK_SCHEMA = pa.schema(
    [
        ("range_no", pa.int64()),
        ("seq", pa.int64()),
        ("start", pa.int64()),
        ("doc_ids", pa.list_(pa.int64())),
        ("counts", pa.list_(pa.int64())),
        ("control", pa.binary()),
        ("data", pa.binary()),
    ]
)
_BLOCK_SQL = (
    "range_no long, seq long, start long, doc_ids array<long>, counts array<long>, "
    "control binary, data binary"
)


def write_tokens(docs: DataFrame, folder: str, tokenizer: str, end_id: int) -> None:
    """Encode every text of ``docs(doc_id, text)`` and write the store to ``folder``.

    Each document is followed by ``end_id``. Documents go in ascending order of doc_id, null
    ids first; rows that share an id are ordered by a hash of their text, and equal rows are
    interchangeable. A null text is empty. An empty table gives a store without blocks.
    """
    spark = ready(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    key1, _ = wide_hash(F.col("text"))
    # The texts are dealt by ranges before they are encoded, so each is encoded once.
    dealt = docs.withColumn("tie", key1).repartitionByRange("doc_id", "tie")
    dealt = dealt.sortWithinPartitions("doc_id", "tie").select("doc_id", "text")
    tokens_path = f"{folder}/tokens"
    tokens = dealt.mapInArrow(_tokenise(tokenizer, end_id), _TOKENS)
    tokens.write.option("compression", "zstd").parquet(tokens_path)
    tokens = spark.read.schema(_TOKENS).parquet(tokens_path)

    counts = tokens.select("width", "ids").mapInArrow(_count_ids, "id long, n long")
    counts = counts.groupBy("id").agg(F.sum("n").alias("n"))
    # One row per id in use: bounded by the vocabulary.
    ranked = sorted(((r.id, r.n) for r in counts.collect()), key=lambda x: (-x[1], x[0]))
    ids = np.array([i for i, _ in ranked], np.int64)
    table = pa.Table.from_pydict(
        {"rank": np.arange(len(ids)), "id": ids, "n": np.array([n for _, n in ranked], np.int64)}
    )
    spark.createDataFrame(table.to_pandas(), "rank long, id long, n long").coalesce(
        1
    ).write.parquet(f"{folder}/ranks")
    rank_of = np.zeros(int(ids.max()) + 1 if len(ids) else 1, np.uint32)
    rank_of[ids] = np.arange(len(ids))

    sums = tokens.groupBy("range_no").agg(F.sum("n_tokens").alias("n"))
    base, before = {}, 0
    for row in sums.orderBy("range_no").toLocalIterator():  # one row per range
        base[row.range_no] = before
        before += row.n
    blocks = tokens.mapInArrow(_pack_blocks(rank_of, base), _BLOCK_SQL)
    blocks.write.option("compression", "none").parquet(f"{folder}/blocks")


def _unpack_blocks(id_of: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                counts = np.array(row["counts"], np.int64)
                ranks = unpack(
                    np.frombuffer(row["control"], np.uint8),
                    np.frombuffer(row["data"], np.uint8),
                    int(counts.sum()),
                )
                data = id_of[ranks].astype("<u4")
                stop = np.cumsum(counts)
                offsets = (np.concatenate(([0], stop)) * 4).astype(np.int32)
                start = row["start"] + stop - counts
                binary = pa.Array.from_buffers(
                    pa.binary(), len(counts), [None, pa.py_buffer(offsets), pa.py_buffer(data)]
                )
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(row["doc_ids"], pa.int64()),
                        pa.array(start.astype(np.int64)),
                        pa.array(counts),
                        binary,
                    ],
                    ["doc_id", "start", "n_tokens", "ids"],
                )

    return run


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        crc = [zlib.crc32(x.as_buffer()) for x in batch.column("ids")]
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(c) for c in ("doc_id", "start", "n_tokens")), pa.array(crc, pa.int64())],
            ["doc_id", "start", "n_tokens", "ids_crc32"],
        )


def read_tokens(spark: SparkSession, folder: str, digest: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of a store, ids as little-endian 32-bit numbers; with
    ``digest`` their crc32 in place of them."""
    ready(spark)
    ranks = spark.read.parquet(f"{folder}/ranks").orderBy("rank").select("id").collect()
    id_of = np.array([r.id for r in ranks], np.uint32)
    decode = _unpack_blocks(id_of)
    blocks = spark.read.schema(_BLOCK_SQL).parquet(f"{folder}/blocks")
    if not digest:
        return blocks.mapInArrow(decode, "doc_id long, start long, n_tokens long, ids binary")
    return blocks.mapInArrow(
        lambda batches: _digest(decode(batches)),
        "doc_id long, start long, n_tokens long, ids_crc32 long",
    )


def token_store(docs: DataFrame, tokenizer: str, end_id: int = 1) -> DataFrame:
    """Write a store below the shared folder and return what is read back from it:
    (doc_id, start, n_tokens, ids_crc32)."""
    folder = shared_path(docs.sparkSession, "token-store")
    write_tokens(docs, folder, tokenizer, end_id)
    return read_tokens(docs.sparkSession, folder, digest=True)
