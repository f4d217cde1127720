"""Whole Arrow batches of texts as one byte array, cut into words by table lookup.

All helpers work on the UTF-8 bytes of a batch at once. A byte class is a table of 256
entries; as every byte of a non-ASCII character is 0x80 or above, word rules that treat all
such characters alike can be told from bytes.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

U64 = np.uint64


@dataclass
class Batch:
    """``data[start[i]:end[i]]`` are the UTF-8 bytes of text ``i``; a null text is empty."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray


def batch_of(column: pa.Array) -> Batch:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    wide = pa.types.is_large_string(column.type)
    kind = np.int64 if wide else np.int32
    if n == 0:
        none = np.zeros(0, np.int64)
        return Batch(np.zeros(0, np.uint8), none, none)
    _, offsets, values = column.buffers()
    at = np.frombuffer(offsets, kind, n + 1, column.offset * kind().itemsize).astype(np.int64)
    data = np.frombuffer(values, np.uint8) if values is not None else np.zeros(0, np.uint8)
    data = data[at[0] : at[-1]]
    at = at - at[0]
    start, end = at[:-1], at[1:].copy()
    if column.null_count:
        gone = np.asarray(column.is_null())
        end[gone] = start[gone]
    return Batch(data, start, end)


def byte_class(chars: str = "", *, spans=(), high: bool = False) -> np.ndarray:
    """Table of the bytes in ``chars``, in the inclusive ``spans``, and, if ``high``, of all
    bytes of non-ASCII characters."""
    table = np.zeros(256, bool)
    for c in chars:
        table[ord(c)] = True
    for low, top in spans:
        table[low : top + 1] = True
    if high:
        table[128:] = True
    return table


def lower_table() -> np.ndarray:
    """Lower-cases A-Z and leaves every other byte."""
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    return table


LOWER = lower_table()
# Words [^\x20\x09-\x0D]+
SPACED = ~byte_class(" ", spans=((9, 13),))
# Words [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ of lower-cased text
PLAIN = byte_class(spans=((48, 57), (97, 122)), high=True)


@dataclass
class Words:
    """Words of a batch: byte ranges, and for each text the range of its words."""

    start: np.ndarray
    end: np.ndarray
    first: np.ndarray
    last: np.ndarray


def words_of(batch: Batch, is_word: np.ndarray) -> Words:
    """Maximal runs of word bytes; a run never crosses from one text into the next."""
    inside = is_word[batch.data]
    n = len(inside)
    begins = np.empty(n, bool)
    ends = np.empty(n, bool)
    if n:
        begins[0], ends[-1] = inside[0], inside[-1]
        np.greater(inside[1:], inside[:-1], out=begins[1:])
        np.greater(inside[:-1], inside[1:], out=ends[:-1])
        cut = batch.start[(batch.start > 0) & (batch.start < n)]
        begins[cut] = inside[cut]
        ends[cut - 1] = inside[cut - 1]
    start = np.flatnonzero(begins)
    end = np.flatnonzero(ends) + 1
    return Words(
        start,
        end,
        np.searchsorted(start, batch.start, "left"),
        np.searchsorted(start, batch.end, "left"),
    )


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values, so that every output bit depends on every
    input bit (xor-shift and odd multiplications)."""
    x = x ^ (x >> U64(31))
    x *= U64(0x9FB21C651E98DF25)
    x ^= x >> U64(29)
    x *= U64(0xD6E8FEB86659FD93)
    x ^= x >> U64(32)
    return x


_SPAN = 1 << 16
_BASE = 0xA24BAED4963EE407  # odd


def _powers(base: int, n: int) -> np.ndarray:
    out = np.empty(n, np.uint64)
    out[0] = 1
    out[1:] = U64(base)
    return np.cumprod(out)


def word_hashes(data: np.ndarray, words: Words) -> np.ndarray:
    """64-bit hashes of the words' bytes: random values per byte, weighted by powers of an odd
    number by their place in the word, summed, and scrambled together with the length."""
    if len(words.start) == 0:
        return np.zeros(0, np.uint64)
    rng = np.random.default_rng(20240517)
    table = rng.integers(0, 2**63, 256, dtype=np.uint64) * U64(2) + U64(1)
    length = words.end - words.start
    longest = int(length.max())
    power = _powers(_BASE, max(longest, 1))
    # place of each byte in its word, for word bytes only
    total = int(length.sum())
    first = np.repeat(words.start - np.concatenate(([0], np.cumsum(length)[:-1])), length)
    at = first + np.arange(total)
    place = at - np.repeat(words.start, length)
    weighted = table[data[at]] * power[place]
    starts = np.concatenate(([0], np.cumsum(length)[:-1]))
    sums = np.add.reduceat(weighted, starts)
    return mix(sums + length.astype(np.uint64) * U64(0xC2B2AE3D27D4EB4F))
