"""Runs of repeated word sequences, by a suffix automaton under a link-cut tree.

Words are appended one at a time. The suffix links of the automaton form a tree in which the
path from a prefix's state to the root holds all its suffixes; every state remembers where its
strings ended last. Appending word ``i`` recolours that path: the access operation of the
link-cut tree walks it by segments of one colour. A segment of colour ``e`` whose deepest
state has length ``m`` says that the last ``m`` words ended at ``e`` before, and no longer
suffix did. If the distance ``i - e`` is at most ``m``, that is a square; if twice the distance
is, the period has stood three times. The stretch it covers cannot grow to the left, and as
the next words report the same start and period until the period breaks, the last report is
the whole run.

Automata are built over stretches only in which every sequence of eight words occurs again:
a run of 24 words or more, three periods long, lies in such a stretch as a whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerwatch.llm.common import ready
from ledgerwatch.llm.textbatch import SPACED, U64, batch_of, mix, word_hashes, words_of

# A run has at least so many words and so many periods.
LEAST_WORDS = 24
LEAST_PERIODS = 3
# With l >= 24 and period q <= l / 3, each of the l - 7 sequences of eight words of a run has
# an equal one q words before or behind it in the run, as l - 2q >= 8.
GRAM = LEAST_WORDS // LEAST_PERIODS

RUN = "struct<start: long, length: long, period: long>"


class LinkCutAutomaton:
    """Suffix automaton, built word by word, whose suffix links are kept as a link-cut tree.

    State 0 is none, 1 the root. Splay trees hold preferred paths, in order of depth. All
    states of a preferred path were last visited by the same access, so their colour, the
    place where their strings ended last, is kept once, at the root of the splay tree.
    """

    def __init__(self) -> None:
        self.length = [0, 0]
        self.link = [0, 0]
        self.after: list[dict[int, int]] = [{}, {}]
        self.last = 1
        self.left = [0, 0]
        self.right = [0, 0]
        self.up = [0, 0]
        self.colour = [-1, -1]

    def _state(self, length: int, after: dict[int, int]) -> int:
        self.length.append(length)
        self.link.append(0)
        self.after.append(after)
        self.left.append(0)
        self.right.append(0)
        self.up.append(0)
        self.colour.append(-1)
        return len(self.length) - 1

    def append(self, word: int) -> int:
        """The state of the text so far, one word longer; it is a leaf with no colour yet."""
        after, link, length, up = self.after, self.link, self.length, self.up
        state = self._state(length[self.last] + 1, {})
        p = self.last
        self.last = state
        while p and word not in after[p]:
            after[p][word] = state
            p = link[p]
        if not p:
            above = 1
        else:
            above = after[p][word]
            if length[p] + 1 != length[above]:
                above = self._split(p, above, word)
        link[state] = above
        up[state] = above
        return state

    def _split(self, p: int, low: int, word: int) -> int:
        """A copy of ``low`` for its shorter strings, put between it and its parent. Both
        have ended at the same places so far, so the copy joins the preferred path of ``low``."""
        after, link = self.after, self.link
        copy = self._state(self.length[p] + 1, after[low].copy())
        link[copy] = link[low]
        link[low] = copy
        while p and after[p].get(word) == low:
            after[p][word] = copy
            p = link[p]
        self._splay(low)
        above = self.left[low]
        self.left[copy] = above
        if above:
            self.up[above] = copy
        self.left[low] = copy
        self.up[copy] = low
        return copy

    def _splay(self, x: int) -> None:
        """Makes ``x`` the root of its splay tree and gives it the tree's colour."""
        left, right, up = self.left, self.right, self.up
        y = up[x]
        if not y or (left[y] != x and right[y] != x):
            return
        while True:
            y = up[x]
            if not y or (left[y] != x and right[y] != x):
                break
            z = up[y]
            zig = left[y] == x
            top = z and (left[z] == y or right[z] == y)
            if top and (left[z] == y) == zig:
                self._rotate(y, z, zig)
                self._rotate(x, y, zig)
            else:
                self._rotate(x, y, zig)
                if top:
                    self._rotate(x, z, not zig)
            root = z if top else y
        self.colour[x] = self.colour[root]

    def _rotate(self, x: int, y: int, zig: bool) -> None:
        """Turns ``x`` above its parent ``y``; ``zig`` says that it is the left child."""
        left, right, up = self.left, self.right, self.up
        z = up[y]
        if z:
            if left[z] == y:
                left[z] = x
            elif right[z] == y:
                right[z] = x
        up[x] = z
        if zig:
            child = right[x]
            left[y] = child
            right[x] = y
        else:
            child = left[x]
            right[y] = child
            left[x] = y
        if child:
            up[child] = y
        up[y] = x

    def access(self, state: int, place: int) -> list[tuple[int, int]]:
        """Gives the whole path above ``state`` the colour ``place``. Returns, for each of its
        segments of one earlier colour, that colour and the length of its deepest state."""
        right, up, colour, length = self.right, self.up, self.colour, self.length
        found = []
        below, x = 0, state
        while x:
            self._splay(x)
            cut = right[x]
            if cut:
                colour[cut] = colour[x]
            right[x] = below
            if below:
                up[below] = x
            if colour[x] >= 0:
                found.append((colour[x], length[x]))
            below = x
            x = up[x]
        colour[below] = place
        self._splay(state)
        return found


def runs_of(words: list[int]) -> list[tuple[int, int, int]]:
    """(start, length, smallest period) of every run of three periods or more."""
    automaton = LinkCutAutomaton()
    append, access = automaton.append, automaton.access
    last: dict[tuple[int, int], int] = {}
    for i, word in enumerate(words):
        for end, length in access(append(word), i):
            period = i - end
            if (LEAST_PERIODS - 1) * period <= length:
                last[end - length + 1, period] = i
    return [(start, end - start + 1, period) for (start, period), end in last.items()]


def repeating_stretches(hashes: np.ndarray, first: np.ndarray, last: np.ndarray):
    """Word ranges of a batch of texts in which every sequence of eight words occurs again,
    24 words long at least. Narrowed until every sequence occurs again in its own range."""
    begin, end = first, last
    while True:
        long = end - begin >= LEAST_WORDS
        begin, end = begin[long], end[long]
        if not len(begin):
            return begin, end
        count = end - begin - GRAM + 1
        owner = np.repeat(np.arange(len(begin)), count)
        at = np.repeat(begin - np.concatenate(([0], np.cumsum(count)[:-1])), count)
        at += np.arange(len(at))
        value = mix(owner.astype(np.uint64) + U64(1))
        for j in range(GRAM):
            value = value * U64(0x9E6C63D0676A9A99) + hashes[at + j]
        value = mix(value)
        order = np.argsort(value)
        equal = value[order[1:]] == value[order[:-1]]
        again = np.zeros(len(at), bool)
        again[order[1:]] = equal
        again[order[:-1]] |= equal
        if again.all():
            return begin, end
        edge = np.ones(len(at) + 1, bool)
        edge[1:-1] = (owner[1:] != owner[:-1]) | (again[1:] != again[:-1])
        cut = np.flatnonzero(edge)
        low, high = cut[:-1][again[cut[:-1]]], cut[1:][again[cut[:-1]]]
        begin, end = at[low], at[high - 1] + GRAM


def _batch_runs(batch: pa.RecordBatch) -> pa.RecordBatch:
    texts = batch_of(batch.column("text"))
    words = words_of(texts, SPACED)
    hashes = word_hashes(texts.data, words)
    n = len(words.first)
    found: dict[int, list[tuple[int, int, int]]] = {}
    kept = np.ones(len(words.start), bool)
    for begin, end in zip(*repeating_stretches(hashes, words.first, words.last), strict=True):
        _, numbers = np.unique(hashes[begin:end], return_inverse=True)
        own = [r for r in runs_of(numbers.tolist()) if r[1] >= LEAST_WORDS]
        if own:
            row = int(np.searchsorted(words.last, begin, "right"))
            shift = int(begin - words.first[row])
            found.setdefault(row, []).extend((s + shift, m, q) for s, m, q in own)
            for start, length, period in own:
                kept[begin + start + period : begin + start + length] = False
    runs = [sorted(found.get(row, ()), key=lambda r: (r[0], r[2])) for row in range(n)]
    flat = np.array([r for own in runs for r in own], np.int64).reshape(-1, 3)
    offsets = np.concatenate(([0], np.cumsum([len(own) for own in runs]))).astype(np.int32)
    parts = [pa.array(np.ascontiguousarray(flat[:, k])) for k in range(3)]
    runs = pa.ListArray.from_arrays(
        pa.array(offsets), pa.StructArray.from_arrays(parts, ["start", "length", "period"])
    )
    columns = {"doc_id": batch.column("doc_id"), "runs": runs}
    columns |= {
        "n_words": pa.array((words.last - words.first).astype(np.int64)),
        "kept_text": _joined(texts, words, kept),
    }
    return pa.RecordBatch.from_pydict(columns)


def _joined(texts, words, kept: np.ndarray) -> pa.Array:
    """The kept words of each text, joined by one space."""
    size = len(texts.data)
    change = np.zeros(size + 1, np.int32)
    change[words.start[kept]] += 1
    change[words.end[kept]] -= 1
    mask = np.cumsum(change[:-1]).astype(bool)
    data = texts.data.copy()
    # Every kept word but a text's first is preceded by at least one byte of white space.
    place = np.flatnonzero(kept)
    row = np.searchsorted(words.last, place, "right")
    later = np.zeros(len(place), bool)
    later[1:] = row[1:] == row[:-1]
    space = words.start[place[later]] - 1
    mask[space] = True
    data[space] = 32
    before = np.concatenate(([0], np.cumsum(mask)))
    ends = before[texts.end]
    offsets = np.concatenate(([0], ends)).astype(np.int64)
    return pa.LargeStringArray.from_buffers(
        len(texts.end), pa.py_buffer(offsets), pa.py_buffer(data[mask])
    ).cast(pa.string())


def _find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield _batch_runs(batch)


def find_runs(docs: DataFrame) -> DataFrame:
    """(doc_id, runs, n_words, kept_text) for every row of ``docs(doc_id, text)``.

    Words are ``[^\\x20\\x09-\\x0D]+``, numbered from 0. ``runs`` holds every stretch of 24
    words or more, at least three times its smallest period long, that no neighbouring word
    extends, as (start, length, period) by start, then period. ``kept_text`` is the text with
    all but the first period of each run left out, its words joined by one space.

    Null, empty and blank texts have no words, no runs and an empty kept text. Rows stay
    rows: repeated ids and null ids are treated like any other. Further columns are ignored;
    an empty table gives an empty result. Each text is worked on whole, with memory in
    proportion to its repeating stretches.
    """
    ready(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    schema = f"doc_id long, runs array<{RUN}>, n_words long, kept_text string"
    return docs.mapInArrow(_find, schema)
