"""Language identification with error-correcting output codes.

Languages get codewords; for each bit a binary classifier over byte n-grams tells the languages
with a one from those with a zero. A text is decoded to the language whose codeword has the
least loss, each bit weighted by how well its classifier separates the training rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerwatch.llm.common import ready
from ledgerwatch.llm.textbatch import LOWER, batch_of, byte_class

# Hashed n-gram features: bins for each of the orders 1 to 3.
BINS = 4096
ORDERS = (1, 2, 3)
# Training rows per language, at most (a documented bound: only the number of rows the
# classifiers are fitted on; their texts are read whole). The rows are those of least hash.
TRAIN_ROWS = 400
# Any two codewords differ in so many bits at least: one wrong bit is corrected, two are seen.
DISTANCE = 4
EPOCHS = 60
HASH_PARTS = 1 << 14
UNDECIDED = "und"
PIECE = 1 << 21

# Bytes of ASCII letters and of non-ASCII characters count; all others are a boundary.
_LETTERS = byte_class(spans=((65, 90), (97, 122)), high=True)
_FOLD = np.where(_LETTERS, LOWER, 32).astype(np.uint8)


def _bins(folded: np.ndarray, order: int) -> np.ndarray:
    """Bin of the n-gram that starts at each byte. N-grams that begin or end in the text's
    last bytes wrap to boundaries there."""
    code = folded.astype(np.uint32)
    for step in range(1, order):
        code[:-step] = code[:-step] * np.uint32(257) + folded[step:]
    code = (code * np.uint32(2654435761)) ^ (code >> np.uint32(13))
    return (code * np.uint32(2246822519)) >> np.uint32(32 - 12)


def features(data: np.ndarray) -> np.ndarray:
    """Square roots of n-gram frequencies of one text, for all orders, scaled to length 1.

    A text of any length is counted in pieces; n-grams across two pieces are kept by an
    overlap."""
    folded = _FOLD[data]
    out = np.zeros(len(ORDERS) * BINS)
    for begin in range(0, len(folded), PIECE):
        piece = folded[begin : begin + PIECE + max(ORDERS) - 1]
        own = min(PIECE, len(folded) - begin)
        for k, order in enumerate(ORDERS):
            if len(piece) < order:
                continue
            last = min(own, len(piece) - order + 1)
            counts = np.bincount(_bins(piece, order)[:last], minlength=BINS)
            out[k * BINS : (k + 1) * BINS] += counts
            if order > 1:  # runs of boundaries say nothing
                gap = _bins(np.full(order, 32, np.uint8), order)[0]
                out[k * BINS + gap] = 0
    out[_bins(np.array([32], np.uint8), 1)[0]] = 0
    norm = out.sum()
    return np.sqrt(out / norm) if norm else out


def has_letters(data: np.ndarray) -> bool:
    """ASCII letters, or characters beyond ASCII that count as letters."""
    if _ASCII[data].any():
        return True
    if not (data >= 128).any():
        return False
    return any(c.isalpha() for c in data.tobytes().decode("utf-8", "replace"))


_ASCII = byte_class(spans=((65, 90), (97, 122)))


def codewords(n: int) -> np.ndarray:
    """A +1/-1 codeword per language, any two at DISTANCE or more.

    Up to five languages have a bit for every way to split them in two. More have rows of a
    Hadamard matrix without its constant column, half of which differ; the rows are chosen so
    that its columns are different splits, too. Two or three languages have too few splits,
    so these are repeated; ``feature_folds`` keeps the repetitions independent.
    """
    if n == 1:
        return np.ones((1, 1))
    if n <= 5:
        splits = [[1 if k == 0 or bits >> (k - 1) & 1 == 0 else -1 for k in range(n)] for bits in range(1, 2 ** (n - 1))]
        codes = np.array(splits, np.float64).T
        return np.tile(codes, repetitions(n))
    size = 16
    while size < n:
        size *= 2
    matrix = np.array([[1]])
    while len(matrix) < size:
        matrix = np.block([[matrix, matrix], [matrix, -matrix]])
    # Row 0 and the rows of powers of two tell all columns apart.
    first = [0, *[1 << k for k in range(size.bit_length() - 1)]]
    rows = [*first, *[r for r in range(size) if r not in first]][:n]
    return matrix[rows, 1:].astype(np.float64)


def repetitions(n: int) -> int:
    """How often each split occurs: all splits of n languages are at distance 2^(n-2)."""
    return -(-DISTANCE // 2 ** (n - 2)) if 2 <= n <= 5 else 1


def feature_folds(n: int, bits: int) -> np.ndarray:
    """Features x bits: which features a bit's classifier may use. Repetitions of a split have
    features of their own, so that they do not err together."""
    times = repetitions(n)
    fold = np.arange(len(ORDERS) * BINS) % times
    return (fold[:, None] == (np.arange(bits) // (bits // times))[None, :]).astype(np.float64)


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    codes: np.ndarray
    weights: np.ndarray  # features x bits
    bias: np.ndarray
    trust: np.ndarray  # weight of each bit in decoding


def fit(rows: list[tuple[str, np.ndarray]]) -> Model | None:
    """Logistic regressions, one per bit, by full-batch gradient steps on the bounded sample
    of (language, features)."""
    languages = tuple(sorted({lang for lang, _ in rows}))
    if not languages:
        return None
    codes = codewords(len(languages))
    folds = feature_folds(len(languages), codes.shape[1])
    x = np.array([own for _, own in rows], np.float32)
    label = np.array([languages.index(lang) for lang, _ in rows])
    y = codes[label]
    # Every language weighs the same, however many rows it has.
    share = 1.0 / (np.bincount(label, minlength=len(languages))[label] * len(languages))
    weights = np.zeros((x.shape[1], codes.shape[1]))
    bias = np.zeros(codes.shape[1])
    speed = np.zeros_like(weights)
    for _ in range(EPOCHS):
        margin = x @ weights.astype(np.float32) + bias
        slope = -y / (1.0 + np.exp(y * margin)) * share[:, None]
        speed = 0.9 * speed - 20.0 * (slope.astype(np.float32).T @ x).T * folds - 2e-4 * weights
        weights += speed
        bias -= 2.0 * slope.sum(axis=0)
    margin = x @ weights + bias
    right = ((margin * y > 0) * share[:, None]).sum(axis=0)
    trust = np.maximum(right - 0.5, 1e-3)
    return Model(languages, codes, weights.astype(np.float32), bias, trust / trust.sum())


def decode(model: Model, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(language index, score, gap to the second) of each row of margins. The loss of a
    codeword is the logistic loss of its bits, weighted by trust; scores are the softmax of
    the negative losses, summed over bits."""
    loss = np.logaddexp(0.0, -margins[:, None, :] * model.codes[None, :, :]) @ model.trust
    loss = loss * model.codes.shape[1]
    odds = np.exp(loss.min(axis=1, keepdims=True) - loss)
    odds /= odds.sum(axis=1, keepdims=True)
    best = odds.argmax(axis=1)
    score = odds[np.arange(len(odds)), best]
    second = np.sort(odds, axis=1)[:, -2] if odds.shape[1] > 1 else np.zeros(len(odds))
    return best, score, score - second


def _predictor(model: Model | None):
    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch_of(batch.column("text"))
            n = len(texts.start)
            x = np.zeros((n, len(ORDERS) * BINS), np.float32)
            known = np.zeros(n, bool)
            for i, (a, b) in enumerate(zip(texts.start, texts.end, strict=True)):
                own = texts.data[a:b]
                if model is not None and has_letters(own):
                    known[i] = True
                    x[i] = features(own)
            names = np.full(n, UNDECIDED, object)
            score, gap = np.zeros(n), np.zeros(n)
            if known.any():
                best, s, g = decode(model, x[known] @ model.weights + model.bias)
                names[known] = np.array(model.languages, object)[best]
                score[known], gap[known] = s, g
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(names, pa.string()), pa.array(score), pa.array(gap)],
                ["doc_id", "lang_pred", "score", "gap"],
            )

    return predict


def _sparse_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch_of(batch.column("text"))
        places, values = [], []
        for begin, end in zip(texts.start, texts.end, strict=True):
            own = features(texts.data[begin:end])
            at = np.flatnonzero(own)
            places.append(at.astype("<u2").tobytes())
            values.append(own[at].astype("<f4").tobytes())
        columns = [batch.column("lang"), batch.column("doc_id"), pa.array(places), pa.array(values)]
        yield pa.RecordBatch.from_arrays(columns, ["lang", "doc_id", "places", "values"])


def training_rows(labelled: DataFrame) -> list[tuple[str, np.ndarray]]:
    """(language, features) of the bounded sample of ``labelled(doc_id, text, lang)``: for each
    language the rows of least hash of their id. The number of languages is that of the labels
    in use. Whole texts become features where they lie; a row's features have a fixed size."""
    rows = labelled.where("lang is not null and text is not null and doc_id is not null")
    # Ranked without the texts, and only where the rank can be low: hashes are cut into parts,
    # and sums over the counts of parts tell up to which part a language's rows are needed.
    hashed = F.xxhash64("doc_id")
    keys = rows.select("lang", "doc_id").withColumn("hash", hashed)
    keys = keys.withColumn("part", F.floor((F.col("hash") / 2.0**63 + 1) * HASH_PARTS / 2))
    counts = keys.groupBy("lang", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("lang").orderBy("part")
    before = before.rowsBetween(Window.unboundedPreceding, -1)
    needed = counts.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
    needed = needed.where(F.col("before") < TRAIN_ROWS).select("lang", "part")
    order = Window.partitionBy("lang").orderBy("hash", "doc_id")
    keys = keys.join(needed, ["lang", "part"]).select("lang", "doc_id", "hash").distinct()
    keys = keys.withColumn("place", F.row_number().over(order)).where(f"place <= {TRAIN_ROWS}")
    keys = keys.select("lang", "doc_id")
    rows = rows.join(keys, ["lang", "doc_id"]).groupBy("lang", "doc_id")
    rows = rows.agg(F.min("text").alias("text")).mapInArrow(
        _sparse_features, "lang string, doc_id long, places binary, values binary"
    )
    rows = rows.orderBy("lang", F.xxhash64("doc_id"), "doc_id")
    found = []
    for r in rows.toLocalIterator():
        own = np.zeros(len(ORDERS) * BINS, np.float32)
        own[np.frombuffer(r["places"], "<u2")] = np.frombuffer(r["values"], "<f4")
        found.append((r["lang"], own))
    return found


def identify_languages(docs: DataFrame, labelled: DataFrame, ambiguous_gap: float = 0.2) -> DataFrame:
    """(doc_id, lang_pred, score, gap, ambiguous) for every row of ``docs(doc_id, text)``.

    The classifiers are fitted on ``labelled(doc_id, text, lang)``, a bounded sample per
    language. Texts that are null or have no letters are ``und`` with score 0; so is every
    text if no row is labelled. Very long texts are counted in pieces. Equal texts have equal
    results; ties of the loss go to the language first by name. Further columns are ignored.
    """
    ready(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    model = fit(training_rows(labelled.select("doc_id", "text", F.col("lang").cast("string"))))
    schema = "doc_id long, lang_pred string, score double, gap double"
    found = docs.mapInArrow(_predictor(model), schema)
    return found.withColumn(
        "ambiguous", (F.col("lang_pred") != UNDECIDED) & (F.col("gap") < ambiguous_gap)
    )


def drop_unidentified(docs: DataFrame, labelled: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose text has a language, with all their columns. Rejected are
    texts that are null or without letters, and all if no row is labelled."""
    ready(docs.sparkSession)
    model = fit(training_rows(labelled.select("doc_id", "text", F.col("lang").cast("string"))))
    predict = _predictor(model)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for found in predict(iter([batch])):
                yield batch.filter(pc.not_equal(found.column("lang_pred"), UNDECIDED))

    return docs.mapInArrow(keep, docs.schema)


def held_out(doc_id: str = "doc_id"):
    """Rows that no classifier is fitted on: crc32 of the id as text, modulo 3, is 1."""
    return F.coalesce(F.crc32(F.encode(F.col(doc_id).cast("string"), "utf-8")) % 3 == 1, F.lit(False))
