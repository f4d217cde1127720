"""Runs of words and centroid clustering against brute force."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from ledgerwatch.llm import orchard, queries, runs
from tests.llm.test_text_operators import docs_of

SF = "/root/testdata/sf0.001"
SPACE = re.compile(r"[^\x20\x09-\x0D]+")


def brute_runs(words):
    """Every period on its own: maximal stretches with it, if no smaller period holds them."""
    n, found = len(words), []
    for q in range(1, n // 3 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            length = j - i + q
            if j > i and length >= 3 * q:
                own = words[i : i + length]
                if all(own[p:] != own[:-p] for p in range(1, q)):
                    found.append((i, length, q))
            i = max(j, i + 1)
    return sorted(found, key=lambda r: (r[0], r[2]))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 2), max_size=40) | st.lists(st.integers(0, 40), max_size=40))
def test_automaton_finds_all_runs(words):
    assert sorted(runs.runs_of(words)) == sorted(brute_runs(words))


def test_automaton_on_periodic_words_with_faults():
    rng = random.Random(5)
    for _ in range(300):
        period = rng.randint(1, 9)
        base = [rng.randrange(4) for _ in range(period)]
        words = [base[i % period] for i in range(rng.randint(3, 90))]
        for _ in range(rng.randint(0, 3)):
            words[rng.randrange(len(words))] = rng.randrange(6)
        assert sorted(runs.runs_of(words)) == sorted(brute_runs(words)), words


def test_long_periods_are_linear():
    words = [i % 7 for i in range(100_000)]
    assert runs.runs_of(words) == [(0, 100_000, 7)]


def test_stretches_hold_every_run():
    rng = np.random.default_rng(3)
    for _ in range(60):
        words = rng.integers(0, 5000, 400).astype(np.uint64)
        period, start = int(rng.integers(1, 40)), int(rng.integers(0, 200))
        length = max(24, 3 * period)
        words[start : start + length] = words[start + np.arange(length) % period]
        texts = np.array([0, 150, 400]) if start >= 150 or start + length <= 150 else np.array([0, 400])
        begin, end = runs.repeating_stretches(words, texts[:-1], texts[1:])
        assert any(b <= start and e >= start + length for b, e in zip(begin, end, strict=True))
        assert end.sum() - begin.sum() < 2 * length + 48


def texts_with_runs():
    rng = random.Random(11)
    word = lambda: rng.choice(["a", "be", "cé", "δ", "É", "x9", "the"])
    texts = [None, "", "  \t\n", "one", "ab " * 23, "ab " * 24, "\x0bab\x0c " * 30, "a b " * 12, "a b " * 11 + "a c"]
    texts += ["v\xa0w " * 24, " ".join(["lead", *"abcdefgh" * 3, "tail"]), " ".join([*"abcdefghi" * 2, *"abcdefg"])]
    for _ in range(80):
        parts = []
        for _ in range(rng.randint(1, 4)):
            unit = [word() for _ in range(rng.randint(1, 12))]
            parts += unit * rng.randint(1, 6) + [word() for _ in range(rng.randint(0, 5))]
        texts.append(rng.choice(["", " ", "\n"]) + rng.choice([" ", "\t", " \r\n"]).join(parts))
    return texts


def collapsed(words, found):
    gone = {i for s, m, q in found for i in range(s + q, s + m)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def test_find_runs_like_brute_force(spark):
    rows = [(i % 90, t, "en", "s") for i, t in enumerate(texts_with_runs())]
    rows += [(None, "no id " * 30, None, None), (3, rows[20][1], "en", "s"), (700, "long " * 60_000, "en", "s")]
    docs = docs_of(spark, rows)
    got = sorted(
        ((r.doc_id, r.n_words, [tuple(x) for x in r.runs], r.kept_text) for r in runs.find_runs(docs).collect()),
        key=str,
    )
    wanted = []
    for i, text, *_ in rows:
        words = SPACE.findall(text or "")
        found = [(0, 60_000, 1)] if i == 700 else [r for r in brute_runs(words) if r[1] >= 24]
        wanted.append((i, len(words), found, collapsed(words, found)))
    assert got == sorted(wanted, key=str)
    assert runs.find_runs(docs.where("false")).count() == 0
    clashing = docs.withColumnsRenamed({"lang": "runs", "source": "kept_text"})
    assert runs.find_runs(clashing).count() == len(rows)


def contract_row(doc_id, text):
    words = SPACE.findall(text or "")
    n = len(words)
    h = zlib.crc32(str(doc_id).encode())
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
    found = [r for r in brute_runs(words) if r[1] >= 24]
    best = min(found, key=lambda r: (-r[1] / r[2], r[0], r[2])) if found else (None,) * 3
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    lines = "".join(f"{s},{m},{q}\n" for s, m, q in found)
    milli = 1000 * best[1] // best[2] if found else None
    return (doc_id, len(found), *best, milli, sha(lines), sha(collapsed(words, found)))


@pytest.mark.skipif(not __import__("os").path.isdir(SF), reason="supplied tables are missing")
def test_runs_query_like_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    small = {r.doc_id: r.text for r in docs if len(r.text or "") < 12_000}
    columns = "doc_id n_runs start length period exponent_milli runs_sha256 collapsed_sha256".split()
    found = queries.op11_word_runs(spark, SF).select(columns).collect()
    assert len(found) == len(docs)
    got = {r.doc_id: tuple(r) for r in found}
    wanted = {i: contract_row(i, t) for i, t in small.items()}
    assert {i: got[i] for i in small} == wanted
    assert sum(r[1] > 0 for r in wanted.values()) > 5


def brute_clusters(rows, k, rounds, seed=3):
    kept = [(i, [int(np.floor(1024 * float(x))) for x in v]) for i, v in rows]
    draw = sorted((hashlib.sha256(f"{seed}:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)
    centroids = [list(v) for _, v in draw[:k]]
    far = lambda v, c: sum((a - b) ** 2 for a, b in zip(v, c, strict=True))
    near = lambda v: min((far(v, c), n) for n, c in enumerate(centroids))
    for _ in range(rounds):
        own = [near(v)[1] for _, v in kept]
        for n in range(len(centroids)):
            mine = [v for (_, v), o in zip(kept, own, strict=True) if o == n]
            if mine:
                centroids[n] = [sum(c) // len(mine) for c in zip(*mine, strict=True)]
    return [(i, *near(v)[::-1]) for i, v in kept], centroids


@pytest.mark.parametrize(("k", "rounds"), [(8, 10), (5, 0), (40, 3)])
def test_clusters_like_brute_force(spark, k, rounds):
    rng = np.random.default_rng(k)
    rows = [(i, rng.normal(size=6).round(1).astype(np.float32).tolist()) for i in range(120)]
    rows += [(500 + i, rows[3][1]) for i in range(15)] + [rows[4], (7, rows[8][1]), (None, rows[9][1])]
    rows += [(600, [float(x)] * 6) for x in (0, -1, 1)]
    bad = [(900, None), (901, []), (902, [1.0] * 5), (903, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (904, [float("nan")] * 6)]
    bad += [(905, [float("-inf")] + [0.0] * 5), (906, [1.0] * 7)]
    table = spark.createDataFrame([(*r, 4, 2) for r in rows + bad], "vec_id long, embedding array<float>, cluster int, steps int")
    found = orchard.cluster(table, k, rounds, 6).withColumn("h", orchard.centroid_digest()).collect()
    wanted, centroids = brute_clusters(rows, k, rounds)
    assert sorted(((r.vec_id, r.cluster, r.distance) for r in found), key=str) == sorted(wanted, key=str)
    sums = [sum(d for _, c, d in wanted if c == n) for n in range(len(centroids))]
    for r in found:
        assert (r.cluster_inertia, r.inertia) == (sums[r.cluster], sum(sums))
        assert r.h == hashlib.sha256(",".join(map(str, centroids[r.cluster])).encode()).hexdigest()
    assert orchard.cluster(table.where("false"), k, rounds, 6).count() == 0
    assert orchard.cluster(table.where("vec_id > 900"), k, rounds, 6).count() == 0


def test_orchard_search_is_exact_and_measures_less():
    rng = np.random.default_rng(2)
    centroids = rng.integers(-50, 50, (60, 3))
    centroids[7] = centroids[3]
    rows = rng.integers(-60, 60, (500, 3))
    search = orchard.Orchard(centroids)
    every = ((rows[:, None] - centroids[None]) ** 2).sum(axis=2)
    for start in (np.zeros(500, int), rng.integers(0, 60, 500), every.argmin(axis=1)):
        near, distance = search.nearest(rows, start)
        assert (near == every.argmin(axis=1)).all() and (distance == every.min(axis=1)).all()
    limit = orchard.most(64)
    assert 64 * (2 * limit) ** 2 * 4 < 2**63
    with pytest.raises(ValueError, match="would not fit"):
        orchard._integers(__import__("pyarrow").array([[1e30] * 2]), 2)
