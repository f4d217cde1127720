"""The heavy-light set join against brute force."""

import random
import re
from itertools import combinations

import numpy as np
import pytest

from ledgerwatch.llm import queries, setjoin
from tests.llm.test_text_operators import docs_of

SF = "/root/testdata/sf0.001"
SPACE = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def shingles(text):
    words = SPACE.findall((text or "").translate(LOWER))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + 3]) for i in range(max(1, len(words) - 2)))


def brute_groups(rows):
    """(doc_id, set size, component) of each row; ids that repeat tie their texts."""
    sets = [(i, shingles(t)) for i, t in rows]
    up = {i: i for i, s in sets if i is not None}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    holders = {}
    for i, s in sets:
        if i is not None and s:
            holders.setdefault(s, []).append(i)
    for ids in holders.values():
        for i in ids:
            a, b = top(ids[0]), top(i)
            up[max(a, b)] = min(a, b)
    for (s, i), (t, j) in combinations(((s, v[0]) for s, v in holders.items()), 2):
        shared = len(s & t)
        if 10 * shared >= 9 * (len(s) + len(t) - shared):
            a, b = top(i), top(j)
            up[max(a, b)] = min(a, b)
    return sorted(((i, len(s), top(i) if i is not None and s else i) for i, s in sets), key=str)


def changed(rng, words, times):
    words = list(words)
    for _ in range(times):
        k = rng.randrange(len(words))
        how = rng.random()
        if how < 0.4:
            words[k] = f"new{rng.randrange(1000)}"
        elif how < 0.7 and len(words) > 1:
            del words[k]
        else:
            words.insert(k, f"add{rng.randrange(1000)}")
    return words


def families(seed, sizes, copies):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    texts = []
    for size in sizes:
        base = rng.choices(vocabulary, k=size)
        for _ in range(copies):
            texts.append(" ".join(changed(rng, base, rng.choice([0, 0, 1, 1, 2, size // 40, size // 15]))))
    rng.shuffle(texts)
    return texts


def got_rows(df):
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in df.collect()), key=str)


EDGES = [None, "", " \t", "one", "ONE", "one two", "one two three", "One Two Three", "a b c d"]


@pytest.mark.parametrize(("heavy", "block"), [(None, 512), (9, 3), (25, 8), (1, 512)])
def test_groups_like_brute_force(spark, monkeypatch, heavy, block):
    monkeypatch.setattr(setjoin, "BLOCK", block)
    if heavy:
        monkeypatch.setattr(setjoin, "boundary", lambda *_: heavy)
    texts = EDGES + families(heavy or 0, [5, 11, 12, 15, 20, 21, 22, 24, 26, 28, 30, 45, 90, 200], 9)
    passage = " ".join(f"shared{i}" for i in range(40))
    texts += [f"{passage} {' '.join(f'own{i}_{j}' for j in range(i))}" for i in range(0, 12)]
    rows = [(1000 - i, t, None, "s") for i, t in enumerate(texts)]
    rows += [(None, texts[20], "en", "s"), (5, "long " * 50_000 + passage, "en", "s"), (6, "long " * 50_001 + passage, "en", "s")]
    # One id with texts of two families, and a row twice.
    rows += [(2000, texts[30], "en", "s"), (2000, texts[100], "en", "s"), rows[40], rows[40]]
    docs = docs_of(spark, rows)
    wanted = brute_groups([r[:2] for r in rows])
    assert got_rows(setjoin.jaccard_groups(docs)) == wanted
    assert len({c for _, _, c in wanted}) < len(rows) - 30


def test_join_of_nothing(spark):
    docs = docs_of(spark, [(1, None, "en", "s")])
    assert got_rows(setjoin.jaccard_groups(docs)) == [(1, 0, 1)]
    assert setjoin.jaccard_groups(docs.where("false")).count() == 0
    clashing = docs_of(spark, [(4, "a b c d", "en", "s"), (3, "a b c d", "en", "s")])
    clashing = clashing.withColumnsRenamed({"lang": "node", "source": "component_id", "n": "print1"})
    assert got_rows(setjoin.jaccard_groups(clashing)) == [(3, 2, 3), (4, 2, 3)]


def test_subsets_meet_exactly_at_the_threshold():
    """Sets over few elements: they meet in a subset if and only if they reach the threshold."""
    rng = random.Random(8)
    for n, m, c in {r for size in range(9, 26) for r in setjoin.roles(size)}:
        assert setjoin.similar(c, n, m) and not setjoin.similar(c - 1, n, m)
        assert n - c == len(setjoin._left_out(n, n - c)[0]) and setjoin.close_sizes(n, m)
    for size in range(1, 200):
        least = min(setjoin.overlap(size, m) for m in range(-(-9 * size // 10), 10 * size // 9 + 1))
        assert setjoin.prefix_length(size) >= size - least + 1
    assert rng


def test_boundary_follows_cost():
    many_small = {s: 1000 for s in range(9, 32)}
    low, high = setjoin.boundary(many_small, 0.0), setjoin.boundary(many_small, 1e6)
    assert low < high <= setjoin.MOST_LIGHT
    assert setjoin.subset_count(8) == 0 and setjoin.subset_count(9) == 1 and setjoin.subset_count(20) > 190


def test_cells_never_rule_out_a_link():
    rng = np.random.default_rng(4)
    for _ in range(200):
        n = int(rng.integers(20, 400))
        both = rng.integers(0, 2**63, n)
        a, b = both[rng.random(n) < 0.97], both[rng.random(n) < 0.97]
        shared = len(np.intersect1d(a, b))
        cells = [np.minimum(np.bincount(x >> 57, minlength=64), 255).astype(np.uint8)[None] for x in (a, b)]
        apart = setjoin._differences(*cells)
        assert apart[0] <= len(a) + len(b) - 2 * shared
        if setjoin.similar(shared, len(a), len(b)):
            assert setjoin.possible(len(a), len(b), apart[0])


@pytest.mark.skipif(not __import__("os").path.isdir(SF), reason="supplied tables are missing")
def test_query_like_brute_force(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert got_rows(queries.op12_jaccard_join(spark, SF)) == brute_groups(docs)
