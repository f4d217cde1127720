"""Token store, nearest neighbours, near duplicates, URL verdicts, mixing and the pipeline."""

import random
import re
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ledgerwatch.llm import blockjoin, linkrank, minhash, mixing, tokenstore
from ledgerwatch.llm.common import written
from ledgerwatch.llm.components import components
from tests.llm.test_text_operators import by_id, docs_of

PATH = public_tokenizers.path("word_bpe_49k.json")


@given(st.lists(st.integers(0, 2**32 - 1)))
def test_pack_round_trip(values):
    values = np.array(values, np.uint32)
    control, data = tokenstore.pack(values)
    assert len(control) == -(-len(values) // 4)
    assert (tokenstore.unpack(control, data, len(values)) == values).all()


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(max_size=40) | st.sampled_from(["Heing, in\nthe.", "a<|endoftext|>b", "ǅ İ ß,."]), max_size=4))
def test_word_encoder_equals_library(texts):
    encoder = tokenstore._encoder(PATH)
    ids, counts = encoder.encode(texts)
    whole = [encoder.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    assert ids.tolist() == [x for own in whole for x in own]
    assert counts.tolist() == [len(x) for x in whole]


def test_token_store(spark, folder, monkeypatch):
    rows = [(i, f"text number {i}, the {'end. ' * (i % 7)}", "en", "s") for i in range(300, 0, -1)]
    rows += [(500, None, None, None), (501, "", "en", "s"), (502, "word " * 70_000, "en", "s")]
    rows += [(7, "another text of seven", "en", "s"), (None, "no id", "en", "s")]
    docs = docs_of(spark, rows)
    path = f"{folder}/store"
    tokenstore.write_tokens(docs, path, PATH, 1)
    got = tokenstore.read_tokens(spark, path).orderBy("start").collect()
    encoder = tokenstore._encoder(PATH).tokenizer
    ids_of = lambda t: [*encoder.encode(t or "", add_special_tokens=False).ids, 1]
    assert [r.doc_id for r in got] == sorted([r[0] for r in rows], key=lambda i: (i is not None, i))
    start = 0
    wanted = defaultdict(list)
    for i, text, *_ in rows:
        wanted[i].append(ids_of(text))
    for r in got:
        ids = np.frombuffer(bytes(r.ids), "<u4").tolist()
        wanted[r.doc_id].remove(ids)
        assert (r.start, r.n_tokens) == (start, len(ids))
        start += len(ids)
    ranks = spark.read.parquet(f"{path}/ranks").orderBy("rank").collect()
    assert [r.n for r in ranks] == sorted((r.n for r in ranks), reverse=True)
    digest = by_id(tokenstore.read_tokens(spark, path, digest=True), "ids_crc32")
    assert digest[500] == (zlib.crc32(np.array([1], "<u4").tobytes()),)
    assert tokenstore.token_store(docs.where("false"), PATH).count() == 0


def brute_nearest(rows, asks, k):
    out = {}
    good = [
        (i, np.array(v, float))
        for i, v in rows
        if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)
    ]
    for q, a in good:
        if not asks(q):
            continue
        found = {}
        for i, b in good:
            if i != q and len(a) == len(b):
                s = float((a * b).sum() / (np.sqrt((a * a).sum()) * np.sqrt((b * b).sum())))
                found[i] = max(s, found.get(i, -2))
        out[q] = sorted(found.items(), key=lambda x: (-round(x[1], 12), x[0]))[:k]
    return out


@pytest.mark.parametrize("block", [8192, 7])
def test_nearest_like_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(blockjoin, "BLOCK", block)
    monkeypatch.setattr(blockjoin, "QUERY_BLOCK", max(3, block // 2))
    rng = np.random.default_rng(9)
    rows = [(i, np.round(rng.normal(size=6), 2).astype(np.float32).tolist()) for i in range(80)]
    rows += [(100 + i, rows[0][1]) for i in range(20)]
    rows += [(200, None), (201, [0.0] * 6), (202, [1.0, None, 2.0, 0.0, 0.0, 0.0]), (203, [float("nan")] * 6)]
    rows += [(210, [float("inf")] + [1.0] * 5), (204, []), (205, [1.0, 2.0]), (220, [2.0, 1.0]), (None, rows[1][1])]
    rows += [rows[3], rows[3]]
    table = spark.createDataFrame([(*r, 5, 7) for r in rows], "vec_id long, embedding array<float>, label int, rank int")
    got = defaultdict(list)
    for r in blockjoin.nearest(table, F.col("vec_id") % 5 == 0, 5).orderBy("query_id", "rank").collect():
        assert r.rank == len(got[r.query_id]) + 1
        got[r.query_id].append((r.vec_id, r.score))
    wanted = brute_nearest(dict.fromkeys(map(lambda r: (r[0], tuple(r[1]) if r[1] is not None else None), rows)), lambda q: q % 5 == 0, 5)
    assert {q: [i for i, _ in v] for q, v in got.items()} == {q: [i for i, _ in v] for q, v in wanted.items() if v}
    for q, v in got.items():
        assert np.allclose([s for _, s in v], [s for _, s in wanted[q]], atol=1e-12)
    assert blockjoin.nearest(table.where("false"), F.col("vec_id") % 5 == 0, 5).count() == 0


def test_int8_bounds_hold():
    rng = np.random.default_rng(1)
    for d in (3, 64, 1200):
        a, b = (x / np.linalg.norm(x, axis=1)[:, None] for x in (rng.normal(size=(20, d)), rng.normal(size=(30, d)) ** 5))
        low, high = blockjoin.bounds(a, b)
        exact = a @ b.T
        assert (low <= exact).all() and (exact <= high).all()


def brute_groups(texts):
    sets = {}
    for i, text in texts.items():
        words = [w for w in _split(_lower(text or "")) if w]
        n = len(words)
        sets[i] = {tuple(words[j : j + 5]) for j in range(max(n - 4, 1))} if n else set()
    up = {i: i for i in sets}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for x, i in enumerate(ids):
        for j in ids[:x]:
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= 85 * len(a | b):
                p, q = top(i), top(j)
                up[max(p, q)] = min(p, q)
    return {i: (len(sets[i]), top(i), top(i) == i) for i in ids}


def _lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def _split(text):
    import re

    return re.split(r"[\x20\x09-\x0D]+", text)


@pytest.fixture(scope="module")
def near(spark):
    rng = random.Random(6)
    texts, base = {}, []
    for g in range(12):
        base.append([f"w{rng.randrange(400)}" for _ in range(rng.choice([3, 8, 40, 120, 300]))])
    for i in range(150):
        words = list(base[rng.randrange(12)])
        for _ in range(rng.choice([0, 0, 1, 2, 4, 9])):
            words[rng.randrange(len(words))] = f"e{rng.randrange(1000)}"
        texts[i + 10] = rng.choice([" ", "\n", "\t "]).join(words).title()
    # Two families that only one document in their middle ties together.
    chain = [f"c{i}" for i in range(60)]
    for k in range(12):
        texts[300 + k] = " ".join(f"x{j}" if j < 1.5 * k else w for j, w in enumerate(chain))
    texts |= {400: None, 401: "", 402: " \n", 403: "One", 404: "one", 405: "one two three four", 406: "É é"}
    texts[410] = "long " + " ".join(f"q{i}" for i in range(60_000))
    texts[411] = texts[410] + " more"
    return texts


def test_near_duplicates_like_brute_force(spark, near, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", 8)
    rows = [(i, t, "en", "s") for i, t in near.items()] + [(403, "One", "en", "s"), (None, near[411], "en", "s")]
    found = minhash.near_duplicates(docs_of(spark, rows))
    rows = found.collect()
    assert len(rows) == len(near) + 2
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in rows if r.doc_id is not None}
    assert got == brute_groups(near)
    alone = [r for r in rows if r.doc_id is None]
    assert (alone[0].component_id, alone[0].kept) == (None, True)


def test_near_duplicates_repeated_ids_and_no_rows(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(30)) for x in "abc")
    docs = docs_of(spark, [(1, a, "", ""), (5, a, "", ""), (5, b, "", ""), (7, b, "", ""), (9, c, "", "")])
    got = {(r.doc_id, r.component_id) for r in minhash.near_duplicates(docs).collect()}
    assert got == {(1, 1), (5, 1), (7, 1), (9, 9)}
    assert minhash.near_duplicates(docs.where("false")).count() == 0


def test_estimates_agree(spark):
    rng = np.random.default_rng(3)
    found = rng.integers(0, 2**32, (6, minhash.BANDS * minhash.ROWS), dtype=np.uint32)
    found[1, :90] = found[0, :90]
    bits = minhash.pack_bits(found)
    table = minhash.estimate(bits, bits)
    assert np.allclose(np.diag(table), 1.0) and abs(table[0, 1] - 0.5) < 0.1
    pairs = spark.createDataFrame(
        [(bytes(bits[i]), bytes(bits[j]), float(table[i, j])) for i in range(6) for j in range(6)],
        "a binary, b binary, e double",
    )
    gap = F.abs(minhash._estimate_column("a", "b") - F.col("e"))
    assert pairs.where(gap > 1e-9).count() == 0


def test_components(spark):
    rng = random.Random(8)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(i, i + 1) for i in range(300, 340)]
    up = {}

    def top(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        p, q = top(a), top(b)
        up[max(p, q)] = min(p, q)
    got = {r.id: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    linked = {x for e in edges if e[0] != e[1] for x in e}
    assert got == {x: top(x) for x in linked}
    assert components(spark.createDataFrame([(1, 1)], "a long, b long")).count() == 0


RULES = [
    linkrank.Rule("block", "net", "/"),
    linkrank.Rule("allow", "example.net", "/en/"),
    linkrank.Rule("allow", "org", "/fr/"),
]


def test_url_verdicts(spark):
    link = lambda h: f'<a href="https://{h}/x">x</a>'
    rows = [
        (1, "http://A.Example.NET/en/x?q#f", link("c.com")),
        (2, "https://bad.net/p", link("bad2.net")),
        (3, "https://bad2.net/p", None),
        (4, "https://farm.com/1", link("bad.net") + link("bad2.net") + "<img src=//bad.net/i>"),
        (5, "https://farm.com/2", link("bad.net")),
        (6, "https://c.com/", link("good.org")),
        (7, "https://good.org/fr/a", ""),
        (8, "https://net", "x"),
        (9, None, None),
        (10, "no scheme", link("bad.net")),
        (11, "https://xnet/en/", None),
        (12, "x://h?a/b://c", "<a href='/in'>in</a>" + "y" * 200_000),
        (12, "x://h?a/b://c", None),
    ]
    pages = spark.createDataFrame([(*r, "z") for r in rows], "page_id long, url string, html string, host string")
    found = linkrank.judge_pages(pages, RULES)
    assert found.count() == len(rows)
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in found.collect()}
    assert got[1] == ("a.example.net", "/en/x", "example.net/en/", "allow")
    assert got[2] == ("bad.net", "/p", "net/", "block")
    assert got[4] == ("farm.com", "/1", None, "block") and got[5][3] == "block"
    assert got[6] == ("c.com", "/", None, "allow")
    assert got[7] == ("good.org", "/fr/a", "org/fr/", "allow")
    assert got[8][:3] == ("net", "", None)
    assert got[9] == got[10] == ("", "", None, "allow")
    assert got[11] == ("xnet", "/en/", None, "allow") and got[12] == ("h", "", None, "allow")
    assert linkrank.judge_pages(pages.where("false"), RULES).count() == 0


def test_one_link_in_a_thousand_blocks_no_host_and_in_linkers_hide_none(spark):
    """Hosts round a blocked one are blocked whatever their number; other cases in between."""
    link = lambda h: f'<a href="https://{h}/x">x</a>'
    rows, wanted = [], {}

    def page(host, *out, verdict=None):
        rows.append((len(rows), f"https://{host}/", "".join(map(link, out))))
        if verdict:
            wanted[len(rows) - 1] = verdict

    for m in (1, 10, 1000):
        page(f"bad{m}.net", "hide1.com", "hide2.com", "hide3.com", verdict="block")
        for i in range(m):
            page(f"farm{m}x{i}.com", f"bad{m}.net", verdict="block")
    # A host two links from a blocked one that few others link to.
    page("bad9.net")
    page("near.com", "bad9.net", verdict="block")
    page("far.com", "near.com", verdict="block")
    # One bad link among a thousand others, and two bad ones of three.
    page("wide.com", "bad1.net", *[f"fine{i}.com" for i in range(999)], verdict="allow")
    for i in range(0, 999, 50):
        page(f"fine{i}.com", verdict="allow")
    page("mostly.com", "bad1.net", "bad10.net", "solo.com", verdict="block")
    # A trusted host vouches for one that links to a bad one.
    rows.append((9000, "https://good.org/fr/a", link("both.com")))
    page("both.com", "bad10.net", verdict="allow")
    page("hide1.com", verdict="allow")
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    found = {r.page_id: r for r in linkrank.judge_pages(pages, RULES).collect()}
    assert {i: found[i].verdict for i in wanted} == wanted
    farms = [r for r in found.values() if r.host.startswith("farm")]
    assert len(farms) == 1011 and all(r.trust == 0 and r.distrust == 1 for r in farms)


def random_graph(seed):
    rng = random.Random(seed)
    hosts = [f"h{i}" for i in range(15)]
    edges = {(a, b): rng.randrange(1, 5) for a in hosts for b in rng.sample(hosts, 3) if a != b and a != "h3"}
    return hosts, edges


def walk_scores(hosts, edges, start):
    """Sum over all walks from the start, each link at DAMPING times its share."""
    at = {h: k for k, h in enumerate(hosts)}
    step = np.zeros((len(hosts), len(hosts)))
    for (a, b), n in edges.items():
        step[at[b], at[a]] = linkrank.DAMPING * n / sum(m for (x, _), m in edges.items() if x == a)
    return np.linalg.solve(np.eye(len(hosts)) - step, np.array([float(h in start) for h in hosts]))


def test_spread_and_shares_like_linear_algebra(spark):
    hosts, edges = random_graph(1)
    seeds = ["h0", "h7"]
    links = spark.createDataFrame([("t", a, b, n) for (a, b), n in edges.items()], "kind string, src string, dst string, n long")
    start = spark.createDataFrame([("t", s) for s in seeds], "kind string, host string")
    got = {r.host: r.received + (r.host in seeds) for r in linkrank.spread(links, start).collect()}
    for h, score in zip(hosts, walk_scores(hosts, edges, seeds), strict=True):
        assert abs(got.get(h, 0.0) - score) < 0.01 * score + 1e-9
    cut = {(a, b): n for (a, b), n in edges.items() if b not in seeds}
    ours, all_ = walk_scores(hosts, cut, seeds), walk_scores(hosts, cut, hosts)
    shares = {r.host: r.share for r in linkrank.relative(links, start).collect()}
    for k, h in enumerate(hosts):
        wanted = 1.0 if h in seeds else ours[k] / (all_[k] - 1) if ours[k] else 0.0
        assert abs(shares.get(h, 0.0) - wanted) < 0.01


def brute_rule(rules, host, path):
    """Longest fitting rule, by plain tests on every one."""
    best = None
    for r in rules:
        same = host == r.host or host[-len(r.host) - 1 :] == "." + r.host
        if same and path[: len(r.path)] == r.path:
            if best is None or (-len(r.text), r.text) < (-len(best.text), best.text):
                best = r
    return (best.text, best.verdict) if best else (None, "allow")


def test_rules_like_brute_force(spark):
    from ledgerwatch.llm.queries import URL_RULES

    rng = random.Random(6)
    hosts = ["net", "xnet", "a.net", "example.net", "b.example.net", "example.com", "www.example.com", "org", "a.org", "org.com", ""]
    paths = ["", "/", "/en", "/en/", "/en/x", "/de/", "/DE/", "/fr/a?b", "/fr/#x", "/fr", "?/en/"]
    rows = [(i, f"http://{rng.choice(hosts)}{rng.choice(paths)}".replace("example", rng.choice(["example", "EXAMPLE"])), None) for i in range(300)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    for r in linkrank.judge_pages(pages, URL_RULES).collect():
        rest = rows[r.page_id][1][7:]
        host = _lower(re.split("[/?#]", rest)[0])
        path = re.split("[?#]", rest[len(host) :])[0]
        assert (r.host, r.path) == (host, path)
        rule, verdict = brute_rule(URL_RULES, host, path)
        assert r.rule == rule and (rule is None or r.verdict == verdict), rows[r.page_id]


def brute_targets(words):
    names = sorted(words, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    left, open_, out = 1.5 * sum(words.values()), set(names), {}
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if weight[s] * level > 2 * words[s]}
        if not full:
            return out | {s: weight[s] * level for s in open_}
        for s in full:
            out[s] = 2.0 * words[s]
            left -= out[s]
        open_ -= full
    return out


def test_mix(spark):
    rng = random.Random(12)
    rows = []
    for i in range(900):
        source = rng.choice(["hot"] * 6 + ["a", "b", "é", None, "z"])
        rows.append((i, " ".join(["w"] * rng.choice([1, 5, 40, 300])), "en", source))
    rows += [(2000, None, "en", "a"), (2001, "", "en", "only empty"), (2002, " \n", "en", "a")]
    rows += [(3, rows[3][1], "en", rows[3][3]), (None, "no id here", "en", "b")]
    docs = docs_of(spark, rows)
    mixed = mixing.mix_sources(docs).collect()
    assert len(mixed) == len(rows)
    words, taken, most = defaultdict(int), defaultdict(int), defaultdict(int)
    for r in mixed:
        words[r.source] += r.size
        taken[r.source] += r.taken
        most[r.source] = max(most[r.source], r.size)
        assert 0 <= r.taken <= 2 * r.size
    wanted = brute_targets(dict(words))
    for r in mixed:
        assert r.source_size == words[r.source]
        assert r.target == pytest.approx(wanted[r.source], rel=1e-9)
    for s in words:
        assert abs(taken[s] - wanted[s]) <= most[s]
    key = lambda r: (str(r.doc_id), r.source, r.size, r.taken)
    again = mixing.mix_sources(docs.repartition(7)).collect()
    assert sorted(map(key, mixed), key=str) == sorted(map(key, again), key=str)
    assert mixing.mix_sources(docs.where("false")).count() == 0


def test_mix_of_rows_without_ids_and_repeated_rows(spark):
    """A source whose rows all lack ids, and one that is a single row again and again."""
    rows = [(None, f"text {i} " + "w " * (i % 9), "en", "nameless") for i in range(700)]
    rows += [(7, "again and again", "en", "same")] * 500 + [(i, "x y", "en", "z") for i in range(9, 400)]
    docs = docs_of(spark, rows).repartition(6)
    mixed = mixing.mix_sources(docs).collect()
    assert len(mixed) == len(rows)
    words, taken = defaultdict(int), defaultdict(int)
    for r in mixed:
        words[r.source] += r.size
        taken[r.source] += r.taken
        assert 0 <= r.taken <= 2 * r.size
    for s, target in brute_targets(dict(words)).items():
        assert abs(taken[s] - target) <= 10
    key = lambda r: (str(r.doc_id), r.source, r.size, r.tie, r.taken)
    again = mixing.mix_sources(docs.repartition(3)).collect()
    assert sorted(map(key, mixed)) == sorted(map(key, again))


def test_targets_that_contradict_each_other_are_an_error(spark):
    rows = [("a", "x", 10, 30.0, 20.0), ("b", "x", 30, 30.0, 20.0)]
    cells = spark.createDataFrame(rows, "u string, v string, words long, target_u double, target_v double")
    with pytest.raises(ValueError, match="no rates"):
        mixing.balance(cells, ["u", "v"])


def test_balance_meets_two_sets_of_targets(spark):
    rows = [("a", "x", 10, 30.0, 20.0), ("a", "y", 20, 30.0, 40.0), ("b", "x", 30, 30.0, 20.0), ("b", "y", 5, 30.0, 40.0)]
    cells = spark.createDataFrame(rows, "u string, v string, words long, target_u double, target_v double")
    got = mixing.balance(cells, ["u", "v"]).collect()
    for name in "uv":
        for value in {r[name] for r in got}:
            own = [r for r in got if r[name] == value]
            assert sum(r.words * r.rate for r in own) == pytest.approx(own[0][f"target_{name}"], rel=1e-6)


def test_pipeline(spark, near, folder):
    import corpus_pipeline as cp

    rng = random.Random(2)
    bench = [(i, " ".join(f"b{rng.randrange(50)}" for _ in range(30))) for i in range(3)]
    rows = [(i, t, "en" if i % 2 else "de", rng.choice(["s1", "s2", None]), 5) for i, t in near.items()]
    rows += [(700, "words before " + bench[0][1], "en", "s1", 5), (701, "12 34", "en", "s1", 5), (None, "free of id", "en", "s1", 5)]
    # Two texts under one id are two documents; copies go, with or without id.
    rows += [(702, "one text of this id", "en", "s1", 5), (702, "another of the same id", "en", "s1", 5)]
    rows += [(None, "free of id", "en", "s1", 5), (None, "one text of this id", "en", "s1", 5)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, schema).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    assert 4 <= len(cp.STAGES) <= 5
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    seen = []
    for name, stage in cp.STAGES:
        docs = written(stage(spark, docs, folder), name)
        seen.append(docs.collect())
        if name != "tokens":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    by_row = [{r.doc_id for r in s} for s in seen]
    assert by_row[0] == {r[0] for r in rows if any(c.isalpha() for c in r[1] or "")}
    kept = {i for i, v in brute_groups({i: t for i, t, *_ in rows if i in by_row[0] and i is not None}).items() if v[2]}
    assert by_row[1] == kept | {None} and len(seen[1]) == len(by_row[1]) + 1
    assert {r.text for r in seen[1] if r.doc_id in (702, None)} == {t for i, t, *_ in rows if i in (702, None)}
    assert by_row[2] == by_row[1] - {700}
    sizes = defaultdict(int)
    for r in seen[2]:
        sizes[r.source] += len(r.text.split())
    for source, target in brute_targets(dict(sizes)).items():
        got = sum(len(r.text.split()) for r in seen[3] if r.source == source)
        biggest = max(len(r.text.split()) for r in seen[2] if r.source == source)
        assert abs(got - target) <= biggest
    ids = tokenstore._encoder(PATH).tokenizer
    lengths = sorted(len(ids.encode(r.text, add_special_tokens=False).ids) + 1 for r in seen[3])
    assert sorted(r.n_tokens for r in seen[4]) == lengths
