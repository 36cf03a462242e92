"""The Pitman-Yor model: counts against brute force, normalisation, seating, and held-out perplexity."""

import math
import random
import tracemalloc
import zlib

import numpy as np
import pytest

from statutemill.llm import pitman_yor
from statutemill.llm.common import new_path


def write(spark, rows, schema="doc_id long, text string, bucket string, kind int"):
    path = new_path(spark, "docs")
    spark.createDataFrame(rows, schema).repartition(3).write.parquet(path)
    return spark.read.parquet(path)


@pytest.mark.parametrize("hot_share", [2, 1000])
def test_counts_base_and_held_out(spark, monkeypatch, hot_share):
    monkeypatch.setattr(pitman_yor, "HOT_SHARE", hot_share)
    monkeypatch.setattr(pitman_yor, "CHUNK_BYTES", 2000)
    rng = random.Random(5)
    words = [f"w{i}" for i in range(60)]
    follow = {w: rng.sample(words, 4) for w in words}

    def text():
        w = [rng.choice(words)]
        for _ in range(rng.randint(0, 60)):
            w.append(rng.choice(follow[w[-1]]) if rng.random() < 0.9 else rng.choice(words))
        return " ".join(w)

    rows = [(i, text(), "x", 1) for i in range(300)]
    rows += [(400, None, "x", 1), (401, "", "x", 1), (402, " \n", "x", 1), (None, "w1 W2", "x", 1), (403, "never seen É é", "x", 1), rows[2], rows[2], (404, "w1 " * 3000, "x", 1)]
    df = write(spark, rows)
    fold = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2
    toks = lambda t: [*(t or "").encode().lower().split(), None]
    count = {}
    for i, t, *_ in rows:
        if not fold(i):
            for w in toks(t):
                count[w] = count.get(w, 0) + 1
    n, v = sum(count.values()), len(count)
    want = sorted((str(i), fold(i), len(toks(t)), sum(w in count for w in toks(t)), n) for i, t, *_ in rows)
    got = pitman_yor.score(df).collect()
    assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens) for r in got) == want
    base = {i: sum(math.log10((count.get(w, 0) + 1) / (n + v + 1)) for w in toks(t)) for i, t, *_ in rows}
    for r in got:
        assert math.isclose(r.base_score, base[r.doc_id], rel_tol=1e-9)
    held = [r for r in got if r.held_out]
    assert len(held) > 20
    per = lambda k: sum(r[k] for r in held) / sum(r.n_tokens for r in held)
    assert per("score") > per("base_score") + 0.3
    again = {(r.doc_id, r.score) for r in pitman_yor.score(df).collect()}
    assert again == {(r.doc_id, r.score) for r in got}


def test_unknown_words_are_one_dish(spark, monkeypatch):
    monkeypatch.setattr(pitman_yor, "HOT_SHARE", 1)  # contexts of few words would all be hot
    words = ["a", "b", "c", "d"]
    rng = random.Random(1)
    learn = [(i, " ".join(rng.choices(words, k=rng.randint(0, 5)))) for i in range(700) if zlib.crc32(str(i).encode()) % 7 != 2]
    free = iter([i for i in range(1000, 2000) if zlib.crc32(str(i).encode()) % 7 == 2])
    probes = {w: next(free) for w in ["", *words, "new"]} | {(v, w): next(free) for v in words for w in [*words, "new", "other"]}
    texts = [(i, w if isinstance(w, str) else " ".join(w)) for w, i in probes.items()]
    got = {r.doc_id: 10**r.score for r in pitman_yor.score(write(spark, learn + texts, "doc_id long, text string")).collect()}
    f = {w: got[i] for w, i in probes.items()}
    assert all(0 < x < 1 for x in f.values())
    for v in words:  # unknown words are one dish: any two have the same probability
        assert math.isclose(f[v, "new"], f[v, "other"], rel_tol=1e-9)
    assert sum(f[w] for w in ["", *words, "new"]) + sum(f[v, w] for v in words for w in [*words, "new"]) < 1


def plain_scores(rows, seed=1):
    """The model with dictionaries and one dish after another; the same numbers in (0, 1) and limits of the law of large dishes."""
    P = pitman_yor
    name = lambda w: int(P._END) if w is None else int(P.word_hashes(np.frombuffer(w, np.uint8), np.array([0]), np.array([len(w)]))[0])
    toks = lambda t: [*(t or "").encode().lower().split(), None]
    fold = lambda i: zlib.crc32(str(i).encode()) % 7 == 2
    count, start = {}, int(P._START)
    for i, t in rows:
        before = start
        for w in map(name, toks(t)):
            if not fold(i):
                count.setdefault(before, {}).setdefault(w, 0)
                count[before][w] += 1
            before = w
    cs = [c for d in count.values() for c in d.values()]
    d = P.discount(cs.count(1), cs.count(2))
    tables = {u: dict.fromkeys(ws, 1) for u, ws in count.items()}

    def guests():
        out = {}
        for ws in tables.values():
            for w, t in ws.items():
                out[w] = out.get(w, 0) + t
        return out

    root = guests()
    once = list(root.values())
    d0, own, v = P.discount(once.count(1), once.count(2)), dict.fromkeys(root, 1), len(root)
    parent = lambda w: (root.get(w, 0) - d0 * own.get(w, 0) + (P.ROOT_THETA + d0 * sum(own.values())) / (v + 1)) / (P.ROOT_THETA + sum(root.values()))

    def draw(c, theta, p, d, u):
        stirling = [1.0]
        for k in range(1, c + 1):
            stirling = [0.0] + [(stirling[t - 1] if t else 0) + ((k - 1 - d * t) * stirling[t] if t < k else 0) for t in range(1, k + 1)]
        weights = [math.prod(theta + d * i for i in range(t)) * p**t * stirling[t] for t in range(1, c + 1)]
        left = u * sum(weights)
        for t, x in enumerate(weights, 1):
            left -= x
            if left <= 0:
                return t
        return c

    unit = lambda sweep, u, w: float(P._unit(seed, sweep, np.array([u], np.uint64), np.array([w], np.uint64))[0])
    sums = {i: [0.0] * (len(toks(t))) for i, t in rows}
    for sweep in range(1, P.BURN_IN + P.SAMPLES + 1):
        new = {u: {w: draw(c, P.THETA + d * (sum(tables[u].values()) - tables[u][w]), parent(w), d, unit(sweep, u, w)) for w, c in ws.items()} for u, ws in count.items()}
        tables = new
        root = guests()
        own = {w: draw(c, P.ROOT_THETA + d0 * (sum(own.values()) - own[w]), 1 / (v + 1), d0, unit(-1 - sweep, 0, w)) for w, c in root.items()}
        if sweep > P.BURN_IN:
            for i, t in rows:
                before = start
                for k, w in enumerate(map(name, toks(t))):
                    ws = count.get(before, {})
                    here = tables.get(before, {})
                    sums[i][k] += (ws.get(w, 0) - d * here.get(w, 0) + (P.THETA + d * sum(here.values())) * parent(w)) / (P.THETA + sum(ws.values()))
                    before = w
    return {i: sum(math.log10(x / P.SAMPLES) for x in xs) for i, xs in sums.items()}


def prose(n, seed=4):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(40)]
    return [(i, " ".join(rng.choices(words, [1 / (k + 1) for k in range(40)], k=rng.randint(0, 30)))) for i in range(n)]


def test_scores_against_a_plain_sampler(spark, monkeypatch):
    monkeypatch.setattr(pitman_yor, "CHUNK_BYTES", 1500)
    rows = prose(120)
    want = plain_scores(rows)
    got = {r.doc_id: r.score for r in pitman_yor.score(write(spark, rows, "doc_id long, text string")).collect()}
    for i, x in want.items():
        assert math.isclose(got[i], x, rel_tol=1e-7), i


def test_scores_do_not_hang_on_partitions(spark, monkeypatch):
    monkeypatch.setattr(pitman_yor, "HOT_SHARE", 20)
    monkeypatch.setattr(pitman_yor, "CHUNK_BYTES", 3000)
    df = write(spark, prose(400, 9), "doc_id long, text string")
    found, before = [], spark.conf.get("spark.sql.shuffle.partitions")
    for n in (3, 8):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        found.append({r.doc_id: r.score for r in pitman_yor.score(df).collect()})
    spark.conf.set("spark.sql.shuffle.partitions", before)
    assert found[0].keys() == found[1].keys()
    assert all(math.isclose(x, found[1][i], rel_tol=1e-9) for i, x in found[0].items())
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("hpy_")]


def test_next_words_are_a_distribution(spark, monkeypatch):
    rows = [r for r in prose(200, 2) if zlib.crc32(str(r[0]).encode()) % 7 != 2]
    words = sorted({w for _, t in rows for w in t.split()})
    free = iter([i for i in range(1000, 9000) if zlib.crc32(str(i).encode()) % 7 == 2])
    probes = {w: next(free) for w in ["", *words, "new"]} | {("w0", w): next(free) for w in ["", *words, "new"]}
    texts = [(i, w if isinstance(w, str) else " ".join(w).strip()) for w, i in probes.items()]
    got = {r.doc_id: 10**r.score for r in pitman_yor.score(write(spark, rows + texts, "doc_id long, text string")).collect()}
    # texts of one word, and of two that begin alike, are parts of what may be said
    assert all(0 < x < 1 for x in got.values())
    assert sum(got[probes[w]] for w in ["", *words, "new"]) + sum(got[probes["w0", w]] for w in [*words, "new"]) < 1


def test_what_is_sent_for_frequent_words_stays_small():
    """Words of the common list go by number; whatever the list, buckets get the same words, texts and counts."""
    rng = random.Random(3)
    lines = [" ".join(f"w{rng.randrange(3000)}" for _ in range(500)).encode() for _ in range(80)]
    words, doc = pitman_yor._tokens(lines)
    kinds, sizes, found = np.unique(words), [], []
    for common in (np.empty(0, np.uint64), kinds[::2], kinds):
        rows = list(pitman_yor._pack_pairs(5, np.arange(80), np.zeros(80, bool), lines, kinds[:9], common, 8))
        pairs = [r.column("data")[0].as_py() for r in rows if r.column("kind")[0].as_py() == pitman_yor._PAIRS]
        sizes.append(sum(map(len, pairs)))
        got = []
        for data in pairs:
            du, nu, numbers, others, w_of, count, docs, _ = pitman_yor.unpack(data)
            w = np.repeat(pitman_yor._names(numbers, others, common)[w_of], count)
            got += zip(np.repeat(np.repeat(np.cumsum(du), nu), count).tolist(), w.tolist(), docs.tolist())
        found.append(sorted(got))
    before = np.where(np.diff(doc, prepend=-1) > 0, pitman_yor._START, np.roll(words, 1))
    assert found[0] == found[1] == found[2] == sorted(zip(before.tolist(), words.tolist(), doc.tolist()))
    assert sizes[2] < 0.85 * sizes[0] and sizes[2] < sizes[1] < sizes[0]


def test_a_bucket_is_merged_in_little_memory():
    """Merging a bucket holds far less than several long arrays for each pair would."""
    rng = np.random.default_rng(8)
    blobs, common = [], np.empty(0, np.uint64)
    for chunk in range(30):
        lines = [" ".join(f"w{x}" for x in rng.integers(0, 20000, 400)).encode() for _ in range(80)]
        rows = pitman_yor._pack_pairs(chunk, np.arange(80), np.zeros(80, bool), lines, common, common, 1)
        blobs += [(chunk, r.column("data")[0].as_py()) for r in rows if r.column("kind")[0].as_py() == pitman_yor._PAIRS]
    tokens = 30 * 80 * 401
    tracemalloc.start()
    rows = pitman_yor._restaurants(0, blobs, common, common, 1)
    state = next(rows).column("data")[0].as_py()
    peak = tracemalloc.get_traced_memory()[1]
    rows.close()
    tracemalloc.stop()
    assert peak < 75 * tokens, peak / tokens
    du, nu, dw, w_of, c, seen, of_chunk, where, chunks = pitman_yor.unpack(state)
    assert int(seen.sum()) == int(c.sum()) == len(where) == len(of_chunk) == tokens and len(chunks) == 30
    assert len(c) == int(nu.sum()) == len(w_of) and len(du) == len(nu) and int(w_of.max()) == len(dw) - 1


def test_empty(spark):
    assert pitman_yor.score(write(spark, [], "doc_id long, text string")).count() == 0


def law(n, theta, p, d):
    """Mean and deviation of the number of tables of n customers, from the generating function (1 - p f) ** (-theta / d), f = 1 - (1 - z) ** d."""
    k = np.arange(1, n + 1)
    f = np.concatenate([[d], d * np.cumprod((k[:-1] - d) / k[1:])])  # coefficients of f from z on
    def powers(a):
        """Coefficients of (1 - p f) ** -a, by g' (1 - p f) = a p f' g."""
        g = np.zeros(n + 1)
        g[0] = 1
        for i in range(1, n + 1):
            g[i] = (np.dot(p * f[: i - 1], (g[1:i] * k[: i - 1])[::-1]) + a * p * np.dot(k[:i] * f[:i], g[:i][::-1])) / i
        return g
    a = theta / d
    over = lambda g, x: np.dot(x, g[::-1])
    all_ = powers(a)[n]
    x = np.concatenate([[0.0], p * f])
    one = a * over(powers(a + 1), x) / all_
    xx = np.convolve(x, x)[: n + 1]
    two = a * (a + 1) * over(powers(a + 2), xx) / all_
    return one, math.sqrt(two + one - one**2)


@pytest.mark.parametrize("n,theta,p,d", [(30, 3.0, 0.3, 0.6), (1000, 40.0, 0.1, 0.7), (3000, 100.0, 0.05, 0.6), (4000, 3000.0, 0.05, 0.7), (4000, 6000.0, 0.03, 0.8)])
def test_tables_against_their_law(n, theta, p, d):
    """Mean and deviation of draws against the closed form, below and above the size from which limits are used."""
    mean, deviation = law(n, theta, p, d)
    k = 3000
    u = np.random.default_rng(7).random(k)
    got = pitman_yor.tables_of(np.full(k, n), np.full(k, theta), np.full(k, p), d, u)
    assert math.isclose(got.mean(), mean, rel_tol=0.08, abs_tol=0.05), (got.mean(), mean)
    assert math.isclose(got.std(), deviation, rel_tol=0.15), (got.std(), deviation)
