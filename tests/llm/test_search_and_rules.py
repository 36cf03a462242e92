"""Quality rules, URL filter, top-k search, SimHash, mixing and the pipeline: brute force and odd rows."""

import math
import random
import re

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from statutemill.llm import mixing, quality_rules, simhash, topk_search, url_filter
from statutemill.llm.common import new_path
from statutemill.llm.components import components


def table(spark, rows, schema):
    path = new_path(spark, "t")
    spark.createDataFrame(rows, schema).repartition(3).write.parquet(path)
    return spark.read.parquet(path)


def test_counts_by_hand():
    t = "Aa bb cc dd ee\nAa bb cc dd ee\n\n | #*\tÉ"
    got = dict(zip(quality_rules.COUNTS, quality_rules.text_counts(t)))
    assert got == {"n_words": 13, "word_chars": 24, "n_symbols": 3, "n_dup_lines": 1, "n_repeat_words": 10, "n_lines": 3, "n_capitals": 2}
    assert quality_rules.text_counts(None) == quality_rules.text_counts("") == (0,) * 7


def test_tail_is_binomial():
    for k, n, a in ((0, 10, 0.1), (3, 50, 0.05), (20, 400, 0.06)):
        want = sum(math.comb(n, i) * a**i * (1 - a) ** (n - i) for i in range(k + 1))
        assert math.isclose(quality_rules.tail(k, n, a), want, rel_tol=1e-9)


def test_cutoffs_keep_their_limit(spark):
    """Clean texts stay within the limit in each stratum, junk goes, an unlabelled stratum rejects nothing beyond the base."""
    rng = random.Random(2)
    word = lambda: "".join(rng.choices("abcdefgh", k=6))
    good = lambda: " ".join(word() for _ in range(60))
    junk = lambda: " ".join(word() + "***" for _ in range(60))
    rows = [(i, good() if i % 5 else junk(), "en" if i < 3000 else "fr") for i in range(3100)] + [(4000, None, "en"), (4001, "", None), (None, good(), "en"), (4002, junk(), "fr")]
    docs = table(spark, rows, "doc_id long, text string, lang string")
    labels = table(spark, [(i, int(i % 5 > 0), 0) for i in range(3000)] + [(None, 1, 0), (3, None, 1)], "doc_id long, quality int, toxic int")
    got = quality_rules.judge(docs, labels).collect()
    kept = {r.doc_id: r.kept for r in got}
    assert len(got) == len(rows) and not kept[4000] and not kept[4001] and kept[None]
    assert all(kept[i] for i in range(3100) if i % 5)
    assert not any(kept[i] for i in range(0, 3000, 5)) and kept[4002]
    assert sorted(str(r.doc_id) for r in quality_rules.accepted(docs, labels).collect()) == sorted(str(i) for i, k in kept.items() if k)
    assert quality_rules.judge(docs.limit(0), labels).count() == 0
    assert quality_rules.judge(docs, labels.limit(0)).where("rejected_by is not null").count() == 0


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text("ab/*?.é", min_size=1, max_size=9), min_size=1, max_size=30), st.lists(st.text("ab/.éø", max_size=12), min_size=1, max_size=6))
def test_automaton_against_regex(globs, urls):
    def regex(g):
        out = re.sub(r"\*\*|\*|\?|.", lambda m: {"**": ".*", "*": "[^/]*", "?": "."}.get(m[0], re.escape(m[0])), g)
        # runs of more than two stars are the widest of their parts
        return re.compile(out, re.S)

    got = url_filter.Automaton(tuple(globs)).run(urls, cells=16)
    for i, u in enumerate(urls):
        for j, g in enumerate(globs):
            assert got[i, j] == bool(regex(g).fullmatch(u)), (u, g)


def test_urls(spark):
    rows = [
        (1, "http://A.Example.ORG/es/x?q=/en/1"), (2, "https://example.org/en/12"), (3, "https://notexample.org/en/12#a"), (4, "http://x.com/de/"), (5, "http://com/fr/"), (6, None), (7, "no scheme"),
        (8, "http://x.net?y"), (9, "http://shop.cheap-pills.net/a"), (10, "http://x.net/" + "a" * 50_000 + "/login"), (11, "http://x.com/frx"), (12, ""), (1, "http://A.Example.ORG/es/x"), (None, "x://org"), (13, "ftp://é.org/"),
    ]
    got = {(r.page_id, r.host, len(r.path), r.rule, r.verdict) for r in url_filter.judge(table(spark, rows, "page_id long, url string")).collect()}
    assert got == {
        (1, "a.example.org", 5, "example.org/es/", "block"), (2, "example.org", 6, "example.org/en/1", "block"), (3, "notexample.org", 6, "org/", "allow"), (4, "x.com", 4, "com/de/", "block"),
        (5, "com", 4, "com/fr/", "allow"), (6, "", 0, None, "allow"), (7, "", 0, None, "allow"), (8, "x.net", 0, None, "allow"), (9, "shop.cheap-pills.net", 2, None, "block"),
        (10, "x.net", 50_007, None, "block"), (11, "x.com", 4, None, "allow"), (12, "", 0, None, "allow"), (None, "org", 0, None, "allow"), (13, "é.org", 1, "org/", "allow"),
    }


@pytest.mark.parametrize("kind", ["normal", "long_tail", "same", "huge"])
def test_top_k(spark, kind):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(400, 6))
    if kind == "long_tail":
        x *= rng.pareto(1, 400)[:, None] + 0.01
        x[:200, 0] += 3
    if kind == "same":
        x[50:] = x[50]
    if kind == "huge":
        x *= 1e5
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(500, None), (501, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (502, [float("nan")] * 6), (503, [float("inf")] * 6), (504, [0.0] * 6), (505, [1.0, 2.0]), (None, [1.0] * 6), (7, [float(v) for v in x[7]])]
    v = topk_search.quantised(table(spark, rows, "vec_id long, embedding array<double>"), 256)
    got = {}
    for r in topk_search.top_k(v.where("id % 50 = 0 or id in (7, 505)"), v, 5, block_rows=64, query_rows=4).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    q = {}
    for i, e in rows:
        if i is not None and e is not None and all(z is not None and math.isfinite(z) for z in e):
            q.setdefault(i, []).append([math.floor(256 * z) for z in e])
    want = {}
    for i in [i for i in q if i % 50 == 0 or i in (7, 505)]:
        scores = sorted((-sum(a * b for a, b in zip(q[i][0], c)), j) for j, cs in q.items() for c in cs if j != i and len(c) == len(q[i][0]))
        if scores:
            want[i] = [(n, j, -s) for n, (s, j) in enumerate(scores[:5], 1)]
    assert {i: sorted(r) for i, r in got.items()} == want
    assert topk_search.top_k(v.limit(0), v.limit(0)).count() == 0


def test_keys_of_fingerprints_are_not_broadcast(spark):
    # while fingerprints were few enough, their rows for all tables were broadcast as if there were one table
    fps = table(spark, [(i * 0x9E3779B97F4A7C15 % (1 << 62),) for i in range(200)], "fp long")
    for radius, by_chance in ((simhash.RADIUS, simhash.BY_CHANCE), (simhash.NEAR_RADIUS, 1)):
        assert "Broadcast" not in simhash.links(fps, radius, by_chance)._jdf.queryExecution().executedPlan().toString()


def test_top_k_broadcasts_no_copies_of_queries(spark):
    # a copy of all queries for each lane was joined as if it were one copy, and so broadcast
    v = topk_search.quantised(table(spark, [(i, [float(i), 1.0]) for i in range(50)], "vec_id long, embedding array<double>"), 256)
    assert "Broadcast" not in topk_search.top_k(v, v)._jdf.queryExecution().executedPlan().toString()


def test_top_k_prunes_coordinates_of_long_vectors():
    rng = np.random.default_rng(5)
    rows = np.floor(256 * rng.normal(size=(300, topk_search.COORDINATE_DIM))).astype(np.int64)
    rows[100:200] = rows[0] + rng.integers(-60, 60, (100, rows.shape[1]))
    norm = lambda x: np.sqrt((x.astype(float) ** 2).sum(1))
    rows = rows[np.argsort(-norm(rows))]
    block = (np.arange(300), np.zeros(300, np.int64), norm(rows), rows)
    floor = topk_search._floors(block, block, 5)
    scores = np.where(np.eye(300, dtype=bool), np.iinfo(np.int64).min, rows @ rows.T)
    assert (floor == np.sort(scores, 1)[:, -5]).all() and (floor / norm(rows) / norm(rows).max() >= topk_search.COORDINATE_FROM).any()
    query, ids, got = topk_search._search(block, block, floor, 5)
    want = [(i, j, scores[i, j]) for i in range(300) for j in np.lexsort((np.arange(300), ~scores[i]))[:5]]
    assert list(zip(query, ids, got)) == want


def brute_fingerprint(text, width):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()
    shingles = [b" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))] if words else []
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


@pytest.mark.parametrize("part_rows", [4096, 20])
def test_simhash(spark, monkeypatch, part_rows):
    monkeypatch.setattr(simhash, "PART_ROWS", part_rows)
    rng = random.Random(9)
    words = ["".join(rng.choices("abcdeÉ", k=4)) for _ in range(40)]
    base = [rng.choices(words, k=400) for _ in range(6)]
    rows = []
    for i in range(150):
        w = list(rng.choice(base))
        for _ in range(rng.randint(0, 6)):
            w[rng.randrange(400)] = rng.choice(words)
        rows.append((i, " ".join(w)))
    rows += [(200, None), (201, ""), (202, " \n"), (203, "one two"), (204, "ONE two"), (None, "one two"), (None, "alone at last null"), rows[5], (205, "x")]
    got = simhash.near_duplicates(table(spark, rows, "doc_id long, text string")).collect()
    fps = [(i, brute_fingerprint(t, 3)) for i, t in rows]
    parent = list(range(len(fps)))
    find = lambda a: a if parent[a] == a else find(parent[a])
    for a in range(len(fps)):
        for b in range(a):
            if bin(fps[a][1] ^ fps[b][1]).count("1") <= 3:
                parent[find(a)] = find(b)
    least = {}
    for a, (i, _) in enumerate(fps):
        if i is not None:
            least[find(a)] = min(i, least.get(find(a), i))
    want = sorted(str((i, f"{fp:016x}", least.get(find(a)))) for a, (i, fp) in enumerate(fps))
    assert sorted(str(tuple(r)) for r in got) == want
    assert len({r.component_id for r in got}) < len(got) - 20
    assert simhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**64 - 1), min_size=1, max_size=150), st.integers(1, 12), st.integers(0, 2**32))
def test_bit_sliced_distances(values, radius, seed):
    rng = random.Random(seed)
    near = [v ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, radius + 2))) for v in values[:20]]
    fps, queries = np.array(values, np.uint64), np.array(near, np.uint64)
    got = {(int(a), int(b)) for i, j in simhash.within(queries, fps, radius, tile=7) for a, b in zip(i, j)}
    assert got == {(a, b) for a, q in enumerate(near) for b, v in enumerate(values) if bin(q ^ v).count("1") <= radius}


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(40)] + [(100 + i, 101 + i) for i in range(30)] + [(5, 5)]
    parent = {n: n for e in edges for n in e}
    for _ in parent:
        for a, b in edges:
            m = min(parent[a], parent[b])
            parent[a] = parent[b] = m
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == {n: r for n, r in parent.items() if n != r}


def test_first_of_copies(spark):
    rng = random.Random(5)
    words = ["".join(rng.choices("abcdefgh", k=6)) for _ in range(3000)]
    rows, copies = [], set()
    for i in range(0, 400, 2):
        w = rng.choices(words, k=rng.randint(60, 300))
        rows.append((i, " ".join(w)))
        if i % 4 == 0:
            w = list(w)
            if i % 8:
                w[len(w) // 2] = "changed"
            rows.append((i + 1, " ".join(w)))
            copies.add(i + 1)
    rows += [(900, None), (901, ""), (None, rows[0][1]), rows[4], (902, "short text"), (903, "short text")]
    docs = table(spark, rows, "doc_id long, text string")
    got = sorted(str(r.doc_id) for r in simhash.first_of_copies(docs).collect())
    keep = {i for i, _ in rows if i is not None} - copies - {901, 903}
    assert got == sorted(map(str, keep))


def brute_first_of_copies(rows, width=5, similarity=0.8):
    """The ids that stay, by comparing all pairs; rows are distinct, their ids not null."""
    sets = []
    for _, t in rows:
        w = t.lower().split()
        sets.append({tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))})
    parent = list(range(len(rows)))
    find = lambda a: a if parent[a] == a else find(parent[a])
    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both >= similarity * (len(sets[a]) + len(sets[b]) - both):
                parent[find(a)] = find(b)
    least = {}
    for a, (i, _) in enumerate(rows):
        least[find(a)] = min(i, least.get(find(a), i))
    return sorted(least.values())


@pytest.mark.parametrize("often,part_rows", [(64, 4096), (8, 10)])
def test_copies_just_alike_enough(spark, monkeypatch, often, part_rows):
    """Against brute force: pairs of a similarity about 0.8, chains of them, a large group and a line that many texts share."""
    monkeypatch.setattr(simhash, "COPY_OFTEN", often, raising=False)
    monkeypatch.setattr(simhash, "PART_ROWS", part_rows)
    monkeypatch.setattr(simhash, "_MEET_ROWS", 50, raising=False)
    rng = random.Random(12)
    words = ["".join(rng.choices("abcdefgh", k=6)) for _ in range(3000)]
    line = rng.choices(words, k=12)

    def edited(w, n):
        w = list(w)
        for at in rng.sample(range(len(w)), n):
            w[at] = rng.choice(words)
        return w

    texts = []
    for _ in range(150):
        w = rng.choices(words, k=rng.randint(60, 300))
        texts += [w, edited(w, round(len(w) * rng.uniform(0.015, 0.03)))]
    for _ in range(20):
        w = rng.choices(words, k=200)
        for _ in range(4):
            texts.append(w)
            w = edited(w, 4)
    base = rng.choices(words, k=200)
    texts += [edited(base, rng.randint(1, 5)) for _ in range(60)] + [[*line, *rng.choices(words, k=100)] for _ in range(60)]
    rng.shuffle(texts)
    rows = [(i, " ".join(w)) for i, w in enumerate(texts)]
    got = sorted(r.doc_id for r in simhash.first_of_copies(table(spark, rows, "doc_id long, text string")).collect())
    assert got == brute_first_of_copies(rows)


def test_pipeline_drops_near_copies_by_simhash(spark):
    """The pipeline's stage against all pairs of fingerprints; a large group, long texts that share much, short ones that share little."""
    import corpus_pipeline as p

    rng = random.Random(33)
    words = ["".join(rng.choices("abcdefgh", k=6)) for _ in range(3000)]
    base, line = rng.choices(words, k=400), rng.choices(words, k=12)
    texts = [[*line, *rng.choices(words, k=rng.choice([20, 100]))] for _ in range(60)]
    for n in (60, 150, 300, 500):
        for changed in (1, 2, 4, 6, 9, 14, 20, 40):
            w = rng.choices(words, k=n)
            other = list(w)
            for at in rng.sample(range(n), changed):
                other[at] = rng.choice(words)
            texts += [w, other]
    for _ in range(200):
        w = list(base)
        for at in rng.sample(range(400), rng.randint(1, 12)):
            w[at] = rng.choice(words)
        texts.append(w)
    rng.shuffle(texts)
    rows = [(i, " ".join(w), "en", "s", 1) for i, w in enumerate(texts, 1)]
    rows += [(i, t, "en", "s", 1) for i, t in ((901, None), (902, " \n"), (None, " ".join(base)), (None, "alone at last"), (903, "one two"), (904, "ONE two"))] + [rows[7]]
    got = p.near_copies(spark, table(spark, rows, "doc_id long, text string, lang string, source string, n_chars long"), "")
    fps = [brute_fingerprint(r[1], 3) for r in rows]
    parent = list(range(len(rows)))
    find = lambda a: a if parent[a] == a else find(parent[a])
    for a in range(len(rows)):
        for b in range(a):
            if (fps[a] ^ fps[b]).bit_count() <= 7:
                parent[find(a)] = find(b)
    least = {}
    for a, r in enumerate(rows):
        least[find(a)] = min(r, least.get(find(a), r), key=lambda x: (x[0] is None, x[0]))
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, least.values()))


def test_links_of_a_large_group_stay_few(spark):
    """A group of 600 fingerprints, all within 6 bits of each other: a few links each, not one for each pair."""
    rng = random.Random(34)
    fps = {sum(1 << b for b in rng.sample(range(64), 3)) for _ in range(600)}
    d = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in fps], "fp long")
    made = simhash.links(d, simhash.NEAR_RADIUS, simhash.NEAR_BY_CHANCE)
    assert len(fps) - 1 <= made.count() <= 36 * len(fps)
    assert {r.root for r in components(made).collect()} == {min(f - (1 << 64) if f >> 63 else f for f in fps)}


def test_mixing(spark):
    rng = random.Random(8)
    rows = [(i, "w " * rng.randint(1, 1500), "hot" if i % 3 else f"s{i % 7}", rng.choice(["en", "fr"])) for i in range(1500)] + [(5000, None, None, None), (5001, "", "hot", "en"), (None, "a b", "hot", "en")]
    docs = table(spark, rows, "doc_id long, text string, source string, lang string")
    cells = mixing.stored(mixing._numbered(docs, None).drop("row").groupBy(*mixing.DIMENSIONS).agg(mixing.F.sum("n_tokens").alias("tokens"), mixing.F.count("*").alias("n_docs")), "cells").where("tokens > 0")
    targets = mixing.targets_by_temperature(cells)
    raked = mixing.rake(cells, targets, 24).collect()
    assert math.isclose(sum(r.weight for r in raked), 1, rel_tol=1e-9)
    for d in mixing.DIMENSIONS:
        want = {r.value: r.target for r in targets[d].collect()}
        have = {}
        for r in raked:
            have[r[d]] = have.get(r[d], 0) + r.weight
        for v, t in want.items():
            assert math.isclose(have[v], t / sum(want.values()), rel_tol=1e-3)
    out = mixing.mix(docs).collect()
    assert len(out) == len(rows) and all(0 < r.probability <= 1 for r in out)
    assert sorted(str(r.doc_id) for r in mixing.sample(docs).collect()) == sorted(str(r.doc_id) for r in out if r.kept)
    assert mixing.mix(docs.limit(0)).count() == 0
    hot = [r for r in out if r.source == "hot"]
    assert sum(r.kept for r in hot) / len(hot) < 0.97


def test_probabilities_meet_the_targets(spark):
    """The query's own rows: tokens that its probabilities expect, in each dimension, and those that were drawn."""
    rows = mixing.mix(spark.read.parquet("/root/testdata/sf0.1/documents.parquet")).collect()
    assert max(r.probability for r in rows) == 1
    for d in mixing.DIMENSIONS:
        held, expected, drawn = {}, {}, {}
        for r in rows:
            for of, n in ((held, r.n_tokens), (expected, r.n_tokens * r.probability), (drawn, r.n_tokens * r.kept)):
                of[r[d]] = of.get(r[d], 0) + n
        raised = {v: n ** mixing.TEMPERATURE[d] for v, n in held.items()}
        apart = lambda got: sum(abs(got[v] / sum(got.values()) - t / sum(raised.values())) for v, t in raised.items()) / 2
        assert apart(expected) < 1e-3 and apart(drawn) < 0.025, (d, apart(expected), apart(drawn))


def test_drawn_rows_meet_targets(spark):
    """The pipeline's stage: token shares of the rows it returns, in each dimension, a hot source and rare values among them."""
    import corpus_pipeline as p

    rng = random.Random(18)
    rows = [(i, "w " * rng.choice([20, 40, 300]), "hot" if i % 3 == 0 else f"s{i % 7}", rng.choices(["en", "fr", "da"], [80, 15, 5])[0], 1) for i in range(12_000)] + [(20_000, None, "hot", "en", 0)]
    docs = table(spark, rows, "doc_id long, text string, source string, lang string, n_chars long")
    cells = mixing._numbered(docs, None).groupBy(*mixing.DIMENSIONS).agg(mixing.F.sum("n_tokens").alias("tokens"))
    targets = mixing.targets_by_temperature(cells.where("tokens > 0"))
    got = mixing._numbered(p.source_mix(spark, docs, ""), None).groupBy(*mixing.DIMENSIONS).agg(mixing.F.sum("n_tokens").alias("tokens")).collect()
    assert p.source_mix(spark, docs, "").where("doc_id = 20000").count() == 1
    for d in mixing.DIMENSIONS:
        want = {r.value: r.target for r in targets[d].collect()}
        for v, t in want.items():
            have = sum(r.tokens for r in got if r[d] == v) / sum(r.tokens for r in got)
            assert math.isclose(have, t / sum(want.values()), rel_tol=0.06), (d, v, have, t / sum(want.values()))


def test_no_python_in_mixing(spark, sf):
    plan = mixing.mix(spark.read.parquet(f"{sf}/documents.parquet"))._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


def test_pipeline(spark, sf):
    import corpus_pipeline as p

    assert [n for n, _ in p.STAGES] == ["quality_rules", "simhash_near_dedup", "suffix_array_dedup", "source_mixing", "bpe_encoding"]
    docs = start = spark.read.parquet(f"{sf}/documents.parquet")
    for name, stage in p.STAGES:
        docs = p.stored(stage(spark, docs, sf), name)
        if name != "bpe_encoding":
            assert docs.columns == start.columns
    assert 0 < docs.count() < start.count()
