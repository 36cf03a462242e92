"""Language by context trees, fill-in-middle cuts and the source audit, against brute force, over odd rows too."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from statutemill.llm import divergence, fill_middle, match_language
from statutemill.llm.sql import OP13

SCHEMA = "doc_id long, text string, lang string, source string, key string, term string, n long"
TOKEN = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def table(spark, rows):
    """rows (doc_id, text, lang, source) beside columns whose names clash with the operators' own."""
    return spark.createDataFrame([(*r, "k", "t", 1) for r in rows], SCHEMA)


def same(got, want):
    return sorted(map(repr, got)) == sorted(map(repr, want))


# fill-in-middle


def cut(i, t):
    t = t or ""
    tokens = TOKEN.findall(t)
    digest = hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    a, b = sorted((h[0] % (len(tokens) + 1), h[1] % (len(tokens) + 1)))
    p, m, s = "".join(tokens[:a]), "".join(tokens[a:b]), "".join(tokens[b:])
    if t == "" or any(x in t for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return (i, len(tokens), "plain", None, None, t)
    return (i, len(tokens), *(("spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}") if h[3] % 100 < 80 else ("psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")))


@pytest.fixture(scope="module")
def cut_rows():
    rng = random.Random(1)
    rows = [(i, "".join(rng.choices("ab é<PSM>你 \n\t", k=rng.randint(0, rng.choice([3, 20, 400, 5000]))))) for i in range(150)]
    rows += [(i, t.replace("<", "")) for i, t in rows[:120]]
    rows += [(None, "a b c"), (None, None), (7, None), (8, ""), rows[3], rows[3], (3, "another text b"), (500, " "), (501, "a" * 5000), (502, " " * 5000), (503, "x y " * 3000), (504, "x" * 2999 + "<P> b"), (505, "x" * 2999 + "< P>")]
    return [(i, t, "en", "s") for i, t in rows]


@pytest.mark.parametrize("piece", [1 << 16, 3000, 1024])
def test_cuts_of_whole_and_piecewise_scans(spark, cut_rows, piece):
    out = fill_middle.transform(table(spark, cut_rows), piece)
    assert same((tuple(r) for r in out.collect()), (cut(i, t) for i, t, *_ in cut_rows))


def test_outputs_restore_their_texts(spark, cut_rows):
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    got = [tuple(r) for r in fill_middle.digests(table(spark, cut_rows)).collect()]
    assert same(got, ((*cut(i, t)[:5], sha(cut(i, t)[5]), sha(t or "")) for i, t, *_ in cut_rows))
    assert fill_middle.digests(table(spark, cut_rows).limit(0)).count() == 0


def test_lanes_compose_associatively():
    rng = np.random.default_rng(2)
    grid = fill_middle._grid(fill_middle._CLASS[rng.choice(np.frombuffer(b"a <PSM>\n", np.uint8), 999)], 7)
    each = fill_middle.functions(grid)
    a, b, c = (tuple(x[:, s::3][:, :40] for x in each) for s in range(3))
    left = fill_middle.compose(fill_middle.compose(a, b), c)
    right = fill_middle.compose(a, fill_middle.compose(b, c))
    assert all((x == y).all() for x, y in zip(left, right))
    state = 0
    for lane, entry in zip(each[0].T, fill_middle.entered(each, 0)[0]):
        assert entry == state
        state = lane[state]


# language


def learns(i):
    return zlib.crc32(str(i if i is not None else "").encode()) % 4 != 2


def brute_length(tree, text, order):
    """Code length in units of the tree {context: Counter}, one byte after another."""
    data, total = b" " * order + text, 0
    for at in range(order, len(data)):
        for k in range(order, -1, -1):
            seen = tree.get(data[at - k : at])
            if seen is None:
                continue
            whole, kinds = sum(seen.values()), len(seen)
            if data[at] in seen:
                total += round(match_language.UNIT * math.log2((whole + kinds) / seen[data[at]]))
                break
            total += round(match_language.UNIT * math.log2((whole + kinds) / kinds))
        else:
            total += 8 * match_language.UNIT
    return total


def brute_tree(blocks, order):
    tree = defaultdict(Counter)
    for b in set(blocks):
        for k in range(order + 1):
            for at in range(k, len(b)):
                tree[b[at - k : at]][b[at]] += 1
    return {c: seen for c, seen in tree.items() if not c or sum(seen.values()) >= match_language.LEAST_SEEN}


@pytest.fixture(scope="module")
def language_rows():
    rng = random.Random(4)
    words = {"aa": ["the", "of", "tion", "ing"], "bb": ["der", "ung", "über", "sch"], "cc": ["que", "ción", "los", "año"]}
    rows = [(i, " ".join(rng.choices(words[lang], k=rng.randint(1, 60))), lang, "s") for i in range(60) for lang in words]
    rows += [(1000, None, "aa", "s"), (1001, "", "aa", "s"), (1002, "12 34!", "bb", "s"), (1003, "ung", None, "s"), (None, "los años", "cc", "s"), rows[5], rows[5], (1004, "x" * 30_000, None, None)]
    return rows


def test_code_lengths_are_those_of_the_trees(spark, language_rows):
    order = match_language.ORDER
    blocks = defaultdict(list)
    for i, t, lang, _ in language_rows:
        if learns(i) and lang and t:
            raw = t.encode()
            blocks[lang] += [raw[s : s + match_language.BLOCK_BYTES] for s in range(0, len(raw), match_language.BLOCK_BYTES)]
    trees = {lang: brute_tree(b, order) for lang, b in blocks.items()}
    got = match_language.predict(table(spark, language_rows)).collect()
    assert len(got) == len(language_rows)
    found = defaultdict(list)
    for r in got:
        found[r["doc_id"]].append((r["held_out"], r["lang_pred"], round(r["score"], 9), r["bits"]))
    want = defaultdict(list)
    for i, t, *_ in language_rows:
        if t and any(c.isalpha() for c in t):
            lengths = {lang: brute_length(tree, t.encode(), order) for lang, tree in trees.items()}
            best = min(sorted(lengths), key=lengths.get)
            share = 1 / sum(2.0 ** ((lengths[best] - n) / match_language.UNIT) for n in lengths.values())
            want[i].append((not learns(i), best, round(share, 9), lengths[best] / match_language.UNIT))
        else:
            want[i].append((not learns(i), "und", 0.0, None))
    assert {k: sorted(map(repr, v)) for k, v in found.items()} == {k: sorted(map(repr, v)) for k, v in want.items()}


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = match_language.predict(docs).where("held_out").join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in got) >= 0.98 * len(got) > 0


def test_language_without_labels_or_rows(spark, language_rows):
    unlabelled = table(spark, [(i, t, None, s) for i, t, _, s in language_rows])
    assert {r["lang_pred"] for r in match_language.predict(unlabelled).collect()} == {"und"}
    assert match_language.predict(unlabelled.limit(0)).count() == 0


def test_sample_is_bounded(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    small, large = (sum(len(r["tree"]) for r in match_language.trained(docs, n).collect()) for n in (1 << 16, 1 << 20))
    assert small < large / 2


# divergence


def audit_rows():
    rng = random.Random(6)
    words = ["".join(rng.choices("abCDéß你", k=rng.randint(1, 3))) for _ in range(60)]
    rows = [(i, " ".join(f"{w}{rng.choice(['', '1', ' -', ','])}" for w in rng.choices(words, k=rng.randint(0, 30))), rng.choice(["en", "de", None]), rng.choice(["a", "b", "ü", None])) for i in range(400)]
    rows += [(900, None, "xx", "a"), (901, "", "xx", "b"), (902, "lonely", "yy", "z"), (903, "A\x00b" * 2000, "en", "only"), rows[0], rows[0], (None, "aa bb", None, None)]
    return rows


def oracle(rows):
    import pandas as pd

    con = duckdb.connect()
    con.register("documents", pd.DataFrame(rows, columns=["doc_id", "text", "lang", "source"]))
    return con.execute(OP13).fetchall()


def test_audit_against_sql(spark):
    rows = audit_rows()
    got = [tuple(r) for r in divergence.audit(table(spark, rows)).collect()]
    want = oracle(rows)
    assert same(got, want) and {r[0] for r in got} >= {"en", "de", "", "xx"}
    assert ("xx", "a", "pair", "b", 0, 1) in got


def test_audit_of_nothing(spark):
    assert divergence.audit(table(spark, audit_rows()).limit(0)).count() == 0


def test_audit_when_sums_are_sent_early(spark, monkeypatch):
    rows = audit_rows()
    monkeypatch.setattr(divergence, "HELD_SUMS", 50)
    monkeypatch.setattr(divergence, "BLOCK_BYTES", 500)
    count, keep = divergence._counter(3), divergence._keeper(30)
    docs = table(spark, rows).selectExpr("coalesce(lang, '') lang", "coalesce(source, '') source", "coalesce(text, '') text").toArrow()
    sent = sorted((b for b in count(iter(docs.to_batches()))), key=lambda b: b.column("shard")[0].as_py())
    assert len(sent) > 30
    kept = Counter()
    for b in keep(iter(sent)):
        for r in b.to_pylist():
            kept[r["lang"], r["source"], r["term"]] += r["n"]
    want, docs_of = Counter(), Counter()
    for _, t, lang, source in rows:
        terms = Counter(re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")))
        for term, n in terms.items():
            want[lang or "", source or "", term] += n
            docs_of[lang or "", term] += 1
    assert kept == Counter({k: n for k, n in want.items() if docs_of[k[0], k[2]] >= 30})
