"""Operators on texts against brute force, over planted copies and odd rows."""

import datetime
import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from statutemill.llm import byte_bpe, spans, suffix_dedup, super_kmers, token_files, word_bpe
from statutemill.llm.common import new_path

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, start string, part string"


def corpus():
    """Texts with copies, near copies, shared passages, odd white space, accents; nulls, empty and repeated rows."""
    rng = random.Random(7)
    words = ["".join(rng.choices("abcdeéøñ'.,|", k=rng.randint(1, 7))) for _ in range(300)]
    make = lambda n: " ".join(rng.choices(words, k=n))
    passage, long = make(70), make(30_000)
    rows = []
    for i in range(80):
        t = make(rng.randint(1, 200))
        if i % 5 == 0:
            t += "\n" + passage + "\t" + make(20)
        if i % 7 == 0 and rows:
            old = (rng.choice(rows)[1] or "").split(" ")
            old[len(old) // 2 : len(old) // 2 + 1] = ["XX"]
            t = " ".join(old)
        rows.append((i, t))
    rows += [(90, long), (91, long[:9000] + " new " + long[9000:]), (92, None), (93, ""), (94, " \n\t "), (95, "ab " * 900), (96, "x" * 3000)]
    rows += [(None, passage), (None, passage), rows[3], rows[5], (5, "other text under an id that is taken " + passage)]
    rows += [(97, "İstanbul don't WE'LL é x y <|endoftext|>a 12345 你好"), (98, "<|startoftext|> a b  c"), (-4, passage + passage)]
    rng.shuffle(rows)
    return [(i, t, "en", "s", 1, "clash", "clash") for i, t in rows]


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    # from a table, as operators read it
    path = new_path(spark, "docs")
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(path)
    return spark.read.parquet(path)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def sha(x):
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


def test_repeated_word_windows(spark, docs, rows):
    least, big = {}, 1 << 62
    for i, t, *_ in rows:
        w = (t or "").encode().split()
        for s in range(len(w) - 12):
            k = tuple(w[s : s + 13])
            least[k] = min(least.get(k, big), big if i is None else i)
    want = []
    for i, t, *_ in rows:
        w = (t or "").encode().split()
        gone = set()
        for s in range(len(w) - 12):
            if (big if i is None else i) > least[tuple(w[s : s + 13])]:
                gone.update(range(s, s + 13))
        want.append((i, len(w), len(gone), sha(b" ".join(x for j, x in enumerate(w) if j not in gone))))
    got = [tuple(r) for r in super_kmers.remove_repeats(docs).collect()]
    assert sorted(map(str, got)) == sorted(map(str, want))
    assert sum(r[2] for r in got) > 5000
    assert super_kmers.remove_repeats(empty(spark)).count() == 0


@pytest.mark.parametrize("length", [400, 40])
def test_repeated_byte_strings(spark, docs, rows, length):
    places = defaultdict(int)
    raws = [(i, (t or "").encode()) for i, t, *_ in rows]
    for _, raw in raws:
        for s in range(len(raw) - length + 1):
            places[raw[s : s + length]] += 1
    want = []
    for i, raw in raws:
        gone = np.zeros(len(raw) + 2, bool)
        for s in range(len(raw) - length + 1):
            if places[raw[s : s + length]] > 1:
                gone[s + 1 : s + 1 + length] = True
        kept = bytes(b for b, g in zip(raw, gone[1:-1]) if not g)
        want.append((i, len(raw), int(gone.sum()), int((np.diff(gone.astype(int)) == 1).sum()), sha(kept)))
    got = [tuple(r) for r in suffix_dedup.digests(docs, length).collect()]
    assert sorted(map(str, got)) == sorted(map(str, want))
    assert sum(r[2] for r in got) > 20_000
    assert suffix_dedup.digests(empty(spark), length).count() == 0


@pytest.mark.parametrize(("length", "passage"), [(400, 250), (40, 25), (60, 60)])
def test_passages_are_counted_beside_longer_strings(spark, docs, rows, length, passage):
    """Texts that end in a passage, in longer strings cut short by the end, or hold NUL bytes there are among them."""
    rng = random.Random(5)
    make = lambda n: "".join(rng.choices("abcdefgh ", k=n))
    ends, other = make(390), make(300)
    more = [(200, make(50) + ends), (201, make(70) + ends), (202, ends + "\0" * 20 + make(30)), (203, ends), (204, other + make(9)), (205, make(90) + other + make(90)), (206, other[:249])]
    df = docs.select("doc_id", "text").unionByName(spark.createDataFrame(more, "doc_id long, text string"))
    raws = [(r[0], (r[1] or "").encode()) for r in [*rows, *more]]
    want = []
    for width in (length, passage):
        places = defaultdict(int)
        for _, raw in raws:
            for s in range(len(raw) - width + 1):
                places[raw[s : s + width]] += 1
        gone = []
        for _, raw in raws:
            g = np.zeros(len(raw), int)
            for s in range(len(raw) - width + 1):
                if places[raw[s : s + width]] > 1:
                    g[s : s + width] = 1
            gone.append(g)
        want.append(gone)
    want = [
        (i, len(raw), int(g.sum()), int((np.diff(g, prepend=0) == 1).sum()), sha(bytes(b for b, x in zip(raw, g) if not x)), int(p.sum()))
        for (i, raw), g, p in zip(raws, *want)
    ]
    out = suffix_dedup.digests(df, length, passage=passage)
    assert out.columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_passage_bytes"]
    got = [tuple(r) for r in out.collect()]
    assert sorted(map(str, got)) == sorted(map(str, want))
    assert sorted(map(str, (r[:5] for r in got))) == sorted(str(tuple(r)) for r in suffix_dedup.digests(df, length).collect())
    if (length, passage) == (400, 250):
        assert {r[0]: (r[2], r[5]) for r in got if r[0] in (200, 203, 205, 206)} == {200: (0, 390), 203: (0, 390), 205: (0, 300), 206: (0, 0)}


def test_first_place_stays(spark):
    a, b = "".join(random.Random(1).choices("abcdefgh ", k=900)), "".join(random.Random(2).choices("ijkl ", k=500))
    df = spark.createDataFrame([(2, b + a), (1, a), (3, a[100:700] + "é" + b), (4, a[:399])], "doc_id long, text string")
    got = {r.doc_id: r.text for r in suffix_dedup.kept_texts(df, 400).collect()}
    assert got == {1: a, 2: b, 3: "é", 4: a[:399]}


def test_repeated_rows_keep_their_text(spark):
    a, b = "".join(random.Random(1).choices("abcdefgh ", k=900)), "".join(random.Random(2).choices("ijkl ", k=500))
    df = spark.createDataFrame([(1, a), (1, a), (2, b + a), (2, b + a), (None, b), (None, b), (3, "xy" * 600), (3, "xy" * 600)], "doc_id long, text string")
    once = {(r.doc_id, r.text) for r in suffix_dedup.kept_texts(df.dropDuplicates()).collect()}
    got = sorted(((r.doc_id, r.text) for r in suffix_dedup.kept_texts(df).collect()), key=str)
    assert got == sorted([*once, *once], key=str) and (1, a) in once and (2, b) in once


def shared(a, b):
    return next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))


@pytest.mark.parametrize("hashed", [True, False])
def test_factor_arrays(hashed):
    rng = random.Random(3)
    for trial in range(120):
        length = rng.choice([1, 3, 8, 9, 20, 50])
        text = bytes(rng.choices(b"ab" if trial % 3 else b"abcdefgh", k=rng.randint(60, 150))) * rng.randint(1, 3)
        at = np.array(rng.sample(range(len(text) - length + 1), rng.randint(1, len(text) - length + 1)))
        order, common = suffix_dedup.suffix_order(text, at, length, hashed)
        places = at[order]
        strings = [text[p : p + length] for p in places]
        assert strings == sorted(strings) and sorted(order.tolist()) == list(range(len(at)))
        assert common.tolist() == [0, *map(shared, strings, strings[1:])]
        factor = [max((shared(s, text[q : q + length]) for q in places if q < p), default=0) for s, p in zip(strings, places)]
        assert suffix_dedup.previous_factors(places, common).tolist() == factor
        assert suffix_dedup.previous_factors(places, common, length).tolist() == [f if f >= length else 0 for f in factor]


def test_passages_go_from_later_texts(spark):
    """Passages of 51 to 60 words in up to five texts: the first keeps them, the others lose them and nothing else; other columns stay as they are."""
    rng = random.Random(11)
    words = ["".join(rng.choices("abcdefghijk", k=rng.randint(4, 8))) for _ in range(4000)]
    make = lambda n: " ".join(rng.choices(words, k=n))
    rows, want = [], {}
    moment = datetime.datetime(2024, 2, 3, 4, 5, 6, 123456)
    for g in range(60):
        passage = make(rng.randint(51, 60))
        for k in range(rng.randint(2, 5)):
            i, head, tail = 10 * g + k, make(rng.randint(0, 60)) + " ", " " + make(rng.randint(5, 60))
            rows.append((i, head + passage + tail, k, [g, None], moment))
            want[i] = {head + passage + tail} if k == 0 else {head[: len(head) - a] + tail[b:] for a in range(5) for b in range(5)}  # letters about it may agree too
    rows += [(5000, None, None, None, None), (5001, "clean " + make(200), 9, [], moment)]
    want |= {5000: {""}, 5001: {rows[-1][1]}}
    rng.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_spans int, start array<int>, carry timestamp")
    out = suffix_dedup.kept_texts(docs)
    assert out.schema == docs.schema
    got = {r.doc_id: r for r in out.collect()}
    assert len(got) == len(rows)
    for i, _, *others in rows:
        assert list(got[i])[2:] == others
        assert got[i].text in want[i]
    assert suffix_dedup.kept_texts(docs.limit(0)).count() == 0


def test_common_grams_change_nothing(spark, docs, monkeypatch):
    want = [sorted(map(str, f(docs).collect())) for f in (suffix_dedup.digests, super_kmers.remove_repeats)]
    monkeypatch.setattr(spans, "OFTEN_LEAST", 2)
    monkeypatch.setattr(spans, "BUCKET_BYTES", 10_000)
    rows = spans.keyed(docs)
    assert len(spans.common_grams(rows, 90, lambda texts: super_kmers._low_grams(texts, 3))) > 20
    assert want == [sorted(map(str, f(docs).collect())) for f in (suffix_dedup.digests, super_kmers.remove_repeats)]


@pytest.mark.parametrize("unit", ["bit", "byte"])
def test_token_files(spark, docs, rows, unit):
    path = public_tokenizers.path("byte_bpe_50k.json")
    tok = Tokenizer.from_file(path)
    encoder = lambda: byte_bpe.byte_bpe(path).encode
    files = token_files.write(token_files.in_order(docs, 3), new_path(spark, "ids"), encoder, unit)
    got = [tuple(r) for r in token_files.read_documents(files).collect()]
    want = {}
    for i, t, *_ in rows:
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        want.setdefault(i, []).append((len(ids), zlib.crc32(ids.tobytes())))
    assert sorted(map(str, ((i, n, c) for i, _, n, c in got))) == sorted(str((i, *x)) for i, xs in want.items() for x in xs)
    at = 0
    for i, start, n, _ in sorted(got, key=lambda r: r[1]):
        assert start == at
        at += n
    ids = [r[0] for r in sorted(got, key=lambda r: r[1])]
    assert ids == sorted(ids, key=lambda i: (i is None, i or 0))
    assert token_files.read_documents(token_files.write(token_files.in_order(empty(spark)), new_path(spark, "ids"), encoder)).count() == 0


def test_planes_round_trip():
    rng = np.random.default_rng(0)
    for n in (0, 1, 7, 1000):
        for top in (1, 2, 255, 256, 50_000, 2**32 - 1):
            ids = rng.integers(0, top, n, dtype=np.uint64).astype(np.uint32)
            for unit in ("bit", "byte"):
                assert (token_files.join_planes(token_files.split_planes(ids, unit), n, unit) == ids).all()


def test_word_table(spark, docs, rows, monkeypatch):
    monkeypatch.setattr(word_bpe, "CHUNK_BYTES", 20_000)
    path = public_tokenizers.path("word_bpe_49k.json")
    tok = Tokenizer.from_file(path)
    want, texts = [], []
    for i, t, *_ in rows:
        ids = tok.encode(t or "", add_special_tokens=False).ids
        text = tok.decode(ids, skip_special_tokens=False)
        want.append((i, len(ids), sha(np.array(ids, "<u4").tobytes()), sha(text)))
        texts.append((i, text))
    got = [tuple(r) for r in word_bpe.digests(docs, path).collect()]
    assert sorted(map(str, got)) == sorted(map(str, want))
    ids = spark.createDataFrame([(r.doc_id, np.frombuffer(r.ids, "<u4").tolist()) for r in word_bpe.encode(docs, path).collect()], "doc_id long, ids array<int>")
    assert sorted(map(str, (tuple(r) for r in word_bpe.decode(ids, word_bpe.piece_table(spark, path)).collect()))) == sorted(map(str, texts))
    assert word_bpe.digests(empty(spark), path).count() == 0
