"""Lexicons as tables against plain search."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from statutemill.operators import clean, lexicon, validate


def test_labels_in_the_lexicons_order(spark):
    rows = [(1, "en pensionist, og pension"), (2, "pensionister"), (3, None), (4, ""), (5, "søfolk§pension_x æpension pension"), (6, "a.b a+b")]
    terms = [(2, "P", "pensionist", True), (2, "P", "pension", True), (1, "S", "søfolk", True), (3, "plain", "pension", False), (4, "dot", "a.b", False), (5, "empty", "", False), (6, "null", None, False)]
    got = lexicon.labelled(spark.createDataFrame(rows, "id long, t string"), F.col("t"), spark.createDataFrame(terms, "position long, label string, term string, whole_word boolean")).collect()
    assert {r["id"]: r["labels"] for r in got} == {1: ["P", "plain"], 2: ["plain"], 3: [], 4: [], 5: ["S", "P", "plain"], 6: ["dot"]}


@pytest.mark.parametrize("shard", [16 << 20, 200])
def test_many_terms_equal_plain_search(spark, shard):
    rng = random.Random(3)
    word = lambda: "".join(rng.choices("abæ ", k=rng.randint(1, 5)))
    terms = sorted({(t, rng.random() < 0.5) for t in (word() for _ in range(60)) if t.strip() == t})
    texts = [(i, "".join(rng.choices("abæ .", k=60))) for i in range(80)]
    table = spark.createDataFrame([(t, w, f"{t}/{w}") for t, w in terms], "term string, whole_word boolean, label string")
    got = {r["id"]: r["labels"] for r in lexicon.labelled(spark.createDataFrame(texts, "id long, t string"), F.col("t"), table, shard_bytes=shard).collect()}
    assert got == {i: sorted(f"{t}/{w}" for t, w in terms if (re.search(rf"\b{re.escape(t)}\b", x) if w else t in x)) for i, x in texts}


def test_word_characters():
    assert all(map(lexicon.is_word, "aÆé9_‿́‍Ⅳ")) and not any(map(lexicon.is_word, " .§-+²\n"))


def test_time_does_not_grow_with_terms():
    rng = random.Random(5)
    texts = [" ".join("".join(rng.choices("abcdefghij", k=8)) for _ in range(400)) for _ in range(60)]

    def took(n):
        machine = lexicon.Terms([("".join(rng.choices("klmnopqrst", k=10)), True) for _ in range(n)] + [("abc", True)])
        began = time.process_time()
        for t in texts:
            machine.found(t)
        return time.process_time() - began

    few = min(took(10) for _ in range(5))
    assert min(took(10_000) for _ in range(5)) < 5 * few + 0.02


def test_tables_of_needles_equal_single_filters(spark, sf):
    from statutemill.jobs import derive

    chunks = derive.chunks(spark, sf).cache()
    needles = [" UDLANDET ", "Brand#1", "§ 7", "gælder ikke", "absent", "", "LEMPELSE"]
    got = {(r["needle"], r["chunk_id"]) for r in lexicon.text_filters(chunks, spark.createDataFrame([(n,) for n in needles], "needle string")).collect()}
    assert got == {(n, r["chunk_id"]) for n in needles if n for r in clean.text_filter(chunks, n).select("chunk_id").collect()}


@pytest.mark.parametrize("few, block", [(4096, 10_000), (0, 10_000), (0, 3)])
def test_containment_joined_and_in_blocks(spark, few, block):
    rng = random.Random(7)
    word = lambda: "".join(rng.choices("aBæ", k=rng.randint(0, 6)))
    want = [(d, word()) for d in (1, 2) for _ in range(40)] + [(3, "only"), (4, None)]
    have = [(d, [word() + "x" for _ in range(3)] + [None, ""]) for d in (1, 2) for _ in range(4)] + [(4, None)]
    got = validate.missing_by_containment(spark.createDataFrame(want, "doc_id long, e string"), spark.createDataFrame(have, "doc_id long, e array<string>"), "e") if few == 4096 else lexicon.missing_by_containment(spark.createDataFrame(want, "doc_id long, e string"), spark.createDataFrame(have, "doc_id long, e array<string>"), "e", few, block)
    held = lambda d, e: any(h and (h.lower() in e.lower() or e.lower() in h.lower()) for k, hs in have if k == d and hs for h in hs)
    assert sorted(tuple(r) for r in got.collect()) == sorted({(d, e) for d, e in want if e and not held(d, e)})
