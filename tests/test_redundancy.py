"""Redundancy against all pairs, joined and in blocks."""

import random

import pytest

from statutemill.operators import validate


def similarity(a, b):
    if a in b or b in a:
        return 1_000_000
    x, y = ({t[i : i + 3] for i in range(len(t) - 2)} for t in (a, b))
    least = min(len(x), len(y))
    shared = len(x & y)
    return shared * 1_000_000 // least if 2 * shared > least else 0


def rows(n):
    rng = random.Random(n)
    base = ["Ligningslovens § 33 A gælder for ophold i udlandet", "Ældre pensionister er ikke omfattet af stk. 2", "x" * 260, "aBcAbC"]
    make = lambda: "".join(c if rng.random() > 0.1 else rng.choice("æøå §1") for c in rng.choice(base))[: rng.randint(0, 230)]
    out = [(d, make()) for d in (1, 2, 3) for _ in range(n)] + [(4, "alone"), (5, None), (5, "")]
    return out + [(1, t) for t in ("", "a", "ab", "b ", "§", None, "AB")] + out[:9]


@pytest.mark.parametrize("few, block", [(64, 1024), (1, 7), (1, 1000), (10, 16)])
def test_mean_over_all_pairs(spark, few, block):
    data = rows(40)
    want = {}
    for d in {d for d, _ in data}:
        heads = [(t or "")[:200].lower() for k, t in data if k == d]
        pairs = [similarity(a, b) for i, a in enumerate(heads) for b in heads[:i]]
        want[d] = (len(heads), sum(pairs) / (len(pairs) * 1_000_000) if pairs else 0.0)
    got = validate.redundancy(spark.createDataFrame(data, "doc_id long, content string"), few=few, block=block).collect()
    assert {r["doc_id"]: (r["n_chunks"], r["redundancy"]) for r in got} == want


def test_a_large_document_in_blocks(spark):
    n = 6000
    data = spark.range(n).selectExpr("1L as doc_id", "concat(cast(id * 7919 % 10007 as string), ' ', substring(sha2(cast(id % 3000 as string), 256), 1, 40)) as content")
    (row,) = validate.redundancy(data).collect()
    assert row["n_chunks"] == n and 0 < row["redundancy"] < 0.01


def test_no_chunks(spark):
    assert validate.redundancy(spark.createDataFrame([], "doc_id long, content string")).count() == 0
