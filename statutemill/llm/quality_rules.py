"""Quality rules whose cutoffs are chosen on labelled holdouts with a bound on false rejection.

Each rule rejects a document whose feature lies above a cutoff. Cutoffs come from fixed grids, ordered from lenient to
strict. In every stratum a cutoff counts as safe if the exact binomial tail P(Bin(n, a) <= k) of its k false rejections
among n good labelled documents is at most the error budget (the exact Clopper-Pearson upper bound on its false
rejection rate is then below a). Testing in fixed order stops at the first unsafe cutoff, so a grid costs no correction;
the error budget is divided over all (stratum, rule) pairs (Bonferroni). Of safe cutoffs the most useful is taken. The limit on false rejection is divided over
the rules, so that all rules together keep it (union bound) in every stratum, with probability 1 - delta at least.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from .common import batch, stored

#: rule -> (numerator, denominator, cutoffs from lenient to strict); a document above the cutoff is rejected.
RULES: dict[str, tuple[str, str, tuple[float, ...]]] = {
    "symbols": ("n_symbols", "n_words", (2.0, 1.0, 0.75, 0.5, 0.35, 0.25, 0.15, 0.1, 0.05)),
    "capitals": ("n_capitals", "word_chars", (0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.2)),
    "duplicate_lines": ("n_dup_lines", "n_lines", (0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.2)),
    "repeats": ("n_repeat_words", "n_words", (0.18, 0.15, 0.12, 0.1, 0.08, 0.05)),
}
#: Most false rejections allowed in a stratum, and the chance that any bound fails.
ALPHA, DELTA = 0.05, 0.05
MIN_WORDS, MAX_REPEAT_PERCENT = 10, 20
REPEAT_WINDOW = 5

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_capitals")
_SYMBOLS, _SPACES = "#*$%&|<>", " \t\n\v\f\r"
_CAPITALS = bytes(range(65, 91))


def text_counts(text: str | None) -> tuple[int, ...]:
    """COUNTS of one text; null and empty texts give zeros. Words lie between ASCII white space."""
    if not text:
        return (0,) * len(COUNTS)
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    lines = [x for x in text.split("\n") if x.strip(_SPACES)]
    repeats, n = 0, len(words)
    if n > REPEAT_WINDOW:
        windows = list(zip(*(words[i:] for i in range(REPEAT_WINDOW))))
        if len(set(windows)) < len(windows):
            seen = Counter(windows)
            starts = np.flatnonzero(np.fromiter((seen[x] > 1 for x in windows), bool, len(windows)))
            edge = np.zeros(n + 1, np.int32)
            np.add.at(edge, starts, 1)
            np.add.at(edge, starts + REPEAT_WINDOW, -1)
            repeats = int((np.cumsum(edge)[:n] > 0).sum())
    return (
        n,
        len(text) - sum(map(text.count, _SPACES)),
        sum(map(text.count, _SYMBOLS)),
        len(lines) - len(set(lines)),
        repeats,
        len(lines),
        len(raw) - len(raw.translate(None, _CAPITALS)),
    )


def features(docs: DataFrame, stratum_col: str = "lang") -> DataFrame:
    """doc_id, stratum and COUNTS of every document, from whole texts; one row a row of docs. A null stratum is ''."""
    out = pa.schema([("doc_id", pa.int64()), ("stratum", pa.string()), *((c, pa.int64()) for c in COUNTS)])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [text_counts(x.as_py()) for x in b.column("text")]
            yield batch(out, doc_id=b.column("doc_id"), stratum=b.column("stratum"), **{c: [r[i] for r in rows] for i, c in enumerate(COUNTS)})

    kinds = {"doc_id": "long", "stratum": "string"}
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.coalesce(F.col(stratum_col).cast("string"), F.lit("")).alias("stratum"))
    return rows.mapInArrow(count, ", ".join(f"{f.name} {kinds.get(f.name, 'long')}" for f in out)).withColumn("base_failed", _base_failed())


def _base_failed():
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def tail(k: int, n: int, a: float) -> float:
    """P(Bin(n, a) <= k), exact up to rounding."""
    i = np.arange(k + 1)
    logs = np.array([math.lgamma(n + 1) - math.lgamma(x + 1) - math.lgamma(n - x + 1) for x in i]) + i * math.log(a) + (n - i) * math.log1p(-a)
    return float(min(1.0, np.exp(logs).sum()))


@F.pandas_udf(T.DoubleType())
def _tails(k: pd.Series, n: pd.Series, a: pd.Series) -> pd.Series:
    # more than a tenth above the mean cannot be safe: the sum over k terms is then skipped
    return pd.Series([1.0 if x > 1.1 * m * p + 1 else tail(int(x), int(m), float(p)) for x, m, p in zip(k, n, a)], dtype=float)


def _value(rule: str):
    top, below, _ = RULES[rule]
    return F.coalesce(F.col(top) / F.when(F.col(below) > 0, F.col(below)), F.lit(0.0))


def cutoffs(feats: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """A row for each stratum with labelled documents: a safe cutoff of each rule (null: none is safe and of use).

    Holdouts are labelled documents that the base rules keep; good ones decide what is safe. Of safe cutoffs the one
    that rejects most bad documents beyond good ones is taken, the most lenient on ties; all safe ones hold at once, so
    the choice costs nothing. If labels has several rows for a document, one that calls it good suffices; null ids and
    qualities count for nothing.
    """
    known = labels.where("doc_id is not null and quality in (0, 1)").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((F.max("quality") == 1).alias("good"))
    held = feats.where(~F.col("base_failed")).join(known, "doc_id")
    grid = [(r, j, c) for r, (_, _, cuts) in RULES.items() for j, c in enumerate(cuts)]
    above = lambda r, c, good: F.sum(((_value(r) > c) & (F.col("good") == good)).cast("long"))
    counts = held.groupBy("stratum").agg(
        F.sum(F.col("good").cast("long")).alias("n"), *(above(r, c, g).alias(f"{p}{i}") for i, (r, _, c) in enumerate(grid) for p, g in (("k", True), ("b", False)))
    )
    counts = stored(counts, "quality-holdouts")  # one row a stratum
    strata = max(1, counts.where("n > 0").count())
    tests = ", ".join(f"'{r}', {j}, {c}D, k{i}, b{i}" for i, (r, j, c) in enumerate(grid))
    order = W.partitionBy("stratum", "rule").orderBy("step")
    safe = (
        counts.where("n > 0").select("stratum", "n", F.expr(f"stack({len(grid)}, {tests}) as (rule, step, cutoff, k, b)"))
        .withColumn("p", _tails("k", "n", F.lit(alpha / len(RULES))))
        .withColumn("safe", F.min((F.col("p") <= delta / (strata * len(RULES))).cast("int")).over(order) == 1)
    )
    useful = lambda r: F.when(F.col("safe") & (F.col("rule") == r) & (F.col("b") > F.col("k")), F.struct((F.col("b") - F.col("k")).alias("gain"), "cutoff"))
    return safe.groupBy("stratum").agg(F.first("n").alias("n_holdout"), *(F.max(useful(r))["cutoff"].alias(f"cut_{r}") for r in RULES))


@F.pandas_udf(T.StructType([T.StructField(c, T.LongType()) for c in COUNTS]))
def _counts(text: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([text_counts(x) for x in text], columns=list(COUNTS))


def _verdict(rows: DataFrame, cuts: DataFrame) -> DataFrame:
    broken = F.coalesce(*(F.when(_value(r) > F.col(f"cut_{r}"), F.lit(r)) for r in RULES))
    return rows.join(cuts, "stratum", "left").withColumn("rejected_by", broken).withColumn("kept", ~F.col("base_failed") & F.col("rejected_by").isNull())


def accepted(docs: DataFrame, labels: DataFrame, stratum_col: str = "lang", alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """The rows of docs that judge() keeps, all columns. Texts are counted where they lie and are not shuffled."""
    cuts = cutoffs(features(docs, stratum_col), labels, alpha, delta)
    counts = _counts.asNondeterministic()(F.col("text").cast("string"))
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.coalesce(F.col(stratum_col).cast("string"), F.lit("")).alias("stratum"), counts.alias("c"))
    rows = rows.select("row", "stratum", *(F.col(f"c.{c}").alias(c) for c in COUNTS)).withColumn("base_failed", _base_failed())
    return _verdict(rows, cuts).where("kept").select("row.*")


def judge(docs: DataFrame, labels: DataFrame, stratum_col: str = "lang", alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """Counts, base_failed, the name of the first rule broken (rejected_by; null: none) and kept for every document.

    Null and empty texts have no words, so the base rules fail them. Repeated rows and ids each get a row. A null or
    unlabelled stratum has no cutoffs and rejects nothing beyond the base rules; empty tables give an empty result.
    Columns of docs beyond doc_id, text and the stratum are not read.
    """
    feats = stored(features(docs, stratum_col), "quality-features")
    return _verdict(feats, cutoffs(feats, labels, alpha, delta))
