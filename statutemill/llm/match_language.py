"""Language by prediction by partial matching: which language's frozen context tree codes a text in the fewest bits.

A tree holds, for every context of up to ORDER bytes that its language's training text has at least twice, the bytes that
followed and how often. A byte is coded in the longest context that the tree has; one not seen there escapes to the next
shorter one, down to all 256 bytes being alike (method C: of T bytes seen after a context, d of them distinct, a byte
seen c times has probability c / (T + d), an escape d / (T + d)). Nothing is learned while texts are scored, so what a
byte costs hangs on it and the ORDER bytes before it alone; before a text stand blanks. Costs are whole numbers of
1 / UNIT bits, so code lengths are exact sums.

Trees are fitted on a bounded sample of labelled documents: whole blocks of their texts, chosen by a hash over all of
them, SAMPLE_BYTES a language on average. Scoring reads every byte of every text.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import batch, pack, trim, unpack

#: Bytes of context; a byte and its context make one 64-bit key.
ORDER = 5
#: Training text of a language, on average, in blocks of BLOCK_BYTES: the bound of what a tree is fitted on.
SAMPLE_BYTES, BLOCK_BYTES = 1 << 20, 4 << 10
#: A context that was seen less often is left out of its tree.
LEAST_SEEN = 2
#: Costs are in 1 / UNIT bits.
UNIT = 1 << 12
#: Bytes of text that are scored at a time.
SCORE_BYTES = 4 << 20

_TREE_SQL = "lang string, tree binary"
_OUT_SQL = "doc_id long, held_out boolean, lang_pred string, score double, bits double"
_OUT = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("lang_pred", pa.string()), ("score", pa.float64()), ("bits", pa.float64())])


def held_out() -> Column:
    """Documents that nothing is learned from: crc32 of the id as text leaves 2 when divided by 4. A null id counts as ''."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 4 == 2


def _keys(data: np.ndarray, size: int) -> np.ndarray:
    """The size bytes that end at each place from size - 1 on, as one number, the first of them highest."""
    out = np.zeros(max(0, len(data) - size + 1), np.uint64)
    for j in range(size):
        out = (out << np.uint64(8)) | data[j : j + len(out)]
    return out


def fit(blocks: list[bytes]) -> bytes:
    """The packed tree of a language: for each order, keys of (context, byte) with their costs, and contexts with the cost of an escape."""
    arrays = []
    for order in range(ORDER + 1):
        grams = [_keys(np.frombuffer(b, np.uint8), order + 1) for b in blocks]
        keys, n = np.unique(np.concatenate(grams) if grams else np.empty(0, np.uint64), return_counts=True)
        context = keys >> np.uint64(8)
        first = np.flatnonzero(np.concatenate([[True], context[1:] != context[:-1]])) if len(keys) else np.empty(0, np.intp)
        seen, kinds = np.add.reduceat(n, first) if len(first) else n, np.diff(np.append(first, len(keys)))
        kept = seen >= LEAST_SEEN if order else seen > 0
        of = np.repeat(np.arange(len(first)), kinds)
        inside = kept[of]
        bits = lambda part, whole: np.round(UNIT * np.log2(whole / part)).astype(np.int32)
        arrays += [keys[inside], bits(n[inside], (seen + kinds)[of][inside]), context[first[kept]], bits(kinds[kept], (seen + kinds)[kept])]
    return pack(*arrays)


def _at(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of wanted in sorted keys, and whether they are there."""
    if not len(keys):
        return np.zeros(len(wanted), np.intp), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, keys[at] == wanted


class Trees:
    """Frozen trees of all languages, in order of their names."""

    def __init__(self, packed: list[tuple[str, bytes]]) -> None:
        self.names = sorted(name for name, _ in packed)
        by_name = dict(packed)
        self.trees = [unpack(by_name[name]) for name in self.names]

    def costs(self, keys: np.ndarray) -> np.ndarray:
        """keys x languages: what the last byte of each key costs after the ORDER bytes before it. keys are sorted."""
        out = np.zeros((len(keys), len(self.trees)), np.int32)
        for column, tree in enumerate(self.trees):
            cost, rest = out[:, column], np.arange(len(keys))
            for order in range(ORDER, -1, -1):
                grams, gram_cost, contexts, escape = tree[4 * order : 4 * order + 4]
                short = keys[rest] & np.uint64((1 << 8 * (order + 1)) - 1)
                at, found = _at(grams, short)
                cost[rest[found]] += gram_cost[at[found]]
                rest, short = rest[~found], short[~found]
                at, known = _at(contexts, short >> np.uint64(8))
                cost[rest[known]] += escape[at[known]]
            cost[rest] += 8 * UNIT
        return out

    def lengths(self, texts: list[bytes]) -> np.ndarray:
        """texts x languages: code lengths in 1 / UNIT bits, exact."""
        blank = b" " * ORDER
        data = np.frombuffer(b"".join([blank + t for t in texts]), np.uint8)
        sizes = np.array([len(t) for t in texts], np.int64)
        ends = np.cumsum(sizes + ORDER)
        place = np.ones(len(data), bool)
        for j in range(ORDER):
            place[ends - sizes - ORDER + j] = False
        keys = _keys(data, ORDER + 1)[place[ORDER:]]
        of, distinct = pd.factorize(keys)
        order = np.argsort(distinct)
        cost = np.empty((len(distinct), len(self.trees)), np.int32)
        cost[order] = self.costs(distinct[order])
        out = np.zeros((len(texts), len(self.trees)), np.int64)
        full = np.flatnonzero(sizes)
        starts = (np.cumsum(sizes) - sizes)[full]
        for column in range(len(self.trees)):
            if len(full):
                out[full, column] = np.add.reduceat(cost[of, column], starts, dtype=np.int64)
        return out


@lru_cache(maxsize=1)
def _trees(model) -> Trees:
    return Trees(model.value)


def trained(docs: DataFrame, sample_bytes: int = SAMPLE_BYTES) -> DataFrame:
    """lang, tree of every language in the labelled documents that are not held out.

    Texts are cut in blocks; a block is in the sample if its hash is below its language's rate, so copies are taken or
    left together and count once, and a long document weighs as much as short ones of that size.
    """
    rows = docs.where(~held_out() & F.col("lang").isNotNull() & (F.octet_length("text") > 0)).select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    # a row a language, like the trees
    rates = rows.groupBy("lang").agg((sample_bytes / F.sum(F.octet_length("text").cast("double"))).alias("rate"))
    data, size = F.col("text").cast("binary"), F.octet_length("text")
    cut = F.transform(F.sequence(F.lit(0), ((size - 1) / BLOCK_BYTES).cast("int")), lambda i: F.substring(data, i * BLOCK_BYTES + 1, F.lit(BLOCK_BYTES)))
    share = lambda c: F.pmod(F.xxhash64(c), F.lit(1 << 30)) / float(1 << 30)
    blocks = rows.join(F.broadcast(rates), "lang").select("lang", "rate", F.explode(F.filter(cut, lambda b: share(b) < F.col("rate"))).alias("block"))

    def grow(key: tuple, found: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"lang": [key[0]], "tree": [fit(sorted(found["block"]))]})

    return blocks.select("lang", "block").distinct().groupBy("lang").applyInPandas(grow, _TREE_SQL)


def predict(docs: DataFrame, sample_bytes: int = SAMPLE_BYTES) -> DataFrame:
    """doc_id, held_out, lang_pred, score, bits (the best language's code length) of every row of docs.

    lang_pred is und, score 0 and bits null where text is null or has no letter, or where nothing could be learned. score is
    the best language's share of the probabilities of the text under all trees; of equally short codes the least name wins.
    Repeated rows each get a row; other columns are not read, and lang only where it is learned from.
    """
    packed = [(r["lang"], r["tree"]) for r in trained(docs, sample_bytes).collect()]  # one row a language, of SAMPLE_BYTES of text
    model = docs.sparkSession.sparkContext.broadcast(packed)
    letters = F.coalesce(F.regexp_like("text", F.lit(r"\p{L}")), F.lit(False))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), F.when(letters, F.col("text").cast("string")).alias("text"))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = _trees(model)
        for b in batches:
            texts, at = b.column("text"), 0
            while at < len(b):
                held, size, upto = [], 0, at
                while upto < len(b) and (upto == at or size < SCORE_BYTES):
                    held.append(texts[upto].as_buffer().to_pybytes() if texts[upto].is_valid else None)
                    size, upto = size + len(held[-1] or b""), upto + 1
                yield batch(_OUT, doc_id=b.column("doc_id").slice(at, upto - at), held_out=b.column("held_out").slice(at, upto - at), **_best(trees, held))
                at = upto
        trim()

    return rows.mapInArrow(score, _OUT_SQL)


def _best(trees: Trees, texts: list[bytes | None]) -> dict[str, list]:
    known = [i for i, t in enumerate(texts) if t is not None] if trees.names else []
    out = {"lang_pred": ["und"] * len(texts), "score": [0.0] * len(texts), "bits": [None] * len(texts)}
    if known:
        lengths = trees.lengths([texts[i] for i in known])
        best = lengths.argmin(1)
        least = lengths[np.arange(len(known)), best]
        shares = 1 / np.exp2(np.maximum(least[:, None] - lengths, -1000 * UNIT) / UNIT).sum(1)
        for i, k, s, n in zip(known, best.tolist(), shares.tolist(), least.tolist()):
            out["lang_pred"][i], out["score"][i], out["bits"][i] = trees.names[k], s, n / UNIT
    return out
