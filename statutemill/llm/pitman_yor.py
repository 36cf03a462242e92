"""Hierarchical Pitman-Yor language model over words.

Each context (the word before) is a Chinese restaurant whose dishes are the words that follow; all share one parent, the
root restaurant, whose customers are their tables and whose base is uniform over the training vocabulary and one unknown
word. Seatings are sampled by Gibbs, a dish at a time: all its customers leave and are seated again, which comes to drawing
the number of its tables from its law given all other dishes (tables are all that the model's predictions ask of a
seating). Each sweep draws every dish of every context from the counts of the sweep before, sends the tables that opened
and closed to the root, seats the root's customers anew, and returns its counts to the contexts. A text's score is the
log10 of predictive probabilities averaged over samples.

Work is dealt by context. A task packs the word pairs of a chunk of texts by bucket; a bucket merges them into
restaurants (a bucketed table). Contexts that hold over 1 / HOT_SHARE of all tokens are dealt by dish as well, and add up
their customers and tables. Draws hang on the seed, the sweep and the dish's words alone, totals are the whole corpus's:
how work is dealt changes no score. Words are told apart by 64-bit hashes.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import NULL_ID, batch, by_group, new_path, pack, partitions, stored, trim, unpack
from .spans import mix
from .super_kmers import _words, word_hashes

#: Documents whose crc32(doc_id as text) leaves HELD_OUT modulo FOLDS are scored only.
FOLDS, HELD_OUT = 7, 2
#: Concentrations of root and contexts; discounts follow from the counts of counts.
ROOT_THETA, THETA = 5.0, 1.0
SAMPLES, BURN_IN = 3, 1
HOT_SHARE = 1000
CHUNK_BYTES = 4 << 20
#: Words that go to buckets by their number in a list that all tasks have, not by hash: the most frequent of about so many chunks.
COMMON, COMMON_CHUNKS = 1 << 16, 16
#: Bytes of text whose pairs make a bucket, about; a quarter of that where there would be fewer buckets than partitions.
BUCKET_BYTES = 16 << 20
#: Buckets for each part of the root's words: so many blobs fewer go between them.
ROOT_SHARE = 4
#: Rows (texts, or blobs of up to some 100 KB) that go to Python at a time; the JVM and Python hold each such batch several times.
ROWS = 64
#: Dishes of up to so many customers are drawn from their law itself, larger ones from its limits.
EXACT = 1024
#: Dishes worked on at a time, where arrays of a number for each would be large.
PART = 1 << 18

_START, _END = np.uint64(0x243F6A8885A308D3), np.uint64(0x13198A2E03707344)
_PAIRS, _DOCS, _STATE, _DISHES, _TABLES, _HOT, _COUNTS, _SEATS = range(8)
_ROW = pa.schema([("bucket", pa.int64()), ("kind", pa.int32()), ("source", pa.int64()), ("a", pa.int64()), ("b", pa.int64()), ("data", pa.binary())])
_ROW_SQL = "bucket long, kind int, source long, a long, b long, data binary"


def _row(bucket: int, kind: int, source: int, data: bytes | None, a: int = 0, b: int = 0) -> pa.RecordBatch:
    return batch(_ROW, bucket=[bucket], kind=[kind], source=[source], a=[a], b=[b], data=[data])


def _small(a: np.ndarray) -> np.ndarray:
    """The same whole numbers in as few bytes as they need."""
    top = int(a.max(initial=0))
    return a.astype("<u1" if top < 1 << 8 else "<u2" if top < 1 << 16 else "<u4" if top < 1 << 32 else "<u8")


def _sorted_hashes(h: np.ndarray) -> np.ndarray:
    return np.diff(h, prepend=np.uint64(0))


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, np.ndarray, list[bytes]]]:
    """(chunk, doc ids, held out, normalised lines of words) for each CHUNK_BYTES of texts."""
    from pyspark import TaskContext

    base, made, ids, held, lines, size = TaskContext.get().partitionId() << 32, 0, [], [], [], 0
    for b in batches:
        for i, h, t in zip(b.column("doc_id").to_pylist(), b.column("held_out").to_pylist(), b.column("text")):
            line = b" ".join((t.as_py() or "").encode("utf-8", "surrogatepass").lower().split())
            if ids and size + len(line) > CHUNK_BYTES:
                yield base + made, np.array(ids, np.int64), np.array(held, bool), lines
                made, ids, held, lines, size = made + 1, [], [], [], 0
            ids.append(i)
            held.append(h)
            lines.append(line)
            size += len(line)
    if ids:
        yield base + made, np.array(ids, np.int64), np.array(held, bool), lines


def _tokens(lines: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens (words, then one end a text) and the text of each."""
    filled = [x for x in lines if x]
    if filled:
        buf = np.frombuffer(b"\n".join(filled), np.uint8)
        starts, ends, line = _words(buf)
        words = word_hashes(buf, starts, ends)
        per = np.bincount(line, minlength=len(filled))
    else:
        words, per = np.empty(0, np.uint64), np.empty(0, np.int64)
    n = np.zeros(len(lines), np.int64)
    n[[i for i, x in enumerate(lines) if x]] = per
    doc = np.repeat(np.arange(len(lines)), n + 1)
    end = np.zeros(len(doc), bool)
    end[np.cumsum(n + 1) - 1] = True
    out = np.empty(len(doc), np.uint64)
    out[end], out[~end] = _END, words
    return out, doc


def frequent_words(rows: DataFrame, chunks: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of words: those that may hold over 1 / HOT_SHARE of all tokens (fewer than 2 * HOT_SHARE, whatever the corpus), and, sorted, COMMON frequent ones.

    The latter, of a sample of the corpus's chunks (about so many in all), only shorten what is sent: any list gives the same scores.
    """
    every = np.uint64(max(1, chunks // COMMON_CHUNKS))

    def often(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = pa.schema([("word", pa.int64()), ("n", pa.int64()), ("sampled", pa.bool_())])
        for chunk, _, _, lines in _chunks(batches):
            words, _ = _tokens(lines)
            kinds, n = np.unique(words, return_counts=True)
            many = n * 2 * HOT_SHARE >= len(words)
            word, total = kinds[many].view(np.int64), n[many]
            yield batch(out, word=np.append(word, 0), n=np.append(total, -len(words)), sampled=np.zeros(len(word) + 1, bool))
            if mix(np.array([chunk], np.uint64))[0] % every == 0:
                again = n > 2
                yield batch(out, word=kinds[again].view(np.int64), n=n[again], sampled=np.ones(int(again.sum()), bool))
            trim()

    counts = stored(rows.mapInArrow(often, "word long, n long, sampled boolean"), "hpy-often")
    total = counts.where("n < 0").agg(F.sum(-F.col("n"))).head()[0] or 0
    of = lambda sampled: counts.where("n > 0").where(F.col("sampled") == sampled).groupBy("word").agg(F.sum("n").alias("n"))
    hot = [r.word for r in of(False).where(F.col("n") * 2 * HOT_SHARE >= total).select("word").collect()] + [int(_START.view(np.int64))]
    common = of(True).orderBy(F.desc("n"), "word").limit(COMMON).select("word").collect()
    return np.array(hot, np.int64).view(np.uint64), np.sort(np.array([r.word for r in common], np.int64).view(np.uint64))


def _named(h: np.ndarray, common: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes as numbers in common and hashes of the others, both as steps."""
    at = np.searchsorted(common, h)
    known = at < len(common)
    known[known] = common[at[known]] == h[known]
    return _small(np.diff(at[known], prepend=0)), _sorted_hashes(h[~known])


def _names(numbers: np.ndarray, others: np.ndarray, common: np.ndarray) -> np.ndarray:
    """The hashes that _named took apart."""
    return np.sort(np.concatenate([common[np.cumsum(numbers.astype(np.int64))], np.cumsum(others)]))


def _deal(hu: np.ndarray, hw: np.ndarray, hot: np.ndarray, buckets: int) -> np.ndarray:
    return (mix(np.where(np.isin(hu, hot), hu + mix(hw), hu)) % np.uint64(buckets)).astype(np.int64)


def _pack_pairs(chunk: int, ids: np.ndarray, held: np.ndarray, lines: list[bytes], hot: np.ndarray, common: np.ndarray, buckets: int) -> Iterator[pa.RecordBatch]:
    words, doc = _tokens(lines)
    n_tokens = np.bincount(doc, minlength=len(ids))
    yield _row(int(mix(np.array([chunk], np.uint64))[0] % np.uint64(buckets)), _DOCS, chunk, pack(ids, np.packbits(held), _small(n_tokens)))
    kinds, of = np.unique(words, return_inverse=True)
    del words
    n = len(kinds) + 1
    names = np.append(kinds, _START)
    key = np.empty(len(of), np.int64)
    key[1:] = of[:-1]
    key[np.concatenate([[True], doc[1:] != doc[:-1]])] = n - 1
    key *= n
    key += of
    order = np.argsort(key, kind="stable")
    key, doc = key[order], doc[order]
    del of, order
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    pair, count = key[first], np.diff(np.append(first, len(key)))
    del key
    bucket = _deal(names[pair // n], names[pair % n], hot, buckets)
    by = np.argsort(bucket.astype(np.uint16) if buckets < 1 << 16 else bucket, kind="stable")
    pair, count, bucket, first = pair[by], count[by], bucket[by], first[by]
    doc, ends = _gathered(doc, first, count), np.cumsum(count)
    cuts = [0, *(np.flatnonzero(np.diff(bucket)) + 1).tolist(), len(bucket)]
    for s, e in zip(cuts, cuts[1:]):
        u, w = pair[s:e] // n, pair[s:e] % n
        # local numbers follow the order of hashes, but for the start of texts, which comes last
        u_first = np.flatnonzero(np.concatenate([[True], u[1:] != u[:-1]]))
        w_kinds, w_of = np.unique(w, return_inverse=True)
        data = pack(_sorted_hashes(names[u[u_first]]), _small(np.diff(np.append(u_first, len(u)))), *_named(names[w_kinds], common), _small(w_of), _small(count[s:e]), _small(doc[ends[s] - count[s] : ends[e - 1]]), np.packbits(held))
        yield _row(int(bucket[s]), _PAIRS, chunk, data)


def _gathered(values: np.ndarray, first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The values in the stretches first .. first + count, one after another."""
    out, done = np.empty(int(count.sum()), values.dtype), 0
    for s in range(0, len(first), PART):
        n = count[s : s + PART].astype(np.int64)
        at = np.repeat(first[s : s + PART] - (np.cumsum(n) - n), n)
        at += np.arange(len(at))
        out[done : done + len(at)] = values[at]
        done += len(at)
    return out


def _restaurants(bucket: int, blobs: list[tuple[int, bytes]], hot: np.ndarray, common: np.ndarray, buckets: int) -> Iterator[pa.RecordBatch]:
    """Merges a bucket's pairs; yields its state, its tables for the root by word, and its share of hot contexts.

    Words go by their number among the bucket's, and counts in few bytes: of what is known of a pair, only its key has eight.
    """
    us, nus, ws, w_ofs, ns, trains, docs = [], [], [], [], [], [], []
    for j in range(len(blobs)):
        du, nu, numbers, others, w_of, count, doc, held = unpack(blobs[j][1])
        us.append(np.cumsum(du))
        nus.append(nu)
        ws.append(_names(numbers, others, common))
        w_ofs.append(w_of)
        ns.append(count)
        learn = np.unpackbits(held)[doc] == 0
        trains.append(np.add.reduceat(learn, np.cumsum(count, dtype=np.int64) - count, dtype=np.int64).astype(count.dtype))
        docs.append(doc)
        blobs[j] = (blobs[j][0], b"")  # read; its memory is needed
    u_kinds, w_kinds = np.unique(np.concatenate(us)), np.unique(np.concatenate(ws))
    sizes = [len(x) for x in ns]
    key, done = np.empty(sum(sizes), np.int64), 0
    for u, nu, w, w_of, size in zip(us, nus, ws, w_ofs, sizes):
        mine = key[done : done + size]
        mine[:] = np.repeat(np.searchsorted(u_kinds, u) * len(w_kinds), nu)
        mine += np.searchsorted(w_kinds, w)[w_of]
        done += size
    del us, nus, ws, w_ofs
    order = np.argsort(key, kind="stable")
    key = key[order]
    n, train, doc = map(np.concatenate, (ns, trains, docs))
    del ns, trains, docs
    at = (np.cumsum(n, dtype=np.int64) - n)[order]
    n, train, chunk = n[order], train[order], np.repeat(_small(np.arange(len(blobs))), sizes)[order]
    del order
    first = np.flatnonzero(np.diff(key, prepend=-1))
    u_of, w_of = map(_small, np.divmod(key[first], len(w_kinds)))
    del key
    c, seen = (_small(np.add.reduceat(x, first, dtype=np.int64)) for x in (train, n))
    del train, first
    where, of_chunk = _gathered(doc, at, n), np.repeat(chunk, n)
    del doc, at, n, chunk
    nu = np.bincount(u_of, minlength=len(u_kinds))
    data = pack(_sorted_hashes(u_kinds), _small(nu), _sorted_hashes(w_kinds), w_of, c, seen, _small(of_chunk), _small(where), np.array([x for x, _ in blobs], np.int64))
    del seen, of_chunk, where
    yield _row(bucket, _STATE, bucket, data)
    # what sampling needs, without places: dishes of two customers or more, and each context's dishes
    many = np.flatnonzero(c > 1)
    data = pack(_sorted_hashes(u_kinds), _sorted_hashes(w_kinds), _small(np.bincount(u_of[c > 0], minlength=len(u_kinds))), _small(np.diff(u_of[many], prepend=0)), _small(w_of[many]), _small(c[many]))
    yield _row(bucket, _DISHES, bucket, data)
    yield _row(bucket, _COUNTS, bucket, None, int((c == 1).sum()), int((c == 2).sum()))
    ends = np.cumsum(nu)
    for i in np.flatnonzero(np.isin(u_kinds, hot)).tolist():
        mine = c[ends[i] - nu[i] : ends[i]]
        yield _row(bucket, _HOT, int(u_kinds[i].view(np.int64)), None, int(mine.sum()), int((mine > 0).sum()))
    tables = np.bincount(w_of[c > 0], minlength=len(w_kinds))
    total = np.bincount(w_of, c, len(w_kinds)).astype(np.int64)
    to = _root_bucket(w_kinds, buckets)
    for p in np.unique(to).tolist():
        m = to == p
        yield _row(p, _TABLES, bucket, pack(_sorted_hashes(w_kinds[m]), _small(tables[m]), _small(total[m])))


def _root_bucket(w: np.ndarray, buckets: int) -> np.ndarray:
    return (mix(w + np.uint64(0x9E3779B97F4A7C15)) % np.uint64(-(-buckets // ROOT_SHARE))).astype(np.int64)


@lru_cache(maxsize=2)
def log_stirling(d: float, most: int) -> np.ndarray:
    """Row c holds the logs of the generalised Stirling numbers of c customers at t tables, for discount d."""
    out = np.full((most + 1, most + 1), -np.inf)
    out[0, 0] = 0
    t = np.arange(1, most + 1)
    for c in range(most):
        with np.errstate(divide="ignore"):
            stay = out[c, 1:] + np.log(np.maximum(c - d * t, 0))
        out[c + 1, 1:] = np.logaddexp(out[c, :-1], stay)
    return out


def _unit(seed: int, sweep: int, u: np.ndarray, w: np.ndarray) -> np.ndarray:
    """A number in (0, 1) for each dish w of context u."""
    h = mix(mix(u + np.uint64((seed * 1_000_003 + sweep * 7919 + 1) % (1 << 63))) + w * np.uint64(0xD6E8FEB86659FD93))
    return (mix(h) >> np.uint64(11)).astype(np.float64) / (1 << 53) + 1e-17


def _large(c: np.ndarray, theta: np.ndarray, p: np.ndarray, d: float, u: np.ndarray) -> np.ndarray:
    """Tables of dishes of many customers, by the limits of their law; its generating function in customers is (1 - p (1 - (1 - z) ** d)) ** (-theta / d).

    With few tables beside so many customers, one table holds most customers, and the others are negative binomial. With
    many, customers and tables are jointly normal about the saddle point.
    """
    from statistics import NormalDist

    few = theta * p / (d * (1 - p)) * c**-d < 0.3
    lo, hi = np.full(len(c), -700.0), np.full(len(c), -1e-12)  # log of 1 - z
    for _ in range(60):
        mid = (lo + hi) / 2
        eps = np.exp(mid)
        expected = theta * p * (1 - eps) * eps ** (d - 1) / (1 - p * (1 - eps**d))
        lo, hi = np.where(expected > c, mid, lo), np.where(expected > c, hi, mid)
    eps = np.exp((lo + hi) / 2)
    z, q, a = 1 - eps, p * (1 - eps**d), theta / d
    r = d * p * z * eps ** (d - 1)
    r_s = d * p * (z * eps ** (d - 1) + z**2 * (1 - d) * eps ** (d - 2))
    spread = a * q / (1 - q) ** 2 - (a * r / (1 - q) ** 2) ** 2 / (a * (r_s / (1 - q) + r**2 / (1 - q) ** 2))
    inverse = NormalDist().inv_cdf
    normal = np.array([inverse(min(max(x, 1e-15), 1 - 1e-15)) for x in u.tolist()])
    out = np.rint(a * q / (1 - q) + np.sqrt(np.maximum(spread, 0)) * normal)
    for i in np.flatnonzero(few).tolist():
        rng = np.random.default_rng(int(u[i] * (1 << 53)))
        out[i] = 1 + rng.negative_binomial(a[i] + 1, 1 - p[i])
    return np.clip(out, 1, c).astype(np.int64)


def tables_of(c: np.ndarray, theta: np.ndarray, p: np.ndarray, d: float, u: np.ndarray) -> np.ndarray:
    """How many tables the customers c of each dish take, given the rest: t has weight theta (theta + d) ... (theta + (t - 1) d) * p ** t * S(c, t).

    theta: the concentration and d times the tables of the restaurant's other dishes; p: the parent's probability of the
    dish; S: generalised Stirling numbers; u: a number in (0, 1) for each draw.
    """
    out = np.minimum(c, 1).astype(np.int64)
    big = np.flatnonzero(c > EXACT)
    if len(big):
        out[big] = _large(c[big].astype(np.float64), theta[big], p[big], d, u[big])
    small = np.flatnonzero((c > 1) & (c <= EXACT))
    small = small[np.argsort(c[small], kind="stable")]
    if not len(small):
        return out
    stirling = log_stirling(d, EXACT)
    sizes, first = np.unique(c[small], return_index=True)
    for size, at, end in zip(sizes.tolist(), first.tolist(), [*first[1:].tolist(), len(small)]):
        for s in range(at, end, max(1, (1 << 20) // size)):
            mine = small[s : min(end, s + max(1, (1 << 20) // size))]
            weight = np.log((theta[mine, None] + d * np.arange(size)) * p[mine, None])
            np.cumsum(weight, axis=1, out=weight)
            weight += stirling[size, 1 : size + 1]
            weight -= weight.max(1, keepdims=True)
            np.exp(weight, out=weight)
            np.cumsum(weight, axis=1, out=weight)
            out[mine] = 1 + np.minimum((weight < u[mine, None] * weight[:, -1:]).sum(1), size - 1)
    return out


def discount(once: float, twice: float) -> float:
    """From the numbers of dishes met once and twice; kept off 0 and 1."""
    return min(0.95, max(0.1, once / (once + 2 * twice))) if once + twice else 0.5


_ROOT = pa.schema([("bucket", pa.int64()), ("source", pa.int64()), ("data", pa.binary()), ("words", pa.int64()), ("tokens", pa.int64()), ("customers", pa.int64()), ("tables", pa.int64()), ("once", pa.int64()), ("twice", pa.int64())])
_ROOT_SQL = "bucket long, source long, data binary, words long, tokens long, customers long, tables long, once long, twice long"


def _root(part: int, base: list[tuple[int, bytes]], opened: list[tuple[int, bytes]], before: bytes | None, m: dict) -> Iterator[pa.RecordBatch]:
    """Seats the tables of a part of the vocabulary in the root; answers each bucket in its own order of words.

    base: for each bucket its words there, with its dishes and all customers of each; opened: tables beyond one a dish;
    before: the root's own tables after the last sweep (none: each word has one).
    """
    words, tables, counts = [], {}, []
    for source, blob in base:
        h, t, c = unpack(blob)
        words.append(np.cumsum(h))
        tables[source] = t.astype(np.int64)
        counts.append(c.astype(np.int64))
    kinds, of = np.unique(np.concatenate(words), return_inverse=True)
    for source, blob in opened:
        which, more = unpack(blob)
        tables[source][np.cumsum(which.astype(np.int64))] += more.astype(np.int64)
    add = lambda parts: np.bincount(of, np.concatenate(parts).astype(np.float64), len(kinds)).astype(np.int64)
    customers, total = add(list(tables.values())), add(counts)
    mine = np.minimum(customers, 1) if before is None else unpack(before)[0].astype(np.int64)
    once, twice = int((customers == 1).sum()), int((customers == 2).sum())
    if m is not None:  # else the totals are not known yet
        d = m["root_discount"]
        p = np.full(len(kinds), 1 / (m["words"] + 1))
        mine = tables_of(customers, ROOT_THETA + d * np.maximum(m["root_tables"] - mine, 0).astype(np.float64), p, d, _unit(m["seed"], -1 - m["sweep"], np.zeros(len(kinds), np.uint64), kinds))
    at = 0
    for source, own in tables.items():
        these = of[at : at + len(own)]
        at += len(own)
        data = pack(_small(customers[these]), _small(mine[these]), *([_small(total[these])] if m is not None and m["last"] else []))
        yield batch(_ROOT, bucket=[source], source=[part], data=[data], words=[0], tokens=[0], customers=[0], tables=[0], once=[0], twice=[0])
    yield batch(_ROOT, bucket=[-1 - part], source=[part], data=[pack(_small(mine))], words=[int((total > 0).sum())], tokens=[int(total.sum())], customers=[int(customers.sum())], tables=[int(mine.sum())], once=[once], twice=[twice])


def _answered(w_kinds: np.ndarray, answers: list[tuple[int, bytes]], buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The root's customers and tables, and after the last sweep all customers, for each word of a bucket."""
    out = tuple(np.zeros(len(w_kinds), np.int64) for _ in range(3))
    to = _root_bucket(w_kinds, buckets)
    for part, blob in answers:
        mine = np.flatnonzero(to == part)
        for x, given in zip(out, unpack(blob)):
            x[mine] = given
    return out


def _parent(customers: np.ndarray, tables: np.ndarray, m: dict) -> np.ndarray:
    return (customers - m["root_discount"] * tables + (ROOT_THETA + m["root_discount"] * m["root_tables"]) / (m["words"] + 1)) / (ROOT_THETA + m["customers"])


def _of_contexts(u_hash: np.ndarray, own: np.ndarray, totals: dict[int, int], hot: np.ndarray) -> np.ndarray:
    """own, with the whole corpus's number for contexts that stand in several buckets."""
    out = own.astype(np.float64)
    for i in np.flatnonzero(np.isin(u_hash, hot)).tolist():
        out[i] = totals[int(u_hash[i].view(np.int64))]
    return out


def _sweep(bucket: int, dishes: bytes, before: bytes | None, answers: list[tuple[int, bytes]], m: dict) -> Iterator[pa.RecordBatch]:
    """Draws the tables of a bucket's dishes; yields them, those beyond one a dish for the root by word, and what hot contexts have here."""
    du, dw, n_dishes, dat, w_of, c = unpack(dishes)
    u_hash, w_kinds, at = np.cumsum(du), np.cumsum(dw), np.cumsum(dat.astype(np.int64))
    w_of, c = w_of.astype(np.int64), c.astype(np.int64)
    seats = np.ones(len(c), np.int64) if before is None else 1 + unpack(before)[0].astype(np.int64)
    customers, tables, _ = _answered(w_kinds, answers, m["buckets"])
    of_context = _of_contexts(u_hash, n_dishes + np.bincount(at, seats - 1, len(u_hash)), m["hot_tables"], m["hot"])
    theta = THETA + m["discount"] * (of_context[at] - seats)
    seats = tables_of(c, theta, _parent(customers, tables, m)[w_of], m["discount"], _unit(m["seed"], m["sweep"], u_hash[at], w_kinds[w_of]))
    yield _row(bucket, _SEATS, bucket, pack(_small(seats - 1)))
    now = n_dishes + np.bincount(at, seats - 1, len(u_hash)).astype(np.int64)
    for i in np.flatnonzero(np.isin(u_hash, m["hot"])).tolist():
        yield _row(bucket, _HOT, int(u_hash[i].view(np.int64)), None, int(now[i]))
    more = np.bincount(w_of, (seats - 1).astype(np.float64), len(w_kinds)).astype(np.int64)
    to = _root_bucket(w_kinds, m["buckets"])
    for p in np.unique(to[more > 0]).tolist():
        here = more[to == p]
        some = np.flatnonzero(here)
        yield _row(p, _TABLES, bucket, pack(_small(np.diff(some, prepend=0)), _small(here[some])))


_SCORES = pa.schema([("chunk", pa.int64()), ("side", pa.int32()), ("data", pa.binary())])
_SCORES_SQL = "chunk long, side int, data binary"


def _scores(state: bytes, seats: dict[int, bytes], answers: dict[int, list[tuple[int, bytes]]], models: list[dict]) -> Iterator[pa.RecordBatch]:
    """Averages a bucket's predictive probabilities over the samples (models, by sweep) and sums their logs by document."""
    du, nu, dw, w_of, c, seen, of_chunk, where, chunks = unpack(state)
    del state  # read; its memory is needed
    order = np.argsort(of_chunk, kind="stable").astype(np.int32)
    ends = np.cumsum(np.bincount(of_chunk, minlength=len(chunks)))
    of_token = np.repeat(np.arange(len(c), dtype=np.int32), seen.astype(np.int64))
    del of_chunk, seen
    u_hash, w_kinds = np.cumsum(du), np.cumsum(dw)
    u_of, many = np.repeat(np.arange(len(nu), dtype=np.int32), nu.astype(np.int64)), np.flatnonzero(c > 1)
    n_dishes = np.bincount(u_of[c > 0], minlength=len(nu))
    m = models[-1]
    guests = THETA + _of_contexts(u_hash, np.bincount(u_of, c, len(nu)), m["hot_customers"], m["hot"])
    mean = np.zeros(len(c))
    for m in models:
        customers, tables, total = _answered(w_kinds, answers[m["sweep"]], m["buckets"])
        parent = _parent(customers, tables, m)
        t = np.minimum(c, 1)
        t[many] += unpack(seats[m["sweep"]])[0].astype(t.dtype)  # no more tables than customers
        of_context = THETA + m["discount"] * _of_contexts(u_hash, n_dishes + np.bincount(u_of[many], t[many] - 1, len(nu)), m["hot_tables"], m["hot"])
        for s in range(0, len(c), PART):
            mine = slice(s, s + PART)
            of_dish = of_context[u_of[mine]]
            of_dish *= parent[w_of[mine]]
            of_dish += c[mine] - m["discount"] * t[mine]
            of_dish /= guests[u_of[mine]]
            mean[mine] += of_dish
        del t
    del u_of, many, c
    mean /= len(models)
    log = np.log10(mean, out=mean)
    base, known = np.log10((total + 1) / (m["tokens"] + m["words"] + 1)), (total > 0).astype(np.float64)
    for j, chunk in enumerate(chunks.tolist()):
        mine = order[ends[j - 1] if j else 0 : ends[j]]
        token, doc = of_token[mine], where[mine].astype(np.int64)
        word, n = w_of[token], np.bincount(doc)
        used = np.flatnonzero(n)
        sums = [np.bincount(doc, x)[used] for x in (log[token], base[word], known[word])]
        yield batch(_SCORES, chunk=[chunk], side=[1], data=[pack(_small(np.diff(used, prepend=0)), sums[0], sums[1], _small(sums[2].astype(np.int64)))])


@contextmanager
def _small_batches(spark: SparkSession) -> Iterator[None]:
    """Within it, at most ROWS rows go to Python at a time."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, ROWS)
    try:
        yield
    finally:
        spark.conf.set(name, before)


_OUT = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])


def score(docs: DataFrame, folds: int = FOLDS, held_out: int = HELD_OUT, seed: int = 1) -> DataFrame:
    """Scores of every row of docs; see _score."""
    with _small_batches(docs.sparkSession):
        return _score(docs, folds, held_out, seed)


def _score(docs: DataFrame, folds: int, held_out: int, seed: int) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row of docs.

    Tokens are words between ASCII white space, A-Z lower-cased, and one end a text; null and empty texts have the end
    alone. A null doc_id counts as '' in the crc32. Repeated rows each learn and each get a row. If nothing is there to
    learn from, all words are unknown. An empty table gives an empty result.
    """
    id_text = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    rows = docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("doc_id"),
        (F.crc32(id_text.cast("binary")) % folds == held_out).alias("held_out"),
        F.col("text").cast("string").alias("text"),
    )
    size = rows.agg(F.sum(F.octet_length("text"))).head()[0] or 0  # one row
    hot, common = frequent_words(rows, size // CHUNK_BYTES)
    n = max(1, min(partitions(docs), -(-4 * size // BUCKET_BYTES)), -(-size // BUCKET_BYTES))

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        log_stirling.cache_clear()  # a reused worker may have tables that are no longer asked for
        for chunk, ids, held, lines in _chunks(batches):
            yield from _pack_pairs(chunk, ids, held, lines, hot, common, n)
            trim()

    def restaurants(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        log_stirling.cache_clear()
        for bucket, group in by_group(batches, "bucket"):
            kinds = group.column("kind").to_numpy()
            mine = group.filter(pa.array(kinds == _PAIRS))
            for b in group.filter(pa.array(kinds == _DOCS)).to_batches():
                yield pa.RecordBatch.from_arrays(b.columns, schema=_ROW)
            if len(mine):
                blobs = list(zip(mine.column("source").to_pylist(), mine.column("data").to_pylist()))
                del group, mine
                yield from _restaurants(int(bucket), blobs, hot, common, n)
                trim()

    dealt = rows.mapInArrow(pairs, _ROW_SQL).repartition(n, "bucket").sortWithinPartitions("bucket", "kind", "source")
    # dealt by bucket already, so that each task writes one file a kind, and later steps read them without a shuffle
    spark, name = docs.sparkSession, f"hpy_{uuid.uuid4().hex}"
    dealt.mapInArrow(restaurants, _ROW_SQL).write.option("path", new_path(spark, "hpy-state")).option("compression", "zstd").partitionBy("kind").bucketBy(n, "bucket").saveAsTable(name)
    table = spark.table(name)
    of_kind = lambda d, k: d.where(F.col("kind") == k)
    # dealt into n parts as the table is, so that what goes to buckets is moved once
    # a task has a row or a few of a bucket's bytes: a sort would take a page of memory for each side
    hashed = lambda d: d.hint("shuffle_hash")
    listed = lambda: F.collect_list(F.struct("kind", "source", "sweep", "data"))

    def seated(opened: DataFrame | None, before: DataFrame | None, model: dict | None) -> DataFrame:
        """The root's answers and own tables after a sweep."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for part, base, given in zip(b.column("bucket").to_pylist(), b.column("base"), b.column("given")):
                    of = lambda rows, k: sorted((x["source"], x["data"]) for x in rows.as_py() or [] if x["kind"] == k)
                    own = of(given, _SEATS)
                    yield from _root(part, of(base, _TABLES), of(given, _TABLES), own[0][1] if own else None, model)
                    trim()

        rows = F.collect_list(F.struct("kind", "source", "data"))
        base = of_kind(table, _TABLES).groupBy("bucket").agg(rows.alias("base"))  # where it lies
        if opened is None:
            return stored(base.withColumn("given", F.lit(None).cast("array<struct<kind: int, source: long, data: binary>>")).mapInArrow(run, _ROOT_SQL), "hpy-root")
        own = before.where("bucket < 0").select(F.col("source").alias("bucket"), F.lit(_SEATS).alias("kind"), "source", "data")
        given = own.unionByName(of_kind(opened, _TABLES).select("bucket", "kind", "source", "data")).repartition(n, "bucket").groupBy("bucket").agg(rows.alias("given"))
        return stored(base.join(hashed(given), "bucket").select("bucket", "base", "given").mapInArrow(run, _ROOT_SQL), "hpy-root")

    def totals(root: DataFrame) -> dict:
        found = root.where("bucket < 0").agg(*(F.coalesce(F.sum(x), F.lit(0)).alias(x) for x in ("words", "tokens", "customers", "tables", "once", "twice"))).head()
        return {"words": found.words, "tokens": found.tokens, "customers": found.customers, "root_tables": found.tables, "once": found.once, "twice": found.twice}

    def of_hot(d: DataFrame, column: str) -> dict[int, int]:
        """A row for each hot context, of which there are fewer than 2 * HOT_SHARE."""
        return {r.source: r.n for r in of_kind(d, _HOT).groupBy("source").agg(F.sum(column).alias("n")).collect()}

    answers = seated(None, None, None)
    counts = of_kind(table, _COUNTS).agg(F.sum("a"), F.sum("b")).head()
    first = totals(answers)
    model = {
        "buckets": n, "hot": hot, "hot_customers": of_hot(table, "a"), "hot_tables": of_hot(table, "b"), "seed": seed, "sweep": 0, "discount": discount(counts[0] or 0, counts[1] or 0),
        "root_discount": discount(first.pop("once"), first.pop("twice")), **first,
    }
    drawn, samples, models = None, [], []
    for sweep in range(1, BURN_IN + SAMPLES + 1):
        model = model | {"sweep": sweep, "last": sweep == BURN_IN + SAMPLES}
        given = answers.where("bucket >= 0").select("bucket", F.lit(_DISHES).alias("kind"), "source", F.lit(sweep).alias("sweep"), "data")
        if drawn is not None:
            given = given.unionByName(of_kind(drawn, _SEATS).select("bucket", "kind", "source", F.lit(sweep).alias("sweep"), "data"))
        given = given.repartition(n, "bucket").groupBy("bucket").agg(listed().alias("given"))

        def sweeps(batches: Iterator[pa.RecordBatch], model=model) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for i in range(len(b)):
                    got = b.column("given")[i].as_py()
                    before = next((x["data"] for x in got if x["kind"] == _SEATS), None)
                    yield from _sweep(b.column("bucket")[i].as_py(), b.column("data")[i].as_py(), before, [(x["source"], x["data"]) for x in got if x["kind"] == _DISHES], model)
                    trim()

        drawn = stored(of_kind(table, _DISHES).select("bucket", "data").join(hashed(given), "bucket").mapInArrow(sweeps, _ROW_SQL), "hpy-sweep")
        model = model | {"hot_tables": of_hot(drawn, "a")}
        answers = seated(drawn, answers, model)
        model = model | {k: v for k, v in totals(answers).items() if k in ("customers", "root_tables")}
        if sweep > BURN_IN:
            own = of_kind(drawn, _SEATS).select("bucket", "kind", "source", F.lit(sweep).alias("sweep"), "data")
            samples += [own, answers.where("bucket >= 0").select("bucket", F.lit(_TABLES).alias("kind"), "source", F.lit(sweep).alias("sweep"), "data")]
            models.append(model)

    def scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        log_stirling.cache_clear()
        for b in batches:
            for i in range(len(b)):
                got = b.column("given")[i].as_py()
                seats = {x["sweep"]: x["data"] for x in got if x["kind"] == _SEATS}
                replies = {m["sweep"]: [(x["source"], x["data"]) for x in got if x["kind"] == _TABLES and x["sweep"] == m["sweep"]] for m in models}
                del got
                yield from _scores(b.column("data")[i].as_py(), seats, replies, models)
                trim()

    given = reduce(DataFrame.unionByName, samples)
    given = given.repartition(n, "bucket").groupBy("bucket").agg(listed().alias("given"))
    states = of_kind(table, _STATE).select("bucket", "data").join(hashed(given), "bucket")
    sides = states.select("data", "given").mapInArrow(scores, _SCORES_SQL).unionByName(of_kind(table, _DOCS).select(F.col("source").alias("chunk"), F.lit(0).alias("side"), "data"))

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, group in by_group(batches, "chunk"):
            sides = group.column("side").to_pylist()
            data = group.column("data")
            ids, held, n_tokens = unpack(data[sides.index(0)].as_py())
            log, base, known = np.zeros(len(ids)), np.zeros(len(ids)), np.zeros(len(ids), np.int64)
            for i, side in enumerate(sides):
                if side:
                    used, a, b, k = unpack(data[i].as_py())
                    used = np.cumsum(used.astype(np.int64))
                    log[used] += a
                    base[used] += b
                    known[used] += k
            yield batch(
                _OUT,
                doc_id=pa.array(ids, pa.int64(), mask=ids == NULL_ID),
                held_out=np.unpackbits(held)[: len(ids)].astype(bool),
                n_tokens=n_tokens.astype(np.int64),
                n_known=known,
                train_tokens=np.full(len(ids), model["tokens"], np.int64),
                base_score=base,
                score=log,
            )

    kinds = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    out = stored(sides.repartition(n, "chunk").sortWithinPartitions("chunk", "side").mapInArrow(added, kinds), "hpy-scores")
    spark.sql(f"DROP TABLE {name}")
    return out
