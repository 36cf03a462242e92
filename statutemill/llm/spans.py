"""Windows that travel by their minimiser, and spans that come back to the texts; shared by the repeat operators.

Every window of a text belongs to the bucket of the least hash among its grams, so equal windows meet. Consecutive
windows of one minimiser form a run, which travels once, as one string. Tasks pack the runs of a block of texts by bucket.
Grams that many texts hold come last in the order of hashes, so that windows about a common passage are dealt by what else
they hold; only windows of nothing but common grams share a bucket, and those travel once a block and are equal strings.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import NULL_ID, batch, by_group, pack, partitions, row_key, unpack

SPAN_SQL = "doc_id long, key long, start long, end long"
SPAN = pa.schema([("doc_id", pa.int64()), ("key", pa.int64()), ("start", pa.int64()), ("end", pa.int64())])
#: Bytes of text that a task packs at a time before they are shuffled.
TEXT_BLOCK = 8 << 20
#: Bytes of text whose windows make a bucket, on average; one bucket is held at a time.
BUCKET_BYTES = 5 << 20
#: Common grams: of SAMPLE texts, at least one in OFTEN_SHARE has one, on average. Only how evenly work is dealt hangs on these.
SAMPLE, OFTEN_SHARE, OFTEN_LEAST, OFTEN_MOST = 10_000, 500, 16, 1 << 15

_SIDE = pa.schema([("part", pa.int64()), ("side", pa.int32()), *SPAN, ("data", pa.binary())])
_SIDE_SQL = f"part long, side int, {SPAN_SQL}, data binary"
_SPANS, _TEXTS = 0, 1
#: Spans of kind k have k << KIND_BITS added to their key, which is below that.
KIND_BITS = 32


def keyed(docs: DataFrame, carry: Column | None = None) -> DataFrame:
    """doc_id (null: NULL_ID), key, text, and carry if given. key is 32 bits of the text's hash: it tells apart rows that repeat an id."""
    key = F.coalesce(row_key(F.col("text")), F.lit(0)).bitwiseAND(F.lit(0xFFFFFFFF))
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("doc_id"), key.alias("key"), F.col("text").cast("string").alias("text"), *([] if carry is None else [carry.alias("carry")]))


def measured(rows: DataFrame) -> tuple[int, int]:
    """Rows of keyed(), and a number of buckets that fits their bytes."""
    found = rows.agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("bytes")).head()  # one row
    return found.n, max(2 * partitions(rows), -(-(found.bytes or 0) // BUCKET_BYTES))


def common_grams(rows: DataFrame, n: int, grams: Callable[[list[bytes]], np.ndarray]) -> np.ndarray:
    """Sorted hashes of grams that come often in a sample of n rows of keyed(), OFTEN_MOST of them at most."""
    every = max(1, n // SAMPLE)
    schema = pa.schema([("gram", pa.int64()), ("n", pa.int64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            held, size = [], 0
            for i, t in enumerate(b.column("text")):
                held.append((t.as_py() or "").encode("utf-8", "surrogatepass"))
                size += len(held[-1])
                if size > TEXT_BLOCK or i + 1 == len(b):
                    gram, times = np.unique(grams(held), return_counts=True)
                    yield batch(schema, gram=gram.view(np.int64), n=times)
                    held, size = [], 0

    some = rows.where(F.pmod(F.xxhash64("doc_id", "key"), F.lit(every)) == 0).select("text").mapInArrow(count, "gram long, n long")
    often = some.groupBy("gram").agg(F.sum("n").alias("n")).where(F.col("n") >= max(OFTEN_LEAST, n // every // OFTEN_SHARE))
    found = often.orderBy(F.desc("n"), "gram").limit(OFTEN_MOST).select("gram").toPandas()["gram"]
    return np.sort(found.to_numpy(np.int64).view(np.uint64))


def demoted(hashes: np.ndarray, common: np.ndarray) -> np.ndarray:
    """Hashes of 63 bits, and above them a bit that common ones carry, so that any other is less."""
    out = hashes >> np.uint64(1)
    if len(common):
        low = np.uint64((1 << 20) - 1)
        table = np.zeros(1 << 20, bool)
        table[common & low] = True
        maybe = np.flatnonzero(table[hashes & low])
        found = common[np.minimum(np.searchsorted(common, hashes[maybe]), len(common) - 1)] == hashes[maybe]
        out[maybe[found]] |= np.uint64(1 << 63)
    return out


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(29))


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each run of width values, by doubling."""
    done, out = 1, values
    while 2 * done <= width:
        out = np.minimum(out[:-done], out[done:])
        done *= 2
    rest = width - done
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out


def runs(least: np.ndarray, valid: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last window of each run of consecutive valid windows with the same minimiser."""
    at = np.flatnonzero(valid)
    if not len(at):
        return at, at
    cut = np.flatnonzero((np.diff(at) != 1) | (least[at[1:]] != least[at[:-1]])) + 1
    return at[np.concatenate([[0], cut])], at[np.concatenate([cut - 1, [len(at) - 1]])]


def merged(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spans, sorted and with those that touch or overlap joined."""
    if not len(start):
        return start, end
    order = np.argsort(start, kind="stable")
    start, top = start[order], np.maximum.accumulate(end[order])
    new = np.concatenate([[True], start[1:] > top[:-1]])
    last = np.concatenate([np.flatnonzero(new)[1:] - 1, [len(start) - 1]])
    return start[new], top[last]


def flagged_spans(flag: np.ndarray, begin: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Index of the first and last of each stretch of set flags whose begin values go up by one."""
    at = np.flatnonzero(flag)
    if not len(at):
        return at, at
    cut = np.flatnonzero((np.diff(at) != 1) | (np.diff(begin[at]) != 1)) + 1
    return at[np.concatenate([[0], cut])], at[np.concatenate([cut - 1, [len(at) - 1]])]


def _frame(rows: pa.Array) -> np.ndarray:
    """An array as an Arrow stream."""
    sink = pa.BufferOutputStream()
    table = pa.table({"carry": rows})
    with pa.ipc.new_stream(sink, table.schema) as out:
        out.write_table(table)
    return np.frombuffer(sink.getvalue(), np.uint8)


def apply_spans(docs: DataFrame, spans: DataFrame, run: Callable[..., tuple], out: pa.Schema, out_sql: str, kinds: int = 1) -> DataFrame:
    """run(text bytes, starts, ends) for each row of keyed() docs, with the merged spans of its doc_id and key; starts and ends of more kinds follow.

    Texts meet their spans in packed blocks; out holds doc_id and then what run returns. A null text is empty. If docs
    has a column carry, it comes last, as it is.
    """
    n, carries = partitions(docs), "carry" in docs.columns
    part = F.pmod(F.xxhash64("doc_id", F.col("key").bitwiseAND(F.lit((1 << KIND_BITS) - 1))), F.lit(4 * n)).cast("long").alias("part")
    returned = T._parse_datatype_string(out_sql)
    if carries:
        returned = returned.add("carry", docs.schema["carry"].dataType)

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        carried: list[pa.Array] = []
        size = before = 0

        def flush() -> Iterator[pa.RecordBatch]:
            whole = pa.chunked_array(carried) if held and carries else None
            for p in sorted(held):
                ids, keys, raw, at = zip(*held[p])
                frame = _frame(whole.take(pa.array(at, pa.int64()))) if carries else np.empty(0, np.uint8)
                data = pack(frame, np.array(ids, np.int64), np.array(keys, np.int64), np.array([len(x) for x in raw], np.int64), np.frombuffer(b"".join(raw), np.uint8))
                yield batch(_SIDE, part=[p], side=[_TEXTS], doc_id=[0], key=[0], start=[0], end=[0], data=[data])

        for b in batches:
            if carries:
                carried.append(b.column("carry"))
            for j, (p, i, k, t) in enumerate(zip(b.column("part").to_pylist(), b.column("doc_id").to_pylist(), b.column("key").to_pylist(), b.column("text"))):
                raw = (t.as_py() or "").encode("utf-8", "surrogatepass")
                held.setdefault(p, []).append((i, k, raw, before + j))
                size += len(raw)
                if size > TEXT_BLOCK:
                    yield from flush()
                    held, carried, size, before = {}, carried[-1:], 0, 0
            before = sum(map(len, carried))
        yield from flush()

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spans_of: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}
        pieces: list[pa.RecordBatch] = []
        now, nothing = None, np.empty(0, np.int64)

        def settle() -> None:
            cols = [np.concatenate([p.column(c).to_numpy() for p in pieces]) for c in ("doc_id", "key", "start", "end")]
            order = np.lexsort((cols[2], cols[1], cols[0]))
            i, k, s, e = (c[order] for c in cols)
            cuts = np.flatnonzero((np.diff(i) != 0) | (np.diff(k) != 0)) + 1
            for a, z in zip([0, *cuts.tolist()], [*cuts.tolist(), len(i)]):
                spans_of[int(i[a]), int(k[a])] = merged(s[a:z], e[a:z])
            pieces.clear()

        for b in batches:  # sorted by part, its spans before its texts
            sides, parts = b.column("side").to_numpy(), b.column("part").to_numpy()
            cuts = [0, *(np.flatnonzero((np.diff(parts) != 0) | (np.diff(sides) != 0)) + 1).tolist(), len(b)]
            for a, z in zip(cuts, cuts[1:]):
                if a == z:
                    continue
                if parts[a] != now:
                    spans_of, now = {}, parts[a]
                    pieces.clear()
                if sides[a] == _SPANS:
                    pieces.append(b.slice(a, z - a))
                    continue
                if pieces:
                    settle()
                for data in b.column("data").slice(a, z - a):
                    frame, ids, keys, sizes, flat = unpack(data.as_py())
                    raw, at, rows = flat.tobytes(), 0, []
                    for i, k, size in zip(ids.tolist(), keys.tolist(), sizes.tolist()):
                        found = [x for kind in range(kinds) for x in spans_of.get((i, k + (kind << KIND_BITS)), (nothing, nothing))]
                        rows.append((None if i == NULL_ID else i, *run(raw[at : at + size], *found)))
                        at += size
                    done = [pa.array([r[c] for r in rows], f.type) for c, f in enumerate(out)]
                    names = list(out.names)
                    if carries:
                        done.append(pa.ipc.open_stream(pa.py_buffer(frame.tobytes())).read_all().column(0).combine_chunks())
                        names.append("carry")
                    yield pa.RecordBatch.from_arrays(done, names)

    left = spans.select(part, F.lit(_SPANS).alias("side"), "doc_id", "key", "start", "end", F.lit(None).cast("binary").alias("data"))
    right = docs.select(part, "doc_id", "key", "text", *(["carry"] if carries else [])).mapInArrow(texts, _SIDE_SQL)
    return left.unionByName(right).repartition(n, "part").sortWithinPartitions("part", "side").mapInArrow(joined, returned)


__all__ = ["KIND_BITS", "SPAN", "SPAN_SQL", "apply_spans", "by_group", "common_grams", "demoted", "flagged_spans", "keyed", "measured", "merged", "mix", "runs", "sliding_min"]
