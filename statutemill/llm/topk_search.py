"""Exact top-k inner products by norm-bucketed retrieval.

Vectors are sorted by length and packed into blocks of similar length (buckets). A first pass over the longest bucket
gives each query a score that k candidates reach already. From it follows, for each query and bucket, a local cosine
threshold: above 1 the bucket is skipped; where it is high, coordinates are pruned (each focus coordinate of a candidate
must lie in the range that the threshold leaves); else only candidates that are too short are pruned. What is left is
verified by exact integer products.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import batch, pack, partitions, stored, unpack

BLOCK_ROWS, QUERY_ROWS = 4096, 512
#: From this cosine on, coordinates are pruned, by the query's so many largest ones.
COORDINATE_FROM, FOCUS = 0.5, 4
#: Of fewer coordinates than that, the whole product costs less than looking at a few of them.
COORDINATE_DIM = 256
#: Components of candidates that a task holds at most on average, and those for which a task of its own is worth its queries.
LANE_MOST, LANE_LEAST = 1 << 22, 1 << 19
_SLACK = 1e-9
_BLOCK = pa.schema([("block", pa.int64()), ("dim", pa.int32()), ("n", pa.int64()), ("longest", pa.float64()), ("data", pa.binary())])
_HIT = pa.schema([("query_id", pa.int64()), ("query_key", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])
_BLOCK_SQL = "block long, dim int, n long, longest double, data binary"
_HIT_SQL = "query_id long, query_key long, vec_id long, score long"


def quantised(vectors: DataFrame, scale: int, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """id, key (tells repeated ids apart), dim, norm and q = floor(scale * x); rows that take no part are left out.

    Those are null ids, null vectors and vectors that hold null or non-finite components.
    """
    wide = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("x"))
    fits = F.col("id").isNotNull() & F.col("x").isNotNull() & F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return (
        wide.where(fits)
        .withColumn("q", F.transform("x", lambda v: F.floor(v * scale).cast("long")))
        .withColumn("norm", F.sqrt(F.aggregate("q", F.lit(0.0), lambda a, v: a + v.cast("double") * v.cast("double"))))
        .select("id", F.xxhash64("q").alias("key"), F.size("q").alias("dim"), "norm", "q")
    )


def _blocks(rows: DataFrame, size: int, n: int) -> DataFrame:
    """Rows of one dimension and similar length, packed; a task numbers its own blocks, so numbers need no other pass."""

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, made, held, dim = TaskContext.get().partitionId(), 0, [], None

        def flush() -> pa.RecordBatch:
            ids, keys, norms, q = (np.concatenate([h[i] for h in held]) for i in range(4))
            return batch(_BLOCK, block=[part << 32 | made], dim=[dim], n=[len(ids)], longest=[float(norms.max())], data=[pack(ids, keys, norms, q.reshape(-1))])

        for b in batches:
            dims = b.column("dim").to_numpy()
            cuts = [0, *(np.flatnonzero(dims[1:] != dims[:-1]) + 1).tolist(), len(dims)]
            for s, e in zip(cuts, cuts[1:]):
                while s < e:
                    if held and (dims[s] != dim or sum(len(h[0]) for h in held) >= size):
                        yield flush()
                        made, held = made + 1, []
                    dim = int(dims[s])
                    m = min(e - s, size - sum(len(h[0]) for h in held))
                    piece = b.slice(s, m)
                    q = piece.column("q").flatten().to_numpy().reshape(m, dim)
                    held.append((*(piece.column(c).to_numpy() for c in ("id", "key", "norm")), q))
                    s += m
        if held:
            yield flush()

    order = ["dim", F.desc("norm"), "id", "key"]
    return rows.repartitionByRange(n, *order).sortWithinPartitions(*order).mapInArrow(packed, _BLOCK_SQL)


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of integer rows; scores beyond 64 bits are cut to the ends of that range."""
    most = lambda m: max(abs(int(m.max(initial=0))), abs(int(m.min(initial=0))))
    bound = most(a) * most(b) * max(1, a.shape[1])
    if bound < 2**53:
        kind = np.float32 if bound < 2**24 else np.float64
        return (a.astype(kind) @ b.astype(kind).T).astype(np.int64)
    if bound < 2**63:
        return a @ b.T
    exact = a.astype(object) @ b.astype(object).T
    return np.clip(exact, -(2**63), 2**63 - 1).astype(np.int64)


def _best(query: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of each query's k highest scores, ties to the smaller id, in the order of queries and ranks."""
    order = np.lexsort((ids, ~scores, query))  # ~ turns the order around, and is never out of range
    q = query[order]
    return order[np.arange(len(q)) - np.searchsorted(q, q) < k]


def _search(q: tuple, c: tuple, floor: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Candidates of a block that may reach the floors of a block's queries, as (query, ids, scores), at most k a query."""
    (q_ids, _, q_norms, q_rows), (c_ids, _, c_norms, c_rows) = q, c
    longest = c_norms.max(initial=0.0)
    with np.errstate(divide="ignore", invalid="ignore"):
        local = np.where(q_norms * longest > 0, floor / (q_norms * longest), np.where(floor > 0, np.inf, -np.inf))
        short = np.where(local > _SLACK, floor / q_norms * (1 - _SLACK), -np.inf)  # candidates below that length can't reach the floor
    wide = q_rows.shape[1] >= COORDINATE_DIM
    live = local <= 1 + _SLACK
    focused = live & (local >= COORDINATE_FROM) & wide
    found = []
    for i in np.flatnonzero(focused):
        if not found:
            unit = np.where(c_norms[:, None] > 0, c_rows / np.where(c_norms > 0, c_norms, 1)[:, None], 0.0)
        u, t = q_rows[i] / q_norms[i], min(1.0, local[i])
        focus = np.argsort(-np.abs(u))[:FOCUS]
        room = np.sqrt(max(0.0, 1 - t * t)) * np.sqrt(np.maximum(0.0, 1 - u[focus] ** 2)) + _SLACK
        rows = np.flatnonzero((np.abs(unit[:, focus] - t * u[focus]) <= room + (1 - t) * np.abs(u[focus])).all(1))
        found.append((np.full(len(rows), i), rows, _products(q_rows[i : i + 1], c_rows[rows])[0]))
    whole = np.flatnonzero(live & ~focused)
    if len(whole):  # as many candidates as the query with the lowest bound needs, longest first, for all these queries at once
        n = int(np.searchsorted(-c_norms, -short[whole].min(), "right"))
        scores = _products(q_rows[whole], c_rows[:n])
        i, j = np.nonzero(scores >= floor[whole][:, None])
        found.append((whole[i], j, scores[i, j]))
    if not found:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
    query, rows, scores = (np.concatenate(x) for x in zip(*found))
    keep = (c_ids[rows] != q_ids[query]) & (scores >= floor[query])
    query, ids, scores = query[keep], c_ids[rows[keep]], scores[keep]
    best = _best(query, ids, scores, k)
    return query[best], ids[best], scores[best]


def _floors(q: tuple, c: tuple, k: int) -> np.ndarray:
    """For each query of a block the score that k candidates of another reach; -inf where it has fewer."""
    own = c[0][None, :] == q[0][:, None]
    scores = np.where(own, np.iinfo(np.int64).min, _products(q[3], c[3]))
    enough = (~own).sum(1) >= k
    return np.where(enough, np.partition(scores, -k, axis=1)[:, -k], -np.inf) if enough.any() else np.full(len(q[0]), -np.inf)


def _read(data: bytes, dim: int) -> tuple[np.ndarray, ...]:
    ids, keys, norms, flat = unpack(data)
    return ids, keys, norms, flat.reshape(len(ids), dim)


def top_k(queries: DataFrame, candidates: DataFrame, k: int = 5, block_rows: int = BLOCK_ROWS, query_rows: int = QUERY_ROWS) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: each query's k highest integer inner products, ties to the smaller vec_id.

    Both frames come from quantised(). A query never finds rows of its own id, and is compared with vectors of its own
    dimension; it has fewer rows where fewer candidates exist, none where none do. Repeated candidate rows count as
    often as they stand there; a query id that repeats with the same vector is answered once, with another vector each
    is answered. Empty tables give an empty result.
    """
    n = partitions(candidates)
    blocks = stored(_blocks(candidates, block_rows, n), "topk-blocks")
    asked = stored(_blocks(queries.dropDuplicates(["id", "key"]), query_rows, max(1, n // 4)), "topk-queries")
    # the longest block of each dimension: one row of block_rows vectors at most each
    first = blocks.groupBy("dim").agg(F.max_by(F.struct("block", "data"), F.struct("longest", "n")).alias("s")).select("dim", F.col("s.data").alias("seed"))

    def floors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = pa.schema([*_BLOCK, ("floors", pa.binary()), ("reach", pa.float64())])
        for b in batches:
            for r in b.to_pylist():
                q = _read(r["data"], r["dim"])
                floor = _floors(q, _read(r["seed"], r["dim"]), k)
                with np.errstate(divide="ignore", invalid="ignore"):
                    need = np.where(q[2] > 0, floor / q[2], np.where(floor > 0, np.inf, -np.inf))
                yield batch(out, **{f.name: [r[f.name]] for f in _BLOCK}, floors=[pack(floor)], reach=[float(need.min())])

    known = stored(asked.join(first, "dim").mapInArrow(floors, _BLOCK_SQL + ", floors binary, reach double"), "topk-floors")
    # a lane holds its blocks of candidates and lets all blocks of queries pass: no row is made, moved or broadcast for a pair of blocks
    cells = blocks.agg(F.sum(F.col("n") * F.col("dim"))).head()[0] or 0  # one row
    lanes = max(1, -(-cells // LANE_MOST), min(4 * n, -(-cells // LANE_LEAST)))
    lane = F.pmod(F.xxhash64("block"), F.lit(lanes)).cast("int")
    held = blocks.select(lane.alias("lane"), F.lit(0).alias("kind"), "dim", F.col("longest").alias("bound"), "data", F.lit(b"").alias("floors"))
    asks = known.select(F.explode(F.sequence(F.lit(0), F.lit(lanes - 1))).alias("lane"), F.lit(1).alias("kind"), "dim", F.col("reach").alias("bound"), "data", "floors")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, mine = None, []
        for b in batches:
            lane, kind, dim, bound = (b.column(c).to_numpy() for c in ("lane", "kind", "dim", "bound"))
            for i in range(len(b)):
                if lane[i] != now:
                    now, mine = lane[i], []
                if kind[i] == 0:  # the longest come first, before all queries
                    mine.append((dim[i], bound[i], _read(b.column("data")[i].as_py(), int(dim[i]))))
                    continue
                q, (floor,) = _read(b.column("data")[i].as_py(), int(dim[i])), unpack(b.column("floors")[i].as_py())
                got = [np.empty(0, np.int64)] * 3
                for d, longest, c in mine:
                    # a block too short for all of these queries is left out
                    if d == dim[i] and longest * (1 + _SLACK) + _SLACK >= bound[i]:
                        more = _search(q, c, floor, k)
                        if len(more[0]):
                            got = [np.concatenate(x) for x in zip(got, more)]
                            best = _best(*got, k)
                            got = [x[best] for x in got]
                            last = np.append(got[0][1:] != got[0][:-1], True)
                            full = last & (np.bincount(got[0], minlength=len(floor))[got[0]] == k)
                            floor = floor.copy()
                            floor[got[0][full]] = np.maximum(floor[got[0][full]], got[2][full])
                if len(got[0]):
                    yield batch(_HIT, query_id=q[0][got[0]], query_key=q[1][got[0]], vec_id=got[1], score=got[2])

    met = held.unionByName(asks).repartition(lanes, "lane").sortWithinPartitions("lane", "kind", F.desc("bound"))
    hits = met.mapInArrow(verify, _HIT_SQL)
    order = W.partitionBy("query_id", "query_key").orderBy(F.desc("score"), "vec_id")
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
