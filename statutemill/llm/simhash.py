"""SimHash near-duplicates, compared bit-sliced.

Fingerprints that differ in r bits at most agree on all but r of r + s blocks of their bits, so each choice of s blocks
is a table whose buckets hold every link at least once. Within a bucket, fingerprints stand vertically: plane b holds
bit b of 64 fingerprints a word. A query's bits are compared with whole planes; carry-save counters add the differing
bits of all of them at once and stick when they pass r; a tile is abandoned once all its counters have passed.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import NULL_ID, batch, by_group, partitions, row_key, stored
from .components import components

BITS, RADIUS, SHINGLE, SEED = 64, 3, 3, 42
#: Fingerprints of a bucket that one task compares with each other; larger buckets are dealt out by pairs of parts.
PART_ROWS = 4096
#: Fingerprints that share a key by chance, at most, on average.
BY_CHANCE = 64

_PAIR_SQL = "src long, dst long"
_PAIR = pa.schema([("src", pa.int64()), ("dst", pa.int64())])


def shingle_hashes(text: str | None, width: int) -> np.ndarray:
    """XXH64 (seed 42) of the shingles of a text, repeats included: lower-cased A-Z, words between ASCII white space."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = max(1, len(words) - width + 1)
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(line[s:e], SEED) for s, e in zip(starts[:n].tolist(), ends[min(width, len(words)) - 1 :].tolist())), np.uint64, n)


def fingerprint(hashes: np.ndarray) -> int:
    """A bit is 1 if set in over half the hashes; no hashes: 0."""
    counts = np.zeros(BITS, np.int64)
    for i in range(0, len(hashes), 1 << 16):
        part = np.ascontiguousarray(hashes[i : i + (1 << 16)].astype("<u8")).view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(0, dtype=np.int64)
    bits = 2 * counts > len(hashes)
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, width: int = SHINGLE) -> DataFrame:
    """doc_id, key (tells repeated ids apart), fp (the fingerprint as a signed long) for every row of docs, from whole texts."""
    out = pa.schema([("doc_id", pa.int64()), ("key", pa.int64()), ("fp", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(shingle_hashes(x.as_py(), width)) for x in b.column("text")], np.uint64)
            yield batch(out, doc_id=b.column("doc_id"), key=b.column("key"), fp=fps.view(np.int64))

    rows = docs.select(F.col("doc_id").cast("long"), row_key(F.col("text")).alias("key"), F.col("text").cast("string"))
    return rows.mapInArrow(run, "doc_id long, key long, fp long")


def planes(fps: np.ndarray) -> np.ndarray:
    """Bit planes (BITS x words): word w of plane b holds bit b of fingerprints 64w to 64w + 63."""
    words = -(-len(fps) // 64)
    bits = np.unpackbits(np.ascontiguousarray(fps.astype("<u8")).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    full = np.zeros((words * 64, BITS), np.uint8)
    full[: len(fps)] = bits
    return np.ascontiguousarray(np.packbits(full.T, axis=1, bitorder="little")).view("<u8")


def within(queries: np.ndarray, fps: np.ndarray, radius: int, tile: int = 512) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (query index, fingerprint index) that differ in radius bits at most, tile by tile."""
    vertical, levels = planes(fps), max(1, int(radius).bit_length())
    spare = (1 << levels) - 1 - radius  # counters start there, so that they overflow just beyond the radius
    words = vertical.shape[1]
    ones = np.uint64(0xFFFFFFFFFFFFFFFF)
    valid = np.full(words, ones)
    if len(fps) % 64:
        valid[-1] = np.uint64((1 << len(fps) % 64) - 1)
    for at in range(0, len(queries), tile):
        rows = np.arange(at, min(at + tile, len(queries)))
        flip = np.zeros((len(rows), BITS), np.uint64)
        flip[((queries[rows, None] >> np.arange(BITS, dtype=np.uint64)) & np.uint64(1)).astype(bool)] = ones
        counter = [np.full((len(rows), words), ones if spare >> k & 1 else np.uint64(0)) for k in range(levels)]
        over = np.repeat(~valid[None, :], len(rows), 0)
        for b in range(BITS):
            carry = vertical[b][None, :] ^ flip[:, b][:, None]
            for k in range(levels):
                counter[k], carry = counter[k] ^ carry, counter[k] & carry
            over |= carry
            if b % 8 == 7 and b < BITS - 1:
                live = (over != ones).any(1)
                if not live.any():
                    break
                if 2 * live.sum() < len(live):
                    rows, flip, over = rows[live], flip[live], over[live]
                    counter = [c[live] for c in counter]
        near = ~over
        q, w = np.nonzero(near)
        if len(q):
            hit = np.unpackbits(near[q, w].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            i, j = np.nonzero(hit)
            yield rows[q[i]], w[i] * 64 + j


def _spanning(i: np.ndarray, j: np.ndarray, parent: np.ndarray) -> None:
    """Joins the sets of i and j in parent (roots are the smallest index); parent is flat before and after."""
    while True:
        a, b = parent[i], parent[j]
        differ = a != b
        if not differ.any():
            return
        i, j, a, b = i[differ], j[differ], a[differ], b[differ]
        np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))
        while True:
            up = parent[parent]
            if (up == parent).all():
                break
            parent[:] = up


def _keys(fp: Column, n: int, radius: int, by_chance: int) -> Column:
    """An array of (table, key): in each table so many bits of agreeing blocks that by_chance of n fingerprints share a key by chance."""
    need = max(1, (n // by_chance).bit_length())
    for spare in range(1, 9):
        blocks = radius + spare
        edges = [BITS * i // blocks for i in range(blocks + 1)]
        if spare * (BITS // blocks) >= need:
            break
    tables = []
    for t, chosen in enumerate(combinations(range(blocks), spare)):
        bits = [b for c in chosen for b in range(edges[c], edges[c + 1])][:need]
        mask = sum(1 << b for b in bits)
        signed = mask - (1 << 64) if mask >> 63 else mask
        tables.append(F.struct(F.lit(t).alias("t"), fp.bitwiseAND(F.lit(signed)).alias("key")))
    return F.array(*tables)


def _dealt(fps: DataFrame, keys: Column) -> DataFrame:
    """fps (fp and others) with mine and task: a row for each task that compares it, sorted by task within partitions.

    Buckets over PART_ROWS are cut into parts, and each pair of parts is compared by a task of its own.
    """
    others = fps.columns
    keyed = fps.select(*others, F.explode(keys).alias("k")).select(*others, F.xxhash64("k.t", "k.key").alias("bucket"))
    sizes = keyed.groupBy("bucket").agg(F.count("*").alias("n")).where(F.col("n") > 1)
    cuts = F.ceil(F.col("n") / PART_ROWS).cast("int")
    # a row for each table is many times what Spark takes keyed for, which it would broadcast while fingerprints are few
    sized = keyed.hint("merge").join(sizes, "bucket").withColumn("mine", F.pmod(F.xxhash64("fp"), cuts).cast("int"))
    # a fingerprint of part p goes to the tasks (p, x) and (x, p): a small bucket has the one task (0, 0)
    meets = F.transform(F.sequence(F.lit(0), cuts - 1), lambda x: F.struct(F.least(x, F.col("mine")).alias("a"), F.greatest(x, F.col("mine")).alias("b")))
    dealt = sized.select(*others, "mine", "bucket", F.explode(meets).alias("m")).select(*others, "mine", F.xxhash64("bucket", "m.a", "m.b").alias("task"))
    return dealt.repartition(partitions(fps), "task").sortWithinPartitions("task")


def _close(group: pa.Table, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows of a task's group within radius of each other, tile by tile: of two parts, or of one with itself."""
    fp, side = group.column("fp").to_numpy().view(np.uint64), group.column("mine").to_numpy()
    first, others = np.flatnonzero(side == side.min()), np.flatnonzero(side != side.min())
    if not len(others):
        others = first
    for i, j in within(fp[first], fp[others], radius):
        yield first[i], others[j]


def links(fps: DataFrame, radius: int = RADIUS, by_chance: int = BY_CHANCE) -> DataFrame:
    """(src, dst): links that span every group of distinct fingerprints (column fp, no nulls) within radius of each other.

    Not all pairs: within a part of a bucket a spanning forest is enough, as no group is lost by it.
    """

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        src, dst, held = [], [], 0
        for _, group in by_group(batches, "task"):
            fp, parent = group.column("fp").to_numpy(), np.arange(len(group))
            for i, j in _close(group, radius):
                _spanning(i, j, parent)
            far = np.flatnonzero(parent != np.arange(len(fp)))
            if len(far):
                src.append(fp[far])
                dst.append(fp[parent[far]])
                held += len(far)
            if held > 50_000:
                yield batch(_PAIR, src=np.concatenate(src), dst=np.concatenate(dst))
                src, dst, held = [], [], 0
        if held:
            yield batch(_PAIR, src=np.concatenate(src), dst=np.concatenate(dst))

    return _dealt(fps.select("fp"), _keys(F.col("fp"), fps.count(), radius, by_chance)).mapInArrow(compare, _PAIR_SQL)


def groups(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """prints (doc_id, key, fp) with component_id: the smallest doc_id reachable over links, a document's own included.

    Equal fingerprints are one node, so copies cost nothing. Null ids are never the smallest; a group of null ids alone
    has a null component_id.
    """
    distinct = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-distinct")
    roots = components(links(distinct.select("fp"), radius))
    node = distinct.join(roots, distinct["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    ids = stored(node, "simhash-nodes")
    named = ids.join(ids.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("fp", "component_id")
    return prints.join(named, "fp")


def near_duplicates(docs: DataFrame, width: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id for every row of docs.

    Null and empty texts, and those of white space, have fingerprint zero and are linked like any other. Texts shorter
    than a shingle are one shingle. Repeated rows each get a row; an empty table gives an empty result.
    """
    prints = stored(fingerprints(docs, width), "simhash-prints")
    out = groups(prints, radius)
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


#: Near copies for a corpus that is thinned: fingerprints that differ in so many bits. Its tables have few bits in common, so more share a key by chance.
NEAR_RADIUS, NEAR_BY_CHANCE = 7, 1024


def first_of_groups(docs: DataFrame, width: int = SHINGLE, radius: int = NEAR_RADIUS) -> DataFrame:
    """The rows of docs without near copies: of each group of fingerprints linked within radius, the smallest doc_id stays.

    Links are found exactly, as for near_duplicates, and none but those that span a group are made. Null ids come last.
    Rows equal in id and text are copies; so are texts without words, whose fingerprint is zero.
    """
    base = _with_key(docs)
    prints = stored(fingerprints(docs, width).withColumn("doc_id", F.coalesce("doc_id", F.lit(NULL_ID))), "near-prints")
    firsts = stored(prints.groupBy("fp").agg(F.min(F.struct("doc_id", "key")).alias("first")), "near-firsts")
    roots = components(links(firsts.select("fp"), radius, NEAR_BY_CHANCE))
    placed = firsts.join(roots, firsts["fp"] == roots["node"], "left").withColumn("root", F.coalesce("root", "fp"))
    kept = placed.groupBy("root").agg(F.min("first").alias("first")).select("first.*")
    return base.join(kept, ["doc_id", "key"], "left_semi").dropDuplicates(["doc_id", "key"]).select("row.*")


#: Near copies by comparing sets: shingles of five words, a Jaccard similarity of 0.8 or more.
COPY_SHINGLE, COPY_SIMILARITY = 5, 0.8
#: Texts among which frequent shingles are looked for; a shingle is frequent in so many texts, or in this part of all.
COPY_SAMPLE, COPY_OFTEN, COPY_OFTEN_SHARE = 100_000, 16, 10_000
#: Rows of prefixes that are compared at a time.
_MEET_ROWS = 1 << 17

_PREFIX = pa.schema([("node", pa.int64()), ("size", pa.int32()), ("token", pa.int64()), ("pos", pa.int32()), ("often", pa.bool_())])
_PREFIX_SQL = "node long, size int, token long, pos int, often boolean"


def _sets(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, key, node (a hash of the text's set of shingles) and the set's sketch."""
    out = pa.schema([("doc_id", pa.int64()), ("key", pa.int64()), ("node", pa.int64()), ("sketch", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [np.unique(shingle_hashes(x.as_py(), width)) for x in b.column("text")]
            nodes = np.array([xxhash.xxh64_intdigest(s.tobytes(), SEED) for s in sets], np.uint64).view(np.int64)
            yield batch(out, doc_id=b.column("doc_id"), key=b.column("key"), node=nodes, sketch=[_cells(s) for s in sets])

    return docs.mapInArrow(run, "doc_id long, key long, node long, sketch binary")


def _prefixes(texts: DataFrame, width: int, similarity: float, often: np.ndarray) -> DataFrame:
    """For each text (node, text) the first shingles of its set, in an order of hashes with the frequent ones (often, sorted) last.

    So many that two texts as similar as that have one in common.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            nodes, sizes, tokens, pos, last = [], [], [], [], []
            for node, x in zip(b.column("node").to_pylist(), b.column("text")):
                h = np.unique(shingle_hashes(x.as_py(), width)).view(np.int64)
                if not len(h):
                    continue
                is_often = often[np.minimum(np.searchsorted(often, h), len(often) - 1)] == h if len(often) else np.zeros(len(h), bool)
                p = len(h) - int(np.ceil(similarity * len(h) - 1e-9)) + 1
                order = np.argsort(is_often, kind="stable")[:p]
                nodes.append(np.full(len(order), node))
                sizes.append(np.full(len(order), len(h)))
                tokens.append(h[order])
                pos.append(np.arange(len(order)))
                last.append(is_often[order])
            if nodes:
                yield batch(_PREFIX, **{k: np.concatenate(v) for k, v in zip(_PREFIX.names, (nodes, sizes, tokens, pos, last))})

    return texts.mapInArrow(run, _PREFIX_SQL)


def _alike(size_a: np.ndarray, pos_a: np.ndarray, size_b: np.ndarray, pos_b: np.ndarray, similarity: float) -> np.ndarray:
    """Whether sets may be as similar as that, if the first shingle that they share stands at these places."""
    most = np.minimum(size_a - pos_a, size_b - pos_b)
    return most >= np.ceil(similarity / (1 + similarity) * (size_a + size_b) - 1e-9)


def _met(rows: DataFrame, similarity: float) -> DataFrame:
    """(src, dst), repeats included, src > dst: nodes of different comp that meet in a task and may be similar.

    rows (task, node, size, pos, and comp, mine, own if a task compares two parts: own tells that they are one) are sorted by task.
    """
    parted = "comp" in rows.columns

    def compare(held: list[pa.RecordBatch]) -> pa.RecordBatch | None:
        t = pa.Table.from_batches(held)
        task, node, size, pos = (t.column(c).to_numpy() for c in ("task", "node", "size", "pos"))
        comp, mine, own = (t.column(c).to_numpy() for c in ("comp", "mine", "own")) if parted else (node, None, None)
        src, dst = [], []
        i, lag = np.flatnonzero(task[1:] == task[:-1]), 1
        while len(i):
            j = i + lag
            ok = (comp[i] != comp[j]) & _alike(size[i], pos[i], size[j], pos[j], similarity)
            if parted:
                ok &= own[i] | (mine[i] != mine[j])
            src.append(np.maximum(node[i[ok]], node[j[ok]]))
            dst.append(np.minimum(node[i[ok]], node[j[ok]]))
            lag += 1
            i = i[i + lag < len(task)]
            i = i[task[i + lag] == task[i]]
        if not sum(map(len, src)):
            return None
        both = np.unique(np.stack([np.concatenate(src), np.concatenate(dst)]), axis=1)
        return batch(_PAIR, src=both[0], dst=both[1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for b in batches:
            if not len(b):
                continue
            task = b.column("task").to_numpy()
            if n >= _MEET_ROWS:  # up to the end of the task that is cut
                last = held[-1].column("task")[-1].as_py()
                end = int(np.searchsorted(task != last, True)) if task[0] == last else 0
                if end < len(b):
                    done = compare([*held, b.slice(0, end)])
                    if done is not None:
                        yield done
                    held, n, b = [], 0, b.slice(end)
            held.append(b)
            n += len(b)
        if held:
            done = compare(held)
            if done is not None:
                yield done

    return rows.mapInArrow(run, _PAIR_SQL)


def _frequent(texts: DataFrame, n: int, width: int, similarity: float) -> np.ndarray:
    """Hashes of shingles that open many of n texts, sorted: a sample's, fewer than COPY_SAMPLE * COPY_OFTEN_SHARE / n texts could hold in all."""
    every = max(1, n // COPY_SAMPLE)
    least = max(COPY_OFTEN // every, n // COPY_OFTEN_SHARE // every, 8)
    some = texts.where(F.pmod("node", F.lit(every)) == 0)
    often = _prefixes(some, width, similarity, np.empty(0, np.int64)).groupBy("token").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    return np.sort(often.select("token").toPandas()["token"].to_numpy(np.int64))


def copy_links(texts: DataFrame, sketches: DataFrame, width: int = COPY_SHINGLE, similarity: float = COPY_SIMILARITY) -> DataFrame:
    """(src, dst): links that span every group of texts (node, text; distinct sets of shingles) as similar as that.

    sketches (node, sketch) has a row for each node, as _sets makes them.
    Exact: texts that share a shingle of their prefixes are compared, by all their shingles. In groups of a frequent shingle,
    which hold large groups of copies, each is compared with the group's first one; then those that are not in one
    component by then are compared with each other.
    """
    n, tasks = texts.count(), partitions(texts)
    often = _frequent(texts, n, width, similarity)
    opened = _prefixes(texts, width, similarity, often)
    if len(often):
        opened = stored(opened, "copies-prefixes")
    rare = opened.where("not often").select(F.col("token").alias("task"), "node", "size", "pos")
    pairs = _met(rare.repartition(tasks, "task").sortWithinPartitions("task"), similarity)
    if not len(often):
        return _verified(pairs.distinct(), texts, sketches, width, similarity)
    hot = opened.where("often")
    heads = hot.groupBy("token").agg(F.min("node").alias("dst"), F.count("*").alias("n"))
    stars = hot.join(heads, "token").where("node <> dst").select(F.col("node").alias("src"), "dst")
    found = _verified(pairs.unionByName(stars).distinct(), texts, sketches, width, similarity)
    placed = hot.join(components(found).withColumnRenamed("root", "comp"), "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    mixed = placed.groupBy("token").agg(F.count("*").alias("n"), F.min("comp").alias("a"), F.max("comp").alias("b")).where("a <> b")
    cuts = F.ceil(F.col("n") / PART_ROWS).cast("int")
    sized = placed.join(mixed.select("token", "n"), "token").withColumn("cuts", cuts).withColumn("mine", F.pmod(F.xxhash64("node"), "cuts").cast("int"))
    meets = F.transform(F.sequence(F.lit(0), F.col("cuts") - 1), lambda x: F.struct(F.least(x, F.col("mine")).alias("a"), F.greatest(x, F.col("mine")).alias("b")))
    dealt = sized.withColumn("m", F.explode(meets)).select(F.xxhash64("token", "m.a", "m.b").alias("task"), "node", "size", "pos", "comp", "mine", (F.col("m.a") == F.col("m.b")).alias("own"))
    rest = stored(_met(dealt.repartition(tasks, "task").sortWithinPartitions("task"), similarity).distinct(), "copies-rest")
    return found.unionByName(_verified(rest, texts, sketches, width, similarity))


#: Cells of a sketch: how many shingles of a set fall in each by hash; a cell that reaches the top of its type tells nothing.
_CELLS, _FULL = 256, 65_535


def _cells(hashes: np.ndarray) -> bytes:
    """The sketch of a set of shingles."""
    count = np.bincount((hashes >> np.uint64(56)).astype(np.int64), minlength=_CELLS)
    return np.minimum(count, _FULL).astype("<u2").tobytes()


def _may_be(similarity: float):
    """Whether sets of these sketches may be as similar as that: cell by cell they share the lesser count at most."""

    @F.pandas_udf("boolean")
    def judge(a: pd.Series, b: pd.Series) -> pd.Series:
        x, y = (np.frombuffer(b"".join(c), "<u2").reshape(-1, _CELLS).astype(np.int64) for c in (a, b))
        enough = np.minimum(x, y).sum(1) >= np.ceil(similarity / (1 + similarity) * (x.sum(1) + y.sum(1)) - 1e-9)
        return pd.Series(enough | (x.max(1, initial=0) >= _FULL) | (y.max(1, initial=0) >= _FULL))

    return judge


def _verified(pairs: DataFrame, texts: DataFrame, sketches: DataFrame, width: int, similarity: float) -> DataFrame:
    """The pairs whose sets are as similar as that. Sketches go with every pair, texts only with those that sketches leave.

    Nodes of those are written before texts are looked for, so that the join knows their size: while they are few, texts
    stay where they lie.
    """
    sides = lambda d, c: (d.select(F.col("node").alias(side), F.col(c).alias(f"{side}_{c}")) for side in ("src", "dst"))
    a, b = sides(sketches, "sketch")
    likely = stored(pairs.join(a, "src").join(b, "dst").where(_may_be(similarity)("src_sketch", "dst_sketch")).select("src", "dst"), "copies-likely")
    named = stored(likely.select(F.col("src").alias("node")).unionByName(likely.select(F.col("dst").alias("node"))).distinct(), "copies-named")
    a, b = sides(stored(texts.join(named, "node", "left_semi"), "copies-texts"), "text")
    judged = likely.join(a, "src").join(b, "dst").withColumn("similarity", _similarity(width).asNondeterministic()("src_text", "dst_text"))
    return stored(judged.where(F.col("similarity") >= similarity).select("src", "dst"), "copies-links")


def first_of_copies(docs: DataFrame, width: int = COPY_SHINGLE, similarity: float = COPY_SIMILARITY) -> DataFrame:
    """The rows of docs without near copies: of each group, linked by texts as similar as that, the smallest doc_id stays.

    Texts with equal sets of shingles are one node; links between nodes are found exactly (see copy_links). Null ids come
    last. Rows equal in id and text are copies; so are texts without words.
    """
    base = _with_key(docs)
    sets = stored(_sets(base.select("doc_id", "key", F.col("row.text").cast("string").alias("text")), width), "copies-sets")
    firsts = sets.groupBy("node").agg(F.min(F.struct("doc_id", "key")).alias("f")).select("node", F.col("f.doc_id").alias("doc_id"), F.col("f.key").alias("key"))
    reps = stored(base.join(firsts, ["doc_id", "key"]).dropDuplicates(["doc_id", "key"]), "copies-firsts")
    sketches = stored(sets.select("node", "sketch").dropDuplicates(["node"]), "copies-sketches")  # equal sets, equal sketches
    roots = components(copy_links(reps.select("node", F.col("row.text").cast("string").alias("text")), sketches, width, similarity))
    placed = reps.select("node", "doc_id", "key").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    kept = placed.groupBy("root").agg(F.min(F.struct("doc_id", "key", "node")).alias("f")).select(F.col("f.node").alias("node"))
    return reps.join(kept, "node").select("row.*")


def _with_key(docs: DataFrame) -> DataFrame:
    return docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("doc_id"), row_key(F.col("text")).alias("key"))


def _similarity(width: int):
    @F.pandas_udf("double")
    def jaccard(a: pd.Series, b: pd.Series) -> pd.Series:
        out, last, kept = [], None, None
        for x, y in zip(a, b):
            if kept is None or y is not last:
                last, kept = y, np.unique(shingle_hashes(y, width))
            mine = np.unique(shingle_hashes(x, width))
            both = len(np.intersect1d(mine, kept, assume_unique=True))
            union = len(mine) + len(kept) - both
            out.append(both / union if union else 1.0)
        return pd.Series(out, dtype=float)

    return jaccard
