"""A stored index over vectors: two levels of centroids, lists as partitions, searched as exactly as a full scan.

Centroids are fitted on a bounded sample: coarse ones by k-means over all of it, fine ones, the lists, within each coarse
cell. Their numbers are about the fourth and the square root of the number of vectors, so only coarse centroids go to
every task; lists' centroids are joined to the blocks of vectors or questions of their coarse cell. Vectors lie in blocks
under the partition of their list. Lists and coarse cells know their radius, the distance of their farthest vector: a
list has no vector nearer to a question than the question's distance from its centroid less the radius.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..sources.shared import stored
from .search import _in_blocks, _ranked

#: Vectors that centroids are fitted on, on average: all, or so many chosen by a hash of their id.
SAMPLE = 1 << 16
#: Floats of vectors that one block holds, in an index and of questions.
BLOCK_FLOATS = 1 << 18
#: Rounds of fitting, and the seed of their start.
ROUNDS, SEED = 10, 7
#: For rounding, where a bound decides.
MARGIN = 1e-9

#: Coarse cells in which a question's nearest lists are looked for.
NEAR_CELLS = 4

_FINE = "list_id int, coarse int, centroid array<double>"
_NEAR = "query_id long, list_id int, gap double"


def n_lists(n: int) -> int:
    """Lists of an index over n vectors."""
    return 100 if 5000 <= n <= 15000 else max(1, int(math.sqrt(n)))


def _matrix(vectors: pa.ListArray) -> np.ndarray:
    return vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(vectors), -1)


def _gaps(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Distances of rows from centroids."""
    return np.sqrt(np.maximum(0, (x**2).sum(1)[:, None] + (centroids**2).sum(1)[None] - 2 * x @ centroids.T))


def _exact(x: np.ndarray, centroid: np.ndarray) -> np.ndarray:
    return np.sqrt(((x - centroid) ** 2).sum(1))


def fit(x: np.ndarray, k: int) -> np.ndarray:
    """At most k centroids of x: a start spread out by distance, then rounds of means; cells left empty keep their centroid."""
    rng = np.random.default_rng(SEED)
    found = x[rng.integers(len(x), size=1)]
    near = ((x - found[0]) ** 2).sum(1)
    while len(found) < min(k, len(x)) and near.max() > 0:
        found = np.vstack([found, x[rng.choice(len(x), p=near / near.sum())]])
        near = np.minimum(near, ((x - found[-1]) ** 2).sum(1))
    for _ in range(ROUNDS):
        of = _gaps(x, found).argmin(1)
        counts = np.bincount(of, minlength=len(found))
        sums = np.zeros_like(found)
        np.add.at(sums, of, x)
        found = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], found)
    return found


@dataclass(frozen=True)
class VectorIndex:
    """The index under path: vectors (list_id as partitions), lists and coarse."""

    spark: SparkSession
    path: str

    def read(self, table: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path.rstrip('/')}/{table}")

    def _write(self, rows: DataFrame, table: str, *by: str) -> DataFrame:
        rows.write.mode("overwrite").partitionBy(*by).parquet(f"{self.path.rstrip('/')}/{table}")
        return self.read(table)

    def vectors(self) -> DataFrame:
        """(list_id, chunk_id, embedding), out of the blocks."""
        return self.read("vectors").select("list_id", F.inline("vs"))

    def _coarse(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Numbers, centroids and radii of the coarse cells, about the fourth root of the number of vectors."""
        rows = self.read("coarse").orderBy("coarse").collect()
        return np.array([r["coarse"] for r in rows]), np.array([r["centroid"] for r in rows], float), np.array([r["radius"] for r in rows])

    def build(self, vectors: DataFrame, sample: int = SAMPLE, block_floats: int = BLOCK_FLOATS) -> VectorIndex:
        """An index over vectors (chunk_id, embedding). Rows without a vector take no part; all others must be equally long."""
        from pyspark.ml.clustering import KMeans
        from pyspark.ml.functions import array_to_vector

        rows = vectors.where("embedding is not null").select(F.col("chunk_id").cast("long").alias("chunk_id"), "embedding")
        kind = rows.schema["embedding"].dataType.simpleString()
        size = rows.agg(F.count("*").alias("n"), F.max(F.size("embedding")).alias("dim")).head()  # one row
        if not size.n:
            self._write(self.spark.createDataFrame([], f"vs array<struct<chunk_id:bigint,embedding:{kind}>>, list_id int"), "vectors")
            self._write(self.spark.createDataFrame([], _FINE + ", radius double, n long"), "lists")
            self._write(self.spark.createDataFrame([], "coarse int, centroid array<double>, radius double"), "coarse")
            return self
        lists = n_lists(size.n)
        cells = math.ceil(math.sqrt(lists))
        each = math.ceil(lists / cells)
        share = F.pmod(F.xxhash64("chunk_id"), F.lit(1 << 30)) / float(1 << 30)
        taken = rows.where(share < sample / size.n) if size.n > sample else rows
        model = KMeans(k=cells, seed=SEED, maxIter=ROUNDS, featuresCol="features").fit(taken.select(array_to_vector(F.col("embedding").cast("array<double>")).alias("features")))
        centers = np.array([c for c in model.clusterCenters()])

        def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if len(b):
                    x = _matrix(b.column("embedding"))
                    of = _gaps(x, centers).argmin(1)
                    yield pa.RecordBatch.from_arrays([b.column("chunk_id"), b.column("embedding"), pa.array(of, pa.int32()), pa.array(_exact(x, centers[of]))], ["chunk_id", "embedding", "coarse", "coarse_gap"])

        def refine(key: tuple, members: pd.DataFrame) -> pd.DataFrame:
            found = fit(np.stack(members.sort_values("chunk_id")["embedding"].to_list()), each)
            return pd.DataFrame({"list_id": key[0] * each + np.arange(len(found)), "coarse": key[0], "centroid": list(found)})

        centered = self.spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centers)], "coarse int, centroid array<double>")
        fitted = stored(taken.mapInArrow(assign, f"chunk_id long, embedding {kind}, coarse int, coarse_gap double").groupBy("coarse").applyInPandas(refine, _FINE), "index-fitted")
        unseen = centered.join(fitted.select("coarse").distinct(), "coarse", "left_anti")  # a cell that the sample has no vector of is one list
        fine = fitted.unionByName(unseen.select((F.col("coarse") * each).alias("list_id"), "coarse", "centroid"))
        block = max(1, block_floats // max(1, size.dim))
        assigned = rows.mapInArrow(assign, f"chunk_id long, embedding {kind}, coarse int, coarse_gap double")
        many = assigned.groupBy("coarse").agg(F.count("*").alias("m"), F.max("coarse_gap").alias("radius"))
        many = self._write(many.join(centered, "coarse"), "coarse")
        dealt = assigned.join(F.broadcast(many.select("coarse", "m")), "coarse").withColumn("part", F.pmod(F.xxhash64("chunk_id"), F.ceil(F.col("m") / block)))
        packed = dealt.groupBy("coarse", "part").agg(F.collect_list(F.struct("chunk_id", "embedding")).alias("vs"))
        centroids = fine.groupBy("coarse").agg(F.array_sort(F.collect_list(F.struct("list_id", "centroid"))).alias("cs"))

        def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for i in range(len(b)):
                    vs, cs = b.column("vs")[i].values, b.column("cs")[i].values
                    x, c = _matrix(vs.field("embedding")), _matrix(cs.field("centroid"))
                    of = _gaps(x, c).argmin(1)
                    yield pa.RecordBatch.from_arrays([cs.field("list_id").take(pa.array(of)), vs.field("chunk_id"), vs.field("embedding"), pa.array(_exact(x, c[of]))], ["list_id", "chunk_id", "embedding", "gap"])

        flat = stored(packed.join(centroids, "coarse").select("vs", "cs").mapInArrow(listed, f"list_id int, chunk_id long, embedding {kind}, gap double"), "index-lists")
        sizes = flat.groupBy("list_id").agg(F.max("gap").alias("radius"), F.count("*").alias("n"))
        known = self._write(fine.join(sizes, "list_id"), "lists")
        part = F.pmod(F.xxhash64("chunk_id"), F.ceil(F.col("n") / block)).alias("part")
        blocks = flat.join(known.select("list_id", "n"), "list_id").select("list_id", part, "chunk_id", "embedding").groupBy("list_id", "part").agg(F.collect_list(F.struct("chunk_id", "embedding")).alias("vs"))
        self._write(blocks.repartitionByRange("list_id", "part").drop("part"), "vectors", "list_id")
        return self

    def search(self, queries: DataFrame, k: int = 10, nprobe: int = 10, exact: bool = True) -> DataFrame:
        """(query_id, chunk_id, distance, score, rank): as search.knn over the index's vectors, with the same rows.

        Each question's nprobe nearest lists first; then, if exact, every other list that may hold a nearer vector than the
        k found. Without exact, lists that are not probed may hide near vectors. Questions travel in blocks; where they
        are few, files of lists that none asks for are not read.
        """
        asks = queries.where("embedding is not null").select(F.col("query_id").cast("long").alias("query_id"), "embedding")
        size = asks.agg(F.count("*").alias("n"), F.max(F.size("embedding")).alias("dim")).head()  # one row
        blocks = max(1, math.ceil(size.n * max(1, size.dim or 1) / BLOCK_FLOATS))
        asks = stored(asks.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks))), "index-asks")
        near = self._in_cells(asks, "query_id", "embedding").mapInArrow(_nearest_lists(nprobe), _NEAR)
        w = W.partitionBy("query_id").orderBy("gap", "list_id")
        first = stored(near.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= nprobe).groupBy("query_id").agg(F.collect_list("list_id").alias("probed")), "index-probes")
        probes = first.select("query_id", F.explode("probed").alias("list_id")).join(asks, "query_id").groupBy("list_id", "block").agg(F.collect_list(F.struct("query_id", "embedding")).alias("qs"))
        vectors = self.read("vectors")
        if blocks == 1:
            vectors = vectors.where(F.col("list_id").isin([r[0] for r in first.select(F.explode("probed")).distinct().collect()]))  # at most all numbers of lists
        hits = _ranked(_in_blocks(probes.join(vectors, "list_id").select("qs", "vs"), k), k)
        if not exact:
            return hits
        hits = stored(hits.select("query_id", "chunk_id", "distance", "rank"), "index-hits")
        edges = hits.groupBy("query_id").agg(F.max(F.when(F.col("rank") == k, F.sqrt("distance"))).alias("edge"))
        # questions with fewer than k hits so far have no bound
        far = asks.join(first, "query_id").join(edges, "query_id", "left").withColumn("edge", F.coalesce("edge", F.lit(float("inf"))))
        cells = self._in_cells(far, "query_id", "embedding", "edge", "probed")
        kind = asks.schema["embedding"].dataType.simpleString()
        vectors = self.read("vectors")
        if blocks == 1:
            vectors = vectors.where(F.col("list_id").isin([r[0] for r in cells.mapInArrow(_lists_within(False), "list_id int").distinct().collect()]))
        more = cells.mapInArrow(_lists_within(True), f"list_id int, qs array<struct<query_id:bigint,embedding:{kind},edge:double>>")
        rest = _in_blocks(more.join(vectors, "list_id").select("qs", "vs"), k)
        return _ranked(hits.drop("rank").unionByName(rest), k)

    def _in_cells(self, asks: DataFrame, *fields: str) -> DataFrame:
        """(qs, cs): questions of a block with a coarse cell's lists: the nearest cells of each, or with an edge all cells that reach within it."""
        numbers, centers, radii = self._coarse()
        packed = asks.groupBy("block").agg(F.collect_list(F.struct(*fields)).alias("qs"))
        kind = packed.schema["qs"].dataType.simpleString()

        def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for i in range(len(b) if len(numbers) else 0):
                    qs = b.column("qs")[i].values
                    gaps = _gaps(_matrix(qs.field("embedding")), centers)
                    if "edge" in fields:
                        wants = gaps - radii[None] <= _reach(qs, gaps)
                    else:
                        wants = np.zeros(gaps.shape, bool)
                        np.put_along_axis(wants, np.argsort(gaps, 1, kind="stable")[:, :NEAR_CELLS], True, 1)
                    for c in np.flatnonzero(wants.any(0)):
                        yield _packed_row(int(numbers[c]), qs, wants[:, c], "coarse")

        lists = self.read("lists").groupBy("coarse").agg(F.array_sort(F.collect_list(F.struct("list_id", "centroid", "radius"))).alias("cs"))
        return packed.select("qs").mapInArrow(cells, f"coarse int, qs {kind}").join(lists, "coarse").select("qs", "cs")


def _reach(qs: pa.StructArray, gaps: np.ndarray) -> np.ndarray:
    """How near something must come to matter, with a margin for rounding."""
    return qs.field("edge").to_numpy(zero_copy_only=False)[:, None] * (1 + MARGIN) + MARGIN * (1 + gaps)


def _packed_row(number: int, qs: pa.StructArray, mask: np.ndarray, name: str) -> pa.RecordBatch:
    """One row: a number, and the questions of the mask as a list."""
    taken = qs.filter(pa.array(mask))
    return pa.RecordBatch.from_arrays([pa.array([number], pa.int32()), pa.ListArray.from_arrays(pa.array([0, len(taken)], pa.int32()), taken)], [name, "qs"])


def _nearest_lists(nprobe: int):
    """mapInArrow over (qs, cs): the nearest lists of each question."""

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(len(b)):
                qs, cs = b.column("qs")[i].values, b.column("cs")[i].values
                gaps = _gaps(_matrix(qs.field("embedding")), _matrix(cs.field("centroid")))
                best = np.argsort(gaps, 1, kind="stable")[:, :nprobe]
                rows, cols = np.repeat(np.arange(len(best)), best.shape[1]), best.reshape(-1)
                yield pa.RecordBatch.from_arrays([qs.field("query_id").take(pa.array(rows)), cs.field("list_id").take(pa.array(cols)), pa.array(gaps[rows, cols])], ["query_id", "list_id", "gap"])

    return near


def _lists_within(payload: bool):
    """mapInArrow over (qs, cs): lists that may hold a vector within a question's edge and were not probed, with those questions."""

    def within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(len(b)):
                qs, cs = b.column("qs")[i].values, b.column("cs")[i].values
                ids = cs.field("list_id").to_numpy(zero_copy_only=False)
                gaps = _gaps(_matrix(qs.field("embedding")), _matrix(cs.field("centroid")))
                wants = gaps - cs.field("radius").to_numpy(zero_copy_only=False)[None] <= _reach(qs, gaps)
                for row, probed in enumerate(qs.field("probed")):
                    wants[row] &= ~np.isin(ids, probed.values.to_numpy(zero_copy_only=False))
                slim = pa.StructArray.from_arrays([qs.field(x) for x in ("query_id", "embedding", "edge")], ["query_id", "embedding", "edge"])
                for c in np.flatnonzero(wants.any(0)):
                    yield _packed_row(int(ids[c]), slim, wants[:, c], "list_id") if payload else pa.RecordBatch.from_arrays([pa.array([ids[c]], pa.int32())], ["list_id"])

    return within
