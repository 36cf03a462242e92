"""The stored vector index against a full scan, on even, clustered and odd vectors."""

import glob
import re

import numpy as np
import pytest

from statutemill.operators import search
from statutemill.operators.vector_index import VectorIndex, fit, n_lists
from statutemill.sources.shared import new_path

VECTORS = "chunk_id long, embedding array<float>"


def clustered(n, dim=16, seed=3):
    rng = np.random.default_rng(seed)
    centers = rng.normal(size=(12, dim)) * 8
    of = np.where(rng.random(n) < 0.4, 0, rng.integers(0, 12, n))  # one cluster holds four in ten
    return (centers[of] + rng.normal(size=(n, dim))).astype(np.float32)


def frame(spark, x, first=0):
    return spark.createDataFrame([(first + i, a.tolist()) for i, a in enumerate(x)], VECTORS)


def hits(df):
    return {(r["query_id"], r["rank"], r["chunk_id"]) for r in df.collect()}


@pytest.fixture(scope="module")
def vectors(spark):
    path = new_path(spark, "test-vectors")
    rows = frame(spark, clustered(1500)).unionByName(frame(spark, clustered(1500)[:40], 5000)).unionByName(spark.createDataFrame([(9000, None)], VECTORS))
    rows.write.parquet(path)  # with copies, whose ties the id decides
    return spark.read.parquet(path)


@pytest.fixture(scope="module")
def index(spark, vectors):
    return VectorIndex(spark, new_path(spark, "test-index")).build(vectors, block_floats=1 << 10)


def test_every_vector_is_in_one_list_within_its_radius(index, vectors):
    rows = index.vectors().join(index.read("lists"), "list_id").collect()
    assert sorted(r["chunk_id"] for r in rows) == sorted(r[0] for r in vectors.where("embedding is not null").select("chunk_id").collect())
    assert all(np.linalg.norm(np.array(r["embedding"]) - np.array(r["centroid"])) <= r["radius"] + 1e-9 for r in rows)
    assert 10 <= index.read("lists").count() <= 2 * n_lists(1540)


def test_search_equals_a_full_scan(index, vectors):
    asks = vectors.where("chunk_id % 20 = 0").withColumnRenamed("chunk_id", "query_id")
    want = hits(search.knn(asks, vectors, 7))
    assert hits(index.search(asks, 7, 2)) == want
    some = hits(index.search(asks, 7, 4, exact=False))
    assert len({(q, c) for q, _, c in some} & {(q, c) for q, _, c in want}) >= 0.9 * len(want)


def test_more_neighbours_than_vectors(spark):
    x = frame(spark, clustered(9))
    asks = x.limit(2).withColumnRenamed("chunk_id", "query_id")
    assert VectorIndex(spark, new_path(spark, "test-index")).build(x).search(asks, 20, 1).count() == 18


def test_sampled_centroids_lose_no_vector(spark, vectors):
    index = VectorIndex(spark, new_path(spark, "test-index")).build(vectors, sample=60)
    assert index.vectors().count() == 1540
    asks = vectors.where("chunk_id % 100 = 0").withColumnRenamed("chunk_id", "query_id")
    assert hits(index.search(asks, 5, 3)) == hits(search.knn(asks, vectors, 5))


def test_nothing_to_index_and_nothing_to_ask(spark, vectors, index):
    empty = VectorIndex(spark, new_path(spark, "test-index")).build(vectors.where("false"))
    asks = vectors.limit(3).withColumnRenamed("chunk_id", "query_id")
    assert empty.vectors().count() == 0 and empty.search(asks).count() == 0
    assert index.search(asks.where("false")).count() == 0


def test_lists_are_partitions_that_searches_prune(spark, index, vectors):
    root = index.path.removeprefix("file://")
    assert len(glob.glob(f"{root}/vectors/list_id=*")) == index.read("lists").count()
    one = vectors.where("chunk_id = 3").withColumnRenamed("chunk_id", "query_id")
    plans = index.search(one, 3, 2, exact=False)._jdf.queryExecution().executedPlan().toString()
    (asked,) = set(re.findall(r"PartitionFilters: \[.*?list_id#\d+ (?:IN|INSET) \(?([\d,]+)", plans))
    read = asked.split(",")
    assert 0 < len(read) <= 4


def test_means_settle_on_separate_groups():
    x = np.repeat(np.array([[0.0, 0], [10, 0], [0, 10]]), 30, 0)
    assert sorted(map(tuple, fit(x, 3).round(6))) == [(0, 0), (0, 10), (10, 0)]
    assert len(fit(x[:1], 5)) == 1
