"""The approximate vector index against the exact search."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from veedor.operators import text as tx
from veedor.operators import vector_index as vi

SF = "/root/testdata/sf0.01"


def rows_of(x):
    return [(i, v.tolist()) for i, v in enumerate(x)]


def unit(x):
    return x / np.linalg.norm(x, axis=1, keepdims=True)


@pytest.fixture(scope="module")
def clustered(spark, tmp_path_factory):
    rng = np.random.default_rng(5)
    x = unit(rng.normal(size=(40, 32))[rng.integers(0, 40, 4000)] + 0.25 * rng.normal(size=(4000, 32))).astype(np.float32)
    vectors = spark.createDataFrame(rows_of(x), "chunk_id long, v array<float>").cache()
    return vectors, vi.build(vectors, str(tmp_path_factory.mktemp("index") / "a"))


def exact(vectors, queries, top=20):
    return {(r.query_id, r.chunk_id): r.score for r in tx.vector_top(vectors, queries, top).collect()}


def asked(vectors):
    return vectors.where("chunk_id % 20 = 0").select(F.col("chunk_id").alias("query_id"), F.col("v").alias("q"))


def test_every_vector_is_indexed_and_recall_is_high_with_few_cells(spark, clustered):
    vectors, index = clustered
    assert index.rows(spark).count() == 4000 and len(index.centres) == 63
    assert index.probes <= 12  # a fifth of the cells
    want, got = exact(vectors, asked(vectors)), {(r.query_id, r.chunk_id): r.score for r in vi.search(index, asked(vectors)).collect()}
    assert len(set(want) & set(got)) >= 0.9 * len(want)
    assert all(want[k] == got[k] for k in set(want) & set(got))


def test_many_queries_are_dealt_with_equal_results(spark, clustered, monkeypatch):
    vectors, index = clustered
    monkeypatch.setattr(vi, "PER_TASK", 30)
    a = sorted(map(tuple, vi.search(index, asked(vectors)).collect()))
    b = sorted(map(tuple, vi.search(index, asked(vectors), sent=3).collect()))
    assert a == b and len(a) == 200 * 20


def test_all_probes_are_the_exact_search(spark, clustered):
    vectors, index = clustered
    got = {(r.query_id, r.chunk_id): r.score for r in vi.search(index, asked(vectors), probes=10_000, refine=10).collect()}
    assert got == exact(vectors, asked(vectors))


def test_unprobed_cells_are_not_read(spark, clustered):
    vectors, index = clustered
    one = asked(vectors).where("query_id = 20")
    plan = vi.search(index, one, probes=2)._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(cell" in plan or "cell#" in plan.split("PartitionFilters:")[1][:60]


def test_an_index_holds_after_loading_and_odd_rows(spark, clustered, tmp_path):
    vectors, index = clustered
    again = vi.load(spark, index.path)
    assert np.array_equal(again.centres, index.centres) and again.probes == index.probes
    none = vi.build(vectors.limit(0), str(tmp_path / "none"))
    assert vi.search(none, asked(vectors)).count() == 0
    two = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 1.0]), ("c", None)], "chunk_id string, v array<double>")
    got = vi.search(vi.build(two, str(tmp_path / "two")), spark.createDataFrame([("x", [1.0, 0.0]), ("y", None)], "query_id string, q array<double>"), probes=9).collect()
    assert [(r.query_id, r.chunk_id, r.score, r["rank"]) for r in got] == [("x", "a", 1.0, 1), ("x", "b", 0.0, 2)]


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")
def test_recall_over_the_given_vectors(spark, tmp_path):
    e = spark.read.parquet(f"{SF}/embeddings.parquet")
    vectors = e.select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("v"))
    index = vi.build(vectors, str(tmp_path / "given"))
    want, got = exact(vectors, asked(vectors)), {(r.query_id, r.chunk_id) for r in vi.search(index, asked(vectors)).collect()}
    assert len(set(want) & got) >= 0.9 * len(want)
