"""The approximate index: recall and share of rows scored, search width, filters, storage, and its place in a pipeline."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from passagework.operators import ann, retrieval
from passagework.plans import config as configs
from passagework.plans.pipeline import Pipeline

DATA = "/root/testdata"


def measured(found, truth):
    other = F.col("query_id") != F.col("chunk_id")
    return ann.recall(found.where(other), truth.where(other)).first()["recall"]


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_recall_and_share(spark, sf):
    if not os.path.exists(f"{DATA}/{sf}"):
        pytest.skip("no test data")
    vectors = spark.read.parquet(f"{DATA}/{sf}/embeddings.parquet").select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("vector"))
    queries = vectors.where("chunk_id % 20 = 0").select(F.col("chunk_id").alias("query_id"), "vector")
    n = vectors.count()
    model = ann.fit(vectors)
    rows = ann.with_cells(vectors, model).cache()
    assert rows.select(F.countDistinct("cell")).first()[0] > 2
    truth = retrieval.dense_top_k(queries, vectors, 6, space="cosine").cache()
    found = [measured(ann.search(queries, rows, model, 6, w, 50), truth) for w in (1, len(model.centroids) // 2, len(model.centroids))]
    assert found[0] < found[1] < found[2]  # a wider search finds more, without building anything again
    assert found[2] >= 0.9 and 50 <= 0.1 * n  # a tenth of the rows at most gets exact scores


def made(spark, n=400, width=10, seed=5):
    r = np.random.default_rng(seed)
    centres = r.standard_normal((6, width)) * 4
    rows = [(f"c{k}", (centres[k % 6] + r.standard_normal(width)).astype(float).tolist(), "even" if k % 2 == 0 else "odd") for k in range(n)]
    rows += [(f"same{k}", rows[0][1], "same") for k in range(n // 2)]  # a third of all rows is one vector
    return spark.createDataFrame(rows, "chunk_id string, vector array<double>, kind string")


def test_clusters_filters_and_storage(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(ann, "TILE_ROWS", 32)  # cells of several blocks
    monkeypatch.setattr(ann, "TILE_QUERIES", 4)
    vectors = made(spark)
    queries = vectors.where("kind <> 'same'").orderBy("chunk_id").limit(25).select(F.col("chunk_id").alias("query_id"), "vector")
    for space in ("ip", "cosine", "l2"):
        model = ann.fit(vectors, space, cells=8)
        rows = ann.with_cells(vectors, model)
        ann.save(rows, model, f"{tmp_path}/{space}")
        rows, model = ann.load(spark, f"{tmp_path}/{space}")
        assert rows.count() == vectors.count()
        whole = ann.search(queries, rows, model, 5, 8, 10_000)
        exact = retrieval.dense_top_k(queries, vectors, 5, space)
        assert {tuple(r) for r in whole.select("query_id", "rank", "chunk_id").collect()} == {tuple(r) for r in exact.select("query_id", "rank", "chunk_id").collect()}
        odd = ann.search(queries, rows, model, 5, 8, 10_000, {"kind": "odd"})
        assert {tuple(r) for r in odd.select("query_id", "rank", "chunk_id").collect()} == {tuple(r) for r in retrieval.dense_top_k(queries, vectors, 5, space, {"kind": "odd"}).select("query_id", "rank", "chunk_id").collect()}
    # l2: clusters are found in the nearest cells, other cells' folders aren't read
    one = queries.where("query_id = 'c0'")
    near = ann.search(one, rows, model, 5, 2)
    assert near.count() == 5
    plan = near._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [cell" in plan.replace("#", " #") or "cell#" in plan.split("PartitionFilters: [")[1][:30]


def test_odd_tables(spark):
    vectors = made(spark, 9)
    model = ann.fit(vectors.limit(2), "cosine")
    rows = ann.with_cells(vectors, model)
    queries = vectors.select(F.col("chunk_id").alias("query_id"), "vector")
    assert ann.search(queries, rows, model, 3, 4).count() == 3 * queries.count()
    assert ann.search(queries.limit(0), rows, model, 3, 4).count() == 0
    assert ann.search(queries, rows.limit(0), model, 3, 4).count() == 0
    assert ann.with_cells(vectors.limit(0), ann.fit(vectors.limit(0))).count() == 0


def test_pipeline_changes_the_width_online(spark, tmp_path):
    texts = [(f"d{k}", f"number {k} speaks of {'apples' if k % 3 else 'pears'} and {k * 7} other things") for k in range(60)]
    docs = spark.createDataFrame(texts, "doc_id string, text string")
    config = configs.load(index={"type": "chroma", "space": "cosine", "ef_search": 1, "cells": 6}, retriever={"type": "vector"}, reranker={"type": "identity"})
    pipeline = Pipeline(spark, config).index(docs)
    queries = docs.select(F.col("doc_id").alias("query_id"), F.col("text").alias("question"))
    exact = Pipeline(spark, {**config, "index": {"type": "flat", "space": "cosine"}}).index(docs).candidates(queries, 5).select("query_id", "chunk_id").cache()
    built = pipeline.kb.cells("cosine", 6)
    found = []
    for width in (1, 3, 6):
        found.append(ann.recall(pipeline.set_ef_search(width).candidates(queries, 5), exact).first()["recall"])
        assert pipeline.kb.cells("cosine", 6) is built
    assert found[0] < found[2] and found == sorted(found) and found[2] > 0.95
    pipeline.kb.save(f"{tmp_path}/kb")
    again = type(pipeline.kb).load(spark, f"{tmp_path}/kb")
    assert again._cells is not None and again.cells("cosine", 6)[0].count() == 60


def test_all_rows_of_visited_cells_are_scored(spark):
    """No code decides: with all cells the search is exact however many rows there are, with fewer it is exact within them."""
    rng = np.random.default_rng(11)
    rows = spark.createDataFrame([(k, x) for k, x in enumerate(rng.standard_normal((3000, 16)).tolist())], "chunk_id long, vector array<float>")
    queries = rows.where("chunk_id % 300 = 0").withColumnRenamed("chunk_id", "query_id")
    model = ann.fit(rows, "cosine", 6)
    index = ann.with_cells(rows, model).persist()
    exact = {(r["query_id"], r["rank"]): r["chunk_id"] for r in retrieval.dense_top_k(queries, rows, 30, space="cosine").collect()}
    found = ann.search(queries, index, model, 30, 6, rescored="all").collect()
    assert {(r["query_id"], r["rank"]): r["chunk_id"] for r in found} == exact
    cell = {r["chunk_id"]: r["cell"] for r in index.collect()}
    for r in ann.search(queries, index, model, 30, 2, rescored="all").collect():
        q = np.array([x["vector"] for x in queries.where(f"query_id = {r['query_id']}").collect()], np.float64) if r["rank"] == 1 else None
        assert q is None or cell[r["chunk_id"]] in model.order(q)[0, :2]


def test_no_pair_of_the_lsh_search_is_shuffled(spark):
    rng = np.random.default_rng(12)
    rows = spark.createDataFrame([(k, x) for k, x in enumerate(rng.standard_normal((400, 8)).tolist())], "chunk_id long, vector array<float>")
    queries = rows.where("chunk_id % 40 = 0").withColumnRenamed("chunk_id", "query_id")
    found = retrieval.lsh_top_k(queries, rows, 7, tables=3, bits=3, probes=1)
    assert "Join" not in found._jdf.queryExecution().toString()
    q, v = retrieval.lsh_signatures(queries, "query_id", 3, 3, 7, 1).collect(), retrieval.lsh_signatures(rows, "chunk_id", 3, 3, 7).collect()
    want = {}
    for a in q:
        near = sorted((-round(float(np.dot(np.array(a["vector"], np.float64), np.array(b["vector"], np.float64))), 9), b["chunk_id"]) for b in v if set(a["codes"]) & set(b["codes"]))
        want |= {(a["query_id"], i + 1): c for i, (_, c) in enumerate(near[:7])}
    assert {(r["query_id"], r["rank"]): r["chunk_id"] for r in found.collect()} == want
