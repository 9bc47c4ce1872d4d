"""The approximate index against the exact scan."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cairn.operators import ann, vectors

SCHEMA = "id bigint, embedding array<double>"


def exact(spark, queries, store, limit):
    return {(r["query_id"], r["id"]) for r in vectors.search_many(queries, store, limit).select("query_id", "id").collect()}


def test_recall_on_the_embeddings(spark, sf):
    """Queries with ids divisible by 100 against all rows; every row is indexed."""
    store = spark.read.parquet(f"{sf}/embeddings.parquet").select(F.col("vec_id").alias("id"), "embedding")
    queries = store.where("id % 100 = 0")
    index = ann.AnnIndex.build(store)
    assert index.rows.count() == store.count()
    want = exact(spark, queries, store, 10)
    got = {(r["query_id"], r["id"]) for r in index.search(queries, store, 10).select("query_id", "id").collect()}
    assert len(want & got) >= 0.9 * len(want)
    assert index.scanned(queries) < 0.9


def test_clustered_vectors_need_few_lists(spark):
    rng = np.random.default_rng(2)
    middles = rng.normal(size=(40, 32))
    rows = [(i, (middles[i % 40] + 0.3 * rng.normal(size=32)).tolist()) for i in range(4000)]
    store = spark.createDataFrame(rows, SCHEMA)
    queries = store.where("id % 100 = 0")
    index = ann.AnnIndex.build(store, lists=40, parts=8, sample=1000)
    want = exact(spark, queries, store, 10)
    got = {(r["query_id"], r["id"]): r["score"] for r in index.search(queries, store, 10, probes=6, keep=150).collect()}
    assert len(want & set(got)) >= 0.9 * len(want)
    assert index.scanned(queries, 6) < 0.4
    x = np.array([v for _, v in rows])
    for (q, i), s in list(got.items())[:50]:
        assert s == pytest.approx(x[q] @ x[i] / np.linalg.norm(x[q]) / np.linalg.norm(x[i]))


def test_a_list_is_many_blocks_with_the_same_result(spark):
    rng = np.random.default_rng(3)
    rows = [(i, (np.ones(16) + 0.1 * rng.normal(size=16)).tolist()) for i in range(600)]
    store = spark.createDataFrame(rows, SCHEMA)
    queries = store.where("id % 100 = 0")
    one, many = (ann.AnnIndex.build(store, lists=2, parts=4, block=b) for b in (10_000, 50))
    assert many.rows.groupBy("list", "block").count().agg(F.max("count")).first()[0] < 100
    search = lambda x: sorted(tuple(r)[:2] for r in x.search(queries, store, 5, probes=2, keep=600).select("query_id", "id").collect())
    assert search(one) == search(many) == sorted(exact(spark, queries, store, 5))


def test_odd_rows(spark):
    good = [(i, [float(i), 1.0, -1.0, 2.0]) for i in range(20)]
    odd = [(50, None), (51, []), (52, [0.0] * 4), (53, [1.0] * 3), (None, [1.0, 2.0, 3.0, 4.0]), (54, [float("nan")] * 4), (3, [3.0, 1.0, -1.0, 2.0])]
    store = spark.createDataFrame(good + odd, SCHEMA)
    index = ann.AnnIndex.build(store, lists=2, parts=2)
    assert sorted(r["id"] for r in index.rows.collect()) == sorted([*range(20), 3])
    found = index.search(store.where("id = 3 or id > 49"), store, 3, probes=2).collect()
    assert {r["query_id"] for r in found} == {3} and [r["id"] for r in found if r["rank"] == 1] == [3]
    none = spark.createDataFrame([], SCHEMA)
    assert ann.AnnIndex.build(none).search(store, none).collect() == []
