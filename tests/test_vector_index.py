"""The stored vector index against all products: exact mode, recall, batches, odd rows."""

import math

import numpy as np
import pytest
from conftest import SMALL
from pyspark.sql import functions as F

from tarnwick.sources import vector_index
from tarnwick.sources.vector_index import VectorIndex


def plain(held, questions, k):
    out = []
    for qid, q in questions.items():
        scored = sorted((-round(2 * float(np.dot(q, v)) - 1, 6) + 0.0, i) for i, v in held.items())[:k]
        out += [(qid, i, -s + 0.0, r) for r, (s, i) in enumerate(scored, 1)]
    return sorted(out)


def rows(df):
    return sorted((r["query_id"], r["id"], r["score"] + 0.0, r["rank"]) for r in df.collect())


def table(spark, held, name="id"):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v]) for i, v in held.items()], f"{name} long, vec array<double>")


@pytest.mark.parametrize("most", [8192, 7])
def test_exact_mode_equals_all_products(spark, tmp_path, monkeypatch, most):
    monkeypatch.setattr(vector_index, "QUESTIONS", most)
    rng = np.random.default_rng(4)
    middles = rng.normal(size=(12, 6))
    held = {i: middles[i % 12] + rng.normal(size=6) * 0.2 * (1 + i % 5) for i in range(500)}
    held |= {1000 + i: held[3] for i in range(40)}
    odd = {2000: None, 2001: [1.0] * 5, 2002: [1.0, None, 1, 1, 1, 1], 2003: [math.nan] * 6, 2004: [math.inf] * 6, 2005: []}
    questions = {i: rng.normal(size=6) for i in range(20)}
    asked = table(spark, questions | {90: None, 91: [1.0], 92: [math.nan] * 6}, "query_id")
    index = VectorIndex(spark, str(tmp_path / "index"), dims=6, buckets=4)
    index.fit(table(spark, held), cells=9)
    assert index.topk(asked).count() == 0
    everything = table(spark, held | odd).unionByName(spark.createDataFrame([(None, [1.0] * 6)], "id long, vec array<double>"))
    assert index.upsert(everything, 0) and not index.upsert(everything, 0)
    assert rows(index.topk(asked, 7, probes=1, exact=True)) == plain(held, questions, 7)
    changed = {i: -held[i] for i in range(0, 90, 4)} | {700 + i: rng.normal(size=6) * 3 for i in range(15)}
    assert index.upsert(table(spark, changed | {11: None}), 1)
    held |= changed
    del held[11]
    assert index.remove(spark.createDataFrame([(i,) for i in (1, 2, 700, 4321)], "id long"), 2)
    for i in (1, 2, 700):
        del held[i]
    assert index.store.commits()[2]["n"] == len(held)
    for k in (1, 7, 2000):
        assert rows(index.topk(asked, k, probes=2, exact=True)) == plain(held, questions, k)
    assert rows(index.topk(asked, 7, probes=9)) == plain(held, questions, 7)


def test_every_row_is_indexed_and_recall(spark, tmp_path):
    e = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vec"))
    asked = e.where("id % 50 = 0").select(F.col("id").alias("query_id"), "vec")
    index = VectorIndex(spark, str(tmp_path / "index"))
    index.fit(e)
    index.upsert(e, 0)
    assert index.store.commits()[0]["n"] == e.count() == index.store.read("vectors", vector_index.VECTORS, [0]).count()
    near, exact = rows(index.topk(asked)), rows(index.topk(asked, exact=True))
    found = len({r[:2] for r in near} & {r[:2] for r in exact}) / len(exact)
    print("recall", found)
    assert found >= 0.9


def test_an_empty_index(spark, tmp_path):
    none = spark.createDataFrame([], "id long, vec array<double>")
    index = VectorIndex(spark, str(tmp_path / "index"), dims=3)
    with pytest.raises(FileNotFoundError, match="fit"):
        index.upsert(none, 0)
    index.fit(none)
    assert index.upsert(none, 0) and index.topk(spark.createDataFrame([(1, [1.0, 0.0, 0.0])], "query_id long, vec array<double>"), exact=True).count() == 0
    assert index.upsert(spark.createDataFrame([(5, [0.0, 1.0, 0.0])], "id long, vec array<double>"), 1)
    assert index.topk(spark.createDataFrame([(1, [1.0, 0.0, 0.0])], "query_id long, vec array<double>"), exact=True).count() == 1


def test_cells_are_left_out(spark, tmp_path):
    e = spark.read.parquet(f"{SMALL}/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vec"))
    index = VectorIndex(spark, str(tmp_path / "index"))
    index.fit(e, cells=12)
    index.upsert(e, 0)
    one = e.where("id = 50").select(F.col("id").alias("query_id"), "vec")
    plan = index.topk(one, 3, probes=1)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "cell" in plan
    top = index.topk(one, 1, probes=1).collect()
    assert [(r["id"], r["score"]) for r in top] == [(50, 1.0)]
