"""Whole requests: branches by row, what a missing or failing model means, traces."""

import json

import pytest
from conftest import SMALL
from pyspark.sql import functions as F

from tarnwick.operators import retrieval as R
from tarnwick.plans import request as RQ
from tarnwick.plans import tables as T


@pytest.fixture(scope="module")
def asked(spark):
    return T.questions(spark, SMALL).where("query_id < 3").select("query_id", F.concat("query", F.lit(" 检索 rag")).alias("query")).unionByName(spark.createDataFrame([(7, ""), (8, None)], "query_id long, query string"))


def test_without_models_all_is_local(spark, asked):
    u = RQ.understood(asked, None, RQ.Plugins())
    rows = {r["query_id"]: r for r in u.collect()}
    assert len(rows) == 5 and all(r["route"] == "local" and r["rewritten"] == r["query"] == r["aligned"] and not r["align_triggered"] for r in rows.values())
    t = RQ.traced(u, RQ.contexts(spark, SMALL, u, use_kg=False)).collect()
    assert len(t) == 5
    for r in t:
        kinds = [c["kind"] for c in r["contexts"] or []]
        assert "global" not in kinds and r["trace"]["route_decision"] == "local" and not r["trace"]["rewrite_triggered"]
        if r["query_id"] < 3:
            assert kinds[0] in ("seed", "neighbor") and r["trace"]["rerank_active"] and [c["ctx_pos"] for c in r["contexts"]] == list(range(1, len(kinds) + 1)) and "subgraph" not in kinds


def test_failing_models_fall_back(spark, asked):
    def fails(_):
        raise OSError("no model")

    history = spark.createDataFrame([(0, 0, "user", "hello"), (0, 1, "assistant", "yes")], "conv_id long, turn long, role string, text string")
    u = {r["query_id"]: r for r in RQ.understood(asked, history, RQ.Plugins(fails, fails, None, 0)).collect()}
    assert all(r["rewritten"] == r["query"] and not r["align_triggered"] for r in u.values())
    assert json.loads(u[0]["alignment"])["fallback_reason"] == "llm_error" and json.loads(u[7]["alignment"])["fallback_reason"] == "empty_query"


def test_both_routes_in_one_plan(spark, asked):
    vectors = R.dense(R.hashed_terms(asked, "query_id", "query"))
    prototypes = vectors.where("id = 1").select(F.lit("global").alias("intent"), "vec").unionByName(vectors.where("id = 2").select(F.lit("local").alias("intent"), "vec"))
    calls = spark.sparkContext.accumulator(0)

    def aligner(prompts):
        calls.add(len(prompts))
        return [json.dumps({"confidence": 0.9, "expansions": ["finding"]}) for _ in prompts]

    u = RQ.understood(asked, None, RQ.Plugins(None, aligner, prototypes, 0))
    rows = RQ.contexts(spark, SMALL, u, mode="bm25", use_parents=True)
    t = {r["query_id"]: r for r in RQ.traced(u, rows, "bm25", use_parents=True, times={"align_ms": 3.5}).collect()}
    assert calls.value == 3
    one, two = t[1], t[2]
    assert one["trace"]["route_decision"] == "global" and two["trace"]["route_decision"] == "local"
    assert [c["kind"] for c in one["contexts"]][0] == "global" and one["contexts"][0]["id"] == "global_kg_macro"
    assert all(c["kind"] != "global" for c in two["contexts"]) and two["trace"]["parent_child_active"] and two["trace"]["parent_child_unique_parents"] > 0
    assert two["trace"]["align_triggered"] and two["trace"]["aligned_query"].endswith("finding") and two["trace"]["align_ms"] == 3.5 and two["trace"]["mode"] == "bm25"
    assert all(c["text"] for c in two["contexts"]) and {c["kind"] for c in two["contexts"]} <= {"parent", "child", "subgraph"}
    assert json.loads(str(one["trace"]["route_info"].toJson()))["best"] == "global"
