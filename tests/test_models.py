from pyspark.sql import functions as F

from tarnwick.operators import match, models
from tarnwick.operators import retrieval as R


def test_triples_from_replies(spark):
    chunks = spark.createDataFrame(
        [("c1", "a.md", "list", False), ("c2", "a.md", "object", None), ("c3", "a.md", "code", True), ("c4", "a.md", "boom", False), ("c5", "a.md", "junk", False), ("c6", "a.md", None, False)],
        "chunk_id string, source string, text string, is_code boolean",
    )

    def model(prompts):
        if "boom" in prompts:
            raise RuntimeError("boom")
        known = {"list": '[{"head": "A", "relation": "is  a", "tail": "B"}, {"h": "a", "rel": "is a", "t": "b"}, {"head": ""}]', "object": '```json\n{"triples": [{"entity1": "X", "predicate": "has", "entity2": 3}]}\n```', "code": '[{"head": "no", "relation": "no", "tail": "no"}]'}
        return [known.get(p, "nothing here") for p in prompts]

    got = models.extract_triples(chunks, model, wait=0).orderBy("chunk_id").collect()
    assert [(r["chunk_id"], r["head"], r["relation"], r["tail"]) for r in got] == [("c1", "A", "is a", "B"), ("c2", "X", "has", "3")]
    assert models.extract_triples(chunks.limit(0), model).count() == 0


def test_ask_keeps_rows_and_errors(spark):
    rows = spark.createDataFrame([(1, "x", "old"), (2, None, "old"), (3, "bad", "old")], "id long, p string, reply string")

    def model(prompts):
        if "bad" in prompts:
            raise ValueError("no")
        return [p.upper() for p in prompts]

    got = {r["id"]: (r["reply"], r["error"]) for r in models.ask(rows, F.col("p"), model, 0).collect()}
    assert got == {1: ("X", None), 2: (None, None), 3: (None, "no")}


def test_judge(spark):
    cases = spark.createDataFrame([("good", ["c"], "a"), ("bad", ["c"], None)], "query string, contexts array<string>, answer string")
    model = lambda ps: ['{"retrieval_relevance": 4, "faithfulness": 5, "completeness": 3, "reason": "ok"}' if "query: good" in p else "?" for p in ps]
    got = {r["query"]: r for r in models.judge(cases, model, 0).collect()}
    assert (got["good"]["retrieval_relevance"], got["good"]["faithfulness"], got["good"]["reason"]) == (4, 5, "ok")
    assert got["bad"]["completeness"] is None and got["bad"]["reason"] == "failed: no JSON"


def test_align(spark):
    queries = spark.createDataFrame([(1, "什么是 RAG"), (2, "ab"), (3, "向量库 what"), (4, "知识图谱 kg"), (5, "分块 chunking")], "query_id long, query string")
    replies = {"什么是 RAG": '{"should_expand": true, "confidence": 0.9, "expansions": ["retrieval augmented"]}', "向量库 what": '{"should_expand": true, "confidence": 0.2, "expansions": ["x"]}', "知识图谱 kg": "no json", "分块 chunking": ""}
    got = {r["query_id"]: (r["triggered"], r["fallback_reason"], r["search_query"]) for r in models.align(queries, lambda ps: [replies[p] for p in ps], wait=0).collect()}
    assert got[1] == (True, None, "什么是 RAG retrieval augmented")
    assert got[2][:2] == (False, "too_short") and got[3][1] == "low_confidence" and got[4][1] == "invalid_payload" and got[5][1] == "empty_response"
    assert got[3][2] == "向量库 what"


def test_rewrite(spark):
    asked = spark.createDataFrame([(1, "and then?"), (2, "alone")], "conv_id long, query string")
    history = spark.createDataFrame([(1, 0, "user", "hello"), (1, 1, "assistant", "hi")], "conv_id long, turn long, role string, text string")
    got = {r["conv_id"]: r["rewritten"] for r in models.rewrite(asked, history, lambda ps: ["重写：what follows " + p.split("\n")[0] for p in ps], 0).collect()}
    assert got == {1: "what follows user: hello", 2: "alone"}


def test_embed_and_rerank(spark):
    rows = spark.createDataFrame([(1, "abc"), (2, " "), (3, None)], "id long, text string")
    got = {r["id"]: r["vec"] for r in models.embed(rows, "text", lambda ts: [[len(t), 1] for t in ts]).collect()}
    assert got == {1: [3.0, 1.0], 2: [1.0, 1.0], 3: [1.0, 1.0]}
    cand = spark.createDataFrame([(1, i, i, "q", "t" * i) for i in range(1, 5)], "query_id long, id long, rank int, query string, text string")
    best = models.rerank(cand, lambda ps: [float(len(t)) for _, t in ps]).orderBy("rank").collect()
    assert [r["id"] for r in best] == [3, 2, 1]
    cache = spark.createDataFrame([("q", 1, 9.0)], "query string, id long, logit double")
    assert models.rerank(cand, lambda ps: [float(len(t)) for _, t in ps], cache=cache).orderBy("rank").first()["id"] == 1


def test_merge_candidates(spark):
    rows = [("vector", 1, 1, 1, 0.9, "v", {"a": "1"}), ("bm25", 1, 1, 2, 3.0, "b", {"a": "2", "b": "3"}), ("bm25", 1, 2, 1, 2.0, "c", None)]
    df = spark.createDataFrame(rows, "channel string, query_id long, id long, rank int, score double, text string, metadata map<string,string>")
    got = {r["id"]: r for r in R.merge_candidates(df, {"vector": 0.45, "bm25": 0.35}).collect()}
    assert got[1]["text"] == "b" and got[1]["channels"] == ["bm25", "vector"] and got[1]["channel_scores"] == {"bm25": 3.0, "vector": 0.9}
    assert got[1]["metadata"] == {"a": "2", "b": "3"} and got[1]["channel_metadata"]["vector"] == {"a": "1"} and got[2]["metadata"] == {}


def test_substring_matches(spark):
    q = spark.createDataFrame([(1, "Tell me about  New York"), (2, "york"), (3, ""), (4, None), (5, "x")], "query_id long, query string")
    e = spark.createDataFrame([("new york",), ("York",), ("x",), ("xy",), ("",), (None,)], "entity string")
    got = sorted((r["query_id"], r["entity"]) for r in match.substring_matches(q, e).collect())
    assert got == [(1, "York"), (1, "new york"), (2, "York"), (2, "new york"), (5, "xy")]
    assert match.substring_matches(q, e.limit(0)).count() == 0 and match.substring_matches(q.limit(0), e).count() == 0


def test_streamed_answers(spark):
    from tarnwick.operators import answer

    def deltas(prompt):
        yield from prompt.split("|")
        if prompt.startswith("bad"):
            raise OSError("cut off")

    asked = spark.createDataFrame([(1, "one| two| three four|five|"), (2, "bad| start of it|and|"), (3, None), (4, ""), (5, "bad")], "query_id long, prompt string")
    got = {}
    for r in answer.stream_answers(asked, "prompt", deltas).orderBy("query_id", "seq").collect():
        got.setdefault(r["query_id"], []).append((r["seq"], r["shown"], r["error"]))
    assert got[1] == [(1, "one two three four", None), (2, "one two three fourfive", None)]
    assert got[2] == [(1, "bad start of it", None), (2, "bad start of itand", "cut off")] and got[5] == [(1, "bad", "cut off")] and set(got) == {1, 2, 5}
    pieces = spark.createDataFrame([(["one", " two", " three four", "five", ""],)], "d array<string>").select(answer.flush_points(F.col("d")).alias("p")).first()["p"]
    assert ["".join(pieces[: i + 1]) for i in range(len(pieces))] == [shown for _, shown, _ in got[1]]


def test_prompt_variants_are_paced(spark):
    import time

    chunks = spark.createDataFrame([(i, f"text {i}") for i in range(6)] + [(9, None)], "chunk_id long, text string").coalesce(1)
    made = {"a": lambda t: F.concat(F.lit("A "), t), "b": lambda t: t}
    began = time.time()
    got = models.compare_prompts(chunks, lambda ps: ['[{"head": "h"}]' if p.startswith("A") else "" for p in ps], made, per_second=20, wait=0)
    rows = models.prompt_summary(got, "chunk_id", 2).collect()
    assert time.time() - began > 0.5
    assert {(r["variant"], r["outcome"]): (r["n"], r["examples"]) for r in rows} == {("a", "success"): (6, []), ("a", "empty_content"): (1, [9]), ("b", "empty_content"): (7, [0, 1])}
