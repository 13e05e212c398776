"""The chunkers against plain versions, and their edges."""

import json

import numpy as np
import pytest
from conftest import SMALL
from pyspark.sql import functions as F

from tarnwick.operators import answer as A
from tarnwick.operators import chunker as C
from tarnwick.operators import metrics as M
from tarnwick.operators import models, nearest
from tarnwick.operators import retrieval as R
from tarnwick.operators import segment as S
from tarnwick.operators import understand as U
from tarnwick.plans import retrieve as P
from tarnwick.plans import tables as T
from tarnwick.sources import collection


def spans(sentences, sims, least, most, percentile):
    """Chunks built sentence by sentence, merged and halved as lists of texts."""
    limit = float(np.percentile(sims, percentile))
    groups, now = [], []
    for i, s in enumerate(sentences):
        now.append(s)
        if i + 1 < len(sentences) and (sims[i] < limit or s["is_code"] != sentences[i + 1]["is_code"]):
            groups.append(now)
            now = []
    groups.append(now)
    merged = []
    for g in groups:
        if merged and len(" ".join(s["text"] for s in merged[-1])) < least and all(s["is_code"] for s in merged[-1]) == all(s["is_code"] for s in g):
            merged[-1] = merged[-1] + g
        else:
            merged.append(g)

    def cut(g):
        text = " ".join(s["text"] for s in g)
        if len(text) <= most or (len(g) == 1 and g[0]["is_code"]):
            return [text]
        if len(g) == 1:
            return [text[a : a + most] for a in range(0, len(text), most)]
        return cut(g[: len(g) // 2]) + cut(g[len(g) // 2 :])

    return [t.strip() for g in merged for t in cut(g) if t.strip()]


@pytest.mark.parametrize("seed", range(4))
def test_chunks_equal_the_plain_version(seed):
    rng = np.random.default_rng(seed)
    for _ in range(60):
        n = int(rng.integers(3, 30))
        sentences = [{"text": "s" * int(rng.choice([6, 20, 70, 300])), "is_code": bool(rng.random() < 0.2), "code_language": "py"} for _ in range(n)]
        vectors = C.unit(rng.normal(size=(n, 5)))
        sizes = C.Sizes(least=80, most=250)
        sims = [float(np.round(a @ b, 6)) for a, b in zip(*[C.unit(np.array([vectors[max(0, i - 1) : i + 2].mean(axis=0) for i in range(n)]))[k:][: n - 1] for k in (0, 1)], strict=True)]
        assert [c[0] for c in C.chunks_of(sentences, vectors, sizes)] == spans(sentences, sims, 80, 250, 85.0)


def test_code_is_kept_whole_and_apart(spark):
    code = "```python\nx = 1. Not a cut! Here\n" + "y = 2\n" * 400 + "```"
    text = "First sentence here. Second one follows. Third sentence is longer still.\n" + code + "\nAnd after. The end comes now. " * 3
    rows = C.semantic_chunks(spark.createDataFrame([(1, text), (2, "ab"), (3, None), (4, ""), (5, "Just one sentence.")], "id long, text string"), ["id"]).collect()
    mine = [r for r in rows if r["id"] == 1 and r["is_code"]]
    assert [(r["text"], r["code_language"]) for r in mine] == [(code, "python")]
    assert all("y = 2" not in r["text"] for r in rows if not r["is_code"])
    assert {r["id"] for r in rows} == {1, 5} and [r["text"] for r in rows if r["id"] == 5] == ["Just one sentence."]


def test_fallbacks(spark):
    def broken(texts):
        raise RuntimeError("no model")

    docs = spark.createDataFrame([(1, "One sentence here. Two sentences here. Three sentences here."), (2, "a. b")], "id long, text string")
    rows = {(r["id"], r["chunk_index"]): r for r in C.split_documents(docs, ["id"], embed=broken).collect()}
    assert rows[1, 0]["text"].startswith("One sentence") and rows[1, 0]["chunker"] == "semantic" and (1, 1) not in rows
    assert rows[2, 0]["text"] == "a. b" and rows[2, 0]["chunker"] == "recursive"


def test_long_sections_are_split_with_overlap(spark):
    text = "# One\n" + "\n\n".join(f"Paragraph {i} " + "has words here. More of them follow. " * 9 for i in range(30)) + "\n# Two\nshort\n# Three\nalso short"
    docs = spark.createDataFrame([("a/b.md", text)], "source string, text string")
    parents = C.parents(docs).orderBy("parent_index").collect()
    assert [p["parent_id"] for p in parents] == [f"a_b_parent_{i}" for i in range(len(parents))] and len(parents) > 3
    assert all(len(p["text"]) <= 2500 for p in parents) and all(f"Paragraph {i} " in "".join(p["text"] for p in parents) for i in range(30))
    want = S.recursive_pieces(S_first(text), 2500, 100, C.SECTION_SEPARATORS)
    assert [p["text"] for p in parents][: len(want)] == want
    kids = C.children(C.parents(docs)).collect()
    assert all(len(k["text"]) <= 400 for k in kids) and {k["parent_id"] for k in kids} == {p["parent_id"] for p in parents}


def S_first(text):
    return text[: text.index("# Two")].strip()


def test_hashed_embedder_equals_the_expression(spark):
    docs = T.load(spark, SMALL, "documents").where("n_chars < 800").limit(40).cache()
    long = {(r["id"], r["dim"]): r["w"] for r in R.hashed_terms(docs, "doc_id").collect()}
    rows = docs.select("doc_id", "text").collect()
    for r, vec in zip(rows, C.hashed_embedder([r["text"] for r in rows]), strict=True):
        assert np.allclose(vec, [long.get((r["doc_id"], d), 0.0) for d in range(64)])


def test_large_query_sets_meet_the_corpus_by_groups(spark):
    rng = np.random.default_rng(0)
    rows = [(i, C.unit(rng.normal(size=(1, 6)))[0].tolist()) for i in range(300)] + [(300, None)]
    corpus = spark.createDataFrame(rows, "id long, vec array<double>")
    asked = corpus.where("id % 3 = 0").select(F.col("id").alias("query_id"), "vec")
    few = {tuple(r) for r in R.vector_topk(corpus, asked, 7).collect()}
    many = {tuple(r) for r in R.vector_topk(corpus, asked, 7, most_queries=10, group_rows=40).collect()}
    assert few == many and len(few) == 700
    tied = np.array([[0.5, 0.5, 0.5, 0.1]])
    i, j = nearest.best(tied, np.array([9, 3, 4, 1]), 2)
    assert i.tolist() == [0, 0] and j.tolist() == [1, 2]


def test_history_gives_way_to_evidence(spark):
    asked = spark.createDataFrame([(1, "why?"), (2, "how?")], "query_id long, query string")
    contexts = spark.createDataFrame([(1, 0, "x" * 300), (1, 1, "second")], "query_id long, ctx_pos int, evidence string")
    history = spark.createDataFrame([(1, 0, "user", "old " * 40), (1, 1, "assistant", "newer"), (1, 2, "user", " "), (1, 3, "tool", "no")], "query_id long, turn long, role string, text string")
    got = {r["query_id"]: [tuple(m) for m in r["messages"]] for r in A.prompt_messages(asked, contexts, history, system="be brief", total=160, output=20, margin=10).collect()}
    assert got[1] == [("system", "be brief"), ("assistant", "newer"), ("user", A.BEFORE_EVIDENCE + "x" * 300 + A.BETWEEN + "second" + A.BEFORE_QUESTION + "why?")]
    assert [m[0] for m in got[2]] == ["system", "user"]
    none = A.prompt_messages(asked, contexts, history, total=50, output=20, margin=10).collect()
    assert all(len(r["messages"]) == 2 and r["history_budget"] < 0 for r in none)
    told = A.generate(A.prompt_messages(asked, contexts), lambda ps: [json.loads(p)[-1]["content"][-4:] for p in ps], wait=0).collect()
    assert {r["query_id"]: r["answer"] for r in told} == {1: "why?", 2: "how?"}


def test_flushes_reset_their_count(spark):
    deltas = spark.createDataFrame([(["abc", "defgh", "ij", "k" * 12, "xyz"],), ([],)], "d array<string>")
    got = [r["f"] for r in deltas.select(A.flush_points(F.col("d")).alias("f")).collect()]
    assert got == [["abcdefghij", "k" * 12, "xyz"], []]


def test_reasoning_only_replies_are_asked_again(spark):
    chunks = spark.createDataFrame([("c1", "s", "text one", False), ("c2", "s", "text two", None), ("c3", "s", "code", True)], "chunk_id string, source string, text string, is_code boolean")
    asked = []

    def model(prompts):
        asked.extend(prompts)
        follow = '{"triples": [{"head": "a", "relation": "r", "tail": "b"}]}'
        return [follow if models.FOLLOW in p else json.dumps({"content": "", "reasoning": "thinking"}) if p == "text one" else '[{"h": "c", "rel": "r", "t": "d"}]' for p in prompts]

    got = {(r["chunk_id"], r["head"], r["tail"]) for r in models.extract_triples(chunks, model, wait=0).collect()}
    assert got == {("c1", "a", "b"), ("c2", "c", "d")}


def test_alignment_reads_reasoning_and_maps(spark):
    queries = spark.createDataFrame([(1, "什么是 RAG"), (2, "向量库 what"), (3, "分块 chunking")], "query_id long, query string")
    body = {"confidence": 0.9, "expansions": {"RAG": ["retrieval augmented"], "x": "generation"}}
    replies = {"什么是 RAG": json.dumps(body), "向量库 what": json.dumps({"content": "", "reasoning": "so: " + json.dumps(body)}), "分块 chunking": json.dumps({"content": "", "reasoning": "no idea"})}
    got = {r["query_id"]: r["alignment"] for r in models.align(queries, lambda ps: [replies[p] for p in ps], wait=0).collect()}
    assert got[1]["expansions"] == ["retrieval augmented", "generation"] and got[1]["search_query"].endswith("retrieval augmented generation")
    assert got[2]["should_expand"] and got[3]["fallback_reason"] == "reasoning_only_no_json" and got[3]["detected_terms"]
    shown = queries.select(U.align_prompt(F.col("query")).alias("p")).first()["p"]
    assert "什么是 RAG" in shown and '"canonical":"RAG"' in shown
    assert set(json.loads(spark.createDataFrame([tuple(got[1])], models_schema(got[1])).select(F.to_json(F.struct("*")).alias("j")).first()["j"])) >= {"original_query", "search_query", "detected_terms", "language"}


def models_schema(row):
    return "original_query string, search_query string, should_expand boolean, confidence double, reason string, fallback_reason string, detected_terms array<struct<canonical:string,aliases:array<string>>>, expansions array<string>, language string"


def test_collections(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        collection.open_table(spark, str(tmp_path / "t"))
    schema = "head string, relation string, tail string, source string, chunk_id string"
    assert collection.open_table(spark, str(tmp_path / "t"), schema).count() == 0
    new = spark.createDataFrame([("A", "r", "b", "s", "c"), ("a ", "R", "B", "s", "c"), ("x", "r", "y", "s", "c")], schema)
    merged, added = collection.append_triples(collection.open_table(spark, str(tmp_path / "t")), new)
    collection.save(merged, str(tmp_path / "t"))
    assert added == 2 and collection.open_table(spark, str(tmp_path / "t")).count() == 2
    again, more = collection.append_triples(collection.open_table(spark, str(tmp_path / "t")), new)
    assert more == 0 and again.count() == 2
    (tmp_path / "cases.json").write_text('[{"query": "q1", "expected_keywords": ["a", "b"]}, {"query": "q2", "category": "c"}]')
    cases = collection.read_cases(spark, str(tmp_path / "cases.json")).orderBy("case_id").collect()
    assert [(c["case_id"], c["query"], c["expected_keywords"], c["category"]) for c in cases] == [(0, "q1", ["a", "b"], None), (1, "q2", None, "c")]
    (tmp_path / "broken.json").write_text("[{")
    assert collection.read_triples(spark, str(tmp_path / "broken.json")).count() == 0
    assert collection.read_triples(spark, str(tmp_path / "missing.json")).count() == 0
    assert len(collection.report_path("r", "ablation")) == len("r/ablation_20240101_000000")


def test_cache_of_scores_forgets_the_oldest(spark):
    cache = spark.createDataFrame([("q", 1, 0.5, 1), ("q", 2, 0.6, 2)], "query string, id long, logit double, used long")
    scored = spark.createDataFrame([("q", 1, 0.5), ("p", 3, 0.1)], "query string, id long, logit double")
    got = models.remember(cache, scored, at=3, most=2).collect()
    assert {(r["query"], r["id"], r["used"]) for r in got} == {("q", 1, 3), ("p", 3, 3)}


def test_global_contexts_without_graph_and_with_summary(spark):
    texts = spark.createDataFrame([("c1", "text", "src")], "chunk_id string, text string, source string")
    assert [r["id"] for r in P.global_contexts(spark, None, texts).collect()] == ["global_fallback"]
    triples = spark.createDataFrame([(1, "a", "r", "b", "s", "c1")], "seq long, head string, relation string, tail string, source string, chunk_id string")
    assert [r["id"] for r in P.global_contexts(spark, triples, texts).orderBy(F.desc("score")).collect()] == ["global_kg_macro", "c1"]
    done = P.global_contexts(spark, triples, texts, summarise=lambda ts: ["sum of " + str(len(ts))], wait=0).collect()
    assert [(r["id"], r["text"]) for r in done] == [("global_summary", "sum of 1")]
    assert P.global_contexts(spark, triples, texts, summarise=lambda ts: [""] * len(ts), wait=0).count() == 2


def test_queries_without_parents_get_children(spark):
    base = spark.createDataFrame([(1, 10, 0.9, 1), (2, 11, 0.8, 1)], "query_id long, id long, score double, rank int")
    parents = spark.createDataFrame([(1,)], "query_id long")
    notes = spark.createDataFrame([(11, "n", 3, "t")], "id long, source string, chunk_index int, text string")
    got = P.children_instead(base, parents, notes).collect()
    assert [(r["query_id"], r["id"], r["kind"], r["chunk_index"]) for r in got] == [(2, "11", "child", 3)]


def test_timer_and_empty_summary(spark):
    with M.Timer() as t:
        pass
    assert 0 <= t.elapsed_ms < 50
    empty = spark.createDataFrame([], ", ".join(f"{s}_ms double" for s in M.STAGES))
    assert set(M.summary(empty).first().asDict().values()) == {0}
