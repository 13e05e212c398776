"""Whole results and bounded work of the retrieval channels."""

import pyarrow as pa
from conftest import SMALL

from tarnwick import registry
from tarnwick.operators import chunker as C
from tarnwick.operators import retrieval as R
from tarnwick.operators import segment as S
from tarnwick.plans import retrieve as P
from tarnwick.sources.keyword_index import KeywordIndex
from tarnwick.sources.versions import Versions


def test_keyword_statistics_have_a_row_for_every_term(spark):
    got = registry.QUERIES["bm25_stats"](spark, SMALL)
    assert got.columns == ["t", "df", "idf"]
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    assert got.count() == R.postings(docs).select("t").distinct().count()


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def rows(df):
    return sorted((r["query_id"], r["id"], round(r["score"], 5)) for r in df.collect())


def test_keyword_scores_add_up_in_the_tasks_that_hold_the_documents(spark):
    docs = spark.createDataFrame([(1, "a b b c"), (2, "a"), (3, "x y"), (4, ""), (5, None), (6, "c c a d"), (7, "b")], "doc_id long, text string")
    asked = spark.createDataFrame([(10, "a b a zz"), (11, "c d"), (12, "nothing"), (13, None)], "query_id long, query string")
    for k in (None, 2):
        near, joined = (R.bm25_of_words(R.word_table(docs), asked, k, most_asked=m) for m in (R.ASKED, 0))
        assert "Exchange" not in plan(near)
        assert rows(R.bm25_topk(near, 2)) == rows(R.bm25_topk(joined, 2))
    assert "Exchange" not in plan(R.bm25(docs, asked))
    assert rows(R.bm25(docs, asked)) == rows(R.bm25(docs, asked, most_asked=0))


def test_a_task_holds_only_its_best_rows(spark):
    docs = spark.createDataFrame([(i, "a " * (i % 7 + 1) + "b") for i in range(500)], "doc_id long, text string").coalesce(1)
    asked = spark.createDataFrame([(1, "a"), (2, "b")], "query_id long, query string")
    words = R.word_table(docs)
    assert R.bm25_of_words(words, asked, 3).count() <= 6
    assert rows(R.bm25_topk(R.bm25_of_words(words, asked, 3), 3)) == rows(R.bm25_topk(R.bm25(docs, asked), 3))


def test_word_lists_are_counted_in_bounded_parts():
    batch = pa.RecordBatch.from_arrays([pa.array(range(5)), pa.array([["a"] * 4, None, ["b", "a", "b"], [], ["c"] * 9])], names=["id", "w"])
    parts = list(R.slices(iter([batch]), "w", 5))
    assert [p.num_rows for p in parts] == [2, 2, 1]
    got = pa.Table.from_batches(list(R.counted_words(iter(parts)))).to_pylist()
    assert [(r["id"], r["dl"], r["ts"], r["tfs"]) for r in got] == [(0, 4, ["a"], [4]), (1, None, None, None), (2, 3, ["b", "a"], [2, 1]), (3, 0, [], []), (4, 9, ["c"], [9])]


def test_a_channel_is_searched_once_however_often_it_is_read(spark):
    table = P.words(spark, SMALL)
    for channel in (P.keyword_channel(spark, SMALL, table=table), P.vector_channel(spark, SMALL, table=table)):
        assert "InArrow" not in plan(channel) and "Exchange" not in plan(channel)
    base = P.hybrid(spark, SMALL)
    assert "Exchange" not in plan(base)
    # The parents' texts are picked by broadcast, not shuffled.
    assert plan(base.join(P.T.notes(spark, SMALL), "id")).count("BroadcastHashJoin") == 1


def test_sentences_of_a_text_are_compared_and_joined_without_a_shuffle(spark):
    text = "Alpha beta gamma. Beta gamma delta! Gamma delta?\n\n```py\nx = 1\n```\nSome more words here. And yet others follow. Alpha beta gamma. "
    docs = spark.createDataFrame([(1, text * 3), (2, ""), (3, None), (4, "Only one sentence here."), (5, "A first one here. And a second one.")], "doc_id long, text string")
    sims, chunks = C.sentence_sims(docs), C.sentence_chunks(docs)
    assert "Exchange" not in plan(sims) and "Exchange" not in plan(chunks)
    cut = {(r["doc"], r["pos"]) for r in S.breakpoints(sims).collect()}
    sentences, want = {}, {}
    for r in sorted(S.split_code_aware(docs).collect()):
        before = sentences.get(r["doc"])
        new = before is None or (r["doc"], r["pos"] - 1) in cut or before["is_code"] != r["is_code"]
        want.setdefault(r["doc"], []).append([]) if new else None
        want[r["doc"]][-1].append(r["sentence"])
        sentences[r["doc"]] = r
    got = {}
    for r in sorted(chunks.collect()):
        assert r["chunk"] == len(got.setdefault(r["doc"], []))
        got[r["doc"]].append(r["text"])
    assert got == {doc: [" ".join(c) for c in found] for doc, found in want.items()} and len(got) == 3


def test_a_batch_without_repeated_ids_moves_its_words_once(spark, tmp_path, monkeypatch):
    index, moved, write = KeywordIndex(spark, str(tmp_path / "index"), buckets=4, block=8), [], Versions.write

    def seen(self, df, table, version, *by):
        if table == "docs":
            moved.append(plan(df))
        write(self, df, table, version, *by)

    monkeypatch.setattr(Versions, "write", seen)
    index.upsert(spark.createDataFrame([(1, "a b"), (2, "b c")], "doc_id long, text string"), 0)
    index.upsert(spark.createDataFrame([(3, "a"), (3, "a b"), (4, None)], "doc_id long, text string"), 1)
    assert [(p.split("Initial Plan")[-1].count("Exchange"), "Window" in p) for p in moved] == [(1, False), (1, True)]
    assert sorted((r["id"], r["dl"]) for r in index.documents().collect()) == [(1, 2), (2, 2), (3, 2), (4, 0)]
