"""The stored keyword index against BM25 over the texts, batch by batch; what a batch and a question read."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tarnwick.operators import retrieval as R
from tarnwick.sources import keyword_index as K
from tarnwick.sources.keyword_index import KeywordIndex
from tarnwick.sources.versions import Versions


@pytest.fixture(scope="module")
def world():
    rng = random.Random(17)
    words = [f"w{i}" for i in range(60)]
    often = [1 / (i + 1) for i in range(60)]
    text = lambda n: " ".join(rng.choices(words, often, k=n))
    return rng, text


def rows(df):
    return sorted(tuple(r) for r in df.select("query_id", "id", "score", "rank").collect())


def plain(spark, held, questions, k):
    docs = spark.createDataFrame(sorted(held.items()), "doc_id long, text string")
    return rows(R.bm25_topk(R.bm25(docs, questions), k))


def test_batches_equal_the_whole(spark, tmp_path, world):
    rng, text = world
    questions = spark.createDataFrame([(1, "w0 w1 w59"), (2, text(12)), (3, "w40 w41 w40"), (4, "unknown"), (5, ""), (6, None), (7, "w3")], "query_id long, query string")
    index = KeywordIndex(spark, str(tmp_path / "index"), buckets=4, block=8)
    assert rows(index.topk(questions, 5)) == [] and index.scores(questions).count() == 0
    held = {i: text(rng.randrange(1, 60)) for i in range(150)} | {900: None, 901: ""}
    assert index.upsert(spark.createDataFrame([*held.items(), (None, "w0 w0 w1")], "doc_id long, text string"), 0)
    assert rows(index.topk(questions, 5)) == plain(spark, held, questions, 5)
    changed = {i: text(rng.randrange(1, 80)) for i in [*range(0, 60, 3), *range(400, 420), 901]}
    assert index.upsert(spark.createDataFrame([*changed.items(), *[(5000, "w1"), (5000, "w1 w2")]], "doc_id long, text string"), 3)
    held |= changed | {5000: "w1 w2"}
    assert not index.upsert(spark.createDataFrame([(1, "w1")], "doc_id long, text string"), 3)
    assert index.remove(spark.createDataFrame([(i,) for i in (3, 6, 7, 400, 12345)], "doc_id long"), 4)
    for i in (3, 6, 7, 400):
        del held[i]
    back = {3: "w59 w59 w58", 8: ""}
    assert index.upsert(spark.createDataFrame(list(back.items()), "doc_id long, text string"), 5)
    held |= back
    for k in (5, 1000):
        assert rows(index.topk(questions, k)) == plain(spark, held, questions, k)
    docs = spark.createDataFrame(sorted(held.items()), "doc_id long, text string")
    whole, about = R.bm25_stats(docs)
    numbers = lambda df: sorted((r["t"], r["df"], round(r["idf"], 9)) for r in df.collect())
    assert numbers(index.statistics()) == numbers(whole)
    last = index.store.commits()[5]
    assert (last["n"], round(last["length"] / last["n"], 9), round(last["mean_idf"], 9)) == (about["n"], round(about["avgdl"], 9), round(about["mean_idf"], 9))
    assert sorted(tuple(r) for r in index.postings().collect()) == sorted(tuple(r) for r in R.postings(docs).select("t", "id", "tf", F.col("dl").cast("long")).collect())
    fresh = index.compacted(str(tmp_path / "fresh"))
    assert rows(fresh.topk(questions, 5)) == plain(spark, held, questions, 5) and list(fresh.store.commits()) == [0]


def test_a_broken_batch_stays_unseen(spark, tmp_path, world, monkeypatch):
    _, text = world
    index = KeywordIndex(spark, str(tmp_path / "index"), buckets=4, block=8)
    questions = spark.createDataFrame([(1, "w0 w1 w2")], "query_id long, query string")
    first = {i: text(20) for i in range(30)}
    index.upsert(spark.createDataFrame(list(first.items()), "doc_id long, text string"), 0)
    before = sorted(map(tuple, index.documents().collect()))
    second = {i: text(30) for i in range(10, 50)}
    batch = spark.createDataFrame(list(second.items()), "doc_id long, text string")
    with monkeypatch.context() as m:
        m.setattr(index.store, "commit", lambda *a, **k: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError, match="lost"):
            index.upsert(batch, 1)
    assert sorted(map(tuple, index.documents().collect())) == before
    assert index.upsert(batch, 1)
    assert rows(index.topk(questions)) == plain(spark, first | second, questions, 10)


def test_what_is_read(spark, tmp_path, world):
    rng, text = world
    index = KeywordIndex(spark, str(tmp_path / "index"), buckets=16, block=4)
    index.upsert(spark.createDataFrame([(i, text(rng.randrange(3, 90))) for i in range(800)], "doc_id long, text string"), 0)
    questions = spark.createDataFrame([(1, "w0 w59")], "query_id long, query string")
    top = index.topk(questions, 3)
    plan = top._jdf.queryExecution().optimizedPlan().toString() + top._jdf.queryExecution().executedPlan().toString()
    buckets = {r[0] for r in spark.range(1).select(F.explode(F.array(*[index._bucket(F.lit(t)) for t in ("w0", "w59")]))).collect()}
    scans = [line for line in plan.splitlines() if "FileScan" in line and "postings" in line or "PartitionFilters" in line and "bucket" in line]
    assert scans and all(str(b) in "".join(scans) for b in buckets)
    weights, blocks, about = index._asked(questions, 0.25)
    files = {f for f in blocks.inputFiles()}
    assert {int(f.split("bucket=")[1].split("/")[0]) for f in files} <= set(range(16))
    read = blocks.select(F.input_file_name().alias("f")).distinct().collect()
    assert {int(r["f"].split("bucket=")[1].split("/")[0]) for r in read} == buckets
    opened, _ = index.opened_blocks(weights, blocks, about, 3, 1.5, 0.75)
    essential, every = opened.where("essential").count(), blocks.join(weights, "t").count()
    assert 0 < essential < every / 10, (essential, every)
    touched = {b.split("bucket=")[1] for b in map(str, (tmp_path / "index" / "terms" / "version=0").glob("bucket=*"))}
    index.upsert(spark.createDataFrame([(1, "w7 w7")], "doc_id long, text string"), 1)
    later = {b.split("bucket=")[1] for b in map(str, (tmp_path / "index" / "postings" / "version=1").glob("bucket=*"))}
    assert len(later) == 1 < len(touched)


def test_many_questions_shuffle_no_postings(spark, tmp_path, world, monkeypatch):
    rng, text = world
    index, plans, write = KeywordIndex(spark, str(tmp_path / "index"), buckets=4, block=8), {}, Versions.write

    def seen(self, df, table, version, *by):
        plans[table] = df._jdf.queryExecution().executedPlan().toString()
        write(self, df, table, version, *by)

    monkeypatch.setattr(Versions, "write", seen)
    held = {i: text(rng.randrange(1, 60)) for i in range(120)} | {900: None, 901: ""}
    changed = {i: text(rng.randrange(1, 60)) for i in [*range(0, 40, 3), 500]}
    batch = lambda rows: spark.createDataFrame(list(rows.items()), "doc_id long, text string")
    split = spark.conf.get(K.SPLIT)
    index.upsert(batch(held), 0)
    assert "Exchange" not in plans["postings"] and spark.conf.get(K.SPLIT) == split
    monkeypatch.setattr(K, "BROADCAST", 0)
    index.upsert(batch(changed), 1)
    index.remove(spark.createDataFrame([(5,), (9,), (77777,)], "doc_id long"), 2)
    held = {i: t for i, t in (held | changed).items() if i not in (5, 9)}
    questions = spark.createDataFrame([(1, "w0 w1 w59"), (2, text(12)), (3, "w40 w41 w40"), (4, "unknown"), (5, ""), (6, None)], "query_id long, query string")
    few = rows(index.topk(questions, 7))
    monkeypatch.setattr(K, "PAIRS", 0)
    many = index.topk(questions, 7)
    assert rows(many) == few == plain(spark, held, questions, 7)
    plan = many._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
    assert "ids" not in "".join(line for line in plan.splitlines() if "Generate" in line)  # no row for each posting


def test_runs_are_bounded_and_cut_into_blocks(monkeypatch):
    monkeypatch.setattr(K, "RUN", 5)
    docs = pa.table({"part": pa.array([0, 0, 0, 1], pa.int32()), "id": [1, 2, 3, 4], "dl": [3, 9, 2, 1], "ts": [["a", "b"], ["a", "b", "c"], ["a"], ["b"]], "tfs": pa.array([[1, 2], [5, 3, 1], [2], [1]], pa.list_(pa.int32()))})
    runs = list(K._runs(iter(docs.to_batches())))
    assert [r.column("id").to_pylist() for r in runs] == [[1, 2, 3], [4]]
    blocks = [b for run in runs for part in K._blocks(run, 2, 7) for b in part.to_pylist()]
    assert sorted((b["t"], b["lead"], b["ids"], b["tfs"], b["max_tf"], b["min_dl"], b["run"]) for b in blocks) == [
        ("a", 1, [1], [1], 1, 3, 7), ("a", 2, [2, 3], [5, 2], 5, 2, 7), ("b", 2, [2, 1], [3, 2], 3, 3, 7), ("b", 4, [4], [1], 1, 1, 7), ("c", 2, [2], [1], 1, 9, 7),
    ]
