"""A folder of notes: files added, changed, repeated, unreadable and gone; batches that break off; both indexes."""

import json

import pytest
from pyspark.sql import functions as F

from tarnwick.operators import retrieval as R
from tarnwick.sources import note_index
from tarnwick.sources.note_index import NoteIndex


def note(path, name, *words):
    file = path / name
    file.parent.mkdir(parents=True, exist_ok=True)
    file.write_text(f"# {name}\n\n" + "\n\n".join(f"About {w} there is much to say, and {w} is not all. Another line tells of {w} again." for w in words))


def held(index):
    return {(r["source"], r["chunk_index"]): r["text"] for r in index.chunks().collect()}


def consistent(spark, index):
    """Both indexes hold just the chunks that are there."""
    keys = {r["key"] for r in index.chunks().collect()}
    assert {r["id"] for r in index.keywords().documents().collect()} == keys
    docs = index.chunks().select(F.col("key").alias("doc_id"), "text")
    asked = spark.createDataFrame([(1, "about kestrel and heron"), (2, "otter")], "query_id long, query string")
    want = sorted(map(tuple, R.bm25_topk(R.bm25(docs, asked)).select("query_id", "id", "score").collect()))
    assert sorted(map(tuple, index.keywords().topk(asked).select("query_id", "id", "score").collect())) == want
    vectors = R.dense(R.hashed_terms(docs, "doc_id"))
    q = R.dense(R.hashed_terms(asked, "query_id", "query")).select(F.col("id").alias("query_id"), "vec")
    best = lambda df: sorted((r["query_id"], r["id"], r["score"]) for r in df.collect())
    assert best(index.vectors().topk(q, 3, exact=True)) == best(R.vector_topk(vectors, q, 3))
    return index.search(asked)


def test_a_growing_folder(spark, tmp_path):
    notes, extract = tmp_path / "notes", lambda ps: [json.dumps([{"head": p.split()[1], "relation": "in", "tail": "note"}]) for p in ps]
    index = NoteIndex(spark, str(tmp_path / "index"), extract, 0, buckets=4)
    note(notes, "a.md", "kestrel")
    note(notes, "sub/b.md", "heron", "otter")
    (notes / "bad.md").write_bytes(b"\xff\xfe broken \x80")
    (notes / "empty.md").write_text("")
    told = index.refresh(str(notes))
    assert told == {"added": 2, "changed": 0, "unreadable": 1, "dropped": 0, "unchanged": 0}
    files = {r["path"]: r for r in index.files().collect()}
    assert set(files) == {"a.md", "sub/b.md", "bad.md"} and files["bad.md"]["error"] == "not UTF-8" and files["bad.md"]["n_chunks"] == 0
    assert {r["chunk_id"] for r in index.chunks().where("chunk_index = 0").collect()} == {"a_0", "sub_b_0"}
    assert index.triples().count() == index.chunks().where("not is_code").count() > 0
    top = index.search(spark.createDataFrame([(2, "otter")], "query_id long, query string")).where("rank = 1").collect()
    assert [r["source"] for r in top] == ["sub/b.md"]
    assert index.refresh(str(notes)) == {"added": 0, "changed": 0, "unreadable": 0, "dropped": 0, "unchanged": 3}
    assert list(index.store.commits()) == [0]
    note(notes, "sub/b.md", "otter")
    note(notes, "c.md", "kestrel", "heron")
    assert index.refresh(str(notes)) == {"added": 1, "changed": 1, "unreadable": 0, "dropped": 0, "unchanged": 2}
    assert not any("heron" in t for (s, _), t in held(index).items() if s == "sub/b.md")
    (notes / "a.md").unlink()
    assert index.refresh(str(notes))["dropped"] == 0 and ("a.md", 0) in held(index)
    assert index.refresh(str(notes), drop_missing=True)["dropped"] == 1
    assert {s for s, _ in held(index)} == {"sub/b.md", "c.md"}
    consistent(spark, index)


@pytest.mark.parametrize("where", ["vectors", "commit"])
def test_a_broken_batch(spark, tmp_path, monkeypatch, where):
    notes = tmp_path / "notes"
    note(notes, "a.md", "kestrel", "otter")
    index = NoteIndex(spark, str(tmp_path / "index"), buckets=2)
    index.refresh(str(notes))
    before = held(index)
    note(notes, "a.md", "heron")
    note(notes, "b.md", "otter")

    def broken(*_, **__):
        raise OSError("lost")

    with monkeypatch.context() as m:
        m.setattr(*((index.store, "commit") if where == "commit" else (note_index.VectorIndex, "upsert")), broken)
        with pytest.raises(OSError, match="lost"):
            index.refresh(str(notes))
    assert held(index) == before
    note(notes, "c.md", "kestrel")
    assert index.refresh(str(notes)) == {"added": 2, "changed": 1, "unreadable": 0, "dropped": 0, "unchanged": 2}
    assert {s for s, _ in held(index)} == {"a.md", "b.md", "c.md"} and sorted(index.store.commits()) == [0, 1, 2]
    consistent(spark, index)


def test_a_stream_of_files(spark, tmp_path):
    """Files land in a table; the stream's batches are versions, and a repeated one changes nothing."""
    from tarnwick.streaming.metrics import index_stream

    kind = "path string, text string, md5 string, error string"
    land = lambda *rows: spark.createDataFrame([(p, t, str(hash(t)), None) for p, t in rows], kind).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    seen = []

    def take(batch, number):
        index = NoteIndex(batch.sparkSession, str(tmp_path / "index"), buckets=2)
        seen.append(index.take(batch, number)["added"])
        assert index.take(batch, number)["added"] == 0

    run = lambda: index_stream(spark.readStream.schema(kind).parquet(str(tmp_path / "in")), take, str(tmp_path / "check")).awaitTermination()
    land(("x.md", "The kestrel hovers over the field. It looks for a mouse. Then it drops."))
    run()
    land(("x.md", "The otter swims in the river. It looks for a fish. Then it dives."), ("y.md", "A heron stands still. It waits for long. Then it strikes."))
    run()
    run()
    index = NoteIndex(spark, str(tmp_path / "index"), buckets=2)
    assert seen == [1, 2] and {s for s, _ in held(index)} == {"x.md", "y.md"} and not any("kestrel" in t for t in held(index).values())
