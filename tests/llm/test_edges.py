"""Nulls, clashing names, repeated rows, empty tables, very long texts, and inputs that must be refused."""

import hashlib
import json
from types import SimpleNamespace

import numpy as np
import pytest
from conftest import SMALL
from pyspark.sql import functions as F

from tarnwick.llm import bpe, bpe_codec, common, embed_dedup, langid, mixing, quality, shingles, syncmers, token_counts, toxicity, warc
from tarnwick.llm import queries as Q
from tarnwick.llm.common import fold, load

LONG = 5_000_000


@pytest.fixture(scope="module")
def long_text():
    rng = np.random.default_rng(11)
    stock = ["".join(rng.choice(list("abcdefghijklmnop"), rng.integers(2, 9))) for _ in range(3000)]
    return " ".join(rng.choice(stock, LONG // 6).tolist())


def test_long_texts(spark, long_text):
    docs = load(spark, SMALL, "documents")
    labels = load(spark, SMALL, "labels")
    table = spark.createDataFrame([(1, long_text), (2, "short one")], "doc_id long, text string")
    counted = {r["doc_id"]: r["n_tokens"] for r in token_counts.token_report(table, Q.tokenizer()).collect()}
    coded = {r["doc_id"]: r for r in bpe_codec.round_trip(table, Q.tokenizer()).collect()}
    assert counted[1] == coded[1]["n_tokens"] > LONG // 12
    assert coded[1]["decoded_sha256"] == hashlib.sha256(long_text.encode()).hexdigest()
    lang = langid.train(docs, F.lit(True))
    good = quality.train(docs, labels, F.lit(True))
    bad = toxicity.train(docs, labels, F.lit(True))
    for scored in (langid.predict(table, lang), quality.score(table, good), toxicity.score(table, bad), mixing.mix(table.withColumn("source", F.lit("s"))), syncmers.edit_test(table)):
        assert scored.count() > 0
    pages = spark.createDataFrame([(1, "u", long_text), (2, "u", long_text)], "page_id long, url string, html string")
    got = {r["page_id"]: r for r in warc.archive_and_read(pages).collect()}
    assert got[1]["payload_bytes"] == got[2]["payload_bytes"] == len(long_text) and got[1]["refers_to"] == 2
    assert got[1]["payload_digest"] == hashlib.sha1(long_text.encode()).hexdigest()


def test_long_texts_are_hashed_in_pieces(monkeypatch, long_text):
    texts = [long_text[:20_000], "x" * 700 + " " + "y" * 3, " \t" * 50, "a\vb  c\n" * 40, "é" * 300]
    whole = shingles.shingle_sets(texts)
    for piece in (16, 100, 4096):
        monkeypatch.setattr(shingles, "PIECE", piece)
        assert all(np.array_equal(a, b) for a, b in zip(whole, shingles.shingle_sets(texts), strict=True))


CLASHES = ["_lang_pred", "_lang_score", "_lang_accepted", "__lang_pred", "_quality_score", "label", "good", "id", "quality", "quality_score", "lang_pred", "lang_score", "lang_accepted", "mix_copy", "mix_u", "component", "component_id", "rep", "node", "features", "n_tokens", "token_ids", "digest"]


def test_pipeline_keeps_rows_and_columns(spark):
    import corpus_pipeline as P

    a, b = (" ".join(f"{c}{i}" for i in range(40)) for c in "ab")
    rows = [(1, a), (1, b), (1, b), (2, a + " end"), (4, None), (5, ""), (None, a), (None, b), (None, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    for c in CLASHES:
        docs = docs.withColumn(c, F.lit("own " + c))
    kept = P.keep_one_of_group(spark, docs, SMALL)
    assert kept.columns == docs.columns
    assert sorted([(r["doc_id"], r["text"]) for r in kept.collect()], key=str) == sorted([(1, a), (1, b), (4, None), (5, ""), (None, a), (None, b), (None, None)], key=str)
    whole = load(spark, SMALL, "documents").limit(0)
    for c in CLASHES:
        whole = whole.withColumn(c, F.lit("own " + c))
    part = load(spark, SMALL, "documents").where("n_chars < 900")
    for c in CLASHES:
        part = part.withColumn(c, F.lit("own " + c))
    part = part.unionByName(docs.select(*part.columns))
    for name, stage in P.STAGES[:-1]:
        assert stage(spark, whole, SMALL).count() == 0
        part = stage(spark, part, SMALL)
        assert part.columns == whole.columns and part.where(" or ".join(f"{c} <> 'own {c}'" for c in CLASHES)).count() == 0, name
        part = P.materialize(part, "edge")
    assert part.count() > 0 and P.encode_tokens(spark, part, SMALL).count() == part.count()
    assert P.encode_tokens(spark, whole, SMALL).count() == 0


def test_folds_of_null_ids_are_known(spark):
    row = spark.range(1).select((fold(F.lit(None).cast("long"), 3) == 1).alias("held_out")).first()
    assert row["held_out"] is False


def test_conflicting_labels_are_settled(spark):
    docs = spark.createDataFrame([(i, f"text number {i} " + "word " * 30) for i in range(60)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, q) for i in range(60) for q in ((1, 0) if i < 30 else (1, 1))], "doc_id long, quality int").withColumn("toxic", F.col("quality"))
    shuffled = labels.orderBy(F.rand(3))
    for train in (quality.train, toxicity.train):
        one, two = train(docs, labels, F.lit(True)), train(docs, shuffled, F.lit(True))
        assert np.array_equal(one.weight, two.weight)


def test_models_without_rows(spark):
    none = spark.createDataFrame([], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    some = spark.createDataFrame([(1, "some text", "en"), (None, None, None)], none.schema)
    for train, score in ((quality.train, quality.score), (toxicity.train, toxicity.score)):
        model = train(none, labels, F.lit(True))
        assert score(some, model).count() == 2 and score(none, model).count() == 0
    model = langid.train(none, F.lit(True))
    assert {r["lang_pred"] for r in langid.predict(some, model).collect()} == {"und"}


def test_fits_are_bounded_whatever_the_ids(spark, monkeypatch):
    """A hot id, and rows without one, bring no more rows to the fit than any others."""
    seen = []
    monkeypatch.setattr(quality, "fit", lambda p, u, prior: seen.append((len(p), len(u))) or SimpleNamespace())
    monkeypatch.setattr(quality, "class_prior", lambda p, u: 0.5)
    monkeypatch.setattr(quality, "calibrate", lambda *a: None)
    labels = spark.createDataFrame([(7, 1)], "doc_id long, quality int")
    for ident in (None, 7):
        docs = spark.range(3000).select(F.lit(ident).cast("long").alias("doc_id"), F.concat(F.lit("text "), F.repeat(F.lit("ab "), F.col("id").cast("int") % 700), F.col("id").cast("string")).alias("text"))
        quality.train(docs.unionByName(docs), labels, F.lit(True), max_labelled=50, max_unlabelled=60)
    assert all(u <= 66 for _, u in seen) and seen[0][0] == 0 and 0 < seen[1][0] <= 55 and min(u for _, u in seen) > 20
    docs = spark.range(4000).select(F.lit(None).cast("long").alias("doc_id"), F.concat(F.lit("text "), F.col("id").cast("string")).alias("text"), F.when(F.col("id") < 3900, "a").otherwise("b").alias("lang"))
    texts, langs = langid.sample(docs.unionByName(docs), "text", "lang", "doc_id", F.lit(True), 40, "s", 9, 1000)
    assert len(texts) == len(set(texts)) <= 160 and langs.count("b") > 10 < langs.count("a")


def test_hundreds_of_languages(spark):
    docs = spark.range(2 * 300).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), F.sha2((F.col("id") % 300).cast("string"), 256)).alias("text"), F.concat(F.lit("l"), (F.col("id") % 300).cast("string")).alias("lang"))
    model = langid.train(docs, F.lit(True))
    assert len(model.languages) == 300 and model.logits.nbytes <= 256 << 18
    assert langid.predict(docs, model).where("lang_pred like 'l%'").count() == 600


def test_equal_rows_are_dealt_out(spark):
    rows = spark.range(4000).select(F.lit(1).alias("doc_id"), F.lit("same").alias("text"), F.lit("s").alias("source"))
    mixed = mixing.mix(rows, size=3.0)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        sizes = [r["count"] for r in mixed.groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(sizes) > 4 and max(sizes) < 0.4 * sum(sizes) and sum(sizes) % 4000 == 0


def test_a_repeated_row_stays_once_whatever_the_order(spark):
    import corpus_pipeline as P

    rows = [(1, "some words", s) for s in "cabd"] * 3 + [(2, "other words", "x")]
    kept = [sorted(map(tuple, P.keep_one_of_group(spark, spark.createDataFrame(some, "doc_id long, text string, source string"), SMALL).collect())) for some in (rows, rows[::-1])]
    assert kept[0] == kept[1] == [(1, "some words", "a"), (2, "other words", "x")]


def test_too_many_languages_are_an_error(spark):
    docs = spark.createDataFrame([(i, f"text {i}", f"l{i}") for i in range(9)], "doc_id long, text string, lang string")
    with pytest.raises(ValueError, match="most_languages"):
        langid.train(docs, F.lit(True), most_languages=8)


def test_other_tokenizers_are_refused(tmp_path):
    with open(Q.tokenizer(), encoding="utf-8") as f:
        spec = json.load(f)
    for change in ({"normalizer": {"type": "NFC"}}, {"pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": True}}, {"model": spec["model"] | {"ignore_merges": True}}):
        path = tmp_path / "other.json"
        path.write_text(json.dumps(spec | change))
        with pytest.raises(ValueError, match="unsupported"):
            bpe.ByteBPE(str(path))


def test_large_ids_do_not_collide():
    left = np.array([1, 1 << 18, 5], np.int64)
    right = np.array([1 << 19, 3, 1 << 20], np.int64)
    table = bpe.PairTable(left, right, np.arange(3, dtype=np.int32))
    assert table(left, right).tolist() == [0, 1, 2] and table(right, left).tolist() == [bpe.NEVER] * 3


def test_tiny_and_huge_vectors_have_a_direction(spark):
    rows = [(1, [1e-200, 2e-200]), (2, [1e200, 2e200]), (3, [1.0, 2.0]), (4, [0.0, 0.0]), (5, [2.0, -1.0])]
    got = {r["vec_id"]: r for r in embed_dedup.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert [got[i]["n_links"] for i in (1, 2, 3, 4, 5)] == [2, 2, 2, 0, 0] and got[3]["component_id"] == 1


def test_blocks_of_vectors_meet_without_a_shuffle(spark, monkeypatch):
    rng = np.random.default_rng(8)
    base = rng.normal(size=(30, 20))
    rows = [(b + rng.normal(size=20) * 0.1).astype(np.float32).tolist() for b in base for _ in range(9)] + [base[0].tolist()] * 5
    table = spark.createDataFrame(list(enumerate(rows)), "vec_id long, embedding array<float>")
    plans, keep = {}, common.Scratch.keep

    def seen(self, df, name, n=None):
        plans[name] = df._jdf.queryExecution().executedPlan().toString()
        return keep(self, df, name, n)

    monkeypatch.setattr(common.Scratch, "keep", seen)
    monkeypatch.setattr(embed_dedup, "BLOCK", 16)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = {r["vec_id"]: r for r in embed_dedup.near_vectors(table, pivots=5).collect()}
        monkeypatch.setattr(embed_dedup, "BROADCAST", 0)
        assert {r["vec_id"]: r for r in embed_dedup.near_vectors(table, pivots=3).collect()} == got
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "CartesianProduct" in plans["vector-tiles"] and "Exchange" not in plans["vector-tiles"]
    x = np.array(rows, np.float32).astype(np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    link = x @ x.T >= 0.95
    np.fill_diagonal(link, False)
    root = np.arange(len(rows))
    for _ in rows:
        root = np.array([min([root[i], *root[link[i]]]) for i in range(len(rows))])
    assert [(got[i]["n_links"], got[i]["component_id"]) for i in range(len(rows))] == list(zip(link.sum(axis=1).tolist(), root.tolist(), strict=True))


def test_links_of_a_tile_are_united_as_they_come():
    rng = np.random.default_rng(2)
    x, y = rng.integers(0, 300, 260), rng.integers(0, 300, 260)
    root = np.arange(300)
    for a in range(0, 260, 20):
        root = embed_dedup._unite(root, x[a : a + 20], y[a : a + 20])
    want = list(range(300))
    for _ in range(300):
        for a, b in zip(x.tolist(), y.tolist(), strict=True):
            want[a] = want[b] = min(want[a], want[b])
    assert root.tolist() == want


def test_corrupt_archives_are_noticed(spark):
    pages = spark.createDataFrame([(1, "u", "x" * 2000), (2, "u", "x" * 2000)], "page_id long, url string, html string")
    plan = warc.plan(pages)
    wrong = warc.bundles(plan.withColumn("digest", F.sha1(F.lit("other"))))
    with pytest.raises(Exception, match="not that of its digest"):
        warc.read(wrong).collect()
    alone = warc.bundles(plan.where("page_id = 1"))
    with pytest.raises(Exception, match="no response for the revisit"):
        warc.resolve(warc.read(alone, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")).collect()


def test_a_cluster_needs_a_shared_folder():
    session = SimpleNamespace(conf=SimpleNamespace(get=lambda key, default=None: default), sparkContext=SimpleNamespace(master="spark://host:7077"))
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        common.shared_dir(session)


def test_dropped_tables_leave_no_files(spark, tmp_path):
    scratch = common.Scratch(spark)
    one, two = scratch.keep(spark.range(10).toDF("x"), "one"), scratch.keep(spark.range(10).toDF("x"), "two", 10)
    paths = [p.removeprefix("file://") for p in scratch.paths.values()]
    import os

    assert one.count() == two.count() == 10 and all(map(os.path.exists, paths))
    scratch.drop(one)
    assert not os.path.exists(paths[0]) and os.path.exists(paths[1])
    scratch.drop()
    assert not os.path.exists(paths[1])


def test_mixture_of_a_high_rate(spark):
    docs = spark.createDataFrame([(i, "rare" if i == 0 else "common") for i in range(200)], "doc_id long, source string")
    weights = spark.createDataFrame([("rare", 1.0), ("common", 0.0)], "source string, weight double")
    got = mixing.mix(docs, weights=weights, size=20.0)
    n = got.count()
    assert got.select("source").distinct().first()["source"] == "rare" and 3700 < n < 4300
    assert got.agg(F.max("mix_copy"), F.count_distinct("mix_copy")).first() == (n, n)
