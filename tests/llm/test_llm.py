import hashlib
import math

import numpy as np
import pytest
from conftest import SMALL, same
from pyspark.sql import functions as F

from tarnwick.llm import bpe_codec, embed_dedup, jaccard, langid, mixing, quality, syncmers, token_counts, toxicity, warc
from tarnwick.llm import queries as Q
from tarnwick.llm.bpe import Codec, Counter
from tarnwick.llm.components import components
from tarnwick.llm.partenum import common_map, signatures
from tarnwick.llm.shingles import shingle_sets

ODD = ["", "a", "a" * 3001, " \n\t  ", "aaa aaaa  \n\n x <|endoftext|> y<|endoftext|>", "日本語 🎉🎉 don't WE'LL 12345", "ab" * 2000, "x  y   z"]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(Q.tokenizer())


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, ties, repeated rows and clashing extra columns."""
    rows = [(i, t, "en", "s", i) for i, t in enumerate(ODD)] + [(None, "null id here", None, None, 0), (50, None, None, "s", 0), (3, ODD[3], "en", "s", 3), (60, ODD[5], "de", None, 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_tokens long")


def texts_of(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


def test_tokens_equal_the_library(library, docs):
    texts = [t or "" for _, t in texts_of(docs)] + ODD
    want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    assert Counter(Q.tokenizer(), memo=50)(texts) == [len(i) for i in want]
    codec = Codec(Q.tokenizer(), memo=50)
    ids = codec.encode(texts)
    assert [np.frombuffer(i, "<u4").tolist() for i in ids] == want
    assert [codec.decode(i).decode() for i in ids] == [library.decode(i, skip_special_tokens=False) for i in want]


def test_seams_decide_like_merging():
    bpe = Codec(Q.tokenizer()).bpe
    rng = np.random.default_rng(0)
    a, b = rng.integers(0, 50256, 4000), rng.integers(0, 50256, 4000)
    counts, _ = bpe.merge([bpe.bytes_of[x] + bpe.bytes_of[y] for x, y in zip(a, b, strict=True)])
    exact = [bpe.merge([bpe.bytes_of[x] + bpe.bytes_of[y]])[1].tolist() == [x, y] for x, y in zip(a.tolist(), b.tolist(), strict=True)]
    sound = bpe.sound[a] & bpe.sound[b]
    assert (bpe.compatible(a, b)[sound] == np.array(exact)[sound]).all() and len(counts) == 4000


def test_op1_and_op8_rows(spark, library, odd):
    got = token_counts.token_report(odd, Q.tokenizer()).collect()
    assert len(got) == odd.count()
    want = sorted(len(library.encode(t or "", add_special_tokens=False).ids) for _, t in texts_of(odd))
    assert sorted(r["n_tokens"] for r in got) == want
    for r in bpe_codec.round_trip(odd, Q.tokenizer()).join(odd.select("doc_id", "text").distinct(), "doc_id").collect():
        ids = library.encode(r["text"] or "", add_special_tokens=False).ids
        assert r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256((r["text"] or "").encode()).hexdigest()
    empty = odd.limit(0)
    assert token_counts.token_report(empty, Q.tokenizer()).count() == 0
    assert token_counts.token_counts(odd, Q.tokenizer()).columns == ["doc_id", "text", "lang", "source", "n_tokens"]


def test_language(spark, docs, odd):
    done = Q.op2_language_id(spark, SMALL).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(done) > 20 and np.mean([r["lang"] == r["lang_pred"] for r in done]) > 0.9
    assert all(0 <= r["score"] <= 1 for r in done)
    model = langid.train(docs, F.lit(True))
    got = langid.predict(odd, model).collect()
    assert len(got) == odd.count()
    for r in got:
        if not r["text"] or not any(c.isalpha() for c in r["text"]):
            assert (r["lang_pred"], r["lang_accepted"]) == ("und", False)
    assert langid.predict(odd.limit(0), model).count() == 0
    assert langid.train(docs.limit(0), F.lit(True)).languages == ["und"]


def test_unlearned_language_is_rejected():
    rng = np.random.default_rng(8)
    syllables = {k: ["".join(rng.choice(list("abcdefghijklmnoprstuvz"), 2)) for _ in range(25)] for k in "wxyz"}

    def some(k, n):
        return [" ".join("".join(rng.choice(syllables[k], rng.integers(1, 4))) for _ in range(80)) for _ in range(n)]

    model = langid.fit([t for k in "wxy" for t in some(k, 60)], [k for k in "wxy" for _ in range(60)], bits=14)
    assert np.mean([model.judge(some(k, 40))[1].mean() for k in "wxy"]) > 0.9
    junk = ["".join(rng.choice(list("bcdfghjklmnpqrstvwxz  "), 500)) for _ in range(40)]
    for strange in (some("z", 40), junk, ["Όλοι οι άνθρωποι γεννιούνται ελεύθεροι και ίσοι στην αξιοπρέπεια"]):
        assert model.judge(strange)[1].mean() < 0.1


def near(texts):
    """Components by comparing every pair."""
    sets = []
    for t in texts:
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
        for c in "\t\n\v\f\r":
            low = low.replace(c, " ")
        w = [x for x in low.split(" ") if x]
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set()))
    root = list(range(len(sets)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 75 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [len(s) for s in sets], [find(i) for i in range(len(sets))]


def edited_copies(rng, n, words, rate):
    base = [f"w{rng.integers(0, 5000)}" for _ in range(words)]
    out = []
    for _ in range(n):
        base = [f"v{rng.integers(0, 10**6)}" if rng.random() < rate else w for w in base]
        out.append(" ".join(base))
    return out


def test_near_groups_equal_all_pairs(spark):
    rng = np.random.default_rng(5)
    passage = " ".join(f"p{i}" for i in range(60))
    texts = ["", None, "  ", "one two", "One  TWO", "a b c d e", "a b c d e f"]
    for words, rate in ((6, 0.02), (9, 0.02), (14, 0.02), (25, 0.01), (40, 0.01), (120, 0.01), (300, 0.01)):
        texts += edited_copies(rng, 12, words, rate)
    texts += [passage + " " + t for t in edited_copies(rng, 10, 60, 0.5)] + [texts[40]] * 5 + ["w " * 4000]
    sizes, roots = near(texts)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("component_id", F.lit(7))
    got = {r["doc_id"]: r for r in jaccard.near_groups(df).collect()}
    assert [got[i]["n_shingles"] for i in range(len(texts))] == sizes
    assert [got[i]["component_id"] for i in range(len(texts))] == roots
    assert len(set(roots)) < len(texts) - 20


def test_near_groups_odd_rows(spark, odd):
    got = jaccard.near_groups(odd).collect()
    assert len(got) == odd.count()
    assert {r["component_id"] for r in got if r["doc_id"] in (5, 60)} == {5}
    assert jaccard.near_groups(odd.limit(0)).count() == 0


@pytest.mark.parametrize("common", [False, True])
def test_similar_sets_share_a_signature(common):
    rng = np.random.default_rng(1)
    for m in (4, 5, 7, 10, 13, 18, 20, 33, 60, 150, 400, 1100):
        for _ in range(25):
            a = np.unique(rng.integers(0, 2**63, m, dtype=np.uint64))
            drop = rng.integers(0, max(1, a.size // 8) + 1)
            b = np.unique(np.r_[a[drop:], rng.integers(0, 2**63, drop, dtype=np.uint64)])
            both = np.intersect1d(a, b).size
            if 4 * both < 3 * (a.size + b.size - both):
                continue
            hint = common_map(rng.choice(a, max(1, a.size // 2))) if common else None
            w, s = signatures([a, b], common=hint)
            assert np.intersect1d(s[w == 0], s[w == 1]).size or (a.size == b.size == both)


def test_sketches_never_overstate():
    rng = np.random.default_rng(2)
    for m in (3, 100, 700):
        a = np.unique(rng.integers(0, 2**63, m, dtype=np.uint64))
        b = np.unique(np.r_[a[m // 10 :], rng.integers(0, 2**63, m // 3, dtype=np.uint64)])
        assert jaccard.flipped(jaccard.sketch(a), jaccard.sketch(b)) <= np.setxor1d(a, b).size


def test_components_of_a_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (5, 5)], "src long, dst long")
    got = {r["node"]: r["component"] for r in components(edges).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}


def test_warc(spark, duck, tmp_path):
    same(Q.op4_warc_bundles(spark, SMALL).toPandas(), duck.execute(Q.ORACLE_SQL["op4_warc_bundles"]).df())
    big = "é" * 600
    rows = [(1, "u 1\r\n", big), (2, None, big), (3, "u", big), (4, "u", "same"), (5, "u", "same"), (6, "u", None), (3, "u", big), (None, "u", big)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit("clash"))
    stored = warc.bundles(warc.plan(pages), frame=700).cache()
    got = warc.read(stored).collect()
    assert len(got) == len(rows)
    assert sorted((r["page_id"], r["refers_to"]) for r in got if r["record_type"] == "revisit") == [(1, 3), (2, 3)]
    assert {r["payload"] for r in got if r["page_id"] == 3} == {big.encode()}
    assert {r["payload_bytes"] for r in got if r["page_id"] == 1} == {1200}
    found = warc.lookup(stored, spark.createDataFrame([(4,), (6,)], "page_id long")).collect()
    assert sorted((r["page_id"], r["payload"]) for r in found) == [(4, b"same"), (6, b"")]
    warc.export(stored, str(tmp_path))
    files = list(tmp_path.glob("*.warc.zst"))
    data = files[0].read_bytes()
    table = warc.seek_table(data)
    import zstandard

    whole = b"".join(warc.open_frame(data, f) for f in table)
    assert whole.startswith(b"WARC/1.1\r\n") and len(table) > 0
    assert zstandard.ZstdDecompressor().stream_reader(data, read_across_frames=True).read(10**8) == whole
    assert warc.archive_and_read(pages.limit(0)).count() == 0


def test_fingerprints(spark, docs, odd):
    for table in (docs, odd):
        rows = sorted(texts_of(table), key=lambda r: (r[0] is None, -(r[0] or 0), r[1] is not None, r[1] or ""))
        got = syncmers.edit_test(table).collect()
        assert len(got) == len(rows)
        want = []
        for i, (doc_id, t) in enumerate(rows):
            new = syncmers.edited(t or "", rows[(i + 1) % len(rows)][1] or "")
            want.append((doc_id or -1, len(t or ""), hashlib.sha256(new.encode()).hexdigest()))
        assert sorted((-1 if r["doc_id"] is None else r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in got) == sorted((-1 if d == -1 else d, n, h) for d, n, h in [(x[0] if rows[k][0] != 0 else 0, x[1], x[2]) for k, x in enumerate(want)])
        assert all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in got)
    big = [r for r in syncmers.edit_test(docs).collect() if r["n_chars"] > 800]
    assert np.mean([r["near_edited"] for r in big]) > 0.2 > np.mean([r["near_next"] for r in big])
    assert syncmers.edit_test(odd.limit(0)).count() == 0
    one = spark.createDataFrame([(1, "abcd")], "doc_id long, text string")
    assert syncmers.edit_test(one).first()["edited_sha256"] == hashlib.sha256(b"abab").hexdigest()


def test_syncmers_by_definition():
    rng = np.random.default_rng(3)
    raw = bytes(rng.integers(97, 123, 400, dtype=np.uint8))
    hashes, places = syncmers.anchors(raw)
    again, moved = syncmers.anchors(b"#" * 100 + raw)
    shared = np.intersect1d(hashes, again)
    assert len(shared) > 0.7 * len(hashes) and syncmers.likeness((hashes, places), (again, moved)) > 0.6
    assert len(set(hashes.tolist())) == len(hashes) <= syncmers.ANCHORS


def test_fingerprints_of_long_texts_see_small_edits():
    rng = np.random.default_rng(9)
    raw = rng.integers(97, 123, 400_000, dtype=np.uint8)
    whole = syncmers.anchors(bytes(raw))
    for a in range(0, 400_000, 40_000):
        other = raw.copy()
        other[a : a + 1000] = rng.integers(97, 123, 1000, dtype=np.uint8)
        assert 0.9 < syncmers.likeness(whole, syncmers.anchors(bytes(other))) < 1


def test_vectors_equal_all_pairs(spark, duck):
    same(Q.op6_embedding_near_dedup(spark, SMALL).toPandas(), duck.execute(Q.ORACLE_SQL["op6_embedding_near_dedup"]).df())
    rng = np.random.default_rng(4)
    base = rng.normal(size=(40, 24))
    rows = [(b + rng.normal(size=24) * 0.12).tolist() for b in base for _ in range(6)] + [base[0].tolist()] * 4
    odd = [None, [], [0.0] * 24, [float("nan")] * 24, [float("inf")] + [0.0] * 23, [None] + [1.0] * 23, [1.0, 2.0], [2.0, 4.0]]
    table = list(enumerate(rows + odd))
    df = spark.createDataFrame(table, "vec_id long, embedding array<double>").withColumn("rep", F.lit(1))
    got = {r["vec_id"]: r for r in embed_dedup.near_vectors(df, pivots=7).collect()}
    x = np.array(rows)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    link = x @ x.T >= 0.95
    np.fill_diagonal(link, False)
    assert [got[i]["n_links"] for i in range(len(rows))] == link.sum(axis=1).tolist()
    root = np.arange(len(rows))
    for _ in range(len(rows)):
        root = np.array([min([root[i], *root[link[i]]]) for i in range(len(rows))])
    assert [got[i]["component_id"] for i in range(len(rows))] == root.tolist()
    n = len(rows)
    assert [got[n + i]["n_links"] for i in range(8)] == [0] * 6 + [1, 1] and got[n + 7]["component_id"] == n + 6 and got[n]["kept"]
    assert embed_dedup.near_vectors(df.limit(0)).count() == 0


def auc(y, s):
    order = np.argsort(s)
    rank = np.empty(len(s))
    rank[order] = np.arange(1, len(s) + 1)
    y = np.array(y)
    return (rank[y == 1].sum() - y.sum() * (y.sum() + 1) / 2) / (y.sum() * (len(y) - y.sum()))


def test_toxicity_and_quality_rank_held_out_rows(spark):
    sf = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    for f, column, least in ((Q.op7_toxicity, "toxic", 0.85), (Q.op9_quality_classifier, "quality", 0.98)):
        got = f(spark, sf).where("held_out").join(labels, "doc_id").where(F.col(column).isNotNull()).collect()
        assert auc([r[column] for r in got], [r["score"] for r in got]) > least


def labelled_words(seed, n, words):
    """Texts of invented words; every third is toxic and holds two of ``words``."""
    rng = np.random.default_rng(seed)
    stock = ["".join(rng.choice(list("abcdefghij"), rng.integers(3, 8))) for _ in range(400)]
    texts, toxic = [], []
    for i in range(n):
        t = rng.choice(stock, 60).tolist()
        if i % 3 == 0:
            for k in rng.integers(0, 60, 2):
                t[k] = words[rng.integers(len(words))]
        texts.append(" ".join(t))
        toxic.append(int(i % 3 == 0))
    return texts, toxic


def test_toxic_words_survive_copies():
    texts, toxic = labelled_words(5, 300, ["zounderkite", "quisbyling"])
    most = [texts[0]] * 100 + [texts[0] + " abc" * (k % 7) for k in range(40)]
    rows = toxicity.representatives(texts + most, toxic + [1] * 140)
    assert rows == list(range(300))
    model = toxicity.fit(texts + most, toxic + [1] * 140)
    assert b" zounderkite" in model.toxic and b" quisbyling" in model.toxic


def test_rare_and_short_toxic_words_are_learned():
    texts, toxic = labelled_words(6, 2400, ["zounderkite", "kwy"])
    for i in range(0, 27, 3):  # 9 of 800 toxic texts
        texts[i] += " quisbyling"
    tail, _ = toxicity.dictionaries(texts, toxic)
    assert all(w in tail for w in (b" zounderkite ", b" kwy ", b" quisbyling "))


def test_scores_of_odd_rows(spark, docs, odd):
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    for module, column in ((toxicity, "toxic_score"), (quality, "quality_score")):
        model = module.train(docs, labels, F.lit(True))
        got = module.score(odd, model).collect()
        assert len(got) == odd.count() and all(0 <= r[column] <= 1 for r in got)
        assert len({r[column] for r in got if r["doc_id"] == 3}) == 1
        assert module.score(odd.limit(0), module.train(docs, labels.limit(0), F.lit(True))).count() == 0


def poisson(u, rate):
    k, p, total = 0, math.exp(-rate), math.exp(-rate)
    while total <= u:
        k += 1
        p *= rate / k
        total += p
    return k


def test_mixing(spark, duck, odd):
    same(Q.op10_source_mixing(spark, SMALL).toPandas(), duck.execute(Q.ORACLE_SQL["op10_source_mixing"]).df())
    big = spark.range(30000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "a").when(F.col("id") % 3 == 1, "b").alias("source"))
    weights = spark.createDataFrame([("a", 3.0), ("b", 1.0)], "source string, weight double")
    n = {r["source"]: r["count"] for r in mixing.mix(big, weights=weights).groupBy("source").count().collect()}
    assert abs(n["a"] - 22500) < 600 and abs(n["b"] - 7500) < 400 and None not in n
    for r in mixing.mix(big).groupBy("doc_id", "source").count().where("doc_id < 300").collect():
        u = int(hashlib.md5(f"{r['doc_id']}|mix".encode()).hexdigest()[:8], 16) / 2**32
        assert r["count"] == poisson(u, 1.0)
    assert mixing.mix(odd).columns == [*odd.columns, "mix_copy"]
    assert mixing.mix(odd.limit(0)).count() == 0
    few = mixing.BROADCAST_SOURCES
    mixing.BROADCAST_SOURCES = 0
    try:
        salted = mixing.mix(big).groupBy("source").count().collect()
    finally:
        mixing.BROADCAST_SOURCES = few
    assert sorted(map(str, salted)) == sorted(map(str, mixing.mix(big).groupBy("source").count().collect()))


def test_pipeline_stage_by_stage(spark, library):
    import corpus_pipeline as P

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    seen = [docs.toPandas()]
    for name, stage in P.STAGES:
        docs = P.materialize(stage(spark, docs, SMALL), "test-" + name.replace(" ", "-"))
        if name != P.STAGES[-1][0]:
            assert docs.columns == seen[0].columns.tolist()
        seen.append(docs.toPandas())
    _, good, known, single, mixed, coded = seen
    assert 0 < len(good) <= len(seen[0]) and 0 < len(known) <= len(good)
    known = known.sort_values("doc_id").reset_index(drop=True)
    _, roots = near(known.text.tolist())
    assert sorted(single.doc_id) == sorted({known.doc_id[i] for i in roots})
    counts = single.source.value_counts()
    scale = len(single) / sum(math.sqrt(n) for n in counts)
    want = {}
    for d, s in zip(single.doc_id, single.source, strict=True):
        u = int(hashlib.md5(f"{d}|mix".encode()).hexdigest()[:8], 16) / 2**32
        want[d] = poisson(u, math.sqrt(counts[s]) * scale / counts[s])
    assert mixed.doc_id.value_counts().to_dict() == {d: n for d, n in want.items() if n}
    text = dict(zip(mixed.doc_id, mixed.text, strict=True))
    for r in coded.itertuples():
        assert np.frombuffer(r.token_ids, "<u4").tolist() == library.encode(text[r.doc_id], add_special_tokens=False).ids
        assert r.decoded_sha256 == hashlib.sha256(text[r.doc_id].encode()).hexdigest()
    assert len(coded) == len(mixed)


def test_shingles_of_short_texts():
    a, b, c, d = shingle_sets(["a b", "A  B", "ab", ""])
    assert a.tolist() == b.tolist() != c.tolist() and d.size == 0
