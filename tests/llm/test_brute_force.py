"""Operators without SQL against plain versions: loops over one text at a time, by definition."""

import hashlib
import math
from collections import Counter

import numpy as np
import pytest
import zstandard
from conftest import SMALL
from pyspark.sql import functions as F
from test_llm import near

from tarnwick.llm import jaccard, langid, quality, syncmers, toxicity
from tarnwick.llm import queries as Q
from tarnwick.llm.common import fold, load

M64 = (1 << 64) - 1


def scrambled(x):
    x ^= x >> 32
    x = x * 0xD6E8FEB86659FD93 & M64
    x ^= x >> 29
    x = x * 0xA0761D6478BD642F & M64
    return x ^ (x >> 32)


def plain_anchors(raw):
    """Every k-mer looked at by itself: (hash, place), smallest hashes first."""
    if not raw:
        return []
    found = {}
    for i in range(len(raw) - syncmers.K + 1):
        inner = []
        for j in range(i, i + syncmers.K - syncmers.S + 1):
            h = int.from_bytes(raw[j : j + syncmers.S], "little") * 0x9E3779B97F4A7C15 & M64
            h ^= h >> 32
            inner.append(h * 0xD6E8FEB86659FD93 & M64)
        if min(inner) in (inner[0], inner[-1]):
            found.setdefault(scrambled((inner[0] + inner[-1] * 0xA0761D6478BD642F) & M64) >> 32, i)
    if not found:
        return [(int.from_bytes(hashlib.sha256(raw).digest()[:4], "little"), 0)]
    best = sorted(found.items())
    return best[: max(syncmers.ANCHORS, sum(h < syncmers.DENSE for h, _ in best))]


def plain_likeness(a, b):
    if a == b:
        return 1.0
    both = sorted({h for h, _ in a} | {h for h, _ in b})
    both = both[: max(syncmers.ANCHORS, sum(h < syncmers.DENSE for h in both))]
    if not a or not b:
        return 0.0
    at = dict(b)
    moves = [p - at[h] for h, p in a if h in at and h <= both[-1]]
    return max([0, *(sum(m <= x <= m + syncmers.SLACK for x in moves) for m in moves)]) / len(both)


def test_fingerprints_by_definition(spark):
    docs = load(spark, SMALL, "documents").where("n_chars < 4000")
    extra = spark.createDataFrame([(10**6, "", "", "", 0), (10**6 + 1, None, "", "", 0), (10**6 + 2, "short", "", "", 5), (10**6 + 3, "x" * 900, "", "", 900)], docs.schema)
    rows = sorted([(r["doc_id"], r["text"] or "") for r in docs.unionByName(extra).select("doc_id", "text").collect()], reverse=True)
    got = {r["doc_id"]: r for r in syncmers.edit_test(docs.unionByName(extra)).collect()}
    text_of = lambda fp: syncmers.to_text(tuple(np.array([x[k] for x in fp], np.uint32) for k in (0, 1)))
    prints = [plain_anchors(t.encode()) for _, t in rows]
    for i, (d, t) in enumerate(rows):
        after = rows[(i + 1) % len(rows)][1]
        half = len(t) // 2
        new = t[: len(t) - half] + after[:half]
        fp = plain_anchors(new.encode())
        r = got[d]
        assert r["edited_sha256"] == hashlib.sha256(new.encode()).hexdigest()
        assert (r["fingerprint"], r["edited_fingerprint"]) == (text_of(prints[i]), text_of(fp))
        assert r["near_edited"] == pytest.approx(plain_likeness(prints[i], fp))
        assert r["near_next"] == pytest.approx(plain_likeness(prints[i], prints[(i + 1) % len(rows)]))


def plain_language(model, text):
    """Logits summed gram by gram; the best language, its probability, and whether it is accepted."""
    raw = [int(langid.CLASSES[b]) for b in b" " + text.lower().encode() + b" "]
    grams = []
    for n in langid.ORDERS:
        for i in range(len(raw) - n + 1):
            h = raw[i] + 1
            for k in range(1, n):
                h = (h * 0x01000193 & 0xFFFFFFFF) ^ raw[i + k]
            mixed = (h ^ (n * 0x9E3779B1 & 0xFFFFFFFF)) * 0x85EBCA6B & 0xFFFFFFFF
            grams.append(mixed >> (32 - model.bits))
    z = [sum(float(model.logits[g, k]) for g in grams) / max(1, len(grams)) + float(model.bias[k]) for k in range(len(model.languages))]
    top = max(z)
    e = [math.exp((x - top) / model.temperature) for x in z]
    k = max(range(len(e)), key=lambda j: (e[j], -j))
    score = e[k] / sum(e)
    close = sum(float(model.usual[g, k]) for g in grams) / max(1, len(grams))
    mean, gram, spread = model.centre[k]
    strange = (mean - close) / math.sqrt(spread + 6 * gram / max(1, len(grams)) + 1e-9)
    return model.languages[k], score, score >= model.reject_below and strange <= model.strange_above


def test_language_by_loops(spark):
    docs = load(spark, SMALL, "documents")
    model = langid.train(docs, fold(F.col("doc_id"), 4) != 2)
    got = langid.predict(docs.where("n_chars < 3000"), model).collect()
    for r in got[:80]:
        lang, score, accepted = plain_language(model, r["text"])
        if not langid.LETTER.search(r["text"]):
            lang, score, accepted = "und", 0.0, False
        assert (r["lang_pred"], r["lang_accepted"]) == (lang, accepted)
        assert r["lang_score"] == pytest.approx(score, abs=1e-5)


def test_toxicity_by_loops(spark):
    docs = load(spark, SMALL, "documents")
    model = toxicity.train(docs, load(spark, SMALL, "labels"), fold(F.col("doc_id"), 3) != 1)
    how = zstandard.ZstdCompressionParameters.from_level(6, min_match=5, write_content_size=0, write_checksum=0, write_dict_id=0)
    small = lambda d, w: len(zstandard.ZstdCompressor(compression_params=how, dict_data=zstandard.ZstdCompressionDict(d, dict_type=zstandard.DICT_TYPE_RAWCONTENT)).compress(w))
    for r in toxicity.score(docs.where("n_chars < 1500"), model).collect()[:40]:
        raw = r["text"].lower().encode()
        cut, at = [], 0
        while at == 0 or at < len(raw) - (toxicity.WINDOW - toxicity.STEP):
            cut.append(raw[at : at + toxicity.WINDOW])
            at += toxicity.STEP
        d = sorted((small(model.ordinary, w) - small(model.toxic, w) for w in cut), reverse=True)
        n = len(d)
        share = lambda k: sum(x >= k for x in d) / n
        root = lambda k: math.sqrt(sum(x >= k for x in d))
        x = [d[0], sum(d[:3]) / len(d[:3]), sum(d[:10]) / len(d[:10]), share(3), share(4), share(5), sum(max(v, 0) for v in d) / n, sum(min(v, 0) for v in d) / n, math.log(n), root(4), root(5), root(6)]
        z = sum((a - m) / s * w for a, m, s, w in zip(x, model.mean, model.scale, model.weight, strict=False)) + model.weight[-1]
        assert r["toxic_score"] == pytest.approx(1 / (1 + math.exp(-z)), abs=1e-8)


def plain_features(text):
    raw = text.encode()
    kind = lambda b: next((k for k, s in quality.GROUPS.items() if b < 128 and chr(b) in s), 1 if b > 127 else 15)
    pairs = Counter((kind(a), kind(b)) for a, b in zip(raw, raw[1:], strict=False))
    out = [math.sqrt(pairs[i, j] / (len(raw) - 1)) if len(raw) > 1 else 0.0 for i in range(16) for j in range(16)]
    words = text.split()
    if not words:
        return out + [0.0] * quality.STATS
    n, lines = len(words), [x for x in text.split("\n") if x.strip()]
    following = [(words[i], words[i + 1]) for i in range(n - 1)]
    per_line = len(text) / max(1, len(lines))
    return out + [
        len(set(words)) / n, max(words.count(w) for w in set(words)) / n, sum(a == b for a, b in following) / n, len(set(following)) / max(1, len(following)),
        math.log(1 + n) / 10, sum(len(w) for w in words) / n / 10, len(set(lines)) / max(1, len(lines)), math.log(1 + per_line) / 10, n < 20, n < 60,
        math.sqrt(len(set(words))) / math.sqrt(n), sum(w.isupper() for w in words) / n, sum(not w[-1].isalnum() for w in words) / n,
    ]


def test_quality_by_loops(spark):
    docs = load(spark, SMALL, "documents")
    model = quality.train(docs, load(spark, SMALL, "labels"), fold(F.col("doc_id"), 3) != 1)
    for r in quality.score(docs.where("n_chars < 3000"), model, risk_col="risk").collect()[:80]:
        margin = sum((float(np.float32(x)) - m) / s * w for x, m, s, w in zip(plain_features(r["text"]), model.mean, model.scale, model.weight, strict=True)) + model.bias
        assert r["risk"] == pytest.approx(1 / (1 + math.exp(-margin)), abs=1e-6)
        assert r["quality_score"] == pytest.approx(1 / (1 + math.exp(-(model.slope * margin + model.offset))), abs=1e-6)


def test_class_prior_is_that_of_the_mixture():
    rng = np.random.default_rng(0)
    for share in (0.2, 0.5, 0.85):
        good, other = rng.normal(1.5, 1, (3000, 4)), rng.normal(-1.5, 1, (3000, 4))
        k = int(3000 * share)
        mixed = np.vstack([rng.normal(1.5, 1, (k, 4)), other[: 3000 - k]])
        found = quality.class_prior(good, mixed[rng.permutation(3000)])
        assert abs(found - share) < 0.06
        model = quality.fit(good, mixed, found)
        quality.calibrate(model, good, mixed)
        assert (model.score(good) >= 0.5).mean() > 0.95 and (model.score(other) >= 0.5).mean() < 0.05


def test_first_pipeline_stages_keep_what_loops_keep(spark):
    import corpus_pipeline as P

    docs = load(spark, SMALL, "documents").where("n_chars < 2000")
    model = quality.train(docs, load(spark, SMALL, "labels"), fold(F.col("doc_id"), 3) != 1)
    rows = docs.collect()
    want = set()
    for r in rows:
        margin = sum((float(np.float32(x)) - m) / s * w for x, m, s, w in zip(plain_features(r["text"]), model.mean, model.scale, model.weight, strict=True)) + model.bias
        if 1 / (1 + math.exp(-(model.slope * margin + model.offset))) >= Q.GOOD_FROM:
            want.add(r["doc_id"])
    good = P.keep_good(spark, docs, SMALL)
    assert {r["doc_id"] for r in good.select("doc_id").collect()} == want
    known = langid.train(good, fold(F.col("doc_id"), 4) != 2)
    sure = {r["doc_id"] for r in good.collect() if langid.LETTER.search(r["text"]) and plain_language(known, r["text"])[2]}
    assert {r["doc_id"] for r in P.keep_known_language(spark, good, SMALL).select("doc_id").collect()} == sure


def crowded_texts(seed, n=260):
    """Near copies of few bases, most with one passage that half of them share, one base with half of all rows."""
    rng = np.random.default_rng(seed)
    passage = [f"p{i}" for i in range(30)]
    bases = [[f"w{rng.integers(0, 3000)}" for _ in range(k)] for k in (60, 12, 25, 40, 90)]
    texts = []
    for i in range(n):
        b = list(bases[0] if i % 2 else bases[rng.integers(1, 5)])
        b += passage if rng.random() < 0.5 else []
        for _ in range(rng.integers(0, 4)):
            b[rng.integers(0, len(b))] = f"x{rng.integers(0, 40)}"
        texts.append(" ".join(b))
    return texts


@pytest.mark.parametrize("bound, task", [(None, jaccard.TASK), (4, 700)])
def test_crowded_groups_equal_all_pairs(spark, monkeypatch, bound, task):
    """Large groups of near copies around a common passage; then with every join shuffled and every block tiny, and tasks
    of many ranges and several runs a range."""
    if bound:
        for name in ("BROADCAST_IDS", "STAR_BLOCK", "PAIR_BLOCK"):
            monkeypatch.setattr(jaccard, name, bound)
    texts = crowded_texts(bound or 0)
    sizes, roots = near(texts)
    got = {r["doc_id"]: r for r in jaccard.near_groups(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5), task=task, tasks=2).collect()}
    assert [got[i]["n_shingles"] for i in range(len(texts))] == sizes
    assert [got[i]["component_id"] for i in range(len(texts))] == roots


def test_rows_of_one_id_have_the_links_of_all_its_texts(spark):
    a, b = (" ".join(f"{c}{i}" for i in range(40)) for c in "ab")
    rows = [(7, a), (7, b), (3, a + " more"), (9, b), (9, b), (5, b + " else"), (1, "quite another text of some words"), (None, a), (None, a)]
    got = jaccard.near_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == len(rows)
    assert {(r["doc_id"], r["component_id"]) for r in got} == {(7, 3), (3, 3), (9, 3), (5, 3), (1, 1), (None, None)}
