"""Operator 2, language ID: averaged hashed subword embeddings with a linear softmax.

A text is the mean of the embeddings of its hashed byte 2-, 3- and 4-grams; a linear softmax on that mean gives the
languages.  Both are trained by stochastic gradient descent in numpy on a bounded sample.  As the model is linear in
the mean, prediction gathers one precomputed logit row an n-gram and averages over the whole text: no shuffle.

A held-back part of the sample sets the softmax temperature and two bounds a prediction must keep to be accepted: the
score, and how far the text's n-grams are from what the predicted language's training texts have.  The score alone tells
languages apart but says little of texts of none of them.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import append_columns, field, passage_of, unit_hash

UNKNOWN = "und"
#: Languages up to which each has full rows in the model, and its full share of the sample.
FULL_LANGUAGES = 256
ORDERS = (2, 3, 4)
#: Lower-cased bytes; digits, ASCII punctuation and white space become one blank, 0 parts documents.
CLASSES = np.array([32 if b < 65 or 91 <= b <= 96 or 123 <= b <= 127 else b for b in range(256)], np.uint8)
LETTER = regex.compile(r"\p{L}")


def ngram_buckets(texts: list[str], bits: int):
    """For each n-gram order: bucket of the n-gram at every byte (-1 where it leaves its text); and each text's first byte."""
    parts = [b" " + t.lower().encode("utf-8", "surrogatepass") + b" " for t in texts]
    start = np.cumsum([0, *map(len, parts)])
    raw = CLASSES[np.frombuffer(b"".join(parts), np.uint8)].astype(np.uint32)
    left = np.repeat(start[1:], np.diff(start)) - np.arange(raw.size)  # bytes up to the end of the text
    out, h = [], raw + np.uint32(1)
    for n in range(2, max(ORDERS) + 1):
        h = h[:-1] * np.uint32(0x01000193) ^ raw[n - 1 :]
        if n in ORDERS:
            mixed = (h ^ np.uint32(n * 0x9E3779B1 & 0xFFFFFFFF)) * np.uint32(0x85EBCA6B)
            bucket = np.full(raw.size, -1, np.int64)
            bucket[: h.size] = mixed >> np.uint32(32 - bits)
            bucket[left < n] = -1
            out.append(bucket)
    return out, start


def sparse(text: str, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets of a text and their shares."""
    orders, _ = ngram_buckets([text], bits)
    all_ = np.concatenate(orders)
    ids, count = np.unique(all_[all_ >= 0], return_counts=True)
    return ids.astype(np.int32), (count / max(1, count.sum())).astype(np.float32)


@dataclass
class LanguageModel:
    languages: list[str]
    logits: np.ndarray  # buckets x languages: embedding @ weights
    bias: np.ndarray
    bits: int
    temperature: float = 1.0
    reject_below: float = 0.0
    usual: np.ndarray | None = None  # buckets x languages: log share of the n-gram in the language
    centre: np.ndarray | None = None  # of each language: mean of ``usual``, its variance over n-grams and over texts
    strange_above: float = np.inf

    def raw(self, texts: list[str], grams=None) -> np.ndarray:
        orders, start = grams or ngram_buckets(texts, self.bits)
        table = np.vstack([self.logits, np.zeros((1, len(self.languages)), np.float32)])  # -1 is the zero row
        total, count = np.zeros((len(texts), len(self.languages))), np.zeros(len(texts))
        for bucket in orders:
            if bucket.size:
                total += np.add.reduceat(table[bucket], start[:-1], axis=0, dtype=np.float64)
                count += np.add.reduceat((bucket >= 0).astype(np.int64), start[:-1])
        return total / np.maximum(count, 1)[:, None] + self.bias

    def probabilities(self, texts: list[str]) -> np.ndarray:
        return softmax(self.raw(texts) / self.temperature)

    def closeness(self, grams, lang: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Mean log share of each text's n-grams in its language of ``lang``, and the number of n-grams."""
        orders, start = grams
        table, width = np.append(self.usual.ravel(), np.float32(0)), len(self.languages)
        column = np.repeat(lang, np.diff(start))
        total, count = np.zeros(len(lang)), np.zeros(len(lang))
        for bucket in orders:
            if bucket.size:
                total += np.add.reduceat(table[np.where(bucket < 0, table.size - 1, bucket * width + column)], start[:-1], dtype=np.float64)
                count += np.add.reduceat((bucket >= 0).astype(np.int64), start[:-1])
        return total / np.maximum(count, 1), count

    def strangeness(self, grams, lang: np.ndarray) -> np.ndarray:
        """How many deviations, for its length, a text is less close to its language than usual."""
        close, count = self.closeness(grams, lang)
        mean, gram, text = self.centre[lang].T
        # N-grams of three orders overlap: about six in a row say the same.
        return (mean - close) / np.sqrt(text + 6 * gram / np.maximum(count, 1) + 1e-9)

    def judge(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Probabilities, and whether the best one is accepted."""
        grams = ngram_buckets(texts, self.bits)
        p = softmax(self.raw(texts, grams) / self.temperature)
        accepted = p.max(axis=1) >= self.reject_below
        if self.usual is not None:
            accepted &= self.strangeness(grams, p.argmax(axis=1)) <= self.strange_above
        return p, accepted


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def sample(docs: DataFrame, text_col: str, lang_col: str, id_col: str, usable: Column, bound: int, seed: str, most_languages: int, passage: int) -> tuple[list[str], list[str]]:
    """About ``bound`` rows of each language, chosen by a hash of id and text; texts and languages, in a fixed order.

    Counting reads two columns; the rows are then picked by a hash threshold while scanning, so nothing is shuffled
    but the chosen rows, of which equal ones count once.  In all there are twice as many as meant at most.  Of a text
    longer than ``passage`` characters a hash-chosen passage of so many is taken.  Where languages are more than
    ``FULL_LANGUAGES``, each has its share of the rows that so many have, and no fewer than 40.
    """
    known = docs.where(usable & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    sizes = known.groupBy("lang").count().limit(most_languages + 1).collect()
    if not sizes:
        return [], []
    if len(sizes) > most_languages:
        raise ValueError(f"more than most_languages={most_languages} languages")
    bound = bound if len(sizes) <= FULL_LANGUAGES else max(min(bound, 40), bound * FULL_LANGUAGES // len(sizes))
    shares = docs.sparkSession.createDataFrame([(r["lang"], min(1.0, bound / r["count"])) for r in sizes], "lang string, share double")
    u = unit_hash(F.coalesce(F.col("id").cast("string"), F.lit("null")), F.xxhash64("text"), F.lit(seed))
    rows = known.withColumn("u", u).join(F.broadcast(shares), "lang").where("u < share")  # a row a language
    rows = rows.select("u", "lang", passage_of(F.col("text"), passage).alias("text")).dropDuplicates()
    rows = rows.orderBy("u", "lang", "text").limit(bound * len(sizes) * 2).toArrow()
    return rows.column("text").to_pylist(), rows.column("lang").to_pylist()


def fit(texts: list[str], langs: list[str], bits: int = 16, dims: int = 16, epochs: int = 4, rate: float = 0.5, seed: int = 7, keep: float = 0.998) -> LanguageModel:
    """Train on four fifths of the sample, calibrate temperature and rejection on the rest."""
    names = sorted(set(langs))
    bits -= max(0, math.ceil(math.log2(max(1, len(names)) / FULL_LANGUAGES)))  # the model stays as large as it is then
    rng = np.random.default_rng(seed)
    if not names:
        return LanguageModel([UNKNOWN], np.zeros((1 << bits, 1), np.float32), np.zeros(1), bits)
    y = np.array([names.index(x) for x in langs])
    emb = rng.normal(0, 0.1, (1 << bits, dims)).astype(np.float32)
    weight, bias = rng.normal(0, 0.1, (dims, len(names))).astype(np.float32), np.zeros(len(names), np.float32)
    train = [i for i in range(len(texts)) if i % 5 or len(texts) < 10]
    held = [i for i in range(len(texts)) if not i % 5] if len(texts) >= 10 else train
    rows = {i: sparse(texts[i], bits) for i in train}
    epochs = max(epochs, -(-6000 // max(1, len(train))))  # few texts are seen more often
    steps, at = epochs * len(train), 0
    for _ in range(epochs):
        for i in rng.permutation(train).tolist():
            ids, share = rows[i]
            lr = rate * (1 - at / steps)
            at += 1
            if not ids.size:
                continue
            mean = share @ emb[ids]
            p = softmax((mean @ weight + bias)[None])[0]
            p[y[i]] -= 1
            back = weight @ p
            weight -= lr * np.outer(mean, p)
            bias -= lr * p
            # A mean over thousands of n-grams has small shares: scale the step by their inverse square sum.
            emb[ids] -= (lr / max(float(share @ share), 1e-4)) * 0.05 * np.outer(share, back)
    model = LanguageModel(names, (emb @ weight).astype(np.float32), bias, bits)
    z, t = model.raw([texts[i] for i in held]), y[held]
    grid = np.geomspace(0.01, 10, 61)
    loss = [-np.log(np.maximum(softmax(z / s)[np.arange(len(t)), t], 1e-12)).mean() for s in grid]
    model.temperature = float(grid[int(np.argmin(loss))])
    p = softmax(z / model.temperature)
    best = p.argmax(axis=1)
    right = np.sort(p.max(axis=1)[best == t])
    # Scores of one to the last digits are all one.
    model.reject_below = min(float(right[int((1 - keep) * right.size)]), 1 - 1e-9) if right.size else 0.0
    counts = np.zeros((1 << bits, len(names)))
    for i in train:
        grams = np.concatenate(ngram_buckets([texts[i]], bits)[0])
        counts[:, y[i]] += np.bincount(grams[grams >= 0], minlength=1 << bits)
    share = (counts + 0.1) / (counts + 0.1).sum(axis=0)
    model.usual = np.log(share).astype(np.float32)
    seen = counts / np.maximum(counts.sum(axis=0), 1)
    mean = (seen * model.usual).sum(axis=0)
    gram = (seen * (model.usual - mean) ** 2).sum(axis=0)
    model.centre = np.stack([mean, gram, np.full(len(names), 1e-4)], axis=1)
    # Texts that calibrate are those the training has not seen, each language around their own middle.
    grams = ngram_buckets([texts[i] for i in held], bits)
    close, count = model.closeness(grams, t)
    for k in range(len(names)):
        at = (t == k) & (count >= 200)
        if at.sum() >= 5:
            model.centre[k, 0] = np.median(close[at])
            model.centre[k, 2] += (1.4826 * np.median(np.abs(close[at] - model.centre[k, 0]))) ** 2
    far = np.sort(model.strangeness(grams, t)[best == t])[::-1]
    model.strange_above = float(far[int((1 - keep) * far.size)]) if far.size else np.inf
    return model


def predict(docs: DataFrame, model: LanguageModel, text_col: str = "text", prefix: str = "lang_") -> DataFrame:
    """``docs`` with ``<prefix>pred`` string, ``<prefix>score`` double in [0, 1] and ``<prefix>accepted`` boolean.

    Null texts, and texts without a letter, get ``und``, score 0 and are not accepted; nor are texts that score lower
    or look stranger than all but about 0.2 % of the held-back ones of the learned languages.  Ties go to the first language
    in name order.  Existing columns of these names are replaced; an empty table gives an empty table.
    """

    def make():
        def run(texts):
            lettered = [bool(t and LETTER.search(t)) for t in texts]
            p, accepted = model.judge([t or "" for t in texts])
            best, score = p.argmax(axis=1).tolist(), np.clip(p.max(axis=1), 0, 1).tolist()
            known = [ok and bool(model.languages) for ok in lettered]
            return [
                [model.languages[b] if ok else UNKNOWN for b, ok in zip(best, known, strict=True)],
                [s if ok else 0.0 for s, ok in zip(score, known, strict=True)],
                [ok and a for a, ok in zip(accepted.tolist(), known, strict=True)],
            ]

        return run

    return append_columns(docs, text_col, make, [field(prefix + "pred", "string"), field(prefix + "score", "double"), field(prefix + "accepted", "boolean")])


def train(docs: DataFrame, usable: Column, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", per_language: int = 400, seed: str = "langid", most_languages: int = 8192, passage: int = 50_000) -> LanguageModel:
    """Fit on about ``per_language`` documents of each language among the ``usable`` ones, and on a passage of ``passage``
    characters of longer texts (documented bounds).

    The model has a row of 512 KB a language; past ``FULL_LANGUAGES`` of them rows get shorter, so that it stays under
    134 MB, and past ``most_languages`` they are an error: none is left out.
    """
    return fit(*sample(docs, text_col, lang_col, id_col, usable, per_language, seed, most_languages, passage))
