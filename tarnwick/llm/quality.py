"""Operator 9, quality classifier: positive-unlabelled learning.

A linear model on character-class bigrams and repetition statistics of the whole text minimises the non-negative
unbiased risk: trusted positives and unlabelled web text, with an estimated class prior, and no negatives.  The prior
is estimated from positives and unlabelled rows alone, by the best bin of a positive-against-unlabelled score: where
hardly a negative is, the unlabelled share over the positive share is the prior.  A final monotone map, by the unbiased
logistic risk on the same two kinds of rows, makes the score a probability; no negative label is read.

Features are computed where the texts are read; only a bounded, documented number of feature rows reaches the driver.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import append_columns, field, unit_hash

#: Groups of bytes that count as one class each.
GROUPS = {
    1: "abcdefghijklmnopqrstuvwxyz", 2: "ABCDEFGHIJKLMNOPQRSTUVWXYZ", 3: "0123456789", 4: " \t", 5: "\n\r", 6: ".", 7: ",", 8: "!?",
    9: "|", 10: "#$%&*@^~", 11: "/\\_=+-", 12: "<>{}[]()", 13: ":;", 14: "\"'`",
}
CLASS = np.array([next((k for k, s in GROUPS.items() if chr(b) in s), 1 if b > 127 else 15) for b in range(256)], np.uint8)
STATS = 13
WIDTH = 256 + STATS


def features(text: str) -> np.ndarray:
    """Square roots of character-class bigram shares, then statistics of words and lines."""
    out = np.zeros(WIDTH, np.float32)
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    if raw.size > 1:
        c = CLASS[raw].astype(np.int16)
        out[:256] = np.sqrt(np.bincount(c[:-1] * 16 + c[1:], minlength=256) / (raw.size - 1))
    words = text.split()
    n = len(words)
    if n:
        count = Counter(words)
        pairs = list(zip(words, words[1:]))  # noqa: B905
        lines = [x for x in text.split("\n") if x.strip()]
        shared = Counter(lines)
        letters = sum(map(len, words))
        out[256:] = [
            len(count) / n,
            max(count.values()) / n,
            sum(a == b for a, b in pairs) / n,
            len(set(pairs)) / max(1, len(pairs)),
            np.log1p(n) / 10,
            letters / n / 10,
            len(shared) / max(1, len(lines)),
            np.log1p(len(text) / max(1, len(lines))) / 10,
            float(n < 20),
            float(n < 60),
            np.sqrt(len(count)) / n**0.5,
            sum(w.isupper() for w in words) / n,
            sum(not w[-1].isalnum() for w in words) / n,
        ]
    return out


@dataclass
class QualityModel:
    weight: np.ndarray
    bias: float
    mean: np.ndarray
    scale: np.ndarray
    prior: float
    slope: float = 1.0
    offset: float = 0.0

    def margin(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.mean) / self.scale) @ self.weight + self.bias

    def score(self, x: np.ndarray) -> np.ndarray:
        return sigmoid(self.slope * self.margin(x) + self.offset)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float, epochs: int = 60, batch: int = 256, rate: float = 0.02, decay: float = 1e-3, seed: int = 3) -> QualityModel:
    """Non-negative PU risk with the sigmoid loss, by Adam on mini-batches.

    risk = prior * E_pos[l(g)] + max(0, E_unl[l(-g)] - prior * E_pos[l(-g)]); where the bracket turns negative, its
    gradient is followed upwards, as the estimator's authors do.
    """
    width = unlabelled.shape[1]
    if not len(positive) or not len(unlabelled):
        return QualityModel(np.zeros(width), 0.0, np.zeros(width), np.ones(width), prior)
    both = np.vstack([positive, unlabelled])
    mean, scale = both.mean(axis=0), both.std(axis=0) + 1e-3
    p, u = (positive - mean) / scale, (unlabelled - mean) / scale
    rng = np.random.default_rng(seed)
    w, m, v, step = np.zeros(width + 1), np.zeros(width + 1), np.zeros(width + 1), 0
    p, u = np.c_[p, np.ones(len(p))], np.c_[u, np.ones(len(u))]
    for _ in range(epochs):
        order = rng.permutation(len(u))
        for a in range(0, len(u), batch):
            x = u[order[a : a + batch]]
            q = p[rng.integers(0, len(p), len(x))]
            gu, gq = sigmoid(x @ w), sigmoid(q @ w)  # loss of calling it negative
            du, dq = (gu * (1 - gu)) @ x / len(x), (gq * (1 - gq)) @ q / len(q)
            negative = gu.mean() - prior * gq.mean()
            grad = -prior * dq + (du - prior * dq) if negative >= 0 else -(du - prior * dq)
            grad = grad + decay * w
            step += 1
            m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
            w = w - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return QualityModel(w[:-1], float(w[-1]), mean, scale, prior)


def class_prior(positive: np.ndarray, unlabelled: np.ndarray, ridge: float = 1.0, delta: float = 0.1) -> float:
    """Share of positives among the unlabelled rows, by best bin estimation.

    A logistic score tells half of the positives from half of the unlabelled rows.  On the other halves, the share of
    unlabelled rows above a threshold over that of positives bounds the prior from above, and meets it where no
    negative scores so high; the threshold with the lowest confident bound is taken.
    """
    if len(positive) < 4 or len(unlabelled) < 4:
        return 0.5
    p, u = positive[::2], unlabelled[::2]
    both = np.vstack([p, u])
    mean, scale = both.mean(axis=0), both.std(axis=0) + 1e-3
    x = np.c_[(both - mean) / scale, np.ones(len(both))]
    y = np.r_[np.ones(len(p)), np.zeros(len(u))]
    weight = np.r_[np.full(len(p), 0.5 / len(p)), np.full(len(u), 0.5 / len(u))] * len(both)
    w = np.zeros(x.shape[1])
    for _ in range(15):
        q = sigmoid(x @ w)
        hessian = (x * (weight * q * (1 - q))[:, None]).T @ x + ridge * np.eye(len(w))
        w -= np.linalg.solve(hessian, x.T @ (weight * (q - y)) + ridge * w)
    sp, su = (np.sort(np.c_[(r - mean) / scale, np.ones(len(r))] @ w) for r in (positive[1::2], unlabelled[1::2]))
    at = np.unique(sp)
    share_p = 1 - np.searchsorted(sp, at) / len(sp)
    share_u = 1 - np.searchsorted(su, at) / len(su)
    doubt = np.sqrt(np.log(4 / delta) / 2) * (len(su) ** -0.5 + 1.01 * len(sp) ** -0.5)
    best = int(np.argmin((share_u + doubt) / share_p))
    return float(np.clip(share_u[best] / share_p[best], 0.02, 0.98))


def calibrate(model: QualityModel, positive: np.ndarray, unlabelled: np.ndarray, ridge: float = 1e-3) -> None:
    """A map from margins to probabilities by the unbiased logistic risk of positives and unlabelled rows,
    E_unl[log(1 + e^z)] - prior * E_pos[z]; its slope is held down by ``ridge`` where the kinds part cleanly."""
    if not len(positive) or not len(unlabelled):
        return
    zp, zu = model.margin(positive), model.margin(unlabelled)
    mid, wide = zu.mean(), zu.std() + 1e-9
    x, pull = np.c_[(zu - mid) / wide, np.ones(len(zu))], model.prior * np.array([((zp - mid) / wide).mean(), 1.0])
    w, hold = np.array([1.0, 0.0]), np.array([ridge, 1e-9])
    for _ in range(100):
        q = sigmoid(x @ w)
        step = np.linalg.solve((x * (q * (1 - q))[:, None]).T @ x / len(x) + np.diag(hold), x.T @ q / len(x) - pull + hold * w)
        w = w - np.clip(step, -1, 1)
    if np.isfinite(w).all() and w[0] > 0:
        model.slope, model.offset = float(w[0] / wide), float(w[1] - w[0] * mid / wide)


def feature_rows(rows: DataFrame, text_col: str, keep: list[str]) -> DataFrame:
    def make():
        return lambda texts: [[features(t or "").tobytes() for t in texts]]

    return append_columns(rows.select(*keep, text_col), text_col, make, [field("features", "binary")]).drop(text_col)


def _matrix(rows: DataFrame, most: int) -> np.ndarray:
    """Features of the rows, each once, cut to ``most`` by a hash of id and features in the rare case of more."""
    found = rows.dropDuplicates(["id", "features"]).orderBy(F.xxhash64("id", "features"), "id", "features").limit(most)
    found = found.toArrow().sort_by([("id", "ascending"), ("features", "ascending")])
    return np.frombuffer(b"".join(found.column("features").to_pylist()), np.float32).reshape(-1, WIDTH).astype(np.float64)


def train(docs: DataFrame, labels: DataFrame, usable: Column, text_col: str = "text", id_col: str = "doc_id", label_col: str = "quality", max_labelled: int = 6000, max_unlabelled: int = 6000, seed: str = "quality") -> QualityModel:
    """Fit on about ``max_labelled`` trusted positives and ``max_unlabelled`` unlabelled rows among the ``usable`` ones,
    picked by hashes while scanning, and on a tenth more at most (documented bounds).

    Rows that repeat an id and a text count once.  Rows labelled 1, and never otherwise, are trusted; no other label is read.
    """
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    trusted = labels.where(usable & F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.min(F.col(label_col).cast("int")).alias("good")).where("good = 1").select("id")
    share = min(1.0, max_labelled / max(1, trusted.count()))
    few = trusted.where(unit_hash(F.col("id"), F.lit(seed)) < share)
    p = _matrix(feature_rows(texts.join(F.broadcast(few), "id"), "text", ["id"]), max_labelled * 11 // 10)
    pool = docs.where(usable).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    share = min(1.0, max_unlabelled / max(1, pool.count()))
    chosen = unit_hash(F.coalesce(F.col("id").cast("string"), F.lit("null")), F.xxhash64("text"), F.lit(seed + "-web")) < share
    u = _matrix(feature_rows(pool.where(chosen), "text", ["id"]), max_unlabelled * 11 // 10)
    model = fit(p, u, class_prior(p, u))
    calibrate(model, p, u)
    return model


def score(docs: DataFrame, model: QualityModel, text_col: str = "text", score_col: str = "quality_score", risk_col: str | None = None) -> DataFrame:
    """``docs`` with ``score_col`` double in [0, 1] to nine places, higher for text more like the trusted positives, and
    if asked ``risk_col``, the risk's own sigmoid before calibration.

    Null and empty texts are scored like any other (all features zero); equal texts and repeated rows score equally;
    texts of any length are scored whole.  Existing columns of these names are replaced and other columns pass through;
    an empty table gives an empty table.
    """

    def make():
        def run(texts):
            x = np.array([features(t or "") for t in texts], np.float64)
            return [np.round(model.score(x), 9).tolist(), *([np.round(sigmoid(model.margin(x)), 9).tolist()] if risk_col else [])]

        return run

    return append_columns(docs, text_col, make, [field(score_col, "double"), *([field(risk_col, "double")] if risk_col else [])])
