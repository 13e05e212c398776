"""Operator 7, toxicity: compression-distance classification.

Two zstandard dictionaries are made from labelled rows, one of toxic and one of ordinary words.  Every window of a text is compressed
with both; the window's distance is how many bytes the ordinary dictionary costs more.  A logistic map of the window
distances, fitted on labelled rows that the dictionaries have not seen, calibrates the score and its threshold.

Both dictionaries share the most frequent ordinary words, so that ordinary text costs alike; they differ in a tail:
here the word starts typical of toxic texts, as many as the training rows speak for, there as many bytes of rarer
ordinary words.  All of it comes from a bounded, documented number of labelled rows; windows cover whole texts.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from dataclasses import dataclass, field as datafield
from heapq import heapify, heappop, heappush
from zlib import crc32

import numpy as np
import regex
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import append_columns, field, materialize, passage_of, unit_hash

WORD = regex.compile(r"\p{L}+")
WINDOW, STEP = 64, 48
FEATURES = 12
#: Bytes of word starts in the toxic dictionary at most.
TAIL = 32 << 10


def windows(text: str) -> list[bytes]:
    """Overlapping byte windows that cover the whole text; an empty text has one empty window."""
    raw = text.lower().encode("utf-8", "surrogatepass")
    return [raw[a : a + WINDOW] for a in range(0, max(1, len(raw) - (WINDOW - STEP)), STEP)]


@dataclass
class ToxicityModel:
    toxic: bytes
    ordinary: bytes
    weight: np.ndarray = datafield(default_factory=lambda: np.zeros(FEATURES + 1))
    mean: np.ndarray = datafield(default_factory=lambda: np.zeros(FEATURES))
    scale: np.ndarray = datafield(default_factory=lambda: np.ones(FEATURES))

    def compressors(self):
        # Matches of five bytes or more: shorter ones are syllables of any text.
        how = zstandard.ZstdCompressionParameters.from_level(6, min_match=5, write_content_size=0, write_checksum=0, write_dict_id=0)
        kind = zstandard.DICT_TYPE_RAWCONTENT
        return [zstandard.ZstdCompressor(compression_params=how, dict_data=zstandard.ZstdCompressionDict(d, dict_type=kind)).compress for d in (self.ordinary, self.toxic)]

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(np.c_[(x - self.mean) / self.scale, np.ones(len(x))] @ self.weight, -40, 40)))


def distances(text: str, ordinary, toxic) -> np.ndarray:
    return np.array([len(ordinary(w)) - len(toxic(w)) for w in windows(text)], np.float64)


def summary(d: np.ndarray) -> list[float]:
    """What the window distances of a text say, whatever its length."""
    top = np.sort(d)[::-1]
    return [top[0], top[:3].mean(), top[:10].mean(), (d >= 3).mean(), (d >= 4).mean(), (d >= 5).mean(), d.clip(0).mean(), d.clip(None, 0).mean(), np.log(d.size), (d >= 4).sum() ** 0.5, (d >= 5).sum() ** 0.5, (d >= 6).sum() ** 0.5]


def representatives(texts: list[str], toxic: list[int], share: float = 0.5, size: int = 64) -> list[int]:
    """Rows that copy no earlier row of their label, neither wholly nor in ``share`` of their sampled word triples."""
    kept: list[int] = []
    whole: set[tuple[int, str]] = set()
    holders: dict[tuple[int, int], list[int]] = defaultdict(list)
    for i, (text, y) in enumerate(zip(texts, toxic, strict=True)):
        low = text.lower()
        if (y, low) in whole:
            continue
        words = WORD.findall(low)
        triples = sorted({crc32(" ".join(words[k : k + 3]).encode("utf-8", "surrogatepass")) for k in range(len(words) - 2)})[:size]
        met = Counter(j for h in triples for j in holders.get((y, h), ()))
        if met and max(met.values()) >= share * len(triples):
            continue
        kept.append(i)
        whole.add((y, low))
        for h in triples:
            holders[y, h].append(i)
    return kept


def starts(text: str) -> set[str]:
    """Words, each between blanks, and their starts of four letters or more with the blank before.

    A form takes five bytes at least, as matches do: a word of two ASCII letters has none.
    """
    out: set[str] = set()
    for w in set(WORD.findall(text.lower())):
        if len(w.encode("utf-8", "surrogatepass")) >= 3:
            out.add(" " + w + " ")
        out.update(" " + w[:k] for k in range(4, min(len(w), 9) + 1))
    return out


def dictionaries(texts: list[str], toxic: list[int], size: int = TAIL, support: int = 5) -> tuple[bytes, bytes]:
    """Content of the toxic and the ordinary dictionary from labelled texts, none of them a copy of another.

    Any form of ``support`` texts that stands in toxic ones more often than by chance is a candidate, whatever its
    share; the tail takes them up to ``size`` bytes, those first that say most about texts with few others.
    """
    bad = [t for t, y in zip(texts, toxic, strict=True) if y]
    n_fine = len(texts) - len(bad)
    # Counted first and looked at closely after, so that few forms are held with all they stand for.
    seen: Counter[str] = Counter()
    for t in bad:
        seen.update(starts(t))
    often = {w: n for w, n in seen.items() if n >= support}
    del seen
    fine: Counter[str] = Counter()
    words: Counter[str] = Counter()
    for t, y in zip(texts, toxic, strict=True):
        if not y:
            fine.update(starts(t) & often.keys())
            words.update(WORD.findall(t.lower()))
    odds = {w: np.log((n + 0.5) / (len(bad) + 1)) - np.log((fine[w] + 0.5) / (n_fine + 1)) for w, n in often.items()}
    # Of all forms looked at, one at most is to be expected among the candidates by chance (Chernoff bound).
    share, enough = len(bad) / max(1, len(texts)), np.log(max(1, len(often)))
    odds = {w: x for w, x in odds.items() if x > 2.5 and surprise(often[w], often[w] + fine[w], share) >= enough}
    del often
    where: dict[str, list[int]] = defaultdict(list)
    for i, t in enumerate(bad):
        for w in starts(t) & odds.keys():
            where[w].append(i)
    covered, chosen, used = [0] * len(bad), [], 0
    bases, heads = set(), set()

    def worth(w: str) -> float:
        return odds[w] * sum(1 / (1 + covered[i]) for i in where[w])

    # Worth only falls while texts get covered, so a candidate is weighed again when it comes first.
    queue = [(-worth(w), -len(w), w) for w in where]
    heapify(queue)
    while queue:
        before, _, w = heappop(queue)
        base = w.rstrip()
        # A start of the chosen, or a longer form of it, tells nothing new.
        if base in heads or any(base[:k] in bases for k in range(2, len(base) + 1)):
            continue
        now = -worth(w)
        if now > before:
            heappush(queue, (now, -len(w), w))
            continue
        entry = ending(base)
        if used + len(entry) > size:
            break
        chosen.append(entry)
        used += len(entry)
        bases.add(base)
        heads.update(base[:k] for k in range(2, len(base) + 1))
        for i in where[w]:
            covered[i] += 1
    tail = b"".join(reversed(chosen))
    ranked = [w for w, _ in words.most_common(8000)]
    common = "".join(" " + w for w in reversed(ranked[:400])).encode()
    rare = "".join(" " + w for w in ranked[3000:] or ranked[400:]).encode()
    pad = (rare + b" " * len(tail))[: len(tail)]
    # zstd takes no dictionary of under eight bytes.
    return common + tail + b" " * 8, common + pad + b" " * 8


def surprise(k: int, n: int, share: float) -> float:
    """Lower bound of minus the logarithm of the chance that ``k`` or more of ``n`` texts are toxic, ``share`` being."""
    part = k / n
    if part <= share:
        return 0.0
    return n * (part * np.log(part / share) + ((1 - part) * np.log((1 - part) / (1 - share)) if part < 1 else 0.0))


def ending(base: str) -> bytes:
    """A form as it stands in the dictionary: one too short to match by itself comes with what may follow it."""
    raw = base.encode("utf-8", "surrogatepass")
    return raw + b" " if len(raw) >= 5 else raw + b"." + raw + b"," + raw + b" "


def fit(texts: list[str], toxic: list[int], ridge: float = 0.3) -> ToxicityModel:
    """Dictionaries from three fifths of the sample's rows without copies, calibration on the others."""
    rows = representatives(texts, toxic)
    texts, toxic = [texts[i] for i in rows], [toxic[i] for i in rows]
    part = [i % 5 < 3 for i in range(len(texts))]
    model = ToxicityModel(*dictionaries([t for t, p in zip(texts, part, strict=True) if p], [y for y, p in zip(toxic, part, strict=True) if p]))
    rest = [i for i, p in enumerate(part) if not p]
    y = np.array([toxic[i] for i in rest], float)
    if not rest or y.min() == y.max():
        model.weight[-1] = 4.0 if len(y) and y.min() == 1 else -4.0
        return model
    ordinary, bad = model.compressors()
    x = np.array([summary(distances(texts[i], ordinary, bad)) for i in rest])
    model.mean, model.scale = x.mean(axis=0), x.std(axis=0) + 1e-6
    a, w = np.c_[(x - model.mean) / model.scale, np.ones(len(x))], np.zeros(FEATURES + 1)
    penalty = ridge * np.r_[np.ones(FEATURES), 1e-6]
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -40, 40)))
        h = (a * (p * (1 - p))[:, None]).T @ a + np.diag(penalty + 1e-9)
        w = w - np.linalg.solve(h, a.T @ (p - y) + penalty * w)
    model.weight = w
    return model


def train(docs: DataFrame, labels: DataFrame, usable: Column, text_col: str = "text", id_col: str = "doc_id", label_col: str = "toxic", max_each: int = 3500, seed: str = "toxicity", passage: int = 50_000) -> ToxicityModel:
    """Fit on at most about ``max_each`` distinct labelled texts of each kind among the ``usable`` rows, and on a passage
    of ``passage`` characters of longer ones (documented bounds).  An id labelled both ways counts as toxic."""
    marked = labels.where(usable & F.col(label_col).isNotNull()).groupBy(id_col).agg(F.max(F.col(label_col).cast("int")).alias("label"))
    # One row for each distinct text, so that a large group of copies does not fill the sample.
    digests = docs.select(id_col, F.md5(F.coalesce(text_col, F.lit(""))).alias("digest"))
    marked = materialize(marked.join(digests, id_col).groupBy("label", "digest").agg(F.min(id_col).alias(id_col)).select(id_col, "label"), "toxicity-texts")
    sizes = {r[0]: r[1] for r in marked.groupBy("label").count().collect()}
    share = F.when(F.col("label") == 1, min(1.0, max_each / max(1, sizes.get(1, 0)))).otherwise(min(1.0, max_each / max(1, sizes.get(0, 0))))
    u = unit_hash(F.col(id_col), F.lit(seed))
    few = marked.where(u < share).withColumn("u", u).limit(4 * max_each)
    rows = docs.select(id_col, passage_of(F.coalesce(text_col, F.lit("")), passage).alias("text")).join(F.broadcast(few), id_col).select("u", "label", "text").toArrow().sort_by("u")
    return fit(rows.column("text").to_pylist(), rows.column("label").to_pylist())


def score(docs: DataFrame, model: ToxicityModel, text_col: str = "text", score_col: str = "toxic_score") -> DataFrame:
    """``docs`` with ``score_col`` double in [0, 1] to nine places, higher for text likelier toxic.

    Null and empty texts have one empty window and are scored by it; equal texts score equally; an existing
    ``score_col`` is replaced and other columns pass through.
    """

    def make():
        ordinary, toxic = model.compressors()
        return lambda texts: [np.round(model.probability(np.array([summary(distances(t or "", ordinary, toxic)) for t in texts])), 9).tolist()]

    return append_columns(docs, text_col, make, [field(score_col, "double")])
