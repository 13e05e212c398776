"""PartEnum signatures for sets with Jaccard similarity of at least a threshold.

Sizes fall into bands of ratio 1/threshold; in band ``t`` two similar sets, the smaller one of band ``t``, differ in
at most k elements.  The feature domain is cut into ``n1`` partitions of ``n2`` parts each.  As at most k elements
differ, enough partitions differ in at most ``k2`` elements, hence agree on some ``n2 - k2`` of their parts: each such
subset of parts is hashed to a signature, and similar sets share one.

A subset whose parts are all empty says nothing, so its signature is left out.  That is safe: a partition can only be
lost for a set if at most ``k2`` of its parts hold elements ("thin"), ``n1`` is larger than needed by ``spare``, and
a set with more than ``spare`` thin partitions also takes part in the next family of partitions.  Two sets that are
both thin in every family meet in signatures of empty subsets, emitted only then.

Leaving some features out of the domain loses no pair either, as sets differ in no more elements on a part of it.  So
the first family leaves out features known to be common: texts that share but a passage of many texts then share no
signature.  Which features those are affects only how many dissimilar sets meet.
"""

from __future__ import annotations

import functools
from itertools import combinations

import numpy as np

from .shingles import mix

FAMILIES = 5
#: Leading bits of a feature that the map of common features looks at.
MAP_BITS = 22


def common_map(features: np.ndarray) -> np.ndarray:
    """A map of common features by their leading bits; a few others fall in, which does no harm."""
    out = np.zeros(1 << MAP_BITS, bool)
    out[(features >> np.uint64(64 - MAP_BITS)).astype(np.int64)] = True
    return out


@functools.lru_cache(maxsize=64)
def bands(num: int, den: int, most: int) -> tuple[tuple[int, int], ...]:
    """(lowest, highest) size of each band, until a band holds ``most``."""
    out, lo = [], 1
    while not out or out[-1][1] < most:
        hi = max(lo, lo * den // num)
        out.append((lo, hi))
        lo = hi + 1
    return tuple(out)


@functools.lru_cache(maxsize=4096)
def shape(hi: int, num: int, den: int) -> tuple[int, int, int, int, int]:
    """k, n1, k2, n2 and spare of the band whose highest size is ``hi``.

    With overlap o of sets r and s, J >= num/den means |r| + |s| - 2o <= (|r| + |s|) (den - num) / (den + num), and
    |s| <= |r| den / num makes that at most |r| (den - num) / num.
    """
    k = hi * (den - num) // num
    if k <= 4:
        return k, 1, k, k + 3, 0
    need = k // 2 + 1
    spare = -(-need * 3 // 10) + 2
    return k, need + spare, 1, 3, spare


def signatures(sets: list[np.ndarray], num: int = 3, den: int = 4, common: np.ndarray | None = None):
    """Signatures of each set: index of the set and 64-bit signature, as two arrays."""
    rare = sets if common is None else [s[~common[(s >> np.uint64(64 - MAP_BITS)).astype(np.int64)]] for s in sets]
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    if not sizes.size or not sizes.max():
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    table = bands(num, den, int(sizes.max()))
    own = np.searchsorted(np.array([hi for _, hi in table]), sizes)
    whose, sigs = [], []
    for t, (_, hi) in enumerate(table):
        members = np.nonzero(((own == t) | (own == t + 1)) & (sizes > 0))[0]
        k, *_ = shape(hi, num, den)
        if not members.size or not k:  # k = 0: only equal sets, which are one class anyway
            continue
        # The larger set has at most hi * den / num elements.
        members = members[sizes[members] <= hi * den // num]
        for family in range(FAMILIES):
            if not members.size:
                break
            domain = sets if family else rare
            w, s, members = _family([domain[i] for i in members], members, t, family, hi, num, den)
            whose.append(w)
            sigs.append(s)
    if not whose:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return np.concatenate(whose), np.concatenate(sigs)


def _family(sets, members, band: int, family: int, hi: int, num: int, den: int):
    k, n1, k2, n2, spare = shape(hi, num, den)
    with np.errstate(over="ignore"):
        salt = mix(np.array([(band << 8) | family], np.uint64))[0]
        h = np.concatenate(sets)
        doc = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        place = mix(h ^ salt)
        cell = ((place >> np.uint64(32)) * np.uint64(n1 * n2) >> np.uint64(32)).astype(np.int64) + doc * (n1 * n2)
        n = len(sets) * n1 * n2
        # Sums of 32-bit halves stay exact in doubles up to 2^21 elements.
        low = np.bincount(cell, (h & np.uint64(0xFFFFFFFF)).astype(np.float64), n)
        high = np.bincount(cell, (h >> np.uint64(32)).astype(np.float64), n)
        part = (low.astype(np.uint64) + (high.astype(np.uint64) << np.uint64(32))).reshape(len(sets), n1, n2)
        full = part != 0
        thin = (full.sum(axis=2) <= k2).sum(axis=1)
        part = mix(part ^ salt)
        onward = thin > spare
        whose, sigs = [], []
        at = mix((np.arange(n1, dtype=np.uint64) << np.uint64(20)) ^ salt)[None, :]
        for c, kept in enumerate(combinations(range(n2), n2 - k2)):
            s = at + np.uint64(c)
            for j in kept:
                s = s * np.uint64(0x9E3779B97F4A7C15) + part[:, :, j]
            some = full[:, :, list(kept)].any(axis=2)
            if family == FAMILIES - 1:
                some |= onward[:, None]
            d, p = np.nonzero(some)
            whose.append(members[d])
            sigs.append(s[d, p])
        return np.concatenate(whose), mix(np.concatenate(sigs)), members[onward]
