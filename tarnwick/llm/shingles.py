"""Word shingles as 64-bit hashes, computed over whole batches of texts in numpy."""

from __future__ import annotations

import numpy as np

_rng = np.random.default_rng(20240501)
#: A random 64-bit value for each byte; A-Z take those of a-z, the separators 0.
BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
BYTE[65:91] = BYTE[97:123]
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Bytes hashed at a time: temporary arrays take about 40 bytes a byte of a piece, however long a text is.
PIECE = 1 << 20
BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
STEP = np.uint64(0xD6E8FEB86659FD93)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xA0761D6478BD642F)
    return x ^ (x >> np.uint64(32))


def _words(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each word begins, and its hash: its bytes' values times powers of an odd base, by place in the word."""
    blank = SPACE[raw]
    begin = np.nonzero(~blank & np.r_[True, blank[:-1]])[0]
    end = np.nonzero(np.r_[blank, True] & ~np.r_[True, blank])[0]
    if not begin.size:
        return begin, np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        place = np.arange(raw.size)
        place[begin[0] :] -= np.repeat(begin, np.diff(np.r_[begin, raw.size]))
        longest = int((end - begin).max())
        power = np.cumprod(np.r_[np.uint64(1), np.full(longest, BASE, np.uint64)])
        value = BYTE[raw] * power[np.minimum(place, longest)]
        value[blank] = 0
        total = np.r_[np.uint64(0), np.cumsum(value, dtype=np.uint64)]
        return begin, mix(total[end] - total[begin] + (end - begin).astype(np.uint64))


def _long_word(raw: np.ndarray) -> np.uint64:
    """The hash of one word of any length."""
    total, scale = 0, 1
    step = pow(int(BASE), PIECE, 1 << 64)
    with np.errstate(over="ignore"):
        power = np.cumprod(np.r_[np.uint64(1), np.full(PIECE - 1, BASE, np.uint64)])
        for a in range(0, raw.size, PIECE):
            part = BYTE[raw[a : a + PIECE]]
            total += int((part * power[: part.size]).sum(dtype=np.uint64)) * scale
            scale = scale * step % (1 << 64)
        return mix(np.array([(total + raw.size) % (1 << 64)], np.uint64))[0]


def words_of(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """As ``_words``, in pieces that end at a blank."""
    if raw.size <= PIECE:
        return _words(raw)
    begins, hashes, at = [], [], 0
    while at < raw.size:
        stop = min(raw.size, at + PIECE)
        if stop < raw.size:
            blanks = np.nonzero(SPACE[raw[at:stop]])[0]
            if blanks.size:
                stop = at + int(blanks[-1]) + 1
            else:  # within one long word
                while stop < raw.size and not (more := SPACE[raw[stop : stop + PIECE]]).any():
                    stop += more.size
                stop += int(more.argmax()) if stop < raw.size else 0
                begins.append(np.array([at]))
                hashes.append(np.array([_long_word(raw[at:stop])], np.uint64))
                at = stop
                continue
        begin, h = _words(raw[at:stop])
        begins.append(begin + at)
        hashes.append(h)
        at = stop
    return np.concatenate(begins), np.concatenate(hashes)


def shingle_sets(texts: list[str], size: int = 5) -> list[np.ndarray]:
    """Sorted distinct hashes of each text's shingles of ``size`` words.

    Words are runs of bytes other than space and 0x09-0x0D, A-Z lower-cased.  A text with fewer words has its whole
    sequence as one shingle; without words it has none.  Texts of any length are hashed in pieces.
    """
    parts = [t.encode("utf-8", "surrogatepass") for t in texts]
    begin, word = words_of(np.frombuffer(b" ".join(parts) + b" ", np.uint8))
    if not begin.size:
        return [np.zeros(0, np.uint64) for _ in texts]
    with np.errstate(over="ignore"):
        roll = np.zeros(max(0, word.size - size + 1), np.uint64)
        for i in range(size):
            roll = roll * STEP + word[i : word.size - size + 1 + i] if roll.size else roll
        roll = mix(roll)
    first = np.searchsorted(begin, np.cumsum([0, *[len(p) + 1 for p in parts]]))
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= size:
            out.append(np.unique(roll[a : b - size + 1]))
        elif b > a:
            h = np.uint64(b - a)
            with np.errstate(over="ignore"):
                for w in word[a:b]:
                    h = h * STEP + w
                out.append(mix(np.array([h ^ np.uint64(0x5BD1E995)], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
