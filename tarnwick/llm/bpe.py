"""Byte-level BPE in numpy: rank-synchronous merging over ragged arrays, and speculate-and-verify encoding.

A tokenizer file is a parameter; nothing is trained or copied.  Both encoders work on distinct pre-tokens and keep a
bounded memo of results, so a frequent word is merged once per worker.
"""

from __future__ import annotations

import functools
import json

import numpy as np
import regex

#: The published byte-level pre-tokenizer pattern.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
NEVER = np.int32(2**31 - 1)
#: Memo entries a worker keeps before it starts anew, and characters up to which a pre-token is kept.
MEMO, LONG = 200_000, 128


def byte_alphabet() -> dict[str, int]:
    """Printable stand-ins of the 256 bytes in byte-level vocabularies: a visible Latin-1 character stands for itself,
    the others follow from U+0100 on."""
    visible = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = [b for b in range(256) if b not in visible]
    return {chr(b): b for b in visible} | {chr(0x100 + i): b for i, b in enumerate(hidden)}


def refuse(spec: dict) -> None:
    """Raise on a tokenizer file with settings that this encoder does not follow."""
    model, pre = spec["model"], spec.get("pre_tokenizer") or {}
    odd = {
        "model type": model.get("type", "BPE") != "BPE",
        "normalizer": spec.get("normalizer") is not None,
        "pre-tokenizer": pre.get("type") != "ByteLevel" or not pre.get("use_regex", True),
        "prefix space": bool(pre.get("add_prefix_space")),
        "affixes": bool(model.get("continuing_subword_prefix") or model.get("end_of_word_suffix")),
        "dropout": bool(model.get("dropout")),
        "ignore_merges": bool(model.get("ignore_merges")),
        "added token rules": any(t.get(k) for t in spec["added_tokens"] for k in ("lstrip", "rstrip", "single_word")),
    }
    if any(odd.values()):
        raise ValueError("unsupported tokenizer file: " + ", ".join(k for k, v in odd.items() if v))


class PairTable:
    """A hash table from (left id, right id) to rank with vectorised lookups; open addressing at low load."""

    def __init__(self, left: np.ndarray, right: np.ndarray, rank: np.ndarray):
        bits = max(10, (8 * len(rank)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys = np.full(1 << bits, -1, np.int64)
        self.ranks = np.full(1 << bits, NEVER, np.int32)
        key = (left.astype(np.int64) << 32) | right
        for k, s, r in zip(key.tolist(), self._slot(key).tolist(), rank.tolist(), strict=True):
            while self.keys[s] >= 0:
                s = (s + 1) & self.mask
            self.keys[s], self.ranks[s] = k, r

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def __call__(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = (left.astype(np.int64) << 32) | right
        slot = self._slot(key)
        seen = self.keys[slot]
        out = np.where(seen == key, self.ranks[slot], NEVER)
        todo = np.nonzero((seen != key) & (seen >= 0))[0]
        while todo.size:
            slot[todo] = (slot[todo] + 1) & self.mask
            seen = self.keys[slot[todo]]
            hit = seen == key[todo]
            out[todo[hit]] = self.ranks[slot[todo[hit]]]
            todo = todo[~hit & (seen >= 0)]
        return out


class ByteBPE:
    """A byte-level BPE vocabulary from a tokenizers JSON file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        refuse(spec)
        alphabet, vocab = byte_alphabet(), spec["model"]["vocab"]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        size = 1 + max([*vocab.values(), *self.specials.values()])
        self.bytes_of: list[bytes] = [b""] * size
        for token, i in vocab.items():
            self.bytes_of[i] = bytes(alphabet[c] for c in token)
        for token, i in self.specials.items():
            self.bytes_of[i] = token.encode()
        self.of_byte = np.zeros(256, np.int32)
        for c, b in alphabet.items():
            self.of_byte[b] = vocab[c]
        self.left = np.array([vocab[a] for a, _ in pairs], np.int32)
        self.right = np.array([vocab[b] for _, b in pairs], np.int32)
        self.merged = np.array([vocab[a + b] for a, b in pairs], np.int32)
        self.rank = PairTable(self.left, self.right, np.arange(len(pairs), dtype=np.int32))
        self.made_at = np.full(size, -1, np.int32)  # rank of the merge that makes a token; -1 for single bytes
        self.made_at[self.merged] = np.arange(len(pairs), dtype=np.int32)
        self.words = regex.compile(PATTERN)
        self.special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.specials, key=len, reverse=True))) + ")") if self.specials else None
        self.size_of = np.fromiter(map(len, self.bytes_of), np.int64, size)

    @functools.cached_property
    def matcher(self):
        """Leftmost-longest matching of the vocabulary."""
        import ahocorasick

        out = ahocorasick.Automaton()
        for i, b in enumerate(self.bytes_of):
            if b and i not in self.specials.values():
                out.add_word(b.decode("latin-1"), i)
        out.make_automaton()
        return out

    # -- pre-tokens ------------------------------------------------------------------------------------------------
    def pieces(self, text: str) -> list[str]:
        """Pre-tokens in order.  A special token's string stays one piece, as in the library's default."""
        if self.special and any(s in text for s in self.specials):
            out: list[str] = []
            for i, part in enumerate(self.special.split(text)):
                out += [part] if i % 2 else self.words.findall(part)
            return out
        return self.words.findall(text)

    # -- rank-synchronous merging ----------------------------------------------------------------------------------
    def merge(self, words: list[bytes], want_ids: bool = True):
        """Merge all words at once: every round applies each word's own lowest-rank pair everywhere in that word.

        Returns the number of symbols left for each word, and the ids one after another if ``want_ids``.
        """
        n = len(words)
        length = np.fromiter(map(len, words), np.int64, n)
        counts, kept = length.copy(), []
        sym = self.of_byte[np.frombuffer(b"".join(words), np.uint8)]
        owner = np.repeat(np.arange(n), length)
        rank = self._ranks(sym, owner)
        while sym.size:
            start = np.nonzero(np.r_[True, owner[1:] != owner[:-1]])[0]
            lowest = np.minimum.reduceat(rank, start)
            size = np.diff(np.r_[start, sym.size])
            over = lowest == NEVER
            if over.any():
                if want_ids:
                    gone = np.repeat(over, size)
                    kept.append((owner[gone], sym[gone]))
                stay = np.repeat(~over, size)
                sym, owner, rank = sym[stay], owner[stay], rank[stay]
                lowest, size = lowest[~over], size[~over]
                if not sym.size:
                    break
            chosen = rank == np.repeat(lowest, size)
            # Of overlapping choices, as in "aaa", every second one counts from the left.
            at = np.nonzero(chosen)[0]
            new_run = np.r_[True, np.diff(at) != 1]
            if not new_run.all():
                run_start = np.maximum.accumulate(np.where(new_run, np.arange(at.size), 0))
                at = at[(np.arange(at.size) - run_start) % 2 == 0]
            sym[at] = self.merged[rank[at]]
            counts -= np.bincount(owner[at], minlength=n)
            keep = np.ones(sym.size, bool)
            keep[at + 1] = False
            place = np.cumsum(keep) - 1
            sym, owner, rank = sym[keep], owner[keep], rank[keep]
            touched = np.zeros(sym.size, bool)
            touched[place[at]] = touched[np.maximum(place[at] - 1, 0)] = True
            stale = np.nonzero(touched)[0]
            rank[stale] = self._ranks_at(sym, owner, stale)
        if not want_ids:
            return counts, None
        if not kept:
            return counts, np.zeros(0, np.int32)
        whose, ids = np.concatenate([k[0] for k in kept]), np.concatenate([k[1] for k in kept])
        return counts, ids[np.argsort(whose, kind="stable")]

    def _ranks(self, sym: np.ndarray, owner: np.ndarray) -> np.ndarray:
        return self._ranks_at(sym, owner, np.arange(sym.size))

    def _ranks_at(self, sym: np.ndarray, owner: np.ndarray, at: np.ndarray) -> np.ndarray:
        out = np.full(at.size, NEVER, np.int32)
        inner = at < sym.size - 1
        inner[inner] = owner[at[inner]] == owner[at[inner] + 1]
        out[inner] = self.rank(sym[at[inner]], sym[at[inner] + 1])
        return out

    # -- speculate and verify --------------------------------------------------------------------------------------
    @functools.cached_property
    def sound(self) -> np.ndarray:
        """Whether a token's own bytes merge to just that token."""
        some = [i for i, b in enumerate(self.bytes_of) if b and i not in self.specials.values()]
        counts, ids = self.merge([self.bytes_of[i] for i in some])
        out = np.zeros(len(self.bytes_of), bool)
        first = np.cumsum(counts) - counts
        out[some] = (counts == 1) & (ids[first] == np.array(some))
        return out

    def compatible(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Whether two tokens may stand side by side: no merge across the seam comes before those that made them.

        Merges inside both tokens are undone from the latest to the earliest; each state's seam pair must not have a
        lower rank than the merges that consume its two sides.
        """
        a, b = left.astype(np.int64), right.astype(np.int64)
        ok = np.ones(a.size, bool)
        eaten_a, eaten_b = np.full(a.size, NEVER, np.int64), np.full(a.size, NEVER, np.int64)
        live = np.arange(a.size)
        while live.size:
            x, y = a[live], b[live]
            r = self.rank(x, y).astype(np.int64)
            # Equal ranks occur in runs of one symbol, where the leftmost pair goes first.
            bad = (r != NEVER) & (r < eaten_a[live]) & (r <= eaten_b[live])
            ok[live[bad]] = False
            made_x, made_y = self.made_at[x], self.made_at[y]
            go = ~bad & ((made_x >= 0) | (made_y >= 0))
            live, x, y, made_x, made_y = live[go], x[go], y[go], made_x[go], made_y[go]
            undo_a = made_x > made_y
            la, lb = live[undo_a], live[~undo_a]
            eaten_a[la], a[la] = made_x[undo_a], self.right[made_x[undo_a]]
            eaten_b[lb], b[lb] = made_y[~undo_a], self.left[made_y[~undo_a]]
        return ok

    def speculate(self, words: list[bytes]) -> list[bytes]:
        """Ids of each word as little-endian uint32: longest match proposes, the seam check verifies, failing words merge."""
        size = np.fromiter(map(len, words), np.int64, len(words))
        # Bytes as Latin-1 characters; the separator is in no token, so no match spans two words.
        found = np.fromiter(self.matcher.iter_long("\u0100".join([w.decode("latin-1") for w in words])), [("end", "<i8"), ("id", "<i8")])
        proposed = np.ascontiguousarray(found["id"])
        whose = np.searchsorted(np.cumsum(size + 1), found["end"], side="right")
        count = np.bincount(whose, minlength=len(words))
        failing = np.zeros(len(words), bool)
        failing[whose[~self.sound[proposed]]] = True
        failing |= np.bincount(whose, self.size_of[proposed], len(words)) != size
        seam = np.nonzero(whose[1:] == whose[:-1])[0]
        if seam.size:
            key, back = np.unique((proposed[seam] << 32) | proposed[seam + 1], return_inverse=True)
            fits = self.compatible(key >> 32, key & 0xFFFFFFFF)
            failing[whose[seam[~fits[back]]]] = True
        raw = proposed.astype("<u4").tobytes()
        ends = np.cumsum(count) * 4
        out = [raw[e - 4 * c : e] for e, c in zip(ends.tolist(), count.tolist(), strict=True)]
        redo = np.nonzero(failing)[0].tolist()
        if redo:
            counts, exact = self.merge([words[w] for w in redo])
            raw, ends = exact.astype("<u4").tobytes(), np.cumsum(counts) * 4
            for w, e, c in zip(redo, ends.tolist(), counts.tolist(), strict=True):
                out[w] = raw[e - 4 * c : e]
        return out


@functools.lru_cache(maxsize=2)
def bpe(path: str) -> ByteBPE:
    return ByteBPE(path)


def forget(memo: dict, pieces: list[str]) -> None:
    """Long pre-tokens leave the memo with their batch, so that its entries bound its bytes."""
    for piece in pieces:
        if len(piece) > LONG:
            del memo[piece]


class Counter:
    """Token counts of texts through a bounded memo of pre-tokens."""

    def __init__(self, path: str, memo: int = MEMO):
        self.bpe, self.memo, self.most = bpe(path), {}, memo

    def __call__(self, texts: list[str]) -> list[int]:
        pieces = [self.bpe.pieces(t) for t in texts]
        if len(self.memo) > self.most:
            self.memo.clear()
        self.memo.update(dict.fromkeys(self.bpe.specials, 1))
        fresh = list(set().union(*pieces).difference(self.memo)) if pieces else []
        if fresh:
            counts, _ = self.bpe.merge([w.encode("utf-8", "surrogatepass") for w in fresh], want_ids=False)
            self.memo.update(zip(fresh, counts.tolist(), strict=True))
        out = [sum(map(self.memo.__getitem__, p)) for p in pieces]
        forget(self.memo, fresh)
        return out


class Codec:
    """Encoding by speculate-and-verify, and decoding, through a bounded memo of pre-tokens."""

    def __init__(self, path: str, memo: int = MEMO // 2):
        self.bpe, self.memo, self.most = bpe(path), {}, memo

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids as little-endian uint32, one bytes object a text."""
        pieces = [self.bpe.pieces(t) for t in texts]
        if len(self.memo) > self.most:
            self.memo.clear()
        self.memo.update({s: int(i).to_bytes(4, "little") for s, i in self.bpe.specials.items()})
        fresh = list(set().union(*pieces).difference(self.memo)) if pieces else []
        if fresh:
            self.memo.update(zip(fresh, self.bpe.speculate([w.encode("utf-8", "surrogatepass") for w in fresh]), strict=True))
        out = [b"".join(map(self.memo.__getitem__, p)) for p in pieces]
        forget(self.memo, fresh)
        return out

    def decode(self, ids: bytes) -> bytes:
        """The bytes the ids stand for, with malformed sequences replaced as text decoders do."""
        raw = b"".join(map(self.bpe.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist()))
        return raw.decode("utf-8", "replace").encode()
