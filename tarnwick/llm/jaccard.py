"""Operator 3, n-gram Jaccard join: PartEnum signatures, verified exactly, joined into components.

1. One pass over the texts gives each document's set size, a 128-bit key of its shingle set and a parity sketch.
   Documents with equal keys are one class, which its smallest document stands for.
2. A second pass makes the signatures.  A batch of documents sends each hash partition one packed block (32-bit
   signatures, ids as short offsets), six to twelve bytes a signature.  A partition sorts its signatures in bounded
   runs; documents that share one are tied to the first of them, the leader.  A tie carries a 64-bit mask of the
   signatures, hashed, at which three documents or more met.
3. Each document's best tie is checked first, and gives components; then the ties that still cross components.  The
   check is by sketch, as flipped parity bits never exceed the true set difference, so no similar pair is lost, and
   then on the whole texts.  Both send a leader once to each block of its fellows, so a leader of any number of ties is
   spread and its set is not repeated for each.
4. A signature at which two documents met is settled by their tie.  Where more met, fellows of one leader may be
   similar to one another.  If a tie of a leader crossed components, its fellows of different components whose masks
   overlap are compared with each other by sketch, in blocks, and the survivors verified.  So no link is missed.
5. Components come from the verified links; copies follow their class.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, append_columns, bounded_batches, field, materialize, release, slices, unit_hash, whole_groups
from .components import components
from .partenum import MAP_BITS, common_map, signatures
from .shingles import mix, shingle_sets

#: Documents and signatures of one packed block set at most.
BLOCK_DOCS, BLOCK_SIGNATURES = 4096, 700_000
#: Signatures a reducing task is meant to get, and sorts at a time; and how many tasks there are at most.  Past that each
#: task has its signatures sorted into ranges by Spark, which spills, and takes one range after the other.
TASK, RUN, TASKS = 1_000_000, 1_500_000, 50_000
#: Documents looked at to find common shingles, and in how many of them a common one stands.  A hint that saves
#: comparisons: no result depends on it.
HINT_DOCS, HINT_TIMES = 8000, 3
#: Rows of ids or ties up to which they are broadcast (24 bytes each at most); beyond it the join is shuffled.
BROADCAST_IDS = 1_000_000
#: Fellows that one copy of their leader meets, and rows of a block of step 4.
STAR_BLOCK, PAIR_BLOCK = 256, 1024

def sketch(hashes: np.ndarray) -> bytes:
    """Parity of the elements in each of 2^j buckets, with as many buckets as elements or more, 128 to 8192."""
    bits = 1 << min(13, max(7, int(len(hashes) - 1).bit_length() if len(hashes) else 7))
    at = (mix(hashes ^ np.uint64(0xC2B2AE3D27D4EB4F)) & np.uint64(bits - 1)).astype(np.int64)
    return np.packbits((np.bincount(at, minlength=bits) & 1).astype(np.uint8), bitorder="little").tobytes()


def flipped(a: bytes, b: bytes) -> int:
    """Differing bits, the longer sketch folded onto the shorter: at most the size of the set difference."""
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    while x.size > y.size:
        x = x[: x.size // 2] ^ x[x.size // 2 :]
    while y.size > x.size:
        y = y[: y.size // 2] ^ y[y.size // 2 :]
    return int(np.bitwise_count(x ^ y).sum())


def may_link(na: int, nb: int, differ: int, num: int, den: int) -> bool:
    """Whether sets of these sizes that differ in ``differ`` elements or more can reach the threshold."""
    return den * min(na, nb) >= num * max(na, nb) and (na + nb) * (den - num) >= differ * (den + num)


def describe(docs: DataFrame, words: int = 5) -> DataFrame:
    """(doc_id, n_shingles, set_key, sketch) of each document's whole text; set_key and sketch are null for empty sets."""

    def make():
        def run(texts):
            sets = shingle_sets([t or "" for t in texts], words)
            return [
                [len(s) for s in sets],
                [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets],
                [sketch(s) if len(s) else None for s in sets],
            ]

        return run

    return append_columns(docs, "text", make, [field("n_shingles", "long"), field("set_key", "binary"), field("sketch", "binary")]).drop("text")


def _common(docs: DataFrame, total: int, words: int) -> np.ndarray:
    """Map of the shingles that stand in several of the documents looked at."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            for a, b in slices(texts):
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(shingle_sets(texts[a:b], words)).view(np.int64))], names=["h"])

    some = docs.where(unit_hash(F.col("doc_id"), F.lit("hint")) < min(1.0, HINT_DOCS / max(1, total))).select("text")
    often = some.mapInArrow(run, "h long").groupBy("h").count().where(F.col("count") >= HINT_TIMES)
    leading = often.select(F.shiftrightunsigned("h", 64 - MAP_BITS).alias("m")).distinct()  # 2^MAP_BITS rows at most
    return common_map(leading.toArrow().column("m").to_numpy().astype(np.uint64) << np.uint64(64 - MAP_BITS))


def _even_keys(spark: SparkSession, parts: int) -> np.ndarray:
    """For each of ``parts`` hash partitions a key that falls into it, so that blocks are dealt out one to one."""
    tried = spark.range(32 * parts).select(F.col("id").cast("int").alias("k"))
    found = tried.groupBy(F.pmod(F.hash("k"), F.lit(parts)).alias("at")).agg(F.min("k").alias("k")).toArrow()
    keys = np.arange(parts, dtype=np.int64) + 32 * parts  # in the rare case that no key was found
    keys[found.column("at").to_numpy()] = found.column("k").to_numpy()
    return keys


def planes(x: np.ndarray, width: int) -> bytes:
    """The low ``width`` bytes of little-endian integers, byte by byte: leading bytes of sorted ones pack well."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), -1)[:, :width].T).tobytes()


def unplanes(data: bytes, width: int) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8).reshape(width, -1)
    out = np.zeros((raw.shape[1], 8), np.uint8)
    out[:, :width] = raw.T
    return out.view(np.uint64).ravel()


def _blocks(docs: DataFrame, words: int, num: int, den: int, parts: int, common: np.ndarray, keys: np.ndarray) -> DataFrame:
    """(bucket, base, width, sigs, local, ids): packed signatures by hash partition.

    ``ids`` are offsets from ``base`` in ``width`` bytes: one a signature, or, where ``local`` is set, one a document
    with ``local`` naming the document of each signature.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list[int] = []
        seen: set[bytes] = set()
        whose: list[np.ndarray] = []
        sigs: list[np.ndarray] = []
        held = 0

        def flush():
            w, s, of = np.concatenate(whose).astype(np.uint16), np.concatenate(sigs), np.array(ids, np.int64)
            base = int(of.min())
            of = (of - base).view(np.uint64)  # wraps like the addition that undoes it
            width = max(1, -(-int(of.max()).bit_length() // 8))
            # The low bits choose the partition, the upper 32 stay as the signature.
            bucket = ((s & np.uint64(0xFFFFFF)) * np.uint64(parts) >> np.uint64(24)) << np.uint64(32)
            s >>= np.uint64(32)
            bucket |= s
            order = np.argsort(bucket)
            w, bucket = w[order], bucket[order]
            del order, s
            ends = np.searchsorted(bucket, np.arange(parts + 1, dtype=np.uint64) << np.uint64(32))
            cols: list[list] = [[] for _ in range(6)]
            for p in range(parts):
                a, b = ends[p], ends[p + 1]
                if a < b:
                    used, local = np.unique(w[a:b], return_inverse=True)
                    few = 2 * (b - a) + width * used.size < width * (b - a)
                    row = (int(keys[p]), base, width, planes(bucket[a:b], 4), local.astype("<u2").tobytes() if few else None, planes(of[used if few else w[a:b]], width))
                    for c, v in zip(cols, row, strict=True):
                        c.append(v)
            kinds = [pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["bucket", "base", "width", "sigs", "local", "ids"])

        for batch in batches:
            doc_ids, texts = (batch.column(n).to_pylist() for n in ("doc_id", "text"))
            for a, b in slices([t or "" for t in texts]):
                sets = shingle_sets([t or "" for t in texts[a:b]], words)
                fresh = []
                for i, s in enumerate(sets):
                    if len(s) and doc_ids[a + i] is not None:
                        key = hashlib.blake2b(s.tobytes(), digest_size=16).digest()
                        if key not in seen:  # copies within a block send their signatures once
                            seen.add(key)
                            fresh.append(i)
                for c in range(0, len(fresh), 512):
                    some = fresh[c : c + 512]
                    w, s = signatures([sets[i] for i in some], num, den, common)
                    if held and (len(ids) + len(some) > BLOCK_DOCS or held + s.size > BLOCK_SIGNATURES):
                        yield flush()
                        ids, whose, sigs, held = [], [], [], 0
                        seen = set()
                    whose.append(w + len(ids))
                    sigs.append(s)
                    held += s.size
                    ids += [doc_ids[a + i] for i in some]
            del batch, texts
            release()
        if held:
            yield flush()

    return docs.select("doc_id", "text").mapInArrow(run, "bucket int, base long, width int, sigs binary, local binary, ids binary")


def _merged(lead: np.ndarray, other: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each tie once, its masks united."""
    if not lead.size:
        return lead, other, mask
    order = np.lexsort((other, lead))
    lead, other = lead[order], other[order]
    start = np.nonzero(np.r_[True, (lead[1:] != lead[:-1]) | (other[1:] != other[:-1])])[0]
    return lead[start], other[start], np.bitwise_or.reduceat(mask[order], start)


def _unpacked(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(signatures with their bucket above, documents) of each block."""
    for bucket, base, width, packed, local, ids in zip(*[batch.column(n).to_pylist() for n in ("bucket", "base", "width", "sigs", "local", "ids")], strict=True):
        # Partitions can share a task: the bucket joins the 32 bits again.
        d = unplanes(ids, width).view(np.int64) + base
        yield unplanes(packed, 4) | np.uint64(bucket << 32), d if local is None else d[np.frombuffer(local, "<u2")]


def _ranged(dealt: DataFrame, ranges: int) -> DataFrame:
    """Blocks of a task cut by the signatures' leading bits into ``ranges``, and brought into their order."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def flush():
            s, d = (np.concatenate([h[i] for h in held]) for i in (0, 1))
            held.clear()
            at = ((s & np.uint64(0xFFFFFFFF)) * np.uint64(ranges) >> np.uint64(32)).astype(np.int32)
            order = np.argsort(at, kind="stable")
            ends = np.searchsorted(at[order], np.arange(ranges + 1))
            full = np.nonzero(np.diff(ends))[0].tolist()
            pick = lambda x: pa.array([planes(x[order[ends[r] : ends[r + 1]]], 8) for r in full], pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pick(s), pick(d)], names=["range", "sigs", "ids"])

        for batch in batches:
            for pair in _unpacked(batch):
                held.append(pair)
                if sum(len(h[0]) for h in held) >= BLOCK_SIGNATURES:
                    yield flush()
            del batch
            release()
        if held:
            yield flush()

    return dealt.mapInArrow(cut, "range int, sigs binary, ids binary").sortWithinPartitions("range")


def _ties(blocks: DataFrame, parts: int, meet_keys: np.ndarray, ranges: int = 1, most: int = RUN) -> DataFrame:
    """(lead, other, mask): documents that share a signature with its leader, the smallest of them as a rule.  A tie
    may be listed more than once.  ``ranges`` of a task are worked on one by one, ``most`` signatures at a time."""
    meet = len(meet_keys)

    def pieces(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        if ranges == 1:
            yield from ((0, s, d) for s, d in _unpacked(batch))
        else:
            for at, s, d in zip(*[batch.column(n).to_pylist() for n in ("range", "sigs", "ids")], strict=True):
                yield at, unplanes(s, 8), unplanes(d, 8).view(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = None
        seen_sig, seen_doc = np.zeros(0, np.uint64), np.zeros(0, np.int64)  # earlier runs: one document a signature
        sigs: list[np.ndarray] = []
        docs: list[np.ndarray] = []
        held = 0

        def groups(last: bool):
            nonlocal seen_sig, seen_doc
            s, d = np.concatenate(sigs), np.concatenate(docs)
            sigs.clear()
            docs.clear()
            order = np.lexsort((d, s))
            s, d = s[order], d[order]
            whole = last and not seen_sig.size
            if seen_sig.size:
                order = np.argsort(np.concatenate([seen_sig, s]), kind="stable")  # an earlier run's leader comes first
                s, d = np.concatenate([seen_sig, s])[order], np.concatenate([seen_doc, d])[order]
            del order
            start = np.nonzero(np.r_[True, s[1:] != s[:-1]])[0]
            size = np.diff(np.r_[start, s.size])
            keep = np.repeat(size > 1, size)
            lead, other = np.repeat(d[start], size)[keep], d[keep]
            # Of several runs none sees a signature whole: then any group may be larger than it looks.
            many = np.repeat(size > 2, size)[keep] | (not whole)
            mask = np.where(many, np.uint64(1) << (mix(s[keep]) >> np.uint64(58)), np.uint64(0))
            apart = lead != other
            lead, other, mask = _merged(lead[apart], other[apart], mask[apart])
            if not last:
                seen_sig, seen_doc = s[start], d[start]
            to = (mix(lead.view(np.uint64) ^ other.view(np.uint64)) % np.uint64(meet)).astype(np.int64)
            order = np.argsort(to, kind="stable")
            cut = np.searchsorted(to[order], np.arange(meet + 1))
            packed = np.stack([lead, other, mask.view(np.int64)], axis=1)[order]
            full = np.nonzero(np.diff(cut))[0]
            return pa.RecordBatch.from_arrays([pa.array(meet_keys[full].astype(np.int32)), pa.array([planes(packed[cut[i] : cut[i + 1]].ravel(), 8) for i in full.tolist()], pa.binary())], names=["bucket", "ties"])

        for batch in batches:
            for at, s, d in pieces(batch):
                if at != now:
                    if held:
                        yield groups(True)
                    seen_sig, seen_doc, held, now = seen_sig[:0], seen_doc[:0], 0, at
                sigs.append(s)
                docs.append(d)
                held += s.size
                if held >= most:
                    yield groups(False)
                    held = 0
            del batch
            release()
        if held:
            yield groups(True)

    def once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Similar documents meet in many tasks: their ties are united, as many as can be held at a time."""
        held = [np.zeros(0, np.int64)] * 2 + [np.zeros(0, np.uint64)]
        waiting: list[np.ndarray] = []

        def unite():
            new = np.concatenate(waiting) if waiting else np.zeros((0, 3), np.int64)
            waiting.clear()
            return list(_merged(*[np.concatenate([h, new[:, i].copy().view(h.dtype)]) for i, h in enumerate(held)]))

        def out():
            return pa.RecordBatch.from_arrays([pa.array(held[0]), pa.array(held[1]), pa.array(held[2].view(np.int64))], names=["lead", "other", "mask"])

        for batch in batches:
            for packed in batch.column("ties"):
                waiting.append(unplanes(packed.as_buffer(), 8).view(np.int64).reshape(-1, 3))
                if sum(map(len, waiting)) > most // 2:
                    held = unite()
                    if held[0].size > most // 2:
                        yield out()
                        held = [h[:0] for h in held]
        held = unite()
        yield out()

    dealt = blocks.repartition(parts, "bucket")
    dealt = (dealt if ranges == 1 else _ranged(dealt, ranges)).mapInArrow(run, "bucket int, ties binary")
    return dealt.repartition(meet, "bucket").mapInArrow(once, "lead long, other long, mask long")


def _star(ties: DataFrame, count: int, payload: DataFrame, read: Callable[[pa.RecordBatch], list], fits: Callable[[object, object], bool]) -> DataFrame:
    """The ties (lead, other) of which some payload row of ``lead`` fits one of ``other``.

    Fellows are dealt into blocks of about ``STAR_BLOCK``, and the leader goes to each block once, so a leader of any
    number of fellows is spread.  ``payload`` has ``doc_id`` and what ``read`` turns into one object a row.
    """
    sizes = ties.groupBy("lead").count().select("lead", F.ceil(F.col("count") / STAR_BLOCK).cast("int").alias("blocks"))
    leaders = sizes.select("lead", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(0).alias("role"), F.col("lead").alias("doc_id"))
    large, ties = sizes.where("blocks > 1"), ties.select("lead", "other")
    member = lambda t, block: t.select("lead", block.cast("int").alias("block"), F.lit(1).alias("role"), F.col("other").alias("doc_id"))
    spread = member(ties.join(large, "lead"), F.pmod(F.xxhash64("other"), F.col("blocks")))
    rows = spread.unionByName(member(ties.join(large, "lead", "left_anti"), F.lit(0))).unionByName(leaders)
    if 2 * count <= BROADCAST_IDS:
        rows = F.broadcast(rows)
    full = payload.join(rows, "doc_id")
    full = full.repartition("lead", "block").sortWithinPartitions("lead", "block", "role")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, mine = None, []
        for batch in batches:
            lead, block, role, doc = (batch.column(n).to_numpy().tolist() for n in ("lead", "block", "role", "doc_id"))
            out = []
            for i, theirs in enumerate(read(batch)):
                if not role[i]:
                    if key != (lead[i], block[i]):
                        key, mine = (lead[i], block[i]), []
                    mine.append(theirs)
                elif any(fits(x, theirs) for x in mine):
                    out.append(i)
            yield pa.RecordBatch.from_arrays([pa.array([lead[i] for i in out], pa.int64()), pa.array([doc[i] for i in out], pa.int64())], names=["lead", "other"])
            del batch
            release()

    return full.mapInArrow(run, "lead long, other long")


def _likely(ties: DataFrame, count: int, about: DataFrame, num: int, den: int) -> DataFrame:
    """Ties whose sketches leave the threshold possible."""
    read = lambda batch: list(zip(batch.column("n_shingles").to_pylist(), batch.column("sketch").to_pylist(), strict=True))

    def fits(x, y) -> bool:
        return den * min(x[0], y[0]) >= num * max(x[0], y[0]) and may_link(x[0], y[0], flipped(x[1], y[1]), num, den)

    return _star(ties, count, about.select("doc_id", "n_shingles", "sketch"), read, fits)


def _verified(ties: DataFrame, count: int, docs: DataFrame, words: int, num: int, den: int) -> DataFrame:
    """Ties whose whole shingle sets reach the threshold."""

    def read(batch):
        texts = [t or "" for t in batch.column("text").to_pylist()]
        for a, b in slices(texts):
            yield from shingle_sets(texts[a:b], words)

    def fits(x, y) -> bool:
        shared = np.intersect1d(x, y, assume_unique=True).size
        return den * shared >= num * (x.size + y.size - shared)

    return _star(ties, count, docs, read, fits)


def _crowded(listed: DataFrame, about: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs (lead, other) of different components, listed under one leader with overlapping masks, that pass by
    sketch; in blocks of bounded size."""
    sizes = listed.groupBy("lead").agg(F.ceil(F.count("*") / PAIR_BLOCK).cast("int").alias("blocks"))
    rows = listed.join(sizes, "lead")
    mine = F.pmod(F.xxhash64("doc_id", F.lit(7)), F.col("blocks")).cast("int")
    # A member of block i meets every block: as (i, j) for j >= i and (j, i) for j < i.
    spread = rows.withColumn("i", mine).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    spread = spread.select("lead", F.least("i", "j").alias("x"), F.greatest("i", "j").alias("y"), (F.col("i") <= F.col("j")).alias("left"), (F.col("i") >= F.col("j")).alias("right"), "doc_id", "component", "mask")
    full = spread.join(about.select("doc_id", "n_shingles", "sketch"), "doc_id")
    full = full.repartition("lead", "x", "y").sortWithinPartitions("lead", "x", "y")

    def compare(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        ids, comp, mask, n = (batch.column(c).to_numpy() for c in ("doc_id", "component", "mask", "n_shingles"))
        raw = batch.column("sketch").to_pylist()
        width = np.fromiter(map(len, raw), np.int64, len(raw))
        left, right = (np.nonzero(batch.column(c).to_numpy(zero_copy_only=False))[0] for c in ("left", "right"))
        found: list[tuple[np.ndarray, np.ndarray]] = []
        for size in np.unique(width[right]).tolist():
            some = right[width[right] == size]
            theirs = np.frombuffer(b"".join([raw[j] for j in some.tolist()]), np.uint64).reshape(len(some), -1)
            for i in left.tolist():
                near = np.nonzero((comp[some] != comp[i]) & ((mask[some] & mask[i]) != 0) & (den * np.minimum(n[some], n[i]) >= num * np.maximum(n[some], n[i])))[0]
                if not near.size:
                    continue
                a, b = np.frombuffer(raw[i], np.uint64), theirs[near]
                while a.size > b.shape[1]:
                    a = a[: a.size // 2] ^ a[a.size // 2 :]
                while b.shape[1] > a.size:
                    b = b[:, : b.shape[1] // 2] ^ b[:, b.shape[1] // 2 :]
                differ = np.bitwise_count(b ^ a).sum(axis=1, dtype=np.int64)
                hit = ids[some[near[(n[some[near]] + n[i]) * (den - num) >= differ * (den + num)]]]
                if hit.size:
                    found.append((np.minimum(hit, ids[i]), np.maximum(hit, ids[i])))
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return tuple(np.concatenate([f[k] for f in found]) for k in (0, 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in whole_groups(batches, ["lead", "x", "y"]):
            a, b = compare(group)
            if a.size:
                a, b, _ = _merged(a, b, np.zeros(a.size, np.uint64))
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["lead", "other"])

    return full.mapInArrow(run, "lead long, other long").distinct()


def near_groups(docs: DataFrame, words: int = 5, num: int = 3, den: int = 4, id_col: str = "doc_id", text_col: str = "text", task: int = TASK, tasks: int = TASKS) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of ``docs``: links are pairs with Jaccard >= num/den.

    Null and empty texts, and texts of white space, have the empty set and link with nothing.  Equal sets are one
    class, so ties and repeated rows share a component.  Rows with a null id keep a null component and link with
    nothing.  Rows that share an id are one document, with the links of all its texts.  Texts of any length are hashed
    in pieces.  Other columns are ignored; an empty table gives an empty table.  ``task`` signatures are meant for each of
    at most ``tasks`` tasks or, past that, for each range of one.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    scratch = Scratch(spark)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    about = scratch.keep(describe(docs, words), "sets-of")
    named = about.where("doc_id is not null and set_key is not null")
    rows, total = about.agg(F.count("*"), F.coalesce(F.sum("n_shingles"), F.lit(0))).first()
    repeated = named.groupBy("doc_id").count().where(F.col("count") > 1).select("doc_id")
    again = repeated.limit(1).count() > 0
    sets, texts, sketches = named.select("doc_id", "set_key"), docs.where("doc_id is not null"), named
    if again:  # saves work only: equal rows of one id need no second look
        sets, texts, sketches = sets.distinct(), texts.distinct(), named.dropDuplicates(["doc_id", "set_key"])
    classes = sets.groupBy("set_key").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n")).where("n > 1").select("set_key", "rep")
    classes = scratch.keep(classes, "classes", rows)
    if classes.count() <= BROADCAST_IDS // 2:
        classes = F.broadcast(classes)
    follows = scratch.keep(sets.join(classes, "set_key").where("doc_id <> rep").select("doc_id", "rep").distinct(), "class-of", rows)
    equal = spark.createDataFrame([], "src long, dst long")
    if again:
        # Documents of several sets stay themselves, linked to the classes of all their sets.
        equal = scratch.keep(follows.join(repeated, "doc_id", "left_semi").toDF("src", "dst"), "equal", rows)
        follows = scratch.keep(follows.join(repeated, "doc_id", "left_anti"), "class-of", rows)
    few = follows.count() <= BROADCAST_IDS
    # Of a class one document's signatures do: the others stay behind where their ids can be broadcast; where they are
    # too many for that, their ties are turned into their class's instead.
    first = docs.join(F.broadcast(follows.select("doc_id")), "doc_id", "left_anti") if few else docs

    common = _common(docs, rows, words)
    meet = int(spark.conf.get("spark.sql.shuffle.partitions"))
    wanted = total * 3 // (2 * task)
    parts = max(meet, min(tasks, wanted))
    ties = _ties(_blocks(first, words, num, den, parts, common, _even_keys(spark, parts)), parts, _even_keys(spark, meet), max(1, -(-wanted // parts)), task * 3 // 2)
    if not few:
        side = lambda n: follows.select(F.col("doc_id").alias(n), F.col("rep").alias(f"r_{n}"))
        ties = ties.join(side("lead"), "lead", "left").join(side("other"), "other", "left")
        ties = ties.select(F.coalesce("r_lead", "lead").alias("lead"), F.coalesce("r_other", "other").alias("other"), "mask").where("lead <> other")
    ties = scratch.keep(ties.groupBy("lead", "other").agg(F.bit_or("mask").alias("mask")), "ties", 4 * rows)

    def links_of(pairs: DataFrame) -> DataFrame:
        """Pairs that may be similar by sketch, verified on the texts."""
        likely = scratch.keep(_likely(pairs, pairs.count(), sketches, num, den), "likely", rows)
        return scratch.keep(_verified(likely, likely.count(), texts, words, num, den), "links", rows).toDF("src", "dst")

    def with_component(pairs: DataFrame, n: str) -> DataFrame:
        of = found.select(F.col("node").alias(n), F.col("component").alias(f"c_{n}"))
        return pairs.join(of, n, "left").withColumn(f"c_{n}", F.coalesce(f"c_{n}", n))

    def crossing(pairs: DataFrame) -> DataFrame:
        return with_component(with_component(pairs, "other"), "lead").where("c_lead <> c_other").select("lead", "other", "mask")

    # A document's tie of most signatures comes first; of the others those count that it leaves between components.
    best = ties.groupBy("other").agg(F.min_by("lead", F.struct(-F.bit_count("mask"), F.col("lead"))).alias("lead"))
    edges = links_of(scratch.keep(best.select("lead", "other"), "first-ties", rows)).unionByName(equal)
    found = components(edges, scratch, rows)
    rest = scratch.keep(crossing(ties), "rest", rows)
    edges = edges.unionByName(links_of(rest))
    found = components(edges, scratch, rows)
    leads = scratch.keep(rest.where("mask <> 0").select("lead").distinct(), "crossing", rows)
    crowd = with_component(ties.where("mask <> 0").join(leads, "lead", "left_semi"), "other")
    fellows = scratch.keep(crowd.select("lead", F.col("other").alias("doc_id"), F.col("c_other").alias("component"), "mask"), "crowd", 4 * rows)
    more = scratch.keep(_crowded(fellows, sketches, num, den), "crowded", rows)
    if more.limit(1).count():
        found = components(edges.unionByName(scratch.keep(_verified(more, more.count(), texts, words, num, den), "links", rows).toDF("src", "dst")), scratch, rows)
    final = about.select("doc_id", "n_shingles").join(follows, "doc_id", "left").withColumn("rep", F.coalesce("rep", "doc_id"))
    final = final.join(found, F.col("rep") == F.col("node"), "left").select("doc_id", "n_shingles", F.coalesce("component", "rep").alias("component_id"))
    final = materialize(final, "groups", rows)
    scratch.drop()
    return final
