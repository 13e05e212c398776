"""Operator 5, document fingerprints: closed syncmers.

A k-mer of the text's bytes is an anchor if the smallest of its inner s-mers, by hash, lies at one of its edges: a
property of the k-mer alone, so an edit elsewhere moves no anchor's choice.  The fingerprint is the anchors of the
smallest hashes, each with its place, as many as the text's length asks for; two fingerprints are compared by the anchors they share at one displacement.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, materialize
from .shingles import mix

K, S = 12, 6
#: Anchors of a fingerprint where the text has as many: those of the smallest hashes, and all with a hash under DENSE.
ANCHORS = 64
#: One anchor in 64 has a hash under it: one in about 224 bytes of text, so that long texts have more anchors.
DENSE = 2**32 // 64
#: Bytes by which the displacements of anchors that count together may differ.
SLACK = 256


def anchors(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes (distinct, ascending) and places of the chosen anchors.

    A text without one, shorter than ``K`` bytes as a rule, has itself as its anchor; an empty text has none.
    """
    n = len(raw)
    if not n:
        return np.zeros(0, np.uint32), np.zeros(0, np.uint32)
    hashes = np.zeros(0, np.uint32)
    if n >= K:
        padded = np.frombuffer(raw + bytes(8), np.uint8)
        smers = np.ndarray((n - S + 1,), "<u8", padded, strides=(1,)) & np.uint64((1 << 8 * S) - 1)
        with np.errstate(over="ignore"):
            h = smers * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(32)
            h *= np.uint64(0xD6E8FEB86659FD93)
        w = K - S + 1  # s-mers in a k-mer: 7
        two = np.minimum(h[:-1], h[1:])
        four = np.minimum(two[:-2], two[2:])
        low = np.minimum(four[:-3], four[3:])
        place = np.nonzero((h[: low.size] == low) | (h[w - 1 : w - 1 + low.size] == low))[0]
        with np.errstate(over="ignore"):
            hashes = (mix(h[place] + h[place + w - 1] * np.uint64(0xA0761D6478BD642F)) >> np.uint64(32)).astype(np.uint32)
    if not hashes.size:
        return np.frombuffer(hashlib.sha256(raw).digest()[:4], np.uint32), np.zeros(1, np.uint32)
    if hashes.size > 8 * ANCHORS:
        # Only small hashes can be chosen; where too few of them are distinct, all are looked at.
        few = hashes < np.uint32(max(DENSE, 2**32 // hashes.size * 4 * ANCHORS))
        u, first = np.unique(hashes[few], return_index=True)
        if u.size >= ANCHORS:
            n = chosen(u)
            return u[:n], place[few][first[:n]].astype(np.uint32)
    u, first = np.unique(hashes, return_index=True)
    n = chosen(u)
    return u[:n], place[first[:n]].astype(np.uint32)


def chosen(hashes: np.ndarray) -> int:
    """How many of distinct ascending hashes count."""
    return max(ANCHORS, int(np.searchsorted(hashes, np.uint32(DENSE))))


def to_text(fp: tuple[np.ndarray, np.ndarray]) -> str:
    return base64.b64encode(np.stack(fp, axis=1).astype("<u4").tobytes()).decode()


def likeness(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Share of the smallest anchors of both texts that both have, at about one displacement; 1 for equal fingerprints."""
    if a[0].size == b[0].size and (a[0] == b[0]).all() and (a[1] == b[1]).all():
        return 1.0
    if not a[0].size or not b[0].size:
        return 0.0
    both = np.union1d(a[0], b[0])
    both = both[: chosen(both)]
    shared, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    ok = shared <= both[-1]
    move = np.sort(a[1][i[ok]].astype(np.int64) - b[1][j[ok]].astype(np.int64))
    if not move.size:
        return 0.0
    most = (np.searchsorted(move, move + SLACK, side="right") - np.arange(move.size)).max()
    return float(most / both.size)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint) of every whole text; null and empty texts have the empty fingerprint.  No shuffle."""
    from .common import append_columns, field

    def make():
        return lambda texts: [[to_text(anchors((t or "").encode("utf-8", "surrogatepass"))) for t in texts]]

    text = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return append_columns(text, "text", make, [field("fingerprint", "string")]).drop("text")


def edited(text: str, following: str) -> str:
    """The last half of ``text`` (rounded down) replaced by as many code points of ``following``, or all it has."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order; each is finished when the one after it in its bucket comes.  Guests only end their bucket."""
    held = None  # bucket, id, text, fingerprint
    for batch in batches:
        rows = zip(*[batch.column(n).to_pylist() for n in ("bucket", "guest", "doc_id", "text")], strict=True)
        out: list[list] = [[] for _ in range(7)]
        size = 0
        for bucket, guest, doc_id, text in rows:
            text = text or ""
            fp = anchors(text.encode("utf-8", "surrogatepass"))
            if held and held[0] == bucket:
                _, before_id, before, before_fp = held
                new = edited(before, text).encode("utf-8", "surrogatepass")
                new_fp = anchors(new)
                row = (before_id, len(before), hashlib.sha256(new).hexdigest(), to_text(before_fp), to_text(new_fp), likeness(before_fp, new_fp), likeness(before_fp, fp))
                for c, v in zip(out, row, strict=True):
                    c.append(v)
                size += 1
            held = None if guest else (bucket, doc_id, text, fp)
            if size >= 4000:
                yield _batch(out)
                out, size = [[] for _ in range(7)], 0
        yield _batch(out)


def _batch(cols: list[list]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=[x.split()[0] for x in OUT.split(", ")])


def edit_test(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every document and of its text with the last half overwritten by the next document's start.

    Documents follow one another by descending id, equal ids by text, null ids last; after the last comes the first.
    A null text counts as empty.  The texts are range-partitioned once; each range gets the first document of the
    range after it as a guest, so no global sort and no row goes through one task.  An empty table gives an empty one.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = docs.agg(F.percentile_approx("doc_id", [i / parts for i in range(1, parts)] or [0.5], 10000).alias("c")).first()["c"] or []
    cuts = sorted(set(cuts))
    # Ranges are numbered from the highest ids down; null ids come after all.
    below = F.size(F.filter(F.array(*[F.lit(c).cast("long") for c in cuts]), lambda c: c > F.col("doc_id"))) if cuts else F.lit(0)
    bucket = F.when(F.col("doc_id").isNull(), F.lit(len(cuts) + 1)).otherwise(below).cast("int")
    firsts = [(r["bucket"], r["top"]) for r in docs.select(bucket.alias("bucket"), "doc_id").groupBy("bucket").agg(F.max("doc_id").alias("top")).orderBy("bucket").collect()]  # a row for each range
    rows = docs.select(bucket.alias("bucket"), F.lit(0).alias("guest"), "doc_id", "text")
    if firsts:
        hosts = [firsts[i - 1][0] for i in range(len(firsts))]  # the range before; the first document is the last range's guest
        known = spark.createDataFrame([(t, h, b) for (b, t), h in zip(firsts, hosts, strict=True)], "top long, host int, home int")
        heads = docs.join(F.broadcast(known), docs["doc_id"].eqNullSafe(known["top"]))
        heads = heads.groupBy("home", "host").agg(F.min(F.struct(F.coalesce("text", F.lit("")).alias("text"))).alias("t"), F.first("doc_id").alias("doc_id"))
        rows = rows.unionByName(materialize(heads.select(F.col("host").alias("bucket"), F.lit(1).alias("guest"), "doc_id", F.col("t.text").alias("text")), "range-heads"))
    ordered = rows.repartitionByRange(parts, "bucket").sortWithinPartitions("bucket", "guest", F.desc_nulls_last("doc_id"), F.asc_nulls_first("text"))
    return ordered.mapInArrow(_walk, OUT)
