"""Operator 11, centroid clustering: weighted deduplication before Lloyd's rounds, all in exact integers.

1. Each usable vector is quantised to integers and packed into a code (two bytes a component where they fit).
2. Equal codes are grouped with their multiplicity, so a vector that a third of the rows repeat costs one row from here
   on; the distinct codes are written once to the shared folder.
3. A round maps over the distinct codes: the nearest centroid of each, and for each task one row a centroid with the
   weighted integer sums.  Those rows are added up by centroid; only the centroids themselves reach the driver.
4. The last assignment of each distinct code is joined back to the ids.  Codes that hold more than one row in
   ``HEAVY`` are fewer than ``HEAVY``, so they are broadcast; the others are too light to make a hot key.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, bounded_batches, join_back, materialize

#: Integers up to which sums of products are exact in doubles, for up to 4096 components.
EXACT = 1 << 19
INERTIA_LIMIT = (1 << 63) - 1


def most(dims: int) -> int:
    """Quantised components beyond this count as this, so that squared distances fit into 62 bits."""
    return min(1 << 30, math.isqrt((1 << 62) // dims) // 2)


def pack(codes: np.ndarray) -> list[bytes]:
    """Rows of integers as bytes: of 16 bits where all of a row's fit, else of 32."""
    small = (np.abs(codes) < 1 << 15).all(axis=1)
    short, long = codes.astype("<i2"), codes.astype("<i4")
    return [short[i].tobytes() if s else long[i].tobytes() for i, s in enumerate(small.tolist())]


def unpack(packed: list[bytes], dims: int) -> np.ndarray:
    out = np.zeros((len(packed), dims), np.int64)
    wide = np.fromiter((len(p) == 4 * dims for p in packed), bool, len(packed))
    for kind, some in (("<i2", np.nonzero(~wide)[0]), ("<i4", np.nonzero(wide)[0])):
        if some.size:
            out[some] = np.frombuffer(b"".join([packed[i] for i in some.tolist()]), kind).reshape(-1, dims)
    return out


def quantised(vectors: DataFrame, dims: int, scale: int) -> DataFrame:
    """(vec_id, code) of the vectors with exactly ``dims`` components, none null or non-finite: floor(scale * x)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = batch.column("embedding")
            sized = np.nonzero(cells.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False) == dims)[0]
            x = cells.take(pa.array(sized)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims)
            fine = np.isfinite(x).all(axis=1)
            with np.errstate(over="ignore"):
                codes = np.clip(np.floor(x[fine] * scale), -most(dims), most(dims)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id").take(pa.array(sized[fine])), pa.array(pack(codes), pa.binary())], names=["vec_id", "code"])

    return vectors.mapInArrow(run, "vec_id long, code binary")


def nearest(points: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of the nearest centroid, the smaller of equals; squared distance), exact in integers."""
    if max(np.abs(points).max(initial=0), np.abs(centres).max(initial=0)) <= EXACT and points.shape[1] <= 4096:
        # Sums of products stay below 2^53, so doubles hold them exactly in any order.
        p, c = points.astype(np.float64), centres.astype(np.float64)
        apart = (p * p).sum(axis=1)[:, None] - 2.0 * (p @ c.T) + (c * c).sum(axis=1)[None, :]
        best = apart.argmin(axis=1)
        return best, apart[np.arange(len(p)), best].astype(np.int64)
    best, least = np.zeros(len(points), np.int64), np.full(len(points), np.iinfo(np.int64).max)
    for k, c in enumerate(centres):
        d = ((points - c) ** 2).sum(axis=1)
        closer = d < least
        best[closer], least[closer] = k, d[closer]
    return best, least


def _sums(distinct: DataFrame, centres: np.ndarray) -> list:
    """(cluster, n, sums) of every non-empty cluster."""
    dims = centres.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # A task's sums are Python integers, as 64 bits are not enough for wide components times many rows.
        total = np.zeros(centres.shape, object)
        count = np.zeros(len(centres), object)
        for batch in batches:
            points, n = unpack(batch.column("code").to_pylist(), dims), batch.column("n").to_numpy()
            best, _ = nearest(points, centres)
            for k in np.unique(best).tolist():
                mine = best == k
                w, p = n[mine], points[mine]
                small = int(w.sum()) * int(np.abs(p).max(initial=0)) < 1 << 62
                total[k] += (w[:, None] * p).sum(axis=0).astype(object) if small else (w.astype(object)[:, None] * p.astype(object)).sum(axis=0)
                count[k] += int(w.sum())
        some = [k for k in range(len(centres)) if count[k]]
        kind = pa.list_(pa.decimal128(38, 0))
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array([count[k] for k in some], pa.int64()), pa.array([[_decimal(v) for v in total[k]] for k in some], kind)], names=["cluster", "n", "sums"])

    parts = distinct.mapInArrow(run, "cluster int, n long, sums array<decimal(38,0)>")
    return parts.groupBy("cluster").agg(F.sum("n").alias("n"), *[F.sum(F.col("sums")[i]).alias(f"s{i}") for i in range(dims)]).collect()


def _decimal(value: int):
    return Decimal(int(value))


def _assigned(distinct: DataFrame, centres: np.ndarray) -> DataFrame:
    """(code, n, cluster, distance)."""
    dims = centres.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            best, apart = nearest(unpack(batch.column("code").to_pylist(), dims), centres)
            yield pa.RecordBatch.from_arrays([batch.column("code"), batch.column("n"), pa.array(best.astype(np.int32)), pa.array(apart)], names=["code", "n", "cluster", "distance"])

    return distinct.mapInArrow(run, "code binary, n long, cluster int, distance long")


def lloyd(distinct: DataFrame, centres: np.ndarray, rounds: int) -> np.ndarray:
    """Centroids after ``rounds``: each the componentwise floor(sum / count) of its vectors; empty ones stay."""
    for _ in range(rounds):
        centres = centres.copy()
        for row in _sums(distinct, centres):  # a row a centroid
            centres[row["cluster"]] = [int(row[f"s{i}"]) // row["n"] for i in range(centres.shape[1])]
    return centres


def clustered(vectors: DataFrame, k: int = 40, rounds: int = 5, dims: int = 64, scale: int = 256, seed: str = "2", id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every usable row of ``vectors``.

    Vectors that are null, of another width than ``dims``, or that hold null or non-finite components are left out.
    Centroids start as the ``k`` rows whose ids have the smallest SHA-256 of ``seed:id``, all of them where there are
    fewer; rows with a null id come last, and rows of one id in the order of their codes.  Rows that repeat an id each
    give a row.  Components beyond ``most(dims) / scale`` in magnitude (524288 here) count as that, and sums past
    2^63 - 1 are reported as that.  Other columns are ignored; an empty table, or one without usable vectors, gives an empty table.
    """
    spark = vectors.sparkSession
    bounded_batches(spark)
    scratch = Scratch(spark)
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("embedding"))
    coded = scratch.keep(quantised(rows, dims, scale), "codes")
    distinct = scratch.keep(coded.groupBy("code").agg(F.count("*").alias("n")), "distinct-codes")
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    starts = coded.orderBy(order.asc_nulls_last(), "code").limit(k).select("code").collect()  # k rows
    centres = unpack([bytes(r["code"]) for r in starts], dims)
    if not len(centres):
        scratch.drop()
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    centres = lloyd(distinct, centres, rounds)
    done = _assigned(distinct, centres)
    sums = {r["cluster"]: (int(r["n"]), int(r["d"])) for r in done.groupBy("cluster").agg(F.sum("n").alias("n"), F.sum(F.col("distance").cast("decimal(20,0)") * F.col("n")).alias("d")).collect()}
    total, everything = sum(n for n, _ in sums.values()), sum(d for _, d in sums.values())
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres.tolist()]
    about = spark.createDataFrame([(c, min(d, INERTIA_LIMIT), min(everything, INERTIA_LIMIT), digest[c]) for c, (_, d) in sorted(sums.items())], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    joined = join_back(coded, done.select("code", "n", "cluster", "distance"), "code", total)
    out = joined.join(F.broadcast(about), "cluster")  # a row a centroid
    out = materialize(out.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"), "clusters")
    scratch.drop()
    return out
