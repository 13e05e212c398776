"""A stated query set against all rows of a table of vectors, in blocks.

A small query set goes to every task once; a large one stays a table, and each bounded group of corpus rows meets it
block by block.  Either way a task holds a bounded number of vectors and of products at a time.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Queries up to which the query set goes to every task; corpus rows of a group beyond it; products held at a time.
QUERIES, GROUP_ROWS, PRODUCTS = 8192, 50_000, 2_000_000

Work = Callable[[np.ndarray, np.ndarray, pa.Array, np.ndarray], pa.RecordBatch]


def matrix(column: pa.Array) -> np.ndarray:
    """A list column of one width as rows of doubles."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False).reshape(len(column), -1)


def _tiles(ids: np.ndarray, q: np.ndarray, own: pa.Array, v: np.ndarray, work: Work) -> Iterator[pa.RecordBatch]:
    step = max(1, PRODUCTS // max(1, len(v)))
    for a in range(0, len(ids), step):
        yield work(ids[a : a + step], q[a : a + step], own, v)


def meet(corpus: DataFrame, queries: DataFrame, own_col: str, work: Work, schema: str, most_queries: int = QUERIES, group_rows: int = GROUP_ROWS) -> DataFrame:
    """``work(query ids, query vectors, own column, corpus vectors)`` over blocks that cover all queries (query_id, vec)
    times all rows (own column, vec) of ``corpus``; rows without a vector meet nothing."""
    asked = queries.where("vec is not null").select(F.col("query_id").cast("long").alias("query_id"), F.col("vec").cast("array<double>").alias("vec"))
    rows = corpus.where("vec is not null").select(F.col(own_col).alias("own"), F.col("vec").cast("array<double>").alias("vec"))
    table = asked.limit(most_queries + 1).toArrow()
    if table.num_rows <= most_queries:
        table = table.sort_by("query_id").combine_chunks()
        ids = table.column("query_id").to_numpy()
        q = matrix(table.column("vec").combine_chunks()) if len(ids) else np.zeros((0, 0))

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if len(ids) and batch.num_rows:
                    yield from _tiles(ids, q, batch.column("own"), matrix(batch.column("vec")), work)

        return rows.mapInArrow(scan, schema)
    groups = max(1, -(-rows.count() // group_rows))
    kind = rows.schema["own"].dataType.simpleString()
    residents = rows.select(F.pmod(F.xxhash64("own", "vec"), F.lit(groups)).cast("int").alias("g"), F.lit(0).alias("role"), "own", F.lit(None).cast("long").alias("query_id"), "vec")
    guests = asked.select(F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("g"), F.lit(1).alias("role"), F.lit(None).cast(kind).alias("own"), "query_id", "vec")
    dealt = residents.unionByName(guests).repartition(groups, "g").sortWithinPartitions("g", "role")

    def grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, owns, vectors, own, v = None, [], [], None, None
        for batch in batches:
            g, role = batch.column("g").to_numpy(), batch.column("role").to_numpy()
            cuts = [0, *(np.nonzero((g[1:] != g[:-1]) | (role[1:] != role[:-1]))[0] + 1).tolist(), len(g)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if a == b:
                    continue
                part = batch.slice(a, b - a)
                if g[a] != group:
                    group, owns, vectors, own = int(g[a]), [], [], None
                if role[a] == 0:
                    owns.append(part.column("own"))
                    vectors.append(matrix(part.column("vec")))
                    continue
                if own is None and owns:
                    own, v = pa.concat_arrays(owns), np.concatenate(vectors)
                if own is not None:
                    yield from _tiles(part.column("query_id").to_numpy(), matrix(part.column("vec")), own, v, work)

    return dealt.mapInArrow(grouped, schema)


def best(score: np.ndarray, own: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of each row's ``k`` highest scores, ties by the smaller ``own``."""
    if score.shape[1] > k:
        least = np.partition(score, score.shape[1] - k, axis=1)[:, -k]
        i, j = np.nonzero(score >= least[:, None])
    else:
        i, j = (x.ravel() for x in np.indices(score.shape))
    order = np.lexsort((own[j], -score[i, j], i))
    i, j = i[order], j[order]
    place = np.arange(i.size) - np.searchsorted(i, i, side="left")
    return i[place < k], j[place < k]
