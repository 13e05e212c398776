"""Operator 6, embedding near-dedup: PCA-ordered comparison of blocks.

Equal vectors are one class.  Vectors are turned into the principal axes of a bounded sample, widest axis first.  Each
vector lives in the cell of its nearest pivot, and bounded blocks of a cell's vectors are written once.  Pairs of blocks
are read from there, so that nothing but results is shuffled however many blocks a block meets.  Two cells' vectors meet
only where both are within the distance of the threshold of the other cell (a half-space bound that loses none): leading
axes are multiplied first, the rest is bounded by the norms of the suffixes, and pairs that cannot reach the threshold
are dropped; the remaining cosines are taken in double precision on the given components.

Tasks return counts and one root a vector, never pairs, so a dense group stays linear in output.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import FILES, Scratch, bounded_batches, materialize, unit_hash
from .components import components

#: Vectors of a block, and of the sample that gives axes and pivots.
BLOCK, SAMPLE = 4096, 8192
#: Axes multiplied before each cut.
TIERS = (16, 32)
#: Blocks of a file; classes of several vectors up to which they are broadcast; rows that a task returns at a time.
FILE_BLOCKS, BROADCAST, RETURNED = 8, 1_000_000, 100_000


def _keys(vectors: DataFrame, single: bool, parts: bool) -> DataFrame:
    """(vec_id, key): digest of the unit vector in doubles; null where unusable.  With ``parts`` also ``vec``, the
    components' bytes as given, ``single`` or double."""
    kind = np.float32 if single else np.float64

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, vecs = [], []
            for cell in batch.column("embedding"):
                v = cell.as_py()
                key = vec = None
                if v and None not in v:
                    x = np.array(v, np.float64)
                    most = np.abs(x).max() if np.isfinite(x).all() else 0.0
                    if most > 0:
                        vec = x.astype(kind).tobytes()
                        x = x / most  # squares of any finite components neither overflow nor vanish
                        x = x / np.sqrt(x @ x)
                        key = hashlib.blake2b((x + 0.0).tobytes(), digest_size=16).digest()
                keys.append(key)
                vecs.append(vec)
            arrays = [batch.column("vec_id"), pa.array(keys, pa.binary()), pa.array(vecs, pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays[: 2 + parts], names=["vec_id", "key", "vec"][: 2 + parts])

    return vectors.mapInArrow(run, "vec_id long, key binary" + ", vec binary" * parts)


def _units(vecs: bytes | pa.Buffer, rows: int, single: bool) -> np.ndarray:
    """Unit vectors in doubles from the bytes of ``rows`` vectors of one width."""
    x = np.frombuffer(vecs, np.float32 if single else np.float64).reshape(rows, -1).astype(np.float64)
    x /= np.abs(x).max(axis=1)[:, None]
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def _sample(reps: DataFrame, total: int, single: bool) -> np.ndarray:
    some = reps.where(unit_hash(F.col("rep"), F.lit("pca")) < min(1.0, SAMPLE / max(1, total))).limit(2 * SAMPLE).select("rep", "vec").toArrow().sort_by("rep")
    vecs = some.column("vec").to_pylist() or [r["vec"] for r in reps.limit(1).collect()]
    return _units(b"".join(vecs), len(vecs), single)


def tile_links(home: np.ndarray, member: np.ndarray, axes: np.ndarray, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (home, member) with cosine >= threshold; rows are unit vectors in doubles, itself included."""
    h, m = home @ axes, member @ axes
    suffix = lambda x, at: np.sqrt(np.maximum(0.0, (x[:, at:] ** 2).sum(axis=1)))
    tiers = [t for t in TIERS if t < axes.shape[1]]
    norms = {t: (suffix(h, t), suffix(m, t)) for t in tiers}
    step = max(1, 2_000_000 // max(1, len(member)))
    slack = 1e-5  # single precision in the first tier
    if tiers:  # the suffixes' norms are one more axis
        t = tiers[0]
        left, right = (np.column_stack([x[:, :t], norm]).astype(np.float32) for x, norm in zip((h, m), norms[t], strict=True))
    for a in range(0, len(home), step):
        b = min(len(home), a + step)
        if tiers:
            i, j = np.divmod(np.flatnonzero(left[a:b] @ right.T >= np.float32(threshold - slack)), max(1, len(member)))
        else:
            i, j = (x.ravel() for x in np.indices((b - a, len(member))))
        i += a
        for c in range(0, i.size, 500_000):
            p, q = i[c : c + 500_000], j[c : c + 500_000]
            for t in tiers[1:]:
                part = np.einsum("ij,ij->i", h[p, :t], m[q, :t]) + norms[t][0][p] * norms[t][1][q]
                keep = part >= threshold - 1e-9
                p, q = p[keep], q[keep]
            for e in range(0, p.size, 50_000):
                x, y = p[e : e + 50_000], q[e : e + 50_000]
                ok = np.einsum("ij,ij->i", home[x], member[y]) >= threshold
                yield x[ok], y[ok]


def _unite(root: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """``root`` (the smallest index known to be reachable from each) with the pairs x, y united."""
    while True:
        a, b = root[x], root[y]
        apart = a != b
        if not apart.any():
            return root
        x, y, a, b = x[apart], y[apart], a[apart], b[apart]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while (root != (down := root[root])).any():
            root = down


class Links:
    """Counts and roots of the vectors whose blocks a task has met: what it holds does not grow with their links."""

    def __init__(self):
        self.at: dict[int, int] = {}
        self.ids, self.links, self.root = (np.zeros(0, np.int64) for _ in range(3))

    def place(self, block: int, ids: np.ndarray) -> int:
        """Where the block's vectors begin."""
        if block not in self.at:
            self.at[block] = len(self.ids)
            self.root = np.r_[self.root, np.arange(len(self.ids), len(self.ids) + len(ids))]
            self.ids, self.links = np.r_[self.ids, ids], np.r_[self.links, np.zeros(len(ids), np.int64)]
        return self.at[block]

    def add(self, a: int, b: int, n_a: np.ndarray, n_b: np.ndarray, pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> None:
        """Pairs (row of the block at ``a``, row of that at ``b``), each once; the rows stand for so many vectors."""
        size = len(n_a)
        root = np.arange(size + (len(n_b) if a != b else 0))
        for x, y in pairs:
            if x.size:
                np.add.at(self.links, a + x, n_b[y])
                np.add.at(self.links, b + y, n_a[x])
                root = _unite(root, x, y if a == b else size + y)
        own = np.nonzero(root != np.arange(len(root)))[0]
        if own.size:
            slot = lambda k: np.where(k < size, a + k, b + k - size)
            self.root = _unite(self.root, slot(own), slot(root[own]))

    def rows(self) -> Iterator[pa.RecordBatch]:
        """(id, links, root) of those that link; the root is the smallest id known to be reachable."""
        low = np.full(len(self.ids), np.iinfo(np.int64).max)
        np.minimum.at(low, self.root, self.ids)
        some = np.nonzero(self.links > 0)[0]
        for c in range(0, some.size, RETURNED):
            part = some[c : c + RETURNED]
            yield pa.RecordBatch.from_arrays([pa.array(self.ids[part]), pa.array(self.links[part]), pa.array(low[self.root[part]])], names=["id", "links", "root"])


def near_vectors(vectors: DataFrame, threshold: float = 0.95, id_col: str = "vec_id", vec_col: str = "embedding", pivots: int | None = None) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row: links are pairs with cosine >= ``threshold``.

    Vectors that are null, empty, zero or hold null or non-finite components link with nothing, as do vectors of
    another width than theirs.  Equal vectors link with each other, so repeated rows count one another; rows that share
    an id each get a row.  Rows with a null id are returned with no links.  Other columns are ignored; an empty table
    gives an empty table.
    """
    spark = vectors.sparkSession
    bounded_batches(spark)
    scratch = Scratch(spark)
    single = vectors.schema[vec_col].dataType.simpleString() == "array<float>"
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("embedding"))
    keyed = scratch.keep(_keys(rows, single, False), "vector-keys")
    good = "key is not null and vec_id is not null"
    classes = scratch.keep(keyed.where(good).groupBy("key").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n")), "vector-classes")
    # Vectors alone of their class stay where they are; of the others one is taken.
    several = classes.where("n > 1")
    own = _keys(rows, single, True).where(good).join(F.broadcast(several) if several.count() <= BROADCAST else several, "key", "left")
    alone = own.where("n is null").select(F.col("vec_id").alias("rep"), F.lit(1).cast("long").alias("n"), "vec")
    reps = scratch.keep(alone.unionByName(own.where("vec_id = rep").dropDuplicates(["key"]).select("rep", "n", "vec")), "vector-reps")
    total = reps.count()
    found = None
    widths = [r[0] for r in reps.groupBy(F.octet_length("vec").alias("w")).count().orderBy("w").collect()]  # few widths
    for width in widths:
        tiles = _compare(reps.where(F.octet_length("vec") == width), total, threshold, pivots, single, scratch)
        found = tiles if found is None else found.unionByName(tiles)
    if found is None:
        found = spark.createDataFrame([], "id long, links long, root long")
    counts = found.groupBy("id").agg(F.sum("links").alias("links"))
    joined = components(found.where("id <> root").select(F.col("id").alias("src"), F.col("root").alias("dst")), scratch, total)
    by_class = classes.join(counts, classes["rep"] == counts["id"], "left").join(joined, classes["rep"] == joined["node"], "left")
    by_class = by_class.select("key", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    out = keyed.select("vec_id", F.when(F.col("vec_id").isNotNull(), F.col("key")).alias("key")).join(by_class, "key", "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    out = materialize(out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id"))), "vector-groups")
    scratch.drop()
    return out


def _compare(reps: DataFrame, total: int, threshold: float, pivots: int | None, single: bool, scratch: Scratch) -> DataFrame:
    """(id, links, root) of vectors of one width that link, a row for each task that found links."""
    some = _sample(reps, total, single)
    centred = some - some.mean(axis=0)
    value, axes = np.linalg.eigh(centred.T @ centred)
    axes = np.ascontiguousarray(axes[:, np.argsort(-value)])
    count = pivots or int(np.clip(total // BLOCK, 8, 1024))
    centre = some[np.linspace(0, len(some) - 1, min(count, len(some))).astype(int)]
    apart = np.sqrt(np.maximum(0.0, ((centre[:, None, :] - centre[None, :, :]) ** 2).sum(axis=2)))
    reach = np.sqrt(max(0.0, 2 - 2 * threshold)) + 1e-9

    def within(unit: np.ndarray, cell: int, others: np.ndarray | int) -> np.ndarray:
        """Which vectors of a cell can be within reach of vectors of others: a vector within reach of this one, living
        with another pivot, lies on that one's side of the plane between the two."""
        near = unit @ centre[others].T
        own = unit @ centre[cell]
        return (own if near.ndim == 1 else own[:, None]) - near <= reach * apart[cell, others] + 1e-12

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                near = _units(b"".join(batch.column("vec").to_pylist()), batch.num_rows, single) @ centre.T
                yield pa.RecordBatch.from_arrays([pa.array(near.argmax(axis=1).astype(np.int32)), *batch.columns], names=["cell", *batch.schema.names])

    placed = reps.select("rep", "n", "vec").mapInArrow(place, "cell int, rep long, n long, vec binary")
    homes = placed.groupBy("cell").count().orderBy("cell").collect()  # a row a pivot
    grid, blocks = [], 0
    for r in homes:
        grid.append((r["cell"], blocks, -(-r["count"] // BLOCK)))
        blocks += grid[-1][2]
    cells = reps.sparkSession.createDataFrame(grid, "cell int, first int, blocks int")
    number = (F.col("first") + F.pmod(F.xxhash64("rep"), F.col("blocks"))).cast("int").alias("block")
    dealt = placed.join(F.broadcast(cells), "cell").select(number, "cell", "rep", "n", "vec")

    def pack(table: pa.Table) -> pa.Table:
        vecs, cell = b"".join(table.column("vec").to_pylist()), table.column("cell")[0].as_py()
        visits = within(_units(vecs, len(table), single), cell, np.arange(len(centre))).any(axis=0)
        visits[cell] = True
        reps, ns = (table.column(c).to_numpy().astype(np.int64).tobytes() for c in ("rep", "n"))
        return pa.table({"block": table.column("block").slice(0, 1), "cell": table.column("cell").slice(0, 1), "visits": pa.array([visits.tolist()]), "reps": [reps], "ns": [ns], "vecs": [vecs]})

    kept = scratch.keep(dealt.repartition(max(FILES, -(-blocks // FILE_BLOCKS)), "block").groupBy("block").applyInArrow(pack, "block int, cell int, visits array<boolean>, reps binary, ns binary, vecs binary"), "vector-blocks")
    a, b = (kept.select(*[F.col(c).alias(f"{side}_{c}") for c in kept.columns]) for side in "ab")
    # Each pair once, and every block first in about half of its pairs.
    once = (F.col("a_block") == F.col("b_block")) | ((F.col("a_block") != F.col("b_block")) & ((F.col("a_block") < F.col("b_block")) == ((F.col("a_block") + F.col("b_block")) % 2 == 0)))
    pairs = a.join(b, once & F.get("a_visits", "b_cell") & F.get("b_visits", "a_cell")).drop("a_visits", "b_visits")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Links()
        for batch in batches:
            for r in range(batch.num_rows):
                one = lambda c: batch.column(c)[r]  # noqa: B023, E731
                (x, ids, n), (y, ids_y, n_y) = ((one(f"{s}_block").as_py(), *(np.frombuffer(one(f"{s}_{c}").as_buffer(), np.int64) for c in ("reps", "ns"))) for s in "ab")
                unit = _units(one("a_vecs").as_buffer(), len(ids), single)
                at = held.place(x, ids)
                if x == y:
                    held.add(at, at, n, n, ((u[u < v], v[u < v]) for u, v in tile_links(unit, unit, axes, threshold)))
                    continue
                cell, other = one("a_cell").as_py(), one("b_cell").as_py()
                unit_y = _units(one("b_vecs").as_buffer(), len(ids_y), single)
                here, there = (np.arange(len(ids)), np.arange(len(ids_y))) if cell == other else (np.nonzero(within(unit, cell, other))[0], np.nonzero(within(unit_y, other, cell))[0])
                held.add(at, held.place(y, ids_y), n, n_y, ((here[u], there[v]) for u, v in tile_links(unit[here], unit_y[there], axes, threshold)))  # noqa: B023
        yield from held.rows()

    tiles = scratch.keep(pairs.mapInArrow(meet, "id long, links long, root long"), "vector-tiles")
    scratch.drop(kept)
    return tiles
