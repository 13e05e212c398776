"""Centroid clustering and sharding against plain loops; nulls, ties, repeats, hot groups, empty tables."""

import bisect
import hashlib
import math
import random
import zlib

import numpy as np
import pytest
from conftest import SMALL, same
from pyspark.sql import functions as F

from tarnwick.llm import centroids, packing, sharding
from tarnwick.llm import queries as Q


def plain_lloyd(rows, k, rounds, dims, scale, seed):
    """Row by row, in Python integers: (id, cluster, distance) and the centroids."""
    limit = centroids.most(dims)
    kept = []
    for ident, vec in rows:
        if vec is not None and len(vec) == dims and all(x is not None and math.isfinite(x) for x in vec):
            kept.append((ident, tuple(max(-limit, min(limit, math.floor(scale * x))) for x in vec)))
    packed = dict(zip({q for _, q in kept}, centroids.pack(np.array(list({q for _, q in kept}), np.int64).reshape(-1, dims)), strict=True))
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest() if r[0] is not None else "", packed[r[1]]))
    centres = [q for _, q in order[:k]]

    def closest(q):
        return min((sum((a - b) ** 2 for a, b in zip(q, c, strict=True)), i) for i, c in enumerate(centres))

    for _ in range(rounds):
        mine = [[] for _ in centres]
        for _, q in kept:
            mine[closest(q)[1]].append(q)
        centres = [tuple(sum(x) // len(m) for x in zip(*m, strict=True)) if m else c for c, m in zip(centres, mine, strict=True)]
    return [(ident, *closest(q)[::-1]) for ident, q in kept], centres


@pytest.mark.parametrize("wide", [1.0, 3e4, 1e30])
def test_clusters_by_definition(spark, wide):
    rng = random.Random(5)
    some = [[rng.uniform(-wide, wide) for _ in range(4)] for _ in range(30)]
    rows = [(i % 60 if i % 9 else None, rng.choice(some) if i % 3 else some[0]) for i in range(200)]
    rows += [(300, None), (301, []), (302, [1.0] * 3), (303, [1.0, None, 1.0, 1.0]), (304, [math.nan, 0.0, 0.0, 0.0]), (305, [math.inf, 0.0, 0.0, 0.0]), (306, [0.0, -0.0, 1e-9, -1e-9])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("code", F.lit("own")).withColumn("n", F.lit(7)).withColumn("cluster", F.lit(1))
    got = centroids.clustered(table, k=9, rounds=3, dims=4, scale=256, seed="s").collect()
    want, centres = plain_lloyd(rows, 9, 3, 4, 256, "s")
    key = lambda r: (r[0] is None, r)
    assert sorted(((r["vec_id"], r["cluster"], r["distance"]) for r in got), key=str) == sorted(want, key=str)
    inertia = {}
    for _, c, d in want:
        inertia[c] = inertia.get(c, 0) + d
    top = centroids.INERTIA_LIMIT
    for r in got:
        assert r["cluster_inertia"] == min(inertia[r["cluster"]], top) and r["inertia"] == min(sum(inertia.values()), top)
        assert r["centroid_sha256"] == hashlib.sha256(",".join(map(str, centres[r["cluster"]])).encode()).hexdigest()


def test_clusters_of_few_or_no_vectors(spark):
    kind = "vec_id long, embedding array<float>"
    assert centroids.clustered(spark.createDataFrame([], kind)).count() == 0
    assert centroids.clustered(spark.createDataFrame([(1, None), (2, [1.0])], kind)).count() == 0
    got = centroids.clustered(spark.createDataFrame([(i, [0.5] * 64) for i in range(5)] + [(9, [-0.25] * 64)], kind)).collect()
    assert len(got) == 6 and {r["distance"] for r in got} == {0} and len({r["cluster"] for r in got}) == 2


def test_the_query_equals_its_sql(spark, duck):
    same(Q.op11_centroid_clustering(spark, SMALL).toPandas(), duck.execute(Q.ORACLE_SQL["op11_centroid_clustering"]).df())


def test_the_tree_finds_the_tightest_bin():
    rng = random.Random(3)
    tree, plain = packing.Capacities(), []
    for i in range(3000):
        if plain and rng.random() < 0.45:
            key = plain.pop(rng.randrange(len(plain)))
            tree.remove(*key)
        else:
            key = (rng.randrange(500), i)
            bisect.insort(plain, key)
            tree.add(*key)
        size = rng.randrange(520)
        at = bisect.bisect_left(plain, (size, -1))
        assert tree.tightest(size) == (plain[at] if at < len(plain) else None)


def plain_pack(sizes, capacity):
    """Best fit decreasing, an item at a time: the bins' loads and what each item of sorted sizes went to."""
    room, went = [], []
    for size in sorted(sizes, reverse=True):
        fit = [(r, i) for i, r in enumerate(room) if r >= size]
        if fit:
            number = min(fit)[1]
        else:
            number = len(room)
            room.append(max(capacity, size))
        room[number] -= size
        went.append((size, number))
    return went


def test_runs_pack_like_single_items():
    rng = random.Random(8)
    for _ in range(200):
        sizes = [rng.choice([1, 2, 3, 5, 7, 11, 30, 70, rng.randrange(1, 90)]) for _ in range(rng.randrange(1, 80))]
        capacity = rng.randrange(60, 130)
        runs = [(s, sizes.count(s)) for s in set(sizes)]
        got = packing.pack(runs, capacity)
        want = plain_pack(sizes, capacity)
        assert sorted(x for s, b, c in got for x in [(s, b)] * c) == sorted(want)
        loads = {}
        for s, b, c in got:
            loads[b] = loads.get(b, 0) + s * c
        assert all(v <= capacity or v in sizes for v in loads.values()) and sorted(loads) == list(range(len(loads)))
        assert len(loads) <= 1 + 2 * sum(sizes) / capacity + sum(s > capacity for s in sizes)


def test_balanced_loads():
    rng = random.Random(9)
    for most in (3, 40, 400):
        sizes = [rng.randrange(1, most) for _ in range(3000)] + [5000, 90_000]
        runs = [(s, sizes.count(s)) for s in set(sizes)]
        loads, items = [0] * 8, 0
        for s, b, c in packing.balance(runs, 8):
            loads[b] += s * c
            items += c
        assert items == len(sizes) and max(loads) >= 90_000
        rest = sorted(loads)[:-1]
        assert rest[-1] - rest[0] <= max(5000 - rest[0], 10) or rest[-1] == 5000
    assert packing.balance([], 8) == [] and packing.balance([(4, 1)], 8) == [(4, 0, 1)]


def check_shards(rows, docs, shards):
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["size"], r["text_crc32"]) for r in rows) == sorted((i is None, i or 0, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in docs)
    by = {}
    for r in rows:
        by.setdefault(r["shard"], []).append(r["slot"])
        assert r["law"] == "bytes" and r["grown_shard"] is None and 0 <= r["shard"] < shards
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    group = {}
    for r in rows:
        group.setdefault((r["size"], r["text_crc32"]), set()).add(r["shard"])
    assert all(len(s) == 1 for s in group.values())


@pytest.mark.parametrize("part", [3, 4096])
def test_shards_of_awkward_rows(spark, monkeypatch, part):
    monkeypatch.setattr(sharding, "PART", part)
    monkeypatch.setattr(sharding, "COPIES", 4)
    docs = [(i, f"text {i % 70} " + "x" * (i * 37 % 211)) for i in range(300)] + [(i, "hot") for i in range(400, 700)] + [(7, "same row")] * 41
    docs += [(None, "é" * 30)] * 9 + [(None, None), (None, ""), (5, None), (6, ""), (1, "long " * 20_000)]
    table = spark.createDataFrame(docs, "doc_id long, text string")
    for c in ("n", "size", "shard", "digest", "start", "class", "part", "times", "piece"):
        table = table.withColumn(c, F.lit("own " + c))
    rows = sharding.sharded(table, 5).collect()
    check_shards(rows, docs, 5)
    assert len({r["shard"] for r in rows}) == 5
    again = sharding.sharded(table.repartition(3, "text"), 5).collect()
    assert sorted(map(str, rows)) == sorted(map(str, again))
    whole = sharding.with_shard(table, 5)
    assert whole.columns == [c for c in table.columns if c != "shard"] + ["shard"]
    assert sorted((r["shard"], str(r["doc_id"]), r["text"] or "") for r in whole.collect()) == sorted((r["shard"], str(r["doc_id"]), r["text"] or "") for r in whole.collect())
    spread = {(zlib.crc32((r["text"] or "").encode()), r["shard"]) for r in whole.collect()}
    assert spread == {(r["text_crc32"], r["shard"]) for r in rows} and whole.where("n <> 'own n' or digest <> 'own digest'").count() == 0


def test_shards_of_fixed_capacity(spark):
    docs = [(i, "w" * (i * 7919 % 900)) for i in range(500)] + [(900, "z" * 5000)]
    rows = sharding.sharded(spark.createDataFrame(docs, "doc_id long, text string"), None, 2000, bits=40).collect()
    loads, sizes = {}, {}
    for r in rows:
        loads[r["shard"]] = loads.get(r["shard"], 0) + r["size"]
        sizes[r["text_crc32"]] = sizes.get(r["text_crc32"], 0) + r["size"]
    want = {}
    for size, b in plain_pack(list(sizes.values()), 2000):
        want[b] = want.get(b, 0) + size
    assert loads == want


def test_shards_are_near_equal(spark):
    rows = Q.op12_sharding(spark, "/root/testdata/sf0.01").groupBy("shard").agg(F.sum("size").alias("bytes")).collect()
    loads = [r["bytes"] for r in rows]
    assert len(loads) == 8 and max(loads) <= 1.001 * min(loads)


def test_no_rows_no_shards(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert sharding.sharded(none).count() == 0 and sharding.sharded(none, None, 10).count() == 0 and sharding.with_shard(none).count() == 0
    with pytest.raises(ValueError, match="either"):
        sharding.sharded(none, 8, 100)
