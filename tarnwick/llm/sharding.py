"""Operator 12, sharding: groups of equal texts, best-fit-decreasing, in a fixed number of near-equal shards.

1. One pass over the texts gives each document's size, CRC and text digest.  Rows that are equal in these and in their
   id are one row with a multiplicity, so repeated rows cost nothing from here on.
2. A group is the rows of one text; its size is the sum of theirs.  Groups are counted by size class: sizes rounded up
   to ``BITS`` significant bits, so there are fewer than 2^BITS * 64 classes whatever the data.  This histogram is all
   that the driver sees.  Best-fit-decreasing packing treats the groups of a class alike, so its plan says how many of
   each class every shard takes.
3. Groups are numbered within their class, in bounded parts whose offsets are summed up, and the plan's ranges of
   numbers give their shards.  These are joined back to the rows; the few groups of very many rows by broadcast.
4. Rows are numbered within their shard in the same way, which gives the slots.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, bounded_batches, free_name, join_back, materialize
from .packing import balance, pack

#: Significant bits of a group's size that the plan knows: sizes are overestimated by less than one in 2^(BITS - 1).
BITS = 13
#: Rows numbered by one window at most, about; and copies of one row that are numbered together.
PART, COPIES = 4096, 65_536


def size_class(size: Column, bits: int = BITS) -> Column:
    """The size, rounded up to ``bits`` significant bits."""
    drop = F.greatest(F.length(F.bin(size)) - F.lit(bits), F.lit(0))
    step = F.call_function("shiftleft", F.lit(1).cast("long"), drop)
    return F.ceil(size / step).cast("long") * step


def _numbered(rows: DataFrame, scratch: Scratch, key: str, tie: list[str], counts: DataFrame, weight: str | None = None) -> DataFrame:
    """``rows`` with ``start`` long: how much ``weight`` (1 each) stands before each within its ``key``.

    ``counts`` (key, parts) says into how many parts a key's rows are dealt by the hash of ``tie``.  Rows are read twice.
    """
    amount = F.lit(1).cast("long") if weight is None else F.col(weight)
    dealt = rows.join(counts, key).withColumn("part", F.pmod(F.xxhash64(*tie), F.col("parts"))).drop("parts")
    sums = dealt.groupBy(key, "part").agg(F.sum(amount).alias("held"))
    before = Window.partitionBy(key).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = scratch.keep(sums.select(key, "part", F.coalesce(F.sum("held").over(before), F.lit(0)).alias("offset")), "offsets")
    upto = Window.partitionBy(key, "part").orderBy(*tie).rowsBetween(Window.unboundedPreceding, -1)
    ranked = dealt.withColumn("start", F.coalesce(F.sum(amount).over(upto), F.lit(0)))
    return ranked.join(offsets, [key, "part"]).withColumn("start", F.col("start") + F.col("offset")).drop("offset", "part")


def describe(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, digest, size, text_crc32): null texts are as empty ones."""
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit("")).cast("binary")
    return docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.unhex(F.md5(text)).alias("digest"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))


def _groups(rows: DataFrame, bits: int) -> DataFrame:
    groups = rows.groupBy("digest").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("size")).alias("bytes"))
    return groups.select("digest", "n", size_class(F.col("bytes"), bits).alias("class"))


def _shard_of(spark: SparkSession, groups: DataFrame, scratch: Scratch, shards: int | None, capacity: int | None) -> DataFrame:
    """(digest, n, shard) by the plan over the histogram of size classes."""
    runs = [(r["class"], r["count"]) for r in groups.groupBy("class").count().collect()]  # bounded by the size classes
    plan = balance(runs, shards) if capacity is None else pack(runs, capacity)
    upto: dict[int, int] = {}
    steps: dict[int, list[tuple[int, int]]] = {}
    for size, number, count in plan:
        upto[size] = upto.get(size, 0) + count
        steps.setdefault(size, []).append((upto[size], number))
    table = spark.createDataFrame([(size, -(-upto[size] // PART), s) for size, s in steps.items()], "class long, parts long, steps array<struct<upto:long,shard:int>>")
    table = F.broadcast(scratch.keep(table, "plan", 1))
    ranked = _numbered(groups, scratch, "class", ["digest"], table.select("class", "parts"))
    found = F.filter("steps", lambda s: s["upto"] > F.col("start"))
    return ranked.join(table.select("class", "steps"), "class").select("digest", "n", F.element_at(found, 1)["shard"].alias("shard"))


def _planned(docs: DataFrame, scratch: Scratch, shards: int | None, capacity: int | None, id_col: str, text_col: str, bits: int) -> tuple[DataFrame, DataFrame, int]:
    """Rows with multiplicities, the shard of each group, and how many rows there are."""
    described = describe(docs, id_col, text_col)
    rows = scratch.keep(described.groupBy(*described.columns).agg(F.count("*").alias("n")), "shard-rows")
    groups = scratch.keep(_groups(rows, bits), "shard-groups")
    total = rows.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    return rows, scratch.keep(_shard_of(docs.sparkSession, groups, scratch, shards, capacity), "shard-of"), total


def sharded(docs: DataFrame, shards: int | None = 8, capacity: int | None = None, id_col: str = "doc_id", text_col: str = "text", bits: int = BITS) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) of every row of ``docs``, under the law ``bytes``.

    ``size`` is the text's UTF-8 bytes plus 1; null texts count as empty ones and are of their group.  Rows of equal
    texts share a shard, also where they are more than an equal share: such a group has a shard of its own, and the
    others share the rest evenly.  With ``capacity`` in place of ``shards``, shards of so many bytes are opened as they
    are needed; a larger group has one of its own.  ``slot`` numbers a shard's rows without a gap from 0, in an order
    that depends on ids and texts alone.  ``grown_shard`` is null, as adding a shard moves groups between all.  Null
    and repeated ids each keep their rows.  Other columns are ignored; an empty table gives an empty table.
    """
    if (shards is None) == (capacity is None):
        raise ValueError("give either shards or capacity")
    spark = docs.sparkSession
    bounded_batches(spark)
    scratch = Scratch(spark)
    rows, of, total = _planned(docs, scratch, shards, capacity, id_col, text_col, bits)
    placed = join_back(rows.withColumnRenamed("n", "times"), of, "digest", total)
    # A row of very many copies is numbered in pieces, so that they are dealt out.
    pieces = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("times") - 1) / COPIES)))
    placed = placed.withColumn("piece", pieces).withColumn("times", F.least(F.lit(COPIES).cast("long"), F.col("times") - F.col("piece") * COPIES))
    placed = scratch.keep(placed, "placed")
    parts = placed.groupBy("shard").agg(F.ceil(F.count("*") / F.lit(PART)).alias("parts"))
    numbered = _numbered(placed, scratch, "shard", ["doc_id", "digest", "piece"], scratch.keep(parts, "shard-parts"), "times")
    slots = F.explode(F.sequence("start", F.col("start") + F.col("times") - 1)).alias("slot")
    out = numbered.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", slots, F.lit(None).cast("int").alias("grown_shard"))
    out = materialize(out, "shards")
    scratch.drop()
    return out


def with_shard(docs: DataFrame, shards: int | None = 8, capacity: int | None = None, id_col: str = "doc_id", text_col: str = "text", shard_col: str = "shard", bits: int = BITS) -> DataFrame:
    """Every row and column of ``docs`` with its shard, ready for ``write.partitionBy``; as in ``sharded``.

    An existing ``shard_col`` is replaced.
    """
    bounded_batches(docs.sparkSession)
    scratch = Scratch(docs.sparkSession)
    kept = [c for c in docs.columns if c.lower() != shard_col.lower()]
    _, of, total = _planned(docs, scratch, shards, capacity, id_col, text_col, bits)
    digest, n, shard = (free_name(x, [*docs.columns, shard_col]) for x in ("digest", "n", "found"))
    keyed = docs.withColumn(digest, F.unhex(F.md5(F.coalesce(F.col(f"`{text_col}`"), F.lit("")).cast("binary"))))
    scratch.drop(*[t for t in scratch.tables if t is not of])
    found = of.select(F.col("digest").alias(digest), F.col("n").alias("n"), F.col("shard").alias(shard))
    return join_back(keyed, found, digest, total).select(*[F.col(f"`{c}`") for c in kept], F.col(shard).alias(shard_col))
