"""Entities that queries mention: by substring, by common words, by vectors."""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULTS
from ..functions import text as X
from . import retrieval as R

#: Patterns of one automaton, and characters of texts that one task reads through it, about.
PATTERNS, BLOCK_CHARS = 50_000, 4_000_000
#: Characters of a pattern that the automaton holds; what follows them is compared where they are found.
HEAD = 500


def occurrences(wholes: DataFrame, parts: DataFrame, patterns: int = PATTERNS, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(whole_id, part_id): which texts of ``parts`` (part_id, text) stand in which of ``wholes`` (whole_id, text).

    The parts are dealt into shards of about ``patterns`` and each shard becomes one automaton, through which a text is
    read once however many parts there are and however long they are.  Texts are dealt into blocks, so a task holds one
    shard and reads one block; all texts meet all shards.  Null and empty texts match nothing.
    """
    parts = parts.where("text <> ''").select("part_id", "text")
    wholes = wholes.where("text <> ''").select("whole_id", "text")
    shards = max(1, -(-parts.count() // patterns))
    chars = wholes.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    blocks = max(1, -(-chars // block_chars))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(int(n) - 1)))
    kinds = {n: d.schema[n].dataType.simpleString() for d, n in ((wholes, "whole_id"), (parts, "part_id"))}
    none = {n: F.lit(None).cast(kind).alias(n) for n, kind in kinds.items()}
    shard, block = F.pmod(F.xxhash64("text"), F.lit(shards)).cast("int").alias("shard"), F.pmod(F.xxhash64("text", "whole_id"), F.lit(blocks)).cast("int").alias("block")
    residents = parts.select(shard, "part_id", none["whole_id"], "text").withColumn("block", every(blocks)).withColumn("guest", F.lit(False))
    guests = wholes.select(block, none["part_id"], "whole_id", "text").withColumn("shard", every(shards)).withColumn("guest", F.lit(True))
    rows = residents.unionByName(guests).repartition("shard", "block").sortWithinPartitions("shard", "block", "guest")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = machine = None
        ready = False
        for batch in batches:
            found: tuple[list, list] = ([], [])
            for s, b, guest, whole, part, text in zip(*[batch.column(n).to_pylist() for n in ("shard", "block", "guest", "whole_id", "part_id", "text")], strict=True):
                if at != (s, b):
                    at, machine, ready = (s, b), ahocorasick.Automaton(), False
                if not guest:
                    held = machine.get(text[:HEAD], None)
                    if held is None:
                        machine.add_word(text[:HEAD], [(part, text[HEAD:])])
                    else:
                        held.append((part, text[HEAD:]))
                    continue
                if not len(machine):
                    continue
                if not ready:
                    machine.make_automaton()
                    ready = True
                hits = {p for end, ps in machine.iter(text) for p, tail in ps if not tail or text.startswith(tail, end + 1)}
                if hits:
                    found[0].extend([whole] * len(hits))
                    found[1].extend(hits)
            if found[0]:
                yield pa.RecordBatch.from_arrays([pa.array(found[0], batch.schema.field("whole_id").type), pa.array(found[1], batch.schema.field("part_id").type)], names=["whole_id", "part_id"])

    return rows.select("shard", "block", "guest", "whole_id", "part_id", "text").mapInArrow(run, f"whole_id {kinds['whole_id']}, part_id {kinds['part_id']}").distinct()


def substring_matches(queries: DataFrame, entities: DataFrame) -> DataFrame:
    """(query_id, entity): the entity stands in the query or the query in the entity, compared normalised; entities of
    one character and empty queries match nothing."""
    q = queries.select("query_id", X.normalize(F.col("query")).alias("text"))
    e = entities.where(F.length("entity") > 1).select("entity", X.normalize(F.col("entity")).alias("text")).distinct()
    inside = occurrences(q.withColumnRenamed("query_id", "whole_id"), e.withColumnRenamed("entity", "part_id"))
    around = occurrences(e.withColumnRenamed("entity", "whole_id"), q.withColumnRenamed("query_id", "part_id"))
    return inside.toDF("query_id", "entity").unionByName(around.toDF("entity", "query_id")).distinct()


def token_matches(queries: DataFrame, entities: DataFrame) -> DataFrame:
    """(query_id, entity) with a word of more than one character in common."""
    words = lambda c: F.explode(F.filter(F.array_distinct(X.tokens(F.col(c))), lambda t: F.length(t) > 1)).alias("t")
    return queries.select("query_id", words("query")).join(entities.select("entity", words("entity")).distinct(), "t").select("query_id", "entity").distinct()


def entity_id(entity: Column) -> Column:
    """60 bits of the name's MD5, by which vector indexes know an entity."""
    return F.conv(F.substring(F.md5(entity), 1, 15), 16, 10).cast("long")


def entity_vectors(entities: DataFrame) -> DataFrame:
    """(id, vec) of the entities by the default embedding; names without a word have none."""
    named = entities.select("entity").distinct().select(entity_id(F.col("entity")).alias("id"), "entity")
    return R.dense(R.hashed_terms(named, "id", "entity"))


def vector_matches(queries: DataFrame, entities: DataFrame, index=None, k: int = DEFAULTS.kg_top_k, least: float = DEFAULTS.kg_min_similarity) -> DataFrame:
    """(query_id, entity) of each query's ``k`` nearest entities, of which those under the cosine ``least`` then go.

    ``index`` is a vector index of ``entity_vectors``; without one all entities are scanned.
    """
    asked = R.dense(R.hashed_terms(queries, "query_id", "query")).select(F.col("id").alias("query_id"), "vec")
    top = R.vector_topk(entity_vectors(entities), asked, k) if index is None else index.topk(asked, k, exact=True)
    near = top.where((F.col("score") + 1) / 2 >= least).select("query_id", "id")
    return near.join(entities.select("entity").distinct().withColumn("id", entity_id(F.col("entity"))), "id").select("query_id", "entity")


def link_entities(queries: DataFrame, entities: DataFrame, index=None) -> DataFrame:
    """(query_id, entity, way): the entities that each question means, by substring (way 0), by a common word (1), by
    vectors (2); each once, by the first way that finds it."""
    legs = (substring_matches(queries, entities), token_matches(queries, entities), vector_matches(queries, entities, index))
    every = None
    for way, leg in enumerate(legs):
        rows = leg.select("query_id", "entity", F.lit(way).alias("way"))
        every = rows if every is None else every.unionByName(rows)
    return every.groupBy("query_id", "entity").agg(F.min("way").alias("way"))
