"""Triples as an edge table: dedupe, normalise, hops, centrality."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULTS
from ..functions import text as X


def present(*names: str) -> Column:
    """The first of some columns that is neither null nor empty."""
    return F.coalesce(*[F.when(F.col(n) != "", F.col(n)) for n in names])


def normalize_triples(items: DataFrame) -> DataFrame:
    """head, relation and tail from their alternative names; rows that lack one go."""
    out = items.withColumn("head", X.strip(present("head", "h", "entity1"))).withColumn("relation", X.strip(present("relation", "rel", "predicate"))).withColumn("tail", X.strip(present("tail", "t", "entity2")))
    return out.drop("h", "entity1", "rel", "predicate", "t", "entity2").where("head is not null and relation is not null and tail is not null")


def dedupe_triples(rows: DataFrame, keys: tuple[str, ...], order: tuple[str, ...]) -> DataFrame:
    """The first row of each key, compared trimmed and lower-cased."""
    by = Window.partitionBy(*[F.lower(F.trim(F.coalesce(k, F.lit("")))) for k in keys]).orderBy(*order)
    return rows.withColumn("__n", F.row_number().over(by)).where("__n = 1").drop("__n")


def postprocess_triples(rows: DataFrame, order: str = "seq", per_chunk: int = DEFAULTS.kg_triples_per_chunk) -> DataFrame:
    """Lengths checked, relation spaces collapsed, repeats within a chunk dropped, at most ``per_chunk`` kept."""
    clean = rows.withColumn("head", X.strip(F.col("head"))).withColumn("tail", X.strip(F.col("tail"))).withColumn("relation", F.regexp_replace(X.strip(F.col("relation")), r"(?U)\s+", " "))
    fit = clean.where((F.length("head").between(1, 200)) & (F.length("tail").between(1, 500)) & (F.length("relation") <= 120))
    once = dedupe_triples(fit, ("chunk_id", "head", "relation", "tail"), (order,))
    return once.withColumn("__n", F.row_number().over(Window.partitionBy("chunk_id").orderBy(order))).where(F.col("__n") <= per_chunk).drop("__n")


def edges(triples: DataFrame) -> DataFrame:
    return triples.where("head <> '' and relation <> '' and tail <> ''")


def vertices(triples: DataFrame) -> DataFrame:
    return edges(triples).select(F.explode(F.array("head", "tail")).alias("entity")).distinct()


def degrees(triples: DataFrame) -> DataFrame:
    """In plus out; an edge to itself counts twice."""
    return edges(triples).select(F.explode(F.array("head", "tail")).alias("entity")).groupBy("entity").agg(F.count("*").alias("degree"))


def hops(triples: DataFrame, seeds: DataFrame, count: int = DEFAULTS.kg_hops, most: int = DEFAULTS.kg_max_triples, keep: Callable[[DataFrame], DataFrame] = lambda rows: rows) -> tuple[DataFrame, DataFrame]:
    """Triples around seeds (query_id, entity, and ``place`` if some come before others) and the chunks' votes.

    Each hop follows out-edges, then in-edges, of the entities reached last and not visited before; every traversed
    edge votes for its chunk, a triple is kept once.  The order (hop, place of the seed, entity, out before in, seq)
    makes the cap definite.

    The traversal stops with the edge that fills the subgraph, so of every (entity, way) only its first edges can be
    walked: an entity's edges of one way hold no more than ``most`` distinct triples before the stop, and a repeated
    triple stands next to its like.  Edges of the entities that some query has reached are cut to those first of each
    entity once, for all queries, and a query's walk is cut to the stop at each hop before the next one joins; no step
    holds a hub's edges for every query.  ``keep`` may store the walk after each hop, as all that follows reads it.
    """
    e = edges(triples)
    both = e.withColumn("entity", F.col("head")).withColumn("way", F.lit(0)).unionByName(e.withColumn("entity", F.col("tail")).withColumn("way", F.lit(1)))
    at = F.struct("hop", "place", "entity", "way", "seq")
    place = F.min("place" if "place" in seeds.columns else F.lit(0)).cast("int").alias("place")
    front = seeds.groupBy("query_id", "entity").agg(place)
    walked, visited = None, front.select("query_id", "entity")
    for hop in range(count):
        near = _first_edges(both.join(front.select("entity").distinct(), "entity", "left_semi"), most)
        step = front.join(near, "entity").select("query_id", F.lit(hop).alias("hop"), "place", "entity", "way", *e.columns)
        walked = keep(_until_full(step if walked is None else walked.unionByName(step), at, most))
        if hop + 1 < count:
            reached = walked.where(F.col("hop") == hop).select("query_id", F.when(F.col("way") == 0, F.col("tail")).otherwise(F.col("head")).alias("entity")).distinct()
            # What is reached past the stop is not walked from, as the walk is over then.
            front = reached.join(visited, ["query_id", "entity"], "left_anti").withColumn("place", F.lit(0))
            visited = visited.unionByName(front.select("query_id", "entity"))
    kept = walked.groupBy("query_id", "head", "relation", "tail").agg(F.min(at).alias("at"), F.min_by("chunk_id", at).alias("chunk_id"))
    kept = kept.withColumn("n", F.row_number().over(Window.partitionBy("query_id").orderBy("at"))).where(F.col("n") <= most)
    votes = walked.groupBy("query_id", "chunk_id").agg(F.count("*").alias("votes"))
    return kept.select("query_id", F.col("at.hop").alias("hop"), "head", "relation", "tail", "chunk_id", "n"), votes


def _first_edges(edges_of: DataFrame, most: int) -> DataFrame:
    """Of each (entity, way) the edges up to the first one of its ``most``-th distinct triple."""
    key = ["entity", "way"]
    # The place of a triple among an entity's distinct ones is that of its first edge; edges up to place ``most`` stay.
    first = edges_of.groupBy(*key, "head", "relation", "tail").agg(F.min("seq").alias("first"))
    place = F.row_number().over(Window.partitionBy(*key).orderBy("first"))
    last = first.withColumn("n", place).where(F.col("n") <= most).groupBy(*key).agg(F.max("first").alias("until"), F.max("n").alias("n"))
    return edges_of.join(last, key).where((F.col("n") < most) | (F.col("seq") <= F.col("until"))).drop("until", "n")


def _until_full(walked: DataFrame, at: Column, most: int) -> DataFrame:
    """The walk of each query up to the edge that makes its ``most``-th distinct triple, or all of it."""
    once = walked.groupBy("query_id", "head", "relation", "tail").agg(F.min(at).alias("at"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("at"))
    full = once.withColumn("n", place).where(F.col("n") == most).select("query_id", F.col("at").alias("stop"))
    return walked.join(full, "query_id", "left").where(F.col("stop").isNull() | (at <= F.col("stop"))).drop("stop")


def central(triples: DataFrame, top: int = 5, most: int = 50) -> DataFrame:
    """Triples around the ``top`` entities of highest degree, out-edges before in-edges, each once, at most ``most``."""
    best = degrees(triples).orderBy(F.desc("degree"), "entity").limit(top)
    best = best.withColumn("place", F.row_number().over(Window.orderBy(F.desc("degree"), "entity")))  # ``top`` rows
    e, b = edges(triples), F.broadcast(best)
    out = e.join(b, e["head"] == b["entity"]).withColumn("way", F.lit(0))
    into = e.join(b, e["tail"] == b["entity"]).withColumn("way", F.lit(1))
    at = F.struct("place", "way", "seq")
    kept = out.unionByName(into).groupBy("head", "relation", "tail").agg(F.min(at).alias("at"), F.min_by("chunk_id", at).alias("chunk_id"))
    first = kept.orderBy("at").limit(most)
    return first.withColumn("n", F.row_number().over(Window.orderBy("at"))).select("n", "head", "relation", "tail", "chunk_id")  # ``most`` rows


def refresh(spark, path: str, *stale: DataFrame) -> DataFrame:
    """The edges of a triple store as it is now; what was kept of it before (edges, entity vectors) is let go."""
    from ..sources.collection import read_triples

    for table in stale:
        table.unpersist()
    return edges(read_triples(spark, path))


def candidate_score(rank: Column, k: int = DEFAULTS.kg_top_k) -> Column:
    """Score of the graph channel at a rank counted from 0."""
    return F.round(F.lit(DEFAULTS.kg_score_base) + F.greatest(F.lit(k) - rank, F.lit(0)) / F.lit(max(k, 1)) * 0.1, 6)


def as_lines(rows: DataFrame, order: str = "n") -> DataFrame:
    """One text of "(head) -[relation]-> (tail)" lines; a subgraph is bounded by its cap."""
    line = F.format_string("(%s) -[%s]-> (%s)", "head", "relation", "tail")
    listed = rows.agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("n"), line.alias("line")))).alias("l"))
    return listed.select(F.array_join(F.transform("l", lambda x: x["line"]), "\n").alias("text"))
