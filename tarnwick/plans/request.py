"""Whole requests: rewriting, routing, alignment, retrieval on both routes, and the trace, as one plan over many questions.

Every decision is a column of the question, so rows of both routes go through the same plan: those routed to the graph
as a whole get its central structure in front of what the local plan finds for all.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import models as M
from ..operators import retrieval as R
from ..operators.answer import trace
from ..operators.route import route
from . import retrieve as P
from . import tables as T

#: Fixed value: what stands before a request's own subgraph.
SUBGRAPH = "以下是检索到的知识图谱相关子图：\n"
SECTIONS = ("global", "local", "subgraph")


@dataclass(frozen=True)
class Plugins:
    """What a caller has: batch functions that rewrite and align, and prototypes (intent, vec) to route by.  Without one
    its step is left out: the question stays, the route is local."""

    rewriter: M.Batch | None = None
    aligner: M.Batch | None = None
    prototypes: DataFrame | None = None
    wait: float = 1.0


def understood(questions: DataFrame, history: DataFrame | None, plugins: Plugins) -> DataFrame:
    """(query_id, query, rewritten, route, route_info, aligned, align_triggered, alignment), written once, as several
    channels read it and models should not be asked again.

    ``history`` (conv_id, turn, role, text) are messages before the question whose id is ``conv_id``.
    """
    asked = questions.select("query_id", "query")
    if plugins.rewriter is not None and history is not None:
        got = M.rewrite(asked.withColumnRenamed("query_id", "conv_id"), history, plugins.rewriter, plugins.wait)
        asked = got.select(F.col("conv_id").alias("query_id"), "query", "rewritten")
    else:
        asked = asked.withColumn("rewritten", F.col("query"))
    if plugins.aligner is not None:
        done = M.align(asked.select("query_id", F.col("query").alias("original"), F.col("rewritten").alias("query")), plugins.aligner, wait=plugins.wait)
        asked = done.select("query_id", F.col("original").alias("query"), F.col("query").alias("rewritten"), F.col("search_query").alias("aligned"), F.col("alignment.should_expand").alias("align_triggered"), F.to_json("alignment").alias("alignment"))
    else:
        asked = asked.select("*", F.col("rewritten").alias("aligned"), F.lit(False).alias("align_triggered"), F.lit("{}").alias("alignment"))
    if plugins.prototypes is not None:
        asked = P.stored(asked, "worded")
        vectors = R.dense(R.hashed_terms(asked, "query_id", "rewritten")).select(F.col("id").alias("query_id"), "vec")
        went = route(asked.select("query_id").join(vectors, "query_id", "left"), plugins.prototypes)
        to = F.when((F.col("decision") == "routed") & (F.col("best") == "global"), "global").otherwise("local")
        asked = asked.join(went.select("query_id", to.alias("route"), F.to_json(F.struct("best", "score", "margin", "decision")).alias("route_info")), "query_id")
    else:
        asked = asked.select("*", F.lit("local").alias("route"), F.lit("{}").alias("route_info"))
    return P.stored(asked, "understood")


def contexts(spark: SparkSession, sf_dir: str, asked: DataFrame, mode: str = "hybrid", use_kg: bool = True, use_rerank: bool = True, use_parents: bool = False) -> DataFrame:
    """(query_id, ctx_pos, id, source, kind, score, text) of understood questions: the global contexts of those routed
    there, the local ones, the subgraph that the question's entities span.

    Only the vector channel searches with the aligned question; keywords and the graph need the exact words.
    """
    exact = asked.select("query_id", F.col("rewritten").alias("query"))
    triples = T.triples(spark, sf_dir)
    channels, table = {}, P.words(spark, sf_dir)
    if mode != "bm25":
        channels["vector"] = P.vector_channel(spark, sf_dir, asked.select("query_id", F.col("aligned").alias("query")), table)
    if mode != "vector":
        channels["bm25"] = P.keyword_channel(spark, sf_dir, exact, table)
    kept = None
    if use_kg:
        kept, votes = P.walk(spark, sf_dir, triples, exact)
        channels["kg"] = P.voted(votes)
    local = P.stored(P.retrieve(spark, sf_dir, mode, use_kg, use_rerank, use_parents, exact, channels), "local")
    notes = T.notes(spark, sf_dir)
    # The few contexts pick their texts first, so that no other text is shuffled.
    texts = notes.select(F.col("id").cast("string").alias("id"), "text").join(local.select("id"), "id", "left_semi")
    if use_parents:
        wanted = notes.join(local.where("kind = 'parent'").select("source").distinct(), "source", "left_semi")
        whole = wanted.groupBy("source").agg(F.array_sort(F.collect_list(F.struct("chunk_index", "text"))).alias("c"))  # a note's few chunks
        texts = texts.unionByName(whole.select(F.concat("source", F.lit("#p")).alias("id"), F.array_join(F.transform("c", lambda c: c["text"]), "\n\n").alias("text")))
    rows = local.join(texts, "id", "left").select("query_id", F.lit(1).alias("section"), F.col("ctx_pos").alias("pos"), "id", "source", "kind", "score", "text")
    found = P.global_contexts(spark, triples if use_kg else None, T.chunk_texts(spark, sf_dir))
    place = F.row_number().over(Window.orderBy(F.desc("score"), "id"))  # the macro structure and a few sources
    found = found.select(F.lit("global").alias("route"), place.alias("pos"), "id", "source", "score", "text")
    # A few rows, for the questions that go there.
    whole = asked.select("query_id", "route").join(F.broadcast(found), "route").select("query_id", F.lit(0).alias("section"), "pos", "id", "source", F.lit("global").alias("kind"), "score", "text")
    rows = rows.unionByName(whole)
    if kept is not None:
        line = F.format_string("(%s) -[%s]-> (%s)", "head", "relation", "tail")
        lines = kept.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("n", line.alias("line")))).alias("l"))  # ``kg_max_triples`` at most
        text = F.concat(F.lit(SUBGRAPH), F.array_join(F.transform("l", lambda x: x["line"]), "\n"))
        rows = rows.unionByName(lines.select("query_id", F.lit(2).alias("section"), F.lit(1).alias("pos"), F.lit("kg_subgraph").alias("id"), F.lit("Knowledge Graph Subgraph").alias("source"), F.lit("subgraph").alias("kind"), F.lit(1.0).alias("score"), text.alias("text")))
    order = F.row_number().over(Window.partitionBy("query_id").orderBy("section", "pos"))
    return rows.select("query_id", order.alias("ctx_pos"), "id", "source", "kind", "score", "text")


def traced(asked: DataFrame, rows: DataFrame, mode: str = "hybrid", use_rerank: bool = True, use_parents: bool = False, times: dict[str, float] | None = None) -> DataFrame:
    """(query_id, contexts, trace): each question's contexts in order, and how they were come by."""
    fields = ("ctx_pos", "id", "source", "kind", "score", "text")
    listed = rows.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("contexts"))  # a request's few contexts
    every = asked.join(listed, "query_id", "left")
    kinds = F.coalesce(F.transform("contexts", lambda c: c["kind"]), F.array().cast("array<string>"))
    parents = F.size(F.filter(kinds, lambda k: k == "parent"))
    changed = ~F.col("query").eqNullSafe(F.col("rewritten"))
    told = trace(
        route_decision=F.col("route"), mode=F.lit(mode), rewrite_triggered=changed, original_query=F.col("query"), rewritten_query=F.when(changed, F.col("rewritten")),
        align_triggered=F.col("align_triggered"), aligned_query=F.col("aligned"), query_alignment=F.parse_json("alignment"), route_info=F.parse_json("route_info"),
        rerank_active=F.lit(use_rerank) & F.exists(kinds, lambda k: k.isin("seed", "parent")), parent_child_active=F.lit(use_parents) & (parents > 0),
        parent_child_unique_parents=parents, **{k: F.lit(float(v)) for k, v in (times or {}).items()},
    )
    return every.select("query_id", "contexts", told.alias("trace"))
