"""Whole retrieval plans over ``documents`` for every ``benchmark`` text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import DEFAULTS
from ..operators import graph as G
from ..operators import retrieval as R
from ..operators.match import link_entities
from ..sources.versions import shared_folder
from . import tables as T

#: Fixed value: what stands before the central structure.
MACRO = "以下是整个知识库的宏观核心知识结构（核心实体关系）：\n"


#: Rows of a batch for Python while a step is written.
BATCH, ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", 1000


def stored(rows: DataFrame, name: str) -> DataFrame:
    """``rows`` written to the shared folder and read back, for what several steps of a plan read."""
    path, conf = shared_folder(rows.sparkSession, name), rows.sparkSession.conf
    before = conf.get(BATCH)
    try:  # texts and word lists meet Python in small batches
        conf.set(BATCH, min(int(before), ROWS) if int(before) > 0 else ROWS)
        rows.write.parquet(path)
    finally:
        conf.set(BATCH, before)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The word table of ``documents``, written to the shared folder: one reading of the texts for all channels."""
    return stored(R.word_table(T.texts(spark, sf_dir)), "words")


def vector_channel(spark: SparkSession, sf_dir: str, asked: DataFrame | None = None, table: DataFrame | None = None) -> DataFrame:
    """``table`` is what ``words`` wrote, if several channels share it.  A channel's few rows are written, so that all that
    follows reads them instead of searching again."""
    docs = (words(spark, sf_dir) if table is None else table).where("vec is not null").select("id", "vec")
    asked = T.questions(spark, sf_dir) if asked is None else asked
    return stored(R.vector_topk(docs, R.dense(R.hashed_terms(asked, "query_id", "query")).select(F.col("id").alias("query_id"), "vec")), "vector")


def keyword_channel(spark: SparkSession, sf_dir: str, asked: DataFrame | None = None, table: DataFrame | None = None) -> DataFrame:
    scores = R.bm25_of_words(words(spark, sf_dir) if table is None else table, T.questions(spark, sf_dir) if asked is None else asked, DEFAULTS.recall_k)
    return stored(R.bm25_topk(scores), "bm25")


def graph_seeds(spark: SparkSession, sf_dir: str, triples: DataFrame, asked: DataFrame | None = None) -> DataFrame:
    """(query_id, entity, place): the entities that the questions mean, in the order of the ways that find them."""
    linked = link_entities(T.mentions(spark, sf_dir, asked), T.entities(triples))
    return stored(linked.select("query_id", "entity", F.col("way").alias("place")), "seeds")


def walk(spark: SparkSession, sf_dir: str, triples: DataFrame, asked: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """The subgraphs that the questions' entities span, and the chunks' votes."""
    return G.hops(triples, graph_seeds(spark, sf_dir, triples, asked), keep=lambda rows: stored(rows, "walk"))


def graph_channel(spark: SparkSession, sf_dir: str, asked: DataFrame | None = None) -> DataFrame:
    """Documents that the walk from a question's entities votes for: here the derived triples' chunks, by customer key
    modulo documents."""
    return voted(walk(spark, sf_dir, T.triples(spark, sf_dir), asked)[1])


def voted(votes: DataFrame) -> DataFrame:
    """(query_id, id, rank, score): the documents with most votes."""
    best = R.ranked(votes, "votes", "chunk_id", DEFAULTS.kg_top_k)
    return best.select("query_id", F.regexp_extract("chunk_id", r"(\d+)$", 1).cast("long").alias("id"), "rank", G.candidate_score(F.col("rank") - 1).alias("score"))


def fuse(vector: DataFrame, keyword: DataFrame) -> DataFrame:
    d = DEFAULTS
    both = R.named(vector, "vector").unionByName(R.named(keyword, "bm25"))
    return R.ranked(R.rrf(both, {"vector": d.weight_vector, "bm25": d.weight_bm25}), "score", "id", d.recall_k)


def hybrid(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = words(spark, sf_dir)
    return stored(fuse(vector_channel(spark, sf_dir, table=table), keyword_channel(spark, sf_dir, table=table)), "hybrid")


def global_contexts(spark: SparkSession, triples: DataFrame | None, texts: DataFrame, sources: int = 3, summarise=None, wait: float = 1.0) -> DataFrame:
    """(id, text, source, score_type, score): the graph's central structure as one text, and the ``sources`` chunks
    (chunk_id, text, source) it stands on most.  Without a graph, one row that says so.  ``summarise``, a batch
    function from texts to texts, turns all of it into one row; where it fails, the rows stay."""
    kind = "id string, text string, source string, score_type string, score double"
    if triples is None:
        return spark.createDataFrame([("global_fallback", "An overview of everything needs the knowledge graph; only local retrieval is on.", "system", None, 1.0)], kind)
    kept = G.central(triples)
    macro = G.as_lines(kept).where("text <> ''").select(F.lit("global_kg_macro").alias("id"), F.concat(F.lit(MACRO), F.col("text")).alias("text"), F.lit("Knowledge Graph Macro").alias("source"), F.lit("kg_centrality").alias("score_type"), F.lit(1.0).alias("score"))
    best = kept.groupBy("chunk_id").agg(F.count("*").alias("votes")).orderBy(F.desc("votes"), "chunk_id").limit(sources)
    found = texts.join(F.broadcast(best), "chunk_id").select(F.col("chunk_id").alias("id"), "text", "source", F.lit(None).cast("string").alias("score_type"), F.lit(0.9).alias("score"))
    rows = macro.unionByName(found)
    if summarise is None:
        return rows
    from ..operators import models as M

    told = rows.agg(F.array_sort(F.collect_list(F.struct(-F.col("score"), "id", "source", "text"))).alias("c"))  # ``sources`` rows and one
    asked = M.ask(told, F.when(F.size("c") > 0, F.array_join(F.transform("c", lambda c: F.concat(F.lit("[来源: "), c["source"], F.lit("]\n"), c["text"])), "\n\n---\n\n")), summarise, wait)
    done = asked.where("error is null and trim(reply) <> ''").first()  # one row
    return rows if done is None else spark.createDataFrame([("global_summary", done["reply"], "global_summary", "derived_context_max_score", 1.0)], kind)


def children_instead(base: DataFrame, parents: DataFrame, notes: DataFrame) -> DataFrame:
    """The best children themselves, for queries of which no parent was found."""
    alone = base.where(F.col("rank") <= DEFAULTS.final_k).join(parents.select("query_id"), "query_id", "left_anti")
    alone = alone.join(notes.select("id", "source", "chunk_index").join(alone.select("id"), "id", "left_semi"), "id", "left")
    return alone.select("query_id", F.col("rank").alias("ctx_pos"), F.col("id").cast("string").alias("id"), "source", "chunk_index", F.lit("child").alias("kind"), "score")


def retrieve(
    spark: SparkSession, sf_dir: str, mode: str = "hybrid", use_kg: bool = True, use_rerank: bool = True, use_parents: bool = False,
    asked: DataFrame | None = None, channels: dict[str, DataFrame] | None = None,
) -> DataFrame:
    """Contexts in order: (query_id, ctx_pos, id, source, chunk_index, kind, score).  The switches choose the plan.

    ``asked`` (query_id, query) takes the place of the benchmark texts.  ``channels`` (vector, bm25, kg) are results
    that a caller has already, so that several plans over the same queries search once.
    """
    have = channels or {}
    asked = T.questions(spark, sf_dir) if asked is None else asked
    wanted = {"vector": ("vector",), "bm25": ("bm25",)}.get(mode, ("vector", "bm25"))
    table = None if set(wanted) <= set(have) else words(spark, sf_dir)
    vector = lambda: have["vector"] if "vector" in have else vector_channel(spark, sf_dir, asked, table)
    keyword = lambda: have["bm25"] if "bm25" in have else keyword_channel(spark, sf_dir, asked, table)
    base = vector() if mode == "vector" else keyword() if mode == "bm25" else fuse(vector(), keyword())
    base = base.select("query_id", "id", "score", "rank")
    if use_kg:
        d = DEFAULTS
        graph = have["kg"] if "kg" in have else graph_channel(spark, sf_dir, asked)
        fused = R.rrf(R.named(base, "base").unionByName(R.named(graph, "kg")), {"base": 1.0, "kg": d.weight_kg})
        base = R.ranked(fused, "score", "id").select("query_id", "id", "score", "rank")
    # Each step's few rows are written: what follows reads them several times, and joins them to all notes by broadcast.
    base = stored(base, "base")
    notes = T.notes(spark, sf_dir)
    if use_parents:
        hits = base.where(F.col("rank") <= DEFAULTS.recall_k).join(notes, "id").select("query_id", F.concat("source", F.lit("#p")).alias("parent_id"), "score")
        rows = stored(R.rollup_parents(hits), "parents")
        if use_rerank:  # all rolled-up parents are rescored before the cut
            rows = stored(R.rerank_parents(rows, notes.withColumn("parent_id", F.concat("source", F.lit("#p"))), asked), "rescored")
        rows = rows.where(F.col("rank") <= DEFAULTS.final_k)
        out = rows.select("query_id", F.col("rank").alias("ctx_pos"), F.col("parent_id").alias("id"), F.regexp_replace("parent_id", "#p$", "").alias("source"), F.lit(0).alias("chunk_index"), F.lit("parent").alias("kind"), "score")
        return out.unionByName(children_instead(base, out, notes))
    seeds = base.where(F.col("rank") <= DEFAULTS.final_k).join(notes, "id")
    if use_rerank:
        seeds = R.rerank(seeds.join(asked, "query_id"))
    seeds = stored(seeds.select("query_id", "id", "source", "chunk_index", "score", "rank"), "found")
    near = R.neighbors(seeds, notes)
    place = F.lit(1000) + F.row_number().over(R.Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    every = seeds.select("query_id", "id", "source", "chunk_index", "score", F.lit("seed").alias("kind"), F.col("rank").alias("pos")).unionByName(near.select("query_id", "id", "source", "chunk_index", "score", F.lit("neighbor").alias("kind"), place.alias("pos")))
    return R.order_contexts(every).select("query_id", "ctx_pos", F.col("id").cast("string").alias("id"), "source", "chunk_index", "kind", "score")

def retrieve_with_trace(spark: SparkSession, sf_dir: str, mode: str = "hybrid", use_kg: bool = True, use_rerank: bool = True, use_parents: bool = False, asked: DataFrame | None = None, times: dict[str, float] | None = None) -> DataFrame:
    """(query_id, contexts, trace): a request's contexts in order, with how they were come by.  ``times`` are stage
    milliseconds that the caller took with ``metrics.Timer``; a request without contexts has an empty list."""
    from ..operators.answer import trace

    asked = T.questions(spark, sf_dir) if asked is None else asked
    rows = retrieve(spark, sf_dir, mode, use_kg, use_rerank, use_parents, asked)
    fields = ("ctx_pos", "id", "source", "chunk_index", "kind", "score")
    listed = rows.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("contexts"))  # a request's few contexts
    every = asked.select("query_id", "query").join(listed, "query_id", "left")
    none = F.filter(F.array(F.struct(*[F.lit(None).cast(rows.schema[f].dataType).alias(f) for f in fields])), lambda c: F.lit(False))
    every = every.withColumn("contexts", F.coalesce("contexts", none))
    kinds = F.transform("contexts", lambda c: c["kind"])
    parents = F.size(F.filter(kinds, lambda k: k == "parent"))
    told = trace(
        route_decision=F.lit("local"), mode=F.lit(mode), original_query=F.col("query"), rerank_active=F.lit(use_rerank) & (F.size("contexts") > 0),
        parent_child_active=F.lit(use_parents) & (parents > 0), parent_child_unique_parents=parents, **{k: F.lit(float(v)) for k, v in (times or {}).items()},
    )
    return every.select("query_id", "contexts", told.alias("trace"))
