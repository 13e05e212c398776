"""Evaluation: coverage, averages, runs over cases and switch configurations."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X

#: The configurations an ablation compares, in order: name, mode, then the switches reranker, intent
#: router, graph, query aligner, query rewriter, parents.
EXPERIMENTS = [
    ("Base (Vector Only)", "vector", False, False, False, False, False, False),
    ("Base + Hybrid", "hybrid", False, False, False, False, False, False),
    ("Base + Hybrid + Reranker", "hybrid", True, False, False, False, False, False),
    ("Base + Hybrid + Reranker + KG", "hybrid", True, False, True, False, False, False),
    ("Base + H + R + KG + Aligner", "hybrid", True, False, True, True, False, False),
    ("Base + H + R + KG + Aligner + Rewriter", "hybrid", True, False, True, True, True, False),
    ("Full Pipeline (Auto Mode)", "auto", True, True, True, True, True, True),
    ("Full w/o Intent Router", "hybrid", True, False, True, True, True, True),
    ("Full w/o KG", "auto", True, True, False, True, True, True),
    ("Full w/o Query Aligner", "auto", True, True, True, False, True, True),
    ("Full w/o Query Rewriter", "auto", True, True, True, True, False, True),
    ("Full w/o Parent-Child", "auto", True, True, True, True, True, False),
]


def effective(experiment: tuple) -> tuple[str, bool, bool, bool]:
    """(mode, rerank, graph, parents) of an experiment.  Without a model the aligner declines, a single question has no
    history to be rewritten by, and a router without prototypes falls back to the local plan."""
    _, mode, rerank, _, kg, _, _, parents = experiment
    return "hybrid" if mode == "auto" else mode, rerank, kg, parents


def average(c: Column) -> Column:
    """Mean without nulls, four decimals, 0 where there is nothing."""
    return F.round(F.coalesce(F.avg(c), F.lit(0.0)), 4)


def mean_share(c: Column) -> Column:
    """Mean of shares with six decimals, halves up at the fourth, in whole numbers: the same in any order and engine."""
    total, n = F.sum(F.round(c * 1_000_000).cast("long")), F.count(c)
    return F.coalesce(F.call_function("div", total + 50 * n, 100 * n) / F.lit(10_000.0), F.lit(0.0))


def keyword_coverage(haystack: Column, keywords: Column) -> Column:
    """Share of the keywords found, whatever their case; 0 without keywords."""
    low = F.lower(haystack)
    found = F.size(F.filter(keywords, lambda k: F.contains(low, F.lower(k))))
    return F.when(F.size(keywords) > 0, F.round(found / F.size(keywords), 6)).otherwise(F.lit(0.0))


def expected_keywords(query: Column) -> Column:
    return F.slice(F.array_distinct(F.filter(X.tokens(query), lambda t: F.length(t) >= 6)), 1, 5)


def gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(query_id, query, keywords): the first half of each benchmark text asks, words of the other half are expected."""
    from ..plans import tables as T

    half = F.floor(F.length("query") / 2).cast("int")
    rest = F.substring("query", half + 1, F.length("query"))
    return T.questions(spark, sf_dir).select("query_id", F.substring("query", F.lit(1), half).alias("query"), expected_keywords(rest).alias("keywords"))


def evaluate(spark: SparkSession, sf_dir: str, channels: dict[str, DataFrame] | None = None, **switches) -> DataFrame:
    """(query_id, contexts, coverage): each case retrieved, and its expected keywords looked up in the question and in
    what came back.  Keywords are found context by context and united, so that no text is put together."""
    from ..plans import retrieve as P
    from ..plans import tables as T

    cases, notes = gold(spark, sf_dir), T.notes(spark, sf_dir)
    got = P.retrieve(spark, sf_dir, asked=cases.select("query_id", "query"), channels=channels, **switches)
    counted = got.groupBy("query_id").agg(F.count("*").alias("contexts"))
    if switches.get("use_parents"):
        texts = got.select("query_id", "source").join(notes.select("source", "text"), "source").select("query_id", "text")
    else:
        texts = got.select("query_id", F.col("id").cast("long").alias("id")).join(notes.select("id", "text"), "id").select("query_id", "text")
    seen = texts.unionByName(cases.select("query_id", F.col("query").alias("text"))).join(cases.select("query_id", "keywords"), "query_id")
    low = F.lower("text")
    found = seen.select("query_id", F.explode(F.filter("keywords", lambda k: F.contains(low, k))).alias("k")).groupBy("query_id").agg(F.count_distinct("k").alias("found"))
    share = F.when(F.size("keywords") > 0, F.round(F.coalesce("found", F.lit(0)) / F.size("keywords"), 6)).otherwise(F.lit(0.0))
    return cases.join(counted, "query_id", "left").join(found, "query_id", "left").select("query_id", F.coalesce("contexts", F.lit(0)).alias("contexts"), share.alias("coverage"))


def ablate(spark: SparkSession, sf_dir: str, experiments) -> DataFrame:
    """(ordinal, experiment, num_cases, avg_contexts, avg_coverage, error), in the order of definition.

    The channels are searched once and kept (ten rows a query); experiments whose switches come to one plan share it,
    and all plans are one, with a tag.  If that fails, each is run by itself: one that fails is a row with its error.
    """
    from ..plans import retrieve as P

    asked = gold(spark, sf_dir).select("query_id", "query")
    table = P.words(spark, sf_dir)
    channels = {
        "vector": P.vector_channel(spark, sf_dir, asked, table), "bm25": P.keyword_channel(spark, sf_dir, asked, table),
        "kg": P.stored(P.graph_channel(spark, sf_dir, asked), "kg"),
    }
    plans = list(dict.fromkeys(effective(e) for e in experiments))

    def tagged(i: int) -> DataFrame:
        mode, rerank, kg, parents = plans[i]
        return evaluate(spark, sf_dir, channels, mode=mode, use_rerank=rerank, use_kg=kg, use_parents=parents).withColumn("plan", F.lit(i))

    def measured(runs: DataFrame) -> dict[int, tuple]:
        rows = runs.groupBy("plan").agg(F.count("*").alias("n"), average(F.col("contexts")).alias("contexts"), mean_share(F.col("coverage")).alias("coverage"))
        return {r["plan"]: (r["n"], r["contexts"], r["coverage"], None) for r in rows.collect()}  # a row a plan

    try:
        known = measured(functools.reduce(DataFrame.unionByName, [tagged(i) for i in range(len(plans))]))
    except Exception:
        known = {}
        for i in range(len(plans)):
            try:
                known |= measured(tagged(i))
            except Exception as e:
                known[i] = 0, 0.0, 0.0, (str(e) or type(e).__name__)[:500]
    rows = [(i, e[0], *known.get(plans.index(effective(e)), (0, 0.0, 0.0, None))) for i, e in enumerate(experiments)]
    return spark.createDataFrame(rows, "ordinal int, experiment string, num_cases long, avg_contexts double, avg_coverage double, error string")


def comparison(results: DataFrame) -> DataFrame:
    """(experiment, line) of results (experiment, relevance, faithfulness, error): fixed-width lines, the best relevance
    above zero marked; an experiment that failed counts as zero and shows its error."""
    counted = results.withColumn("relevance", F.when(F.col("error").isNull(), F.col("relevance")).otherwise(F.lit(0.0))).withColumn("faithfulness", F.when(F.col("error").isNull(), F.col("faithfulness")).otherwise(F.lit(0.0)))
    top = counted.agg(F.max("relevance").alias("top"))  # one row
    rows = counted.join(F.broadcast(top), F.col("relevance") == F.col("top"), "left")
    mark = F.when(F.col("top").isNotNull() & (F.col("relevance") > 0), " ★").otherwise("")
    line = F.concat(F.format_string("%-40s %8.4f %10.4f", "experiment", F.col("relevance").cast("double"), F.col("faithfulness").cast("double")), mark)
    return rows.select("experiment", F.when(F.col("error").isNotNull(), F.concat(F.format_string("%-40s", "experiment"), F.lit(" [ERROR] "), F.col("error"))).otherwise(line).alias("line"))
