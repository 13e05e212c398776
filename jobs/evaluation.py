"""Evaluates keyword retrieval and extracted answers on a table of cases, an experiment being a number of contexts.

    spark-submit jobs/evaluation.py --documents <table> --cases <table> --index <folder> --output <folder>

The first half of each case's text asks, words of its second half are expected in the question, the contexts or the
answer.  Contexts come from the keyword index that jobs/keyword_index.py keeps; where there is none yet, one is begun
from ``documents``.  ``output/cases`` and ``output/summary`` are partitioned by experiment, and a run replaces the
partitions of its own experiments only, so a repeated run gives the same and others stay.
"""

from __future__ import annotations

import logging
import sys
from pathlib import Path

if __name__ == "__main__":
    sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnwick.operators.answer import extract_answers
from tarnwick.operators.evaluate import average, expected_keywords, mean_share
from tarnwick.sources.keyword_index import KeywordIndex

LOG = logging.getLogger("evaluation")
#: Documents found at most up to which their ids go to every task that reads the texts.
BROADCAST = 1_000_000


def results(cases: DataFrame, documents: DataFrame, index: KeywordIndex, experiments: dict[str, int], document_id: str = "doc_id", case_id: str = "item_id") -> DataFrame:
    """(experiment, query_id, contexts, answer, source, coverage, error), a row for each case and experiment.

    All experiments are one plan: the index is searched once, for the most contexts that any of them takes.  A case
    without text is a row with its error; of documents that share an id the one whose text sorts last is shown.
    """
    half = F.floor(F.length("text") / 2).cast("int")
    asked = cases.select(F.col(case_id).cast("long").alias("query_id"), F.substring("text", F.lit(1), half).alias("query"), expected_keywords(F.substring("text", half + 1, F.length("text"))).alias("keywords"))
    tries = cases.sparkSession.createDataFrame(sorted(experiments.items()), "experiment string, most int")
    asked = asked.join(F.broadcast(tries), F.lit(True)).withColumn("case", F.struct("experiment", "query_id"))  # a row a setting
    questions, most = asked.select("query_id", "query").distinct(), max(experiments.values(), default=1)
    found = index.topk(questions, most)
    ids = found.select("id").distinct()
    if questions.count() * most <= BROADCAST:  # else the texts are shuffled to meet them
        ids = F.broadcast(ids)
    shown = documents.select(F.col(document_id).cast("long").alias("id"), "text", "source").join(ids, "id", "left_semi").groupBy("id").agg(F.max(F.struct("text", "source")).alias("d"))
    ranked = found.join(shown, "id").select("query_id", "rank", "d.text", "d.source")
    contexts = asked.select("case", "query_id", "most", "keywords").join(ranked, "query_id").where("rank <= most")
    contexts = contexts.select(F.col("case").alias("query_id"), F.col("rank").alias("ctx_pos"), "source", "text", "keywords")
    answers = extract_answers(asked.select(F.col("case").alias("query_id"), "query"), contexts.select("query_id", "ctx_pos", "source", "text"))
    said = contexts.select("query_id", "text", "keywords").unionByName(asked.select(F.col("case").alias("query_id"), F.col("query").alias("text"), "keywords"))
    said = said.unionByName(answers.select("query_id", F.col("answer").alias("text")).join(asked.select(F.col("case").alias("query_id"), "keywords"), "query_id").select("query_id", "text", "keywords"))
    low = F.lower("text")
    hits = said.select("query_id", F.explode(F.filter("keywords", lambda k: F.contains(low, k))).alias("k")).groupBy("query_id").agg(F.count_distinct("k").alias("hits"))
    counted = contexts.groupBy("query_id").agg(F.count("*").alias("contexts"))
    out = asked.select(F.col("case").alias("query_id"), "query", "keywords").join(answers, "query_id").join(hits, "query_id", "left").join(counted, "query_id", "left")
    share = F.when(F.size("keywords") > 0, F.round(F.coalesce("hits", F.lit(0)) / F.size("keywords"), 6)).otherwise(F.lit(0.0))
    return out.select("query_id.experiment", "query_id.query_id", F.coalesce("contexts", F.lit(0)).alias("contexts"), "answer", "source", share.alias("coverage"), F.when(F.coalesce(F.length("query"), F.lit(0)) == 0, "no question").alias("error"))


def run(spark: SparkSession, documents: str, cases: str, index: str, output: str, experiments: dict[str, int], document_id: str = "doc_id", case_id: str = "item_id") -> tuple[DataFrame, DataFrame]:
    """(cases, summary), as written under ``output`` and read back."""
    held = KeywordIndex(spark, index)
    docs = spark.read.parquet(documents)
    if not held.store.commits():
        held.upsert(docs, 0, document_id)
        LOG.info("began an index of %s under %s", documents, index)
    put = lambda rows, name: rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("experiment").parquet(f"{output.rstrip('/')}/{name}")
    put(results(spark.read.parquet(cases), docs, held, experiments, document_id, case_id), "cases")
    written = spark.read.parquet(f"{output.rstrip('/')}/cases")
    mine = written.where(F.col("experiment").isin(list(experiments)))
    fine = F.when(F.col("error").isNull(), F.col("coverage"))
    put(mine.groupBy("experiment").agg(F.count("*").alias("num_cases"), F.count_if(F.col("error").isNull()).alias("num_success"), average(F.col("contexts")).alias("avg_contexts"), mean_share(fine).alias("avg_coverage")), "summary")
    summary = spark.read.parquet(f"{output.rstrip('/')}/summary")
    for r in summary.where(F.col("experiment").isin(list(experiments))).orderBy("experiment").collect():  # a row a setting
        LOG.info("%s: read %d cases of %s, wrote %d to %s, coverage %.4f", r["experiment"], r["num_cases"], cases, r["num_cases"], output, r["avg_coverage"])
    return written, summary


def main(argv: list[str] | None = None) -> None:
    from jobs.settings import read

    chosen = read(str(Path(__file__).with_suffix(".json")), argv, "Evaluate keyword retrieval and extracted answers.")
    spark = SparkSession.builder.appName("evaluation").getOrCreate()
    try:
        run(spark, **chosen)
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
