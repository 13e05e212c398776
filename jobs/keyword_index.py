"""Keeps a keyword index of a growing table of documents.

    spark-submit jobs/keyword_index.py --input <table> --output <folder>

A file stream takes the table's files that no earlier run took, as many batches as there are, and stops.  Each batch is
one version of the index: documents with a new id are added, those with a known one replace what the index holds.  The
stream's checkpoint lies beside the index under ``output``; delete both or neither.  A batch that broke off stays
unseen and is repeated by the next run; a run without new files changes nothing.
"""

from __future__ import annotations

import logging
import sys
from pathlib import Path

if __name__ == "__main__":
    sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnwick.sources.keyword_index import KeywordIndex
from tarnwick.streaming.metrics import index_stream

LOG = logging.getLogger("keyword_index")


def as_pattern(path: str) -> str:
    """``path`` as a pattern that it alone matches: a file stream takes a pattern's files, folder or not."""
    folder, _, name = path.rstrip("/").rpartition("/")
    return path if any(c in path for c in "{}[]*?") else f"{folder}/{{{name}}}" if folder else f"{{{name}}}"


def run(spark: SparkSession, input: str, output: str, id: str = "doc_id", text: str = "text", buckets: int = 64, block: int = 256, files_per_batch: int = 1000) -> KeywordIndex:
    """Take in what is new under ``input``, a Parquet table or file, and give the index under ``output``."""
    where = f"{output.rstrip('/')}/index"
    schema = spark.read.parquet(input).schema
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(as_pattern(input))

    def take(batch: DataFrame, number: int) -> None:
        index = KeywordIndex(batch.sparkSession, where, buckets, block)
        done = index.upsert(batch, number, id, text)
        now = index.store.commits()[number]
        LOG.info("batch %d %s: %d documents, %d words in the index", number, "written" if done else "was there", now["n"], now["length"])

    query = index_stream(rows.select(id, text), take, f"{output.rstrip('/')}/checkpoint")
    query.awaitTermination()
    read = [p["numInputRows"] for p in query.recentProgress]
    LOG.info("read %d rows of %s in %d batches", sum(read), input, sum(n > 0 for n in read))
    return KeywordIndex(spark, where, buckets, block)


def entries(index: KeywordIndex) -> DataFrame:
    """(doc_id, term, tf, doc_length, df) of all that the index holds."""
    df = index.statistics().select(F.col("t").alias("term"), "df")
    return index.postings().select(F.col("id").alias("doc_id"), F.col("t").alias("term"), "tf", F.col("dl").alias("doc_length")).join(df, "term").select("doc_id", "term", "tf", "doc_length", "df")


def documents(index: KeywordIndex) -> DataFrame:
    """``entries`` summed up by document: how many there are, their document counts, and the hashes of term and count."""
    hashed = F.conv(F.substring(F.md5(F.concat_ws(":", "term", "tf")), 1, 8), 16, 10).cast("long")
    return entries(index).groupBy("doc_id", "doc_length").agg(F.count("*").alias("terms"), F.sum("df").alias("df_sum"), F.sum(hashed).alias("entries_sum"))


def main(argv: list[str] | None = None) -> None:
    from jobs.settings import read

    chosen = read(str(Path(__file__).with_suffix(".json")), argv, "Keep a keyword index of a growing table of documents.")
    spark = SparkSession.builder.appName("keyword_index").getOrCreate()
    try:
        run(spark, **chosen)
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
