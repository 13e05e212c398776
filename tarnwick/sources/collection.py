"""Sources and sinks: Markdown folders, versioned collections, triple stores, reports."""

from __future__ import annotations

import uuid
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.graph import dedupe_triples

TRIPLE = "head string, relation string, tail string, source string, chunk_id string"
CASE = "query string, category string, difficulty string, expected_keywords array<string>"


def markdown_dir(spark: SparkSession, path: str) -> DataFrame:
    """(path, text, md5, error) of every ``*.md`` under ``path``, with paths relative to it.  A file that is not UTF-8 has
    its error and no text; the others go on.  Spark's readers leave out files without a byte, which have nothing to chunk."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.md").option("recursiveFileLookup", "true").load(path)
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    root = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(where).toString().rstrip("/")
    text = F.col("content").cast("string")
    good = F.is_valid_utf8(text)
    return files.select(F.substring("path", F.lit(len(root) + 2), F.length("path")).alias("path"), F.when(good, text).alias("text"), F.md5("content").alias("md5"), F.when(~good, "not UTF-8").alias("error"))


def changes(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """(key, state) of each new row against the stored digests: added, changed or unchanged."""
    before = old.select(F.col(key).alias("__k"), F.col("md5").alias("__md5"))
    state = F.when(F.col("__k").isNull(), "added").when(~F.col("md5").eqNullSafe(F.col("__md5")), "changed").otherwise("unchanged")
    return new.join(before, new[key] == before["__k"], "left").select(key, state.alias("state"))


def stale(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Keys that are no longer there; the caller decides whether their rows go."""
    return old.select(key).join(new.select(key), key, "left_anti")


def upsert(existing: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """New rows replace those of the same key; nothing else is deleted."""
    return existing.join(new.select(key), key, "left_anti").unionByName(new)


def _there(spark: SparkSession, path: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def read_or_empty(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A Parquet table, or no rows where there is none yet."""
    return spark.read.schema(schema).parquet(path) if _there(spark, path) else spark.createDataFrame([], schema)


def open_table(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A stored collection; with ``schema`` it is created where it is absent, without one that is an error."""
    if not _there(spark, path):
        if schema is None:
            raise FileNotFoundError(f"no collection at {path}")
        spark.createDataFrame([], schema).write.parquet(path)
    return spark.read.parquet(path)


def save(rows: DataFrame, path: str) -> None:
    """Replace the table at ``path``, which ``rows`` may be derived from: it is written beside and then moved."""
    spark = rows.sparkSession
    jvm = spark.sparkContext._jvm
    fresh = f"{path}.{uuid.uuid4().hex}"
    rows.write.parquet(fresh)
    old, new = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(fresh)
    files = old.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files.delete(old, True)
    if not files.rename(new, old):
        raise OSError(f"could not move {fresh} to {path}")


def _json_list(spark: SparkSession, path: str, item: str) -> DataFrame:
    """(seq, fields of ``item``) from a file with one JSON list; no rows where it is missing or does not parse."""
    if not _there(spark, path):
        return spark.createDataFrame([], f"seq int, {item}")
    kind = "array<struct<" + ", ".join(f"{n}: {t}" for n, t in (x.strip().split(" ", 1) for x in item.split(", "))) + ">>"
    rows = spark.read.option("wholetext", "true").text(path).select(F.posexplode(F.from_json("value", kind)).alias("seq", "i"))
    return rows.where("i is not null").select("seq", "i.*")


def read_triples(spark: SparkSession, path: str) -> DataFrame:
    """A JSON list of triples; a missing or broken file gives no rows."""
    return _json_list(spark, path, TRIPLE).drop("seq")


def read_cases(spark: SparkSession, path: str) -> DataFrame:
    """(case_id, query, category, difficulty, expected_keywords) of a JSON list of evaluation cases, numbered in order."""
    return _json_list(spark, path, CASE).withColumnRenamed("seq", "case_id")


def append_triples(existing: DataFrame, new: DataFrame) -> tuple[DataFrame, int]:
    """Stored and new triples, each once by its trimmed and lower-cased fields, the stored one first; and how many more
    rows that makes.  ``save`` puts them in place."""
    fields = [x.split()[0] for x in TRIPLE.split(", ")]
    both = existing.select(*fields, F.lit(0).alias("origin")).unionByName(new.select(*fields, F.lit(1).alias("origin")))
    merged = dedupe_triples(both, tuple(fields), ("origin", *fields)).drop("origin")
    return merged, merged.count() - existing.count()


def report_path(folder: str, name: str, at: datetime | None = None) -> str:
    return f"{folder}/{name}_{at or datetime.now():%Y%m%d_%H%M%S}"


def write_report(rows: DataFrame, path: str) -> None:
    rows.coalesce(1).write.mode("overwrite").json(path)
