"""Structured Streaming: incremental indexing, bounded metrics, flushing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..config import DEFAULTS


def index_stream(docs: DataFrame, index: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Run ``index`` on every micro-batch of new files; the checkpoint takes the place of a hash map of files."""
    return docs.writeStream.foreachBatch(index).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def version_batches(path: str) -> Callable[[DataFrame, int], None]:
    """An ``index`` that stores every batch as a version, to be read through ``latest``: a batch is a file set of its own, named by its
    number, so a repeated batch overwrites itself."""

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("version", F.lit(number)).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return write


def keep_last(path: str, order: str, keep: int = DEFAULTS.metrics_history) -> Callable[[DataFrame, int], None]:
    """An ``index`` that holds the last ``keep`` rows of a stream by ``order`` (a column without ties): batch n folds
    into the state that batch n - 1 left and writes a state of its own, so a repeated batch changes nothing."""

    def write(batch: DataFrame, number: int) -> None:
        rows = batch if number == 0 else batch.unionByName(batch.sparkSession.read.schema(batch.schema).parquet(f"{path}/state={number - 1}"))
        rows.orderBy(F.desc(order)).limit(keep).write.mode("overwrite").parquet(f"{path}/state={number}")

    return write


def latest(rows: DataFrame, key: str) -> DataFrame:
    """The newest version of each key."""
    last = rows.groupBy(key).agg(F.max("version").alias("version"))
    return rows.join(last, [key, "version"], "left_semi").dropDuplicates([key])


def windowed(events: DataFrame, ts: str = "ts", value: str = "value", width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """An extension: counts and means by event-time window, for batch and stream alike."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, width), "event_type").agg(F.count("*").alias("n"), F.avg(value).alias("mean"))


def flushes(deltas: Column, least: int = 10) -> Column:
    """Texts as shown: pieces are held until ``least`` characters are there, what is left is shown at the end."""

    def step(acc: Column, x: Column) -> Column:
        held = F.concat(acc["held"], x)
        full = F.length(held) >= least
        return F.struct(F.when(full, F.concat(acc["out"], F.array(held))).otherwise(acc["out"]).alias("out"), F.when(full, "").otherwise(held).alias("held"))

    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit("").alias("held"))
    return F.aggregate(deltas, start, step, lambda acc: F.when(acc["held"] != "", F.concat(acc["out"], F.array(acc["held"]))).otherwise(acc["out"]))
