"""Request metrics."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULTS
from ..functions import text as X


#: The stages of a request, as they are reported.
STAGES = ("total", "embed", "search", "align", "rerank", "generate")


class Timer:
    """Wall-clock milliseconds of a block on the driver, an action and the plan building around it."""

    elapsed_ms = 0.0

    def __enter__(self) -> Timer:
        self._from = time.perf_counter()
        return self

    def __exit__(self, *_) -> None:
        self.elapsed_ms = (time.perf_counter() - self._from) * 1000


def summary(requests: DataFrame) -> DataFrame:
    """Of requests (``<stage>_ms`` for each stage): their number, the mean of each stage and the 95th percentile of the
    whole (linear); zeros without rows."""
    means = [F.round(F.coalesce(F.avg(f"{s}_ms"), F.lit(0.0)), 4).alias(f"avg_{s}_ms") for s in STAGES]
    return requests.agg(F.count("*").alias("total_requests"), *means, F.round(F.coalesce(F.expr("percentile(total_ms, 0.95)"), F.lit(0.0)), 4).alias("p95_total_ms"))


def bounded(requests: DataFrame, order: str, keep: int = DEFAULTS.metrics_history) -> DataFrame:
    """The last ``keep`` rows: a top-k, not a sort of all."""
    return requests.orderBy(F.desc(order)).limit(keep)


def source_block(contexts: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """(source, score_type, score, first_pos) of contexts (source, sources, score_type, score, pos): every source named,
    from the list ``sources`` where it has any and from ``source`` otherwise, with its first best score, the kind of that
    score, and where the source first stands.  Blank names go; no score counts as 0."""
    none = F.array().cast("array<string>")
    names = F.when(F.size(F.coalesce("sources", none)) > 0, F.col("sources")).otherwise(F.array(F.col("source")))
    clean = F.filter(F.transform(names, lambda s: X.strip(F.coalesce(s, F.lit("")))), lambda s: s != "")
    rows = contexts.select(*keys, "pos", F.coalesce("score", F.lit(0.0)).cast("double").alias("score"), F.coalesce("score_type", F.lit("unknown")).alias("score_type"), F.posexplode(clean).alias("at", "name"))
    first = rows.groupBy(*keys, "name").agg(F.max_by("score_type", F.struct("score", -F.col("pos"), -F.col("at"))).alias("score_type"), F.max("score").alias("score"), F.min(F.struct("pos", "at")).alias("first"))
    return first.select(*keys, F.col("name").alias("source"), "score_type", "score", F.col("first.pos").alias("first_pos"), F.col("first.at").alias("first_at"))


def source_text(block: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """The block as Markdown lines, sources in order of appearance."""
    line = F.format_string('- %s <span style="color:#6c7086;font-size:0.82em">[%s] %.4f</span>', "source", "score_type", "score")
    listed = block.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("first_pos", "first_at", line.alias("line")))).alias("l"))  # a request's sources
    lines = F.transform("l", lambda x: x["line"])
    return listed.select(*keys, F.array_join(F.concat(F.array(F.lit("---\n📎 **参考来源**")), F.when(F.size(lines) > 0, lines).otherwise(F.array(F.lit("- 暂无可展示来源")))), "\n").alias("text"))


def first_per_group(rows: DataFrame, key: str, order: str, n: int = 5) -> DataFrame:
    return rows.withColumn("n", F.row_number().over(Window.partitionBy(key).orderBy(order))).where(F.col("n") <= n)
