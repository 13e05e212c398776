"""Intent routing by prototype vectors."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULTS
from . import nearest


def prototypes(rows: DataFrame, json_col: str, default: dict[str, list[str]]) -> DataFrame:
    """(intent, text) from a JSON map of lists; blank entries go, no entry at all gives the default."""
    parsed = rows.select(F.explode(F.from_json(json_col, "map<string,array<string>>")).alias("intent", "texts")).select("intent", F.explode("texts").alias("text")).where(F.trim("text") != "")
    if parsed.limit(1).count():
        return parsed
    return rows.sparkSession.createDataFrame([(k, t) for k, v in default.items() for t in v], "intent string, text string")


def route(queries: DataFrame, protos: DataFrame, how: str = "max", min_score: float = DEFAULTS.route_min_score, min_margin: float = DEFAULTS.route_min_margin) -> DataFrame:
    """(query_id, best, score, margin, decision): the nearest intent, unless it is too far or too close to the next.

    Any number of prototypes (intent, vec): each block of them gives every intent's best products, ``how`` many the
    score is the mean of.  Without prototypes every query falls back.
    """
    best_of = 1 if how == "max" else 2

    def work(ids: np.ndarray, q: np.ndarray, own: pa.Array, v: np.ndarray) -> pa.RecordBatch:
        names = own.to_numpy(zero_copy_only=False)
        s = np.round(q @ v.T, 6)
        rows: list[tuple[np.ndarray, str, np.ndarray]] = []
        for name in sorted(set(names.tolist())):
            of = s[:, names == name]
            top = -np.sort(-of, axis=1)[:, :best_of]
            rows.append((np.repeat(ids, top.shape[1]), name, top.ravel()))
        intents = [n for i, n, _ in rows for _ in range(len(i))]
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate([r[0] for r in rows])), pa.array(intents, pa.string()), pa.array(np.concatenate([r[2] for r in rows]))], names=["query_id", "intent", "s"])

    met = nearest.meet(protos.where("intent is not null"), queries, "intent", work, "query_id long, intent string, s double")
    place = F.row_number().over(Window.partitionBy("query_id", "intent").orderBy(F.desc("s")))
    scored = met.withColumn("n", place).where(F.col("n") <= best_of).groupBy("query_id", "intent").agg(F.round(F.avg("s"), 7).alias("score"))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "intent")
    top = scored.withColumn("n", F.row_number().over(w)).withColumn("second", F.lead("score").over(w)).where("n = 1").drop("n")
    margin = F.col("score") - F.coalesce("second", F.lit(0.0))
    weak = F.col("score").isNull() | (F.col("score") < min_score) | (margin < min_margin)
    every = queries.select("query_id").join(top, "query_id", "left")
    return every.select("query_id", F.col("intent").alias("best"), F.coalesce("score", F.lit(0.0)).alias("score"), F.coalesce(F.round(margin, 7), F.lit(0.0)).alias("margin"), F.when(weak, "fallback").otherwise("routed").alias("decision"))
