"""Connected components of an edge table by alternating large-star and small-star steps.

Nothing is collected but one (count, checksum) row a round; every round is written to the shared folder, so a lost
executor costs one round at most.  Stars of any size pass through hash aggregation with map-side combining.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def components(edges: DataFrame, scratch: Scratch | None = None, rows: int | None = None) -> DataFrame:
    """(node, component): the smallest node reachable from each node of ``edges`` (src, dst: long, never null).

    Nodes without an edge, or only with an edge to themselves, are not listed.  Rounds go on until nothing changes.
    ``rows`` is about how many edges there can be.
    """
    scratch = scratch or Scratch(edges.sparkSession)
    # Without a count yet, the first table is written as it comes.
    now = scratch.keep(edges.where("src <> dst").select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst")).distinct(), "edges", rows)
    before = None
    while True:
        state = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("src", "dst").cast("decimal(38,0)")).alias("h")).first()
        if state["n"] == 0 or (state["n"], state["h"]) == before:
            break
        before = (state["n"], state["h"])
        # Large star: every larger neighbour of a node is tied to the node's smallest neighbour, itself included.
        both = now.unionByName(now.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        low = both.groupBy("src").agg(F.min("dst").alias("m")).select(F.col("src").alias("node"), F.least("src", "m").alias("m"))
        large = both.join(low, both["src"] == low["node"]).where("dst > src").select(F.col("dst").alias("src"), F.col("m").alias("dst")).distinct()
        # Small star: a node and its smaller neighbours are tied to the smallest of them.
        least = large.groupBy("src").agg(F.min("dst").alias("m")).select(F.col("src").alias("node"), "m")
        small = large.join(least, large["src"] == least["node"]).select(F.explode(F.array("src", "dst")).alias("src"), F.col("m").alias("dst")).where("src <> dst").distinct()
        earlier, now = now, scratch.keep(small, "edges", 2 * state["n"])
        scratch.drop(earlier)
    return now.select(F.col("src").alias("node"), F.col("dst").alias("component")).unionByName(now.select(F.col("dst").alias("node"), F.col("dst").alias("component")).distinct())
