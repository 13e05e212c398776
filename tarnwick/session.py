"""What a session needs for right results."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Spark 4.1 lets a union keep its children's partitioning; with adaptive plans that mixes up partitions or fails with
#: "Can't zip RDDs with unequal numbers of partitions".
UNION = "spark.sql.unionOutputPartitioning"


def prepare(spark: SparkSession) -> SparkSession:
    if spark.conf.get(UNION) != "false":
        spark.conf.set(UNION, "false")
    return spark
