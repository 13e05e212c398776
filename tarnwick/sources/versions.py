"""Tables of one index that grow together, a version at a time.

Every table is a Parquet folder partitioned by ``version``; a version's partitions are overwritten as a whole, so a
batch that is written again replaces itself.  The small table ``commits`` gets its row last, and readers take only
versions that have one: a batch that broke off stays unseen until it is repeated.
"""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .collection import _there


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder under the one that the cluster names in ``spark.checkpoint.dir``; a temporary one in local mode."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = f"file://{tempfile.gettempdir()}/tarnwick-shared"
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


class Versions:
    """The tables under ``path``.  ``totals`` is the schema of a commit's own columns.  With ``upto`` later versions are
    not seen: an index that is part of another shows what that one has committed."""

    def __init__(self, spark: SparkSession, path: str, totals: str, upto: int | None = None):
        self.spark, self.path, self.totals, self.upto = spark, path.rstrip("/"), totals, upto

    def commits(self) -> dict[int, dict]:
        """The columns of each committed version, one row a batch that the index ever took."""
        where = f"{self.path}/commits"
        if not _there(self.spark, where):
            return {}
        rows = self.spark.read.schema(f"{self.totals}, version long").parquet(where).collect()
        return {r["version"]: r.asDict() for r in rows if self.upto is None or r["version"] <= self.upto}

    def read(self, table: str, schema: str, versions: list[int]) -> DataFrame:
        """Rows of the given versions; ``version`` and what the table is partitioned by are columns like others."""
        where = f"{self.path}/{table}"
        full = f"{schema}, version long"
        if not versions or not _there(self.spark, where):
            return self.spark.createDataFrame([], full)
        return self.spark.read.schema(full).parquet(where).where(F.col("version").isin(versions))

    def write(self, rows: DataFrame, table: str, version: int, *by: str) -> None:
        """Replace the version's rows of a table."""
        out = rows.write.mode("overwrite").option("partitionOverwriteMode", "static")
        (out.partitionBy(*by) if by else out).parquet(f"{self.path}/{table}/version={version}")

    def commit(self, version: int, **totals) -> None:
        row = self.spark.createDataFrame([tuple(totals.values())], self.totals)
        self.write(row.coalesce(1), "commits", version)
