"""A folder of Markdown files as one searchable store: chunks, keyword index, vector index and triples, a batch at a time.

A batch takes the files whose bytes have changed, cuts them into chunks, and brings every part up to the same version:
the keyword and the vector index first, each repeatable for itself, then the store's own tables, and last the commit
that makes it all visible.  A batch that broke off anywhere is not seen, and repeating it does what is left to do.
"""

from __future__ import annotations

import logging
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import models as M
from ..operators import retrieval as R
from ..operators.chunker import split_documents
from .collection import _there, changes, markdown_dir
from .keyword_index import KeywordIndex
from .vector_index import VectorIndex
from .versions import Versions

FILES = "path string, md5 string, error string, n_chunks long"
CHUNKS = "key long, chunk_id string, source string, chunk_index int, text string, is_code boolean, code_language string, chunker string"
INCOMING = "path string, text string, md5 string, error string, state string"
TRIPLES = "seq int, head string, relation string, tail string, source string, chunk_id string"
LOG = logging.getLogger(__name__)


def chunk_key(source: Column, index: Column) -> Column:
    """60 bits by which the indexes know a chunk; unlike chunk ids, paths that differ in slashes alone stay apart."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", source, index.cast("string"))), 1, 15), 16, 10).cast("long")


class NoteIndex:
    """The store under ``path``.

    Every file's chunks are those of its last version, so a file that got shorter leaves nothing behind.  ``extractor``
    is a model that finds triples in chunks; without one there are none.
    """

    def __init__(self, spark: SparkSession, path: str, extractor: M.Batch | None = None, wait: float = 1.0, buckets: int = 64):
        self.spark, self.path, self.extractor, self.wait, self.buckets = spark, path.rstrip("/"), extractor, wait, buckets
        self.store = Versions(spark, path, "files long, chunks long")

    def _last(self) -> int:
        return max(self.store.commits(), default=-1)

    def keywords(self, upto: int | None = None) -> KeywordIndex:
        return KeywordIndex(self.spark, f"{self.path}/keywords", self.buckets, upto=self._last() if upto is None else upto)

    def vectors(self, upto: int | None = None) -> VectorIndex:
        return VectorIndex(self.spark, f"{self.path}/vectors", buckets=self.buckets, upto=self._last() if upto is None else upto)

    def files(self) -> DataFrame:
        """(path, md5, error, n_chunks, version) of each file as last taken."""
        rows = self.store.read("files", FILES, sorted(self.store.commits()))
        return rows.groupBy("path").agg(F.max_by(F.struct("md5", "error", "n_chunks", "version"), "version").alias("f")).select("path", "f.*")

    def _of_files(self, table: str, schema: str) -> DataFrame:
        rows = self.store.read(table, schema, sorted(self.store.commits()))
        now = self.files().select(F.col("path").alias("source"), "version")
        return rows.join(now, ["source", "version"], "left_semi").drop("version")

    def chunks(self) -> DataFrame:
        return self._of_files("chunks", CHUNKS)

    def triples(self) -> DataFrame:
        return self._of_files("triples", TRIPLES)

    def refresh(self, folder: str, drop_missing: bool = False) -> dict[str, int]:
        """Take what has changed under ``folder`` as the next version; how many files were added, changed, unchanged,
        unreadable and, if asked for, dropped because they are no longer there."""
        told = {"added": 0, "changed": 0, "unreadable": 0, "dropped": 0}
        if self._pending(self._last() + 1):  # a batch that broke off is finished with what it had taken
            told = self.take(self._incoming(self._last() + 1), self._last() + 1)
        found = markdown_dir(self.spark, folder)
        stored = self.files().where("md5 is not null").select("path", "md5")
        state = changes(stored, found.select("path", "md5"), "path")
        rows = found.join(state.where("state <> 'unchanged'"), "path")
        if drop_missing:
            away = stored.join(found.select("path"), "path", "left_anti").select("path", F.lit(None).cast("string").alias("text"), F.lit(None).cast("string").alias("md5"), F.lit(None).cast("string").alias("error"), F.lit("dropped").alias("state"))
            rows = rows.unionByName(away)
        same = state.where("state = 'unchanged'").count()
        if rows.limit(1).count():
            more = self.take(rows, self._last() + 1)
            told = {k: told[k] + more[k] for k in told}
        return told | {"unchanged": same}

    def _pending(self, version: int) -> bool:
        return _there(self.spark, f"{self.path}/incoming/version={version}/_SUCCESS")

    def _incoming(self, version: int) -> DataFrame:
        return self.store.read("incoming", INCOMING, [version]).drop("version")

    def take(self, rows: DataFrame, version: int) -> dict[str, int]:
        """Bring in files (path, text, md5, error, and ``state`` if known), each once, as a version.  Fit for a stream's
        ``foreachBatch``: a version that is there already changes nothing, and one that broke off goes on with the files
        that it had."""
        none = {"added": 0, "changed": 0, "unreadable": 0, "dropped": 0}
        if version in self.store.commits():
            return none
        if not self._pending(version):
            state = F.col("state") if "state" in rows.columns else F.lit("added")
            self.store.write(rows.select("path", "text", "md5", "error", state.alias("state")), "incoming", version)
        rows = self._incoming(version)
        told = none | {r["state"]: r["count"] for r in rows.where("error is null").groupBy("state").count().collect()}
        told["unreadable"] = rows.where("error is not null").count()
        for r in rows.where("error is not null").select("path", "error").limit(20).collect():  # a sample for the log
            LOG.error("%s: %s; %d unreadable files in all", r["path"], r["error"], told["unreadable"])
        cut = split_documents(rows.where("text is not null").select(F.col("path").alias("source"), "text"), ["source"])
        ident = X.chunk_id(F.col("source"), F.col("chunk_index"))
        cut = cut.select(chunk_key(F.col("source"), F.col("chunk_index")).alias("key"), ident.alias("chunk_id"), "source", "chunk_index", "text", "is_code", "code_language", "chunker")
        self.store.write(cut, "chunks", version)
        fresh = self.store.read("chunks", CHUNKS, [version]).drop("version")
        stale = self.chunks().join(rows.select(F.col("path").alias("source")), "source", "left_semi").select("key").join(fresh.select("key"), "key", "left_anti")
        self.keywords(version).upsert(fresh, version, "key", "text", removed=stale)
        vectors = R.dense(R.hashed_terms(fresh, "key")).withColumnRenamed("id", "key")
        index = self.vectors(version)
        if not index.is_fitted():
            index.fit(vectors, id_col="key")
        away = stale.unionByName(fresh.join(vectors.select("key"), "key", "left_anti").select("key")).withColumn("vec", F.lit(None).cast("array<double>"))
        index.upsert(vectors.unionByName(away), version, "key")
        triples = self.spark.createDataFrame([], TRIPLES) if self.extractor is None else M.extract_triples(fresh, self.extractor, wait=self.wait)
        self.store.write(triples, "triples", version)
        sizes = fresh.groupBy(F.col("source").alias("path")).agg(F.count("*").alias("n_chunks"))
        self.store.write(rows.select("path", "md5", "error").join(sizes, "path", "left").select("path", "md5", "error", F.coalesce("n_chunks", F.lit(0)).alias("n_chunks")), "files", version)
        self.store.commit(version, files=rows.count(), chunks=fresh.count())
        LOG.info("version %d: %s", version, told)
        return told

    def search(self, queries: DataFrame, k: int = 10, how: Callable[[DataFrame, DataFrame], DataFrame] | None = None) -> DataFrame:
        """(query_id, rank, score, chunk_id, source, text): keywords and vectors fused by their weighted ranks."""
        from ..plans.retrieve import fuse

        asked = R.dense(R.hashed_terms(queries, "query_id", "query")).select(F.col("id").alias("query_id"), "vec")
        both = (how or fuse)(self.vectors().topk(asked, k, exact=True), self.keywords().topk(queries, k))
        return both.where(F.col("rank") <= k).join(self.chunks(), F.col("id") == F.col("key")).select("query_id", "rank", "score", "chunk_id", "source", "text")
