"""A stored inverted index: postings by term bucket in impact-ordered blocks, kept up by batches of changed documents.

Tables (see ``versions``), each batch a version:

* ``docs``, by the id's bucket: the terms of each document as the batch has them; a removed document has no ``dl``.
* ``postings``, by the term's bucket: blocks of a term's documents, each with its highest count and its shortest
  document.  These two bound the block's impact whatever the corpus's mean length becomes.  Tasks invert runs of so many
  documents of one id bucket, so postings are not shuffled to be written, and those of a run's documents are in its
  blocks alone: many questions at once are scored run by run.
* ``terms``, by the term's bucket, and ``spread``: changes of the terms' document counts, and of how many terms have
  such a count, which is all that the mean idf depends on.
* ``gone``: ids whose postings of earlier versions are void.

A batch reads the old terms of the documents it changes and writes rows for those and the new terms only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import DEFAULTS
from ..functions import text as X
from ..operators import retrieval as R
from .versions import Versions

DOCS = "id long, dl long, ts array<string>, tfs array<int>, part int"
POSTINGS = "t string, lead long, max_tf int, min_dl long, ids array<long>, tfs array<int>, dls array<long>, run long, bucket int"
TERMS = "t string, ddf long, bucket int"
SPREAD = "df long, dn long"
GONE = "id long, was long"
TOTALS = "n long, length long, mean_idf double"
#: Scores are rounded to six places; bounds are compared with this much room.
SLACK = 1e-5
#: Postings of a run; pairs of questions and terms beyond which all their blocks are opened, run by run.
RUN, PAIRS = 2_000_000, 256
#: Bytes of stored documents that a task inverts at most, some six to ten times as many in memory, and the setting for that.
SPLIT_BYTES, SPLIT = 64 << 20, "spark.sql.files.maxPartitionBytes"
#: Changed ids up to which they go to every task that reads their old words.
BROADCAST = 1_000_000


class KeywordIndex:
    """BM25 over the documents under ``path``.

    ``buckets`` term and id buckets and ``block`` postings a block; both must stay what they were when the index was
    begun.  Documents with a null id cannot be addressed and are left out; null and empty texts are documents without
    terms.  Of rows that share an id in one batch, the one with most words counts, then the one whose words sort last.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64, block: int = 256, upto: int | None = None):
        self.spark, self.buckets, self.block = spark, buckets, block
        self.store = Versions(spark, path, TOTALS, upto)

    # Writing

    def upsert(self, docs: DataFrame, version: int, id_col: str = "doc_id", text_col: str = "text", removed: DataFrame | None = None) -> bool:
        """Put in the given documents in place of those of the same ids, and take out those of ``removed``, which are
        others.  False if the version is there already."""
        rows = docs.where(F.col(f"`{id_col}`").isNotNull()).select(F.col(f"`{id_col}`").cast("long").alias("id"), X.tokens(F.col(f"`{text_col}`")).alias("w"))
        return self._apply(rows if removed is None else rows.unionByName(_absent(removed, id_col)), version)

    def remove(self, ids: DataFrame, version: int, id_col: str = "doc_id") -> bool:
        """Take out the documents with the given ids; ids that are not there do nothing."""
        return self._apply(_absent(ids, id_col), version)

    def _apply(self, rows: DataFrame, version: int) -> bool:
        commits = self.store.commits()
        if version in commits:
            return False
        before = sorted(commits)
        part = F.pmod(F.xxhash64("id"), F.lit(self.buckets)).cast("int")
        fresh = rows.mapInArrow(R.counted_words, "id long, dl long, ts array<string>, tfs array<int>").withColumn("part", part)
        if rows.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").isEmpty():  # ids alone; the words move once
            lists = {"ts": "array<string>", "tfs": "array<int>"}  # as text on their way, which takes a third of the lists' bytes
            whole = lambda c: F.when(F.col(c).isNotNull(), F.filter(F.split(c, " "), lambda x: x != "").cast(lists[c])).alias(c)
            fresh = fresh.select("id", "dl", *[F.array_join(c, " ").alias(c) for c in lists], "part").hint("rebalance", "part").select("id", "dl", *map(whole, lists), "part")
        else:
            once = F.row_number().over(Window.partitionBy("part", "id").orderBy(F.desc_nulls_last("dl"), F.desc("ts"), F.desc("tfs")))
            fresh = fresh.repartition("part").withColumn("__n", once).where("__n = 1").drop("__n")
        self.store.write(fresh, "docs", version, "part")
        new = self.store.read("docs", DOCS, [version])
        parts = [r["part"] for r in new.select("part").distinct().collect()]  # buckets
        there = self.store.read("docs", DOCS, before).where(F.col("part").isin(parts))
        # Which version an id stands in is found without its words; these are read where they are, if the ids are few.
        stands = there.join(new.select("id"), "id", "left_semi").groupBy("id").agg(F.max(F.struct("version", F.col("dl").isNotNull().alias("live"))).alias("last"))
        self.store.write(stands.where("last.live").select("id", F.col("last.version").alias("was")).hint("rebalance"), "gone", version)
        void = self.store.read("gone", GONE, [version]).select("id", F.col("was").alias("version"))
        old = there.join(F.broadcast(void) if void.count() <= BROADCAST else void, ["id", "version"])
        term = lambda d, sign: d.where("dl is not null").select(F.explode("ts").alias("t"), F.lit(sign).cast("long").alias("ddf"))
        moved = term(new, 1).unionByName(term(old, -1)).groupBy("t").agg(F.sum("ddf").alias("ddf")).where("ddf <> 0")
        self.store.write(moved.withColumn("bucket", self._bucket(F.col("t"))).hint("rebalance", "bucket"), "terms", version, "bucket")
        moved = self.store.read("terms", TERMS, [version])
        touched = [r["bucket"] for r in moved.select("bucket").distinct().collect()]  # buckets
        change = moved.select("t", F.lit(0).cast("long").alias("was"), "ddf")
        if before:
            held = self.store.read("terms", TERMS, before).where(F.col("bucket").isin(touched))
            held = held.select("t", F.col("ddf").alias("was"), F.lit(0).cast("long").alias("ddf"))
            change = held.unionByName(change).groupBy("t").agg(F.sum("was").alias("was"), F.sum("ddf").alias("ddf")).where("ddf <> 0")
        change = change.select("was", (F.col("was") + F.col("ddf")).alias("now"))
        steps = change.select(F.explode(F.array(F.struct(F.col("was").alias("df"), F.lit(-1).cast("long").alias("dn")), F.struct(F.col("now").alias("df"), F.lit(1).cast("long").alias("dn")))).alias("s")).select("s.*")
        self.store.write(steps.where("df > 0").groupBy("df").agg(F.sum("dn").alias("dn")).where("dn <> 0"), "spread", version)
        self._write_postings(new, version)
        tally = lambda d: d.agg(F.count("dl").alias("n"), F.coalesce(F.sum("dl"), F.lit(0)).alias("length")).first()
        plus, minus = tally(new), tally(old)
        last = commits[before[-1]] if before else {"n": 0, "length": 0}
        n, length = last["n"] + plus["n"] - minus["n"], last["length"] + plus["length"] - minus["length"]
        spread = self.store.read("spread", SPREAD, [*before, version]).groupBy("df").agg(F.sum("dn").alias("terms")).where("terms > 0")
        raw = F.log(F.lit(float(n)) - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)
        mean = spread.agg((F.sum(raw * F.col("terms")) / F.sum("terms")).alias("m")).first()["m"]
        self.store.commit(version, n=n, length=length, mean_idf=float(mean or 0.0))
        return True

    def _bucket(self, term: Column) -> Column:
        return F.pmod(F.xxhash64(term), F.lit(self.buckets)).cast("int")

    def _write_postings(self, new: DataFrame, version: int) -> None:
        """Each task inverts runs of its documents: blocks of a term, ordered by impact.  It writes them itself, a file for
        each bucket, so that nothing is shuffled."""
        size = self.block

        def invert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for n, rows in enumerate(_runs(batches)):
                yield from _blocks(rows, size, (TaskContext.get().partitionId() << 32) + n)

        blocks = new.where("dl is not null").select("part", "id", "dl", "ts", "tfs").mapInArrow(invert, POSTINGS.removesuffix(", bucket int"))
        dealt = blocks.withColumn("bucket", self._bucket(F.col("t"))).sortWithinPartitions("bucket", "t")
        before = self.spark.conf.get(SPLIT)
        try:  # tasks of so many bytes sort their blocks in memory
            self.spark.conf.set(SPLIT, min(SPLIT_BYTES, self.spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(before)))
            self.store.write(dealt, "postings", version, "bucket")
        finally:
            self.spark.conf.set(SPLIT, before)

    # Reading

    def documents(self) -> DataFrame:
        """(id, dl, ts, tfs) of all documents as their last version has them: length, terms and their counts."""
        rows = self.store.read("docs", DOCS, sorted(self.store.commits()))
        last = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("version")))
        return rows.withColumn("__n", last).where("__n = 1 and dl is not null").select("id", "dl", "ts", "tfs")

    def postings(self) -> DataFrame:
        """(t, id, tf, dl) of all documents, from the term's side."""
        versions = sorted(self.store.commits())
        rows = self.store.read("postings", POSTINGS, versions).select("t", "version", F.explode(F.arrays_zip("ids", "tfs", "dls")).alias("p"))
        return self._present(rows.select("t", "version", F.col("p.ids").alias("id"), F.col("p.tfs").alias("tf"), F.col("p.dls").alias("dl")), versions).select("t", "id", "tf", "dl")

    def _present(self, rows: DataFrame, versions: list[int]) -> DataFrame:
        """Rows (id, version) without those that a later version made void."""
        if len(versions) < 2:
            return rows
        gone = self._gone(versions)
        return rows.join(gone, "id", "left").where(F.col("until").isNull() | (F.col("version") >= F.col("until"))).drop("until")

    def _gone(self, versions: list[int]) -> DataFrame:
        """(id, until): postings of versions before ``until`` are void."""
        return self.store.read("gone", GONE, versions).groupBy("id").agg(F.max("version").alias("until"))

    def _df(self, versions: list[int], buckets: list[int] | None = None, terms: DataFrame | None = None) -> DataFrame:
        rows = self.store.read("terms", TERMS, versions)
        if terms is not None:
            rows = rows.join(terms, "t", "left_semi")
        if buckets is not None:
            rows = rows.where(F.col("bucket").isin(buckets))
        return rows.groupBy("t").agg(F.sum("ddf").alias("df")).where("df > 0")

    def statistics(self, epsilon: float = DEFAULTS.bm25_epsilon) -> DataFrame:
        """(t, df, idf) of all terms."""
        commits = self.store.commits()
        about = commits[max(commits)] if commits else {"n": 0, "mean_idf": 0.0}
        return self._df(sorted(commits)).select("t", "df", _idf(about, epsilon).alias("idf"))

    def _asked(self, queries: DataFrame, epsilon: float) -> tuple[DataFrame, DataFrame, dict] | None:
        """Weights (query_id, t, w) of the questions' terms, the blocks of these terms, and the corpus totals."""
        commits = self.store.commits()
        if not commits:
            return None
        versions, about = sorted(commits), commits[max(commits)]
        asked = queries.select("query_id", F.explode(X.tokens(F.col("query"))).alias("t")).groupBy("query_id", "t").agg(F.count("*").alias("q"))
        terms = asked.select("t").distinct()
        by = terms.groupBy(self._bucket(F.col("t")).alias("b")).count().collect()  # buckets
        buckets = sorted(r["b"] for r in by)
        df = self._df(versions, buckets, F.broadcast(terms) if sum(r["count"] for r in by) <= R.ASKED else terms)
        weights = asked.join(df, "t").select("query_id", "t", (F.col("q") * _idf(about, epsilon)).alias("w"))
        blocks = self.store.read("postings", POSTINGS, versions).where(F.col("bucket").isin(buckets))
        return weights, blocks, about | {"versions": versions}

    def scores(self, queries: DataFrame, k1: float = DEFAULTS.bm25_k1, b: float = DEFAULTS.bm25_b, epsilon: float = DEFAULTS.bm25_epsilon) -> DataFrame:
        """(query_id, id, score) of all documents that share a term with a query."""
        found = self._asked(queries, epsilon)
        if found is None:
            return self.spark.createDataFrame([], "query_id long, id long, score double")
        weights, blocks, about = found
        return _added(self._opened(blocks.join(weights, "t"), about, k1, b))

    def topk(self, queries: DataFrame, k: int = DEFAULTS.recall_k, k1: float = DEFAULTS.bm25_k1, b: float = DEFAULTS.bm25_b, epsilon: float = DEFAULTS.bm25_epsilon) -> DataFrame:
        """(query_id, id, score, rank): the best ``k`` by (score, id), then those above zero; equal to all ``scores`` so cut.

        The best block of each asked term gives a score that ``k`` documents reach.  Terms whose best bounds together
        stay under it cannot put a document there by themselves: candidates come from the other, essential terms.  Of
        these a block is opened only if its own bound and the best bounds of the question's other terms can reach the
        score.  The rest of the postings are added to the candidates that they can still help.  Many questions at once
        have all their terms' blocks opened instead, each once for all questions.
        """
        found = self._asked(queries, epsilon)
        if found is None:
            return self.spark.createDataFrame([], "query_id long, id long, score double, rank int")
        weights, blocks, about = found
        table = weights.limit(R.ASKED + 1).toArrow()
        if PAIRS < table.num_rows <= R.ASKED:
            return self._topk_of_runs(table, R.Weights(table, _mean(about), k1, b), blocks, about["versions"], k, queries.schema["query_id"].dataType.simpleString())
        kept, limits = self.opened_blocks(weights, blocks, about, k, k1, b)
        keys = ["t", "version", "lead"]
        first = self._opened(blocks.join(kept.where("essential").drop("essential"), keys), about, k1, b).groupBy("query_id", "id").agg(F.sum("s").alias("s"))
        able = F.col("reached").isNull() | (F.col("s") + F.col("spare") >= F.col("reached") - SLACK)
        first = first.join(limits, "query_id").where(able).select("query_id", "id", "s")
        rest = self._opened(blocks.join(kept.where("not essential").drop("essential"), keys), about, k1, b)
        scored = _added(first.unionByName(rest.join(first.select("query_id", "id"), ["query_id", "id"], "left_semi")))
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
        return scored.withColumn("rank", rank).where((F.col("rank") <= k) & (F.col("score") > 0))

    def _topk_of_runs(self, table: pa.Table, held: R.Weights, blocks: DataFrame, versions: list[int], k: int, kind: str) -> DataFrame:
        """Blocks of the asked terms meet by run; a task puts the postings of a run together by document, scores these
        and keeps its best, so neither postings nor scores are shuffled.  Ids that became void go before their bucket."""
        part = lambda c: F.pmod(F.xxhash64(c), F.lit(self.buckets)).cast("int").alias("part")
        asked = F.broadcast(self.spark.createDataFrame(table.select(["t"])).distinct())  # at most R.ASKED
        rows = blocks.join(asked, "t", "left_semi").select(part("lead"), F.lit(1).alias("role"), "version", "run", "t", "ids", "tfs", "dls")
        if len(versions) > 1:
            none = {"run": "long", "t": "string", "tfs": "array<int>", "dls": "array<long>"}
            void = self._gone(versions).select(part("id"), F.lit(0).alias("role"), F.col("until").alias("version"), F.array("id").alias("ids"), *[F.lit(None).cast(v).alias(c) for c, v in none.items()])
            rows = rows.unionByName(void)
        dealt = rows.repartition("part").sortWithinPartitions("part", "role", "version", "run")
        scored = dealt.mapInArrow(lambda batches: held.best(_by_document(batches), k), f"query_id {kind}, id long, score double")
        return R.bm25_topk(scored.withColumn("score", F.round("score", 6)), k)

    def opened_blocks(self, weights: DataFrame, blocks: DataFrame, about: dict, k: int, k1: float, b: float) -> tuple[DataFrame, DataFrame]:
        """(query_id, t, version, lead, w, essential) of the blocks that can hold one of the best ``k``, and
        (query_id, reached, spare): the score that ``k`` documents reach and what inessential terms add at most."""
        bound = F.greatest(F.lit(0.0), F.col("w") * _impact(F.col("max_tf"), F.col("min_dl"), about, k1, b))
        heads = blocks.select("t", "version", "lead", "max_tf", "min_dl").join(weights, "t").select("query_id", "t", "version", "lead", "w", bound.alias("bound"))
        by_term = Window.partitionBy("query_id", "t")
        heads = heads.withColumn("best", F.max("bound").over(by_term)).withColumn("n", F.row_number().over(by_term.orderBy(F.desc("bound"), "version", "lead")))
        seeds = _added(self._opened(blocks.join(heads.where("n = 1").select("query_id", "t", "version", "lead", "w"), ["t", "version", "lead"]), about, k1, b))
        place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score")))
        reached = seeds.withColumn("n", place).where(F.col("n") == k).select("query_id", F.col("score").alias("reached"))
        # With a negative weight a partial score is no lower bound: such a question opens all its blocks.
        upto = F.sum("best").over(Window.partitionBy("query_id").orderBy("best", "t").rowsBetween(Window.unboundedPreceding, 0))
        every = Window.partitionBy("query_id")
        terms = heads.where("n = 1").select("query_id", "t", "best", upto.alias("upto"), F.sum("best").over(every).alias("all"), F.min("w").over(every).alias("least")).join(reached, "query_id", "left")
        terms = terms.withColumn("reached", F.when(F.col("least") >= 0, F.col("reached")))
        terms = terms.withColumn("essential", F.col("reached").isNull() | (F.col("upto") >= F.col("reached") - SLACK))
        limits = terms.groupBy("query_id").agg(F.first("reached").alias("reached"), F.sum(F.when(F.col("essential"), F.lit(0.0)).otherwise(F.col("best"))).alias("spare"))
        able = F.col("reached").isNull() | (F.col("bound") + F.col("all") - F.col("best") >= F.col("reached") - SLACK)
        kept = heads.drop("best").join(terms, ["query_id", "t"]).where(able).select("query_id", "t", "version", "lead", "w", "essential")
        return kept, limits

    def _opened(self, blocks: DataFrame, about: dict, k1: float, b: float) -> DataFrame:
        """(query_id, id, s): what the blocks' live postings add."""
        rows = blocks.select("query_id", "w", "version", F.explode(F.arrays_zip("ids", "tfs", "dls")).alias("p")).select("query_id", "version", F.col("p.ids").alias("id"), (F.col("w") * _impact(F.col("p.tfs"), F.col("p.dls"), about, k1, b)).alias("s"))
        return self._present(rows, about["versions"]).select("query_id", "id", "s")

    def compacted(self, path: str) -> KeywordIndex:
        """The index written anew under ``path`` as one version, without what later versions made void."""
        fresh = KeywordIndex(self.spark, path, self.buckets, self.block)
        words = F.flatten(F.transform(F.arrays_zip("ts", "tfs"), lambda p: F.array_repeat(p["ts"], p["tfs"])))
        fresh._apply(self.documents().select("id", words.alias("w")), 0)
        return fresh


def _absent(ids: DataFrame, id_col: str) -> DataFrame:
    return ids.where(F.col(f"`{id_col}`").isNotNull()).select(F.col(f"`{id_col}`").cast("long").alias("id"), F.lit(None).cast("array<string>").alias("w")).distinct()


def _impact(tf: Column, dl: Column, about: dict, k1: float, b: float) -> Column:
    return tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / F.lit(_mean(about))))


def _mean(about: dict) -> float:
    return about["length"] / about["n"] if about["n"] and about["length"] else 1.0


def _idf(about: dict, epsilon: float) -> Column:
    raw = F.log(F.lit(float(about["n"])) - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)
    return F.when(raw < 0, F.lit(epsilon * about["mean_idf"])).otherwise(raw)


def _added(rows: DataFrame) -> DataFrame:
    return rows.groupBy("query_id", "id").agg(F.round(F.sum("s"), 6).alias("score"))


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Documents (part, id, dl, ts, tfs) as they come, of one part at a time, with about ``RUN`` postings or fewer."""
    held, size, last = [], 0, None
    for batch in R.slices(batches, "ts", R.WORDS):
        part = batch.column("part").to_numpy()
        cuts = [0, *(np.nonzero(part[1:] != part[:-1])[0] + 1).tolist(), len(part)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if held and (part[a] != last or size >= RUN):
                yield pa.Table.from_batches(held)
                held, size = [], 0
            held.append(batch.slice(a, b - a))
            size, last = size + len(held[-1].column("ts").flatten()), part[a]
    if held:
        yield pa.Table.from_batches(held)


def _blocks(rows: pa.Table, size: int, run: int) -> Iterator[pa.RecordBatch]:
    """Blocks of at most ``size`` postings of a term, by impact, from a run's documents."""
    rows = rows.combine_chunks()
    ts = rows.column("ts").chunk(0)
    at = np.repeat(np.arange(len(ts)), ts.value_lengths().to_numpy(zero_copy_only=False))
    words = ts.flatten().dictionary_encode()
    code, tf = words.indices.to_numpy(zero_copy_only=False), rows.column("tfs").chunk(0).flatten().to_numpy()
    ids, dl = rows.column("id").to_numpy()[at], rows.column("dl").to_numpy()[at]
    order = np.lexsort((ids, -(tf / (tf + 0.0005 * dl + 0.5)), code))
    code, tf, ids, dl = code[order], tf[order], ids[order], dl[order]
    first = np.nonzero(np.r_[True, code[1:] != code[:-1]])[0] if len(code) else np.zeros(0, np.int64)
    place = np.arange(len(code)) - np.repeat(first, np.diff(np.r_[first, len(code)]))
    starts = np.nonzero(place % size == 0)[0]
    most, least = (f.reduceat(x, starts) if len(starts) else x for f, x in ((np.maximum, tf), (np.minimum, dl)))
    for a in range(0, len(starts), 50_000):
        here = starts[a : a + 50_000]
        ends = np.r_[here, starts[a + 50_000] if a + 50_000 < len(starts) else len(code)]
        lists = [pa.ListArray.from_arrays(pa.array((ends - ends[0]).astype(np.int32)), pa.array(x[ends[0] : ends[-1]])) for x in (ids, tf, dl)]
        arrays = [words.dictionary.take(pa.array(code[here])), pa.array(ids[here]), pa.array(most[a : a + 50_000]), pa.array(least[a : a + 50_000]), *lists, pa.array(np.full(len(here), run, np.int64))]
        yield pa.RecordBatch.from_arrays(arrays, names=["t", "lead", "max_tf", "min_dl", "ids", "tfs", "dls", "run"])


def _by_document(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, dl, ts, tfs) of the documents, a run after the other, of blocks and void ids sorted as ``_topk_of_runs`` has them."""
    key, held, void = None, [], []
    for batch in batches:
        at = np.stack([batch.column(c).fill_null(0).to_numpy().astype(np.int64) for c in ("part", "role", "version", "run")], axis=1)
        cuts = [0, *(np.nonzero((at[1:] != at[:-1]).any(axis=1))[0] + 1).tolist(), len(at)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if a == b:
                continue
            now = tuple(at[a].tolist())
            if now != key and held:
                yield _turned(held, key[2], void)
                held = []
            if key is None or now[0] != key[0]:
                void = []
            key, rows = now, batch.slice(a, b - a)
            if now[1]:
                held.append(rows)
            else:
                void.append((now[2], rows.column("ids").flatten().to_numpy()))
    if held:
        yield _turned(held, key[2], void)


def _turned(blocks: list[pa.RecordBatch], version: int, void: list[tuple[int, np.ndarray]]) -> pa.RecordBatch:
    """The blocks of a run by document, without ids that a later version made void."""
    table = pa.Table.from_batches(blocks).combine_chunks()
    lists = [table.column(c).chunk(0) for c in ("ids", "tfs", "dls")]
    word = np.repeat(np.arange(len(table)), lists[0].value_lengths().to_numpy(zero_copy_only=False))
    ids, tf, dl = (x.flatten().to_numpy() for x in lists)
    gone = [x for until, x in void if until > version]
    live = np.nonzero(~np.isin(ids, np.concatenate(gone)))[0] if gone else np.arange(len(ids))
    order = live[np.argsort(ids[live], kind="stable")]
    ids = ids[order]
    first = np.nonzero(np.r_[True, ids[1:] != ids[:-1]])[0] if len(ids) else np.zeros(0, np.int64)
    ends = pa.array(np.r_[first, len(ids)].astype(np.int32))
    ts, tfs = table.column("t").chunk(0).take(pa.array(word[order])), pa.array(tf[order])
    return pa.RecordBatch.from_arrays([pa.array(ids[first]), pa.array(dl[order][first]), pa.ListArray.from_arrays(ends, ts), pa.ListArray.from_arrays(ends, tfs)], names=["id", "dl", "ts", "tfs"])
