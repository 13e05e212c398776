"""Shared plumbing: column-appending Arrow maps, materialised intermediates and small helpers."""

from __future__ import annotations

import ctypes
import os
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

try:
    TRIM = ctypes.CDLL(None).malloc_trim
except (AttributeError, OSError):  # another C library
    TRIM = None

#: Texts of at most so many characters are handled together inside one Arrow batch.
SLICE_CHARS = 500_000


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names; a temporary one of our own only where all tasks run on this machine."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"file://{os.path.join(tempfile.gettempdir(), 'tarnwick-shared')}"


#: Files of a small table at least, and narrow rows of a file.
FILES, FILE_ROWS = 6, 1_000_000


class Scratch:
    """Tables written to the shared folder and read back, so that later stages restart from files, not the lineage.

    ``drop`` deletes those that no plan reads any more.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.paths: dict[int, str] = {}
        self.tables: list[DataFrame] = []

    def keep(self, df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
        """Write a table.  One of narrow rows comes from as many tasks as the last exchange had; ``rows``, about how many
        there can be, has it written in few files instead."""
        path = f"{shared_dir(self.spark)}/{name}-{uuid.uuid4().hex}"
        (df if rows is None else df.repartition(max(FILES, -(-rows // FILE_ROWS)))).write.parquet(path)
        table = self.spark.read.schema(df.schema).parquet(path)
        self.tables.append(table)
        self.paths[id(table)] = path
        return table

    def drop(self, *tables: DataFrame) -> None:
        """Delete the given tables, or all."""
        for table in tables or tuple(self.tables):
            where = self.spark._jvm.org.apache.hadoop.fs.Path(self.paths.pop(id(table)))
            where.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(where, True)
            self.tables = [t for t in self.tables if t is not table]


def materialize(df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
    """``df`` written to the shared folder and read back, for results that the caller goes on to read."""
    return Scratch(df.sparkSession).keep(df, name, rows)


def fold(id_col: Column, modulus: int) -> Column:
    """crc32 of the id's decimal text, modulo ``modulus``: the held-out folds.  A null id is in fold 0."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % F.lit(modulus), F.lit(0))


def unit_hash(*parts: Column) -> Column:
    """A number in [0, 1) from the MD5 of the parts: 32 bits, the same in any SQL engine."""
    digest = F.md5(F.concat_ws("|", *[p.cast("string") for p in parts]).cast("binary"))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") / F.lit(4294967296.0)


def passage_of(text: Column, size: int) -> Column:
    """The text, or of a longer one a passage of ``size`` characters at a place chosen by its hash: for training samples."""
    room = F.length(text) - F.lit(size) + 1
    return F.when(room <= 1, text).otherwise(F.substring(text, 1 + F.pmod(F.xxhash64(text), F.greatest(room, F.lit(1))).cast("int"), F.lit(size)))


def bounded_batches(spark: SparkSession, most: int = 8 << 20) -> None:
    """Hold the bytes of an Arrow batch down, so that a worker's memory depends on neither row count nor text length;
    and have unions exchange their rows anew, as Spark 4.1 can mix up partitions where they keep their children's."""
    if spark.conf.get("spark.sql.unionOutputPartitioning") != "false":
        spark.conf.set("spark.sql.unionOutputPartitioning", "false")
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = re.fullmatch(r"(\d+)b?", spark.conf.get(key))
    if not now or int(now[1]) > most:
        spark.conf.set(key, str(most))


def release() -> None:
    """Give memory that Arrow and the C library hold for reuse back to the system."""
    pa.default_memory_pool().release_unused()
    if TRIM is not None:
        TRIM(0)


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.RecordBatch]:
    """Of batches sorted by integer ``keys``: the rows of one key after the other, each in one batch."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        at = np.stack([batch.column(k).to_numpy().astype(np.int64) for k in keys], axis=1)
        cuts = [0, *(np.nonzero((at[1:] != at[:-1]).any(axis=1))[0] + 1).tolist(), len(at)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            key = tuple(at[a].tolist())
            if held and key != last:
                yield _joined(held)
                held = []
            held.append(batch.slice(a, b - a))
            last = key
    if held:
        yield _joined(held)


#: Keys with more than one row in so many are fewer than that, whatever the data, and are broadcast.
HEAVY = 1024


def join_back(rows: DataFrame, found: DataFrame, key: str, total: int) -> DataFrame:
    """``rows`` with the columns of ``found``, which has each ``key`` once and its number of rows as ``n``.

    Heavy keys, at most ``HEAVY`` of ``total`` rows' keys, meet their rows by broadcast, so no key of the shuffled join
    holds more than ``total / HEAVY`` rows.  ``rows`` and ``found`` are read twice.  Null keys meet nothing.
    """
    heavy = F.broadcast(found.where(F.col("n") * HEAVY > total).drop("n"))
    light = found.where(F.col("n") * HEAVY <= total).drop("n")
    return rows.join(heavy, key).unionByName(rows.join(heavy.select(key), key, "left_anti").join(light, key))


def _joined(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
    return parts[0] if len(parts) == 1 else pa.Table.from_batches(parts).combine_chunks().to_batches()[0]


def slices(texts: list[str], limit: int = SLICE_CHARS) -> Iterator[tuple[int, int]]:
    """Index ranges whose texts have about ``limit`` characters; a longer text stands alone."""
    start = size = 0
    for i, text in enumerate(texts):
        size += len(text)
        if size >= limit:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def append_columns(
    df: DataFrame,
    text_col: str,
    make: Callable[[], Callable[[list[str | None]], list]],
    fields: list[T.StructField],
) -> DataFrame:
    """All columns of ``df`` plus ``fields``, computed from the text column batch by batch.

    ``make()`` runs once in a Python worker's task and returns a function from a list of texts to a list of columns.
    Columns of ``df`` with a name of ``fields`` are replaced.
    """
    bounded_batches(df.sparkSession)
    names = {f.name for f in fields}
    base = df.select(*[F.col(f"`{c}`") for c in df.columns if c not in names or c == text_col])
    kept = [f for f in base.schema.fields if f.name not in names]
    schema = T.StructType(kept + fields)
    kept_names = [f.name for f in kept]
    arrow = pa.schema([pa.field(f.name, _arrow_type(f.dataType)) for f in fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fn = make()
        for batch in batches:
            texts = batch.column(text_col).to_pylist()
            for a, b in slices([t or "" for t in texts]):
                cols = fn(texts[a:b])
                part = batch.slice(a, b - a)
                arrays = [part.column(n) for n in kept_names]
                arrays += [c if isinstance(c, pa.Array) else pa.array(c, type=t.type) for c, t in zip(cols, arrow, strict=True)]
                yield pa.RecordBatch.from_arrays(arrays, names=kept_names + arrow.names)
            del batch, texts
            release()

    return base.mapInArrow(run, schema)


def _arrow_type(kind: T.DataType) -> pa.DataType:
    return {
        "bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(), "boolean": pa.bool_(), "binary": pa.binary(),
    }[kind.simpleString()]


def free_name(name: str, taken: list[str]) -> str:
    """``name``, with underscores in front until no column has it, in any case."""
    low = {c.lower() for c in taken}
    while name.lower() in low:
        name = "_" + name
    return name


def field(name: str, kind: str) -> T.StructField:
    return T.StructField(name, {"long": T.LongType(), "int": T.IntegerType(), "double": T.DoubleType(), "string": T.StringType(), "boolean": T.BooleanType(), "binary": T.BinaryType()}[kind])
