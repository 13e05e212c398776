"""Operator 10, mixing sources to target weights: Poisson replication, in DataFrame functions only.

Each document's repetition count inverts a Poisson distribution at a hash-seeded uniform number; the distribution's
mean is the rate at which its source must repeat to reach its target weight.  Documents are exploded by their counts
and dealt out globally by a hash.  The same seed gives the same mixture on any cluster.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import free_name, unit_hash

#: Sources, and probabilities of all of them (8 bytes each), up to which the table of rates is broadcast; beyond either
#: the join is salted.
BROADCAST_SOURCES, BROADCAST_STEPS = 50_000, 2_000_000
SALTS = 64


def rates(docs: DataFrame, source_col: str = "source", weights: DataFrame | None = None, size: float = 1.0, exponent: float = 0.5) -> DataFrame:
    """(source, n, rate, steps): documents, mean repetitions and the cumulative probabilities of each source.

    ``weights`` (source, weight) sets target shares; sources it lacks get none.  Without it shares follow the sources'
    sizes to the power ``exponent``, which lifts small sources.  The mixture has ``size`` times as many rows as the
    input, in expectation.  A null source is a source of its own.
    """
    counts = docs.groupBy(F.col(source_col).alias("source")).agg(F.count("*").alias("n"))
    if weights is None:
        shares = counts.withColumn("weight", F.pow(F.col("n").cast("double"), F.lit(float(exponent))))
    else:
        named = weights.groupBy(F.col("source").alias("name")).agg(F.sum("weight").alias("weight"))
        shares = counts.join(named, counts["source"].eqNullSafe(named["name"]), "left").select("source", "n", F.greatest(F.coalesce("weight", F.lit(0.0)), F.lit(0.0)).alias("weight"))
    total = shares.agg(F.sum("n").alias("n"), F.sum("weight").alias("w")).first()
    scale = total["n"] * float(size) / total["w"] if total["w"] else 0.0
    rated = shares.select("source", "n", (F.col("weight") * F.lit(scale) / F.col("n")).alias("rate"))
    # As many terms as 32-bit numbers can tell apart: past mean + 8 deviations + 20 the tail is below 2^-33.
    terms = rated.where("rate > 0").withColumn("k", F.explode(F.sequence(F.lit(0), F.ceil(F.col("rate") + 8 * F.sqrt("rate") + 20).cast("int"))))
    upto = Window.partitionBy("source").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    logs = F.sum(F.when(F.col("k") > 0, F.log(F.col("k").cast("double"))).otherwise(F.lit(0.0))).over(upto)
    terms = terms.withColumn("logf", logs).withColumn("p", F.exp(F.col("k") * F.log("rate") - F.col("rate") - F.col("logf")))
    terms = terms.select("source", "k", F.sum("p").over(upto).alias("cum"))
    steps = terms.groupBy("source").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "cum"))), lambda x: x["cum"]).alias("found"))
    steps = steps.select(F.col("source").alias("name"), "found")
    joined = rated.join(steps, rated["source"].eqNullSafe(steps["name"]), "left")
    return joined.select("source", "n", "rate", F.coalesce("found", F.array(F.lit(1.0))).alias("steps"))


def mix(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", weights: DataFrame | None = None, size: float = 1.0, exponent: float = 0.5, seed: str = "mix", copy_col: str = "mix_copy") -> DataFrame:
    """``docs`` repeated to the target weights and shuffled globally, with ``copy_col`` int (1, 2, ...).

    All columns pass through; an existing ``copy_col`` is replaced.  Rows that share an id share its count; null ids are
    one id.  Null and long texts pass through like any other value.  An empty table gives an empty table.
    """
    kept = [c for c in docs.columns if c.lower() != copy_col.lower()]
    source, steps, u, salt, n, at = (free_name(f"mix_{x}", [*kept, copy_col]) for x in ("source", "steps", "u", "salt", "n", "at"))
    table = rates(docs, source_col, weights, size, exponent)
    most = rates_size(table)
    table = table.select(F.col("source").alias(source), F.col("steps").alias(steps))
    keyed = docs.select(*[F.col(f"`{c}`") for c in kept]).withColumn(u, unit_hash(F.coalesce(F.col(id_col).cast("string"), F.lit("null")), F.lit(seed)))
    if most[0] <= BROADCAST_SOURCES and most[1] <= BROADCAST_STEPS:
        joined = keyed.join(F.broadcast(table), F.col(source_col).eqNullSafe(F.col(source)))
    else:
        # Rates of each source stand under every salt; a document takes one, so a hot source is spread.
        salted = table.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        keyed = keyed.withColumn(at, F.pmod(F.xxhash64(*spread(docs, kept)), F.lit(SALTS)).cast("int"))
        joined = keyed.join(salted, F.col(source_col).eqNullSafe(F.col(source)) & (F.col(at) == F.col(salt))).drop(at, salt)
    count = F.size(F.filter(steps, lambda c: c <= F.col(u)))
    copies = joined.withColumn(n, count).where(F.col(n) > 0).withColumn(copy_col, F.explode(F.sequence(F.lit(1), F.col(n))))
    # Ranges of a uniform hash: dealt out over all partitions, in hash order within each, so in one global random order.
    # All values count, so that different rows of one id, or of none, are spread too; and equal rows, which their order
    # does not tell apart, are dealt out by where they were read.
    dealt = copies.drop(source, steps, u, n).withColumn(at, F.xxhash64(F.lit(seed), copy_col, *spread(docs, kept)))
    return dealt.repartition(F.col(at), F.pmod(F.monotonically_increasing_id(), F.lit(SALTS))).sortWithinPartitions(at).drop(at)


def rates_size(table: DataFrame) -> tuple[int, int]:
    """Sources, and probabilities of all of them."""
    row = table.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.size("steps")), F.lit(0)).alias("steps")).first()
    return row["n"], row["steps"]


def spread(docs: DataFrame, columns: list[str]) -> list[Column]:
    """The columns that can be hashed."""
    return [F.col(f"`{c}`") for c in columns if "map<" not in docs.schema[c].dataType.simpleString() and "variant" not in docs.schema[c].dataType.simpleString()]
