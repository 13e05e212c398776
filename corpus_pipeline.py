"""A training-corpus pipeline over ``documents``: quality, language, near-duplicates, source mixing, BPE.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept.  All but the last return the columns
of their input with their values, extra ones included, whatever their names; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnwick.llm import bpe_codec, jaccard, langid, mixing, quality
from tarnwick.llm.common import fold, free_name, load, materialize
from tarnwick.llm.queries import GOOD_FROM, tokenizer

#: Ids of dropped documents up to which their table is broadcast (8 bytes each); beyond it the join is shuffled.
BROADCAST_DROPPED = 1_000_000


def own(docs: DataFrame) -> list[Column]:
    return [F.col(f"`{c}`") for c in docs.columns]


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9: documents scored under the threshold go.

    Null and empty texts are scored like any other, by a row without features; equal texts fare alike, so copies and
    repeated rows stay or go together.  Rows with a null id are scored and kept by their texts.
    """
    model = quality.train(docs, load(spark, sf_dir, "labels"), fold(F.col("doc_id"), 3) != 1)
    score = free_name("quality", docs.columns)
    return quality.score(docs, model, score_col=score).where(F.col(score) >= GOOD_FROM).select(*own(docs))


def keep_known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2: documents whose language prediction is rejected go.

    Null texts and texts without a letter are rejected.  Equal texts fare alike; rows with a null id are judged by
    their texts.  Without any labelled row no language is known, and nothing stays.
    """
    model = langid.train(docs, fold(F.col("doc_id"), 4) != 2)
    prefix, taken = "lang_", {c.lower() for c in docs.columns}
    while any(prefix + name in taken for name in ("pred", "score", "accepted")):
        prefix = "_" + prefix
    return langid.predict(docs, model, prefix=prefix).where(f"{prefix}accepted").select(*own(docs))


def keep_one_of_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: of each group of near-duplicates the document with the smallest id stays.

    Of rows that repeat an id and a text the first by their other values stays.  Rows of one id with different texts are one document, which stays or
    goes as a whole.  Null and empty texts and rows with a null id link with nothing, so they stay.
    """
    groups = jaccard.near_groups(docs)
    dropped = groups.where("doc_id <> component_id").select("doc_id").distinct()
    side = F.broadcast(dropped) if dropped.count() <= BROADCAST_DROPPED else dropped
    kept = docs.join(side, "doc_id", "left_anti").select(*own(docs))
    repeated = groups.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id")
    if not repeated.limit(1).count():
        return kept
    row, order = F.struct(*own(docs)), F.struct(*mixing.spread(docs, docs.columns))
    once = kept.join(repeated, "doc_id", "left_semi").groupBy(F.col("doc_id").alias("__id"), F.col("text").alias("__text")).agg(F.min_by(row, order).alias("__row"))
    return kept.join(repeated, "doc_id", "left_anti").select(*own(docs)).unionByName(once.select(*[F.col("__row")[c].alias(c) for c in docs.columns]))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: documents are repeated to the sources' target weights, which can be no time at all.

    A null source is a source of its own.  Rows that share an id share its count, and null ids are one id.
    """
    return mixing.mix(docs, copy_col=free_name("mix_copy", docs.columns)).select(*own(docs))


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: token ids (little-endian uint32) of every text, with the digest of the text they decode to.

    Null and empty texts have no tokens; every row, repeated or of a null id, gives a row.
    """
    coded = bpe_codec.code(docs.select("doc_id", "lang", "source", "text"), tokenizer())
    return coded.select("doc_id", "lang", "source", "n_tokens", "token_ids", "decoded_sha256")


STAGES = [
    ("quality classifier", keep_good),
    ("language ID", keep_known_language),
    ("n-gram Jaccard join", keep_one_of_group),
    ("mixing sources", mix_sources),
    ("BPE encoding", encode_tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order, each written as Parquet and read again by the next."""
    docs = load(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
    return docs


#: Trained models decide which rows stay, which SQL cannot express; tests hold it against a brute-force version.
ORACLE_SQL = None
