"""Operator 1, token counts: rank-synchronous array merging.

Batched pre-tokens are held as ragged numpy arrays; each round applies every sequence's lowest-rank pair at once, and
the surviving symbols are counted.  No shuffle: the map runs where the text is read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import Counter
from .common import append_columns, field


def token_counts(docs: DataFrame, tokenizer: str, text_col: str = "text", count_col: str = "n_tokens") -> DataFrame:
    """``docs`` with ``count_col`` long, the number of tokens of the whole text.

    Null and empty texts have 0 tokens; repeated rows and ties are counted row by row; an existing ``count_col`` is
    replaced and all other columns pass through; an empty table gives an empty table.
    """

    def make():
        count = Counter(tokenizer)
        return lambda texts: [count([t or "" for t in texts])]

    return append_columns(docs, text_col, make, [field(count_col, "long")])


def token_report(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 1024) -> DataFrame:
    """One row a document: id, UTF-8 bytes, tokens, and whether the tokens exceed ``limit``."""
    text = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return token_counts(text, tokenizer).select(
        "doc_id",
        F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes"),
        "n_tokens",
        (F.col("n_tokens") > limit).alias("over_limit"),
    )
