"""Operator 8, BPE encoding and decoding: speculate and verify.

Greedy longest match proposes tokens, a vectorised compatibility check tests every adjacent pair, and only failing
words are merged exactly.  No shuffle.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import Codec
from .common import append_columns, field


def encode(docs: DataFrame, tokenizer: str, text_col: str = "text", ids_col: str = "token_ids") -> DataFrame:
    """``docs`` with ``ids_col`` binary: the text's token ids as little-endian uint32.

    Null and empty texts encode to no bytes; equal texts encode alike; an existing ``ids_col`` is replaced, other columns
    pass through; an empty table gives an empty table.
    """

    def make():
        codec = Codec(tokenizer)
        return lambda texts: [codec.encode([t or "" for t in texts])]

    return append_columns(docs, text_col, make, [field(ids_col, "binary")])


def decode(encoded: DataFrame, tokenizer: str, ids_col: str = "token_ids", out_col: str = "decoded") -> DataFrame:
    """``encoded`` with ``out_col`` string, the text its ids stand for; null ids decode to the empty text.

    Repeated rows decode alike; an existing ``out_col`` is replaced; an empty table gives an empty table."""

    def make():
        codec = Codec(tokenizer)
        return lambda ids: [[codec.decode(i or b"").decode() for i in ids]]

    return append_columns(encoded, ids_col, make, [field(out_col, "string")])


def code(docs: DataFrame, tokenizer: str, text_col: str = "text") -> DataFrame:
    """``docs`` with ``n_tokens`` long, ``token_ids`` binary (as ``encode`` has them) and ``decoded_sha256`` string, the
    digest in hex of the text the ids decode to; encoded and decoded in one pass over the texts.

    Null and empty texts have no tokens and decode to the empty text.  Repeated rows and ties give equal rows; texts of
    any length are coded whole.  Existing columns of these names are replaced, other columns pass through; an empty
    table gives an empty table.
    """

    def make():
        codec = Codec(tokenizer)

        def run(texts):
            ids = codec.encode([t or "" for t in texts])
            return [[len(i) // 4 for i in ids], ids, [hashlib.sha256(codec.decode(i)).hexdigest() for i in ids]]

        return run

    return append_columns(docs, text_col, make, [field("n_tokens", "long"), field("token_ids", "binary"), field("decoded_sha256", "string")])


def round_trip(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every row: digests of the ids and of the text they decode to.

    Null and empty texts have no tokens; every row gives a row, repeated ones equal rows; other columns are ignored; an
    empty table gives an empty table.
    """
    text = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return code(text, tokenizer).select("doc_id", "n_tokens", F.sha2("token_ids", 256).alias("ids_sha256"), "decoded_sha256")
