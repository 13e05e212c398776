"""Segmentation: sentences, breakpoints, chunks, parents and children."""

from __future__ import annotations

from collections import deque

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULTS
from ..functions import text as X


def split_sentences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return docs.select(F.col(id_col).alias("doc_id"), F.posexplode(X.sentences(F.col(text_col))).alias("pos", "sentence"))


def smooth(long: DataFrame, half: int = DEFAULTS.window_size // 2) -> DataFrame:
    """Centred mean over neighbouring vectors in long form (doc, pos, dim, val), then unit length."""
    near = Window.partitionBy("doc", "dim").orderBy("pos").rowsBetween(-half, half)
    mean = long.withColumn("val", F.avg("val").over(near))
    norm = F.sqrt(F.sum(F.col("val") * F.col("val")).over(Window.partitionBy("doc", "pos")))
    return mean.withColumn("val", F.col("val") / F.when(norm == 0, F.lit(1.0)).otherwise(norm))


def adjacent(vectors: DataFrame) -> DataFrame:
    """(doc, pos, sim): product of each vector with the next of its document."""
    from ..functions.vectors import dot

    following = F.lead("vec").over(Window.partitionBy("doc").orderBy("pos"))
    return vectors.withColumn("after", following).where("after is not null").select("doc", "pos", dot(F.col("vec"), F.col("after")).alias("sim"))


def breakpoints(sims: DataFrame, percentile: float = DEFAULTS.breakpoint_percentile) -> DataFrame:
    """Gaps whose similarity lies under the document's percentile."""
    cut = sims.groupBy("doc").agg(F.expr(f"percentile(sim, {percentile / 100})").alias("threshold"))
    return sims.join(cut, "doc").where("sim < threshold").select("doc", "pos")


def split_code_aware(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc, pos, sentence, is_code, code_language): sentences, with each fenced block as one."""
    rows = docs.select(F.col(id_col).alias("doc"), F.posexplode(X.code_aware_sentences(F.col(text_col))).alias("pos", "s"))
    return rows.select("doc", "pos", F.col("s.text").alias("sentence"), "s.is_code", "s.code_language")


def merged_pieces(pieces: list[str], least: int, joint: str = " ") -> list[str]:
    """Texts in order, each joined by the next ones while it is shorter than ``least``; in time linear in the texts."""
    out: list[str] = []
    held: list[str] = []
    length = 0
    for piece in pieces:
        if held and length >= least:
            out.append(joint.join(held))
            held, length = [], 0
        length += len(piece) + (len(joint) if held else 0)
        held.append(piece)
    if held:
        out.append(joint.join(held))
    return out


def merge_small(pieces: Column, least: int, joint: str = " ") -> Column:
    """``merged_pieces`` of an array of texts, null for null."""

    @F.pandas_udf("array<string>")
    def merge(rows: pd.Series) -> pd.Series:
        return rows.map(lambda r: None if r is None else merged_pieces(list(r), least, joint))

    return merge(pieces)


def hard_slices(c: Column, most: int) -> Column:
    last = F.greatest(F.lit(0), F.floor((F.length(c) - 1) / most)).cast("int")
    return F.transform(F.sequence(F.lit(0), last), lambda i: F.substring(c, i * most + 1, F.lit(most)))


def split_oversized(pieces: list[str], most: int) -> list[list[str]]:
    """Halve a list of sentences until each part's text fits; a single long sentence is sliced."""
    if len(" ".join(pieces)) <= most:
        return [pieces]
    if len(pieces) == 1:
        return [[pieces[0][a : a + most]] for a in range(0, len(pieces[0]), most)]
    half = len(pieces) // 2
    return split_oversized(pieces[:half], most) + split_oversized(pieces[half:], most)


#: Where the fallback splitter cuts, coarsest first.
SEPARATORS = ("\n## ", "\n### ", "\n\n", "\n", "。", "")


def recursive_pieces(text: str, size: int, overlap: int, separators: tuple[str, ...] = SEPARATORS) -> list[str]:
    """Split at the first separator that occurs, keeping it in front of what follows; pack pieces up to ``size``
    characters with an overlap of whole pieces; split what is still longer by the separators that remain.

    A piece is packed and let go of once, and single characters are packed by offsets, so the time is linear in the text
    for each separator.
    """
    at = next(i for i, s in enumerate(separators) if not s or s in text)
    sep, rest = separators[at], separators[at + 1 :]
    if not sep:
        return _windows(text, size, overlap)
    head, *tail = text.split(sep)
    out: list[str] = []
    held: deque[str] = deque()
    length = 0

    def flush() -> None:
        whole = "".join(held).strip()
        if whole:
            out.append(whole)

    for part in filter(None, [head, *[sep + t for t in tail]]):
        if len(part) > size and rest:
            flush()
            held.clear()
            length = 0
            out += recursive_pieces(part, size, overlap, rest)
            continue
        if held and length + len(part) > size:
            flush()
            while held and (length > overlap or length + len(part) > size):
                length -= len(held.popleft())
        held.append(part)
        length += len(part)
    flush()
    return out


def _windows(text: str, size: int, overlap: int) -> list[str]:
    """Trimmed windows of ``size`` characters that share ``overlap``, or all but one of a window's."""
    size = max(size, 1)
    step = size - min(overlap, size - 1)
    last = max(0, -(-(len(text) - size) // step)) if len(text) > size else 0
    return [w for w in (text[i * step : i * step + size].strip() for i in range(last + 1)) if w]


def recursive_split(docs: DataFrame, size: int = DEFAULTS.chunk_size, overlap: int = DEFAULTS.chunk_overlap, text_col: str = "text") -> DataFrame:
    """(doc_id, chunk_index, chunk): the fallback splitter, in Arrow batches."""
    @F.pandas_udf("array<string>")
    def cut(s: pd.Series) -> pd.Series:
        return s.map(lambda t: recursive_pieces(t or "", size, overlap) if t else [])

    return docs.select("doc_id", F.posexplode(cut(text_col)).alias("chunk_index", "chunk"))


def choose_chunks(semantic: Column, fallback: Column) -> Column:
    """Semantic chunks where there are any, else the fallback's; with the chosen chunker's label."""
    some = F.coalesce(F.size(semantic), F.lit(0)) > 0
    return F.struct(F.when(some, "semantic").otherwise("recursive").alias("chunker"), F.when(some, semantic).otherwise(fallback).alias("pieces"))


def is_code_only(c: Column) -> Column:
    t = X.strip(c)
    return t.startswith("```") & t.endswith("```") & (F.size(F.split(t, "```", -1)) == 3)
