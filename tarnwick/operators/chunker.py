"""The semantic chunker and the two-level chunker built on it, each in one pass over the texts without a shuffle.

Texts are cut into sentences by JVM expressions; what depends on order inside a text (smoothing, breakpoints, merging,
halving) runs on whole texts in Arrow batches.  A chunk is a range of its text's sentences, so sizes come from running
sums.  The embedder is a batch function from texts to vectors; the default hashes words.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULTS
from ..functions import text as X
from . import segment as S
from .retrieval import _bucket, slices

Embedder = Callable[[list[str]], np.ndarray]
WORDS = regex.compile(r"[一-鿿]|(?:(?![一-鿿])[\p{L}\p{N}])+")
#: Separators of sections and of children without semantic chunks, and the overlaps of their pieces.
SECTION_SEPARATORS = ("\n\n", "\n", "。", "")
SECTION_OVERLAP, CHILD_OVERLAP = 100, 40
#: Sentences that a task takes up at a time.
SENTENCES = 20_000
OUT = "chunk_index int, text string, is_code boolean, code_language string"


def hashed_embedder(texts: list[str], dims: int = DEFAULTS.vector_dims) -> np.ndarray:
    """Word counts by hash bucket, at unit length: the default embedding, as ``retrieval.hashed_terms`` has it."""
    found = [[_bucket(w, dims) for w in WORDS.findall(t.lower())] for t in texts]
    return unit(np.array([np.bincount(f, minlength=dims) if f else np.zeros(dims) for f in found], np.float64).reshape(-1, dims))


def unit(rows: np.ndarray) -> np.ndarray:
    norm = np.sqrt((rows * rows).sum(axis=1, keepdims=True))
    return rows / np.where(norm == 0, 1, norm)


@dataclass(frozen=True)
class Sizes:
    least: int = DEFAULTS.min_chunk
    most: int = DEFAULTS.max_chunk
    percentile: float = DEFAULTS.breakpoint_percentile
    half: int = DEFAULTS.window_size // 2


def similarities(vectors: np.ndarray, half: int) -> np.ndarray:
    """Products of neighbouring vectors, each the centred mean of its window at unit length; to six places."""
    n = len(vectors)
    total = np.vstack([np.zeros(vectors.shape[1]), np.cumsum(vectors, axis=0)])
    lo, hi = np.maximum(np.arange(n) - half, 0), np.minimum(np.arange(n) + half + 1, n)
    smooth = unit((total[hi] - total[lo]) / (hi - lo)[:, None])
    return np.round((smooth[:-1] * smooth[1:]).sum(axis=1), 6)


def chunk_ranges(lengths: list[int], code: list[bool], cut_after: set[int], sizes: Sizes) -> Iterator[tuple[int, int, int]]:
    """(first, past the last, slice or -1) of each chunk over the sentences of one text.

    A chunk ends at a breakpoint and where code begins or ends; a short one takes up the next of its kind; one that is
    too long is halved by sentences, and a single long sentence, unless it is code, is sliced.
    """
    until = np.cumsum([0, *[n + 1 for n in lengths]]).tolist()  # a blank joins sentences
    size = lambda a, b: until[b] - until[a] - 1
    n = len(lengths)
    starts = [0, *[i + 1 for i in range(n - 1) if i in cut_after or code[i] != code[i + 1]]]
    merged: list[list[int]] = []
    for a, b in zip(starts, [*starts[1:], n], strict=True):
        if merged and size(*merged[-1]) < sizes.least and code[merged[-1][0]] == code[a]:
            merged[-1][1] = b
        else:
            merged.append([a, b])
    todo = [tuple(m) for m in reversed(merged)]
    while todo:
        a, b = todo.pop()
        if size(a, b) <= sizes.most or (b - a == 1 and code[a]):
            yield a, b, -1
        elif b - a == 1:
            yield from ((a, b, k) for k in range(-(-lengths[a] // sizes.most)))
        else:
            middle = a + (b - a) // 2
            todo += [(middle, b), (a, middle)]


def chunks_of(sentences: list[dict], vectors: np.ndarray | None, sizes: Sizes) -> list[tuple[str, bool, str | None]]:
    """(text, is_code, code_language) of one text's chunks; fewer than three sentences are one chunk."""
    if not sentences:
        return []
    texts, code = [s["text"] for s in sentences], [s["is_code"] for s in sentences]
    if vectors is None:
        ranges = [(0, len(texts), -1)]
    else:
        sims = similarities(vectors, sizes.half)
        cuts = np.nonzero(sims < np.percentile(sims, sizes.percentile))[0]
        ranges = chunk_ranges([len(t) for t in texts], code, set(cuts.tolist()), sizes)
    out = []
    for a, b, k in ranges:
        text = " ".join(texts[a:b]) if k < 0 else texts[a][k * sizes.most : (k + 1) * sizes.most]
        whole = all(code[a:b])
        if text.strip():
            out.append((text.strip(), whole, sentences[a]["code_language"] if whole else None))
    return out


def semantic_chunks(docs: DataFrame, keys: list[str], text_col: str = "text", sizes: Sizes = Sizes(), embed: Embedder = hashed_embedder, fallback: Callable[[str], list[str]] | None = None) -> DataFrame:
    """``keys`` and (chunk_index, text, is_code, code_language, chunker) for the chunks of each row's text.

    Where there is no semantic chunk, or the embedder fails, ``fallback`` cuts the text, if given; ``chunker`` tells
    which of the two it was.  Null and empty texts have no chunks.
    """
    taken = docs.select(*keys, F.col(text_col).alias("__text"), X.code_aware_sentences(F.col(text_col)).alias("__s"))
    kinds = [f"{f.name} {f.dataType.simpleString()}" for f in docs.select(*keys).schema.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "__s", SENTENCES):
            listed = [s or [] for s in batch.column("__s").to_pylist()]
            whole = batch.column("__text").to_pylist()
            at, rows = [], []
            for i, (sentences, text) in enumerate(zip(listed, whole, strict=True)):
                name = "semantic"
                try:
                    found = chunks_of(sentences, embed([s["text"] for s in sentences]) if len(sentences) >= 3 else None, sizes)
                except Exception:  # a plug-in's failure: the text is one chunk
                    found = chunks_of(sentences, None, sizes)
                if not found and fallback is not None and text:
                    name, found = "recursive", [(t, False, None) for t in fallback(text)]
                at += [i] * len(found)
                rows += [(k, *c, name) for k, c in enumerate(found)]
            picked = batch.select(keys).take(pa.array(at, pa.int64()))
            made = [pa.array([r[j] for r in rows], kind) for j, kind in enumerate((pa.int32(), pa.string(), pa.bool_(), pa.string(), pa.string()))]
            yield pa.RecordBatch.from_arrays([*picked.columns, *made], names=[*keys, "chunk_index", "text", "is_code", "code_language", "chunker"])

    return taken.mapInArrow(run, ", ".join([*kinds, OUT, "chunker string"]))


def sentence_sims(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", half: int = Sizes.half, embed: Embedder = hashed_embedder) -> DataFrame:
    """(doc, pos, sim): ``similarities`` of each text's sentences, a row for each but the last; nothing is shuffled."""
    texts = F.transform(X.code_aware_sentences(F.col(text_col)), lambda s: s["text"])
    rows = docs.select(F.col(id_col).alias("doc"), texts.alias("s"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "s", SENTENCES):
            found = [similarities(embed(t), half) if t and len(t) > 1 else np.zeros(0) for t in batch.column("s").to_pylist()]
            many = [len(f) for f in found]
            pos = np.concatenate([np.arange(m, dtype=np.int32) for m in many])
            yield pa.RecordBatch.from_arrays([batch.column("doc").take(pa.array(np.repeat(np.arange(len(many)), many))), pa.array(pos), pa.array(np.concatenate(found))], names=["doc", "pos", "sim"])

    return rows.mapInArrow(run, f"doc {rows.schema['doc'].dataType.simpleString()}, pos int, sim double")


def breaks(sims: np.ndarray, percentile: float) -> np.ndarray:
    """Which similarities lie under their percentile, as ``segment.breakpoints`` has it."""
    if not len(sims):
        return np.zeros(0, bool)
    at, held = (len(sims) - 1) * (percentile / 100), np.sort(sims)
    lo, hi = int(np.floor(at)), int(np.ceil(at))
    limit = held[lo] if lo == hi or held[lo] == held[hi] else (hi - at) * held[lo] + (at - lo) * held[hi]
    return sims < limit


def sentence_chunks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sizes: Sizes = Sizes(), embed: Embedder = hashed_embedder) -> DataFrame:
    """(doc, chunk, text, n, is_code, code_language): the sentences of each text joined up to each breakpoint of their
    vectors, and up to where code begins or ends, before merging and halving; nothing is shuffled."""
    rows = docs.select(F.col(id_col).alias("doc"), X.code_aware_sentences(F.col(text_col)).alias("s"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "s", SENTENCES):
            at, out = [], []
            for i, sentences in enumerate(batch.column("s").to_pylist()):
                texts, code = [s["text"] for s in sentences or []], [s["is_code"] for s in sentences or []]
                cut = breaks(similarities(embed(texts), sizes.half), sizes.percentile) if len(texts) > 1 else []
                starts = [0, *[k + 1 for k in range(len(texts) - 1) if cut[k] or code[k] != code[k + 1]]] if texts else []
                for k, (a, b) in enumerate(zip(starts, [*starts[1:], len(texts)], strict=False)):
                    at.append(i)
                    out.append((k, " ".join(texts[a:b]), b - a, code[a], sentences[a]["code_language"] if code[a] else None))
            made = [pa.array([r[j] for r in out], kind) for j, kind in enumerate((pa.int32(), pa.string(), pa.int32(), pa.bool_(), pa.string()))]
            yield pa.RecordBatch.from_arrays([batch.column("doc").take(pa.array(at, pa.int64())), *made], names=["doc", "chunk", "text", "n", "is_code", "code_language"])

    return rows.mapInArrow(run, f"doc {rows.schema['doc'].dataType.simpleString()}, chunk int, text string, n int, is_code boolean, code_language string")


def split_documents(docs: DataFrame, keys: list[str], sizes: Sizes = Sizes(), embed: Embedder = hashed_embedder) -> DataFrame:
    """Semantic chunks, and recursive ones for texts that have none."""
    cut = functools.partial(S.recursive_pieces, size=DEFAULTS.chunk_size, overlap=DEFAULTS.chunk_overlap)
    return semantic_chunks(docs, keys, sizes=sizes, embed=embed, fallback=cut)


def parents(docs: DataFrame, least: int = DEFAULTS.parent_min, most: int = DEFAULTS.parent_max) -> DataFrame:
    """(source, parent_index, parent_id, text, is_code, code_language): heading sections, short ones merged, long ones
    split by paragraphs, lines and sentences with an overlap; blank ones dropped."""

    @F.pandas_udf("array<string>")
    def resplit(sections: pd.Series) -> pd.Series:
        pieces = lambda t: S.recursive_pieces(t, most, SECTION_OVERLAP, SECTION_SEPARATORS) if len(t) > most else [t]
        return sections.map(lambda s: [p for t in S.merged_pieces(list(s), least, "\n\n") for p in pieces(t) if p.strip()] if s is not None else [])

    rows = docs.select("source", F.posexplode(resplit(X.heading_sections(F.col("text")))).alias("parent_index", "text"))
    code = S.is_code_only(F.col("text"))
    language = F.regexp_extract(X.strip(F.col("text")), r"^```([^\n]*)\n", 1)
    return rows.withColumn("parent_id", F.concat(stem(), F.lit("_parent_"), F.col("parent_index"))).withColumn("is_code", code).withColumn("code_language", F.when(code & (X.strip(language) != ""), X.strip(language)))


def stem() -> Column:
    return F.regexp_replace(F.translate("source", "/", "_"), r"(?<=.)\.[^._]+$", "")


def children(parents_: DataFrame, least: int = DEFAULTS.child_min, most: int = DEFAULTS.child_max, embed: Embedder = hashed_embedder) -> DataFrame:
    """(child_id, source, parent_id, parent_index, child_index, text, is_code, code_language): semantic chunks of each
    parent, or pieces with an overlap where there are none."""
    cut = functools.partial(S.recursive_pieces, size=most, overlap=CHILD_OVERLAP, separators=SECTION_SEPARATORS)
    rows = semantic_chunks(parents_, ["source", "parent_id", "parent_index"], sizes=Sizes(least, most), embed=embed, fallback=cut)
    ident = F.concat(stem(), F.lit("_child_"), F.col("parent_index"), F.lit("_"), F.col("chunk_index"))
    return rows.select(ident.alias("child_id"), "source", "parent_id", "parent_index", F.col("chunk_index").alias("child_index"), "text", "is_code", "code_language")


def with_child_count(parents_: DataFrame, children_: DataFrame) -> DataFrame:
    """Parents with the number of their children."""
    counts = children_.groupBy("parent_id").agg(F.count("*").cast("int").alias("child_count"))
    return parents_.join(counts, "parent_id", "left").withColumn("child_count", F.coalesce("child_count", F.lit(0)))
