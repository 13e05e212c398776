"""The fallback splitter and the merging fold against plain versions that hold and count everything anew."""

import time

from conftest import SMALL
from hypothesis import given, settings
from hypothesis import strategies as st

from tarnwick.operators import segment as S
from tarnwick.plans import text_queries as TQ


def plain_pieces(text, size, overlap, separators=("\n## ", "\n### ", "\n\n", "\n", "。", "")):
    sep = next(s for s in separators if s in text)
    rest = separators[separators.index(sep) + 1 :]
    parts = list(text) if not sep else [p if i == 0 else sep + p for i, p in enumerate(text.split(sep))]
    out, held = [], []
    for part in [p for p in parts if p]:
        if len(part) > size and rest:
            out, held = [*out, "".join(held), *plain_pieces(part, size, overlap, rest)], []
        else:
            if held and len("".join(held)) + len(part) > size:
                out.append("".join(held))
                while held and (len("".join(held)) > overlap or len("".join(held)) + len(part) > size):
                    held = held[1:]
            held.append(part)
    return [p.strip() for p in [*out, "".join(held)] if p.strip()]


def plain_merge(pieces, least, joint):
    out = []
    for p in pieces:
        if out and len(out[-1]) < least:
            out[-1] += joint + p
        else:
            out.append(p)
    return out


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["x", "yz", "longer words", "。", "\n", "\n\n", "\n## ", "\n### ", " "]), max_size=120), st.integers(1, 60), st.integers(0, 70))
def test_pieces_equal_the_plain_version(marks, size, overlap):
    text = "".join(marks)
    assert S.recursive_pieces(text, size, overlap) == plain_pieces(text, size, overlap)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(max_size=12), max_size=30), st.integers(0, 30), st.sampled_from([" ", "\n\n", ""]))
def test_merging_equals_the_plain_version(pieces, least, joint):
    assert S.merged_pieces(pieces, least, joint) == plain_merge(pieces, least, joint)


def test_long_texts_take_seconds():
    began = time.time()
    text = "x" * 5_000_000
    pieces = S.recursive_pieces(text, 512, 64)
    assert sum(map(len, pieces)) - 64 * (len(pieces) - 1) == len(text)
    lines = "\n".join("word " * 3 for _ in range(300_000))
    assert len(S.recursive_pieces(lines, 512, 64)) > 9000
    assert len(S.merged_pieces(["short"] * 1_000_000, 80)) > 60_000
    assert time.time() - began < 20


def test_the_whole_query(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").collect()
    want = sorted((r["doc_id"], i, p) for r in docs for i, p in enumerate(plain_pieces(r["text"] or "", 512, 64) if r["text"] else []))
    assert sorted(map(tuple, TQ.recursive_split(spark, SMALL).collect())) == want
