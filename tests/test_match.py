"""Entity linking against loops over all pairs, with tiny shards and blocks."""

import random

import pytest

from tarnwick.operators import graph as G
from tarnwick.operators import match
from tarnwick.sources.vector_index import VectorIndex


@pytest.mark.parametrize("patterns, block", [(200_000, 32_000_000), (3, 40)])
def test_occurrences_equal_all_pairs(spark, patterns, block):
    rng = random.Random(6)
    word = lambda n: "".join(rng.choice("abé检") for _ in range(n))
    wholes = [(i, word(rng.randrange(0, 30))) for i in range(40)] + [(90, None), (91, ""), (92, "aaaa"), (93, "aaaa")]
    parts = [(f"p{i}", word(rng.randrange(1, 4))) for i in range(30)] + [("n", None), ("e", ""), ("x", "aa"), ("y", "aa"), ("long", "a" * 100)]
    got = match.occurrences(spark.createDataFrame(wholes, "whole_id long, text string"), spark.createDataFrame(parts, "part_id string, text string"), patterns, block)
    assert sorted(map(tuple, got.collect())) == sorted((w, p) for w, a in wholes for p, b in parts if a and b and b in a)


def test_long_questions(spark):
    entities = spark.createDataFrame([(f"entity number {i:05d}",) for i in range(3000)] + [("x" * k,) for k in range(2, 60)], "entity string")
    long = "nothing here " * 80_000 + "Entity  number 00007"
    got = match.substring_matches(spark.createDataFrame([(1, long)], "query_id long, query string"), entities)
    assert [r["entity"] for r in got.collect()] == ["entity number 00007"]
    parts = spark.createDataFrame([("whole", long), ("head", long[:700]), ("other", long[:700] + "!")], "part_id string, text string")
    assert sorted(r["part_id"] for r in match.occurrences(spark.createDataFrame([(1, "so " + long)], "whole_id long, text string"), parts).collect()) == ["head", "whole"]


def test_three_ways_in_order(spark, tmp_path):
    entities = spark.createDataFrame([("Grey Heron",), ("Heron Island",), ("Kestrel",), ("A",), ("kestrel",)], "entity string")
    asked = spark.createDataFrame([(1, "the grey  HERON stands"), (2, "kestrel kestrel"), (3, "a"), (4, ""), (5, None)], "query_id long, query string")
    vectors = match.entity_vectors(entities)
    index = VectorIndex(spark, str(tmp_path / "index"))
    index.fit(vectors)
    index.upsert(vectors, 0)
    plain = sorted(map(tuple, match.link_entities(asked, entities).collect()))
    assert plain == sorted(map(tuple, match.link_entities(asked, entities, index).collect()))
    ways = {(q, e): w for q, e, w in plain}
    assert ways[1, "Grey Heron"] == 0 and ways[1, "Heron Island"] == 1 and ways[2, "Kestrel"] == ways[2, "kestrel"] == 0
    assert ways[3, "A"] == 2 and not any(q in (4, 5) for q, _ in ways)


def test_walks_follow_the_order_of_the_ways(spark):
    triples = spark.createDataFrame([(i, f"a{i}", "in", "A", "s", f"c{i}") for i in range(40)] + [(50 + i, f"z{i}", "in", "Z", "s", f"d{i}") for i in range(40)], "seq long, head string, relation string, tail string, source string, chunk_id string")
    seeds = lambda *rows: spark.createDataFrame(list(rows), "query_id long, entity string, place int")
    first = lambda s: {r["tail"] for r in G.hops(triples, s)[0].collect()}
    assert first(seeds((1, "A", 1), (1, "Z", 0))) == {"Z"} and first(seeds((1, "A", 1), (1, "Z", 1))) == {"A"}
    assert first(seeds((1, "A", 0)).select("query_id", "entity")) == {"A"} and G.hops(triples, seeds((1, "none", 0)))[1].count() == 0
