"""Queries on vectors, keywords, fusion, joins, graphs and whole retrievals, with their SQL."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from ..config import DEFAULTS
from ..functions import text as X
from ..functions import vectors as V
from ..operators import graph as G
from ..operators import retrieval as R
from ..operators.evaluate import EXPERIMENTS, ablate, effective, evaluate
from ..operators.match import entity_vectors, link_entities, substring_matches, token_matches
from ..sources.keyword_index import KeywordIndex
from ..sources.vector_index import VectorIndex
from ..sources.versions import shared_folder
from . import retrieve as P
from . import tables as T

Q: dict = {}
SQL: dict = {}


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query(f"WITH {T.VECTORS} SELECT id, dim::INT AS dim, round(w, 6) AS w FROM dvec")
def embed_hash(spark, d):
    return R.hashed_terms(T.texts(spark, d), "doc_id").select("id", "dim", F.round("w", 6).alias("w"))


@query("WITH v AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS dim FROM embeddings) SELECT vec_id, dim::INT AS dim, round(x / sqrt(sum(x * x) OVER (PARTITION BY vec_id)), 6) AS x FROM v")
def l2_normalize(spark, d):
    return T.load(spark, d, "embeddings").select("vec_id", F.posexplode(V.unit(F.col("embedding"))).alias("dim", "x")).withColumn("x", F.round("x", 6))


@query("SELECT a.vec_id, round(list_inner_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS product FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def vector_dot(spark, d):
    e = T.load(spark, d, "embeddings")
    after = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return e.join(after, "vec_id").select("vec_id", F.round(V.dot(F.col("embedding"), F.col("other")), 6).alias("product"))


_ASK = "v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings), asked AS (SELECT * FROM v WHERE vec_id % 50 = 0)"


def _asked(spark, d):
    """The stated query set: every vector whose id is divisible by 50."""
    e = T.load(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "label", F.col("embedding").cast("array<double>").alias("vec"))
    return e, e.where("id % 50 = 0").select(F.col("id").alias("query_id"), "vec")


@query(f"""WITH {_ASK}, s AS (SELECT q.vec_id AS query_id, v.vec_id AS id, round(2 * list_inner_product(q.e, v.e) - 1, 6) AS score FROM asked q, v)
    SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id)::INT AS rank FROM s QUALIFY rank <= 10""")
def vector_topk(spark, d):
    e, asked = _asked(spark, d)
    return R.vector_topk(e, asked)


@query(f"""WITH {_ASK}, s AS (SELECT q.vec_id AS query_id, v.vec_id AS id, round(2 * list_inner_product(q.e, v.e) - 1, 6) AS score FROM asked q, v)
    SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id)::INT AS rank FROM s QUALIFY rank <= 10""")
def stored_vector_topk(spark, d):
    """From a stored index in its exact mode, built in two batches: every seventh vector is stored turned around first."""
    e, asked = _asked(spark, d)
    index = VectorIndex(spark, shared_folder(spark, "vector-index"))
    index.fit(e)
    index.upsert(e.withColumn("vec", F.when(F.col("id") % 7 == 0, F.transform("vec", lambda x: -x)).otherwise(F.col("vec"))), 0)
    index.upsert(e.where("id % 7 = 0"), 1)
    return index.topk(asked, exact=True)


@query(f"""WITH {_ASK}, s AS (SELECT q.vec_id AS query_id, v.vec_id AS id, round(2 * list_inner_product(q.e, v.e) - 1, 6) AS score FROM asked q, v),
    t AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id)::INT AS rank FROM s QUALIFY rank <= 5)
    SELECT query_id, id, round((score + 1) / 2, 6) AS similarity FROM t WHERE (score + 1) / 2 >= 0.35""")
def entity_vector_topk(spark, d):
    e, asked = _asked(spark, d)
    sim = (F.col("score") + 1) / 2
    return R.vector_topk(e, asked, DEFAULTS.kg_top_k).where(sim >= DEFAULTS.kg_min_similarity).select("query_id", "id", F.round(sim, 6).alias("similarity"))


def _routes(spark, d, how):
    from ..operators.route import route

    e, asked = _asked(spark, d)
    return route(asked, e.select(F.col("label").cast("string").alias("intent"), "vec"), how)


_ROUTE = """WITH {ask}, s AS (SELECT q.vec_id AS query_id, v.label::VARCHAR AS intent, round(list_inner_product(q.e, v.e), 6) AS s FROM asked q, v WHERE v.label IS NOT NULL),
    a AS (SELECT query_id, intent, round({agg}, 7) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id, intent ORDER BY s DESC) AS r FROM s) GROUP BY 1, 2),
    b AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, intent) AS r, lead(score) OVER (PARTITION BY query_id ORDER BY score DESC, intent) AS second FROM a)
    SELECT query_id, intent AS best, score, round(score - coalesce(second, 0), 7) AS margin, CASE WHEN score < 0.45 OR score - coalesce(second, 0) < 0.1 THEN 'fallback' ELSE 'routed' END AS decision FROM b WHERE r = 1"""


@query(_ROUTE.format(ask=_ASK, agg="max(s)"))
def intent_route_max(spark, d):
    return _routes(spark, d, "max")


@query(_ROUTE.format(ask=_ASK, agg="avg(s) FILTER (WHERE r <= 2)"))
def intent_route_top2(spark, d):
    return _routes(spark, d, "top2")


def _products(spark, d):
    e, asked = _asked(spark, d)
    return R.vector_topk(e, asked, 10).withColumn("s", (F.col("score") + 1) / 2)


_TOP = f"""WITH {_ASK}, s AS (SELECT q.vec_id AS query_id, v.vec_id AS id, round(2 * list_inner_product(q.e, v.e) - 1, 6) AS score FROM asked q, v),
    t AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) <= 10)"""


@query(_TOP + " SELECT query_id, round(avg((score + 1) / 2), 6) AS relevance FROM t GROUP BY 1")
def emb_relevance(spark, d):
    return _products(spark, d).groupBy("query_id").agg(F.round(F.avg("s"), 6).alias("relevance"))


@query(_TOP + " SELECT query_id, round(max((score + 1) / 2), 6) AS faithfulness FROM t GROUP BY 1")
def emb_faithfulness(spark, d):
    return _products(spark, d).groupBy("query_id").agg(F.round(F.max("s"), 6).alias("faithfulness"))


_STATS = f"WITH {T.BM25} SELECT df, round(idf, 6) AS idf, count(*) AS terms, sum(('0x' || substr(md5(t), 1, 8))::BIGINT)::BIGINT AS terms_sum FROM idf GROUP BY 1, 2"


def _stats(rows):
    """A row for each document count: its idf, how many terms have it, and the sum of these terms' hashes."""
    return rows.groupBy("df", F.round("idf", 6).alias("idf")).agg(F.count("*").alias("terms"), F.sum(F.conv(F.substring(F.md5("t"), 1, 8), 16, 10).cast("long")).alias("terms_sum"))


@query(f"WITH {T.BM25} SELECT t, df, round(idf, 6) AS idf FROM idf")
def bm25_stats(spark, d):
    return R.bm25_stats(T.texts(spark, d))[0].select("t", "df", F.round("idf", 6).alias("idf"))


@query(f"WITH {T.BM25} SELECT query_id, id, score FROM bscore")
def bm25_score(spark, d):
    return R.bm25(T.texts(spark, d), T.questions(spark, d))


@query(f"WITH {T.BM25} SELECT query_id, id, score, rank::INT AS rank FROM btop")
def bm25_topk(spark, d):
    return P.keyword_channel(spark, d)


def _index(spark, d):
    """A stored keyword index of ``documents`` in two batches: all of them, every seventh with an older text and some
    that are long gone; then the changed ones."""
    index = KeywordIndex(spark, shared_folder(spark, "keyword-index"))
    docs = T.texts(spark, d).select("doc_id", "text")
    older = docs.where("doc_id % 11 <> 0").withColumn("text", F.when(F.col("doc_id") % 7 == 0, F.reverse("text")).otherwise(F.col("text")))
    former = docs.where("doc_id % 5 = 0").select((-1 - F.col("doc_id")).alias("doc_id"), F.concat(F.lit("gone "), "text").alias("text"))
    index.upsert(older.unionByName(former), 0)
    index.upsert(docs.where("doc_id % 7 = 0 or doc_id % 11 = 0"), 1)
    index.remove(former, 2)
    return index


@query(f"WITH {T.BM25} SELECT query_id, id, score, rank::INT AS rank FROM btop")
def stored_bm25_topk(spark, d):
    return _index(spark, d).topk(T.questions(spark, d))


@query(_STATS)
def stored_bm25_stats(spark, d):
    return _stats(_index(spark, d).statistics())


_CHANNELS = f"{T.VECTORS}, {T.BM25}, ch AS (SELECT 'vector' AS channel, query_id, id, rank, score FROM vtop UNION ALL SELECT 'bm25', query_id, id, rank, score FROM btop)"


def _both(spark, d):
    """The vector and the keyword channel, from one reading of the texts."""
    table = P.words(spark, d)
    return P.vector_channel(spark, d, table=table), P.keyword_channel(spark, d, table=table)


def _channels(spark, d):
    vector, keyword = _both(spark, d)
    return R.named(vector, "vector").unionByName(R.named(keyword, "bm25"))


def _rrf_sql(weight: str) -> str:
    return f"SELECT query_id, id, round(sum({weight} / (60 + rank)), 9) AS score, string_agg(DISTINCT channel, ',' ORDER BY channel) AS channels, round(max(score), 6) AS best_raw FROM ch GROUP BY 1, 2"


_W = "CASE channel WHEN 'vector' THEN 0.45::DOUBLE WHEN 'bm25' THEN 0.35::DOUBLE ELSE 1::DOUBLE END"


@query(f"WITH {_CHANNELS} {_rrf_sql('1::DOUBLE')}")
def rrf_plain(spark, d):
    return R.rrf(_channels(spark, d), {})


@query(f"WITH {_CHANNELS} {_rrf_sql(_W)}")
def rrf_weighted(spark, d):
    return R.rrf(_channels(spark, d), {"vector": DEFAULTS.weight_vector, "bm25": DEFAULTS.weight_bm25})


@query(f"WITH {T.VECTORS} SELECT query_id, id, score, rank::INT AS rank FROM vtop")
def retrieve_vector(spark, d):
    return P.vector_channel(spark, d)


@query(f"WITH {T.BM25} SELECT query_id, id, score, rank::INT AS rank FROM btop")
def retrieve_bm25(spark, d):
    return P.keyword_channel(spark, d)


_HYBRID = f"{_CHANNELS}, fused AS ({_rrf_sql(_W)}), hy AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM fused QUALIFY rank <= 10)"


@query(f"WITH {_HYBRID} SELECT query_id, id, score, channels, best_raw, rank::INT AS rank FROM hy")
def retrieve_hybrid(spark, d):
    return P.hybrid(spark, d)


_HOPS = f"""{T.TRIPLES}, {T.LINKED}, seeds AS (SELECT query_id, entity, way AS place FROM linked),
    w0 AS (SELECT query_id, 0 AS hop, place AS spot, entity, 0 AS way, t.* FROM seeds JOIN triples t ON head = entity UNION ALL SELECT query_id, 0, place, entity, 1, t.* FROM seeds JOIN triples t ON tail = entity),
    front AS (SELECT DISTINCT query_id, CASE way WHEN 0 THEN tail ELSE head END AS entity FROM w0),
    f1 AS (SELECT * FROM front f WHERE NOT EXISTS (SELECT 1 FROM seeds s WHERE s.query_id = f.query_id AND s.entity = f.entity)),
    w AS (SELECT * FROM w0 UNION ALL SELECT query_id, 1, 0, entity, 0, t.* FROM f1 JOIN triples t ON head = entity UNION ALL SELECT query_id, 1, 0, entity, 1, t.* FROM f1 JOIN triples t ON tail = entity),
    o AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY hop, spot, entity, way, seq) AS place FROM w),
    once AS (SELECT * FROM o QUALIFY row_number() OVER (PARTITION BY query_id, head, relation, tail ORDER BY place) = 1),
    kept AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY place) AS n FROM once QUALIFY n <= 30),
    fin AS (SELECT query_id, max(n) AS n, max(place) AS place FROM kept GROUP BY 1),
    votes AS (SELECT o.query_id, chunk_id, count(*) AS votes FROM o JOIN fin ON o.query_id = fin.query_id AND (fin.n < 30 OR o.place <= fin.place) GROUP BY 1, 2),
    kg AS (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY votes DESC, chunk_id) AS rank FROM votes QUALIFY rank <= 5),
    kgc AS (SELECT query_id, regexp_extract(chunk_id, '(\\d+)$', 1)::BIGINT AS id, rank, round(0.4 + greatest(5 - (rank - 1), 0) / 5 * 0.1, 6) AS score FROM kg)"""


def _walk(spark, d):
    return P.walk(spark, d, T.triples(spark, d))


@query(f"WITH {_HOPS} SELECT query_id, hop::INT AS hop, head, relation, tail, chunk_id, n::INT AS n FROM kept")
def khop_subgraph(spark, d):
    return _walk(spark, d)[0]


@query(f"WITH {_HOPS} SELECT query_id, chunk_id, votes FROM votes")
def kg_chunk_votes(spark, d):
    return _walk(spark, d)[1]


@query(f"WITH {_HOPS} SELECT query_id, id, rank::INT AS rank, score FROM kgc")
def kg_candidates(spark, d):
    return P.graph_channel(spark, d)


_TWO = """base AS (SELECT 'base' AS channel, query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank, score FROM {base}),
    ch2 AS (SELECT * FROM base UNION ALL SELECT 'kg', query_id, id, rank, score FROM kgc),
    fused2 AS (SELECT query_id, id, round(sum(CASE channel WHEN 'kg' THEN 0.2::DOUBLE ELSE 1::DOUBLE END / (60 + rank)), 9) AS score, string_agg(DISTINCT channel, ',' ORDER BY channel) AS channels, round(max(score), 6) AS best_raw FROM ch2 GROUP BY 1, 2)"""


@query(f"WITH {_HYBRID}, {_HOPS}, {_TWO.format(base='fused')} SELECT * FROM fused2")
def two_stage_fusion(spark, d):
    return R.two_stage(*_both(spark, d), P.graph_channel(spark, d))


@query(f"WITH {_HYBRID}, {_HOPS}, {_TWO.format(base='fused')} SELECT query_id, round(count(*) FILTER (WHERE contains(channels, 'kg')) / greatest(count(*), 1), 6) AS hit_rate FROM fused2 GROUP BY 1")
def kg_hit_rate(spark, d):
    return two_stage_fusion(spark, d).groupBy("query_id").agg(F.round(F.count_if(F.col("channels").contains("kg")) / F.greatest(F.count("*"), F.lit(1)), 6).alias("hit_rate"))


@query("WITH h AS (SELECT user_id AS query_id, event_type AS id, event_id AS pos FROM events) SELECT query_id, id, min(pos) AS pos FROM h GROUP BY 1, 2")
def dedupe_first(spark, d):
    h = T.load(spark, d, "events").select(F.col("user_id").alias("query_id"), F.col("event_type").alias("id"), F.col("event_id").alias("pos"))
    return h.groupBy("query_id", "id").agg(F.min("pos").alias("pos"))


@query(f"WITH {T.VECTORS}, {T.BM25} SELECT query_id, id, 'first' AS part, rank::INT AS pos FROM vtop UNION ALL SELECT query_id, id, 'then', (100 + rank)::INT FROM btop")
def context_concat(spark, d):
    a, b = _both(spark, d)
    return a.select("query_id", "id", F.lit("first").alias("part"), F.col("rank").alias("pos")).unionByName(b.select("query_id", "id", F.lit("then").alias("part"), (F.lit(100) + F.col("rank")).alias("pos")))


_HITS = f"{_HYBRID}, {T.NOTES}, hits AS (SELECT query_id, source || '#p' AS parent_id, score, channels FROM hy JOIN notes USING (id))"


@query(f"WITH {_HITS} SELECT query_id, parent_id, max(score) AS score, count(*) AS child_hit_count, array_to_string(list_sort(list_distinct(flatten(list(string_split(channels, ','))))), ',') || ',parent_child' AS channels, row_number() OVER (PARTITION BY query_id ORDER BY max(score) DESC, parent_id)::INT AS rank FROM hits GROUP BY 1, 2 QUALIFY rank <= 5")
def parent_rollup(spark, d):
    hits = P.hybrid(spark, d).join(T.notes(spark, d), "id").select("query_id", F.concat("source", F.lit("#p")).alias("parent_id"), "score", "channels")
    return R.rollup_parents(hits)


_NEAR = """offs(ord, off) AS (VALUES (0, -1), (1, 1)),
    cand AS (SELECT s.query_id, s.source, s.chunk_index + off AS chunk_index, min(s.rank * 10 + ord) AS spot FROM sd s, offs WHERE s.chunk_index + off >= 0
        AND NOT EXISTS (SELECT 1 FROM sd x WHERE x.query_id = s.query_id AND x.source = s.source AND x.chunk_index = s.chunk_index + off) GROUP BY ALL),
    lim AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY spot) AS n FROM cand QUALIFY n <= 2),
    nb AS (SELECT query_id, id, source, chunk_index, round(0.1::DOUBLE / row_number() OVER (PARTITION BY query_id ORDER BY n), 6) AS score FROM lim JOIN notes USING (source, chunk_index))"""


@query(f"WITH {_HYBRID}, {T.NOTES}, sd AS (SELECT query_id, rank, source, chunk_index FROM hy JOIN notes USING (id) WHERE rank <= 3), {_NEAR} SELECT query_id, id, source, chunk_index::INT AS chunk_index, score FROM nb")
def neighbor_expand(spark, d):
    notes = T.notes(spark, d)
    return R.neighbors(P.hybrid(spark, d).where("rank <= 3").join(notes, "id").select("query_id", "rank", "source", "chunk_index"), notes)


@query(f"""WITH {T.VECTORS}, {T.NOTES}, r AS (SELECT query_id, rank AS pos, id, CASE WHEN id % 7 = 0 THEN NULL ELSE source END AS source, chunk_index FROM vtop JOIN notes USING (id)),
    f AS (SELECT *, min(pos) OVER (PARTITION BY query_id, source) AS first FROM r)
    SELECT query_id, pos::INT AS pos, id, source, chunk_index, row_number() OVER (PARTITION BY query_id ORDER BY source IS NULL, CASE WHEN source IS NOT NULL THEN first END, CASE WHEN source IS NOT NULL THEN chunk_index END, pos)::INT AS ctx_pos FROM f""")
def context_order(spark, d):
    rows = P.vector_channel(spark, d).join(T.notes(spark, d), "id").select("query_id", F.col("rank").alias("pos"), "id", F.when(F.col("id") % 7 != 0, F.col("source")).alias("source"), "chunk_index")
    return R.order_contexts(rows)


_RER = f"""q AS (SELECT item_id AS query_id, list_distinct({T.tok('text')}) AS asked FROM benchmark),
    rr AS (SELECT b.query_id, b.id, n.source, n.chunk_index, round(8 * (len(list_filter(q.asked, lambda x: list_contains({T.tok('n.text')}, x))) / greatest(len(q.asked), 1)) - 4, 6) AS logit
        FROM {{base}} b JOIN notes n USING (id) JOIN q USING (query_id) WHERE b.rank <= 3),
    rs AS (SELECT query_id, id, source, chunk_index, logit, round(1 / (1 + exp(-logit)), 6) AS score FROM rr),
    seedr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM rs)"""


@query(f"WITH {_HYBRID}, {T.NOTES}, {_RER.replace('{base}', 'hy')} SELECT query_id, id, logit, score, rank::INT AS rank FROM seedr")
def rerank_seeds(spark, d):
    rows = P.hybrid(spark, d).join(T.notes(spark, d), "id").join(T.questions(spark, d), "query_id")
    return R.rerank(rows).select("query_id", "id", "logit", "score", "rank")


@query(f"WITH {T.VECTORS}, {T.BM25} SELECT query_id, id FROM (SELECT query_id, id FROM vtop UNION SELECT query_id, id FROM btop)")
def rerank_pairs_dedupe(spark, d):
    vector, keyword = _both(spark, d)
    return vector.select("query_id", "id").unionByName(keyword.select("query_id", "id")).distinct()


_FULL = f"""{_HYBRID}, {_HOPS}, {T.NOTES}, {_TWO.format(base='hy')},
    fr AS (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM fused2)"""


@query(f"""WITH {_FULL}, {_RER.replace('{base}', 'fr')}, sd AS (SELECT query_id, rank, source, chunk_index FROM seedr), {_NEAR},
    al AS (SELECT query_id, id, source, chunk_index, score, 'seed' AS kind, rank AS pos FROM seedr UNION ALL SELECT query_id, id, source, chunk_index, score, 'neighbor', 1000 + row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) FROM nb),
    fi AS (SELECT *, min(pos) OVER (PARTITION BY query_id, source) AS first FROM al)
    SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY first, chunk_index, pos)::INT AS ctx_pos, id::VARCHAR AS id, source, chunk_index::INT AS chunk_index, kind, score FROM fi""")
def retrieve_full(spark, d):
    return P.retrieve(spark, d)


_PARENTS = f"""ru AS (SELECT query_id, parent_id, row_number() OVER (PARTITION BY query_id ORDER BY max(score) DESC, parent_id) AS r FROM hits GROUP BY 1, 2 QUALIFY r <= 5),
    pq AS (SELECT item_id AS query_id, list_distinct({T.tok('text')}) AS asked FROM benchmark),
    pw AS (SELECT source || '#p' AS parent_id, list_distinct(flatten(list({T.tok('text')}))) AS words FROM notes WHERE source || '#p' IN (SELECT parent_id FROM ru) GROUP BY 1),
    ps AS (SELECT query_id, parent_id, round(1 / (1 + exp(-round(8 * (len(list_filter(asked, lambda x: list_contains(words, x))) / greatest(len(asked), 1)) - 4, 6))), 6) AS score FROM ru JOIN pq USING (query_id) JOIN pw USING (parent_id)),
    pr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, parent_id) AS rank FROM ps)"""


@query(f"""WITH {_FULL}, hits AS (SELECT query_id, source || '#p' AS parent_id, score FROM fr JOIN notes USING (id) WHERE rank <= 10),
    {_PARENTS}
    SELECT query_id, rank::INT AS ctx_pos, parent_id AS id, replace(parent_id, '#p', '') AS source, 0 AS chunk_index, 'parent' AS kind, score FROM pr WHERE rank <= 3""")
def retrieve_parent_child(spark, d):
    return P.retrieve(spark, d, use_parents=True)


def _plan_sql(i: int, mode: str, rerank: bool, kg: bool, parents: bool) -> str:
    """One retrieval plan over ``cases`` as CTEs; ``ev{i}`` has each case's contexts and coverage."""
    own = lambda sql: re.sub(r"\b(sd|cand|lim|nb|offs|rr|rs|seedr|ru|pq|pw|ps|pr|hits)\b", rf"\1_{i}", sql)
    base = {"vector": "vtop", "bm25": "btop", "hybrid": "hy"}[mode]
    out = [f"bs_{i} AS (SELECT query_id, id, rank, score FROM {base})"]
    if kg:
        out = [
            f"kf_{i} AS (SELECT query_id, id, round(sum(CASE channel WHEN 'kg' THEN 0.2::DOUBLE ELSE 1::DOUBLE END / (60 + rank)), 9) AS score FROM (SELECT 'base' AS channel, query_id, id, rank FROM {base} UNION ALL SELECT 'kg', query_id, id, rank FROM kgc) GROUP BY 1, 2)",
            f"bs_{i} AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM kf_{i})",
        ]
    if parents:
        out.append(own(f"hits AS (SELECT query_id, source || '#p' AS parent_id, score FROM bs_{i} JOIN notes USING (id) WHERE rank <= 10), {_PARENTS}"))
        out.append(own(f"cx_{i} AS (SELECT query_id, replace(parent_id, '#p', '') AS source FROM {'pr WHERE rank' if rerank else 'ru WHERE r'} <= 3), tx_{i} AS (SELECT query_id, text FROM cx_{i} JOIN notes USING (source))"))
    else:
        if rerank:
            out.append(re.sub(r"\bq\b", f"q_{i}", own(_RER.replace("{base}", f"bs_{i}"))) + own(", sd AS (SELECT query_id, id, rank, source, chunk_index FROM seedr)"))
        else:
            out.append(own(f"sd AS (SELECT query_id, id, rank, source, chunk_index FROM bs_{i} JOIN notes USING (id) WHERE rank <= 3)"))
        out.append(own(f"{_NEAR}, cx_{i} AS (SELECT query_id, id FROM sd UNION ALL SELECT query_id, id FROM nb), tx_{i} AS (SELECT query_id, text FROM cx_{i} JOIN notes USING (id))"))
    out.append(f"""hit_{i} AS (SELECT query_id, count(DISTINCT w) AS found FROM (SELECT t.query_id, t.text, unnest(kw) AS w FROM (SELECT * FROM tx_{i} UNION ALL SELECT item_id, text FROM cases) t JOIN gold USING (query_id)) WHERE contains(lower(text), w) GROUP BY 1),
    ev_{i} AS (SELECT query_id, coalesce(n, 0) AS contexts, CASE WHEN len(kw) > 0 THEN round(coalesce(found, 0) / len(kw), 6) ELSE 0 END AS coverage
        FROM gold LEFT JOIN (SELECT query_id, count(*) AS n FROM cx_{i} GROUP BY 1) USING (query_id) LEFT JOIN hit_{i} USING (query_id))""")
    return ", ".join(out)


def _evaluation_sql(plans: list[tuple]) -> str:
    """WITH clause of some plans, all over the first halves of the benchmark texts."""
    words = f"list_filter({T.tok('rest')}, lambda t: length(t) >= 6)"
    cases = f"""cases AS (SELECT item_id, substr(text, 1, length(text) // 2) AS text, substr(text, length(text) // 2 + 1) AS rest FROM benchmark),
    said AS (SELECT item_id AS query_id, {words} AS a FROM cases),
    gold AS (SELECT query_id, list_transform(list_sort(list_transform(list_distinct(a), lambda x: list_position(a, x))), lambda i: a[i])[1:5] AS kw FROM said)"""
    body = f"{_HYBRID}, {_HOPS}, {T.NOTES}, " + ", ".join(_plan_sql(i, *p) for i, p in enumerate(plans))
    return f"WITH {cases}, {body.replace('FROM benchmark', 'FROM cases')}"


_PLANS = list(dict.fromkeys(effective(e) for e in EXPERIMENTS))
_FIRST = ("hybrid", True, True, False)


@query(_evaluation_sql(_PLANS) + " ".join(
    f"{'UNION ALL' if i else ''} SELECT {i}::INT AS ordinal, '{e[0]}' AS experiment, count(*) AS num_cases, round(coalesce(avg(contexts), 0), 4) AS avg_contexts, coalesce((sum(round(coverage * 1000000)::BIGINT) + 50 * count(*))::BIGINT // (100 * count(*)) / 10000.0::DOUBLE, 0) AS avg_coverage, CAST(NULL AS VARCHAR) AS error FROM ev_{_PLANS.index(effective(e))}"
    for i, e in enumerate(EXPERIMENTS)
))
def ablation(spark, d):
    return ablate(spark, d, EXPERIMENTS)


@query(_evaluation_sql([_FIRST]) + " SELECT query_id, contexts, coverage FROM ev_0")
def eval_run(spark, d):
    return evaluate(spark, d)


@query(f"""WITH e AS (SELECT DISTINCT unnest({T.tok('text')}) AS entity FROM documents UNION SELECT n_name FROM nation)
    SELECT item_id AS query_id, entity FROM benchmark JOIN e ON (contains(lower(text), lower(entity)) OR contains(lower(entity), lower(text))) AND length(entity) > 1""")
def entity_substring_join(spark, d):
    words = T.load(spark, d, "documents").select(F.explode(X.tokens(F.col("text"))).alias("entity"))
    return substring_matches(T.questions(spark, d), words.unionByName(T.load(spark, d, "nation").select(F.col("n_name").alias("entity"))).distinct())


_ETOK = f"e AS (SELECT DISTINCT source AS entity, unnest({T.tok('source')}) AS t FROM documents), qt AS (SELECT DISTINCT item_id AS query_id, unnest({T.tok('text || chr(32) || chr(115) || chr(114) || chr(99) || (item_id % 20)')}) AS t FROM benchmark)"


@query(f"WITH {_ETOK} SELECT DISTINCT query_id, entity FROM e JOIN qt USING (t) WHERE length(t) > 1")
def entity_token_join(spark, d):
    q = T.questions(spark, d).select("query_id", F.concat("query", F.lit(" src"), (F.col("query_id") % 20).cast("string")).alias("query"))
    return token_matches(q, T.load(spark, d, "documents").select(F.col("source").alias("entity")).distinct())


@query(f"WITH {T.TRIPLES}, {T.LINKED} SELECT query_id, entity, way::INT AS way FROM linked")
def match_entities(spark, d):
    """All three ways, the last one through a stored index of the graph's entities."""
    names = T.entities(T.triples(spark, d))
    index = VectorIndex(spark, shared_folder(spark, "entity-index"))
    vectors = entity_vectors(names)
    index.fit(vectors)
    index.upsert(vectors, 0)
    return link_entities(T.mentions(spark, d), names, index)


@query(f"WITH {T.TRIPLES} SELECT seq, head, relation, tail, source, chunk_id FROM triples WHERE head <> '' AND tail <> ''")
def graph_build(spark, d):
    return G.edges(T.triples(spark, d))


@query(f"WITH {T.TRIPLES} SELECT head AS entity FROM triples UNION SELECT tail FROM triples")
def graph_vertices(spark, d):
    return G.vertices(T.triples(spark, d))


@query(f"WITH {T.TRIPLES} SELECT entity, count(*) AS degree FROM (SELECT head AS entity FROM triples UNION ALL SELECT tail FROM triples) GROUP BY 1")
def degree_centrality(spark, d):
    return G.degrees(T.triples(spark, d))


_CENTRAL = f"""{T.TRIPLES}, deg AS (SELECT entity, count(*) AS degree FROM (SELECT head AS entity FROM triples UNION ALL SELECT tail FROM triples) GROUP BY 1),
    top AS (SELECT entity, row_number() OVER (ORDER BY degree DESC, entity) AS place FROM deg QUALIFY place <= 5),
    w AS (SELECT place, 0 AS way, t.* FROM top JOIN triples t ON head = entity UNION ALL SELECT place, 1, t.* FROM top JOIN triples t ON tail = entity),
    once AS (SELECT * FROM w QUALIFY row_number() OVER (PARTITION BY head, relation, tail ORDER BY place, way, seq) = 1),
    cen AS (SELECT row_number() OVER (ORDER BY place, way, seq)::INT AS n, head, relation, tail, chunk_id FROM once QUALIFY n <= 50)"""


@query(f"WITH {_CENTRAL} SELECT * FROM cen")
def central_subgraph(spark, d):
    return G.central(T.triples(spark, d))


@query(f"WITH {_CENTRAL} SELECT string_agg('(' || head || ') -[' || relation || ']-> (' || tail || ')', chr(10) ORDER BY n) AS text FROM cen")
def subgraph_text(spark, d):
    return G.as_lines(G.central(T.triples(spark, d)))


@query(f"""WITH {_CENTRAL}, v AS (SELECT chunk_id, count(*) AS votes FROM cen GROUP BY 1), best AS (SELECT chunk_id FROM v ORDER BY votes DESC, chunk_id LIMIT 3)
    SELECT 'global_kg_macro' AS id, '以下是整个知识库的宏观核心知识结构（核心实体关系）：' || chr(10) || (SELECT string_agg('(' || head || ') -[' || relation || ']-> (' || tail || ')', chr(10) ORDER BY n) FROM cen) AS text, 'Knowledge Graph Macro' AS source, 'kg_centrality' AS score_type, 1.0::DOUBLE AS score
    UNION ALL SELECT chunk_id, d.text, d.source, NULL, 0.9::DOUBLE FROM best JOIN documents d ON d.doc_id = regexp_extract(chunk_id, '(\\d+)$', 1)::BIGINT""")
def global_retrieve(spark, d):
    return P.global_contexts(spark, T.triples(spark, d), T.chunk_texts(spark, d))


_DOUBLE = f"{T.TRIPLES}, twice AS (SELECT 0 AS origin, * FROM triples UNION ALL SELECT 1, seq, upper(head) || ' ', relation, tail, source, chunk_id FROM triples WHERE seq % 2 = 0)"


def _twice(spark, d):
    t = T.triples(spark, d)
    return t.withColumn("origin", F.lit(0)).unionByName(t.where("seq % 2 = 0").withColumn("head", F.concat(F.upper("head"), F.lit(" "))).withColumn("origin", F.lit(1)))


@query(f"WITH {_DOUBLE} SELECT origin, seq, head, relation, tail, source, chunk_id FROM twice QUALIFY row_number() OVER (PARTITION BY lower(trim(head)), lower(relation), lower(tail), source, chunk_id ORDER BY origin, seq) = 1")
def triple_dedupe(spark, d):
    return G.dedupe_triples(_twice(spark, d), ("head", "relation", "tail", "source", "chunk_id"), ("origin", "seq"))


@query("SELECT c_custkey AS seq, trim(c_name) AS head, 'in segment' AS relation, trim(c_mktsegment) AS tail FROM customer WHERE c_custkey % 5 <> 0")
def triple_normalize(spark, d):
    c, k = T.load(spark, d, "customer"), F.col("c_custkey")
    pick = lambda cond, v: F.when(cond, v)
    items = c.select(k.alias("seq"), pick(k % 3 == 0, F.col("c_name")).alias("head"), pick(k % 3 == 1, F.concat(F.lit(" "), F.col("c_name"))).alias("h"), pick(k % 3 == 2, F.col("c_name")).alias("entity1"), pick(k % 2 == 0, F.lit("in segment")).alias("relation"), pick(k % 2 == 1, F.lit("in segment ")).alias("rel"), F.lit("").alias("predicate"), pick(k % 5 != 0, F.col("c_mktsegment")).alias("tail"), F.lit(None).cast("string").alias("t"), F.lit("").alias("entity2"))
    return G.normalize_triples(items).select("seq", "head", "relation", "tail")


@query(f"WITH {_DOUBLE}, p AS (SELECT origin * 10000000000000 + seq AS seq, trim(head) AS head, relation, tail, chunk_id FROM twice), u AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY chunk_id, lower(head), lower(relation), lower(tail) ORDER BY seq) = 1) SELECT seq, head, relation, tail, chunk_id FROM u QUALIFY row_number() OVER (PARTITION BY chunk_id ORDER BY seq) <= 8")
def triple_postprocess(spark, d):
    rows = _twice(spark, d).withColumn("seq", F.col("origin") * F.lit(10000000000000) + F.col("seq"))
    return G.postprocess_triples(rows).select("seq", "head", "relation", "tail", "chunk_id")

