"""Whole requests with stub models, with their SQL."""

from __future__ import annotations

import json
import re

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import retrieval as R
from . import request as RQ
from . import search_queries as S
from . import tables as T
from .text_queries import _ALIASES, _CLASS, _CODE

Q: dict = {}
SQL: dict = {}


def query(sql: str):
    def add(f):
        Q[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return add


def rewriter(prompts: list[str]) -> list[str]:
    return ["so " + p.rsplit("\n", 1)[-1] for p in prompts]


def aligner(prompts: list[str]) -> list[str]:
    return [json.dumps({"should_expand": True, "confidence": 0.3 if len(p) % 2 else 0.9, "expansions": ["retrieval", "searching"]}) for p in prompts]


def _short(spark, d):
    """(query_id, query): the first eight words of each benchmark text; every second one asks about a term."""
    words = F.array_join(F.slice(X.tokens(F.col("query")), 1, 8), " ")
    return T.questions(spark, d).select("query_id", F.when(F.col("query_id") % 2 == 0, F.concat(words, F.lit(" 检索"))).otherwise(words).alias("query"))


def _request(spark, d):
    """Understood questions and their contexts.  Conversations are the history of the questions with their ids; a third of
    the questions are prototypes of the global route, a third of the local one."""
    short = _short(spark, d)
    vectors = R.dense(R.hashed_terms(short.where("query_id % 3 < 2"), "query_id", "query"))
    prototypes = vectors.select(F.when(F.col("id") % 3 == 0, "global").otherwise("local").alias("intent"), "vec")
    asked = RQ.understood(short, T.load(spark, d, "conversations"), RQ.Plugins(rewriter, aligner, prototypes, 0))
    return asked, RQ.contexts(spark, d, asked)


#: What the stubs make of the questions: rewritten, aligned, routed.
_ASKED = f"""
    a(i, j, canonical, alias) AS (VALUES {_ALIASES}),
    short AS (SELECT item_id AS query_id, array_to_string({T.tok('text')}[1:8], ' ') || CASE WHEN item_id % 2 = 0 THEN ' 检索' ELSE '' END AS query FROM benchmark),
    told AS (SELECT conv_id FROM conversations WHERE role IN ('user', 'assistant') GROUP BY 1 HAVING count(*) >= 2),
    again AS (SELECT query_id, query, CASE WHEN query_id IN (SELECT conv_id FROM told) THEN 'so ' || query ELSE query END AS q FROM short),
    gated AS (SELECT *, length({T.trimmed('q')}) >= 4 AND NOT {_CODE} AND (EXISTS (SELECT 1 FROM a WHERE contains(lower(q), alias)) OR {_CLASS} = 'mixed') AND length(q) % 2 = 0 AS expand FROM again),
    rewritten AS MATERIALIZED (SELECT query_id AS item_id, q AS text FROM gated),
    aligned AS MATERIALIZED (SELECT query_id AS item_id, q || CASE WHEN expand THEN ' retrieval searching' ELSE '' END AS text FROM gated),
    {T.unit_vectors('pvec', '(SELECT * FROM short WHERE query_id % 3 < 2)', 'query_id', 'query')}, {T.unit_vectors('rvec', 'rewritten', 'item_id', 'text')},
    near AS (SELECT r.item_id AS query_id, CASE p.query_id % 3 WHEN 0 THEN 'global' ELSE 'local' END AS intent, p.query_id, round(sum(p.w * r.w), 6) AS s FROM rvec r JOIN pvec p USING (dim) GROUP BY r.item_id, p.query_id),
    intents AS (SELECT query_id, intent, round(max(greatest(s, 0)), 7) AS s FROM near GROUP BY 1, 2),
    went AS (SELECT i.item_id AS query_id, max(s) FILTER (WHERE intent = 'global') AS g, max(s) FILTER (WHERE intent = 'local') AS l FROM rewritten i LEFT JOIN intents n ON n.query_id = i.item_id GROUP BY 1),
    routed AS MATERIALIZED (SELECT query_id, CASE WHEN coalesce(g, 0) >= 0.45 AND coalesce(g, 0) - coalesce(l, 0) >= 0.1 THEN 'global' ELSE 'local' END AS route FROM went)"""

_LOCAL = S.SQL["retrieve_full"].replace(T.VECTORS, T.VECTORS.replace("FROM benchmark", "FROM aligned")).replace("FROM benchmark", "FROM rewritten")
_HEAD, _TAIL = _LOCAL.split("SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY first, chunk_index, pos)")
_CENTRAL = re.sub(r"\b(w|once|top|deg)\b", r"c_\1", S._CENTRAL.replace(T.TRIPLES + ",", ""))
_WHOLE = f"""{_HEAD.replace('WITH ', f'WITH {_ASKED}, ', 1)}, {_CENTRAL},
    v AS (SELECT chunk_id, count(*) AS n FROM cen GROUP BY 1), top3 AS (SELECT chunk_id FROM v ORDER BY n DESC, chunk_id LIMIT 3),
    wide AS (SELECT 'global_kg_macro' AS id, 'Knowledge Graph Macro' AS source, 1.0::DOUBLE AS score FROM (SELECT 1) WHERE EXISTS (SELECT 1 FROM cen) UNION ALL SELECT chunk_id, d.source, 0.9::DOUBLE FROM top3 JOIN documents d ON d.doc_id = regexp_extract(chunk_id, '(\\d+)$', 1)::BIGINT),
    parts AS (SELECT query_id, 0 AS section, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS pos, id, source, 'global' AS kind, score FROM routed CROSS JOIN wide WHERE route = 'global'
        UNION ALL SELECT query_id, 1, row_number() OVER (PARTITION BY query_id ORDER BY first, chunk_index, pos), id::VARCHAR, source, kind, score FROM fi
        UNION ALL SELECT DISTINCT query_id, 2, 1, 'kg_subgraph', 'Knowledge Graph Subgraph', 'subgraph', 1.0::DOUBLE FROM kept),
    ctx AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY section, pos)::INT AS ctx_pos, id, source, kind, score FROM parts)"""


@query(_WHOLE + " SELECT * FROM ctx")
def request_contexts(spark, d):
    """Contexts of requests of both routes, in order."""
    return _request(spark, d)[1].drop("text")


@query(_WHOLE + """ SELECT g.query_id, route AS route_decision, 'hybrid' AS mode, q <> query AS rewrite_triggered, query AS original_query, CASE WHEN q <> query THEN q ELSE '' END AS rewritten_query, expand AS align_triggered,
        al.text AS aligned_query, true AS rerank_active, CASE WHEN expand THEN 'aligned' ELSE 'fallback' END AS reason, n::INT AS n_contexts, ids
    FROM gated g JOIN routed USING (query_id) JOIN aligned al ON al.item_id = g.query_id JOIN (SELECT query_id, count(*) AS n, string_agg(id, ',' ORDER BY ctx_pos) AS ids FROM ctx GROUP BY 1) USING (query_id)""")
def request_trace(spark, d):
    """The same requests as one row each, with what the trace tells."""
    asked, rows = _request(spark, d)
    t = RQ.traced(asked, rows)
    named = [f"trace.{n}" for n in ("route_decision", "mode", "rewrite_triggered", "original_query", "rewritten_query", "align_triggered", "aligned_query", "rerank_active")]
    reason = F.try_variant_get(F.col("trace.query_alignment"), "$.reason", "string").alias("reason")
    return t.select("query_id", *named, reason, F.size("contexts").alias("n_contexts"), F.array_join(F.transform("contexts", lambda c: c["id"]), ",").alias("ids"))
